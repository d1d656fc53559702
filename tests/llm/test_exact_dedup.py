import hashlib
import re

import pytest

from varscope.llm.common import new_path
from varscope.llm.exact_dedup import DigestIndex, digests, drop_exact_copies, exact_dedup


def _expected(rows):
    groups = {}
    for r in rows:
        plain = re.sub("[\x20\x09-\x0d]", "", r["text"] or "")
        groups.setdefault(plain, []).append(r)
    out = []
    for plain, members in groups.items():
        best = min(members, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))["doc_id"]
        out += [(r["doc_id"], best, len(members), r["doc_id"] == best, hashlib.sha256(plain.encode()).hexdigest()) for r in members]
    return sorted(out, key=str)


def test_edges_match_brute_force(edge_docs):
    got = sorted((tuple(r) for r in exact_dedup(edge_docs).collect()), key=str)
    assert got == _expected(edge_docs.select("doc_id", "text").collect())


def test_kept_rows_are_one_per_text_with_their_columns(edge_docs, no_docs):
    kept = drop_exact_copies(edge_docs)
    assert kept.columns == edge_docs.columns
    assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in edge_docs.collect()}
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 2, 5, 6, 7, 8, 9, 10]
    assert drop_exact_copies(no_docs).count() == 0 and exact_dedup(no_docs).count() == 0


def test_index_persists_and_takes_only_new_digests(spark, edge_docs):
    place = new_path(spark, "index-test")
    index = DigestIndex(spark, place, buckets=4)
    exact_dedup(edge_docs, index)
    before = index.table().count()
    again = DigestIndex(spark, place, buckets=4)
    batch = spark.createDataFrame([(90, "word"), (91, "new text"), (92, "newtext ")], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup(batch, again).collect()}
    assert got == {90: (6, False), 91: (92, False), 92: (92, True)} or got == {90: (6, False), 91: (91, True), 92: (91, False)}
    assert again.table().count() == before + 1
    plan = digests(batch).join(again.table().hint("merge"), "digest", "left_anti")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan


def test_index_reopens_with_its_own_buckets_in_another_session(spark, edge_docs):
    place, key = new_path(spark, "index-reopen"), "spark.sql.shuffle.partitions"
    parts = spark.conf.get(key)
    try:
        spark.conf.set(key, 7)
        first = DigestIndex(spark, place)
        before = sorted(map(str, exact_dedup(edge_docs, first).collect()))
        size = first.table().count()
        spark.sql(f"DROP TABLE {first.name}")  # a later session has no catalog entry
        spark.conf.set(key, 3)
        again = DigestIndex(spark, place)
        assert again.buckets == 7
        assert sorted(map(str, exact_dedup(edge_docs, again).collect())) == before
        assert again.table().count() == size
        for other in ({"buckets": 3}, {"id_type": "string"}):
            with pytest.raises(ValueError, match="7 buckets"):
                DigestIndex(spark, place, **other)
        assert DigestIndex(spark, place, "long", 7).buckets == 7
    finally:
        spark.conf.set(key, parts)


def test_indexes_whose_locations_differ_in_a_sign(spark, edge_docs):
    """Names are told apart by the whole location, also where long paths end alike."""
    place = new_path(spark, "index")
    ends = ["idx-a", "idx_a", "x/" + "y" * 80, "z/" + "y" * 80]
    for n, end in enumerate(ends):
        batch = spark.createDataFrame([(n, f"text of {end}")], "doc_id bigint, text string")
        assert [r["keep_id"] for r in exact_dedup(batch, DigestIndex(spark, f"{place}/{end}")).collect()] == [n]
    assert [DigestIndex(spark, f"{place}/{end}").table().count() for end in ends] == [1] * 4
