import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from varscope.llm.filter_audit import (audit_filters, corpus_filters, difference_sizes, earlier_copies, failing_ids, failing_lists, gallop,
                                       merged_windows)

IDS = st.lists(st.integers(0, 300), max_size=80).map(lambda x: np.array(sorted(set(x)), dtype=np.int64))


@settings(max_examples=60, deadline=None)
@given(IDS, st.integers(-1, 301), st.integers(0, 10))
def test_gallop_finds_the_first_greater(ids, bound, at):
    at = min(at, len(ids))
    assert gallop(ids, at, bound) == max(at, int(np.searchsorted(ids, bound, side="right")))


@settings(max_examples=60, deadline=None)
@given(st.lists(IDS, min_size=1, max_size=5), st.integers(1, 9))
def test_windows_cut_all_lists_at_common_ids(lists, stride):
    windows = list(merged_windows(lists, stride))
    for n, ids in enumerate(lists):
        assert np.concatenate([np.zeros(0, int), *[w[n] for w in windows]]).tolist() == ids.tolist()
    last = -1
    for window in windows:
        low, high = min(int(x[0]) for x in window if len(x)), max(int(x[-1]) for x in window if len(x))
        assert low > last and all(len(x) <= stride for x in window)
        last = high


@settings(max_examples=40, deadline=None)
@given(st.lists(IDS, min_size=3, max_size=3), st.lists(IDS, min_size=2, max_size=2))
def test_differences_are_those_of_sets(fails, marks):
    sizes = difference_sizes(fails, marks)
    sets, marked = [set(x.tolist()) for x in fails], [set(x.tolist()) for x in marks]
    for n in range(3):
        for chosen in range(8):
            if chosen >> n & 1:
                continue
            rest = sets[n].difference(*[sets[m] for m in range(3) if chosen >> m & 1])
            assert sizes[n, chosen].tolist() == [len(rest), *[len(rest & m) for m in marked]]


def brute(docs, labels):
    """Every order applied row by row."""
    rows, least = [], {}
    for r in docs:
        if r["doc_id"] is not None:
            least[r["text"] or ""] = min(r["doc_id"], least.get(r["text"] or "", r["doc_id"]))
    for r in docs:
        text = r["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
                 "D": bool(re.search(r"[#$%&*|]", text)), "E": r["doc_id"] is not None and r["doc_id"] > least[text]}
        rows.append((r["source"] or "", {f for f in fails if fails[f]}, *labels.get(r["doc_id"], (False, False))))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, name in enumerate(order, 1):
                gone = [r for r in left if name in r[1]]
                left = [r for r in left if name not in r[1]]
                failing = sum(name in r[1] for r in own)
                total[name] += len(gone)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), sum(r[1] == {name} for r in own),
                                          sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def told(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost",
                                                                     "toxic_lost", "shapley")] for r in df.collect()}


def test_every_order_against_brute_force(spark, edge_docs):
    long = " ".join(f"w{n}" for n in range(250))
    more = spark.createDataFrame(
        [(20, long, "a"), (21, long, "b"), (22, long + " #", "a"), (23, long.upper(), "b"), (24, "x " * 300, "a"), (25, "x " * 300, None),
         (20, long, "a"), (26, "# " * 250, "b")], "doc_id bigint, text string, source string")
    docs = edge_docs.unionByName(more, allowMissingColumns=True)
    labels = spark.createDataFrame([(20, True, False), (20, False, True), (3, True, None), (24, True, True), (99, True, True), (None, True, True)],
                                   "id bigint, good boolean, toxic boolean")
    known = {20: (True, True), 3: (True, False), 24: (True, True)}
    assert told(audit_filters(docs, corpus_filters(), labels)) == brute(docs.collect(), known)


def test_lists_name_the_failing_rows(spark, edge_docs):
    lists, rows = failing_lists(edge_docs, corpus_filters())
    ids = sorted((r["id"] for r in failing_ids(lists, rows, corpus_filters(), "E").collect()), key=str)
    assert ids == [4]
    for row in lists.collect():
        assert all(row[f"list{n}"] == sorted(set(row[f"list{n}"])) for n in range(5))


def test_own_filters_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (2, None, "s"), (3, "a", None)], "doc_id bigint, text string, source string")
    got = audit_filters(docs, {"x": F.size("words") < 2, "y": F.lit(None).cast("boolean")}).collect()
    assert {(r["part"], r["filter_order"], r["step"], r["removed"], r["kept"], r["shapley"]) for r in got} == {
        ("s", "xy", 1, 1, 1, 2), ("s", "xy", 2, 0, 1, 0), ("s", "yx", 1, 0, 2, 0), ("s", "yx", 2, 1, 1, 2),
        ("", "xy", 1, 1, 0, 2), ("", "xy", 2, 0, 0, 0), ("", "yx", 1, 0, 1, 0), ("", "yx", 2, 1, 0, 2)}
    with pytest.raises(ValueError, match="1 to 6"):
        audit_filters(docs, {})


def test_copies_in_hot_and_other_groups(spark):
    rows = spark.range(5_000).select(
        F.col("id").alias("row"), F.when(F.col("id") % 10 != 0, F.col("id")).alias("id"), F.lit("p").alias("part"),
        F.when(F.col("id") < 2_000, F.lit("hot")).otherwise((F.col("id") % 2_000).cast("string")).cast("binary").alias("digest"))
    least = {}
    all_rows = rows.collect()
    for r in all_rows:
        if r["id"] is not None:
            least[bytes(r["digest"])] = min(r["id"], least.get(bytes(r["digest"]), r["id"]))
    expected = sorted(r["row"] for r in all_rows if r["id"] is not None and r["id"] > least[bytes(r["digest"])])
    assert sorted(r["row"] for r in earlier_copies(rows).collect()) == expected


def test_no_rows(spark, no_docs):
    assert audit_filters(no_docs, corpus_filters()).count() == 0
