import pytest
from pyspark.sql import functions as F

from varscope.llm.mixing import fill_targets, mix_sources, repeat_by_mixture


def _targets(sizes):
    """Share by weight again and again until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    out, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        total = sum(weight[n] for n in open_)
        full = {n for n in open_ if 3 * sizes[n] <= left * weight[n] / total}
        if not full:
            return out | {n: left * weight[n] / total for n in open_}
        for n in full:
            out[n], left = 3.0 * sizes[n], left - 3 * sizes[n]
        open_ -= full
    return out


def test_targets_match_repeated_sharing(spark):
    for sizes in ({"a": 10, "b": 1_000, "c": 5, "d": 0, "e": 70}, {"x": 1}, {"a": 0}, {"a": 9, "b": 1, "c": 1, "d": 300}):
        totals = spark.createDataFrame([("0" + k, v) for k, v in sizes.items()], "key string, source_size bigint")
        got = {r["key"][1:]: r["target"] for r in fill_targets(totals, (5, 2, 1), 3).collect()}
        assert got == pytest.approx(_targets(sizes))


def test_mixture_nears_its_targets_and_is_repeatable(spark):
    docs = spark.range(3_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.least(F.col("id") % 7, F.lit(4)))).alias("source"),
        F.repeat(F.lit("w "), (F.col("id") % 97 + 1).cast("int")).alias("text"))
    rows = mix_sources(docs, rows_per_cell=50).collect()
    assert len(rows) == 3_000 and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    for (_, target), taken in by.items():
        assert abs(sum(taken) - target) <= 97
    assert sum(t for _, t in by) == pytest.approx(sum(s for s, _ in by))
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mix_sources(docs.repartition(5), rows_per_cell=50).collect()))


def test_edges(edge_docs, no_docs):
    rows = mix_sources(edge_docs).collect()
    sizes = sorted((r["doc_id"] or -1, r["size"]) for r in rows)
    assert sizes[0] == (-1, 8) and (3, 0) in sizes and (5, 0) in sizes and (6, 1) in sizes and len(rows) == 12
    copies = repeat_by_mixture(edge_docs)
    assert copies.columns == edge_docs.columns and copies.count() >= 1
    assert {tuple(r) for r in copies.collect()} <= {tuple(r) for r in edge_docs.collect()}
    assert mix_sources(no_docs).count() == 0 and repeat_by_mixture(no_docs).count() == 0


def test_rows_of_one_id_are_taken_each_by_its_own_count(spark):
    """The rows written are those of the mix, also where ids repeat or are null."""
    docs = spark.range(400).select(
        F.when(F.col("id") % 3 != 0, F.col("id") % 5).alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"),
        F.repeat(F.lit("w "), (F.col("id") % 11).cast("int")).alias("text"), F.col("id").alias("__copies"))
    words = repeat_by_mixture(docs).groupBy("source").agg(F.sum(F.size(F.array_remove(F.split("text", " "), ""))).alias("n"))
    mixed = mix_sources(docs.withColumn("doc_id", F.col("__copies")), row_col="__copies")
    wanted = mixed.groupBy("target", "source_size").agg(F.sum("taken").alias("n"))
    got = sorted(r["n"] for r in words.collect())
    targets = sorted(r["target"] for r in wanted.collect())
    assert len(got) == 4 and all(abs(a - b) <= 11 for a, b in zip(got, targets))


def test_copies_are_the_rate_rounded_up_or_down(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"),
                                   F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"))
    for r in mix_sources(docs).collect():
        assert r["copies"] in {int(r["target"] / r["source_size"]), int(r["target"] / r["source_size"]) + 1}
