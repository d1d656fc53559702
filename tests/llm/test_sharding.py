from collections import Counter

import numpy as np

from varscope.llm import sharding
from varscope.llm.sharding import communication_matrix, shuffle_into_shards, write_shards


def test_matrix_has_exact_margins_and_the_right_mean():
    rows, sizes = [10, 0, 25, 65], [34, 33, 33]
    total = np.zeros((4, 3))
    for seed in range(400):
        m = communication_matrix(rows, sizes, seed)
        assert m.sum(1).tolist() == rows and m.sum(0).tolist() == sizes
        total += m
    assert np.abs(total / 400 - np.outer(rows, sizes) / 100).max() < 0.5


def test_ratio_sampler_agrees_with_the_library(monkeypatch):
    rng = np.random.default_rng(1)
    library = [sharding._hypergeometric(rng, 60, 40, 20) for _ in range(4_000)]
    monkeypatch.setattr(sharding, "SAMPLER_ROWS", 0)
    own = [sharding._hypergeometric(rng, 60, 40, 20) for _ in range(4_000)]
    assert abs(np.mean(own) - 12) < 0.15 and abs(np.std(own) - np.std(library)) < 0.15
    assert sharding._hypergeometric(rng, 0, 5, 3) == 0 and sharding._hypergeometric(rng, 5, 0, 3) == 3
    assert sharding._hypergeometric(rng, 10**11, 3 * 10**11, 40_000) in range(9_000, 11_000)


def test_shards_are_even_gapless_and_repeatable(spark, edge_docs, no_docs, tmp_path):
    docs = spark.range(1_003).withColumnRenamed("id", "doc_id")
    first = shuffle_into_shards(docs, 7, rows_per_partition=100).collect()
    sizes = Counter(r["shard"] for r in first)
    assert set(sizes.values()) == {143, 144} and sum(sizes.values()) == 1_003
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in first if r["shard"] == s) == list(range(n))
    assert sorted(map(tuple, first)) == sorted(map(tuple, shuffle_into_shards(docs, 7, rows_per_partition=100).collect()))
    # Neighbouring ids land together no more often than by chance.
    shard = {r["doc_id"]: r["shard"] for r in first}
    assert 0.08 < sum(shard[i] == shard[i + 1] for i in range(1_002)) / 1_002 < 0.21
    edge = shuffle_into_shards(edge_docs, 5).collect()
    assert {tuple(r)[:-2] for r in edge} <= {tuple(r) for r in edge_docs.drop("shard", "slot").collect()}
    assert len(edge) == 12 and max(Counter(r["shard"] for r in edge).values()) == 3
    assert shuffle_into_shards(no_docs, 5).count() == 0
    write_shards(docs, f"{tmp_path}/out", 3)
    assert {r["shard"]: r["count"] for r in spark.read.parquet(f"{tmp_path}/out").groupBy("shard").count().collect()} == {0: 335, 1: 334, 2: 334}


def test_partitions_stop_growing_before_the_matrix_does(spark, monkeypatch):
    monkeypatch.setattr(sharding, "MOST_DRAWS", 20)
    docs = spark.range(1_000).withColumnRenamed("id", "doc_id")
    rows = shuffle_into_shards(docs, 7, rows_per_partition=10).collect()
    assert sorted(Counter(r["shard"] for r in rows).values()) == [142, 143, 143, 143, 143, 143, 143]
    assert len({(r["shard"], r["slot"]) for r in rows}) == 1_000
