"""Sharding: a uniform shuffle with exact shard sizes by a hypergeometric communication matrix."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from varscope.llm.common import buckets_for, rank_in_groups, whole_row, written

#: Rows of one logical partition, and of one cell of the second permutation.
ROWS_PER_PARTITION = 10_000
#: Numbers of the communication matrix, which the driver draws.
MOST_DRAWS = 1_000_000
#: Above this many rows the library sampler refuses; the ratio sampler below has no limit.
SAMPLER_ROWS = 10**9


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Successes among ``draws`` of ``good + bad`` without replacement."""
    if good + bad < SAMPLER_ROWS:
        return int(rng.hypergeometric(good, bad, draws)) if draws else 0
    low, high = max(0, draws - bad), min(draws, good)
    mean = draws * (good / (good + bad))
    width = 12 * np.sqrt(mean + 1) + 12
    k = np.arange(max(low, int(mean - width)), min(high, int(mean + width)) + 1, dtype=np.float64)
    # p(k + 1) / p(k), added up as logarithms over all values within twelve deviations.
    steps = np.log(good - k[:-1]) + np.log(draws - k[:-1]) - np.log(k[:-1] + 1) - np.log(bad - draws + k[:-1] + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    total = np.cumsum(np.exp(logs - logs.max()))
    return int(k[np.searchsorted(total, rng.random() * total[-1])])


def communication_matrix(rows: Sequence[int], sizes: Sequence[int], seed: int) -> np.ndarray:
    """Exact numbers of rows that each partition sends to each shard of a uniform random permutation.

    Row sums are ``rows`` and column sums ``sizes``: one partition after another draws from what the shards still take.
    """
    rng = np.random.default_rng(seed)
    left = [int(x) for x in sizes]
    matrix = np.zeros((len(rows), len(left)), dtype=np.int64)
    for p, count in enumerate(rows):
        count, open_rows = int(count), sum(left)
        for s, room in enumerate(left):
            open_rows -= room
            taken = _hypergeometric(rng, room, open_rows, count)
            matrix[p, s] = taken
            count -= taken
            left[s] -= taken
    return matrix


def shuffle_into_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", seed: int = 20_240,
                        rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """Add ``shard`` (int) and ``slot`` (long): a uniform random order cut into shards whose counts differ by at most one.

    Rows are dealt to logical partitions by a hash of the id; the matrix says how many rows of each partition go to
    each shard; a partition orders its rows by a seeded hash and deals them out; every shard orders what it got by
    another seeded hash. The same ids, seed and number of rows give the same result. Only partition counts reach the
    driver, one number per ``rows_per_partition`` rows until the matrix has ``MOST_DRAWS`` numbers; from there on the
    partitions grow instead. Null ids are one id; repeated rows take different slots;
    columns named shard or slot are replaced; no rows give no rows; shards without a row do not appear.
    """
    spark = docs.sparkSession
    plain = docs.drop("shard", "slot")
    own = written(plain.select(whole_row(plain).alias("row"), F.col(id_col).alias("id")), "shard-rows")
    total = own.count()
    parts = min(buckets_for(total, rows_per_partition), max(1, MOST_DRAWS // shards))
    ident = F.coalesce(F.col("id").cast("string"), F.lit("\x00"))
    key = lambda n: F.xxhash64(F.lit(seed + n), ident)
    dealt = own.withColumns({"part": F.pmod(key(0), F.lit(parts)).cast("int"), "key": key(1)})
    counted = dealt.groupBy("part").count().orderBy("part").collect()
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix([r["count"] for r in counted], sizes, seed)
    ends = pd.DataFrame({"part": np.array([r["part"] for r in counted], dtype=np.int32),
                         "ends": [x.tolist() for x in np.cumsum(matrix, axis=1)]})
    limits = spark.createDataFrame(ends if len(ends) else [], "part int, ends array<bigint>")
    place = F.row_number().over(Window.partitionBy("part").orderBy("key", "id")) - 1
    first = dealt.withColumn("place", place).join(limits, "part")
    shard = F.size(F.filter("ends", lambda end: end <= F.col("place"))).cast("int")
    sent = first.withColumn("shard", shard).drop("part", "place", "ends")
    cells = buckets_for(total, rows_per_partition * shards)
    again = sent.withColumns({"key": key(2), "cell": F.pmod(key(3), F.lit(cells)).cast("int")})
    return rank_in_groups(again, ["shard"], ["cell"], ["key", "id"], "slot").select("row.*", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int, id_col: str = "doc_id", **options) -> None:
    """Write ``docs`` as one folder per shard, each in slot order within its files."""
    out = shuffle_into_shards(docs, shards, id_col, **options)
    out.repartition("shard", F.floor(F.col("slot") / ROWS_PER_PARTITION)).sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard").parquet(path)
