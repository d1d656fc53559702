"""Shared helpers: scratch tables on shared storage, ranks in large groups, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: White space as the word rules define it: space, tab, line feed, vertical tab, form feed, return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a batch of texts that goes to Python.
BATCH_KEY, TEXT_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000
#: Rows of a counted table of numbers and short keys that every task may hold.
BROADCAST_ROWS = 50_000
#: Edges that one task contracts at a time.
CONTRACT_EDGES = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only where the session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="varscope-shared-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Lower the rows of an Arrow batch for the session, so that whole texts fit beside the heap on both sides."""
    if int(spark.conf.get(BATCH_KEY)) > TEXT_BATCH_ROWS:
        spark.conf.set(BATCH_KEY, TEXT_BATCH_ROWS)


def text_slices(batch: pa.RecordBatch, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose ``text`` has ``most_bytes`` and one more text at most."""
    size = np.cumsum(pc.binary_length(batch["text"]).to_numpy().astype(np.int64))
    cuts = [0, *(np.nonzero(np.diff(size // most_bytes))[0] + 1).tolist(), len(batch)]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, beside which an operator can put columns of any name."""
    return F.struct(*["`" + c.replace("`", "``") + "`" for c in df.columns])


def checkpointed(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def buckets_for(rows: int, per_bucket: int) -> int:
    return max(1, -(-rows // per_bucket))


def rank_in_groups(df: DataFrame, groups: Sequence[str], coarse: Sequence[str], fine: Sequence[str],
                   name: str = "rank") -> DataFrame:
    """Add the 0-based rank of each row in its group, ordered by ``coarse`` and then ``fine`` columns.

    No task sees a whole group: rows are numbered inside a (group, coarse) cell, and a cell starts where the
    counts of the cells before it end. ``groups`` and ``coarse`` must hold no nulls.
    """
    keys = [*groups, *coarse]
    before = Window.partitionBy(*groups).orderBy(*coarse).rowsBetween(Window.unboundedPreceding, -1)
    starts = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
              .select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")))
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(*fine)).cast("bigint")
    return (df.withColumn("__local", local).join(starts, keys)
            .withColumn(name, F.col("__start") + F.col("__local") - 1).drop("__start", "__local"))


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replace the edges of a part by one edge from each node to the smallest node it reaches there."""
    def stars(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        nodes, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
        parent = list(range(len(nodes)))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in zip(codes[: len(a)].tolist(), codes[len(a):].tolist()):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        roots = np.fromiter((find(i) for i in range(len(nodes))), dtype=np.int64, count=len(nodes))
        moved = roots != np.arange(len(nodes))
        return pd.DataFrame({"a": nodes[moved], "b": nodes[roots[moved]]})

    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= CONTRACT_EDGES:
            whole = pd.concat(held)
            yield stars(whole["a"].to_numpy(), whole["b"].to_numpy())
            held, size = [], 0
    if held:
        whole = pd.concat(held)
        yield stars(whole["a"].to_numpy(), whole["b"].to_numpy())


def components(edges: DataFrame, local_edges: int = CONTRACT_EDGES) -> DataFrame:
    """Connected components of ``edges`` (a, b: long): rows (node, component), component the smallest node.

    Parts contract their own edges. Where at most ``local_edges`` are left, one task of that bounded size contracts
    the rest; more go through large-star and small-star rounds, each cut with a checkpoint, whose number grows with
    the logarithm of the longest path. Nodes without an edge are not returned.
    """
    a, b = F.col("a"), F.col("b")
    now = checkpointed(edges.select(a.cast("bigint"), b.cast("bigint")).where(a != b)
                       .mapInPandas(_contract, "a bigint, b bigint").distinct())
    print_of = [F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
    mark = now.agg(*print_of).first()
    while mark[0]:
        if mark[0] <= local_edges:
            now = now.coalesce(1).mapInPandas(_contract, "a bigint, b bigint")
            break
        # Large star: every larger neighbour of a node goes to the smallest node around it.
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (both.join(least, "a").where(b > a)
                 .select(b.alias("a"), F.least("a", "m").alias("b")).distinct())
        # Small star: a node and its smaller neighbours go to the smallest of these.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(b == F.col("m"), a).otherwise(b).alias("a"), F.col("m").alias("b"))
        now = checkpointed(small.where(a != b).distinct())
        new = now.agg(*print_of).first()
        if new == mark:
            break
        mark = new
    return now.select(a.alias("node"), b.alias("component"))


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``df``, marked for broadcast if it was counted and has no more than ``BROADCAST_ROWS`` rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def crc_fold(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
