"""Slices of a sorted table, near the top or deep inside it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, functions as F, types as T

from varscope.functions.columns import ref
from varscope.session import freeze

# A slice that ends within this many rows is a top-k: every task keeps that many rows at most.
TOP_ROWS = 10_000


def range_parts(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The rows ranged by ``order`` with the number of their part in ``_parte``, frozen.

    Parts follow one another in the order. Freezing keeps each row in its part even when a lost
    task runs again, so that sums taken over the parts stay true.
    """
    return freeze(df.repartitionByRange(*order).withColumn("_parte", F.spark_partition_id()))


def _compare(names: Sequence[tuple[str, bool]], bound: Row) -> Column:
    """-1, 0 or 1: where a row stands to a bound in the order of its keys, nulls last."""
    result = F.lit(0)
    for name, up in reversed(names):
        key, value = F.col(name), bound[name]
        if value is None:
            here = F.when(key.isNotNull(), -1)
        else:
            here = F.when(key.isNull(), 1).when(key < F.lit(value), -1 if up else 1).when(key > F.lit(value), 1 if up else -1)
        result = F.coalesce(here, result)
    return result


def ordered_slice(
    df: DataFrame, keys: Sequence[tuple[Column, bool]], start: int, count: int
) -> DataFrame:
    """Rows ``start … start + count`` in the order of ``keys`` (column, ascending); nulls last.

    Ties are broken by a hash of the whole row, so that slices join up without gap or repeat and a
    value that fills a third of the table is still many short ranges. A slice deep inside the
    table is found from its keys alone: one job ranges them and returns the size and the ends of
    every range, a few numbers each; then only the rows between the ends that enclose the slice
    are read and sorted.
    """
    names = [(f"_k{i}", up) for i, (_, up) in enumerate(keys)] + [("_fila", True)]
    # A hash takes no collated text, and the text itself tells rows apart.
    cells = [ref(f.name).cast("string") if isinstance(f.dataType, T.StringType) else ref(f.name)
             for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    keyed = df.select("*", *[key.alias(name) for (name, _), (key, _) in zip(names, keys)], F.xxhash64(*cells).alias("_fila"))
    order = [F.col(n).asc_nulls_last() if up else F.col(n).desc_nulls_last() for n, up in names]
    drop = [n for n, _ in names]
    if start + count <= TOP_ROWS:
        return keyed.orderBy(*order).offset(start).limit(count).drop(*drop)

    ranged = keyed.select(*drop).repartitionByRange(*order).sortWithinPartitions(*order).select(
        F.struct(*drop).alias("_k"), F.spark_partition_id().alias("_parte"), F.monotonically_increasing_id().alias("_i"))
    ends = ranged.groupBy("_parte").agg(
        F.count("*").alias("n"), F.min_by("_k", "_i").alias("desde"), F.max_by("_k", "_i").alias("hasta"))
    before, skipped, low, high = 0, 0, None, None
    for row in ends.orderBy("_parte").collect():
        if before < start + count and before + row["n"] > start:
            if low is None:
                low, skipped = row["desde"], before
            high = row["hasta"]
        before += row["n"]
    if low is None:
        return df.limit(0)
    inside = keyed.filter((_compare(names, low) >= 0) & (_compare(names, high) <= 0))
    return inside.orderBy(*order).offset(start - skipped).limit(count).drop(*drop)
