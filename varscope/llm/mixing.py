"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from varscope.llm.common import WORD, bounded_broadcast, buckets_for, rank_in_groups, whole_row, written

#: Rows of one cell in which a task numbers documents of equal size.
ROWS_PER_CELL = 10_000
#: Equally spaced offsets among which a source takes the one that brings it nearest to its target.
OFFSETS = 32


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def fill_targets(totals: DataFrame, weights: Sequence[float], limit: float) -> DataFrame:
    """Add ``target`` to rows (key, source_size), one per source.

    Weights go round the sources in key order and share the total; a source stops at ``limit`` times its size and
    the excess goes to the others by weight. Sources in order of limit per weight fill up first, so the level at
    which the rest settle is the largest one over all prefixes that might be full.
    """
    place = F.row_number().over(Window.orderBy("key")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    rows = totals.withColumn("weight", weight).withColumn("full", F.col("source_size") * float(limit))
    order = Window.orderBy(F.col("full") / F.col("weight"), "key")
    before = F.coalesce(F.sum("full").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    rows = rows.withColumn("level", (F.sum("source_size").over(everything) - before) / rest)
    return rows.withColumn("target", F.least(F.col("full"), F.col("weight") * F.max("level").over(everything))).drop(
        "weight", "full", "level")


def _copies(rank: Column, rate: Column, offset: Column, limit: float) -> Column:
    """Integer boundaries between ``offset + rank * rate`` and the same one document on."""
    crossed = F.floor(offset + (rank + 1) * rate) - F.floor(offset + rank * rate)
    return F.least(crossed, F.lit(int(limit))).cast("bigint")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), limit: int = 3, id_col: str = "doc_id",
                text_col: str = "text", source_col: str = "source", rows_per_cell: int = ROWS_PER_CELL,
                row_col: str | None = None) -> DataFrame:
    """One row per document: id, size (words), source_size, target, copies and taken (copies times size).

    Documents of a source stand in order of size, then of a hash of the id. Each expects target / source size copies,
    and gets one for every whole number that the running sum passes, from an offset between 0 and 1. The order by size
    keeps the words taken within one long document of the target at any offset; of ``OFFSETS`` equally spaced ones,
    beginning at one drawn from the source's name, a source takes the nearest to its target. Null sources are one
    source, last in order. Null or empty texts have size 0. A source of size 0 has target 0 and takes nothing.
    Repeated rows count as often as they occur. The same rows always give the same result. ``row_col`` names a column
    that tells rows with equal ids apart and is returned too. Other columns are not read.

    Choosing the offset departs from one random draw: the expected copies of a document are no longer its rate. They
    stay between the floor and the ceiling of it; what is lost is that rate as an average over seeds.
    """
    key = F.coalesce(F.concat(F.lit("0"), F.col(source_col)), F.lit("1"))
    own = [] if row_col is None else ["row"]
    rows = written(docs.select(F.col(id_col).alias("id"), *[F.col(row_col).alias(n) for n in own], key.alias("key"),
                               word_count(text_col).alias("size")), "mix-sizes")
    totals = rows.groupBy("key").agg(F.sum("size").alias("source_size"))
    first = F.conv(F.substring(F.md5(F.col("key")), 1, 8), 16, 10).cast("double") / float(2**32)
    sources = rows.select("key").distinct().count()
    targets = fill_targets(totals, weights, limit).withColumns({
        "rate": F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0), "first": first})
    # A cell holds documents of one source and size; a size that many share is split by a hash.
    cells = buckets_for(rows.count(), rows_per_cell)
    hashed = rows.withColumn("order", F.xxhash64("id")).withColumn("cell", F.pmod("order", F.lit(cells)).cast("int"))
    ranked = written(rank_in_groups(hashed, ["key"], ["size", "cell"], ["order", "id", *own]).select("id", *own, "key", "size", "rank"),
                     "mix-ranks")
    # One row per source, counted: a hot source's documents stay where they are.
    known = ranked.join(bounded_broadcast(written(targets, "mix-targets"), sources), "key")
    shift = lambda n: F.pmod(F.col("first") + n / OFFSETS, F.lit(1.0))
    drawn = lambda offset: _copies(F.col("rank"), F.col("rate"), offset, limit)
    sums = known.groupBy("key").agg(F.first("target").alias("target"), F.first("first").alias("first"), F.array(
        *[F.sum(drawn(shift(n)) * F.col("size")) for n in range(OFFSETS)]).alias("sums"))
    gaps = F.transform("sums", lambda x, n: F.struct(F.abs(x - F.col("target")).alias("gap"), n.alias("n")))
    offsets = sums.select("key", F.pmod(F.col("first") + F.array_min(gaps)["n"] / float(OFFSETS), F.lit(1.0)).alias("offset"))
    out = known.join(bounded_broadcast(offsets, sources), "key").withColumn("copies", drawn(F.col("offset")))
    return out.select(F.col("id").alias(id_col), *[F.col(n).alias(row_col) for n in own], "size", "source_size", "target", "copies",
                      (F.col("copies") * F.col("size")).alias("taken"))


def repeat_by_mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix_sources`` takes it, with their columns as they are.

    Rows are numbered and kept with their numbers, so that rows with equal or null ids are taken each by its own count.
    """
    rows = written(docs.select(whole_row(docs).alias("row"), F.monotonically_increasing_id().alias("number")), "mix-rows")
    plain = rows.select(*[F.col("row").getField(c).alias(n) for n, c in (("id", id_col), ("text", text_col), ("source", source_col))], "number")
    taken = mix_sources(plain, id_col="id", row_col="number", **options).where("copies > 0").select("number", "copies")
    return rows.join(taken, "number").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
