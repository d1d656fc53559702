"""Exact quantiles (linear interpolation) for groups of any size.

Small groups use the built-in ``percentile``, whose state is one map per group. A large group
would make that map as large as the group, so a mergeable sketch of fixed size first brackets each
quantile: its rank error is at most ``RANK_ERROR`` of the rows. A second scan counts the rows
between the brackets and the values inside them, which places every wanted rank exactly; should a
bracket miss its rank, or be too large to be ordered at once, it is narrowed: count the values per
bin, keep the bin that holds the rank, repeat inside it. Every scan counts before its shuffle.
Should more groups be large than are bracketed together, the remaining ones (each a small share of
all rows by then) are ranked by a sort that can spill.

The mode ``approx`` stops at the sketch: one scan, values of the column itself, ranks off by at
most ``RANK_ERROR`` of the rows of the group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from varscope.functions.columns import local_rows

SMALL_GROUP = 200_000     # rows per group that one task may order
MAX_LARGE_GROUPS = 5_000  # groups narrowed together; any other is at most 1/5,000 of the rows
BINS = 1_024
SKETCH_ACCURACY = 20_000  # entries of a sketch, about
RANK_ERROR = 1 / SKETCH_ACCURACY
INSIDE_ROWS = 2_000_000   # values inside the brackets of a group that one task may order
EXACT, APPROX = "exact", "approx"


def _wanted_ranks(n: int, probs: Sequence[float]) -> list[int]:
    places = [(n - 1) * p for p in probs]
    return sorted({r for h in places for r in (math.floor(h), math.ceil(h))})


def _between(rest: Column) -> Column:
    """Point between the two order statistics of a group, by the arithmetic of ``percentile``, so that
    a result does not change in its last bit with the size of the group."""
    low, high = F.min("x"), F.max("x")
    return F.when(low == high, low).otherwise(low * (1 - rest) + high * rest)


def quantiles(
    long: DataFrame, probs: Sequence[float], by: str = "columna", small_group: int = SMALL_GROUP,
    sizes: Sequence | None = None, few: bool = False, mode: str = EXACT,
) -> DataFrame:
    """``by, prob, valor`` for a frame with columns ``by`` (not null) and ``x`` (double, not null).

    ``sizes`` may hold rows ``by, n, lo, hi`` of every group when the caller already knows them.
    ``few`` says that there are few groups (columns, boxes), so that their sketches are made by the
    scan that finds their sizes. ``mode`` is ``exact`` or ``approx``.
    """
    probs = sorted(set(probs))
    if mode not in (EXACT, APPROX):
        raise ValueError(f"mode must be {EXACT} or {APPROX}, not {mode}")
    if mode == APPROX:
        return _by_sketch(long, probs, by)
    if few:
        sizes = _sketches(long, probs, by).collect()
    if sizes is not None:
        sizes = sorted(sizes, key=lambda r: -r["n"])
    else:
        # The largest groups only: a bounded driver table whatever the number of groups.
        sizes = (
            long.groupBy(by).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
            .orderBy(F.desc("n"), by).limit(MAX_LARGE_GROUPS + 1).collect()
        )
    large = [r for r in sizes[:MAX_LARGE_GROUPS] if r["n"] > small_group]
    if not large:
        return _by_percentile(long, probs, by)
    key_table = local_rows(long.sparkSession, [(r[by],) for r in large],
                           T.StructType([T.StructField(by, long.schema[by].dataType)]))
    if not few:
        large = _sketches(long.join(F.broadcast(key_table), by), probs, by).collect()
    placed = _interpolated(long, large, _ranked_values(long, large, probs, by), probs, by)
    if len(large) == len(sizes):
        return placed
    rest = long.join(F.broadcast(key_table), by, "left_anti")
    biggest_left = sizes[len(large)]["n"]
    method = _by_percentile if biggest_left <= small_group else _by_sorting
    return placed.unionByName(method(rest, probs, by))


def _by_sketch(long: DataFrame, probs: Sequence[float], by: str) -> DataFrame:
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    return (
        long.groupBy(by).agg(F.percentile_approx("x", wanted, SKETCH_ACCURACY).alias("q"))
        .select(by, F.explode(F.arrays_zip(wanted.alias("prob"), F.col("q").alias("valor"))).alias("z"))
        .select(by, F.col("z.prob").alias("prob"), F.col("z.valor").alias("valor"))
    )


def _margins(prob: float) -> tuple[float, float]:
    """Ranks, as shares, whose sketched values lie on either side of a quantile, whatever the error."""
    return max(0.0, prob - 3 * RANK_ERROR), min(1.0, prob + 3 * RANK_ERROR)


def _sketches(long: DataFrame, probs: Sequence[float], by: str) -> DataFrame:
    """``by, n, lo, hi, bordes``: one row per group, ``bordes`` the values at all margins in order."""
    margins = F.array(*[F.lit(m) for m in sorted({m for p in probs for m in _margins(p)})])
    return long.groupBy(by).agg(
        F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"),
        F.percentile_approx("x", margins, SKETCH_ACCURACY).alias("bordes"))


def _brackets(group, probs: Sequence[float]) -> list[list]:
    """Disjoint brackets ``[lo, hi, ranks]`` of a sketched group, in order."""
    at = dict(zip(sorted({m for p in probs for m in _margins(p)}), group["bordes"]))
    found: list[list] = []
    for p in probs:
        low, high = (at[m] for m in _margins(p))
        # The ends of the ranking are known, the sketch need not hold them.
        low = group["lo"] if _margins(p)[0] == 0.0 else low
        high = group["hi"] if _margins(p)[1] == 1.0 else high
        ranks = _wanted_ranks(group["n"], [p])
        if found and low <= found[-1][1]:
            found[-1][1] = max(high, found[-1][1])
            found[-1][2] = sorted({*found[-1][2], *ranks})
        else:
            found.append([low, high, ranks])
    return found


def _ranked_values(long: DataFrame, groups: list, probs: Sequence[float], by: str) -> list[tuple]:
    """Rows ``group, rank, value`` of the wanted ranks of sketched groups: a few per group.

    One scan gives each row of a group the bracket it is in or the gap between two brackets. Gaps
    are counted, brackets are counted by value, and the running total places the ranks.
    """
    spark, key_type = long.sparkSession, long.schema[by].dataType
    schema = T.StructType([
        T.StructField(by, key_type), T.StructField("tramo", T.IntegerType()), T.StructField("dentro", T.BooleanType()),
        T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType()), T.StructField("rangos", T.ArrayType(T.LongType()))])
    parts, narrow = [], []
    for group in groups:
        brackets = _brackets(group, probs)
        if 6 * RANK_ERROR * group["n"] * len(brackets) > INSIDE_ROWS:
            narrow.append(group)
            continue
        last = -math.inf
        for lo, hi, ranks in brackets:
            parts.append((group[by], len(parts), False, last, lo, []))
            parts.append((group[by], len(parts), True, lo, hi, ranks))
            last = hi
        parts.append((group[by], len(parts), False, last, math.inf, []))
    found = []
    if parts:
        table = F.broadcast(local_rows(spark, parts, schema).withColumnRenamed(by, "_clave"))
        here = F.when(F.col("dentro"), F.col("x").between(F.col("lo"), F.col("hi"))).otherwise(
            (F.col("x") > F.col("lo")) & (F.col("x") < F.col("hi")))
        counted = long.join(table, (F.col(by) == F.col("_clave")) & here).groupBy(
            by, "tramo", F.when(F.col("dentro"), F.col("x")).alias("x")).agg(F.count("*").alias("n"))
        upto = Window.partitionBy(by).orderBy("tramo", "x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = counted.withColumn("hasta", F.sum("n").over(upto)).join(table.select("tramo", "rangos"), "tramo")
        hits = F.filter("rangos", lambda r: (r >= F.col("hasta") - F.col("n")) & (r < F.col("hasta")))
        found = [tuple(r) for r in ranked.select(by, F.explode(hits).alias("rango"), "x").collect()]
    known = {(k, rank) for k, rank, _ in found}
    missed = [g for g in groups if g not in narrow and any((g[by], r) not in known for r in _wanted_ranks(g["n"], probs))]
    missed += narrow
    again = {g[by] for g in missed}
    return [f for f in found if f[0] not in again] + (_by_narrowing(long, missed, probs, by) if missed else [])


def _interpolated(long: DataFrame, groups: list, values: list[tuple], probs: Sequence[float], by: str) -> DataFrame:
    """Quantiles from the values at their ranks: two rows per quantile and group, made on the driver."""
    spark, key_type = long.sparkSession, long.schema[by].dataType
    chosen = local_rows(spark, values, T.StructType([
        T.StructField(by, key_type), T.StructField("rango", T.LongType()), T.StructField("x", T.DoubleType())]))
    wanted = []
    for r in groups:
        for p in probs:
            h = (r["n"] - 1) * p
            for rank in {math.floor(h), math.ceil(h)}:
                wanted.append((r[by], float(p), rank, h - math.floor(h)))
    schema = T.StructType([
        T.StructField(by, key_type), T.StructField("prob", T.DoubleType()),
        T.StructField("rango", T.LongType()), T.StructField("resto", T.DoubleType()),
    ])
    targets = local_rows(spark, wanted, schema)
    return (
        chosen.join(F.broadcast(targets), [by, "rango"]).groupBy(by, "prob", "resto")
        .agg(_between(F.col("resto")).alias("valor")).select(by, "prob", "valor")
    )


def _by_percentile(long: DataFrame, probs: Sequence[float], by: str) -> DataFrame:
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    return (
        long.groupBy(by).agg(F.percentile("x", wanted).alias("q"))
        .select(by, F.explode(F.arrays_zip(wanted.alias("prob"), F.col("q").alias("valor"))).alias("z"))
        .select(by, F.col("z.prob").alias("prob"), F.col("z.valor").alias("valor"))
    )


def _by_sorting(long: DataFrame, probs: Sequence[float], by: str) -> DataFrame:
    """Rank the distinct values of each group by a windowed sort, which spills to disk."""
    counted = long.groupBy(by, "x").agg(F.count("*").alias("n"))
    sizes = counted.groupBy(by).agg(F.sum("n").alias("total"))
    upto = Window.partitionBy(by).orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("hasta", F.sum("n").over(upto)).join(sizes, by)
    places = F.transform(F.array(*[F.lit(float(p)) for p in probs]), lambda p: F.struct(
        p.alias("prob"), ((F.col("total") - 1) * p).alias("lugar")))
    here = lambda rank: (rank >= F.col("hasta") - F.col("n")) & (rank < F.col("hasta"))
    hits = F.filter(places, lambda q: here(F.floor(q["lugar"])) | here(F.ceil(q["lugar"])))
    return (
        ranked.select(by, "x", F.inline(hits)).withColumn("resto", F.col("lugar") - F.floor("lugar"))
        .groupBy(by, "prob", "resto").agg(_between(F.col("resto")).alias("valor"))
        .select(by, "prob", "valor")
    )


def _bracket_table(spark, key_type: T.DataType, by: str, brackets: list[tuple]) -> DataFrame:
    """Driver-made: at most two brackets per wanted quantile and large group."""
    schema = T.StructType([
        T.StructField(by, key_type), T.StructField("tramo", T.IntegerType()),
        T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType()),
        T.StructField("antes", T.LongType()), T.StructField("rangos", T.ArrayType(T.LongType())),
    ])
    return local_rows(spark, brackets, schema)


def _inside(long: DataFrame, table: DataFrame, by: str) -> DataFrame:
    """Values that fall in a bracket of their group: ``tramo, lo, hi, x``."""
    edges = table.select(F.col(by).alias("_clave"), "tramo", "lo", "hi")
    match = (F.col(by) == F.col("_clave")) & F.col("x").between(F.col("lo"), F.col("hi"))
    return long.join(F.broadcast(edges), match).select("tramo", "lo", "hi", "x")


def _ranked_inside(long: DataFrame, table: DataFrame, by: str) -> DataFrame:
    """``by, rango, x``: the wanted ranks of each bracket, by ordering the values it holds.

    A bracket holds at most SMALL_GROUP rows by now, or numbers too close to be told apart by
    bins; either way the window streams over a sort that can spill.
    """
    counted = _inside(long, table, by).groupBy("tramo", "x").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("tramo").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (
        counted.withColumn("_n", F.sum("n").over(upto)).join(F.broadcast(table), "tramo")
        .withColumn("hasta", F.col("antes") + F.col("_n"))
    )
    return ranked.select(by, "x", F.explode(F.filter(
        "rangos", lambda r: (r >= F.col("hasta") - F.col("n")) & (r < F.col("hasta")))).alias("rango"))


def _by_narrowing(long: DataFrame, groups: list, probs: Sequence[float], by: str) -> list[tuple]:
    """Rows ``group, rank, value`` of the wanted ranks, by bins within bins."""
    spark, key_type = long.sparkSession, long.schema[by].dataType
    # A bracket: group, id, value bounds, rows of the group below it, wanted ranks inside it.
    open_brackets = [
        (r[by], i, r["lo"], r["hi"], 0, _wanted_ranks(r["n"], probs)) for i, r in enumerate(groups)
    ]
    ready: list[tuple] = []
    known: list[tuple] = []  # ranks that fell in a bin with a single value: group, rank, value
    while open_brackets:
        table = _bracket_table(spark, key_type, by, open_brackets)
        # Halves, so that the distance between two opposite extremes does not overflow.
        span = F.col("hi") * 0.5 - F.col("lo") * 0.5
        bin_of = F.when(span > 0, F.least(
            F.floor((F.col("x") * 0.5 - F.col("lo") * 0.5) / span * BINS), F.lit(BINS - 1))).otherwise(0)
        bins = _inside(long, table, by).groupBy("tramo", bin_of.alias("bin")).agg(
            F.count("*").alias("n"), F.min("x").alias("_lo"), F.max("x").alias("_hi"))
        below = Window.partitionBy("tramo").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        placed = (
            bins.withColumn("_n", F.coalesce(F.sum("n").over(below), F.lit(0)))
            .join(F.broadcast(table), "tramo")
            .select(by, F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), "n", "rangos",
                    (F.col("antes") + F.col("_n")).alias("antes"))
        )
        hit = placed.withColumn("rangos", F.filter(
            "rangos", lambda r: (r >= F.col("antes")) & (r < F.col("antes") + F.col("n"))))
        found = hit.filter(F.size("rangos") > 0).select(by, "lo", "hi", "antes", "rangos", "n").collect()
        before = {(b[0], b[2], b[3]) for b in open_brackets}
        open_brackets = []
        for r in found:
            bracket = (r[by], r["lo"], r["hi"], r["antes"], list(r["rangos"]))
            if r["lo"] == r["hi"]:
                known += [(r[by], rank, r["lo"]) for rank in r["rangos"]]
            elif r["n"] > SMALL_GROUP and (r[by], r["lo"], r["hi"]) not in before:
                open_brackets.append(bracket)
            else:
                ready.append(bracket)
        open_brackets = [(k, i, *rest) for i, (k, *rest) in enumerate(open_brackets)]

    if ready:
        table = _bracket_table(spark, key_type, by, [(k, i, *rest) for i, (k, *rest) in enumerate(ready)])
        known += [(r[by], r["rango"], r["x"]) for r in _ranked_inside(long, table, by).collect()]
    return known
