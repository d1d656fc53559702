"""Pearson correlation of numeric columns over pairwise complete rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from varscope.functions.columns import column_rows, finite, local_rows, numeric_columns, numeric_long, rounded

#: Columns up to which pairs are rows: 36 pairs and 8 columns with themselves.
FEW_COLUMNS = 8
RESULT = "col_x string, col_y string, r double"
SUMS = ("n", "p", "sx", "sy", "qx", "qy")
BOUNDS = ("lox", "hix", "loy", "hiy")


def _pair_sums(means: list[float]):
    """Per task one row for each pair of columns: sums over the rows in which both hold a number.

    Cells are deviations from the column's mean. With missing cells as 0 and a matrix of ones and
    zeros for the cells that are there, the sums of all pairs are four matrix products.
    """
    k = len(means)
    shift = np.array(means)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, p, s, q = (np.zeros((k, k)) for _ in range(4))
        lo, hi = np.full((k, k), np.inf), np.full((k, k), -np.inf)
        for pdf in batches:
            x = pdf.to_numpy(dtype=np.float64, na_value=np.nan) - shift
            there = ~np.isnan(x)
            known, filled = there.astype(np.float64), np.where(there, x, 0.0)
            n += known.T @ known
            p += filled.T @ filled
            s += filled.T @ known
            q += (filled * filled).T @ known
            for j in range(k):
                rows = x if there[:, j].all() else x[there[:, j]]
                if len(rows):
                    lo[:, j] = np.fmin(lo[:, j], np.fmin.reduce(rows, axis=0))
                    hi[:, j] = np.fmax(hi[:, j], np.fmax.reduce(rows, axis=0))
        i, j = np.triu_indices(k, 1)
        yield pd.DataFrame({
            "i": i, "j": j, "n": n[i, j], "p": p[i, j], "sx": s[i, j], "sy": s[j, i], "qx": q[i, j], "qy": q[j, i],
            "lox": lo[i, j], "hix": hi[i, j], "loy": lo[j, i], "hiy": hi[j, i]})
    return run


def _by_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every pair as rows of a long frame, with built-in moments; a column with itself tells whether it varies."""
    k = len(columns)
    cells = df.select(*[finite(df, name).alias(f"c{i}") for i, name in enumerate(columns)])
    pairs = ", ".join(f"{i}, {j}, c{i}, c{j}" for i in range(k) for j in range(i, k))
    long = cells.selectExpr(f"stack({k * (k + 1) // 2}, {pairs}) AS (i, j, x, y)").filter("x IS NOT NULL AND y IS NOT NULL")
    sums = long.groupBy("i", "j").agg(
        F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")).alias("r"), F.count("*").alias("n"), (F.min("x") < F.max("x")).alias("vx"), (F.min("y") < F.max("y")).alias("vy"))
    every = column_rows(df, [(i, j) for i in range(k) for j in range(i, k)], "i int, j int")
    names = F.array(*[F.lit(c) for c in columns])
    value = F.when((F.col("n") > 1) & F.col("vx") & F.col("vy"), F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.col("r")))
    half = every.join(sums, ["i", "j"], "left").select("i", "j", names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), value.alias("r"))
    both = half.select(F.inline(F.when(F.col("i") == F.col("j"), F.array(
        F.struct(F.col("a").alias("col_x"), F.col("b").alias("col_y"), "r"))).otherwise(F.array(
            F.struct(F.col("a").alias("col_x"), F.col("b").alias("col_y"), "r"),
            F.struct(F.col("b").alias("col_x"), F.col("a").alias("col_y"), "r")))))
    return both.select("col_x", "col_y", rounded(F.col("r")).alias("r"))


def correlation(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``col_x, col_y, r`` for every ordered pair; null where a side is constant.

    A table of few columns takes one scan in the JVM, in which each row is a row per pair. A wide one takes two scans
    whatever the number of columns: one for the means, and one in which every task sums the products of all pairs and
    returns a row per pair, which are then added up.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    k = len(columns)
    if k < 2:
        return local_rows(df.sparkSession, [], RESULT)
    if k <= FEW_COLUMNS:
        return _by_pairs(df, columns)
    first = {r["columna"]: r for r in numeric_long(df, columns).groupBy("columna").agg(
        F.avg("x").alias("m"), F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()}
    means = [first[c]["m"] if c in first else 0.0 for c in columns]
    cells = df.select(*[finite(df, name).alias(f"c{i}") for i, name in enumerate(columns)])
    schema = "i int, j int, " + ", ".join(f"{name} double" for name in (*SUMS, *BOUNDS))
    pairs = cells.mapInPandas(_pair_sums(means), schema).groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in SUMS],
        F.min("lox").alias("lox"), F.max("hix").alias("hix"), F.min("loy").alias("loy"), F.max("hiy").alias("hiy"))
    spread = lambda q, s: F.col(q) - F.try_divide(F.col(s) * F.col(s), F.col("n"))
    r = F.try_divide(F.col("p") - F.try_divide(F.col("sx") * F.col("sy"), F.col("n")), F.sqrt(spread("qx", "sx") * spread("qy", "sy")))
    defined = (F.col("n") > 1) & (F.col("lox") < F.col("hix")) & (F.col("loy") < F.col("hiy"))
    names = F.array(*[F.lit(c) for c in columns])
    every = column_rows(df, [(i, j) for i in range(k) for j in range(i + 1, k)], "i int, j int")
    pairs = every.join(pairs, ["i", "j"], "left")  # an empty table has no sums, but its pairs are there
    half = pairs.select(names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), F.when(defined, r).alias("r"))
    both = half.select(F.inline(F.array(
        F.struct(F.col("a").alias("col_x"), F.col("b").alias("col_y"), "r"),
        F.struct(F.col("b").alias("col_x"), F.col("a").alias("col_y"), "r"))))
    varies = lambda c: c in first and first[c]["n"] > 1 and first[c]["lo"] < first[c]["hi"]
    diagonal = column_rows(df, [(c, c, 1.0 if varies(c) else None) for c in columns], RESULT)
    return diagonal.unionByName(both).select("col_x", "col_y", rounded(F.col("r")).alias("r"))
