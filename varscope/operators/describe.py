"""Descriptive statistics of numeric columns, one row per column or per (column, statistic)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from varscope.functions.columns import local_rows, numeric_columns, numeric_long, rounded
from varscope.functions.vocab import PERCENTILES
from varscope.operators.frequencies import value_counts
from varscope.operators.quantiles import EXACT, quantiles

MAX_MODES = 10


def moments(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column that has numbers: count, sum, mean, bounds, spread and shape.

    One scan; every aggregate combines before the shuffle, which carries one row per task and
    column. Skewness and kurtosis are bias-corrected, and 0 for a constant column.
    """
    columns = numeric_columns(df) if columns is None else columns
    n = F.col("n").cast("double")
    constant = F.col("minimo") == F.col("maximo")
    base = numeric_long(df, columns).groupBy("columna").agg(
        F.count("*").alias("n"), F.sum("x").alias("suma"), F.avg("x").alias("media"),
        F.min("x").alias("minimo"), F.max("x").alias("maximo"),
        F.stddev_samp("x").alias("s"), F.skewness("x").alias("g1"), F.kurtosis("x").alias("g2"),
    )
    deviation = F.when(constant, 0.0).otherwise(F.coalesce("s", F.lit(0.0)))
    skew = F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = ((n + 1) * F.col("g2") + 6) * (n - 1) / ((n - 2) * (n - 3))
    return base.select(
        "columna", F.col("n").alias("conteo"), "suma", "media", "minimo", "maximo",
        (F.col("maximo") - F.col("minimo")).alias("rango"),
        deviation.alias("desviacion_estandar"),
        (deviation * deviation).alias("varianza"),
        F.try_divide(deviation, F.abs("media")).alias("coeficiente_variacion"),
        F.when(n > 2, F.when(constant, 0.0).otherwise(skew)).alias("asimetria"),
        F.when(n > 3, F.when(constant, 0.0).otherwise(kurt)).alias("curtosis"),
    )


def quartiles(df: DataFrame, columns: Sequence[str], mode: str = EXACT) -> DataFrame:
    """One row per column: ``q1, q2, q3, iqr``."""
    long = quantiles(numeric_long(df, columns), (0.25, 0.5, 0.75), few=True, mode=mode)
    return quartile_row(long, "columna")


def quartile_row(long: DataFrame, by: str) -> DataFrame:
    """Quantile rows ``by, prob, valor`` turned into one row with the three quartiles."""
    pick = lambda p: F.max(F.when(F.col("prob") == p, F.col("valor")))
    rows = long.groupBy(by).agg(pick(0.25).alias("q1"), pick(0.5).alias("q2"), pick(0.75).alias("q3"))
    return rows.withColumn("iqr", F.col("q3") - F.col("q1"))


def percentile_rows(df: DataFrame, columns: Sequence[str], mode: str = EXACT) -> DataFrame:
    """``columna, estadistico, valor`` for p1 … p99; ``approx`` is off by ``RANK_ERROR`` of the ranks at most."""
    rows = quantiles(numeric_long(df, columns), [p / 100 for p in PERCENTILES], few=True, mode=mode)
    return _named_quantiles(rows, "p", 100)


def decile_rows(df: DataFrame, columns: Sequence[str], mode: str = EXACT) -> DataFrame:
    """``columna, estadistico, valor`` for d1 … d10."""
    rows = quantiles(numeric_long(df, columns), [d / 10 for d in range(1, 11)], few=True, mode=mode)
    return _named_quantiles(rows, "d", 10)


def _named_quantiles(rows: DataFrame, letter: str, scale: int) -> DataFrame:
    number = F.round(F.col("prob") * scale).cast("int").cast("string")
    return rows.select("columna", F.concat(F.lit(letter), number).alias("estadistico"),
                       rounded(F.col("valor")).alias("valor"))


def modes(counts: DataFrame) -> DataFrame:
    """``columna, orden, moda, n``: values tied at the top count, ascending, at most ten.

    The top count per column is a plain maximum; ties are ranked with a group limit.
    """
    numbers = counts.filter(F.col("valor_num").isNotNull())
    top = numbers.groupBy("columna").agg(F.max("n").alias("_top")).filter(F.col("_top") > 1)
    order = Window.partitionBy("columna").orderBy("valor_num")
    return (
        numbers.join(F.broadcast(top), "columna").filter(F.col("n") == F.col("_top"))
        .withColumn("orden", F.row_number().over(order).cast("bigint"))
        .filter(F.col("orden") <= MAX_MODES)
        .select("columna", "orden", rounded(F.col("valor_num")).alias("moda"), "n")
    )


def outliers(df: DataFrame, columns: Sequence[str], fences: DataFrame | None = None) -> DataFrame:
    """``columna, atipicos``: values beyond 1.5·IQR of the quartiles; 0 when the IQR is 0.

    ``fences`` is the quartile table (one row per column), broadcast into a second scan.
    """
    fences = quartiles(df, columns) if fences is None else fences
    beyond = F.col("iqr") > 0
    beyond &= (F.col("x") < F.col("q1") - 1.5 * F.col("iqr")) | (F.col("x") > F.col("q3") + 1.5 * F.col("iqr"))
    return (
        numeric_long(df, columns).join(F.broadcast(fences), "columna")
        .groupBy("columna").agg(F.count_if(beyond).alias("atipicos"))
    )


def numeric_summary(
    df: DataFrame, columns: Sequence[str] | None = None, counts: DataFrame | None = None, mode: str = EXACT
) -> DataFrame:
    """Whole numeric summary, one row per column with numbers (none for an empty column).

    ``mode`` ``approx`` takes quartiles, percentiles, deciles and fences from a sketch of one scan.

    The parts have one row per column each, so the joins between them are broadcasts.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    counts = value_counts(df, columns) if counts is None else counts
    probs = {p / 100 for p in PERCENTILES} | {d / 10 for d in range(1, 11)}
    # One row per column: small enough for the driver.
    first = moments(df, columns)
    base_rows = first.collect()
    base = local_rows(df.sparkSession, base_rows, first.schema)
    long = numeric_long(df, columns)
    points = quantiles(long, sorted(probs), few=True, mode=mode)
    points = local_rows(df.sparkSession, points.collect(), points.schema)
    percentile_map = F.map_from_entries(F.array_sort(F.collect_list(F.struct(
        F.concat(F.lit("p"), F.round(F.col("prob") * 100).cast("int").cast("string")),
        rounded(F.col("valor"))))))
    decile_map = F.map_from_entries(F.array_sort(F.collect_list(F.struct(
        F.concat(F.lit("d"), F.round(F.col("prob") * 10).cast("int").cast("string")),
        rounded(F.col("valor"))))))
    in_list = lambda values: F.col("prob").isin([float(v) for v in values])
    percentiles = points.filter(in_list(p / 100 for p in PERCENTILES)).groupBy("columna").agg(
        percentile_map.alias("percentiles"))
    deciles = points.filter(in_list(d / 10 for d in range(1, 11))).groupBy("columna").agg(
        decile_map.alias("deciles"))
    fences = quartile_row(points, "columna")
    mode_lists = modes(counts).groupBy("columna").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("orden", "moda"))), lambda m: m["moda"]).alias("moda"))
    for part in (fences, mode_lists, outliers(df, columns, fences), percentiles, deciles):
        base = base.join(F.broadcast(part), "columna", "left")
    reals = ("media", "desviacion_estandar", "varianza", "minimo", "maximo", "rango", "q1", "q2", "q3",
             "iqr", "coeficiente_variacion", "asimetria", "curtosis", "suma")
    r: dict[str, Column] = {name: rounded(F.col(name)).alias(name) for name in reals}
    return base.select(
        "columna", "conteo", r["media"], rounded(F.col("q2")).alias("mediana"),
        F.coalesce("moda", F.array().cast("array<double>")).alias("moda"),
        *[r[name] for name in reals[1:]], "atipicos", "percentiles", "deciles",
    )
