"""Grouped aggregation: one key, two keys, ordering, top groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from varscope.functions.columns import DECIMAL, ENTERO, TEXTO, finite, kinds, present, ref, short_number
from varscope.functions.vocab import EMPTY_LABEL
from varscope.operators.frequencies import scale_position
from varscope.operators.quantiles import quantiles

AGGREGATES = {
    "suma": F.sum, "promedio": F.avg, "conteo": F.count, "minimo": F.min, "maximo": F.max,
}
MEDIAN = "mediana"
DEFAULT_LIMIT = 25


def key_cell(df: DataFrame, name: str) -> Column:
    """Grouping key on the native type; blank text and missing values share one key."""
    kind = kinds(df, [name])[name]
    if kind == TEXTO:
        return F.coalesce(F.nullif(ref(name).cast("string"), F.lit("")), F.lit(EMPTY_LABEL))
    return finite(df, name) if kind == DECIMAL else ref(name)


def key_label(df: DataFrame, name: str, key: str) -> Column:
    """Text shown for a key column; null reads ``(vacío)``, whole numbers carry no decimals."""
    kind = kinds(df, [name])[name]
    if kind == TEXTO:
        return F.col(key)
    text = short_number(key) if kind == DECIMAL else F.col(key).cast("string")
    return F.coalesce(text, F.lit(EMPTY_LABEL))


def key_number(df: DataFrame, name: str, key: str) -> Column:
    """Number by which a key sorts, null for keys that sort as text."""
    return F.col(key).cast("double") if kinds(df, [name])[name] in (ENTERO, DECIMAL) else F.lit(None).cast("double")


def with_label(df: DataFrame, name: str, alias: str, *others: Column) -> DataFrame:
    """The label of one column beside other expressions over the same rows."""
    keyed = df.select(key_cell(df, name).alias("_k"), *others)
    return keyed.withColumn(alias, key_label(df, name, "_k")).drop("_k")


def group_by(df: DataFrame, x: str, y: str | None = None, agregacion: str = "suma") -> DataFrame:
    """``categoria, numero, valor, filas`` per value of ``x``.

    Without a measure rows are counted. With one, groups that hold no number are left out. Keys
    stay on their native type until they are aggregated; counts, sums and bounds combine before
    the shuffle, so a dominant key costs no more than any other.
    """
    if agregacion != MEDIAN and agregacion not in AGGREGATES:
        raise ValueError(f"Agregación no soportada: {agregacion}.")
    key = key_cell(df, x)
    if y is None:
        grouped = df.groupBy(key.alias("_k")).agg(
            F.count("*").cast("double").alias("valor"), F.count("*").alias("filas"))
    else:
        pairs = df.filter(present(df, y)).select(key.alias("_k"), finite(df, y).alias("x")).filter(
            F.col("x").isNotNull())
        if agregacion == MEDIAN:
            labelled = pairs.select(key_label(df, x, "_k").alias("categoria"),
                                    key_number(df, x, "_k").alias("numero"), "x")
            return _medians(labelled)
        grouped = pairs.groupBy("_k").agg(
            AGGREGATES[agregacion]("x").cast("double").alias("valor"), F.count("*").alias("filas"))
    return grouped.select(
        key_label(df, x, "_k").alias("categoria"),
        key_number(df, x, "_k").alias("numero"), "valor", "filas",
    )


def _medians(labelled: DataFrame) -> DataFrame:
    medians = quantiles(labelled.select("categoria", "x"), [0.5], by="categoria")
    groups = labelled.groupBy("categoria").agg(F.first("numero").alias("numero"), F.count("*").alias("filas"))
    return medians.join(groups, "categoria").select("categoria", "numero", "valor", "filas")


def group_order(ordenar: str = "valor", scale: Sequence[str] | None = None) -> list[Column]:
    """Sort keys: a given scale first, else the category, else the value from high to low.

    Ties are broken by the category so that results are the same on every run.
    """
    by_key = [F.col("numero").asc_nulls_last(), F.col("categoria").asc()]
    if scale:
        return [scale_position(F.col("categoria"), scale).asc(), *by_key]
    if ordenar == "categoria":
        return by_key
    if ordenar == "valor":
        return [F.col("valor").desc_nulls_last(), F.col("categoria").asc()]
    raise ValueError(f"Orden no soportado: {ordenar}.")


def top_groups(
    groups: DataFrame, limit: int | None = DEFAULT_LIMIT, ordenar: str = "valor",
    scale: Sequence[str] | None = None,
) -> DataFrame:
    """``orden, categoria, valor, total_categorias, truncado`` of the first groups in order.

    The top-k keeps k rows per task; only those k are numbered. The total number of groups is a
    scalar subquery over the same aggregate, whose shuffle Spark reuses.
    """
    order = group_order(ordenar, scale)
    # Every group has a value, so this counts groups while asking for the same shuffled columns.
    total = groups.agg(F.count("valor").alias("t")).scalar()
    if limit is None:
        return groups.orderBy(*order).select("categoria", "valor", total.alias("total_categorias"))
    first = groups.orderBy(*order).limit(limit)
    return first.select(
        F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("orden"),
        "categoria", "valor", total.alias("total_categorias"),
    ).withColumn("truncado", F.col("total_categorias") > limit)


def aggregate(
    df: DataFrame, x: str, y: str | None = None, agregacion: str = "suma",
    limit: int | None = DEFAULT_LIMIT, ordenar: str = "valor", scale: Sequence[str] | None = None,
) -> DataFrame:
    """Group by one column, aggregate a measure (or count rows), order and cut."""
    return top_groups(group_by(df, x, y, agregacion), limit, ordenar, scale)


def group_by_two(
    df: DataFrame, x: str, serie: str, y: str | None = None, agregacion: str = "suma"
) -> DataFrame:
    """``categoria, serie, valor, filas`` for the combinations that occur."""
    if y is None:
        grouped = df.groupBy(key_cell(df, x).alias("_x"), key_cell(df, serie).alias("_s")).agg(
            F.count("*").cast("double").alias("valor"), F.count("*").alias("filas"))
    else:
        triples = df.select(key_cell(df, x).alias("_x"), key_cell(df, serie).alias("_s"),
                            finite(df, y).alias("x")).filter(F.col("x").isNotNull())
        if agregacion == MEDIAN:
            named = triples.select(
                F.struct(key_label(df, x, "_x").alias("categoria"),
                         key_label(df, serie, "_s").alias("serie")).alias("par"), "x")
            sizes = named.groupBy("par").agg(F.count("*").alias("filas"))
            return quantiles(named, [0.5], by="par").join(sizes, "par").select("par.*", "valor", "filas")
        if agregacion not in AGGREGATES:
            raise ValueError(f"Agregación no soportada: {agregacion}.")
        grouped = triples.groupBy("_x", "_s").agg(
            AGGREGATES[agregacion]("x").cast("double").alias("valor"), F.count("*").alias("filas"))
    return grouped.select(
        key_label(df, x, "_x").alias("categoria"),
        key_label(df, serie, "_s").alias("serie"), "valor", "filas",
    )


def _largest(cells: DataFrame, key: str, limit: int) -> DataFrame:
    """The ``limit`` keys with the highest totals."""
    totals = cells.groupBy(key).agg(F.sum("valor").alias("_t"))
    return totals.orderBy(F.desc("_t"), key).limit(limit).select(key)


def crosstab(
    df: DataFrame, x: str, serie: str, y: str | None = None, agregacion: str = "suma",
    limit_x: int | None = None, limit_series: int | None = None,
) -> DataFrame:
    """Long matrix ``categoria, serie, valor``.

    Limits keep the categories and series with the highest totals. With both limits every category
    gets every series, 0 where the two never meet: at most ``limit_x`` times ``limit_series`` rows.
    With one limit or none only combinations that occur are returned, whatever their number, and
    an absent one stands for 0: filling would pair all categories with all series.
    """
    cells = group_by_two(df, x, serie, y, agregacion)
    if limit_x is not None:
        cells = cells.join(F.broadcast(_largest(cells, "categoria", limit_x)), "categoria", "left_semi")
    if limit_series is not None:
        cells = cells.join(F.broadcast(_largest(cells, "serie", limit_series)), "serie", "left_semi")
    if limit_x is None or limit_series is None:
        return cells.select("categoria", "serie", "valor")
    # Both aggregates hold no more than the limits.
    every = cells.agg(F.array_sort(F.collect_set("serie"))).scalar()
    found = cells.groupBy("categoria").agg(
        F.map_from_entries(F.collect_list(F.struct("serie", "valor"))).alias("_celdas"))
    return found.select("categoria", "_celdas", F.explode(every).alias("serie")).select(
        "categoria", "serie",
        F.coalesce(F.try_element_at("_celdas", F.col("serie")), F.lit(0.0)).alias("valor"),
    )


def share_of_category(cells: DataFrame) -> DataFrame:
    """Each cell as a percentage of its category's total; 0 where the total is 0."""
    total = F.sum("valor").over(Window.partitionBy("categoria"))
    return cells.select("categoria", "serie", F.when(total == 0, 0.0).otherwise(
        F.try_divide(F.col("valor"), total) * 100).alias("valor"))
