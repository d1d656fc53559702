"""The data behind each chart type, computed on all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from varscope.functions import vocab
from varscope.functions.columns import (
    DECIMAL, ENTERO, INFINITY, TEXTO, column_rows, finite, kinds, numeric_columns, present, ref,
)
from varscope.functions.text import natural_key
from varscope.operators.correlation import correlation
from varscope.operators.describe import quartile_row
from varscope.operators.frequencies import class_bounds, histogram
from varscope.operators.grouping import (
    AGGREGATES, MEDIAN, aggregate, crosstab, group_by, group_order, key_cell, key_label, key_number,
    share_of_category, with_label,
)
from varscope.operators.ordering import ordered_slice
from varscope.operators.quantiles import EXACT, quantiles

# --- Fixed values: sizes of the charts, points of the axis scores below
PIE_SLICES = 10
RADAR_AXES = 12
LINE_POINTS = 400
SCATTER_GROUPS = 10
BOXES = 12
HEATMAP_SIDE = 30
HEATMAP_COLUMNS = 20
RANGE_MARGIN = 0.08


def bar(df: DataFrame, x: str, y: str | None = None, agregacion: str = "suma", scale=None) -> DataFrame:
    return aggregate(df, x, y, agregacion, scale=scale)


def pie(df: DataFrame, x: str, y: str | None = None, agregacion: str = "suma", scale=None) -> DataFrame:
    """``orden, categoria, valor``: ten largest slices and the rest as one.

    Shares need magnitudes that are not negative, so a negative group is an error. The remainder
    is one sum over all other groups, however many, and never numbers them.
    """
    groups = group_by(df, x, y, agregacion)
    order = group_order("valor", scale)
    lowest = groups.agg(F.min("valor")).first()[0]
    if lowest is not None and lowest < 0:
        raise ValueError("Un gráfico circular no admite valores negativos.")
    numbered = Window.orderBy(*order)
    slices = groups.orderBy(*order).limit(PIE_SLICES).select(
        F.row_number().over(numbered).cast("bigint").alias("orden"), "categoria", "valor")
    # The key depends on the group's value, which keeps the anti join above the aggregation: both
    # branches then read the same shuffle instead of scanning the table twice.
    keyed = groups.withColumn("_c", F.when(F.col("valor") >= -INFINITY, F.col("categoria")))
    rest = keyed.join(F.broadcast(slices.select(F.col("categoria").alias("_c"))), "_c", "left_anti").agg(
        F.sum("valor").alias("valor"), F.count("*").alias("_g")).filter("_g > 0").select(
        F.lit(PIE_SLICES + 1).cast("bigint").alias("orden"), F.lit(vocab.OTHERS_LABEL).alias("categoria"), "valor")
    return slices.unionByName(rest)


def histogram_chart(df: DataFrame, x: str, clases: int | None = None) -> DataFrame:
    """Class counts by Sturges or with 5 to 30 given classes; one class for a constant column."""
    if clases is not None and not 5 <= clases <= 30:
        raise ValueError("El número de clases va de 5 a 30.")
    bounds = [
        (c, n, lo, hi, 1 if lo == hi else (clases or max(2, k)))
        for c, n, lo, hi, k in class_bounds(df, [x], clases)
    ]
    return histogram(df, bounds)


def line(df: DataFrame, x: str, y: str | None = None, agregacion: str = "suma", scale=None) -> DataFrame:
    """Aggregate along an ordered key, at most 400 points (line and area)."""
    return aggregate(df, x, y, agregacion, LINE_POINTS, "categoria", scale)


area = line


def numeric_pairs(df: DataFrame, x: str, y: str, keep: Sequence[str] = ()) -> DataFrame:
    """Rows in which both columns hold a number: ``keep…, x, y``."""
    return df.select(
        *[ref(k) for k in keep], finite(df, x).alias("x"), finite(df, y).alias("y")
    ).filter(F.col("x").isNotNull() & F.col("y").isNotNull())


def scatter(df: DataFrame, x: str, y: str, serie: str | None = None) -> DataFrame:
    """Complete pairs; with a colour column, those of the ten groups that have most points."""
    if serie is None:
        return numeric_pairs(df, x, y)
    points = with_label(df, serie, "grupo", finite(df, x).alias("x"), finite(df, y).alias("y")).filter(
        F.col("x").isNotNull() & F.col("y").isNotNull())
    shown = points.groupBy("grupo").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "grupo").limit(SCATTER_GROUPS)
    return points.join(F.broadcast(shown.select("grupo")), "grupo", "left_semi")


def radar(df: DataFrame, x: str, y: str | None = None, agregacion: str = "suma", scale=None) -> DataFrame:
    """Twelve first groups; fewer than three give no polygon and no rows."""
    return aggregate(df, x, y, agregacion, RADAR_AXES, scale=scale).filter(F.col("total_categorias") >= 3)


def stacked(
    df: DataFrame, x: str, serie: str, y: str | None = None, agregacion: str = "suma", normalizar: bool = False,
    limit_x: int | None = None, limit_series: int | None = None,
) -> DataFrame:
    """Segments of each bar; with both limits empty segments are 0, else they are absent."""
    if x == serie:
        raise ValueError("Las barras y su desglose necesitan dos columnas diferentes.")
    cells = crosstab(df, x, serie, y, agregacion, limit_x, limit_series)
    return share_of_category(cells) if normalizar else cells


def _combo_medians(df: DataFrame, x: str, cells: DataFrame, two: bool) -> DataFrame:
    """Medians of both measures per group; without a second one the line is the mean of the first."""
    named = cells.select(key_label(df, x, "_k").alias("categoria"), key_number(df, x, "_k").alias("numero"), "y", "z")
    groups = named.groupBy("categoria").agg(
        F.first("numero").alias("numero"), F.count("y").alias("_n"), F.avg("y").alias("linea")).filter("_n > 0")
    middle = lambda c, name: quantiles(
        named.filter(F.col(c).isNotNull()).select("categoria", F.col(c).alias("x")), [0.5], by="categoria").select(
        "categoria", F.col("valor").alias(name))
    groups = groups.join(middle("y", "valor"), "categoria")
    return groups.drop("linea").join(middle("z", "linea"), "categoria", "left") if two else groups


def combo(
    df: DataFrame, x: str, y: str, z: str | None = None, agregacion: str = "suma", scale=None, limit: int = 25
) -> DataFrame:
    """``orden, categoria, barra, linea, eje_min, eje_max``: two measures over the same groups.

    Without a second measure (or with one that holds no number) the line is the mean of ``y``. One
    grouping computes both; the axis range is that of the line with a margin.
    """
    if agregacion != MEDIAN and agregacion not in AGGREGATES:
        raise ValueError(f"«{agregacion}» no es un agregado del gráfico mixto.")
    second = z if z and z != y else None
    if second and not df.select(finite(df, second).alias("z")).filter("z is not null").limit(1).count():
        second = None
    own = F.lit(None).cast("double") if second is None else finite(df, second)
    cells = df.select(key_cell(df, x).alias("_k"), finite(df, y).alias("y"), own.alias("z"))
    if agregacion == MEDIAN:
        groups = _combo_medians(df, x, cells, second is not None)
    else:
        how = AGGREGATES[agregacion]
        line_value = F.avg("y") if second is None else F.when(F.count("z") > 0, how("z"))
        groups = cells.groupBy("_k").agg(
            how("y").cast("double").alias("valor"), F.count("y").alias("_n"), line_value.cast("double").alias("linea"),
        ).filter("_n > 0").select(
            key_label(df, x, "_k").alias("categoria"), key_number(df, x, "_k").alias("numero"),
            "valor", "linea")
    order = group_order("valor", scale)
    first = groups.orderBy(*order).limit(limit)
    # At most `limit` rows from here on.
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    low = F.least(F.coalesce(F.min("linea").over(every), F.lit(0.0)), F.lit(0.0))
    high = F.coalesce(F.max("linea").over(every), F.lit(1.0))
    margin = F.coalesce(F.nullif((high - low) * RANGE_MARGIN, F.lit(0.0)),
                        F.nullif(F.abs(high) * RANGE_MARGIN, F.lit(0.0)), F.lit(1.0))
    return first.select(
        F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("orden"), "categoria",
        F.col("valor").alias("barra"), "linea",
        (low - F.when(low < 0, margin).otherwise(0.0)).alias("eje_min"), (high + margin).alias("eje_max"),
    )


def _box_values(df: DataFrame, y: str, x: str | None) -> DataFrame:
    """``grupo, x`` of the whole column or of the twelve groups with most numbers."""
    number = finite(df, y).alias("x")
    if x is None:
        return df.select(F.lit(y).alias("grupo"), number).filter(F.col("x").isNotNull())
    values = with_label(df, x, "grupo", number).filter(F.col("x").isNotNull())
    # Twelve labels at most; as literals they spare every later scan the count of all groups.
    shown = values.groupBy("grupo").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "grupo").limit(BOXES)
    return values.filter(F.col("grupo").isin([r["grupo"] for r in shown.collect()]))


def _fenced(df: DataFrame, y: str, x: str | None, mode: str = EXACT) -> DataFrame:
    values = _box_values(df, y, x)
    boxes = quartile_row(quantiles(values, (0.25, 0.5, 0.75), by="grupo", few=True, mode=mode), "grupo").select(
        "*", (F.col("q1") - 1.5 * F.col("iqr")).alias("valla_inf"),
        (F.col("q3") + 1.5 * F.col("iqr")).alias("valla_sup"))
    # One row per box: twelve at most.
    return values.join(F.broadcast(boxes), "grupo")


def box(df: DataFrame, y: str, x: str | None = None, mode: str = EXACT) -> DataFrame:
    """``grupo, n, q1, mediana, q3, bigote_inf, bigote_sup, atipicos`` per box.

    With ``mode`` ``approx`` the quartiles are sketched; counts and whiskers are those of their fences.
    """
    inside = F.col("x").between(F.col("valla_inf"), F.col("valla_sup"))
    return _fenced(df, y, x, mode).groupBy("grupo", "q1", "q2", "q3").agg(
        F.count("*").alias("n"), F.min(F.when(inside, F.col("x"))).alias("bigote_inf"),
        F.max(F.when(inside, F.col("x"))).alias("bigote_sup"), F.count_if(~inside).alias("atipicos"),
    ).withColumnRenamed("q2", "mediana")


def box_outliers(df: DataFrame, y: str, x: str | None = None) -> DataFrame:
    """``grupo, x``: the values beyond the fences of their box."""
    inside = F.col("x").between(F.col("valla_inf"), F.col("valla_sup"))
    return _fenced(df, y, x).filter(~inside).select("grupo", "x")


def heatmap_correlation(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Correlation of the first twenty numeric columns, 1 on the diagonal (null for constants)."""
    columns = numeric_columns(df) if columns is None else list(columns)
    return correlation(df, columns[:HEATMAP_COLUMNS])


def heatmap_cross(df: DataFrame, x: str, serie: str, y: str | None = None, agregacion: str = "suma") -> DataFrame:
    return crosstab(df, x, serie, y, agregacion, HEATMAP_SIDE, HEATMAP_SIDE)


def regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """``pendiente, intercepto, r, r2, n, x0, y0, x1, y1`` of the least-squares line.

    No row when fewer than two complete pairs exist or ``x`` does not vary.
    """
    if x == y:
        raise ValueError("Elija dos variables distintas para la regresión.")
    fit = numeric_pairs(df, x, y).agg(
        F.regr_slope("y", "x").alias("pendiente"), F.regr_intercept("y", "x").alias("intercepto"),
        F.regr_r2("y", "x").alias("r2"), F.count("*").alias("n"),
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"),
        F.covar_pop("x", "y").alias("_c"), F.stddev_pop("x").alias("_sx"), F.stddev_pop("y").alias("_sy"),
    ).filter((F.col("n") >= 2) & (F.col("x0") < F.col("x1")))
    at = lambda edge: F.col("pendiente") * F.col(edge) + F.col("intercepto")
    r = F.when(F.col("_y0") < F.col("_y1"), F.try_divide(F.col("_c"), F.col("_sx") * F.col("_sy")))
    return fit.select("pendiente", "intercepto", r.alias("r"), "r2", "n",
                      "x0", at("x0").alias("y0"), "x1", at("x1").alias("y1"))


def kpis(df: DataFrame, medida: str | None = None, filas_totales: int | None = None) -> DataFrame:
    """``filas, proporcion, columnas, completitud, suma, promedio`` of the visible rows, one scan."""
    filled = None
    for name, kind in kinds(df).items():
        here = present(df, name)
        if kind == TEXTO:
            here = here & (ref(name).cast("string") != "")
        one = F.when(here, 1).otherwise(0)
        filled = one if filled is None else filled + one
    value = F.lit(None).cast("double") if medida is None else finite(df, medida)
    row = df.select(filled.alias("_f"), value.alias("_m")).agg(
        F.count("*").alias("filas"), F.sum("_f").alias("_llenas"),
        F.sum("_m").alias("suma"), F.avg("_m").alias("promedio"))
    columns = len(df.columns)
    share = F.lit(100.0) if filas_totales is None else (
        F.try_divide(F.col("filas"), F.lit(filas_totales)) * 100)
    return row.select(
        "filas", F.coalesce(share, F.lit(0.0)).alias("proporcion"),
        F.lit(columns).cast("bigint").alias("columnas"),
        F.coalesce(F.try_divide(F.col("_llenas"), F.col("filas") * columns) * 100, F.lit(100.0)).alias("completitud"),
        "suma", "promedio",
    )


# --- Axis recommendation ------------------------------------------------------------------------
def axis_scores(profile: DataFrame) -> DataFrame:
    """``pos, columna, es_numerica, puntos_categoria, puntos_medida`` per column of a profile.

    A category axis reads best with 2 to 12 values; a measure axis prefers continuous magnitudes.
    The points are fixed values.
    """
    u, role = F.col("unicos"), F.col("rol")
    identifier = role == vocab.IDENTIFICADOR
    category = (
        F.when(u <= 1, -100.0).when(identifier, -50.0).when(role == vocab.TEXTO_LIBRE, -40.0)
        .when(u <= 12, 100.0 - u).otherwise(F.greatest(10 - u / 10, F.lit(-20.0)))
    )
    measure = (
        F.when(~F.col("es_numerica"), -100.0).when(identifier, -50.0)
        .when(role == vocab.MEDIDA, 100.0).when(role == vocab.CONTEO, 80.0).otherwise(40.0)
    )
    return profile.select("pos", "columna", "es_numerica", category.alias("puntos_categoria"),
                          measure.alias("puntos_medida"))


# Axes of a chart in the order they are filled: name -> (which columns fit, whether it must be set).
ANY_AXES = {"x": ("cualquiera", True), "y": ("numerica", False), "serie": ("categorica", False)}
AXIS_ORDER = ("x", "y", "serie")


def ranked_axes(
    scores: DataFrame, axes: dict[str, tuple[str, bool]], selection: dict[str, str] | None = None
) -> DataFrame:
    """``eje, columna, lugar``: the columns that fit each axis, best first, as many as there are axes.

    A column the user picked comes before all others; then points decide, then table order. With
    as many candidates as axes one is always left that no other axis has taken.
    """
    wanted = F.inline(F.array(*[F.struct(
        F.lit(a).alias("eje"), F.lit(kind).alias("apta"), F.lit((selection or {}).get(a)).cast("string").alias("elegida"))
        for a, (kind, _) in axes.items()]))
    fits = (F.col("apta") == "cualquiera") | (F.col("es_numerica") == (F.col("apta") == "numerica"))
    points = F.when((F.col("eje") == "y") | (F.col("apta") == "numerica"), F.col("puntos_medida")).otherwise(F.col("puntos_categoria"))
    order = Window.partitionBy("eje").orderBy(
        F.coalesce(F.col("columna") == F.col("elegida"), F.lit(False)).desc(), points.desc(), "pos")
    return scores.select("*", wanted).filter(fits).select(
        "eje", "columna", F.row_number().over(order).alias("lugar")).filter(F.col("lugar") <= len(AXIS_ORDER))


def recommend_axes(
    scores: DataFrame, axes: dict[str, tuple[str, bool]] | None = None, selection: dict[str, str] | None = None
) -> dict[str, str]:
    """Column for each axis from :func:`axis_scores`: the user's where it fits, else the best free one.

    A missing key asks for a suggestion; an unfit or empty choice leaves an optional axis empty.
    """
    axes = {a: (ANY_AXES if axes is None else axes)[a] for a in AXIS_ORDER if a in (ANY_AXES if axes is None else axes)}
    selection = selection or {}
    ranked: dict[str, list[str]] = {}
    for row in ranked_axes(scores, axes, selection).orderBy("eje", "lugar").collect():
        ranked.setdefault(row["eje"], []).append(row["columna"])
    chosen = dict.fromkeys(AXIS_ORDER, "")
    for axis, (_, required) in axes.items():
        options = ranked.get(axis, [])
        picked = selection.get(axis)
        own = bool(options) and options[0] == picked
        if not own and picked is not None and not required:
            continue
        blocked = {chosen["x"]} if own and axis == "serie" else set() if own else set(chosen.values())
        chosen[axis] = next((c for c in options if c not in blocked), "")
    return chosen


def axes_table(df: DataFrame, chosen: dict[str, str]) -> DataFrame:
    return column_rows(df, list(chosen.items()), "eje string, columna string")


# --- Table view -----------------------------------------------------------------------------------
def table_page(
    df: DataFrame, orden: str, ascendente: bool = True, pagina: int = 0, por_pagina: int = 25,
    desempate: Sequence[str] = (),
) -> DataFrame:
    """One page of the rows sorted by a column; missing values always come last.

    Numbers sort as numbers, text in Spanish order with digit runs as numbers. ``desempate`` names
    columns that break ties.
    """
    kind = kinds(df, [orden])[orden]
    if kind == TEXTO:
        key = F.collate(natural_key(F.nullif(ref(orden).cast("string"), F.lit(""))), "es")
        key = F.when(F.nullif(ref(orden).cast("string"), F.lit("")).isNotNull(), key)
    else:
        key = finite(df, orden) if kind in (ENTERO, DECIMAL) else ref(orden)
    keys = [(key, ascendente), *[(ref(c), True) for c in desempate]]
    return ordered_slice(df, keys, pagina * por_pagina, por_pagina)
