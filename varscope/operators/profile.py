"""Column reports, the global summary, filter controls and row previews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from varscope.functions import vocab
from varscope.functions.columns import (
    DECIMAL, ENTERO, FECHA, column_rows, kinds, present, ref, rounded,
)
from varscope.functions.text import normalize
from varscope.functions.vocab import CONTINUA, DISCRETA
from varscope.operators.classify import cell_metrics, classify, column_metrics, decide
from varscope.operators.duplicates import duplicate_rows
from varscope.operators.frequencies import display_order, frequency_tables, value_counts

SAMPLE_VALUES = 5


def samples(counts: DataFrame, restore=None) -> DataFrame:
    """``columna, muestra``: the first five distinct values in display order."""
    order = Window.partitionBy("columna").orderBy(*display_order())
    first = counts.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= SAMPLE_VALUES)
    return (
        (restore(first) if restore else first)
        .groupBy("columna").agg(F.array_sort(F.collect_list(F.struct("_n", "valor"))).alias("_m"))
        .select("columna", F.transform("_m", lambda s: s["valor"]).alias("muestra"))
    )


def ordered_samples(df: DataFrame, order_by: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """``columna, muestra``: the values of the first five rows that have one, in a given row order."""
    names = list(kinds(df, columns))
    keys = [f"_o{i}" for i in range(len(order_by))]
    wide = df.select(*[ref(c).alias(k) for c, k in zip(order_by, keys)],
                     *[F.when(present(df, c), ref(c)).cast("string").alias(c) for c in names])
    long = wide.unpivot([F.col(k) for k in keys], [ref(c) for c in names], "columna", "valor").filter(
        F.col("valor").isNotNull())
    order = Window.partitionBy("columna").orderBy(*keys)
    return (
        long.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= SAMPLE_VALUES)
        .groupBy("columna").agg(F.array_sort(F.collect_list(F.struct("_n", "valor"))).alias("_m"))
        .select("columna", F.transform("_m", lambda s: s["valor"]).alias("muestra"))
    )


def column_profile(
    df: DataFrame, counts: DataFrame | None = None, classification: DataFrame | None = None
) -> DataFrame:
    """One row per column: type, role, counts, share of nulls, distinct values and flags.

    A given classification is kept: filtering rows never reclassifies a column.
    """
    counts = value_counts(df, compact=True) if counts is None else counts
    fields = ("tipo", "rol", "confianza", "justificacion", "escala_orden")
    if classification is None:
        facts = decide(column_metrics(df, counts=counts)).select(
            "pos", "columna", "clase", "total", "n", "unicos", *fields)
    else:
        rows = [(i, c, k) for i, (c, k) in enumerate(kinds(df).items())]
        facts = (
            column_rows(df, rows, "pos int, columna string, clase string")
            .join(F.broadcast(cell_metrics(df)), "columna")
            .join(F.broadcast(counts.groupBy("columna").agg(F.count("*").alias("unicos"))), "columna", "left")
            .join(F.broadcast(classification.select("columna", *fields)), "columna", "left")
            .withColumn("unicos", F.coalesce("unicos", F.lit(0)))
            .select("pos", "columna", "clase", "total", "n", "unicos", *fields)
        )
    types = column_rows(df, [(f.name, f.dataType.simpleString()) for f in df.schema.fields],
                        "columna string, tipo_dato string")
    numeric = F.col("clase").isin(ENTERO, DECIMAL)
    nulls = F.col("total") - F.col("n")
    return facts.join(F.broadcast(types), "columna").select(
        "pos", "columna", F.concat(F.lit("col"), F.col("pos").cast("string")).alias("clave"),
        "tipo", "rol", "tipo_dato", F.round("confianza", 3).alias("confianza"), "justificacion",
        "escala_orden", "total", nulls.alias("nulos"),
        F.coalesce(F.round(F.try_divide(nulls, F.col("total")) * 100, 2), F.lit(0.0)).alias("porcentaje_nulos"),
        F.col("unicos").cast("bigint").alias("unicos"), numeric.alias("es_numerica"),
        F.lit(True).alias("es_graficable_x"), numeric.alias("es_graficable_y"),
    )


def completeness(df: DataFrame) -> DataFrame:
    """``columna, total, nulos, porcentaje_nulos``, one scan for all columns."""
    nulls = F.col("total") - F.col("n")
    return cell_metrics(df).select(
        "columna", "total", nulls.alias("nulos"),
        F.coalesce(F.round(F.try_divide(nulls, F.col("total")) * 100, 2), F.lit(0.0)).alias("porcentaje_nulos"))


def global_summary(df: DataFrame, profile: DataFrame, with_duplicates: bool = True) -> DataFrame:
    """One row: size of the table, columns per type, empty cells, completeness, duplicates."""
    typed = lambda name: F.count_if(F.col("tipo") == name)
    cells, nulls = F.col("celdas_totales"), F.col("celdas_nulas")
    row = profile.agg(
        F.coalesce(F.max("total"), F.lit(0)).alias("filas"), F.count("*").alias("columnas"),
        F.count_if("es_numerica").alias("numericas"), F.count_if(~F.col("es_numerica")).alias("categoricas"),
        typed(vocab.NOMINAL).alias("nominales"), typed(vocab.ORDINAL).alias("ordinales"),
        typed(DISCRETA).alias("discretas"), typed(CONTINUA).alias("continuas"),
        F.coalesce(F.sum("total"), F.lit(0)).alias("celdas_totales"),
        F.coalesce(F.sum("nulos"), F.lit(0)).alias("celdas_nulas"),
    ).withColumn("completitud", F.coalesce(
        F.round((1 - F.try_divide(nulls, cells)) * 100, 2), F.lit(100.0)))
    if with_duplicates:
        row = row.withColumn("filas_duplicadas", duplicate_rows(df).scalar())
    return row


def dataset_metadata(df: DataFrame, preview_rows: int = 5_000) -> DataFrame:
    """``filas, columnas, celdas_vacias, filas_duplicadas, vista_recortada`` of a loaded table."""
    return cell_metrics(df).agg(
        F.max("total").alias("filas"), F.count("*").alias("columnas"),
        F.sum(F.col("total") - F.col("n")).alias("celdas_vacias"),
    ).select("*", duplicate_rows(df).scalar().alias("filas_duplicadas"),
             (F.col("filas") > preview_rows).alias("vista_recortada"))


def filter_options(
    df: DataFrame, counts: DataFrame | None = None, classification: DataFrame | None = None, restore=None
) -> DataFrame:
    """The filter control of each column: kind, values, bounds, step and a null flag.

    Lists hold at most 200 values: all of them in display order, or for columns with more the 200
    most frequent. One ranked pass serves both, and the group limit keeps 200 rows per task.
    """
    counts = value_counts(df) if counts is None else counts
    classification = classify(df, counts=counts) if classification is None else classification
    kind_rows = column_rows(df, list(kinds(df).items()), "columna string, clase string")
    facts = (
        classification.select("columna", "pos", "tipo", "escala_orden")
        .join(F.broadcast(kind_rows), "columna").join(F.broadcast(cell_metrics(df)), "columna")
    )
    span = F.col("maximo") - F.col("minimo")
    ranged = F.col("tipo").isin(DISCRETA, CONTINUA) & F.col("clase").isin(ENTERO, DECIMAL) & F.col("minimo").isNotNull()
    listed = facts.filter(~ranged & (F.col("clase") != FECHA)).select("columna", "escala_orden")
    sizes = counts.groupBy("columna").agg(F.count("*").alias("_u"))
    wanted = counts.join(F.broadcast(listed), "columna").join(F.broadcast(sizes), "columna")
    place = F.array_position("escala_orden", normalize(F.col("valor")))
    scaled = F.when(F.col("escala_orden").isNotNull(), F.when(place > 0, place).otherwise(F.lit(2_000_000)))
    frequent = F.when(F.col("_u") > vocab.MAX_FILTER_VALUES, -F.col("n"))
    as_number = F.when(scaled.isNull(), F.coalesce("valor_num", F.col("valor").try_cast("double")))
    order = Window.partitionBy("columna").orderBy(
        F.coalesce(frequent, F.lit(0)), scaled.asc_nulls_first(), as_number.asc_nulls_last(), "valor")
    first = wanted.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= vocab.MAX_FILTER_VALUES)
    values = (
        (restore(first) if restore else first)
        .groupBy("columna").agg(
            F.array_sort(F.collect_list(F.struct("_n", "valor"))).alias("_v"), F.max("_u").alias("_u"))
        .select("columna", F.transform("_v", lambda s: s["valor"]).alias("valores"), "_u")
    )
    many = F.coalesce(F.col("_u") > vocab.MAX_FILTER_VALUES, F.lit(False))
    control = (
        F.when(F.col("clase") == FECHA, "fecha").when(ranged, "rango").when(many, "texto").otherwise("categorico")
    )
    step = F.when(F.col("tipo") == DISCRETA, 1.0).otherwise(F.greatest(span / 100, F.lit(1e-6)))
    return facts.join(F.broadcast(values), "columna", "left").select(
        "pos", "columna", control.alias("tipo_control"),
        F.coalesce("valores", F.array().cast("array<string>")).alias("valores"),
        (many & (control == "texto")).alias("valores_truncados"),
        rounded(F.when(ranged, F.col("minimo"))).alias("minimo"),
        rounded(F.when(ranged, F.col("maximo"))).alias("maximo"),
        rounded(F.when(ranged, step)).alias("paso"),
        (F.col("n") < F.col("total")).alias("tiene_nulos"),
    )


def top_categories(
    counts: DataFrame, profile: DataFrame, limit: int = vocab.TOP_CATEGORIES,
    scales: dict[str, Sequence[str]] | None = None, restore=None,
) -> DataFrame:
    """First values in display order of the columns that are not numeric or are discrete.

    Which columns these are is settled first, one name per column: the rules of the classification
    inside this query would make its generated code too large.
    """
    shown = [r["columna"] for r in profile.select("columna", "tipo", "es_numerica").collect()
             if not r["es_numerica"] or r["tipo"] == DISCRETA]
    rows = frequency_tables(counts.filter(F.col("columna").isin(shown)), limit, scales)
    return restore(rows) if restore else rows


def safe_rows(df: DataFrame) -> DataFrame:
    """Cells fit for JSON: no NaN or infinity, decimals rounded to six places, ISO timestamps."""
    cells = []
    for name, kind in kinds(df).items():
        if kind == DECIMAL:
            cells.append(rounded(ref(name)).alias(name))
        elif kind == FECHA:
            # date_format keeps whole seconds; fractions are added only where there are any.
            stamp = ref(name).cast("timestamp_ntz")
            fraction = F.date_format(stamp, "SSSSSS")
            text = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")
            cells.append(F.when(fraction == "000000", text).otherwise(F.concat(text, F.lit("."), fraction)).alias(name))
        else:
            cells.append(ref(name).alias(name))
    return df.select(*cells)


def row_preview(df: DataFrame, limit: int, order_by: Sequence[str], as_json: bool = False) -> DataFrame:
    """The first rows in a given order, JSON-safe; ``as_json`` returns one text column ``fila``."""
    first = safe_rows(df.orderBy(*[ref(c) for c in order_by]).limit(limit))
    if not as_json:
        return first
    return first.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("fila"))
