"""Rule-based consistency check: findings, sources consulted and a 0–100 score."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from varscope.functions import vocab
from varscope.functions.columns import (
    TEXTO, column_rows, kinds, local_rows, numeric_columns, numeric_long, short_number,
)
from varscope.functions.text import normalize, normalize_name
from varscope.functions.vocab import ADVERTENCIA, AdmissibleRange, CRITICO, Catalogue, INFO
from varscope.operators.catalogues import LITERAL_ENTRIES, catalogue_table, missing_from, nearest_entries
from varscope.operators.classify import cell_metrics
from varscope.operators.duplicates import duplicate_rows
from varscope.operators.frequencies import restore_texts, value_counts
from varscope.session import freeze

Restore = Callable[..., DataFrame] | None
# --- Fixed values: examples per finding and per variant finding, limit and least rows of the z-score
EXAMPLES = 5
VARIANT_EXAMPLES = 3
#: Spellings of a normal form that a finding quotes; :func:`variant_forms` has them all.
SPELLINGS_SHOWN = 20
Z_LIMIT = 4.0
Z_MIN_ROWS = 10

FINDING = "codigo string, severidad string, columna string, mensaje string, filas_afectadas bigint, ejemplos array<string>, sugerencia string"


# --- Rules and columns ----------------------------------------------------------------------------
def bound_columns(names: Sequence[str], hints: Sequence[str]) -> list[str]:
    """Columns whose normalised header contains any hint, even inside another word."""
    return [name for name in names if any(h in normalize_name(name) for h in hints)]


def rule_binding(
    headers: DataFrame, catalogues: Sequence[Catalogue] = vocab.CATALOGUES,
    ranges: Sequence[AdmissibleRange] = vocab.RANGES,
) -> DataFrame:
    """``columna, clase_regla, regla`` for headers ``columna, nombre`` of any number of tables.

    ``regla`` is the place of the rule in its list; each header is decided on its own row.
    """
    def rules(kind: str, items) -> list[Column]:
        return [
            F.when(reduce(lambda a, b: a | b, [F.contains("nombre", F.lit(h)) for h in item.hints]),
                   F.struct(F.lit(kind).alias("clase_regla"), F.lit(i).alias("regla")))
            for i, item in enumerate(items)
        ]

    bound = F.array_compact(F.array(*rules("catalogo", catalogues), *rules("rango", ranges)))
    # The outer form keeps the optimizer from adding a filter that would search the header twice.
    return headers.select("columna", F.inline_outer(bound)).filter(F.col("regla").isNotNull())


# --- Examples -------------------------------------------------------------------------------------
def _first_examples(rows: DataFrame, by: Sequence[str], order: Sequence[Column], text: Column,
                    k: int = EXAMPLES, restore: Restore = None) -> DataFrame:
    """``by…, ejemplos``: the first ``k`` texts of each group, kept by a group limit, long ones whole."""
    place = Window.partitionBy(*by).orderBy(*order)
    first = rows.withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= k)
    return (
        (restore(first, limited=True) if restore else first)
        .groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_n", text.alias("t")))).alias("_e"))
        .select(*by, F.transform("_e", lambda s: s["t"]).alias("ejemplos"))
    )


def _finding(rows: DataFrame, code: str, severity: str, message: Column, advice: str,
             column: Column | None = None, examples: Column | None = None) -> DataFrame:
    column = F.col("columna") if column is None else column
    examples = F.col("ejemplos") if examples is None else examples
    return rows.select(
        F.lit(code).alias("codigo"), F.lit(severity).alias("severidad"), column.cast("string").alias("columna"),
        message.alias("mensaje"), F.col("filas").cast("bigint").alias("filas_afectadas"),
        examples.cast("array<string>").alias("ejemplos"), F.lit(advice).alias("sugerencia"),
    )



def _none(df: DataFrame) -> DataFrame:
    return local_rows(df.sparkSession, [], FINDING)


# --- Catalogues -----------------------------------------------------------------------------------
def suggestion(value: Column, catalogue: Sequence[str]) -> Column:
    """Nearest catalogue entry by edit distance (first on ties), or null when it is too far."""
    norm = normalize(value)
    scored = F.array(*[
        F.struct(F.levenshtein(norm, F.lit(entry)).alias("d"), F.lit(i).alias("i"), F.lit(entry).alias("e"))
        for i, entry in enumerate(catalogue)
    ])
    best = F.array_min(scored)
    limit = F.greatest(F.lit(1), F.floor(F.length(norm) / 3))
    return F.when((norm != "") & (best["d"] <= limit), best["e"])


def unknown_values(
    counts: DataFrame, names: Sequence[str], catalogues: Sequence[Catalogue] = vocab.CATALOGUES
) -> DataFrame:
    """``columna, catalogo, valor, n, sugerido``: distinct values missing from a bound catalogue.

    A short catalogue is a literal list, tested and searched on distinct values. A long one is a table: membership is
    an anti-join, and the nearest entry is found by segments, see :func:`catalogues.nearest_entries`.
    """
    parts = []
    for i, catalogue in enumerate(catalogues):
        bound = bound_columns(names, catalogue.hints)
        if not bound:
            continue
        mine = counts.filter(F.col("columna").isin(bound))
        if len(catalogue.values) > LITERAL_ENTRIES:
            table = catalogue_table(counts.sparkSession, catalogue.values)
            unknown = freeze(missing_from(_with_norm(mine), table).select("columna", "valor", "n", "norma"))
            near = nearest_entries(unknown, table)
            part = unknown.join(near, "norma").select("columna", F.lit(i).alias("catalogo"), "valor", "n", "sugerido")
        else:
            part = mine.filter(~normalize(F.col("valor")).isin(list(catalogue.values))).select(
                "columna", F.lit(i).alias("catalogo"), "valor", "n", suggestion(F.col("valor"), catalogue.values).alias("sugerido"))
        parts.append(part)
    if not parts:
        return local_rows(counts.sparkSession, [], "columna string, catalogo int, valor string, n bigint, sugerido string")
    return reduce(DataFrame.unionByName, parts)


def catalogue_findings(
    counts: DataFrame, names: Sequence[str], catalogues: Sequence[Catalogue] = vocab.CATALOGUES,
    restore: Restore = None,
) -> DataFrame:
    if not any(bound_columns(names, c.hints) for c in catalogues):
        return _none(counts)
    unknown = unknown_values(counts, names, catalogues)
    by = ["columna", "catalogo"]
    totals = unknown.groupBy(*by).agg(F.count("*").alias("valores"), F.sum("n").alias("filas"))
    shown = F.when(F.col("sugerido").isNotNull(), F.concat("valor", F.lit(" → "), "sugerido")).otherwise(F.col("valor"))
    examples = _first_examples(unknown, by, [F.desc("n"), F.col("valor")], shown, restore=restore)
    titles = F.array(*[F.lit(c.name) for c in catalogues])
    rows = totals.join(F.broadcast(examples), by)
    message = F.concat(F.col("valores").cast("string"), F.lit(" valor(es) de '"), "columna", F.lit("' fuera de «"),
                       titles[F.col("catalogo")], F.lit("»."))
    return _finding(rows, "valor_fuera_de_catalogo", ADVERTENCIA, message,
                    "Homologar con el catálogo o confirmar las categorías nuevas.")


# --- Ranges ---------------------------------------------------------------------------------------
def range_violations(
    df: DataFrame, ranges: Sequence[AdmissibleRange] = vocab.RANGES
) -> DataFrame | None:
    """``columna, regla, x, n``: distinct numbers outside a bound range; None when none is bound."""
    numeric = numeric_columns(df)
    bound = [(c, i, r.low, r.high) for i, r in enumerate(ranges) for c in bound_columns(numeric, r.hints)]
    if not bound:
        return None
    rules = column_rows(df, bound, "columna string, regla int, lo double, hi double")
    names = list(dict.fromkeys(c for c, *_ in bound))
    outside = (F.col("x") < F.col("lo")) | (F.col("x") > F.col("hi"))
    return (
        numeric_long(df, names).join(F.broadcast(rules), "columna").filter(outside)
        .groupBy("columna", "regla", "x").agg(F.count("*").alias("n"))
    )


def range_findings(df: DataFrame, ranges: Sequence[AdmissibleRange] = vocab.RANGES) -> DataFrame:
    violations = range_violations(df, ranges)
    if violations is None:
        return _none(df)
    by = ["columna", "regla"]
    totals = violations.groupBy(*by).agg(F.sum("n").alias("filas"))
    examples = _first_examples(violations, by, [F.col("x")], short_number("x"))
    texts = F.array(*[F.lit(f"[{r.low:g}, {r.high:g}] {r.unit}") for r in ranges])
    message = F.concat(F.lit("'"), "columna", F.lit("' tiene "), F.col("filas").cast("string"),
                       F.lit(" valor(es) fuera de "), texts[F.col("regla")], F.lit("."))
    return _finding(totals.join(F.broadcast(examples), by), "valor_fuera_de_rango", CRITICO, message,
                    "Revisar la unidad de medida o corregir los valores.")


# --- Structure ------------------------------------------------------------------------------------
def duplicate_findings(df: DataFrame) -> DataFrame:
    rows = duplicate_rows(df).select(F.col("filas_duplicadas").alias("filas")).filter("filas > 0")
    message = F.concat(F.lit("Hay "), F.col("filas").cast("string"), F.lit(" fila(s) duplicadas por completo."))
    return _finding(rows, "filas_duplicadas", ADVERTENCIA, message, "Quitar las filas repetidas.",
                    F.lit(None), F.array())


def null_findings(metrics: DataFrame) -> DataFrame:
    """Columns with more than 15 % of their rows empty, from the per-column cell metrics."""
    share = F.try_divide(F.col("total") - F.col("n"), F.col("total"))
    rows = metrics.filter(share > vocab.NULL_SHARE_WARNING).select(
        "columna", (F.col("total") - F.col("n")).alias("filas"), share.alias("_p"))
    message = F.concat(F.lit("'"), "columna", F.lit("' tiene "), F.format_string("%.1f", F.col("_p") * 100),
                       F.lit(" % de valores vacíos."))
    return _finding(rows, "exceso_de_nulos", ADVERTENCIA, message, "Completar o descartar la columna.",
                    examples=F.array())


def _with_norm(counts: DataFrame) -> DataFrame:
    return counts if "norma" in counts.columns else counts.withColumn("norma", normalize(F.col("valor")))


def spelling_variants(counts: DataFrame) -> DataFrame:
    """``columna, norma, variantes, filas``: normal forms that several raw values share."""
    return _with_norm(counts).groupBy("columna", "norma").agg(
        F.count("*").alias("variantes"), F.sum("n").alias("filas")).filter(F.col("variantes") > 1)


def variant_forms(counts: DataFrame, restore: Restore = None) -> DataFrame:
    """``columna, norma, valor, n``: every raw value of the normal forms that several of them share."""
    shared = spelling_variants(counts).select("columna", "norma")
    forms = _with_norm(counts).join(shared, ["columna", "norma"]).select("columna", "norma", "valor", "n")
    return restore(forms) if restore else forms


def variant_findings(counts: DataFrame, text_columns: Sequence[str], restore: Restore = None) -> DataFrame:
    if not text_columns:
        return _none(counts)
    texts = _with_norm(counts.filter(F.col("columna").isin(list(text_columns))))
    groups = spelling_variants(texts)
    totals = groups.groupBy("columna").agg(F.count("*").alias("categorias"), F.sum("filas").alias("filas"))
    place = Window.partitionBy("columna").orderBy("norma")
    shown = groups.withColumn("_g", F.row_number().over(place)).filter(F.col("_g") <= VARIANT_EXAMPLES)
    # Three normal forms per column, each with its first spellings; a form can have as many as the column has rows.
    spelled = texts.join(F.broadcast(shown.select("columna", "norma", "_g", "variantes")), ["columna", "norma"])
    place = Window.partitionBy("columna", "_g").orderBy("valor")
    first = spelled.withColumn("_s", F.row_number().over(place)).filter(F.col("_s") <= SPELLINGS_SHOWN).select(
        "columna", "_g", "valor", "variantes")
    more = F.first("variantes") - SPELLINGS_SHOWN
    forms = (restore(first, limited=True) if restore else first).groupBy("columna", "_g").agg(F.concat(
        F.array_join(F.array_sort(F.collect_list("valor")), " / "),
        F.when(more > 0, F.concat(F.lit(" / … y "), more.cast("string"), F.lit(" más"))).otherwise("")).alias("t"))
    examples = forms.groupBy("columna").agg(F.array_sort(F.collect_list(F.struct("_g", "t"))).alias("_e")).select(
        "columna", F.transform("_e", lambda s: s["t"]).alias("ejemplos"))
    message = F.concat(F.lit("'"), "columna", F.lit("' tiene "), F.col("categorias").cast("string"),
                       F.lit(" categoría(s) escritas de varias formas."))
    return _finding(totals.join(F.broadcast(examples), "columna"), "inconsistencia_de_formato", ADVERTENCIA,
                    message, "Normalizar el texto de la columna.")


def identifier_columns(text_columns: Sequence[str]) -> list[str]:
    return [c for c in text_columns if normalize_name(c).startswith(vocab.IDENTIFIER_PREFIXES)]


def duplicate_id_findings(counts: DataFrame, text_columns: Sequence[str], restore: Restore = None) -> DataFrame:
    """Repeated values in text columns whose header starts like an identifier."""
    ids = identifier_columns(text_columns)
    if not ids:
        return _none(counts)
    repeated = counts.filter(F.col("columna").isin(ids) & (F.col("n") > 1))
    totals = repeated.groupBy("columna").agg(F.sum(F.col("n") - 1).alias("filas"))
    examples = _first_examples(repeated, ["columna"], [F.col("valor")], F.col("valor"), restore=restore)
    message = F.concat(F.col("filas").cast("string"), F.lit(" fila(s) de '"), "columna",
                       F.lit("' llevan un código que ya apareció antes."))
    return _finding(totals.join(F.broadcast(examples), "columna"), "identificador_duplicado", CRITICO, message,
                    "Buscar registros duplicados en el origen.")


def extreme_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columna, x, n, total``: numbers more than four sample deviations from the mean.

    Two scans: the moments (one row per column, broadcast), then the values beyond them.
    """
    long = numeric_long(df, columns)
    stats = long.groupBy("columna").agg(
        F.count("*").alias("total"), F.avg("x").alias("m"), F.stddev_samp("x").alias("s"),
        F.min("x").alias("lo"), F.max("x").alias("hi"),
    ).filter((F.col("total") > Z_MIN_ROWS) & (F.col("lo") < F.col("hi")) & (F.col("s") > 0))
    return (
        long.join(F.broadcast(stats), "columna").filter(F.abs((F.col("x") - F.col("m")) / F.col("s")) > Z_LIMIT)
        .groupBy("columna", "x", "total").agg(F.count("*").alias("n"))
    )


def zscore_findings(df: DataFrame) -> DataFrame:
    columns = numeric_columns(df)
    if not columns:
        return _none(df)
    extremes = extreme_values(df, columns)
    totals = extremes.groupBy("columna", "total").agg(F.sum("n").alias("filas")).filter(
        F.col("filas") / F.col("total") < vocab.OUTLIER_SHARE_WARNING)
    examples = _first_examples(extremes, ["columna"], [F.col("x")], short_number("x"))
    message = F.concat(F.lit("'"), "columna", F.lit("' tiene "), F.col("filas").cast("string"),
                       F.lit(" valor(es) a más de 4 desviaciones de la media."))
    return _finding(totals.join(F.broadcast(examples), "columna"), "atipicos_extremos", INFO, message,
                    "Confirmar si son errores de captura.")


# --- Report ---------------------------------------------------------------------------------------
def findings(
    df: DataFrame, counts: DataFrame | None = None,
    catalogues: Sequence[Catalogue] = vocab.CATALOGUES, ranges: Sequence[AdmissibleRange] = vocab.RANGES,
) -> DataFrame:
    """All findings; empty for a table without rows. Sort with :func:`sorted_findings`.

    Only text columns are counted by value; numbers are judged in the scans over the long frame.
    Long texts are told apart by digests of the whole text and of its normal form; examples show
    the whole texts.
    """
    by_kind = kinds(df)
    text = [c for c, k in by_kind.items() if k == TEXTO]
    bound = {c for cat in catalogues for c in bound_columns(df.columns, cat.hints)}
    counted = [c for c in df.columns if c in bound or c in text]
    restore = None
    if counts is None and counted:
        counts = value_counts(df, counted, compact=True, with_norm=True)
        restore = restore_texts(df)
    parts = [range_findings(df, ranges), duplicate_findings(df), null_findings(cell_metrics(df)), zscore_findings(df)]
    if counted:
        parts += [catalogue_findings(counts, df.columns, catalogues, restore), variant_findings(counts, text, restore),
                  duplicate_id_findings(counts, text, restore)]
    return reduce(DataFrame.unionByName, parts)


def sorted_findings(rows: DataFrame) -> DataFrame:
    """Most severe first, then most rows; ties by code and column."""
    rank = F.array_position(F.array(*[F.lit(s) for s in vocab.SEVERITY_ORDER]), F.col("severidad"))
    return rows.orderBy(rank, F.desc("filas_afectadas"), "codigo", "columna")


def score(rows: DataFrame, total: int | Column) -> DataFrame:
    """``puntuacion``: 100 less a weight per finding and the share of rows it touches; 0 without rows."""
    total = F.lit(total) if isinstance(total, int) else total
    weight = F.lit(None).cast("double")
    for severity, value in vocab.SEVERITY_WEIGHT.items():
        weight = F.when(F.col("severidad") == severity, value).otherwise(weight)
    reach = F.least(F.try_divide(F.col("filas_afectadas"), total), F.lit(1.0))
    penalty = rows.select((weight * (0.4 + 0.6 * reach)).alias("p")).agg(F.sum("p").alias("p"))
    value = F.round(F.greatest(F.lit(0.0), 100 - F.coalesce("p", F.lit(0.0))), 2)
    return penalty.select(F.when(total == 0, 0.0).otherwise(value).alias("puntuacion"))


def source_usage(
    headers: DataFrame, catalogues: Sequence[Catalogue] = vocab.CATALOGUES, ranges: Sequence[AdmissibleRange] = vocab.RANGES,
) -> DataFrame:
    """``orden, nombre, url, registros, encabezados, estado``: each rule source and how many headers use it.

    ``headers`` has ``columna, nombre`` and may have ``es_numerica``: ranges bind numeric columns
    only. Rules with one address are one source, named after the first of them.
    """
    numeric = F.col("es_numerica") if "es_numerica" in headers.columns else F.lit(True)
    marked = rule_binding(headers, catalogues, ranges).join(
        headers.select("columna", numeric.alias("_num")), "columna").filter((F.col("clase_regla") == "catalogo") | F.col("_num"))
    used = marked.select("columna", "clase_regla", F.col("regla").cast("int").alias("regla"))
    listed = [("catalogo", i, c.name, c.url, len(c.values)) for i, c in enumerate(catalogues)]
    listed += [("rango", i, r.name, r.url, len(ranges)) for i, r in enumerate(ranges)]
    rules = column_rows(headers, [(n, *row) for n, row in enumerate(listed)],
                        "n int, clase_regla string, regla int, nombre string, url string, registros bigint")
    by_url = F.broadcast(rules).join(used, ["clase_regla", "regla"], "left").groupBy("url").agg(
        F.min(F.struct("n", "nombre", "registros")).alias("_r"), F.count_distinct("columna").alias("encabezados"))
    place = F.row_number().over(Window.orderBy("_r.n")) - 1  # one row per source
    return by_url.select(
        place.cast("int").alias("orden"), "_r.nombre", "url", "_r.registros", "encabezados",
        F.when(F.col("encabezados") > 0, "consultada").otherwise("sin coincidencias").alias("estado"))


def sources(
    df: DataFrame, catalogues: Sequence[Catalogue] = vocab.CATALOGUES, ranges: Sequence[AdmissibleRange] = vocab.RANGES,
) -> DataFrame:
    """``orden, nombre, url, registros, estado``: each rule source and whether a column of the table uses it."""
    numeric = set(numeric_columns(df))
    headers = column_rows(df, [(c, normalize_name(c), c in numeric) for c in df.columns],
                          "columna string, nombre string, es_numerica boolean")
    return source_usage(headers, catalogues, ranges).drop("encabezados")
