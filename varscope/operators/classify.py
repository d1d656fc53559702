"""Statistical type and role of every column, from one table with a row per column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from varscope.functions import vocab
from varscope.functions.columns import (
    DECIMAL, ENTERO, TEXTO, column_rows, finite_sql, kinds, local_rows, quoted, sql_array, sql_text,
)
from varscope.functions.text import normalize, normalize_name
from varscope.functions.vocab import (
    BOOLEANO, CATEGORIA, CONTEO, CONTINUA, DISCRETA, IDENTIFICADOR, MEDIDA, NOMINAL, ORDINAL,
    TEMPORAL, TEXTO_LIBRE,
)
from varscope.operators.frequencies import value_counts

WHOLE_TOLERANCE = 1e-9
MAX_ORDINAL_LEVELS = 12
#: Buckets of a sketch of distinct values, as a power of two; the relative standard deviation of its estimate is below
#: the error given, and an estimate is taken to be off by so many of them.
SKETCH_BITS, DISTINCT_ERROR, DEVIATIONS = 16, 0.005, 5
#: Shares of distinct values that a rule compares with.
RATIOS = (0.6, 0.9, vocab.IDENTIFIER_UNIQUE_RATIO)


# --- Headers ------------------------------------------------------------------------------------
def header_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``pos, columna, clase, nombre``: position, kind and normal form of each header."""
    rows = [(i, name, kind, normalize_name(name)) for i, (name, kind) in enumerate(kinds(df, columns).items())]
    return column_rows(df, rows, "pos int, columna string, clase string, nombre string")


def first_hint(hints: Sequence[str], padded: str = "_nombre") -> Column:
    """First hint found in a normalised header with a space on either side, or null.

    One-word hints match whole words, which the spaces around them ensure; longer hints match as
    a substring.
    """
    tests = " ".join(
        f"WHEN contains({padded}, {sql_text(h if ' ' in h else f' {h} ')}) THEN {sql_text(h)}" for h in hints)
    return F.expr(f"CASE {tests} END")


def header_hints(headers: DataFrame, hints: Mapping[str, Sequence[str]] = vocab.HINTS) -> DataFrame:
    """``columna, grupo, pista``: the first hint of each group found in a header.

    ``headers`` may hold the headers of many tables at once; each row is decided on its own.
    """
    padded = headers.select("columna", F.concat(F.lit(" "), "nombre", F.lit(" ")).alias("_nombre"))
    found = F.array(*[
        F.struct(F.lit(group).alias("grupo"), first_hint(words).alias("pista")) for group, words in hints.items()
    ])
    # The outer form keeps the optimizer from adding a filter that would match the hints twice.
    return padded.select("columna", F.inline_outer(found)).filter(F.col("pista").isNotNull())


# --- Metrics of the values ------------------------------------------------------------------------
def cell_metrics(df: DataFrame, columns: Sequence[str] | None = None, estimated: bool = False) -> DataFrame:
    """One row per column from one scan: ``columna, total, n, entera, minimo, maximo, largo``.

    ``n`` counts cells with a value; ``entera`` tells whether all finite values are whole;
    ``largo`` is the mean text length. With ``estimated`` the field ``distintos`` holds the number
    of distinct values as a HyperLogLog sketch estimates it.
    """
    parts: list[str] = ["count(*) AS _total"]
    rows: list[str] = []
    none = "CAST(NULL AS DOUBLE)"
    for i, (name, kind) in enumerate(kinds(df, columns).items()):
        cell, x = quoted(name), finite_sql(name, kind)
        n, whole, low, high, length = f"_n{i}", "true", none, none, none
        distinct = ""
        if estimated:
            value = x if kind in (ENTERO, DECIMAL) else f"CAST({cell} AS STRING)"
            parts.append(f"hll_sketch_estimate(hll_sketch_agg(IF({value} IS NULL, NULL, xxhash64({value})), {SKETCH_BITS})) AS _d{i}")
            distinct = f", 'distintos', _d{i}"
        if kind in (ENTERO, DECIMAL):
            parts += [f"count({x}) AS _n{i}", f"min({x}) AS _lo{i}", f"max({x}) AS _hi{i}"]
            low, high = f"_lo{i}", f"_hi{i}"
            if kind == DECIMAL:
                parts.append(f"bool_and(abs({x} - rint({x})) <= {WHOLE_TOLERANCE}) AS _w{i}")
                whole = f"coalesce(_w{i}, true)"
        else:
            parts.append(f"count({cell}) AS _n{i}")
            if kind == TEXTO:
                parts.append(f"avg(length(CAST({cell} AS STRING))) AS _len{i}")
                length = f"_len{i}"
        rows.append(f"named_struct('columna', {sql_text(name)}, 'total', _total, 'n', {n}, 'entera', {whole}, "
                    f"'minimo', {low}, 'maximo', {high}, 'largo', {length}{distinct})")
    return df.agg(*[F.expr(p) for p in parts]).select(F.expr(f"inline(array({', '.join(rows)}))"))


def integrality(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``columna, entera``: all finite values lie within 1e-9 of an integer (true when none)."""
    return cell_metrics(df, columns).select("columna", "entera")


def value_profile(
    counts: DataFrame,
    scales: Sequence[Sequence[str]] = vocab.ORDINAL_SCALES,
    pairs: Sequence[Sequence[str]] = vocab.BOOLEAN_PAIRS,
) -> DataFrame:
    """One row per column from one pass over the value counts.

    ``n, unicos, ratio`` are exact. For the label rules only the known words a column uses are
    collected (never more than the vocabulary holds); all other labels are just counted.
    """
    norm = F.when(F.col("valor_num").isNull(), normalize(F.col("valor")))
    named = counts.select("columna", "n", norm.alias("norma"))

    def known(words: list[str], prefix: str) -> list[Column]:
        inside = F.col("norma").isin(words)
        return [
            F.collect_set(F.when(inside, F.col("norma"))).alias(f"{prefix}_usadas"),
            F.count_if(~inside & (F.col("norma") != "")).alias(f"{prefix}_ajenas"),
        ]

    return named.groupBy("columna").agg(
        F.sum("n").alias("n"), F.count("*").alias("unicos"),
        *known(sorted({w for scale in scales for w in scale}), "escala"),
        *known(sorted({w for pair in pairs for w in pair}), "par"),
    ).withColumn("ratio", F.col("unicos") / F.col("n"))


def distinct_counts(counts: DataFrame) -> DataFrame:
    """``columna, n, unicos, ratio`` of the cells that hold a value, exact."""
    return counts.groupBy("columna").agg(
        F.sum("n").alias("n"), F.count("*").alias("unicos")
    ).withColumn("ratio", F.col("unicos") / F.col("n"))


def fitting_scale(scales: Sequence[Sequence[str]] = vocab.ORDINAL_SCALES) -> Column:
    """First known scale that holds every label of a column: ``escala_id, niveles`` or null.

    Needs the fields of :func:`value_profile`. Labels that all lie in a scale use equally many
    levels of every scale they fit, so the first one in the list is also the fullest.
    """
    table = ", ".join(
        f"named_struct('escala_id', {i}, 'minimo', {max(2, min(3, len(scale)))}, 'niveles', {sql_array(scale)})"
        for i, scale in enumerate(scales))
    first = (f"try_element_at(filter(array({table}), s -> size(escala_usadas) >= s.minimo "
             "AND size(array_except(escala_usadas, s.niveles)) = 0), 1)")
    # The transform over a one-element array names the scale once instead of repeating it.
    return F.expr(
        f"try_element_at(transform(filter(array(IF(escala_ajenas = 0, {first}, NULL)), s -> s IS NOT NULL), "
        "s -> named_struct('escala_id', s.escala_id, "
        "'niveles', filter(s.niveles, l -> array_contains(escala_usadas, l)))), 1)")


def ordinal_scales(counts: DataFrame, scales: Sequence[Sequence[str]] = vocab.ORDINAL_SCALES) -> DataFrame:
    """``columna, escala_id, niveles, escala`` for the columns whose labels form a known scale."""
    return (
        value_profile(counts, scales).withColumn("_s", fitting_scale(scales)).filter(F.col("_s").isNotNull())
        .select("columna", F.col("_s.escala_id").alias("escala_id"),
                F.size("_s.niveles").alias("niveles"), F.col("_s.niveles").alias("escala"))
    )


def in_boolean_pair(pairs: Sequence[Sequence[str]] = vocab.BOOLEAN_PAIRS) -> Column:
    """All labels lie in one known pair; a column whose labels normalise to nothing counts too."""
    table = ", ".join(sql_array(pair) for pair in pairs)
    return F.expr(f"par_ajenas = 0 AND size(par_usadas) <= 2 AND "
                  f"exists(array({table}), p -> size(array_except(par_usadas, p)) = 0)")


def boolean_labels(counts: DataFrame, pairs: Sequence[Sequence[str]] = vocab.BOOLEAN_PAIRS) -> DataFrame:
    """``columna, booleana`` for every text column."""
    texts = counts.filter(F.col("valor_num").isNull())
    return value_profile(texts, pairs=pairs).select("columna", in_boolean_pair(pairs).alias("booleana"))


def hinted_levels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columna, niveles_texto``: sorted levels of columns with at most twelve distinct values.

    A group limit keeps at most thirteen values per column on either side of the shuffle.
    """
    counts = value_counts(df, columns)
    order = Window.partitionBy("columna").orderBy(F.col("valor_num").asc_nulls_last(), "valor")
    number = F.col("valor_num")
    label = F.when(number == F.rint(number), number.cast("bigint").cast("string")).otherwise(F.col("valor"))
    return (
        counts.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= MAX_ORDINAL_LEVELS + 1)
        .groupBy("columna").agg(F.array_sort(F.collect_list(F.struct("_n", label.alias("t")))).alias("_l"))
        .filter(F.size("_l") <= MAX_ORDINAL_LEVELS)
        .select("columna", F.transform("_l", lambda s: s["t"]).alias("niveles_texto"))
    )


# --- Decision -----------------------------------------------------------------------------------
def _hinted(name: str, hints: Sequence[str]) -> bool:
    normal = normalize_name(name)
    return any(h in normal if " " in h else h in normal.split() for h in hints)


def _far_from_all(estimate: int, n: int) -> bool:
    """Whatever the error of an estimate, every rule reads the number of distinct values alike."""
    error = DEVIATIONS * DISTINCT_ERROR
    low, high = estimate * (1 - error), min(n, estimate * (1 + error))
    words = max(len({w for many in vocab.ORDINAL_SCALES for w in many}), len({w for pair in vocab.BOOLEAN_PAIRS for w in pair}))
    fewest = max(MAX_ORDINAL_LEVELS, vocab.DISCRETE_MAX_UNIQUE, words)
    return low > fewest and all((low >= r * n) == (high >= r * n) for r in RATIOS)


def counting_gate(df: DataFrame, columns: Sequence[str], estimated: bool = False) -> tuple[DataFrame, list[str], dict[str, int]]:
    """The cell metrics of one scan, the columns whose values have to be counted, and estimates of the others.

    A measure, a column with fractions, is continuous however many values it has; only a header that names an
    identifier asks for their number. With ``estimated`` a column is left out too where every rule reads its
    estimated number of distinct values alike, so that neither ids nor near-unique texts are shuffled by value.
    """
    kind = kinds(df, columns)
    first = cell_metrics(df, columns, estimated)
    rows = {r["columna"]: r for r in first.collect()}
    counted, known = [], {}
    for name in columns:
        row = rows[name]
        if kind[name] == DECIMAL and not row["entera"] and not _hinted(name, vocab.HINTS["identificador"]):
            continue
        if estimated and row["n"] and kind[name] in (ENTERO, DECIMAL, TEXTO) and _far_from_all(row["distintos"], row["n"]):
            known[name] = min(row["distintos"], row["n"])
        else:
            counted.append(name)
    # One row per column.
    return local_rows(df.sparkSession, [rows[c] for c in columns], first.schema).drop("distintos"), counted, known


def column_metrics(
    df: DataFrame, columns: Sequence[str] | None = None, counts: DataFrame | None = None, estimated: bool | None = None
) -> DataFrame:
    """Everything the decision needs, one row per column: two passes over the data.

    Where ``estimated`` is given, the first pass decides whose values the second one counts (:func:`counting_gate`);
    ``unicos`` and ``ratio`` of the other columns are estimates, or null for measures. Otherwise all are counted.
    """
    columns = list(kinds(df, columns))
    cells, counted, known = None, columns, {}
    if counts is None and estimated is not None:
        cells, counted, known = counting_gate(df, columns, estimated)
    cells = cell_metrics(df, columns) if cells is None else cells
    counts = value_counts(df, counted, compact=True) if counts is None else counts
    headers = header_table(df, columns).withColumn("_nombre", F.concat(F.lit(" "), "nombre", F.lit(" ")))
    headers = headers.withColumns({f"pista_{g}": first_hint(words) for g, words in vocab.HINTS.items()})
    # Every part below has at most one row per column of the table.
    labels = value_profile(counts).select(
        "columna", "unicos", "ratio", fitting_scale()["niveles"].alias("escala"),
        in_boolean_pair().alias("booleana"))
    result = headers.join(F.broadcast(cells), "columna").join(
        F.broadcast(labels), "columna", "left")
    if known:
        guessed = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
        result = result.withColumn("unicos", F.coalesce("unicos", guessed[F.col("columna")].cast("bigint"))).withColumn(
            "ratio", F.coalesce("ratio", guessed[F.col("columna")] / F.col("n"))).withColumn("booleana", F.coalesce("booleana", F.lit(False)))
    hinted = [c for c in counted if _hinted(c, vocab.ORDINAL_HINTS)]
    if hinted:
        result = result.join(F.broadcast(hinted_levels(df, hinted)), "columna", "left")
    else:
        result = result.withColumn("niveles_texto", F.lit(None).cast("array<string>"))
    return result.withColumn("unicos", F.coalesce("unicos", F.lit(0)))


# Decision list: condition, type, role, confidence, scale and reason. Conditions, scales and reasons
# are SQL over the metrics of one column; the first condition that holds decides.
NUMBER, TEXT = "(clase IN ('entero', 'decimal'))", "(clase = 'texto')"
NEAR_UNIQUE = f"(ratio >= {vocab.IDENTIFIER_UNIQUE_RATIO} AND n > 20)"
FEW = f"(unicos <= {MAX_ORDINAL_LEVELS})"
RULES = (
    ("n = 0", NOMINAL, CATEGORIA, 0.20, None, "'Sin valores: se toma como nominal.'"),
    ("clase = 'fecha'", ORDINAL, TEMPORAL, 0.95, None, "'Fechas: se ordenan en el tiempo.'"),
    ("clase = 'booleano'", NOMINAL, BOOLEANO, 0.98, None, "'Verdadero o falso: dos categorías.'"),
    (f"{NUMBER} AND pista_identificador IS NOT NULL AND (ratio >= 0.9 OR entera)", NOMINAL, IDENTIFICADOR, 0.88,
     None, "'El encabezado (' || pista_identificador || ') indica un identificador; los números son etiquetas.'"),
    (f"{NUMBER} AND pista_ordinal IS NOT NULL AND entera AND {FEW}", ORDINAL, CATEGORIA, 0.82, "niveles_texto",
     "'El encabezado (' || pista_ordinal || ') indica un orden con ' || unicos || ' niveles enteros.'"),
    (f"{NUMBER} AND entera AND unicos = 2 AND minimo = 0 AND maximo = 1", NOMINAL, BOOLEANO, 0.85, None,
     "'Solo ceros y unos: dos categorías.'"),
    (f"{NUMBER} AND NOT entera AND pista_continua IS NOT NULL", CONTINUA, MEDIDA, 0.95, None,
     "'Hay decimales y el encabezado (' || pista_continua || ') nombra una magnitud.'"),
    (f"{NUMBER} AND NOT entera", CONTINUA, MEDIDA, 0.90, None, "'Hay decimales: magnitud medible.'"),
    (f"{NUMBER} AND pista_conteo IS NOT NULL", DISCRETA, CONTEO, 0.93, None,
     "'Enteros y encabezado de conteo (' || pista_conteo || ').'"),
    (f"{NUMBER} AND pista_continua IS NOT NULL", CONTINUA, MEDIDA, 0.72, None,
     "'Enteros, pero el encabezado (' || pista_continua || ') nombra una magnitud.'"),
    (f"{NUMBER} AND unicos <= {vocab.DISCRETE_MAX_UNIQUE}", DISCRETA, CONTEO, 0.85, None,
     "'Enteros con solo ' || unicos || ' valores distintos.'"),
    (f"{NUMBER} AND {NEAR_UNIQUE}", NOMINAL, IDENTIFICADOR, 0.60, None,
     "'Enteros casi todos distintos (' || unicos || ' de ' || n || ').'"),
    (NUMBER, DISCRETA, CONTEO, 0.70, None, "'Todos los valores son enteros.'"),
    (f"{TEXT} AND escala IS NOT NULL", ORDINAL, CATEGORIA, 0.94, "escala",
     "'Las categorías forman una escala conocida (' || array_join(escala, ' < ') || ').'"),
    (f"{TEXT} AND booleana", NOMINAL, BOOLEANO, 0.90, None, "'Texto con dos categorías opuestas.'"),
    (f"{TEXT} AND pista_identificador IS NOT NULL", NOMINAL, IDENTIFICADOR, 0.80, None,
     "'El encabezado (' || pista_identificador || ') indica un identificador.'"),
    (f"{TEXT} AND {NEAR_UNIQUE}", NOMINAL, IDENTIFICADOR, 0.80, None,
     "'Casi todos los valores son distintos (' || unicos || ' de ' || n || ').'"),
    (f"{TEXT} AND pista_ordinal IS NOT NULL AND {FEW}", ORDINAL, CATEGORIA, 0.60, "niveles_texto",
     "'El encabezado (' || pista_ordinal || ') indica un orden que conviene revisar.'"),
    (f"{TEXT} AND largo > 40 AND ratio > 0.6", NOMINAL, TEXTO_LIBRE, 0.65, None,
     "'Texto largo y casi siempre distinto.'"),
    ("true", NOMINAL, CATEGORIA, 0.88, None,
     "'Categorías de texto sin orden (' || unicos || ' valores distintos).'"),
)


def decide(metrics: DataFrame) -> DataFrame:
    """Type, role, confidence, reason and scale of every column; the first rule that holds wins."""
    def chosen(by_rule: Sequence[str]) -> str:
        return "CASE _regla " + " ".join(f"WHEN {i} THEN {value}" for i, value in enumerate(by_rule)) + " END"

    rule = "CASE " + " ".join(f"WHEN {r[0]} THEN {i}" for i, r in enumerate(RULES)) + " END AS _regla"
    none = "CAST(NULL AS ARRAY<STRING>)"
    return metrics.selectExpr("*", rule).selectExpr(
        *[quoted(c) for c in metrics.columns],
        chosen([sql_text(r[1]) for r in RULES]) + " AS tipo",
        chosen([sql_text(r[2]) for r in RULES]) + " AS rol",
        chosen([f"{r[3]}D" for r in RULES]) + " AS confianza",
        chosen([r[4] or none for r in RULES]) + " AS escala_orden",
        chosen([r[5] for r in RULES]) + " AS justificacion",
    )


CLASSIFICATION_FIELDS = ("pos", "columna", "tipo", "rol", "confianza", "justificacion", "escala_orden")


def classify(
    df: DataFrame, columns: Sequence[str] | None = None, counts: DataFrame | None = None, estimated: bool = False
) -> DataFrame:
    """``pos, columna, tipo, rol, confianza, justificacion, escala_orden``, one row per column.

    Without ``counts`` only the columns are counted by value whose type asks for it. ``estimated`` lets a sketch
    decide for near-unique columns too: types, roles and scales are the same, numbers in a reason may be estimates.
    """
    return decide(column_metrics(df, columns, counts, estimated)).select(*CLASSIFICATION_FIELDS)


def type_summary(classification: DataFrame) -> DataFrame:
    """``tipo, columnas``: columns per statistical type."""
    return classification.groupBy("tipo").agg(F.count("*").alias("columnas"))
