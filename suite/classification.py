"""Column classification."""

from pyspark.sql import functions as F

from suite.registry import flat, normal, query, stacked_text, table
from varscope.functions.text import normalize
from varscope.functions.vocab import ORDINAL_SCALES
from varscope.operators import classify
from varscope.operators.frequencies import value_counts


@query("normalize_text", f"SELECT doc_id, {normal('text')} AS norma FROM documents")
def normalize_text(spark, sf):
    return flat(table(spark, sf, "documents").select("doc_id", normalize(F.col("text")).alias("norma")))


HINTS = {"articulo": ("les", "the", "der", "los"), "pareja": ("of the", "de la")}


def _hint_cases(words):
    whole = lambda w: (f"contains(norma, '{w}')" if " " in w else f"list_contains(string_split(norma, ' '), '{w}')")
    return "CASE " + " ".join(f"WHEN {whole(w)} THEN '{w}'" for w in words) + " END"


@query("header_hints", f"""
WITH h AS (SELECT CAST(doc_id AS VARCHAR) AS columna, {normal('text')} AS norma FROM documents),
p AS (SELECT columna, 'articulo' AS grupo, {_hint_cases(HINTS['articulo'])} AS pista FROM h
  UNION ALL SELECT columna, 'pareja', {_hint_cases(HINTS['pareja'])} FROM h)
SELECT * FROM p WHERE pista IS NOT NULL""")
def header_hints(spark, sf):
    headers = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("columna"), normalize(F.col("text")).alias("nombre"))
    return flat(classify.header_hints(headers, HINTS))


LEVELS = """SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'Muy_Alto' WHEN '2-HIGH' THEN ' ALTO' WHEN '3-MEDIUM' THEN 'Medio'
    WHEN '4-NOT SPECIFIED' THEN 'bajo' ELSE 'Muy  bajo' END AS nivel,
  CASE o_orderstatus WHEN 'F' THEN 'Baja' WHEN 'O' THEN 'MEDIA' ELSE 'álta' END AS prioridad,
  o_orderstatus AS estado, CASE WHEN o_orderkey % 2 = 0 THEN 'Sí' ELSE 'NO' END AS pagado,
  CASE WHEN o_orderkey % 3 = 0 THEN 'true' WHEN o_orderkey % 3 = 1 THEN 'FALSE' ELSE 'no' END AS dudoso FROM {source}"""
LEVEL_COLUMNS = ["nivel", "prioridad", "estado", "pagado", "dudoso"]


def _levels(spark, sf):
    return value_counts(spark.sql(LEVELS.format(source="{orders}"), orders=table(spark, sf, "orders")))


SCALE_ROWS = ", ".join(f"({i}, {p}, '{level}')" for i, scale in enumerate(ORDINAL_SCALES) for p, level in enumerate(scale))


@query("ordinal_scale_detect", f"""
WITH t AS ({LEVELS.format(source='orders')}),
d AS (SELECT DISTINCT columna, {normal('valor')} AS norma FROM ({stacked_text('t', LEVEL_COLUMNS)})),
e(escala_id, pos, nivel) AS (VALUES {SCALE_ROWS}),
m AS (SELECT d.columna, e.escala_id, count(*) AS niveles, string_agg(e.nivel, '|' ORDER BY e.pos) AS escala
  FROM d JOIN e ON e.nivel = d.norma WHERE d.norma <> '' GROUP BY ALL),
u AS (SELECT columna, count(*) AS usados FROM d WHERE norma <> '' GROUP BY columna),
s AS (SELECT escala_id, least(3, count(*)) AS minimo FROM e GROUP BY escala_id),
r AS (SELECT m.*, row_number() OVER (PARTITION BY m.columna ORDER BY m.niveles DESC, m.escala_id) AS i
  FROM m JOIN u ON u.columna = m.columna AND u.usados = m.niveles JOIN s ON s.escala_id = m.escala_id
  WHERE m.niveles >= s.minimo AND m.niveles >= 2)
SELECT columna, escala_id::BIGINT AS escala_id, niveles, escala FROM r WHERE i = 1""")
def ordinal_scale_detect(spark, sf):
    return flat(classify.ordinal_scales(_levels(spark, sf)))


@query("boolean_label_detect", f"""
WITH t AS ({LEVELS.format(source='orders')}),
d AS (SELECT DISTINCT columna, {normal('valor')} AS norma FROM ({stacked_text('t', LEVEL_COLUMNS)})),
l AS (SELECT columna, list_sort(list(norma)) AS usadas FROM d WHERE norma <> '' GROUP BY columna)
SELECT columna, usadas IN (['no', 'si'], ['false', 'true'], ['f', 'm'], ['n', 'y'], ['no', 'yes'])
  AS booleana FROM l""")
def boolean_label_detect(spark, sf):
    return flat(classify.boolean_labels(_levels(spark, sf)))


NUMERIC = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("integrality_check", " UNION ALL ".join(
    f"SELECT '{c}' AS columna, bool_and(abs({c} - round({c})) <= 1e-9) AS entera FROM lineitem" for c in NUMERIC))
def integrality_check(spark, sf):
    return flat(classify.integrality(table(spark, sf, "lineitem"), NUMERIC))


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("uniqueness_ratio", " UNION ALL ".join(
    f"SELECT '{c}' AS columna, count({c}) AS n, count(DISTINCT {c}) AS unicos, round(count(DISTINCT {c}) / count({c}), 4) AS ratio "
    f"FROM orders" for c in ORDER_COLUMNS))
def uniqueness_ratio(spark, sf):
    return flat(classify.distinct_counts(value_counts(table(spark, sf, "orders"))))


@query("free_text_detect", " UNION ALL ".join(
    f"SELECT '{c}' AS columna, round(avg(length({c})), 4) AS largo, "
    f"avg(length({c})) > 40 AND count(DISTINCT {c}) / count({c}) > 0.6 AS libre FROM documents" for c in ("text", "lang", "source")))
def free_text_detect(spark, sf):
    df = table(spark, sf, "documents").select("text", "lang", "source")
    metrics = classify.column_metrics(df)
    return flat(metrics.select("columna", "largo", F.expr("largo > 40 AND ratio > 0.6").alias("libre")))


def classified_sql(source, columns):
    """Classification in SQL: ``columna, pos, clase, total, n, u, tipo, rol, confianza``.

    ``columns`` holds (name, kind, identifier hint, ordinal hint, count hint, continuous hint). The
    label rules (known scales and yes/no pairs) are left out: no column used here has such labels.
    """
    parts = []
    for pos, (name, kind, i, o, c, z) in enumerate(columns):
        number = kind in ("entero", "decimal")
        x = f'"{name}"::DOUBLE' if number else "NULL::DOUBLE"
        length = f'avg(length("{name}"))' if kind == "texto" else "NULL"
        parts.append(
            f"""SELECT '{name}' AS columna, {pos} AS pos, '{kind}' AS clase, {i} AS hi, {o} AS ho, {c} AS hc, {z} AS hz,
  count(*) AS total, count("{name}") AS n, count(DISTINCT "{name}") AS u,
  coalesce(bool_and(abs({x} - round({x})) <= 1e-9), true) AS entera, min({x}) AS lo, max({x}) AS hi_, {length} AS largo FROM {source}""")
    rules = [
        ("n = 0", "Cualitativo Nominal", "categoria", 0.2), ("clase = 'fecha'", "Cualitativo Ordinal", "temporal", 0.95),
        ("num AND hi AND (u / n >= 0.9 OR entera)", "Cualitativo Nominal", "identificador", 0.88),
        ("num AND ho AND entera AND u <= 12", "Cualitativo Ordinal", "categoria", 0.82),
        ("num AND entera AND u = 2 AND lo = 0 AND hi_ = 1", "Cualitativo Nominal", "booleano", 0.85),
        ("num AND NOT entera AND hz", "Cuantitativo Continuo", "medida", 0.95),
        ("num AND NOT entera", "Cuantitativo Continuo", "medida", 0.9),
        ("num AND hc", "Cuantitativo Discreto", "conteo", 0.93), ("num AND hz", "Cuantitativo Continuo", "medida", 0.72),
        ("num AND u <= 30", "Cuantitativo Discreto", "conteo", 0.85),
        ("num AND u / n >= 0.95 AND n > 20", "Cualitativo Nominal", "identificador", 0.6),
        ("num", "Cuantitativo Discreto", "conteo", 0.7),
        ("hi OR (u / n >= 0.95 AND n > 20)", "Cualitativo Nominal", "identificador", 0.8),
        ("ho AND u <= 12", "Cualitativo Ordinal", "categoria", 0.6),
        ("largo > 40 AND u / n > 0.6", "Cualitativo Nominal", "texto_libre", 0.65),
        ("true", "Cualitativo Nominal", "categoria", 0.88),
    ]
    case = lambda k, quote: "CASE " + " ".join(
        f"WHEN {r[0]} THEN {quote}{r[k]}{quote}" for r in rules) + " END"
    return f"""SELECT columna, pos, clase, num, total, n, u, {case(1, "'")} AS tipo, {case(2, "'")} AS rol,
  ({case(3, '')})::DOUBLE AS confianza FROM (SELECT *, clase IN ('entero', 'decimal') AS num FROM ({' UNION ALL '.join(parts)}))"""


# Part under headers that carry hints of every group.
PART_AS = ('(SELECT p_partkey AS "Código", p_name AS "Nombre", p_brand AS "Clave Marca", p_type AS "Nivel", '
           'p_size AS "Cantidad", p_retailprice AS "Precio", p_size % 7 AS "Grado", p_size % 2 AS "Par", '
           'p_partkey * 2 AS "Peso" FROM {source})')
PART_HINTS = [
    ("Código", "entero", True, False, False, False), ("Nombre", "texto", False, False, False, False),
    ("Clave Marca", "texto", True, False, False, False), ("Nivel", "texto", False, True, False, False),
    ("Cantidad", "entero", False, False, True, False), ("Precio", "decimal", False, False, False, True),
    ("Grado", "entero", False, True, False, False), ("Par", "entero", False, False, False, False),
    ("Peso", "entero", False, False, False, True),
]
PART_SQL = classified_sql(PART_AS.format(source="part"), PART_HINTS)


def renamed_part(spark, sf):
    sql = "SELECT * FROM " + PART_AS.format(source="{part}").replace('"', "`")
    return spark.sql(sql, part=table(spark, sf, "part"))


@query("classify_columns", f"SELECT columna, tipo, rol, confianza FROM ({PART_SQL})")
def classify_columns(spark, sf):
    return flat(classify.classify(renamed_part(spark, sf)).select("columna", "tipo", "rol", "confianza"))


@query("type_summary", f"SELECT tipo, count(*) AS columnas FROM ({PART_SQL}) GROUP BY tipo")
def type_summary(spark, sf):
    return flat(classify.type_summary(classify.classify(renamed_part(spark, sf))))


@query("classify_columns_estimated", f"SELECT columna, tipo, rol, confianza FROM ({PART_SQL})")
def classify_columns_estimated(spark, sf):
    return flat(classify.classify(renamed_part(spark, sf), estimated=True).select("columna", "tipo", "rol", "confianza"))


DOCUMENT_HINTS = [
    ("doc_id", "entero", True, False, False, False), ("text", "texto", False, False, False, False),
    ("lang", "texto", False, False, False, False), ("source", "texto", False, False, False, False),
    ("n_chars", "entero", False, False, False, False),
]


@query("classify_documents_estimated", f"SELECT columna, tipo, rol, confianza FROM ({classified_sql('documents', DOCUMENT_HINTS)})")
def classify_documents_estimated(spark, sf):
    """Whole texts are told apart by a sketch; none is shuffled."""
    return flat(classify.classify(table(spark, sf, "documents"), estimated=True).select("columna", "tipo", "rol", "confianza"))


@query("normalize_forms", f"SELECT sha256({normal('text')}) AS huella, count(*) AS n FROM documents GROUP BY 1")
def normalize_forms(spark, sf):
    """Texts by their normal form: how many share it."""
    forms = table(spark, sf, "documents").select(F.sha2(normalize(F.col("text")), 256).alias("huella"))
    return flat(forms.groupBy("huella").agg(F.count("*").alias("n")))
