"""Data-quality rules."""

from pyspark.sql import functions as F

from suite.registry import DOC_LABELS, documents_with_labels, flat, normal, query, table
from varscope.functions.text import normalize
from varscope.functions.vocab import AdmissibleRange, Catalogue
from varscope.operators import quality
from varscope.operators.catalogues import missing_from, nearest_entries
from varscope.operators.filters import CATEGORICO, Filter, apply_filters
from varscope.operators.frequencies import restore_texts, value_counts
from varscope.session import freeze

RULE_CATALOGUES = (Catalogue("Artículos", "u:a", ("the ", "les "), ()), Catalogue("Verbos", "u:v", ("ierth",), ()))
RULE_RANGES = (AdmissibleRange("Sílabas", "u:s", ("tion", "ment"), 0.0, 1.0, "u"),)


@query("quality_rule_binding", f"""
WITH h AS (SELECT CAST(doc_id AS VARCHAR) AS columna, {normal('text')} AS nombre FROM documents)
SELECT columna, 'catalogo' AS clase_regla, 0::BIGINT AS regla FROM h WHERE contains(nombre, 'the ') OR contains(nombre, 'les ')
UNION ALL SELECT columna, 'catalogo', 1 FROM h WHERE contains(nombre, 'ierth')
UNION ALL SELECT columna, 'rango', 0 FROM h WHERE contains(nombre, 'tion') OR contains(nombre, 'ment')""")
def quality_rule_binding(spark, sf):
    headers = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("columna"), normalize(F.col("text")).alias("nombre"))
    return flat(quality.rule_binding(headers, RULE_CATALOGUES, RULE_RANGES))


TYPES = Catalogue("Tipos de producto", "u:t", ("tipo",), ("economi", "standard", "small", "medio"))
TYPE_ROWS = "(VALUES ('economi', 0), ('standard', 1), ('small', 2), ('medio', 3)) e(entrada, i)"
UNKNOWN_SQL = f"""SELECT columna, valor, n, norma, arg_min(entrada, levenshtein(norma, entrada) * 100 + i) AS cerca,
    min(levenshtein(norma, entrada)) AS d
  FROM (SELECT 'Tipo Producto' AS columna, p_type AS valor, count(*) AS n, {normal('p_type')} AS norma FROM part GROUP BY p_type),
    {TYPE_ROWS}
  WHERE norma NOT IN ('economi', 'standard', 'small', 'medio') GROUP BY ALL"""
SUGGESTED = "CASE WHEN d <= greatest(1, length(norma) // 3) THEN cerca END"


def _typed_part(spark, sf):
    return table(spark, sf, "part").select(F.col("p_type").alias("Tipo Producto"))


@query("quality_suggestion", f"SELECT columna, valor, n, {SUGGESTED} AS sugerido FROM ({UNKNOWN_SQL})")
def quality_suggestion(spark, sf):
    counts = value_counts(_typed_part(spark, sf))
    return flat(quality.unknown_values(counts, ["Tipo Producto"], [TYPES]).drop("catalogo"))


@query("quality_catalog", f"""
WITH u AS (SELECT *, {SUGGESTED} AS sugerido, row_number() OVER (ORDER BY n DESC, valor) AS i FROM ({UNKNOWN_SQL}))
SELECT 'valor_fuera_de_catalogo' AS codigo, 'advertencia' AS severidad, columna, sum(n)::BIGINT AS filas_afectadas,
  string_agg(CASE WHEN sugerido IS NULL THEN valor ELSE valor || ' → ' || sugerido END, '|' ORDER BY i) FILTER (WHERE i <= 5) AS ejemplos
FROM u GROUP BY columna""")
def quality_catalog(spark, sf):
    rows = quality.catalogue_findings(value_counts(_typed_part(spark, sf)), ["Tipo Producto"], [TYPES])
    return flat(rows.select("codigo", "severidad", "columna", "filas_afectadas", "ejemplos"))


@query("quality_range", """
WITH v AS (SELECT 'Ingreso Mensual' AS columna, c_acctbal AS x FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT 'Edad', c_custkey::DOUBLE FROM customer WHERE c_custkey > 125),
e AS (SELECT columna, x, row_number() OVER (PARTITION BY columna ORDER BY x) AS i FROM (SELECT DISTINCT columna, x FROM v))
SELECT 'valor_fuera_de_rango' AS codigo, 'critico' AS severidad, columna, count(*) AS filas_afectadas,
  (SELECT string_agg(CASE WHEN x = floor(x) THEN x::BIGINT::VARCHAR ELSE x::VARCHAR END, '|' ORDER BY i) FROM e WHERE e.columna = v.columna AND i <= 5) AS ejemplos
FROM v GROUP BY columna""")
def quality_range(spark, sf):
    df = table(spark, sf, "customer").select(F.col("c_acctbal").alias("Ingreso Mensual"), F.col("c_custkey").alias("Edad"))
    return flat(quality.range_findings(df).select("codigo", "severidad", "columna", "filas_afectadas", "ejemplos"))


@query("quality_duplicates", """
SELECT 'filas_duplicadas' AS codigo, 'advertencia' AS severidad, filas::BIGINT AS filas_afectadas FROM (
  SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem)) AS filas FROM lineitem)
WHERE filas > 0""")
def quality_duplicates(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    return flat(quality.duplicate_findings(df).select("codigo", "severidad", "filas_afectadas"))


@query("quality_nulls", f"""
SELECT 'exceso_de_nulos' AS codigo, columna, nulos AS filas_afectadas FROM (
  SELECT unnest(['doc_id', 'lang', 'quality', 'toxic']) AS columna,
    unnest([count(*) - count(doc_id), count(*) - count(lang), count(*) - count(quality), count(*) - count(toxic)]) AS nulos,
    count(*) AS total FROM {DOC_LABELS}) WHERE nulos / total > 0.15""")
def quality_nulls(spark, sf):
    from varscope.operators.classify import cell_metrics

    df = documents_with_labels(spark, sf).select("doc_id", "lang", "quality", "toxic")
    return flat(quality.null_findings(cell_metrics(df)).select("codigo", "columna", "filas_afectadas"))


# Brands written in two ways, and types with an accent on some rows.
SPELLINGS = """SELECT CASE WHEN p_partkey % 4 = 0 THEN upper(p_brand) ELSE p_brand END AS marca,
  CASE WHEN p_partkey % 7 = 0 THEN concat(p_type, ' ') ELSE replace(p_type, 'SMALL', 'SMÁLL') END AS tipo FROM {source}"""


@query("quality_variants", f"""
WITH t AS ({SPELLINGS.format(source='part')}), v AS (SELECT 'marca' AS columna, marca AS valor FROM t UNION ALL SELECT 'tipo', tipo FROM t),
f AS (SELECT columna, valor, {normal('valor')} AS norma, count(*) AS n FROM v GROUP BY ALL),
g AS (SELECT columna, norma, count(*) AS variantes, sum(n) AS filas, string_agg(valor, ' / ' ORDER BY valor) AS formas
  FROM f GROUP BY ALL HAVING count(*) > 1),
r AS (SELECT *, row_number() OVER (PARTITION BY columna ORDER BY norma) AS i FROM g)
SELECT 'inconsistencia_de_formato' AS codigo, columna, sum(filas)::BIGINT AS filas_afectadas,
  string_agg(formas, '|' ORDER BY i) FILTER (WHERE i <= 3) AS ejemplos FROM r GROUP BY columna""")
def quality_variants(spark, sf):
    df = spark.sql(SPELLINGS.format(source="{part}"), part=table(spark, sf, "part"))
    rows = quality.variant_findings(value_counts(df), ["marca", "tipo"])
    return flat(rows.select("codigo", "columna", "filas_afectadas", "ejemplos"))


@query("quality_duplicate_ids", """
WITH f AS (SELECT event_type || '-' || user_id AS valor, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1),
r AS (SELECT *, row_number() OVER (ORDER BY valor) AS i FROM f)
SELECT 'identificador_duplicado' AS codigo, 'id_visita' AS columna, sum(n - 1)::BIGINT AS filas_afectadas,
  string_agg(valor, '|' ORDER BY i) FILTER (WHERE i <= 5) AS ejemplos FROM r HAVING count(*) > 0""")
def quality_duplicate_ids(spark, sf):
    df = table(spark, sf, "events").select(F.concat_ws("-", "event_type", "user_id").alias("id_visita"))
    rows = quality.duplicate_id_findings(value_counts(df), ["id_visita"])
    return flat(rows.select("codigo", "columna", "filas_afectadas", "ejemplos"))


ZSCORE = """SELECT 'atipicos_extremos' AS codigo, 'value' AS columna, count(*) FILTER (WHERE z > 4) AS filas_afectadas
FROM (SELECT abs((value - avg(value) OVER ()) / stddev_samp(value) OVER ()) AS z FROM {source})
HAVING count(*) > 10 AND count(*) FILTER (WHERE z > 4) > 0 AND count(*) FILTER (WHERE z > 4) / count(*) < 0.02"""


@query("quality_zscore", ZSCORE.format(source="events"))
def quality_zscore(spark, sf):
    df = table(spark, sf, "events").select("value")
    return flat(quality.zscore_findings(df).select("codigo", "columna", "filas_afectadas"))


# One table that breaks several rules: an identifier that repeats, spellings, a negative amount.
VISITS = """SELECT concat(event_type, '-', CAST(user_id AS {text})) AS id_visita,
  CASE WHEN event_id % 3 = 0 THEN upper(event_type) ELSE event_type END AS canal,
  value - 5 AS monto, value AS value FROM {source}"""
VISITS_SQL = VISITS.format(text="VARCHAR", source="{source}")
CHANNELS = (Catalogue("Canales", "u:c", ("canal",), ("click", "view", "purchase")),)


def _findings_sql(source):
    t = f"({VISITS_SQL.format(source=source)})"
    return f"""WITH t AS {t}, total AS (SELECT count(*) AS filas FROM t),
f AS (
  SELECT 'valor_fuera_de_catalogo' AS codigo, 'advertencia' AS severidad, 'canal' AS columna, count(*) AS filas_afectadas FROM t
    WHERE lower(canal) NOT IN ('click', 'view', 'purchase') HAVING count(*) > 0
  UNION ALL SELECT 'valor_fuera_de_rango', 'critico', 'monto', count(*) FROM t WHERE monto < 0 HAVING count(*) > 0
  UNION ALL SELECT 'filas_duplicadas', 'advertencia', NULL, n FROM (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS n FROM t) WHERE n > 0
  UNION ALL SELECT 'identificador_duplicado', 'critico', 'id_visita', n FROM (SELECT count(*) - count(DISTINCT id_visita) AS n FROM t) WHERE n > 0
  UNION ALL SELECT 'inconsistencia_de_formato', 'advertencia', 'canal', sum(n)::BIGINT FROM (
    SELECT lower(canal) AS k, count(*) AS n FROM t GROUP BY 1 HAVING count(DISTINCT canal) > 1) HAVING count(*) > 0
  UNION ALL SELECT 'atipicos_extremos', 'info', columna, filas_afectadas FROM (
    {ZSCORE.format(source='t')} UNION ALL {ZSCORE.format(source="t").replace("'value'", "'monto'").replace('value -', 'monto -').replace('(value)', '(monto)')})
)"""


def _visits(spark, sf):
    return spark.sql(VISITS.format(text="STRING", source="{events}"), events=table(spark, sf, "events"))


@query("quality_findings", _findings_sql("events") + " SELECT codigo, severidad, columna, filas_afectadas FROM f")
def quality_findings(spark, sf):
    rows = quality.sorted_findings(quality.findings(_visits(spark, sf), catalogues=CHANNELS))
    return flat(rows.select("codigo", "severidad", "columna", "filas_afectadas"))


SCORE = """SELECT round(greatest(0, 100 - coalesce(sum(CASE severidad WHEN 'critico' THEN 12 WHEN 'advertencia' THEN 5 ELSE 1 END
  * (0.4 + 0.6 * least(filas_afectadas / filas, 1))), 0)), 2)::DOUBLE AS puntuacion FROM f, total"""


@query("quality_score", _findings_sql("events") + SCORE)
def quality_score(spark, sf):
    df = _visits(spark, sf)
    return flat(quality.score(quality.findings(df, catalogues=CHANNELS), df.count()))


@query("quality_filtered", _findings_sql("(SELECT * FROM events WHERE upper(event_type) = 'CLICK' OR event_type = 'error')")
       + " SELECT codigo, severidad, columna, filas_afectadas FROM f")
def quality_filtered(spark, sf):
    visible, _ = apply_filters(_visits(spark, sf), [
        Filter("canal", CATEGORICO, valores=("click", "CLICK", "error", "ERROR"))])
    rows = quality.sorted_findings(quality.findings(visible, catalogues=CHANNELS))
    return flat(rows.select("codigo", "severidad", "columna", "filas_afectadas"))


@query("quality_sources", f"""
WITH h AS (SELECT {normal('text')} AS nombre FROM documents),
s AS (SELECT 0 AS orden, 'Artículos' AS nombre, 'u:a' AS url, 0 AS registros, count(*) FILTER (contains(nombre, 'the ') OR contains(nombre, 'les ')) AS encabezados FROM h
  UNION ALL SELECT 1, 'Verbos', 'u:v', 0, count(*) FILTER (contains(nombre, 'ierth')) FROM h
  UNION ALL SELECT 2, 'Sílabas', 'u:s', 1, count(*) FILTER (contains(nombre, 'tion') OR contains(nombre, 'ment')) FROM h)
SELECT orden::BIGINT AS orden, nombre, url, registros::BIGINT AS registros, encabezados,
  CASE WHEN encabezados > 0 THEN 'consultada' ELSE 'sin coincidencias' END AS estado FROM s""")
def quality_sources(spark, sf):
    headers = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("columna"), normalize(F.col("text")).alias("nombre"))
    return flat(quality.source_usage(headers, RULE_CATALOGUES, RULE_RANGES))


@query("quality_long_texts", """
WITH f AS (SELECT text AS valor, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, sha256(valor)) AS i FROM f)
SELECT sum(n - 1)::BIGINT AS repetidas, count(*) AS textos, sum(length(valor))::BIGINT AS caracteres FROM r""")
def quality_long_texts(spark, sf):
    """Whole texts put back into compact counts of documents: every repeated text, whatever its length."""
    docs = table(spark, sf, "documents").select("text")
    counts = value_counts(docs, compact=True).filter("n > 1")
    whole = restore_texts(docs)(counts)
    return flat(whole.agg(F.sum(F.col("n") - 1).alias("repetidas"), F.count("*").alias("textos"),
                          F.sum(F.length("valor")).alias("caracteres")))


@query("quality_variant_forms", f"""
WITH t AS ({SPELLINGS.format(source='part')}), v AS (SELECT 'marca' AS columna, marca AS valor FROM t UNION ALL SELECT 'tipo', tipo FROM t),
f AS (SELECT columna, valor, {normal('valor')} AS norma, count(*) AS n FROM v GROUP BY ALL)
SELECT columna, norma, valor, n FROM f WHERE (columna, norma) IN (SELECT (columna, norma) FROM f GROUP BY columna, norma HAVING count(*) > 1)""")
def quality_variant_forms(spark, sf):
    df = spark.sql(SPELLINGS.format(source="{part}"), part=table(spark, sf, "part"))
    return flat(quality.variant_forms(value_counts(df)))


WORDS = "[a-zà-ÿ]+"
CATALOGUE_WORDS = f"""known AS (SELECT DISTINCT {normal('w')} AS entrada FROM (SELECT unnest(regexp_extract_all(lower(text), '{WORDS}')) AS w FROM documents)),
asked AS (SELECT DISTINCT {normal('w')} AS norma FROM (SELECT unnest(regexp_extract_all(lower(text), '{WORDS}')) AS w FROM conversations))"""


@query("quality_large_catalogue", f"""
WITH {CATALOGUE_WORDS},
missing AS (SELECT norma, greatest(1, length(norma) // 3) AS limite FROM asked WHERE norma NOT IN (SELECT entrada FROM known)),
near AS (SELECT norma, arg_min(entrada, (d, entrada)) AS sugerido FROM (
    SELECT norma, entrada, limite, levenshtein(norma, entrada) AS d FROM missing JOIN known
      ON length(entrada) BETWEEN length(norma) - limite AND length(norma) + limite) WHERE d <= limite GROUP BY norma)
SELECT m.norma, n.sugerido FROM missing m LEFT JOIN near n ON n.norma = m.norma""")
def quality_large_catalogue(spark, sf):
    """Words of conversations that no document has, each with the nearest word of the documents."""
    words = lambda name: table(spark, sf, name).select(F.explode(F.regexp_extract_all(
        F.lower("text"), F.lit(f"({WORDS})"), F.lit(1))).alias("w")).distinct().select(normalize(F.col("w")).alias("norma")).distinct()
    # Entries without an order of their own: ties go to the first by its letters.
    known = freeze(words("documents")).select(F.col("norma").alias("entrada"), F.lit(0).cast("bigint").alias("orden"))
    return flat(nearest_entries(missing_from(words("conversations"), known), known))
