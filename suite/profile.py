"""Profiles and previews."""

from pyspark.sql import functions as F

from suite.charts import correlation_sql
from suite.classification import classified_sql
from suite.registry import DOC_LABELS, documents_with_labels, flat, query, table
from varscope.operators import profile
from varscope.operators.duplicates import duplicate_rows
from varscope.operators.filters import CATEGORICO, Filter, RANGO
from varscope.plans.analysis import Dataset, analyse

DOC_HINTS = [
    ("doc_id", "entero", True, False, False, False), ("lang", "texto", False, False, False, False),
    ("source", "texto", False, False, False, False), ("n_chars", "entero", False, False, False, False),
    ("quality", "entero", False, False, False, False), ("toxic", "entero", False, False, False, False),
]
DOC_SQL = classified_sql(DOC_LABELS, DOC_HINTS)
DOC_DUPLICATES = f"(SELECT (count(*) - count(DISTINCT (lang, source, n_chars, quality, toxic, doc_id)))::BIGINT FROM {DOC_LABELS})"


@query("column_profile", f"""
SELECT columna, 'col' || pos AS clave, tipo, rol, confianza, total, total - n AS nulos, round((total - n) / total * 100, 2) AS porcentaje_nulos,
  u AS unicos, num AS es_numerica FROM ({DOC_SQL})""")
def column_profile(spark, sf):
    p = profile.column_profile(documents_with_labels(spark, sf))
    return flat(p.select("columna", "clave", "tipo", "rol", "confianza", "total", "nulos", "porcentaje_nulos", "unicos", "es_numerica"))


@query("global_summary", f"""
WITH p AS ({DOC_SQL})
SELECT max(total) AS filas, count(*) AS columnas, count(*) FILTER (WHERE num) AS numericas, count(*) FILTER (WHERE NOT num) AS categoricas,
  count(*) FILTER (WHERE tipo = 'Cualitativo Nominal') AS nominales, count(*) FILTER (WHERE tipo = 'Cualitativo Ordinal') AS ordinales,
  count(*) FILTER (WHERE tipo = 'Cuantitativo Discreto') AS discretas, count(*) FILTER (WHERE tipo = 'Cuantitativo Continuo') AS continuas,
  sum(total)::BIGINT AS celdas_totales, sum(total - n)::BIGINT AS celdas_nulas,
  round((1 - sum(total - n) / sum(total)) * 100, 2) AS completitud, {DOC_DUPLICATES} AS filas_duplicadas FROM p""")
def global_summary(spark, sf):
    df = documents_with_labels(spark, sf)
    return flat(profile.global_summary(df, profile.column_profile(df)))


@query("duplicate_rows", """
SELECT (count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)))::BIGINT AS filas_duplicadas FROM documents""")
def duplicate_rows_query(spark, sf):
    return flat(duplicate_rows(table(spark, sf, "documents").select("text", "lang")))


@query("completeness", " UNION ALL ".join(
    f"SELECT '{c[0]}' AS columna, count(*) AS total, count(*) - count({c[0]}) AS nulos, "
    f"round((count(*) - count({c[0]})) / count(*) * 100, 2) AS porcentaje_nulos FROM {DOC_LABELS}" for c in DOC_HINTS))
def completeness(spark, sf):
    return flat(profile.completeness(documents_with_labels(spark, sf)))


def _list_sql(column, order="valor", limit=200):
    return (f"(SELECT string_agg(valor, '|' ORDER BY i) FROM (SELECT valor, row_number() OVER (ORDER BY {order}) AS i FROM "
            f"(SELECT CAST({column} AS VARCHAR) AS valor, {column} AS k, count(*) AS n FROM part GROUP BY ALL)) WHERE i <= {limit})")


@query("filter_options", f"""
SELECT 'p_partkey' AS columna, CASE WHEN count(DISTINCT p_partkey) > 200 THEN 'texto' ELSE 'categorico' END AS tipo_control,
  {_list_sql('p_partkey', 'n DESC, k')} AS valores, count(DISTINCT p_partkey) > 200 AS valores_truncados,
  NULL::DOUBLE AS minimo, NULL::DOUBLE AS maximo, NULL::DOUBLE AS paso, false AS tiene_nulos FROM part
UNION ALL SELECT 'p_name', 'categorico', {_list_sql('p_name')}, false, NULL, NULL, NULL, false
UNION ALL SELECT 'p_brand', 'categorico', {_list_sql('p_brand')}, false, NULL, NULL, NULL, false
UNION ALL SELECT 'p_type', 'categorico', {_list_sql('p_type')}, false, NULL, NULL, NULL, false
UNION ALL SELECT 'p_size', 'rango', '', false, min(p_size)::DOUBLE, max(p_size)::DOUBLE, 1, false FROM part
UNION ALL SELECT 'p_retailprice', 'rango', '', false, min(p_retailprice), max(p_retailprice),
  round(round(greatest((max(p_retailprice) - min(p_retailprice)) / 100, 1e-6), 6), 4), false FROM part""")
def filter_options(spark, sf):
    return flat(profile.filter_options(table(spark, sf, "part")).drop("pos"))


CUSTOMER_COLUMNS = [("c_custkey", True), ("c_name", False), ("c_nationkey", True), ("c_acctbal", True), ("c_mktsegment", False)]


@query("full_analysis", f"""
{' UNION ALL '.join(f"SELECT 'columna' AS seccion, '{c}' AS clave, 'unicos' AS medida, count(DISTINCT {c})::DOUBLE AS valor FROM customer" for c, _ in CUSTOMER_COLUMNS)}
UNION ALL {' UNION ALL '.join(f"SELECT 'numero', '{c}', 'mediana', round(round(quantile_cont({c}, 0.5), 6), 4) FROM customer" for c, num in CUSTOMER_COLUMNS if num)}
UNION ALL SELECT 'correlacion', col_x, col_y, round(r, 4) FROM ({correlation_sql('customer', ['c_custkey', 'c_nationkey', 'c_acctbal'])})
UNION ALL SELECT 'filtro', 'c_nationkey', 'maximo', max(c_nationkey)::DOUBLE FROM customer
UNION ALL SELECT 'filtro', 'c_acctbal', 'maximo', max(c_acctbal) FROM customer
UNION ALL SELECT 'resumen', 'tabla', 'filas', count(*)::DOUBLE FROM customer
UNION ALL SELECT 'resumen', 'tabla', 'filas_duplicadas', 0""")
def full_analysis(spark, sf):
    a = analyse(table(spark, sf, "customer"))
    row = lambda section, key, measure, value: [
        F.lit(section).alias("seccion"), key.alias("clave"), measure.alias("medida"), value.cast("double").alias("valor")]
    col, text = F.col, F.lit
    parts = a.columnas.select(*row("columna", col("columna"), text("unicos"), col("unicos")))
    parts = parts.unionByName(a.resumen_numerico.select(*row("numero", col("columna"), text("mediana"), col("mediana"))))
    parts = parts.unionByName(a.correlacion.select(*row("correlacion", col("col_x"), col("col_y"), col("r"))))
    parts = parts.unionByName(a.filtros.filter("maximo IS NOT NULL").select(*row("filtro", col("columna"), text("maximo"), col("maximo"))))
    for measure in ("filas", "filas_duplicadas"):
        parts = parts.unionByName(a.resumen.select(*row("resumen", text("tabla"), text(measure), col(measure))))
    return flat(parts)


@query("filtered_analysis", """
WITH v AS (SELECT * FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_totalprice >= 100000),
t AS (SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS columna,
  unnest([count(DISTINCT o_orderkey), count(DISTINCT o_custkey), count(DISTINCT o_orderstatus), count(DISTINCT o_totalprice),
    count(DISTINCT o_orderdate), count(DISTINCT o_orderpriority)]) AS unicos FROM v)
SELECT columna, CASE WHEN columna = 'o_orderdate' THEN 'Cualitativo Ordinal' WHEN columna = 'o_totalprice' THEN 'Cuantitativo Continuo'
  WHEN columna = 'o_custkey' THEN 'Cuantitativo Discreto' ELSE 'Cualitativo Nominal' END AS tipo,
  (SELECT count(*) FROM v) AS total, unicos, 2::BIGINT AS filtros_activos FROM t""")
def filtered_analysis(spark, sf):
    dataset = Dataset.of(table(spark, sf, "orders"))
    a = dataset.analyse([Filter("o_orderpriority", CATEGORICO, valores=("1-URGENT", "5-LOW")),
                         Filter("o_totalprice", RANGO, minimo=100000), Filter("o_orderstatus", CATEGORICO)])
    return flat(a.columnas.select("columna", "tipo", "total", "unicos", F.lit(a.filtros_activos).alias("filtros_activos")))


@query("row_preview", """
SELECT event_id, CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
  ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS ts, event_type, round(value, 4) AS value
FROM events ORDER BY event_id LIMIT 100""")
def row_preview(spark, sf):
    return flat(profile.row_preview(table(spark, sf, "events"), 100, ["event_id"]).select("event_id", "ts", "event_type", "value"))
