"""Cleaning and type inference, on text rendered from the tables."""

from pyspark.sql import functions as F

from suite.registry import DOC_LABELS, documents_with_labels, flat, query, table
from varscope.operators import cleaning
from varscope.operators.classify import cell_metrics
from varscope.operators.profile import dataset_metadata
from varscope.functions.text import parse_date, parse_number


@query("ingest_row_cap", """
SELECT o_orderkey, (SELECT count(*) FROM orders) AS filas_originales FROM orders ORDER BY o_orderkey LIMIT 1000""")
def ingest_row_cap(spark, sf):
    orders = table(spark, sf, "orders")
    total = orders.count()
    return flat(cleaning.cap_rows(orders, 1000, ["o_orderkey"]).select("o_orderkey", F.lit(total).alias("filas_originales")))


@query("clean_drop_empty_columns", """
SELECT unnest(['l_orderkey', 'l_tax', 'a_veces']) AS columna,
  unnest([count(l_orderkey), count(l_tax), count(nullif(l_returnflag, 'A'))]) AS n FROM lineitem""")
def clean_drop_empty_columns(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_tax", F.expr("nullif(l_returnflag, l_returnflag)").alias("vacia"),
        F.expr("nullif(l_returnflag, 'A')").alias("a_veces"), F.expr("nullif(l_tax, l_tax)").alias("sin_datos"))
    kept, _ = cleaning.drop_empty_columns(df)
    return flat(cell_metrics(kept).select("columna", "n"))


@query("clean_drop_empty_rows", f"""
SELECT quality::BIGINT AS quality, toxic::BIGINT AS toxic FROM {DOC_LABELS} WHERE quality IS NOT NULL OR toxic IS NOT NULL""")
def clean_drop_empty_rows(spark, sf):
    return flat(cleaning.drop_empty_rows(documents_with_labels(spark, sf).select("quality", "toxic")))


@query("clean_trim_blank_to_null", """
SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN lang END AS lang FROM documents""")
def clean_trim_blank_to_null(spark, sf):
    padded = F.expr("CASE WHEN doc_id % 5 = 0 THEN concat(' \\t', chr(160)) ELSE concat('  ', lang, chr(160), '\\n') END")
    return flat(cleaning.trim_text(table(spark, sf, "documents").select("doc_id", padded.alias("lang"))))


# Prices written in three styles, and one row in thirty that is no number.
PRICE_TEXT = """CASE WHEN p_partkey % 30 = 7 THEN 'sin dato'
  WHEN p_partkey % 3 = 0 THEN translate(format_number(p_retailprice, 2), '.,', ',.')
  WHEN p_partkey % 3 = 1 THEN format_number(p_retailprice, 2)
  ELSE concat(' ', replace(format_number(p_retailprice, 2), ',', ''), ' ') END"""


@query("parse_locale_number", """
SELECT p_partkey, CASE WHEN p_partkey % 30 <> 7 THEN round(p_retailprice, 2) END AS precio FROM part""")
def parse_locale_number(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", F.expr(PRICE_TEXT).alias("texto"))
    return flat(part.select("p_partkey", parse_number(F.col("texto")).alias("precio")))


@query("infer_numeric_columns", """
SELECT 'precio' AS columna, 'numero' AS tipo, count(*) FILTER (WHERE p_partkey % 30 <> 7) AS n,
  round(sum(round(p_retailprice, 2)) FILTER (WHERE p_partkey % 30 <> 7), 2) AS suma FROM part
UNION ALL SELECT 'talla', 'bigint', count(*), sum(p_size)::DOUBLE FROM part
UNION ALL SELECT 'mezcla', 'texto', count(*), NULL FROM part""")
def infer_numeric_columns(spark, sf):
    df = table(spark, sf, "part").select(
        F.expr(PRICE_TEXT).alias("precio"), F.col("p_size").cast("string").alias("talla"),
        F.expr("IF(p_partkey % 2 = 0, CAST(p_size AS STRING), p_name)").alias("mezcla"))
    typed, chosen = cleaning.infer_types(df)
    sums = typed.agg(*[F.expr(f"count({c}) AS n_{c}") for c in chosen], *[
        (F.expr(f"CAST(sum({c}) AS DOUBLE) AS s_{c}") if t != "texto" else F.expr(f"CAST(NULL AS DOUBLE) AS s_{c}"))
        for c, t in chosen.items()])
    rows = ", ".join(f"named_struct('columna', '{c}', 'tipo', '{t}', 'n', n_{c}, 'suma', s_{c})" for c, t in chosen.items())
    return flat(sums.select(F.expr(f"inline(array({rows}))")), 2)


@query("infer_date_columns", """
SELECT o_orderkey, CASE WHEN o_orderkey % 40 <> 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS fecha FROM orders""")
def infer_date_columns(spark, sf):
    text = """CASE WHEN o_orderkey % 40 = 3 THEN 'pendiente'
      WHEN o_orderkey % 3 = 0 THEN date_format(o_orderdate, 'dd/MM/yyyy')
      WHEN o_orderkey % 3 = 1 THEN date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss')
      ELSE date_format(o_orderdate, 'd-M-yyyy') END"""
    df = table(spark, sf, "orders").select("o_orderkey", F.expr(text).alias("fecha"))
    typed, _ = cleaning.infer_types(df)
    return flat(typed.select("o_orderkey", F.date_format("fecha", "yyyy-MM-dd").alias("fecha")))


@query("dataset_metadata", f"""
SELECT count(*) AS filas, 3::BIGINT AS columnas,
  (count(*) * 3 - count(lang) - count(quality) - count(toxic))::BIGINT AS celdas_vacias,
  (count(*) - (SELECT count(*) FROM (SELECT DISTINCT lang, quality, toxic FROM {DOC_LABELS})))::BIGINT AS filas_duplicadas,
  count(*) > 5000 AS vista_recortada FROM {DOC_LABELS}""")
def dataset_metadata_query(spark, sf):
    return flat(dataset_metadata(documents_with_labels(spark, sf).select("lang", "quality", "toxic")))


@query("parse_odd_dates", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || CASE o_orderkey % 5 WHEN 3 THEN ' 15:04:05' WHEN 4 THEN ' 05:30:00' ELSE ' 00:00:00' END AS fecha
FROM orders""")
def parse_odd_dates(spark, sf):
    """Two-digit years, month names, AM and PM, and a zone."""
    day = F.col("o_orderdate")
    shapes = F.when(F.col("o_orderkey") % 5 == 0, F.date_format(day, "dd/MM/yy")).when(
        F.col("o_orderkey") % 5 == 1, F.date_format(day, "dd-MMM-yyyy")).when(
        F.col("o_orderkey") % 5 == 2, F.date_format(day, "MMM d, yyyy")).when(
        F.col("o_orderkey") % 5 == 3, F.concat(F.date_format(day, "dd/MM/yyyy"), F.lit(" 3:04:05 PM"))).otherwise(
        F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00:30:00-05:00")))
    orders = table(spark, sf, "orders").select("o_orderkey", shapes.alias("texto"))
    return orders.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"),
                         F.date_format(parse_date(F.col("texto")), "yyyy-MM-dd HH:mm:ss").alias("fecha"))
