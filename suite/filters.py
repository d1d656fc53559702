"""Slicer filters."""

from pyspark.sql import functions as F

from suite.registry import DOC_LABELS, documents_with_labels, flat, query, table
from varscope.operators.filters import (
    CATEGORICO, FECHAS, Filter, NULOS, RANGO, TEXTO_CONTIENE, apply_filters, search_values,
)
from varscope.operators.frequencies import value_counts


@query("filter_categorical", """
SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def filter_categorical(spark, sf):
    df, _ = apply_filters(table(spark, sf, "orders"), [
        Filter("o_orderpriority", CATEGORICO, valores=("1-URGENT", "2-HIGH"))])
    return flat(df.select("o_orderkey", "o_orderpriority"))


@query("filter_categorical_exclude", f"""
SELECT doc_id, quality::BIGINT AS quality FROM {DOC_LABELS} WHERE quality IS NULL OR quality <> 1""")
def filter_categorical_exclude(spark, sf):
    df, _ = apply_filters(documents_with_labels(spark, sf), [
        Filter("quality", CATEGORICO, valores=("1",), excluir=True, incluir_nulos=True)])
    return flat(df.select("doc_id", "quality"))


@query("filter_categorical_numeric", """
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity FROM lineitem WHERE l_quantity IN (10, 25)""")
def filter_categorical_numeric(spark, sf):
    df, _ = apply_filters(table(spark, sf, "lineitem"), [
        Filter("l_quantity", CATEGORICO, valores=("10", "25.0", "texto"))])
    return flat(df.select("l_orderkey", "l_linenumber", "l_quantity"))


@query("filter_range", """
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_extendedprice FROM lineitem
WHERE l_extendedprice >= 20000 AND l_extendedprice <= 30000""")
def filter_range(spark, sf):
    df, _ = apply_filters(table(spark, sf, "lineitem"), [
        Filter("l_extendedprice", RANGO, minimo=20000, maximo=30000)])
    return flat(df.select("l_orderkey", "l_linenumber", "l_extendedprice"))


@query("filter_date_range", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS fecha FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-02-01' AND o_orderdate <= TIMESTAMP '1996-12-31'""")
def filter_date_range(spark, sf):
    df, _ = apply_filters(table(spark, sf, "orders"), [
        Filter("o_orderdate", FECHAS, desde="1996-02-01", hasta="1996-12-31")])
    return flat(df.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("fecha")))


@query("filter_text_contains", """
SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), 'tion the')""")
def filter_text_contains(spark, sf):
    df, _ = apply_filters(table(spark, sf, "documents"), [Filter("text", TEXTO_CONTIENE, contiene=" TION the ")])
    return flat(df.select("doc_id", "n_chars"))


@query("filter_text_case", """
SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring')""")
def filter_text_case(spark, sf):
    df, _ = apply_filters(table(spark, sf, "part"), [
        Filter("p_name", TEXTO_CONTIENE, contiene="ring", sensible_mayusculas=True)])
    return flat(df.select("p_partkey", "p_name"))


@query("filter_not_null", f"""
SELECT doc_id, quality::BIGINT AS quality, toxic::BIGINT AS toxic FROM {DOC_LABELS} WHERE quality IS NOT NULL""")
def filter_not_null(spark, sf):
    df, _ = apply_filters(documents_with_labels(spark, sf), [Filter("quality", NULOS)])
    return flat(df.select("doc_id", "quality", "toxic"))


@query("filter_conjunction", """
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity, 3::BIGINT AS filtros_activos FROM lineitem
WHERE l_returnflag IN ('A', 'R') AND l_quantity >= 10
  AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate <= TIMESTAMP '1998-06-30'""")
def filter_conjunction(spark, sf):
    df, active = apply_filters(table(spark, sf, "lineitem"), [
        Filter("l_returnflag", CATEGORICO, valores=("A", "R")),
        Filter("l_quantity", RANGO, minimo=10),
        Filter("l_shipdate", FECHAS, desde="1996-01-01", hasta="1998-06-30"),
        Filter("l_linestatus", CATEGORICO),
    ])
    return flat(df.select("l_orderkey", "l_linenumber", "l_quantity", F.lit(active).alias("filtros_activos")))


@query("search_categories", """
SELECT p_name AS valor, count(*) AS n FROM part WHERE contains(lower(p_name), 'ring') GROUP BY p_name""")
def search_categories(spark, sf):
    return flat(search_values(value_counts(table(spark, sf, "part"), ["p_name"]), "p_name", "RING"))
