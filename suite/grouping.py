"""Grouped aggregation."""

from pyspark.sql import functions as F

from suite.registry import DOC_LABELS, documents_with_labels, flat, query, table
from varscope.operators import grouping


def _group_sql(aggregate):
    return f"""WITH g AS (SELECT CAST(p_size AS VARCHAR) AS categoria, {aggregate} AS valor FROM part GROUP BY p_size),
r AS (SELECT *, row_number() OVER (ORDER BY round(valor, 4) DESC, categoria) AS orden, count(*) OVER () AS total_categorias FROM g)
SELECT categoria, round(valor, 4) AS valor, total_categorias FROM r WHERE orden <= 25"""


def _group(agregacion):
    def run(spark, sf):
        groups = grouping.group_by(table(spark, sf, "part"), "p_size", "p_retailprice", agregacion)
        # Sums of decimals differ in their last bits between runs; rounding first keeps ties ties.
        groups = groups.withColumn("valor", F.round("valor", 4))
        return flat(grouping.top_groups(groups).select("categoria", "valor", "total_categorias"))
    return run


for _name, _agregacion, _sql in (
    ("group_sum", "suma", "sum(p_retailprice)"), ("group_avg", "promedio", "avg(p_retailprice)"),
    ("group_count", "conteo", "count(p_retailprice)::DOUBLE"), ("group_median", "mediana", "quantile_cont(p_retailprice, 0.5)"),
    ("group_min", "minimo", "min(p_retailprice)"), ("group_max", "maximo", "max(p_retailprice)"),
):
    query(_name, _group_sql(_sql))(_group(_agregacion))


@query("group_null_label", f"""
SELECT 'filas' AS medida, coalesce(CAST(quality AS VARCHAR), '(vacío)') AS categoria, count(*)::DOUBLE AS valor
FROM {DOC_LABELS} GROUP BY quality
UNION ALL
SELECT 'toxic', lang, sum(toxic)::DOUBLE FROM {DOC_LABELS} GROUP BY lang HAVING count(toxic) > 0""")
def group_null_label(spark, sf):
    df = documents_with_labels(spark, sf)
    rows = grouping.group_by(df, "quality").select(F.lit("filas").alias("medida"), "categoria", "valor")
    measured = grouping.group_by(df, "lang", "toxic").select(F.lit("toxic").alias("medida"), "categoria", "valor")
    return flat(rows.unionByName(measured))


@query("group_topk", """
WITH g AS (SELECT p_brand AS categoria, round(sum(p_retailprice), 2) AS valor FROM part GROUP BY p_brand),
r AS (SELECT *, row_number() OVER (ORDER BY valor DESC, categoria) AS orden, count(*) OVER () AS total_categorias FROM g)
SELECT orden, categoria, valor, total_categorias, total_categorias > 10 AS truncado FROM r WHERE orden <= 10""")
def group_topk(spark, sf):
    groups = grouping.group_by(table(spark, sf, "part"), "p_brand", "p_retailprice").withColumn("valor", F.round("valor", 2))
    return flat(grouping.top_groups(groups, 10))


@query("group_scale_order", """
WITH g AS (SELECT o_orderpriority AS categoria, round(avg(o_totalprice), 4) AS valor FROM orders GROUP BY o_orderpriority)
SELECT row_number() OVER (ORDER BY CASE categoria WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 WHEN '5-LOW' THEN 3 ELSE 4 END,
  categoria) AS orden, categoria, valor FROM g""")
def group_scale_order(spark, sf):
    rows = grouping.aggregate(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice", "promedio",
                              scale=["3-medium", "1-Urgent", "5-LOW"])
    return flat(rows.select("orden", "categoria", "valor"))


@query("group_sequence", """
WITH g AS (SELECT strftime(o_orderdate, '%Y-%m') AS categoria, count(*)::DOUBLE AS valor FROM orders GROUP BY ALL)
SELECT row_number() OVER (ORDER BY categoria) AS orden, categoria, valor FROM g ORDER BY categoria LIMIT 400""")
def group_sequence(spark, sf):
    orders = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("mes"))
    return flat(grouping.aggregate(orders, "mes", limit=400, ordenar="categoria").select("orden", "categoria", "valor"))


@query("crosstab", """
WITH c AS (SELECT p_brand AS categoria, CAST(p_size AS VARCHAR) AS serie, sum(p_retailprice) AS v FROM part GROUP BY ALL)
SELECT x.categoria, s.serie, round(coalesce(c.v, 0), 2) AS valor
FROM (SELECT DISTINCT categoria FROM c) x, (SELECT DISTINCT serie FROM c) s
LEFT JOIN c ON c.categoria = x.categoria AND c.serie = s.serie""")
def crosstab(spark, sf):
    return flat(grouping.crosstab(table(spark, sf, "part"), "p_brand", "p_size", "p_retailprice", limit_x=100, limit_series=100), 2)


@query("crosstab_sparse", """
SELECT CAST(user_id AS VARCHAR) AS categoria, event_type AS serie, count(*)::DOUBLE AS valor FROM events GROUP BY ALL""")
def crosstab_sparse(spark, sf):
    return flat(grouping.crosstab(table(spark, sf, "events"), "user_id", "event_type"))


@query("crosstab_many_series", """
SELECT l_returnflag AS categoria, CAST(l_suppkey AS VARCHAR) AS serie, sum(l_quantity) AS valor FROM lineitem GROUP BY ALL""")
def crosstab_many_series(spark, sf):
    return flat(grouping.crosstab(table(spark, sf, "lineitem"), "l_returnflag", "l_suppkey", "l_quantity"))
