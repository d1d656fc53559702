"""Chart data."""

from pyspark.sql import functions as F

from suite.describe import CLASS_FIELDS, classes_sql
from suite.registry import DOC_LABELS, documents_with_labels, flat, query, stacked, table
from varscope.operators import charts
from varscope.operators.correlation import correlation
from varscope.operators.profile import column_profile


@query("chart_bar", """
WITH g AS (SELECT p_brand AS categoria, count(*)::DOUBLE AS valor FROM part GROUP BY p_brand)
SELECT row_number() OVER (ORDER BY valor DESC, categoria) AS orden, categoria, valor FROM g
ORDER BY valor DESC, categoria LIMIT 25""")
def chart_bar(spark, sf):
    return flat(charts.bar(table(spark, sf, "part"), "p_brand").select("orden", "categoria", "valor"))


@query("chart_pie_others", """
WITH g AS (SELECT p_name AS categoria, count(p_retailprice)::DOUBLE AS valor FROM part GROUP BY p_name),
r AS (SELECT *, row_number() OVER (ORDER BY valor DESC, categoria) AS i FROM g)
SELECT least(i, 11) AS orden, CASE WHEN i > 10 THEN 'Otros' ELSE categoria END AS categoria, sum(valor) AS valor
FROM r GROUP BY 1, 2""")
def chart_pie_others(spark, sf):
    return flat(charts.pie(table(spark, sf, "part"), "p_name", "p_retailprice", "conteo"))


@query("chart_histogram", classes_sql(stacked("orders", ["o_totalprice"])))
def chart_histogram(spark, sf):
    return flat(charts.histogram_chart(table(spark, sf, "orders"), "o_totalprice").select(*CLASS_FIELDS), 6)


@query("chart_histogram_k", classes_sql(stacked("customer", ["c_acctbal"]), 12))
def chart_histogram_k(spark, sf):
    return flat(charts.histogram_chart(table(spark, sf, "customer"), "c_acctbal", 12).select(*CLASS_FIELDS), 6)


@query("chart_line", """
WITH g AS (SELECT strftime(ts, '%Y-%m-%d') AS categoria, round(sum(value), 2) AS valor FROM events GROUP BY ALL)
SELECT row_number() OVER (ORDER BY categoria) AS orden, categoria, valor, count(*) OVER () AS total_categorias
FROM g ORDER BY categoria LIMIT 400""")
def chart_line(spark, sf):
    events = table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("dia"), "value")
    return flat(charts.line(events, "dia", "value").select("orden", "categoria", "valor", "total_categorias"), 2)


@query("chart_scatter_groups", """
WITH top AS (SELECT p_brand FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 10)
SELECT p_brand AS grupo, p_size::DOUBLE AS x, round(p_retailprice, 4) AS y FROM part WHERE p_brand IN (SELECT p_brand FROM top)""")
def chart_scatter_groups(spark, sf):
    return flat(charts.scatter(table(spark, sf, "part"), "p_size", "p_retailprice", "p_brand"))


@query("numeric_pairs", f"""
SELECT doc_id, n_chars::DOUBLE AS x, quality::DOUBLE AS y FROM {DOC_LABELS} WHERE n_chars IS NOT NULL AND quality IS NOT NULL""")
def numeric_pairs(spark, sf):
    return flat(charts.numeric_pairs(documents_with_labels(spark, sf), "n_chars", "quality", keep=["doc_id"]))


@query("chart_radar", """
WITH g AS (SELECT event_type AS categoria, max(value) AS valor FROM events GROUP BY event_type)
SELECT row_number() OVER (ORDER BY valor DESC, categoria) AS orden, categoria, round(valor, 4) AS valor FROM g
WHERE (SELECT count(*) FROM g) >= 3 ORDER BY valor DESC, categoria LIMIT 12""")
def chart_radar(spark, sf):
    return flat(charts.radar(table(spark, sf, "events"), "event_type", "value", "maximo").select("orden", "categoria", "valor"))


STACK_SQL = """WITH c AS (SELECT l_returnflag AS categoria, l_linestatus AS serie, sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
m AS (SELECT x.categoria, s.serie, coalesce(c.v, 0) AS v FROM (SELECT DISTINCT categoria FROM c) x,
  (SELECT DISTINCT serie FROM c) s LEFT JOIN c ON c.categoria = x.categoria AND c.serie = s.serie)"""


@query("chart_stacked", f"{STACK_SQL} SELECT categoria, serie, round(v, 4) AS valor FROM m")
def chart_stacked(spark, sf):
    return flat(charts.stacked(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity",
                               limit_x=25, limit_series=25))


@query("chart_stacked_100", f"""{STACK_SQL}
SELECT categoria, serie, round(CASE WHEN sum(v) OVER (PARTITION BY categoria) = 0 THEN 0
  ELSE v / sum(v) OVER (PARTITION BY categoria) * 100 END, 4) AS valor FROM m""")
def chart_stacked_100(spark, sf):
    return flat(charts.stacked(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity", normalizar=True,
                               limit_x=25, limit_series=25))


@query("chart_combo", """
WITH g AS (SELECT event_type AS categoria, sum(value) AS barra, sum(user_id)::DOUBLE AS linea FROM events GROUP BY event_type),
r AS (SELECT *, least(min(linea) OVER (), 0) AS lo, max(linea) OVER () AS hi FROM g)
SELECT row_number() OVER (ORDER BY barra DESC, categoria) AS orden, categoria, round(barra, 2) AS barra, round(linea, 2) AS linea,
  round(lo - CASE WHEN lo < 0 THEN (hi - lo) * 0.08 ELSE 0 END, 2) AS eje_min, round(hi + (hi - lo) * 0.08, 2) AS eje_max FROM r""")
def chart_combo(spark, sf):
    return flat(charts.combo(table(spark, sf, "events"), "event_type", "value", "user_id"), 2)


BOX_SQL = """WITH top AS (SELECT {x} AS grupo FROM {t} GROUP BY {x} ORDER BY count(*) DESC, {x} LIMIT 12),
v AS (SELECT {x} AS grupo, {y}::DOUBLE AS x FROM {t} WHERE {x} IN (SELECT grupo FROM top)),
q AS (SELECT grupo, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS mediana, quantile_cont(x, 0.75) AS q3 FROM v GROUP BY grupo),
f AS (SELECT v.grupo, v.x, q1, mediana, q3, v.x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS dentro
  FROM v JOIN q ON q.grupo = v.grupo)"""


@query("chart_box", BOX_SQL.format(t="part", x="p_brand", y="p_retailprice") + """
SELECT grupo, count(*) AS n, round(any_value(q1), 4) AS q1, round(any_value(mediana), 4) AS mediana, round(any_value(q3), 4) AS q3,
  round(min(x) FILTER (WHERE dentro), 4) AS bigote_inf, round(max(x) FILTER (WHERE dentro), 4) AS bigote_sup,
  count(*) FILTER (WHERE NOT dentro) AS atipicos FROM f GROUP BY grupo""")
def chart_box(spark, sf):
    return flat(charts.box(table(spark, sf, "part"), "p_retailprice", "p_brand"))


@query("chart_box_outliers", BOX_SQL.format(t="events", x="event_type", y="value") + """
SELECT grupo, round(x, 4) AS x FROM f WHERE NOT dentro""")
def chart_box_outliers(spark, sf):
    return flat(charts.box_outliers(table(spark, sf, "events"), "value", "event_type"))


def correlation_sql(source, columns):
    pairs = [f"SELECT '{a}' AS col_x, '{b}' AS col_y, round(CASE WHEN min({a}) FILTER (WHERE {b} IS NOT NULL) < "
             f"max({a}) FILTER (WHERE {b} IS NOT NULL) AND min({b}) FILTER (WHERE {a} IS NOT NULL) < "
             f"max({b}) FILTER (WHERE {a} IS NOT NULL) THEN corr({a}, {b}) END, 6) AS r FROM {source}"
             for a in columns for b in columns]
    return " UNION ALL ".join(pairs)


@query("correlation_matrix", correlation_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]))
def correlation_matrix(spark, sf):
    return flat(correlation(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]), 6)


@query("chart_heatmap_corr", correlation_sql(DOC_LABELS, ["doc_id", "n_chars", "quality", "toxic"]))
def chart_heatmap_corr(spark, sf):
    return flat(charts.heatmap_correlation(documents_with_labels(spark, sf)), 6)


@query("chart_heatmap_cross", """
WITH c AS (SELECT CAST(p_size AS VARCHAR) AS categoria, p_brand AS serie, count(*)::DOUBLE AS v FROM part GROUP BY ALL),
tx AS (SELECT categoria FROM c GROUP BY categoria ORDER BY sum(v) DESC, categoria LIMIT 30),
c2 AS (SELECT * FROM c WHERE categoria IN (SELECT categoria FROM tx)),
ts AS (SELECT serie FROM c2 GROUP BY serie ORDER BY sum(v) DESC, serie LIMIT 30)
SELECT tx.categoria, ts.serie, coalesce(c2.v, 0) AS valor FROM tx, ts
LEFT JOIN c2 ON c2.categoria = tx.categoria AND c2.serie = ts.serie""")
def chart_heatmap_cross(spark, sf):
    return flat(charts.heatmap_cross(table(spark, sf, "part"), "p_size", "p_brand"))


@query("chart_regression", """
WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS m, regr_intercept(l_extendedprice, l_quantity) AS b,
  corr(l_quantity, l_extendedprice) AS r, regr_r2(l_extendedprice, l_quantity) AS r2, count(*) AS n,
  min(l_quantity) AS x0, max(l_quantity) AS x1 FROM lineitem)
SELECT round(m, 4) AS pendiente, round(b, 4) AS intercepto, round(r, 4) AS r, round(r2, 4) AS r2, n, x0,
  round(m * x0 + b, 4) AS y0, x1, round(m * x1 + b, 4) AS y1 FROM f""")
def chart_regression(spark, sf):
    return flat(charts.regression(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"))


@query("kpis", f"""
SELECT count(*) AS filas, round(count(*) * 100.0 / (SELECT count(*) FROM documents), 4)::DOUBLE AS proporcion, 6::BIGINT AS columnas,
  round((count(doc_id) + count(nullif(lang, '')) + count(nullif(source, '')) + count(n_chars) + count(quality) + count(toxic))
    * 100.0 / (count(*) * 6), 4)::DOUBLE AS completitud,
  sum(n_chars)::DOUBLE AS suma, round(avg(n_chars), 4) AS promedio
FROM {DOC_LABELS} WHERE lang = 'en'""")
def kpis(spark, sf):
    docs = documents_with_labels(spark, sf)
    return flat(charts.kpis(docs.filter(F.col("lang") == "en"), "n_chars", docs.count()))


@query("recommend_axes", """
WITH u AS (SELECT count(DISTINCT p_name) AS nombre, count(DISTINCT p_brand) AS marca, count(DISTINCT p_type) AS tipo FROM part),
puntos AS (SELECT unnest([nombre, marca, tipo]) AS u, unnest(['p_name', 'p_brand', 'p_type']) AS c, unnest([1, 2, 3]) AS pos FROM u),
s AS (SELECT c, row_number() OVER (ORDER BY CASE WHEN u <= 1 THEN -100 WHEN u <= 12 THEN 100 - u
  ELSE greatest(10 - u / 10, -20) END DESC, pos) AS i FROM puntos)
SELECT 'x' AS eje, c AS columna FROM s WHERE i = 1
UNION ALL SELECT 'y', 'p_retailprice'
UNION ALL SELECT 'serie', c FROM s WHERE i = 2""")
def recommend_axes(spark, sf):
    part = table(spark, sf, "part")
    scores = charts.axis_scores(column_profile(part))
    return charts.axes_table(part, charts.recommend_axes(scores))


@query("table_page_sorted", """
SELECT p_partkey, p_name FROM part ORDER BY p_name DESC, p_partkey LIMIT 100 OFFSET 100""")
def table_page_sorted(spark, sf):
    page = charts.table_page(table(spark, sf, "part"), "p_name", False, 1, 100, ["p_partkey"])
    return flat(page.select("p_partkey", "p_name"))
