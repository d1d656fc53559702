"""Report tables and the catalogue of saved analyses."""

from pyspark.sql import functions as F

from suite.classification import PART_SQL, renamed_part
from suite.describe import TEXTS
from suite.registry import flat, query, table
from varscope.operators.describe import numeric_summary
from varscope.operators.frequencies import value_counts
from varscope.operators.profile import column_profile
from varscope.plans import report
from varscope.sources.catalog import beyond_retention, newest_per_group, without_removed


@query("report_classification", f"""
SELECT columna AS "Columna", tipo AS "Tipo de variable", rol AS "Rol", confianza AS "Confianza", u AS "Valores únicos",
  total - n AS "Nulos", round((total - n) / total * 100, 2) AS "% Nulos" FROM ({PART_SQL})""")
def report_classification(spark, sf):
    t = report.classification_table(column_profile(renamed_part(spark, sf)))
    return flat(t.select("Columna", "Tipo de variable", "Rol", "Confianza", "Valores únicos", "Nulos", "% Nulos"))


@query("report_statistics", """
WITH m AS (SELECT string_agg(p_size::VARCHAR || '.0', ', ' ORDER BY p_size) AS moda FROM (
  SELECT p_size, n, row_number() OVER (ORDER BY p_size) AS i FROM (
    SELECT p_size, count(*) AS n, max(count(*)) OVER () AS top FROM part GROUP BY p_size) WHERE n = top AND top > 1) WHERE i <= 10)
SELECT 'p_size' AS "Columna", count(p_size) AS "N", round(round(avg(p_size), 6), 4) AS "Media", quantile_cont(p_size::DOUBLE, 0.5) AS "Mediana",
  (SELECT coalesce(moda, 'Sin moda') FROM m) AS "Moda", round(round(stddev_samp(p_size), 6), 4) AS "Desv. estándar", round(round(var_samp(p_size), 6), 4) AS "Varianza",
  min(p_size)::DOUBLE AS "Mínimo", max(p_size)::DOUBLE AS "Máximo", round(round(skewness(p_size), 6), 4) AS "Asimetría", round(round(kurtosis(p_size), 6), 4) AS "Curtosis",
  0::BIGINT AS "Atípicos" FROM part""")
def report_statistics(spark, sf):
    t = report.statistics_table(numeric_summary(table(spark, sf, "part"), ["p_size"]))
    return flat(t.select("Columna", "N", "Media", "Mediana", "Moda", "`Desv. estándar`", "Varianza", "Mínimo", "Máximo",
                         "Asimetría", "Curtosis", "Atípicos"))


@query("report_frequencies", f"""
WITH f AS (SELECT columna, valor, count(*) AS n FROM ({TEXTS}) GROUP BY ALL),
c AS (SELECT columna, valor, n, row_number() OVER w AS orden, (sum(n) OVER w)::BIGINT AS acum FROM f
  WINDOW w AS (PARTITION BY columna ORDER BY CASE WHEN columna = 'p_size' THEN valor::DOUBLE END, valor))
SELECT columna AS "Columna", valor AS "Valor", n AS "Frec. absoluta", acum AS "Frec. acumulada" FROM c WHERE orden <= 100""")
def report_frequencies(spark, sf):
    part = table(spark, sf, "part")
    columns = ["p_name", "p_brand", "p_type", "p_size"]
    t = report.frequencies_table(value_counts(part, columns), columns)
    return flat(t.select("Columna", "Valor", "`Frec. absoluta`", "`Frec. acumulada`"))


@query("history_retention", """
SELECT conv_id, turn, orden FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS orden
  FROM conversations) WHERE orden <= 3""")
def history_retention(spark, sf):
    rows = newest_per_group(table(spark, sf, "conversations"), "conv_id", [F.desc("turn")], 3)
    return flat(rows.select("conv_id", "turn", "orden"))


ENTRIES = ["conv_id AS cliente", "turn AS id", "turn AS creado_en", "role", "text"]


@query("history_list", """
SELECT conv_id AS cliente, turn AS id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS orden FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n BETWEEN 2 AND 5""")
def history_list(spark, sf):
    """Entries after retention to five per client and the removal of each client's newest one."""
    saved = table(spark, sf, "conversations").selectExpr(*ENTRIES)
    removed = beyond_retention(saved, 5).unionByName(
        newest_per_group(saved, "cliente", [F.desc("creado_en"), F.desc("id")], 1).drop("orden"))
    left = newest_per_group(without_removed(saved, removed), "cliente", [F.desc("creado_en"), F.desc("id")])
    return flat(left.select("cliente", "id", "role", "text", "orden"))


@query("history_fetch", """
SELECT conv_id AS cliente, turn AS id, text FROM conversations WHERE (conv_id, turn) IN (
  SELECT conv_id, max(turn) FROM conversations GROUP BY conv_id)""")
def history_fetch(spark, sf):
    saved = table(spark, sf, "conversations").selectExpr(*ENTRIES)
    newest = saved.groupBy("cliente").agg(F.max("id").alias("id"))
    return flat(saved.join(newest, ["cliente", "id"]).select("cliente", "id", "text"))


@query("history_clear", """
SELECT conv_id AS cliente, turn AS id FROM conversations c
WHERE NOT EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.role = 'system')""")
def history_clear(spark, sf):
    """What is left after every client with a system message has cleared all its entries."""
    saved = table(spark, sf, "conversations").selectExpr(*ENTRIES)
    leaving = saved.filter("role = 'system'").select("cliente").distinct()
    return flat(without_removed(saved, saved.join(leaving, "cliente", "left_semi")).select("cliente", "id"))
