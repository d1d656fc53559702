"""Descriptive statistics and frequency tables."""

from pyspark.sql import functions as F

from suite.registry import flat, query, stacked, stacked_text, table
from varscope.functions.columns import numeric_long
from varscope.functions.vocab import PERCENTILES
from varscope.operators import describe, frequencies
from varscope.operators.profile import column_profile, top_categories
from varscope.operators.quantiles import APPROX, RANK_ERROR

COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
VALUES = stacked("lineitem", COLUMNS)


@query("describe_basic", f"""
SELECT columna, count(x) AS conteo, round(sum(x), 2) AS suma, round(avg(x), 4) AS media,
  min(x) AS minimo, max(x) AS maximo, round(max(x) - min(x), 4) AS rango
FROM ({VALUES}) GROUP BY columna""")
def describe_basic(spark, sf):
    m = describe.moments(table(spark, sf, "lineitem"), COLUMNS)
    return flat(m.select("columna", "conteo", F.round("suma", 2).alias("suma"), "media", "minimo", "maximo", "rango"))


QUARTILES_SQL = f"""SELECT columna, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2,
  quantile_cont(x, 0.75) AS q3 FROM ({VALUES}) GROUP BY columna"""


@query("describe_quartiles", f"""
SELECT columna, round(q1, 4) AS q1, round(q2, 4) AS q2, round(q3, 4) AS q3, round(q3 - q1, 4) AS iqr
FROM ({QUARTILES_SQL})""")
def describe_quartiles(spark, sf):
    return flat(describe.quartiles(table(spark, sf, "lineitem"), COLUMNS))


def _quantile_sql(letter, points):
    return " UNION ALL ".join(
        f"SELECT columna, '{letter}{name}' AS estadistico, round(round(quantile_cont(x, {p}), 6), 4) AS valor "
        f"FROM v GROUP BY columna" for name, p in points)


@query("describe_percentiles", f"WITH v AS ({VALUES}) " + _quantile_sql("p", [(p, p / 100) for p in PERCENTILES]))
def describe_percentiles(spark, sf):
    return flat(describe.percentile_rows(table(spark, sf, "lineitem"), COLUMNS))


@query("describe_deciles", f"WITH v AS ({VALUES}) " + _quantile_sql("d", [(d, d / 10) for d in range(1, 11)]))
def describe_deciles(spark, sf):
    return flat(describe.decile_rows(table(spark, sf, "lineitem"), COLUMNS))


@query("describe_percentiles_approx", f"""
SELECT columna, 'p' || p AS estadistico, count(x) AS n, true AS dentro
FROM ({VALUES}), (SELECT unnest([{', '.join(map(str, PERCENTILES))}]) AS p) GROUP BY ALL""")
def describe_percentiles_approx(spark, sf):
    """Sketched percentiles, each held against its rank in the table: off by ``RANK_ERROR`` of the rows at most."""
    lines = table(spark, sf, "lineitem")
    found = describe.percentile_rows(lines, COLUMNS, mode=APPROX)
    long = numeric_long(lines, COLUMNS)
    # Nine rows per column, rounded to four places, which all values of these columns keep.
    ranked = long.join(F.broadcast(found), "columna").groupBy("columna", "estadistico").agg(
        F.count("*").alias("n"), F.count_if(F.col("x") < F.col("valor")).alias("menores"),
        F.count_if(F.col("x") <= F.col("valor")).alias("hasta"))
    rank = F.col("n") * F.substring("estadistico", 2, 2).cast("double") / 100
    error = F.col("n") * RANK_ERROR + 1
    return flat(ranked.select("columna", "estadistico", "n", (
        (F.col("menores") - error <= rank) & (rank <= F.col("hasta") + error)).alias("dentro")))


MODES_SQL = f"""WITH f AS (SELECT columna, x, count(*) AS n FROM ({VALUES}) GROUP BY columna, x),
t AS (SELECT *, max(n) OVER (PARTITION BY columna) AS top FROM f),
m AS (SELECT columna, x AS moda, n, row_number() OVER (PARTITION BY columna ORDER BY x) AS orden
  FROM t WHERE n = top AND top > 1)
SELECT columna, orden, moda, n FROM m WHERE orden <= 10"""


@query("describe_modes", MODES_SQL)
def describe_modes(spark, sf):
    return flat(describe.modes(frequencies.value_counts(table(spark, sf, "lineitem"), COLUMNS)))


@query("describe_dispersion", f"""
SELECT columna, round(stddev_samp(x), 4) AS desviacion_estandar, round(var_samp(x), 2) AS varianza,
  round(stddev_samp(x) / abs(avg(x)), 4) AS coeficiente_variacion
FROM ({VALUES}) GROUP BY columna""")
def describe_dispersion(spark, sf):
    m = describe.moments(table(spark, sf, "lineitem"), COLUMNS)
    return flat(m.select("columna", "desviacion_estandar", F.round("varianza", 2).alias("varianza"),
                         "coeficiente_variacion"))


@query("describe_shape", f"""
SELECT columna, round(skewness(x), 4) AS asimetria, round(kurtosis(x), 4) AS curtosis
FROM ({VALUES}) GROUP BY columna""")
def describe_shape(spark, sf):
    return flat(describe.moments(table(spark, sf, "lineitem"), COLUMNS).select("columna", "asimetria", "curtosis"))


EVENTS_FENCES = """SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events"""


@query("describe_outliers", f"""
SELECT 'value' AS columna, count(*) FILTER (
  WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS atipicos
FROM events, ({EVENTS_FENCES})""")
def describe_outliers(spark, sf):
    return flat(describe.outliers(table(spark, sf, "events"), ["value"]))


@query("describe_numeric", f"""
WITH v AS ({VALUES}), q AS ({QUARTILES_SQL}), modas AS ({MODES_SQL}),
o AS (SELECT v.columna, count(*) FILTER (WHERE q3 > q1 AND
    (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1))) AS atipicos FROM v JOIN q USING (columna) GROUP BY v.columna)
SELECT v.columna, count(x) AS conteo, round(round(avg(x), 6), 4) AS media, round(round(any_value(q.q2), 6), 4) AS mediana,
  (SELECT string_agg(CASE WHEN moda = floor(moda) THEN moda::BIGINT::VARCHAR || '.0' ELSE moda::VARCHAR END, '|' ORDER BY orden)
   FROM modas WHERE modas.columna = v.columna) AS moda,
  round(round(stddev_samp(x), 6), 4) AS desviacion_estandar, min(x) AS minimo, max(x) AS maximo,
  round(round(any_value(q.q1), 6), 4) AS q1, round(round(any_value(q.q3), 6), 4) AS q3,
  round(round(skewness(x), 6), 4) AS asimetria, round(round(kurtosis(x), 6), 4) AS curtosis, any_value(o.atipicos) AS atipicos
FROM v JOIN q USING (columna) JOIN o USING (columna) GROUP BY v.columna""")
def describe_numeric(spark, sf):
    s = describe.numeric_summary(table(spark, sf, "lineitem"), COLUMNS)
    return flat(s.select("columna", "conteo", "media", "mediana", F.col("moda").cast("array<string>").alias("moda"),
                         "desviacion_estandar", "minimo", "maximo", "q1", "q3", "asimetria", "curtosis", "atipicos"))


# --- Frequency tables -----------------------------------------------------------------------------
def _frequency_sql(source, column, order, limit=None, text=None):
    """Cumulative table over the full column; the limit only cuts the display."""
    text = text or f"CAST({column} AS VARCHAR)"
    cut = f"WHERE orden <= {limit}" if limit else ""
    return f"""WITH f AS (SELECT {column} AS k, {text} AS valor, count(*) AS n FROM {source}
  WHERE {column} IS NOT NULL GROUP BY ALL),
c AS (SELECT valor, n, row_number() OVER w AS orden, sum(n) OVER (ORDER BY {order} ROWS UNBOUNDED PRECEDING)::BIGINT AS acum,
  sum(n) OVER ()::BIGINT AS total FROM f WINDOW w AS (ORDER BY {order}))
SELECT orden, valor, n AS frecuencia_absoluta, round(n / total, 6) AS frecuencia_relativa,
  acum AS frecuencia_acumulada, round(acum / total, 6) AS frecuencia_relativa_acumulada FROM c {cut}"""


@query("freq_table", _frequency_sql("part", "p_brand", "valor"))
def freq_table(spark, sf):
    return flat(frequencies.frequency_table(table(spark, sf, "part"), "p_brand"), 6)


SCALE = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH"]


@query("freq_table_ordinal", _frequency_sql(
    "orders", "o_orderpriority",
    "CASE valor WHEN '5-LOW' THEN 1 WHEN '4-NOT SPECIFIED' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '2-HIGH' THEN 4 ELSE 5 END, valor"))
def freq_table_ordinal(spark, sf):
    return flat(frequencies.frequency_table(table(spark, sf, "orders"), "o_orderpriority", 500, SCALE), 6)


@query("freq_table_numeric", _frequency_sql("lineitem", "l_quantity", "k"))
def freq_table_numeric(spark, sf):
    return flat(frequencies.frequency_table(table(spark, sf, "lineitem"), "l_quantity"), 6)


@query("freq_table_limit", _frequency_sql("part", "p_size", "k", 10))
def freq_table_limit(spark, sf):
    return flat(frequencies.frequency_table(table(spark, sf, "part"), "p_size", 10), 6)


def classes_sql(values, classes=None):
    """Equal classes per column: ``columna, clase, clases, limite_inferior, limite_superior, n, total``."""
    k = str(classes) if classes else "greatest(2, ceil(1 + 3.322 * log10(n)))::INT"
    return f"""WITH v AS ({values}),
s AS (SELECT columna, count(x) AS n, min(x) AS lo, max(x) AS hi FROM v GROUP BY columna),
k AS (SELECT *, {k} AS k FROM s),
w AS (SELECT *, (hi - lo) / k AS w FROM k),
c AS (SELECT columna, n, lo, hi, k, w, unnest(range(0, k)) AS i FROM w),
b AS (SELECT *, lo + i * w AS inferior, CASE WHEN i = k - 1 THEN hi ELSE lo + (i + 1) * w END AS superior FROM c),
g AS (SELECT b.columna, b.i, count(v.x) AS f FROM b LEFT JOIN v ON v.columna = b.columna AND v.x >= b.inferior
  AND (v.x < b.superior OR (b.i = b.k - 1 AND v.x <= b.superior)) GROUP BY b.columna, b.i)
SELECT b.columna, (b.i + 1)::BIGINT AS clase, b.k::BIGINT AS clases, round(b.inferior, 6) AS limite_inferior,
  round(b.superior, 6) AS limite_superior, round((b.inferior + b.superior) / 2, 6) AS marca_clase,
  g.f AS frecuencia_absoluta, round(g.f / b.n, 6) AS frecuencia_relativa,
  sum(g.f) OVER (PARTITION BY b.columna ORDER BY b.i)::BIGINT AS frecuencia_acumulada
FROM b JOIN g ON g.columna = b.columna AND g.i = b.i"""


CLASS_FIELDS = ["columna", "clase", "clases", "limite_inferior", "limite_superior", "marca_clase",
                "frecuencia_absoluta", "frecuencia_relativa", "frecuencia_acumulada"]


@query("freq_grouped_sturges", classes_sql(stacked("lineitem", ["l_quantity", "l_extendedprice", "l_discount"])))
def freq_grouped_sturges(spark, sf):
    g = frequencies.grouped_tables(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return flat(g.select(*CLASS_FIELDS), 6)


def _bundle_part(column, order):
    return f"""SELECT 'no_agrupada' AS tabla, '{column}' AS columna, orden, valor, frecuencia_absoluta, frecuencia_acumulada
  FROM ({_frequency_sql('orders', column, order, 500)})"""


@query("freq_bundle", f"""{_bundle_part('o_orderstatus', 'valor')} UNION ALL {_bundle_part('o_totalprice', 'k')}
UNION ALL SELECT 'agrupada', columna, clase, NULL, frecuencia_absoluta, frecuencia_acumulada
FROM ({classes_sql(stacked('orders', ['o_totalprice']))})""")
def freq_bundle(spark, sf):
    from varscope.operators.classify import classify

    orders = table(spark, sf, "orders").select("o_orderstatus", "o_totalprice")
    rows = classify(orders).select("columna", "tipo", "escala_orden").collect()
    single, grouped = frequencies.frequency_bundle(orders, [tuple(r) for r in rows])
    top = single.select(F.lit("no_agrupada").alias("tabla"), "columna", "orden", "valor",
                        "frecuencia_absoluta", "frecuencia_acumulada")
    low = grouped.select(F.lit("agrupada").alias("tabla"), "columna", F.col("clase").alias("orden"),
                         F.lit(None).cast("string").alias("valor"), "frecuencia_absoluta", "frecuencia_acumulada")
    return flat(top.unionByName(low))


TEXTS = stacked_text("part", ["p_name", "p_brand", "p_type", "p_size"])


@query("top_categories", f"""
WITH f AS (SELECT columna, valor, count(*) AS n FROM ({TEXTS}) GROUP BY ALL),
c AS (SELECT columna, valor, n, row_number() OVER w AS orden, (sum(n) OVER w)::BIGINT AS acum FROM f
  WINDOW w AS (PARTITION BY columna ORDER BY CASE WHEN columna = 'p_size' THEN valor::DOUBLE END, valor))
SELECT columna, orden, valor, n AS frecuencia_absoluta, acum AS frecuencia_acumulada FROM c WHERE orden <= 12""")
def top_categories_query(spark, sf):
    part = table(spark, sf, "part")
    counts = frequencies.value_counts(part)
    rows = top_categories(counts, column_profile(part, counts))
    return flat(rows.select("columna", "orden", "valor", "frecuencia_absoluta", "frecuencia_acumulada"))
