import pytest
from pyspark.sql import functions as F

from varscope.operators import charts, grouping
from varscope.operators.profile import column_profile


@pytest.fixture(scope="module")
def rows(spark):
    data = [("A", "x", 10.0), ("A", "y", 20.0), ("B", "x", 5.0), ("B", "y", 15.0), ("B", "y", 25.0), (None, "x", None)]
    return spark.createDataFrame(data, "cat string, sub string, valor double")


def pairs(df):
    return [(r["categoria"], r["valor"]) for r in df.orderBy("orden").collect()]


def test_sum_and_order(rows):
    assert pairs(grouping.aggregate(rows, "cat", "valor")) == [("B", 45.0), ("A", 30.0)]


def test_rows_are_counted_without_a_measure(rows):
    assert dict(pairs(grouping.aggregate(rows, "cat"))) == {"A": 2.0, "B": 3.0, "(vacío)": 1.0}


@pytest.mark.parametrize("agregacion, a, b", [
    ("promedio", 15, 15), ("conteo", 2, 3), ("mediana", 15, 15), ("minimo", 10, 5), ("maximo", 20, 25)])
def test_aggregates(rows, agregacion, a, b):
    assert dict(pairs(grouping.aggregate(rows, "cat", "valor", agregacion))) == {"A": a, "B": b}


def test_unknown_aggregate(rows):
    with pytest.raises(ValueError):
        grouping.aggregate(rows, "cat", "valor", "moda")


def test_scale_and_sequence_order(spark):
    levels = spark.createDataFrame([("Alto", 1.0), ("Bajo", 5.0), ("Medio", 3.0)], "n string, v double")
    assert [c for c, _ in pairs(grouping.aggregate(levels, "n", "v", scale=["Bajo", "Medio", "Alto"]))] == ["Bajo", "Medio", "Alto"]
    months = spark.createDataFrame([("2024-03", 1.0), ("2024-01", 2.0), ("2024-02", 3.0)], "mes string, v double")
    assert [c for c, _ in pairs(charts.line(months, "mes", "v"))] == ["2024-01", "2024-02", "2024-03"]
    numbers = spark.createDataFrame([(10,), (9,), (100,)], "k int")
    assert [c for c, _ in pairs(charts.line(numbers, "k"))] == ["9", "10", "100"]


def test_truncation(spark):
    many = spark.range(40).select(F.concat(F.lit("c"), "id").alias("cat"), F.col("id").cast("double").alias("v"))
    top = grouping.aggregate(many, "cat", "v", limit=10).collect()
    assert len(top) == 10 and top[0]["truncado"] and top[0]["total_categorias"] == 40
    assert grouping.aggregate(many, "cat", "v", limit=None).count() == 40


def cells(df):
    return {(r["categoria"], r["serie"]): r["valor"] for r in df.collect()}


def test_crosstab_fills_with_zero_within_limits(spark, rows):
    assert cells(grouping.crosstab(rows, "cat", "sub", "valor"))[("B", "y")] == 40.0
    gaps = spark.createDataFrame([("A", "x", 1.0), ("B", "y", 2.0)], "c string, s string, v double")
    filled = cells(grouping.crosstab(gaps, "c", "s", "v", limit_x=10, limit_series=10))
    assert filled == {("A", "x"): 1.0, ("A", "y"): 0.0, ("B", "x"): 0.0, ("B", "y"): 2.0}
    assert cells(grouping.crosstab(gaps, "c", "s", "v")) == {("A", "x"): 1.0, ("B", "y"): 2.0}
    medians = cells(grouping.crosstab(rows, "cat", "sub", "valor", "mediana"))
    assert medians[("B", "y")] == 20.0


@pytest.mark.parametrize("n", [999, 1_000, 1_001, 1_002])
def test_crosstab_means_the_same_at_any_number_of_series(spark, n):
    df = spark.range(n).selectExpr("id % 2 as c", "id as s")
    assert grouping.crosstab(df, "c", "s").count() == n
    assert grouping.crosstab(df, "c", "s", limit_x=2, limit_series=2_000).count() == 2 * n


def test_stacked_shares(rows):
    share = cells(charts.stacked(rows, "cat", "sub", "valor", normalizar=True))
    assert share[("A", "x")] == pytest.approx(100 / 3) and share[("B", "y")] == pytest.approx(800 / 9)
    with pytest.raises(ValueError):
        charts.stacked(rows, "cat", "cat")


def test_pie(spark):
    df = spark.range(1, 14).select(F.concat(F.lit("c"), "id").alias("c"), F.col("id").cast("double").alias("v"))
    slices = charts.pie(df, "c", "v").orderBy("orden").collect()
    assert len(slices) == 11 and (slices[-1]["categoria"], slices[-1]["valor"]) == ("Otros", 6.0)
    assert sum(r["valor"] for r in slices) == sum(range(1, 14))
    assert charts.pie(df.filter("v <= 3"), "c", "v").count() == 3
    with pytest.raises(ValueError, match="negativos"):
        charts.pie(df.withColumn("v", -F.col("v")), "c", "v")


def test_histogram(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 11)], "v double")
    assert charts.histogram_chart(df, "v", 5).count() == 5
    constant = spark.createDataFrame([(7.0,)] * 3, "v double")
    assert [r["frecuencia_absoluta"] for r in charts.histogram_chart(constant, "v").collect()] == [3]
    with pytest.raises(ValueError):
        charts.histogram_chart(df, "v", 50)


def test_pairs_and_regression(spark):
    df = spark.createDataFrame([(1.0, 5.0), (None, 3.0), (4.0, None), (2.0, 8.0), (3.0, 11.0)], "x double, y double")
    assert charts.numeric_pairs(df, "x", "y").count() == 3
    fit = charts.regression(df, "x", "y").first()
    assert (fit["pendiente"], fit["intercepto"]) == (pytest.approx(3), pytest.approx(2))
    assert (fit["r2"], fit["r"], fit["n"]) == (pytest.approx(1), pytest.approx(1), 3)
    assert charts.regression(df.filter("x = 1"), "x", "y").count() == 0
    flat = spark.createDataFrame([(2.0, 1.0), (2.0, 5.0)], "x double, y double")
    assert charts.regression(flat, "x", "y").count() == 0
    constant_y = spark.createDataFrame([(1.0, 4.2), (2.0, 4.2)], "x double, y double")
    assert charts.regression(constant_y, "x", "y").first()["r"] is None


def test_scatter_keeps_the_ten_largest_groups(spark):
    df = spark.range(300).selectExpr("concat('g', cast(sqrt(id) as int)) as g", "cast(id as double) as x", "1.0D as y")
    shown = {r["grupo"] for r in charts.scatter(df, "x", "y", "g").select("grupo").distinct().collect()}
    assert shown == {f"g{i}" for i in range(7, 17)}


def test_radar_needs_three_axes(rows):
    assert charts.radar(rows, "cat", "valor").count() == 0 and charts.radar(rows, "cat").count() == 3


def test_combo(spark):
    df = spark.createDataFrame([("a", 1.0, -4.0), ("a", 3.0, 2.0), ("b", 10.0, 6.0)], "k string, y double, z double")
    two = charts.combo(df, "k", "y", "z").orderBy("orden").collect()
    assert [(r["categoria"], r["barra"], r["linea"]) for r in two] == [("b", 10.0, 6.0), ("a", 4.0, -2.0)]
    assert (two[0]["eje_min"], two[0]["eje_max"]) == (pytest.approx(-2.64), pytest.approx(6.64))
    mean = charts.combo(df, "k", "y").orderBy("orden").collect()
    assert [r["linea"] for r in mean] == [10.0, 2.0]
    empty = charts.combo(df.withColumn("z", F.lit(None).cast("double")), "k", "y", "z").orderBy("orden").collect()
    assert [r["linea"] for r in empty] == [10.0, 2.0]


def test_boxes(spark):
    df = spark.createDataFrame([("g", float(v)) for v in (1, 2, 3, 4, 100)] + [("h", 5.0), (None, 6.0)], "g string, v double")
    box = {r["grupo"]: r for r in charts.box(df, "v", "g").collect()}
    assert (box["g"]["q1"], box["g"]["mediana"], box["g"]["q3"], box["g"]["bigote_sup"], box["g"]["atipicos"]) == (2, 3, 4, 4, 1)
    assert set(box) == {"g", "h", "(vacío)"}
    assert [tuple(r) for r in charts.box_outliers(df, "v", "g").collect()] == [("g", 100.0)]
    assert charts.box(df, "v").first()["n"] == 7


def test_kpis(spark, rows):
    k = charts.kpis(rows, "valor", 12).first()
    assert (k["filas"], k["proporcion"], k["suma"], k["promedio"]) == (6, 50.0, 75.0, 15.0)
    assert k["completitud"] == pytest.approx(16 / 18 * 100)
    assert charts.kpis(rows.filter("false")).first()["completitud"] == 100.0


def test_axis_recommendation(mixed):
    scores = charts.axis_scores(column_profile(mixed))
    points = {r["columna"]: (r["puntos_categoria"], r["puntos_medida"]) for r in scores.collect()}
    assert points["ID Sensor"] == (-50.0, -100.0) and points["Temperatura Media"][1] == 100.0
    assert points["Parque"][0] == 97.0 and points["Cantidad de Lecturas"] == (93.0, 80.0)
    assert charts.recommend_axes(scores) == {"x": "Parque", "y": "Temperatura Media", "serie": "Nivel de Ruido"}
    kept = charts.recommend_axes(scores, selection={"x": "Nivel de Ruido", "y": "", "serie": "no existe"})
    assert kept == {"x": "Nivel de Ruido", "y": "", "serie": ""}


def test_table_pages(spark):
    df = spark.createDataFrame([("b2", 1), ("b10", 2), (None, 3), ("á1", 4), ("", 5), ("B1", 6)], "t string, i int")
    up = [r["i"] for r in charts.table_page(df, "t", desempate=["i"]).collect()]
    assert up == [4, 6, 1, 2, 3, 5]
    down = [r["i"] for r in charts.table_page(df, "t", False, desempate=["i"]).collect()]
    assert down == [2, 1, 6, 4, 3, 5]
    assert [r["i"] for r in charts.table_page(df, "i", pagina=1, por_pagina=4).collect()] == [5, 6]


def test_every_chart_on_an_empty_table(rows):
    empty = rows.filter("false")
    for df in (
        charts.bar(empty, "cat", "valor"), charts.pie(empty, "cat", "valor"), charts.histogram_chart(empty, "valor"),
        charts.line(empty, "cat", "valor"), charts.scatter(empty, "valor", "valor", "cat"), charts.radar(empty, "cat"),
        charts.stacked(empty, "cat", "sub", "valor", normalizar=True), charts.combo(empty, "cat", "valor"),
        charts.box(empty, "valor", "cat"), charts.heatmap_cross(empty, "cat", "sub"),
    ):
        assert df.count() == 0
