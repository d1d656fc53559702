import math
import random

import pandas as pd
import pytest

from varscope.functions.columns import numeric_long
from varscope.operators import describe, frequencies, quantiles
from varscope.operators.correlation import correlation


def summary(spark, values):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")
    rows = describe.numeric_summary(df).collect()
    return rows[0] if rows else None


def test_known_series(spark):
    s = summary(spark, [2, 4, 4, 4, 5, 5, 7, 9])
    assert (s["conteo"], s["media"], s["mediana"], s["moda"], s["rango"], s["suma"]) == (8, 5.0, 4.5, [4.0], 7.0, 40.0)
    assert s["desviacion_estandar"] == pytest.approx(2.13809, abs=1e-5)
    assert (s["q1"], s["q2"], s["q3"], s["iqr"]) == (4.0, 4.5, 5.5, 1.5)
    assert s["deciles"]["d5"] == 4.5 and s["deciles"]["d10"] == 9.0 and s["percentiles"]["p50"] == 4.5
    assert s["asimetria"] == pytest.approx(0.818488, abs=1e-5) and s["curtosis"] == pytest.approx(0.940625, abs=1e-5)
    assert s["atipicos"] == 1


def test_modes(spark):
    assert summary(spark, [1, 1, 2, 2, 3])["moda"] == [1.0, 2.0]
    assert summary(spark, [1, 2, 3, 4])["moda"] == []
    assert summary(spark, [v for v in range(20) for _ in range(2)])["moda"] == [float(v) for v in range(10)]


def test_missing_values_and_edges(spark):
    s = summary(spark, [1, None, 3, float("nan"), float("inf")])
    assert (s["conteo"], s["media"]) == (2, 2.0)
    assert summary(spark, [None, None]) is None
    assert summary(spark, [-2, 2])["coeficiente_variacion"] is None
    one = summary(spark, [7])
    assert (one["desviacion_estandar"], one["asimetria"], one["curtosis"], one["atipicos"]) == (0.0, None, None, 0)
    constant = summary(spark, [5.1] * 6)
    assert (constant["desviacion_estandar"], constant["asimetria"], constant["curtosis"]) == (0.0, 0.0, 0.0)


def brute(values, p):
    values = sorted(values)
    h = (len(values) - 1) * p
    low, high = values[math.floor(h)], values[math.ceil(h)]
    return low + (high - low) * (h - math.floor(h))


@pytest.mark.parametrize("small, bins", [(10**9, 1024), (40, 1024), (40, 4)])
def test_quantiles_match_sorting_on_skewed_groups(spark, monkeypatch, small, bins):
    """One group holds most rows; values repeat, are heavy-tailed or constant."""
    monkeypatch.setattr(quantiles, "BINS", bins)
    monkeypatch.setattr(quantiles, "SMALL_GROUP", min(small, 40))
    rng = random.Random(5)
    groups = {
        "hot": [round(math.exp(rng.gauss(0, 4)), 3) for _ in range(1500)], "flat": [3.5] * 300,
        "ties": [float(rng.randint(0, 3)) for _ in range(400)], "few": [1.0, 2.0, 10.0],
        "wide": [-1.7e308, 1.7e308, 5e-324, 1e-323, 0.0] * 20 + [float(i) for i in range(30)], "neg": [-rng.random() * 1e9 for _ in range(90)],
    }
    rows = [(g, v) for g, values in groups.items() for v in values]
    long = spark.createDataFrame(rows, "grupo string, x double").repartition(4)
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = {(r["grupo"], r["prob"]): r["valor"] for r in quantiles.quantiles(long, probs, "grupo", small).collect()}
    assert len(got) == len(groups) * len(probs)
    for (group, p), value in got.items():
        want = brute(groups[group], p)
        assert value == want or value == pytest.approx(want, rel=1e-12, abs=1e-12)


def test_more_large_groups_than_are_narrowed_together(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "MAX_LARGE_GROUPS", 3)
    rows = [(g, float(v * g)) for g in range(1, 9) for v in range(50 + g)]
    long = spark.createDataFrame(rows, "grupo int, x double")
    got = {r["grupo"]: r["valor"] for r in quantiles.quantiles(long, [0.5], "grupo", 20).collect()}
    assert got == {g: brute([float(v * g) for v in range(50 + g)], 0.5) for g in range(1, 9)}


def table(df):
    return [tuple(r) for r in df.orderBy("orden").select(
        "valor", "frecuencia_absoluta", "frecuencia_relativa", "frecuencia_acumulada", "frecuencia_relativa_acumulada").collect()]


def test_ungrouped_table(spark):
    df = spark.createDataFrame([(v,) for v in "abaca"] + [(None,)], "v string")
    expected = [("a", 3, 0.6, 3, 0.6), ("b", 1, 0.2, 4, 0.8), ("c", 1, 0.2, 5, 1.0)]
    assert table(frequencies.frequency_table(df, "v")) == expected
    assert table(frequencies.frequency_table(df, "v", 2)) == expected[:2]


def test_scale_order_keeps_spelling(spark):
    df = spark.createDataFrame([(v,) for v in ("MUY ALTO", "bajo", "Medio", "Alto", "Muy bajo", "otro")], "v string")
    scale = ["muy bajo", "bajo", "medio", "alto", "muy alto"]
    expected = ["Muy bajo", "bajo", "Medio", "Alto", "MUY ALTO", "otro"]
    for limit in (None, 500):
        assert [r[0] for r in table(frequencies.frequency_table(df, "v", limit, scale))] == expected


def test_numbers_sort_as_numbers(spark):
    df = spark.createDataFrame([(v,) for v in (10.0, 2.0, 1.5, 1e7, 12345678.25, 0.0005, -3.0)], "v double")
    assert [r[0] for r in table(frequencies.frequency_table(df, "v"))] == [
        "-3.0", "0.0005", "1.5", "2.0", "10.0", "10000000.0", "12345678.25"]


def test_unlimited_running_totals_match_limited_ones(spark):
    df = spark.range(5000).selectExpr("id % 700 as a", "cast(id % 13 as string) as b")
    counts = frequencies.value_counts(df)
    part = {tuple(r) for r in frequencies.frequency_tables(counts, None).collect()}
    whole = {tuple(r) for r in frequencies.frequency_tables(counts, 10_000).collect()}
    assert part == whole and len(part) == 713


def test_grouped_table(spark):
    df = spark.createDataFrame([(float(v),) for v in range(100)], "v double")
    rows = frequencies.grouped_tables(df, ["v"]).orderBy("clase").collect()
    assert len(rows) == 8 and sum(r["frecuencia_absoluta"] for r in rows) == 100
    assert rows[-1]["frecuencia_relativa_acumulada"] == 1.0 and rows[-1]["limite_superior"] == 99.0
    assert rows[0]["intervalo"] == "[0.00 - 12.38)"
    constant = spark.createDataFrame([(5.0,)] * 3, "v double")
    assert frequencies.grouped_tables(constant, ["v"]).count() == 0


def test_class_edges_follow_the_bounds(spark):
    """Every value lands in the class whose bounds contain it, also on inexact edges."""
    values = [0.1 * i for i in range(31)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (3, 6, 7, 10):
        rows = frequencies.histogram(df, frequencies.class_bounds(df, ["v"], k)).orderBy("clase").collect()
        low, width = min(values), (max(values) - min(values)) / k
        want = []
        for i in range(k):
            a, b = low + i * width, low + (i + 1) * width
            want.append(sum(a <= v < b or (i == k - 1 and a <= v) for v in values))
        assert [r["frecuencia_absoluta"] for r in rows] == want


def test_correlation(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 9.0, 4.2, 1.0), (2.0, 4.0, 3.0, 4.2, None), (3.0, 6.0, 5.0, 4.2, 3.0), (4.0, 8.0, 1.0, 4.2, float("nan"))],
        "a double, b double, c double, k double, n double")
    r = {(x["col_x"], x["col_y"]): x["r"] for x in correlation(df).collect()}
    assert r[("a", "a")] == 1.0 and r[("a", "b")] == 1.0 and r[("a", "n")] == 1.0
    assert r[("a", "c")] == r[("c", "a")] == pytest.approx(-0.831522, abs=1e-5)
    assert r[("k", "k")] is None and r[("a", "k")] is None and r[("n", "k")] is None
    assert r[("c", "n")] == -1.0
    assert correlation(df.select("a")).count() == 0


def test_long_frame_drops_what_is_not_a_number(spark):
    df = spark.createDataFrame([("1 000",), ("texto",), (None,), ("3.5",), ("1.0d",)], "v string")
    assert sorted(r["x"] for r in numeric_long(df, ["v"]).collect()) == [3.5, 1000.0]


def test_correlation_scans_do_not_grow_with_the_columns(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 60))
    x[:, 1] = x[:, 0] * 2 + rng.normal(size=300) * 0.1
    x[rng.random(x.shape) < 0.1] = np.nan
    df = spark.createDataFrame([tuple(None if v != v else float(v) for v in row) for row in x], ", ".join(f"c{i} double" for i in range(60)))
    table = correlation(df.repartition(5))
    got = {(r["col_x"], r["col_y"]): r["r"] for r in table.collect()}
    want = pd.DataFrame(x, columns=[f"c{i}" for i in range(60)]).corr()
    assert len(got) == 3_600 and all(got[a, b] == pytest.approx(want.loc[a, b], abs=1e-6) for a, b in got)
    assert table._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan")[0].count("MapInPandas") == 1


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan ")


def test_exact_quantiles_of_large_columns_take_two_scans(spark, monkeypatch, tmp_path):
    """One scan sketches all columns, one ranks the values inside the brackets; neither depends on the values."""
    monkeypatch.setattr(quantiles, "SMALL_GROUP", 1_000)
    rng = random.Random(6)
    values = [(rng.gauss(0, 1) ** 5, float(rng.randint(0, 9)), math.exp(rng.gauss(0, 6))) for _ in range(40_000)]
    spark.createDataFrame(values, "a double, b double, c double").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    jobs = []
    collect = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: (jobs.append(scans(self)), collect(self))[1])
    monkeypatch.setattr(quantiles, "_by_narrowing", lambda *_: pytest.fail("no bracket may miss its rank"))
    probs = [0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0]
    got = {(r["columna"], r["prob"]): r["valor"] for r in quantiles.quantiles(numeric_long(df, ["a", "b", "c"]), probs, small_group=1_000, few=True).collect()}
    assert [n for n in jobs if n] == [1, 1]
    for i, name in enumerate("abc"):
        for p in probs:
            assert got[name, p] == pytest.approx(brute([v[i] for v in values], p), rel=1e-12)


def test_brackets_that_miss_or_hold_too_much_are_narrowed(spark, monkeypatch):
    """Sketches so coarse that ranks are missed, and brackets with more rows than a task may order."""
    rng = random.Random(7)
    values = [rng.expovariate(1) ** 3 for _ in range(3_000)]
    long = spark.createDataFrame([("g", v) for v in values], "columna string, x double").repartition(5)
    for setting in ({"INSIDE_ROWS": 1}, {"SKETCH_ACCURACY": 3}):
        with monkeypatch.context() as patch:
            patch.setattr(quantiles, "SMALL_GROUP", 50)
            for name, value in setting.items():
                patch.setattr(quantiles, name, value)
            got = {r["prob"]: r["valor"] for r in quantiles.quantiles(long, [0.1, 0.5, 0.99], small_group=50, few=True).collect()}
        assert got == {p: pytest.approx(brute(values, p), rel=1e-12) for p in (0.1, 0.5, 0.99)}


@pytest.mark.parametrize("shape", ["normal", "ties", "sorted"])
def test_approximate_quantiles_keep_their_error(spark, monkeypatch, shape):
    monkeypatch.setattr(quantiles, "SKETCH_ACCURACY", 200)
    rng = random.Random(8)
    values = {"normal": [rng.gauss(0, 1) for _ in range(60_000)], "ties": [float(rng.randint(0, 50)) for _ in range(60_000)],
              "sorted": [float(n) for n in range(60_000)]}[shape]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(7)
    rows = quantiles.quantiles(numeric_long(df, ["x"]), [0.01, 0.25, 0.5, 0.9], mode="approx")
    for r in rows.collect():
        low, high = sum(v < r["valor"] for v in values), sum(v <= r["valor"] for v in values)
        assert low - 300 <= r["prob"] * len(values) <= high + 300
        assert r["valor"] in values
    with pytest.raises(ValueError, match="mode"):
        quantiles.quantiles(df, [0.5], mode="about")


def test_approximate_summary_is_close_to_the_exact_one(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(rng.gauss(10, 2),) for _ in range(20_000)], "x double")
    exact, close = describe.numeric_summary(df).first(), describe.numeric_summary(df, mode="approx").first()
    assert (exact["conteo"], exact["media"]) == (close["conteo"], close["media"])
    for name in ("mediana", "q1", "q3"):
        assert close[name] == pytest.approx(exact[name], abs=0.01)
    assert abs(close["atipicos"] - exact["atipicos"]) <= 10
