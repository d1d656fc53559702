import pytest
from pyspark.sql import functions as F

from varscope.operators import charts, cleaning, ordering, quantiles


@pytest.mark.parametrize("top", [10_000, 0])
@pytest.mark.parametrize("up", [True, False])
def test_slices_match_sorting(spark, monkeypatch, top, up):
    monkeypatch.setattr(ordering, "TOP_ROWS", top)
    rows = [((i * 37) % 101 if i % 9 else None, i) for i in range(400)]
    df = spark.createDataFrame(rows, "v int, i int").repartition(3)
    want = sorted(rows, key=lambda r: (r[0] is None, 0 if r[0] is None else (r[0] if up else -r[0]), r[1]))
    for page in (0, 3, 7, 99):
        got = charts.table_page(df, "v", up, page, 50, ["i"]).collect()
        assert [tuple(r) for r in got] == want[page * 50:page * 50 + 50]
    assert sorted(r["i"] for r in cleaning.cap_rows(df, 120, ["i"]).collect()) == list(range(120))


def test_text_pages_deep_inside(spark, monkeypatch):
    monkeypatch.setattr(ordering, "TOP_ROWS", 0)
    df = spark.createDataFrame([("b2",), ("b10",), (None,), ("á1",), ("B1",)], "t string")
    assert [r["t"] for r in charts.table_page(df, "t", pagina=0, por_pagina=3).collect()] == ["á1", "B1", "b2"]


def test_quantiles_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SMALL_GROUP", 5)
    df = spark.range(200).select(F.struct((F.col("id") % 2).alias("a"), F.lit("z").alias("b")).alias("par"),
                                 F.col("id").cast("double").alias("x"))
    got = {r["par"]["a"]: r["valor"] for r in quantiles.quantiles(df, [0.5], "par", 5).collect()}
    assert got == {0: 99.0, 1: 100.0}
