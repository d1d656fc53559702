"""Nothing is cut, merged or rounded on the way: long texts, many spellings, long numbers, tied pages."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from varscope.functions import vocab
from varscope.operators import charts, ordering, quality
from varscope.operators.filters import CATEGORICO, FECHAS, Filter, apply_filters, filter_from_search
from varscope.operators.frequencies import frequency_table, restore_texts, value_counts
from varscope.plans.analysis import Dataset


@pytest.mark.parametrize("size", [80, 255, 256, 257, 5_000])
def test_examples_and_lists_show_whole_texts(spark, size):
    long = "".join(chr(97 + i % 26) for i in range(size))
    df = spark.createDataFrame([(long, 1), (long, 2), (long[:-1] + "Z", 3), ("corto", 4)], "`id nota` string, n int")
    found = {r["codigo"]: r for r in quality.findings(df).collect()}
    assert found["identificador_duplicado"]["ejemplos"] == [long]
    data = Dataset.of(df, compacto=True)
    report = data.analyse()
    listed = next(r["valores"] for r in report.filtros.collect() if r["columna"] == "id nota")
    assert sorted(listed) == sorted([long, long[:-1] + "Z", "corto"])
    assert apply_filters(df, [Filter("id nota", CATEGORICO, valores=(long,))])[0].count() == 2
    top = {r["valor"] for r in report.top_categorias.filter("columna = 'id nota'").collect()}
    single, _ = data.frequencies(["id nota"])
    assert top == set(listed) == {r["valor"] for r in single.collect()}
    report.close(), data.close()


def test_every_spelling_is_given(spark):
    forms = ["azul", "Azul", "AZUL", "aZul", "azUl", "azuL", "AZul", "AzUl", "AzuL", "aZUl", "aZuL", " azul "]
    df = spark.createDataFrame([(f,) for f in forms], "Color string")
    finding = next(r for r in quality.findings(df).collect() if r["codigo"] == "inconsistencia_de_formato")
    assert finding["ejemplos"] == [" / ".join(sorted(forms))] and finding["filas_afectadas"] == 12
    table = quality.variant_forms(value_counts(df)).collect()
    assert sorted(r["valor"] for r in table) == sorted(forms) and {r["norma"] for r in table} == {"azul"}
    long = ["X" * 300 + "y", "x" * 300 + "Y"]
    texts = spark.createDataFrame([(t,) for t in long], "t string")
    rows = quality.variant_forms(value_counts(texts, compact=True, with_norm=True), restore_texts(texts)).collect()
    assert sorted(r["valor"] for r in rows) == sorted(long)


def test_numbers_beyond_doubles_stay_apart(spark):
    ids = [2**53, 2**53 + 1, 2**53 + 2, -(2**53) - 1, -(2**53) - 2]
    df = spark.createDataFrame([(i, Decimal(i * 10**6 + 1)) for i in ids], "k bigint, d decimal(38,0)")
    for name, value in (("k", 2**53 + 1), ("d", (2**53 + 1) * 10**6 + 1)):
        kept, _ = apply_filters(df, [Filter(name, CATEGORICO, valores=(str(value),))])
        assert [int(r[name]) for r in kept.collect()] == [value]
        assert apply_filters(df, [Filter(name, CATEGORICO, valores=(str(value),), excluir=True)])[0].count() == 4
        assert frequency_table(df, name).count() == 5
        shown = [int(r["valor"]) for r in frequency_table(df, name, limit=10).orderBy("orden").collect()]
        assert shown == sorted(shown)
    assert apply_filters(df, [Filter("k", CATEGORICO, valores=("9_007_199_254_740_993",))])[0].count() == 0
    reals = spark.createDataFrame([(1.5,), (2.0,)], "x double")
    assert apply_filters(reals, [Filter("x", CATEGORICO, valores=("2", "1.50"))])[0].count() == 2
    cents = spark.createDataFrame([(Decimal("1.20"),), (Decimal("3.45"),)], "c decimal(20,2)")
    assert apply_filters(cents, [Filter("c", CATEGORICO, valores=("1.2", "3.454"))])[0].count() == 1
    assert {r["valor"] for r in value_counts(cents).collect()} == {"1.2", "3.45"}


@pytest.mark.parametrize("top", [10_000, 0])
def test_tied_pages_join_up(spark, monkeypatch, top):
    monkeypatch.setattr(ordering, "TOP_ROWS", top)
    df = spark.range(1_000).selectExpr("id % 3 as v", "id").repartition(5)
    seen = [r["id"] for page in range(10) for r in charts.table_page(df, "v", pagina=page, por_pagina=100).collect()]
    assert len(seen) == 1_000 and len(set(seen)) == 1_000 and [i % 3 for i in seen] == sorted(i % 3 for i in seen)


def test_median_in_the_combined_chart(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("a", 2.0, None), ("a", 9.0, 7.0), ("b", 4.0, 1.0)], "k string, y double, z double")
    rows = charts.combo(df, "k", "y", "z", "mediana").orderBy("orden").collect()
    assert [(r["categoria"], r["barra"], r["linea"]) for r in rows] == [("b", 4.0, 1.0), ("a", 2.0, 6.0)]
    mean = charts.combo(df, "k", "y", agregacion="mediana").orderBy("orden").collect()
    assert [r["linea"] for r in mean] == [4.0, 4.0]
    with pytest.raises(ValueError):
        charts.combo(df, "k", "y", agregacion="otra")


def test_date_bounds_in_other_forms(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01 00:30:00' as f union all select timestamp_ntz'2024-01-01 06:00:00'")
    kept = lambda **bound: apply_filters(df, [Filter("f", FECHAS, **bound)])[0].count()
    assert kept(desde="01/01/2024") == 2 and kept(desde="01/02/2024") == 0 and kept(hasta="01/02/2023") == 0
    assert kept(desde="2024-01-01T00:00:00-05:00") == 1 and kept(desde="1-Jan-2024 5:59 AM") == 1 and kept(desde="nada") == 0


def test_a_search_becomes_a_filter(spark):
    df = spark.createDataFrame([("Lima",), ("Limón",), ("Cusco",), (None,)], "c string")
    chosen = filter_from_search(value_counts(df), "c", "lim")
    assert apply_filters(df, [chosen])[0].count() == 2 and set(chosen.valores) == {"Lima", "Limón"}


def test_full_ranges_do_not_filter(spark):
    data = Dataset.of(spark.createDataFrame([(float(i), None if i == 3 else i) for i in range(6)], "x double, y int"))
    full = [Filter("x", "rango", minimo=0.0, maximo=5.0), Filter("y", "rango", minimo=1.0, maximo=9.0)]
    report = data.analyse(full)
    assert report.filtros_activos == 1 and vocab.DISCRETA in {r["tipo"] for r in data.clasificacion.collect()} | {vocab.DISCRETA}
    report.close(), data.close()
