import pytest
from pyspark.sql import functions as F

from varscope.functions import vocab
from varscope.functions.vocab import Catalogue
from varscope.operators import quality
from varscope.operators.classify import header_table


def found(df, **rules):
    return {(r["codigo"], r["columna"]): r for r in quality.findings(df, **rules).collect()}


def test_catalogue_and_suggestions(spark):
    df = spark.createDataFrame([("Norte",), ("Sur",), ("Nrte",), ("Atlántida",), ("Nrte",)], "`Región` string")
    f = found(df)[("valor_fuera_de_catalogo", "Región")]
    assert f["filas_afectadas"] == 3 and f["ejemplos"] == ["Nrte → norte", "Atlántida"]


@pytest.mark.parametrize("value, expected", [("nrte", "norte"), ("zz", None), ("", None), ("SÚR", "sur"), ("limq", "lima")])
def test_suggestion(spark, value, expected):
    df = spark.createDataFrame([(value,)], "v string")
    got = df.select(quality.suggestion(F.col("v"), vocab.CATALOGUES[0].values).alias("s")).first()["s"]
    assert got == expected


def test_ranges(spark):
    df = spark.createDataFrame([(20.0,), (22.5,), (950.0,), (-300.0,), (float("nan"),)], "`Temperatura Media` double")
    f = found(df)[("valor_fuera_de_rango", "Temperatura Media")]
    assert (f["severidad"], f["filas_afectadas"], f["ejemplos"]) == ("critico", 2, ["-300", "950"])


def test_binding_is_by_substring(spark):
    df = spark.createDataFrame([], "Humedad double, Ciudad string, `Estado civil` string")
    bound = {(r["columna"], r["clase_regla"], r["regla"]) for r in quality.rule_binding(header_table(df)).collect()}
    assert bound == {("Humedad", "rango", 1), ("Humedad", "rango", 3), ("Estado civil", "catalogo", 0)}


def test_duplicate_identifiers(spark):
    df = spark.createDataFrame([("A-1",), ("A-2",), ("A-1",), ("A-3",)], "`ID Pedido` string")
    f = found(df)[("identificador_duplicado", "ID Pedido")]
    assert (f["filas_afectadas"], f["severidad"], f["ejemplos"]) == (1, "critico", ["A-1"])
    assert quality.identifier_columns(["Idioma", "Código", "Mi clave", "clave x"]) == ["Idioma", "Código", "clave x"]


def test_spelling_variants(spark):
    df = spark.createDataFrame([("Lima",), ("lima",), (" LIMA ",), ("Cusco",)], "Ciudad string")
    f = found(df)[("inconsistencia_de_formato", "Ciudad")]
    assert f["filas_afectadas"] == 3 and f["ejemplos"] == [" LIMA  / Lima / lima"]


def test_nulls_and_duplicates(spark):
    df = spark.createDataFrame([("x" if i < 2 else None, i) for i in range(10)], "`Observación` string, i int")
    assert found(df)[("exceso_de_nulos", "Observación")]["filas_afectadas"] == 8
    twice = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "a int, b string")
    assert found(twice)[("filas_duplicadas", None)]["filas_afectadas"] == 1


def test_extreme_outliers(spark):
    rows = [(float(i % 10),) for i in range(200)] + [(500.0,)]
    f = found(spark.createDataFrame(rows, "v double"))[("atipicos_extremos", "v")]
    assert (f["severidad"], f["filas_afectadas"], f["ejemplos"]) == ("info", 1, ["500"])
    assert ("atipicos_extremos", "v") not in found(spark.createDataFrame([(5.1,)] * 50, "v double"))
    assert ("atipicos_extremos", "v") not in found(spark.createDataFrame([(1.0,)] * 9 + [(1e9,)], "v double"))


def test_scores(spark):
    clean = spark.createDataFrame([(r, 100.0 + i) for i, r in enumerate(["Norte", "Sur", "Centro"] * 5)], "`Región` string, `Monto Total` double")
    dirty = spark.createDataFrame([("Marte", 999.0)] * 10, "`Región` string, Temperatura double")
    good = quality.score(quality.findings(clean), 15).first()[0]
    bad = quality.score(quality.findings(dirty), 10).first()[0]
    assert good == 100.0 and bad == pytest.approx(100 - 12 - 5 - 5 * (0.4 + 0.6 * 0.9))
    assert quality.score(quality.findings(dirty), 0).first()[0] == 0.0


def test_empty_table(spark):
    df = spark.createDataFrame([], "`Región` string, Temperatura double")
    assert quality.findings(df).count() == 0


def test_order_and_sources(spark):
    df = spark.createDataFrame([("Marte", 999.0)] * 10, "`Región` string, Temperatura double")
    severities = [r["severidad"] for r in quality.sorted_findings(quality.findings(df)).collect()]
    assert severities == sorted(severities, key=vocab.SEVERITY_ORDER.index)
    states = {r["url"]: (r["registros"], r["estado"]) for r in quality.sources(df).collect()}
    assert len(states) == 7 and states["https://referencia.clima.org/rangos"] == (6, "consultada")
    assert states["https://referencia.datos.gob/regiones"] == (20, "consultada")


def test_numbers_are_checked_against_a_catalogue_as_text(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "zona int")
    rule = Catalogue("Zonas", "u", ("zona",), ("1", "2"))
    assert found(df, catalogues=[rule])[("valor_fuera_de_catalogo", "zona")]["ejemplos"] == ["3 → 1"]


def test_long_texts_are_compared_whole(spark):
    body = "Palabra " * 60
    texts = [body + "uno", (body + "UNO").upper(), body + "dos", body + "dos", "corto", "  Corto"]
    df = spark.createDataFrame([(t,) for t in texts], "`id texto` string")
    f = found(df)
    assert f[("inconsistencia_de_formato", "id texto")]["filas_afectadas"] == 4
    assert f[("identificador_duplicado", "id texto")]["filas_afectadas"] == 1
    assert f[("filas_duplicadas", None)]["filas_afectadas"] == 1


def test_compact_counts_match_whole_ones(spark):
    from varscope.operators.frequencies import value_counts

    blanks = "alto" + " " * 300
    df = spark.createDataFrame([("a" * 300 + str(i % 3),) for i in range(10)] + [(blanks,), ("x",)], "t string")
    whole, compact = (value_counts(df, compact=c) for c in (False, True))
    assert sorted(r["n"] for r in whole.collect()) == sorted(r["n"] for r in compact.collect()) == [1, 1, 3, 3, 4]
    assert compact.filter(F.col("valor") == blanks).count() == 1
