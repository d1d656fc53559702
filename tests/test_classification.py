import pytest

from varscope.functions import vocab
from varscope.operators import classify
from varscope.operators.frequencies import value_counts


def verdict(df):
    return {r["columna"]: r for r in classify.classify(df).collect()}


def column(spark, name, values, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"`{name}` {kind}")
    r = verdict(df)[name]
    return r["tipo"], r["rol"], r["confianza"], r["escala_orden"]


def test_mixed_table(mixed):
    v = verdict(mixed)
    assert {c: v[c]["tipo"] for c in v} == {
        "ID Sensor": vocab.NOMINAL, "Parque": vocab.NOMINAL, "Nivel de Ruido": vocab.ORDINAL,
        "Cantidad de Lecturas": vocab.DISCRETA, "Temperatura Media": vocab.CONTINUA}
    assert v["ID Sensor"]["rol"] == vocab.IDENTIFICADOR
    assert v["Nivel de Ruido"]["escala_orden"] == ["leve", "moderado", "grave"]


@pytest.mark.parametrize("name, values, kind, expected", [
    ("vacía", [None, None], "string", (vocab.NOMINAL, vocab.CATEGORIA, 0.2, None)),
    ("activo", [True, False, None], "boolean", (vocab.NOMINAL, vocab.BOOLEANO, 0.98, None)),
    ("codigo", [10, 20, 30], "bigint", (vocab.NOMINAL, vocab.IDENTIFICADOR, 0.88, None)),
    ("Grado", [3, 1, 2, 2], "bigint", (vocab.ORDINAL, vocab.CATEGORIA, 0.82, ["1", "2", "3"])),
    ("marca", [0, 1, 1], "bigint", (vocab.NOMINAL, vocab.BOOLEANO, 0.85, None)),
    ("x", [1.5, 2.0], "double", (vocab.CONTINUA, vocab.MEDIDA, 0.9, None)),
    ("Precio", [1.5, 2.0], "double", (vocab.CONTINUA, vocab.MEDIDA, 0.95, None)),
    ("Número de hijos", [1, 2, 7], "bigint", (vocab.DISCRETA, vocab.CONTEO, 0.93, None)),
    ("Peso", [60, 71, 82], "bigint", (vocab.CONTINUA, vocab.MEDIDA, 0.72, None)),
    ("x", [1, 2, 7], "bigint", (vocab.DISCRETA, vocab.CONTEO, 0.85, None)),
    ("x", list(range(40)), "bigint", (vocab.NOMINAL, vocab.IDENTIFICADOR, 0.6, None)),
    ("x", [i // 2 for i in range(80)], "bigint", (vocab.DISCRETA, vocab.CONTEO, 0.7, None)),
    ("opinion", ["Sí", "no", "SI"], "string", (vocab.NOMINAL, vocab.BOOLEANO, 0.9, None)),
    ("x", [f"v{i}" for i in range(30)], "string", (vocab.NOMINAL, vocab.IDENTIFICADOR, 0.8, None)),
    ("Prioridad", ["p1", "p3", "p2"], "string", (vocab.ORDINAL, vocab.CATEGORIA, 0.6, ["p1", "p2", "p3"])),
    ("notas", [f"un comentario bastante largo sobre el servicio {i}" for i in range(9)], "string",
     (vocab.NOMINAL, vocab.TEXTO_LIBRE, 0.65, None)),
    ("color", ["rojo", "azul", "rojo"], "string", (vocab.NOMINAL, vocab.CATEGORIA, 0.88, None)),
    ("talla", ["XL", "s", "M"], "string", (vocab.ORDINAL, vocab.CATEGORIA, 0.94, ["s", "m", "xl"])),
])
def test_rules(spark, name, values, kind, expected):
    assert column(spark, name, values, kind) == expected


def test_dates(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01' as Fecha")
    r = verdict(df)["Fecha"]
    assert (r["tipo"], r["rol"]) == (vocab.ORDINAL, vocab.TEMPORAL)


def test_unknown_label_breaks_a_scale(spark):
    assert column(spark, "x", ["bajo", "medio", "alto", "raro"])[1] == vocab.CATEGORIA
    assert column(spark, "x", ["bajo", "medio"])[3] is None


def test_whole_numbers_with_tolerance(spark):
    df = spark.createDataFrame([(1.0000000001, 1.5, None), (2.0, 2.0, None)], "a double, b double, c double")
    assert {r["columna"]: r["entera"] for r in classify.integrality(df).collect()} == {"a": True, "b": False, "c": True}


def test_blank_labels_count_as_boolean(spark):
    df = spark.createDataFrame([("--",), (" _ ",)], "v string")
    assert classify.boolean_labels(value_counts(df)).first()["booleana"] is True


def test_hints_match_words_or_phrases(spark):
    df = spark.createDataFrame([], "`ID_Pedido` int, Humedad int, `Talla en cm` int, Idioma int")
    got = {(r["columna"], r["grupo"]): r["pista"] for r in classify.header_hints(classify.header_table(df)).collect()}
    assert got == {("ID_Pedido", "identificador"): "id", ("Humedad", "continua"): "humedad",
                   ("Talla en cm", "ordinal"): "talla", ("Talla en cm", "continua"): "talla en"}


def test_measures_and_near_unique_columns_are_not_counted_by_value(spark):
    df = spark.range(3_000).selectExpr(
        "id AS codigo", "id * 0.37 AS precio", "id * 7 AS numero", "concat('text ', id) AS nota", "id % 5 AS grado",
        "IF(id % 2 = 0, 'si', 'no') AS activo", "CAST(NULL AS DOUBLE) AS vacio", "id % 700 AS lote", "id + 0.5 AS id_fraccion")
    names = df.columns
    _, counted, known = classify.counting_gate(df, names)
    assert "precio" not in counted and set(counted) == set(names) - {"precio"} and not known
    _, counted, known = classify.counting_gate(df, names, estimated=True)
    assert set(counted) == {"grado", "activo", "vacio"} and set(known) == {"codigo", "numero", "nota", "lote", "id_fraccion"}
    fields = ("columna", "tipo", "rol", "confianza", "escala_orden")
    whole = [[r[f] for f in fields] for r in classify.decide(classify.column_metrics(df)).collect()]
    for estimated in (False, True):
        assert sorted([r[f] for f in fields] for r in classify.classify(df, estimated=estimated).collect()) == sorted(whole)


def test_estimates_near_a_threshold_are_counted(spark):
    # 95 % and 90 % and 60 % of the values are distinct: an estimate cannot tell on which side a rule falls.
    df = spark.range(10_000).selectExpr("id % 9500 AS a", "concat('x', id % 9000) AS b", "concat('y', id % 6000) AS c", "id % 31 AS d")
    assert classify.counting_gate(df, df.columns, estimated=True)[1] == ["a", "b", "c", "d"]
