import json

import pytest

from varscope.functions import vocab
from varscope.operators import profile
from varscope.operators.duplicates import duplicate_rows
from varscope.operators.filters import CATEGORICO, Filter
from varscope.operators.frequencies import value_counts
from varscope.plans.analysis import Dataset, analyse, reopen
from varscope.sources.catalog import Catalog


def by_column(df):
    return {r["columna"]: r for r in df.collect()}


def test_column_reports(spark, mixed):
    p = by_column(profile.column_profile(mixed))
    assert p["Temperatura Media"]["es_numerica"] and p["Temperatura Media"]["unicos"] == 15 and p["Temperatura Media"]["clave"] == "col4"
    assert not p["Parque"]["es_graficable_y"] and p["Parque"]["unicos"] == 3
    gaps = spark.createDataFrame([("a", 1.0), (None, float("nan")), ("a", None)], "t string, x double")
    g = by_column(profile.column_profile(gaps))
    assert (g["t"]["nulos"], g["t"]["porcentaje_nulos"], g["x"]["nulos"], g["x"]["unicos"]) == (1, 33.33, 2, 1)


def test_samples(spark):
    df = spark.createDataFrame([(3, "b"), (1, None), (2, "a"), (4, "b")], "k int, v string")
    assert by_column(profile.samples(value_counts(df, ["v"])))["v"]["muestra"] == ["a", "b"]
    assert by_column(profile.ordered_samples(df, ["k"], ["v"]))["v"]["muestra"] == ["a", "b", "b"]


def test_duplicates_treat_missing_values_as_equal(spark):
    long = "x" * 5000
    rows = [(None, 1.0, long), (None, 1.0, long), (None, 1.0, long + "y"), ("a", float("nan"), None),
            ("a", float("nan"), None), ("a", None, None), (None, None, None), ("b", -0.0, "t"), ("b", 0.0, "t")]
    df = spark.createDataFrame(rows, "s string, d double, t string")
    assert duplicate_rows(df).first()[0] == 3
    assert duplicate_rows(df.limit(0)).first()[0] == 0


def test_global_summary_and_metadata(spark, mixed):
    s = profile.global_summary(mixed, profile.column_profile(mixed)).first()
    assert (s["filas"], s["columnas"], s["numericas"], s["nominales"], s["ordinales"], s["discretas"], s["continuas"]) == (
        15, 5, 2, 2, 1, 1, 1)
    assert s["completitud"] == 100.0 and s["filas_duplicadas"] == 0
    m = profile.dataset_metadata(mixed, preview_rows=10).first()
    assert (m["filas"], m["columnas"], m["celdas_vacias"], m["vista_recortada"]) == (15, 5, 0, True)


def test_filter_controls(spark, mixed):
    o = by_column(profile.filter_options(mixed))
    assert o["Nivel de Ruido"]["valores"] == ["Leve", "Moderado", "Grave"]
    assert o["Parque"]["tipo_control"] == "categorico" and o["Parque"]["valores"] == ["Cumbre", "Olivar", "Ribera"]
    assert (o["Cantidad de Lecturas"]["tipo_control"], o["Cantidad de Lecturas"]["paso"]) == ("rango", 1.0)
    assert o["Temperatura Media"]["minimo"] == 11.25 and o["Temperatura Media"]["paso"] == pytest.approx(0.2038)
    many = spark.range(300).selectExpr("concat('v', id % 250) as t", "timestamp_ntz'2024-01-01' as f")
    m = by_column(profile.filter_options(many))
    assert m["t"]["tipo_control"] == "texto" and m["t"]["valores_truncados"] and len(m["t"]["valores"]) == 200
    assert set(m["t"]["valores"][:50]) == {f"v{i}" for i in range(50)} and m["f"]["tipo_control"] == "fecha"


def test_preview(spark):
    df = spark.sql("select 2 as k, double('NaN') as x, timestamp_ntz'2024-01-02 03:04:05.5' as f union all "
                   "select 1, 1.23456789D, timestamp_ntz'2024-01-02'")
    rows = [json.loads(r["fila"]) for r in profile.row_preview(df, 5, ["k"], as_json=True).collect()]
    assert rows == [{"k": 1, "x": 1.234568, "f": "2024-01-02T00:00:00"}, {"k": 2, "x": None, "f": "2024-01-02T03:04:05.500000"}]


def test_full_analysis(mixed):
    a = analyse(mixed)
    assert a.columnas.count() == 5 and a.resumen_numerico.count() == 2 and a.correlacion.count() == 4
    top = [r["valor"] for r in a.top_categorias.filter("columna = 'Parque'").orderBy("orden").collect()]
    assert top == ["Cumbre", "Olivar", "Ribera"]
    assert a.top_categorias.filter("columna = 'Temperatura Media'").count() == 0


def test_analysis_without_numbers_or_rows(spark):
    a = analyse(spark.createDataFrame([("a",), ("b",)], "t string"))
    assert a.resumen_numerico is None and a.correlacion.count() == 0 and a.columnas.count() == 1
    e = analyse(spark.createDataFrame([], "t string, x double"))
    assert {r["tipo"] for r in e.columnas.collect()} == {vocab.NOMINAL} and e.resumen.first()["filas"] == 0
    assert e.resumen_numerico.count() == 0 and e.resumen.first()["completitud"] == 100.0


def test_filters_never_reclassify(mixed):
    data = Dataset.of(mixed)
    a = data.analyse([Filter("Parque", CATEGORICO, valores=("Olivar",)), Filter("Parque", CATEGORICO)])
    rows = by_column(a.columnas)
    assert a.filtros_activos == 1 and rows["Parque"]["total"] == 6 and rows["Parque"]["unicos"] == 1
    assert rows["Nivel de Ruido"]["tipo"] == vocab.ORDINAL
    single, grouped = data.frequencies(["Nivel de Ruido", "Temperatura Media"])
    levels = [r["valor"] for r in single.filter("columna like 'Nivel%'").orderBy("orden").collect()]
    assert levels == ["Leve", "Moderado", "Grave"] and {r["columna"] for r in grouped.collect()} == {"Temperatura Media"}
    data.close()


def test_export_and_reports(spark, mixed, tmp_path):
    data = Dataset.of(mixed)
    data.export(str(tmp_path / "lima"), [Filter("Parque", CATEGORICO, valores=("Ribera",))])
    assert spark.read.option("header", True).csv(str(tmp_path / "lima")).count() == 6
    data.export_report(str(tmp_path / "informe"))
    read = lambda name: spark.read.parquet(str(tmp_path / "informe" / name))
    assert len(read("clasificacion").columns) == 9 and read("clasificacion").count() == 5
    stats = {r["Columna"]: r for r in read("estadistica").collect()}
    assert len(read("estadistica").columns) == 18 and stats["Temperatura Media"]["Moda"] == "Sin moda"
    assert stats["Cantidad de Lecturas"]["Moda"] == "1.0"
    assert read("frecuencias").count() == 15 + 3 + 3 + 7 + 15 and read("datos").count() == 15
    data.close()


def test_history(spark, mixed, tmp_path):
    source = str(tmp_path / "fuente.parquet")
    mixed.write.parquet(source)
    catalog = Catalog(spark, str(tmp_path / "historial"), per_client=3, max_bytes=100)
    assert catalog.list("ana").count() == 0 and not catalog.delete("ana", "x") and catalog.clear("ana") == 0
    data = Dataset.open(spark, source)
    keys = [data.save(catalog, "ana", source, f"f{i}", 10) for i in range(4)]
    other = data.save(catalog, "luis", source, "g", 10)
    assert data.save(catalog, "ana", source, "grande", 101) is None
    entries = catalog.list("ana").collect()
    assert [e["nombre_archivo"] for e in entries] == ["f3", "f2", "f1"]
    assert entries[0]["filas"] == 15 and entries[0]["resumen_tipos"][vocab.NOMINAL] == 2
    assert catalog.fetch("luis", keys[3]) is None and catalog.fetch("ana", keys[3])["ruta"] == source
    again = reopen(spark, catalog, "ana", keys[3])
    assert again.df.count() == 15 and catalog.list("ana").count() == 3
    assert reopen(spark, catalog, "luis", keys[3]) is None
    assert not catalog.delete("luis", keys[3]) and catalog.delete("ana", keys[3])
    assert catalog.clear("ana") >= 2 and catalog.list("ana").count() == 0
    assert [e["id"] for e in catalog.list("luis").collect()] == [other]
    data.close(), again.close()


def test_history_reads_one_client_only(spark, mixed, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "h"))
    catalog.save("ana", "r", "f", 1, 1, {})
    catalog.save("luis", "r", "f", 1, 1, {})
    plan = catalog.list("ana")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cliente" in plan and "= ana" in plan


def test_retention_and_deletion_are_for_good(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "h"), per_client=3)
    keys = [catalog.save("ana", "r", f"f{i}", 1, 1, {}) for i in range(5)]
    catalog.save("luis", "r", "g", 1, 1, {})
    names = lambda: [r["nombre_archivo"] for r in catalog.list("ana").collect()]
    assert names() == ["f4", "f3", "f2"] and catalog.fetch("ana", keys[1]) is None
    assert catalog.delete("ana", keys[4]) and names() == ["f3", "f2"]
    before = catalog.entries().select("cliente", "id", "orden").orderBy("cliente", "orden").collect()
    catalog.compact()
    assert catalog.entries().select("cliente", "id", "orden").orderBy("cliente", "orden").collect() == before
    assert spark.read.parquet(catalog.added).count() == 3 and names() == ["f3", "f2"]
    catalog.save("ana", "r", "f5", 1, 1, {})
    assert names() == ["f5", "f3", "f2"]
