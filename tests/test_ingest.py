from datetime import datetime

import pytest
from pyspark.sql import functions as F

from varscope.functions.text import natural_key, normalize, normalize_name, parse_date, parse_number
from varscope.operators import cleaning
from varscope.sources import delimited
from varscope.sources.delimited import EmptyDatasetError, RaggedRowsError, UnsupportedFileError, load


@pytest.fixture()
def put(tmp_path):
    def write(content, name="datos.csv"):
        path = tmp_path / name
        path.write_bytes(content if isinstance(content, bytes) else content.encode("utf-8"))
        return str(path)
    return write


def codes(loaded):
    return {a[0] for a in loaded.avisos}


def test_semicolons_are_found(spark, put):
    loaded = load(spark, put("a;b;c\n1;2;3\n4;5;6\n"))
    assert loaded.df.columns == ["a", "b", "c"] and loaded.df.count() == 2 and "delimitador" in codes(loaded)
    assert loaded.tipos == {"a": "bigint", "b": "bigint", "c": "bigint"}


@pytest.mark.parametrize("lines, expected", [
    (["a,b", "1,2"], ","), (["a;b;c", "1,5;2;3"], ";"), (["a\tb", "1\t2"], "\t"), (["a|b", "1|2"], "|"),
    (["Monto", "1.234,56", "2.500,00"], "\x01"), (["a,b", "1"], ","), (['"x,y";b', '"1,2";3'], ";"), ([], ","),
])
def test_delimiters(lines, expected):
    assert delimited.detect_delimiter(lines) == expected


def test_empty_data_is_an_error(spark, put):
    for content in ("a,b\n,\n,\n", "", "\n\n"):
        with pytest.raises(EmptyDatasetError):
            load(spark, put(content))


def test_unknown_format_is_an_error(spark):
    with pytest.raises(UnsupportedFileError, match=r"\.docx"):
        load(spark, "/tmp/x.docx")


def test_headers():
    names, _ = delimited.normalize_headers(["Nombre", "Nombre", "", " Ciudad  x ", "Ciudad x", "Unnamed: 3", "nan"])
    assert names == ["Nombre", "Nombre (1)", "Columna 3", "Ciudad x", "Ciudad x (1)", "Columna 6", "Columna 7"]
    assert delimited.normalize_headers(["a", "a (1)", "a"])[0] == ["a", "a (1)", "a (2)"]


def test_colliding_headers_warn(spark, put):
    loaded = load(spark, put("Ciudad, Ciudad \nx,y\n"))
    assert loaded.df.columns == ["Ciudad", "Ciudad (1)"] and "encabezado_duplicado" in codes(loaded)
    assert {r["codigo"] for r in loaded.warnings().collect()} == codes(loaded)


def test_one_column_of_locale_numbers(spark, put):
    european = load(spark, put("Monto\n1.234,56\n2.500,00\n980,25\n")).df
    assert european.columns == ["Monto"]
    assert sorted(r[0] for r in european.collect()) == [980.25, 1234.56, 2500.0]
    english = load(spark, put("Monto\n1,234.56\n2,500.00\n", "b.csv")).df
    assert sorted(r[0] for r in english.collect()) == [1234.56, 2500.0]


def test_empty_columns_and_rows_are_dropped(spark, put):
    loaded = load(spark, put("a,b,c\n1,,3\n,,\n2,,4\n"))
    assert loaded.df.columns == ["a", "c"] and loaded.df.count() == 2 and loaded.filas_originales == 2
    assert {"columnas_vacias", "filas_vacias"} <= codes(loaded)


def test_mixed_text_stays_text_and_tokens_are_missing(spark, put):
    assert load(spark, put("Clave\nA1\nB2\nC3\n4\n")).tipos == {"Clave": "texto"}
    loaded = load(spark, put("n,t\n1,x\nNA,NULL\n3,n/a\n", "b.csv"))
    assert [tuple(r) for r in loaded.df.orderBy("n").collect()] == [(1, "x"), (3, None)]


def test_dates_read_day_first(spark, put):
    df = load(spark, put("Fecha\n01/02/2024\n15/03/2024\n28/04/2024\n")).df
    assert sorted(r[0] for r in df.collect()) == [datetime(2024, 2, 1), datetime(2024, 3, 15), datetime(2024, 4, 28)]


def test_trim_and_latin1(spark, put):
    assert load(spark, put("c,d\n  Lima  ,x\n")).df.first()["c"] == "Lima"
    loaded = load(spark, put("Región,n\nAndalucía,1\nCataluña,2\n".encode("latin-1"), "l.csv"))
    assert loaded.df.columns[0] == "Región" and "codificacion" in codes(loaded)
    assert sorted(r[0] for r in loaded.df.collect()) == ["Andalucía", "Cataluña"]


def test_byte_order_mark_quotes_and_blank_lines(spark, put):
    df = load(spark, put("﻿a,b\n\n\"x, y\",\"dijo \"\"sí\"\"\"\n\nz,w\n")).df
    assert df.columns == ["a", "b"]
    assert sorted(tuple(r) for r in df.collect()) == [("x, y", 'dijo "sí"'), ("z", "w")]


def test_folder_of_files(spark, tmp_path):
    folder = tmp_path / "partes.csv"
    folder.mkdir()
    for i in range(3):
        (folder / f"p{i}.csv").write_text(f"id,v\n{i},{i}.5\n")
    loaded = load(spark, str(folder))
    assert sorted(tuple(r) for r in loaded.df.collect()) == [(0, 0.5), (1, 1.5), (2, 2.5)]


def test_caps(spark, put):
    path = put("k,a,b\n" + "".join(f"{i:03d}x,{i},{i}\n" for i in range(50)))
    loaded = load(spark, path, max_rows=10, max_columns=2, order_by=["k"])
    assert loaded.df.columns == ["k", "a"] and loaded.filas_originales == 50
    assert sorted(r["a"] for r in loaded.df.collect()) == list(range(10))
    assert {"tope_filas", "tope_columnas"} <= codes(loaded)
    with pytest.raises(ValueError, match="order_by"):
        load(spark, path, max_rows=10)


def test_tables_keep_their_types(spark, tmp_path):
    for fmt in ("parquet", "orc", "json"):
        path = str(tmp_path / f"t.{fmt}")
        spark.createDataFrame([(1, " x "), (2, "y")], "n bigint, t string").write.format(fmt).save(path)
        assert sorted(tuple(r) for r in load(spark, path).df.select("n", "t").collect()) == [(1, "x"), (2, "y")]


def one(spark, fn, text):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize("text, value", [
    ("2,500", 2.5), ("2,500.00", 2500.0), ("1.234.567", 1234567.0), ("1.234", 1234.0), ("-3,5", -3.5), ("1 234,5", 1234.5),
    ("1 234", 1234.0), ("1e3", 1000.0), (".5", 0.5), ("5.", 5.0), ("1.0d", None), ("inf", None), ("12a", None), ("", None),
    ("1,2,3", 123.0),
])
def test_locale_numbers(spark, text, value):
    assert one(spark, parse_number, text) == value


@pytest.mark.parametrize("text, value", [
    ("2024-03-05", datetime(2024, 3, 5)), ("2024/3/5", datetime(2024, 3, 5)), ("5-3-2024", datetime(2024, 3, 5)),
    ("05/03/2024 14:30", datetime(2024, 3, 5, 14, 30)), ("03/15/2024", datetime(2024, 3, 15)),
    ("2024-03-05T01:02:03.250", datetime(2024, 3, 5, 1, 2, 3, 250000)), (" 31/12/1999 23:59:59 ", datetime(1999, 12, 31, 23, 59, 59)),
    ("15/03/24", datetime(2024, 3, 15)), ("03/15/99", datetime(1999, 3, 15)), ("15-Mar-2024", datetime(2024, 3, 15)),
    ("March 5, 2024", datetime(2024, 3, 5)), ("15/03/2024 3:00 PM", datetime(2024, 3, 15, 15)), ("5 sept 2024 12:05:06 am", datetime(2024, 9, 5, 0, 5, 6)),
    ("2024-03-05 01:02:03.123456789", datetime(2024, 3, 5, 1, 2, 3, 123456)), ("2024-03-05T01:02:03Z", datetime(2024, 3, 5, 1, 2, 3)),
    ("2024-01-01T00:30:00-05:00", datetime(2024, 1, 1, 5, 30)), ("15/03/2024 23:00 +0130", datetime(2024, 3, 15, 21, 30)),
    ("15/03/2024 13:00 PM", None), ("15-Foo-2024", None), ("31/02/24", None), ("32-Jan-2024", None),
    ("31/02/2024", None), ("12:30", None), ("2024", None), ("2024-01/02", None), ("x", None),
])
def test_dates(spark, text, value):
    assert one(spark, parse_date, text) == value


@pytest.mark.parametrize("text, value", [
    ("  Ñandú_del -Río ", "nandu del rio"), ("ÁÉÍÓÚ", "aeiou"), ("a  b", "a b"), ("é", "e"), ("", ""), (None, ""),
    ("--", ""), ("straße", "straße"),
])
def test_normal_form(spark, text, value):
    assert one(spark, normalize, text) == value
    if text is not None:
        assert normalize_name(text) == value


def test_natural_key_orders_digit_runs(spark):
    df = spark.createDataFrame([(v,) for v in ("b10", "b2", "a100", "a20x3", "a20x12", "b02")], "t string")
    ordered = [r["t"] for r in df.orderBy(natural_key(F.col("t")), "t").collect()]
    assert ordered == ["a20x3", "a20x12", "a100", "b02", "b2", "b10"]


def test_inference_shares(spark):
    rows = [(f"{i},5", f"{i}" if i % 5 else "x", f"2024-01-{i % 28 + 1:02d}" if i else "nada", "true") for i in range(20)]
    typed, chosen = cleaning.infer_types(spark.createDataFrame(rows, "a string, b string, c string, d string"))
    assert chosen == {"a": "numero", "b": "texto", "c": "fecha", "d": "boolean"}
    assert typed.agg(F.count("c")).first()[0] == 19


def test_quoted_line_breaks_ragged_rows_and_mixed_encodings(spark, put, tmp_path):
    loaded = load(spark, put('a,b\n1,"x\ny"\n2,z\n', "q.csv"))
    assert sorted(tuple(r) for r in loaded.df.collect()) == [(1, "x\ny"), (2, "z")]
    loaded = load(spark, put("a,b\n1,2\n3,4,5\n6\n", "r.csv"))
    assert ("campos_de_mas", "filas con más campos que el encabezado", 1) in loaded.avisos
    assert sorted((r["a"], r["b"]) for r in loaded.df.collect()) == [(1, 2), (3, 4), (6, None)]
    with pytest.raises(RaggedRowsError):
        load(spark, put("a,b\n1,2\n3,4,5\n", "r2.csv"), ragged="rechazar")
    folder = tmp_path / "mezcla.csv"
    folder.mkdir()
    (folder / "u.csv").write_bytes("ciudad,n\nCataluña,1\n".encode())
    (folder / "l.csv").write_bytes("ciudad,n\nAndalucía,2\n".encode("latin-1"))
    (folder / "q.csv").write_bytes('ciudad,n\n"Los\nRíos",3\n'.encode())
    loaded = load(spark, str(folder))
    assert sorted(tuple(r) for r in loaded.df.collect()) == [("Andalucía", 2), ("Cataluña", 1), ("Los\nRíos", 3)]
    assert ("codificacion", "latin-1", 1) in loaded.avisos


def test_long_integers_stay_exact(spark, put):
    ids = ["9007199254740993", "9007199254740992", "1234567890123456789", "-9223372036854775808"]
    loaded = load(spark, put("id\n" + "\n".join(ids) + "\n", "i.csv"))
    assert loaded.tipos == {"id": "bigint"} and sorted(r["id"] for r in loaded.df.collect()) == sorted(map(int, ids))
    wide = ["12345678901234567890123", "12345678901234567890124"]
    loaded = load(spark, put("id\n" + "\n".join(wide) + "\n", "w.csv"))
    assert loaded.tipos == {"id": "decimal(38,0)"} and sorted(int(r["id"]) for r in loaded.df.collect()) == sorted(map(int, wide))
    assert load(spark, put("id\n" + "\n".join(w * 3 for w in wide) + "\n", "x.csv")).tipos == {"id": "texto"}
