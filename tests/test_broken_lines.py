import csv
import io
import random

import pytest

from varscope.sources import broken_lines, delimited


def rows_of(rng, count):
    words = ["plain", 'say ""no""', "two\nlines", "\n", "a\n\nb", "comma, inside", "", "é ñ", "end\r\nof", "tab\t", '""', "long " * 30]
    return [[f"k{n}", rng.choice(words), rng.choice(words)] for n in range(count)]


def written(path, rows, end="\n", encoding="utf-8", quoting=csv.QUOTE_ALL):
    out = io.StringIO()
    plain = [[c.replace('""', '"') for c in row] for row in rows]
    csv.writer(out, lineterminator=end, quoting=quoting).writerows([["key", "a", "b"], *plain])
    path.write_bytes(out.getvalue().encode(encoding))
    return plain


@pytest.fixture
def small_splits(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set(key, before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("end, encoding", [("\n", "utf-8"), ("\r\n", "utf-8"), ("\n", "latin-1")])
def test_many_tasks_read_what_one_task_reads(spark, small_splits, tmp_path, end, encoding):
    rng = random.Random(4)
    expected = []
    for name in ("a.csv", "b.csv"):
        expected += written(tmp_path / name, rows_of(rng, 150), end, encoding)
    df, warnings = delimited.scan_delimited(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() > 10
    keep = lambda c: None if c in delimited.cleaning.NA_TOKENS else c
    # Two signs at a line end inside quotes stay, as does every other sign.
    assert sorted(str(tuple(r)) for r in df.collect()) == sorted(str(tuple(keep(c) for c in row)) for row in expected)
    one, _ = delimited.scan_delimited(spark, str(tmp_path), multiline=True, encoding=None if encoding == "utf-8" else "ISO-8859-1")
    # One task turns line ends of two signs inside quotes into one; apart from that both read the same.
    plain = lambda frame: sorted(str(tuple(c and c.replace("\r\n", "\n") for c in r)) for r in frame.collect())
    assert plain(one) == plain(df)
    assert ("codificacion" in {w[0] for w in warnings}) == (encoding == "latin-1")


def test_a_field_over_many_splits(spark, small_splits, tmp_path):
    long = "\n".join(f"line {n}" for n in range(1_000))
    rows = [["k1", "x", "y"], ["k2", long, "z"], ["k3", "u", long], ["k4", "v", "w"]]
    written(tmp_path / "t.csv", rows)
    df, _ = delimited.scan_delimited(spark, str(tmp_path / "t.csv"))
    assert sorted(list(r) for r in df.collect()) == rows


def test_a_header_over_two_lines_and_short_rows(spark, small_splits, tmp_path):
    (tmp_path / "t.csv").write_text('"ke\ny",a,b\n1,"x\ny",3\n\n2\n3,"p\nq"\n')
    df, _ = delimited.scan_delimited(spark, str(tmp_path / "t.csv"), delimiter=",")
    rows = broken_lines.parse_rows(broken_lines.joined_rows(spark, [str(tmp_path / "t.csv")], "UTF-8"), spark.createDataFrame(
        [], "c0 string, c1 string, c2 string").schema, ",")
    assert sorted(map(str, (tuple(r) for r in rows.collect()))) == sorted(map(str, [
        ("1", "x\ny", "3", True), ("2", None, None, True), ("3", "p\nq", None, True)]))


def test_quotes_that_do_not_tell_rows_apart(spark, small_splits, tmp_path):
    """A stray quote makes the parity wrong; the file is then read in one task, which loses nothing."""
    lines = ["key,a,b"] + [f"k{n},pipe of 5\" wide,z" if n == 7 else f"k{n},x,z" for n in range(60)]
    (tmp_path / "t.csv").write_text("\n".join(lines) + "\n")
    df, _ = delimited.scan_delimited(spark, str(tmp_path / "t.csv"))
    assert sorted(r["key"] for r in df.collect()) == sorted(f"k{n}" for n in range(60))


def test_rows_with_more_fields_are_still_counted(spark, tmp_path):
    (tmp_path / "t.csv").write_text('key,a\n1,"x\ny"\n2,p,extra\n')
    df, warnings = delimited.scan_delimited(spark, str(tmp_path / "t.csv"))
    assert ("campos_de_mas", "filas con más campos que el encabezado", 1) in warnings and df.count() == 2
