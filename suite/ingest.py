"""Reading delimited text: tables are rendered as files and read back whole."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from suite.registry import flat, query, table
from varscope.operators import cleaning
from varscope.operators.filters import CATEGORICO, RANGO, Filter, apply_filters
from varscope.operators.frequencies import value_counts
from varscope.sources import delimited, sinks

BIG = 2**53
NA_SQL = "(" + ", ".join(f"'{t}'" for t in delimited.cleaning.NA_TOKENS) + ")"


def scratch(spark, name):
    """A new folder on shared storage; a temporary one where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="varscope-suite-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}.csv"


def rendered(df, name, **options):
    path = scratch(df.sparkSession, name)
    plain = {"header": True, "escape": '"', "quote": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.options(**(plain | options)).csv(path)
    return path


@query("csv_round_trip", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS TIMESTAMP)::VARCHAR AS o_orderdate, o_orderpriority FROM orders")
def csv_round_trip(spark, sf):
    names = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    orders = table(spark, sf, "orders").select(*names).withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    df = delimited.load(spark, rendered(orders, "orders")).df
    return df.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).select(
        F.col("o_orderkey").cast("bigint"), F.col("o_custkey").cast("bigint"), "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@query("csv_delimiters", """
SELECT d AS delimitador, count(*) AS filas, sum(p_size)::BIGINT AS suma FROM part, (VALUES ('coma'), ('punto y coma'), ('tabulación'), ('barra vertical')) t(d)
GROUP BY d""")
def csv_delimiters(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    found = []
    for sep in delimited.DELIMITERS:
        df, warnings = delimited.scan_delimited(spark, rendered(part, "part", sep=sep))
        name = next((w[1] for w in warnings if w[0] == "delimitador"), "coma")
        found.append(df.agg(F.lit(name).alias("delimitador"), F.count("*").alias("filas"), F.sum(F.col("p_size").cast("bigint")).alias("suma")))
    return flat(found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3]))


@query("csv_documents", f"SELECT doc_id, CASE WHEN text NOT IN {NA_SQL} THEN sha256(text) END AS texto, lang FROM documents")
def csv_documents(spark, sf):
    """Texts with quotes, line breaks and letters outside ASCII come back whole."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    df, _ = delimited.scan_delimited(spark, rendered(docs, "documents", quoteAll=True))
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.sha2("text", 256).alias("texto"), "lang")


LATIN_SQL = "regexp_full_match(text, '[\\x{0}-\\x{7e}\\x{a1}-\\x{ff}]*')"


@query("csv_encodings", f"""
SELECT doc_id, sha256(text) AS texto, 1::BIGINT AS avisos FROM documents WHERE {LATIN_SQL} AND text NOT IN {NA_SQL}""")
def csv_encodings(spark, sf):
    """Half of the files in UTF-8 and half in Latin-1, read side by side."""
    docs = table(spark, sf, "documents").select("doc_id", "text").filter(
        F.col("text").rlike(r"^[\x00-\x7e\xa1-\xff]*$") & ~F.col("text").isin(list(delimited.cleaning.NA_TOKENS)))
    base = scratch(spark, "mixed")
    for encoding, rest in ((delimited.UTF8, 0), (delimited.LATIN1, 1)):
        docs.filter(F.col("doc_id") % 2 == rest).write.mode("append").options(
            header=True, quoteAll=True, escape='"', encoding=encoding, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(base)
    df, warnings = delimited.scan_delimited(spark, base)
    told = sum(w[0] == "codificacion" for w in warnings)
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.sha2("text", 256).alias("texto"), F.lit(told).cast("bigint").alias("avisos"))


@query("csv_warnings", """
SELECT 'campos_de_mas' AS codigo, count(*) AS n FROM orders WHERE o_orderkey % 10 = 0
UNION ALL SELECT 'columnas_vacias', 1 UNION ALL SELECT 'encabezado_automatico', 1 UNION ALL SELECT 'encabezado_duplicado', 1""")
def csv_warnings(spark, sf):
    """Lines with a field too many, an empty column, a header without a name and one that repeats."""
    lines = table(spark, sf, "orders").select(F.concat_ws(
        ",", "o_orderkey", F.lit(""), "o_orderstatus", "o_custkey", F.when(F.col("o_orderkey") % 10 == 0, F.lit("resto"))).alias("value"))
    path = scratch(spark, "lines")
    # Lines as they are, every file with the header line of its own.
    lines.toDF("clave,nada,clave,").write.options(header=True, sep="\x01", quote="\x00", escapeQuotes=False).csv(path)
    return flat(delimited.load(spark, path).warnings().select("codigo", "n"))


@query("csv_missing_tokens", """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS c_name, c_acctbal FROM customer""")
def csv_missing_tokens(spark, sf):
    tokens = F.array(*[F.lit(t) for t in ("NA", "n/a", "NULL", "nan")])
    name = F.when(F.col("c_custkey") % 3 == 0, F.element_at(tokens, (F.col("c_custkey") % 4 + 1).cast("int"))).otherwise(F.col("c_name"))
    df = delimited.load(spark, rendered(table(spark, sf, "customer").select("c_custkey", name.alias("c_name"), "c_acctbal"), "customer")).df
    return flat(df, 2)


@query("export_round_trip", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_discount >= 0.05")
def export_round_trip(spark, sf):
    visible, _ = apply_filters(table(spark, sf, "lineitem"), [Filter("l_discount", RANGO, minimo=0.05)])
    path = scratch(spark, "export")
    sinks.write_parquet(visible, path)
    return flat(spark.read.parquet(path).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"))


@query("filter_big_ids", f"SELECT o_orderkey + {BIG} AS id FROM orders WHERE o_orderkey IN (1, 3, 5, 7, 33)")
def filter_big_ids(spark, sf):
    ids = table(spark, sf, "orders").select((F.col("o_orderkey") + F.lit(BIG)).alias("id"))
    return apply_filters(ids, [Filter("id", CATEGORICO, valores=tuple(str(BIG + k) for k in (1, 3, 5, 7, 33)))])[0]


WIDE_SQL = "'12345678901234567' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0')"


@query("infer_long_integers", f"SELECT o_orderkey + {BIG} AS id, {WIDE_SQL} AS ancho FROM orders")
def infer_long_integers(spark, sf):
    text = table(spark, sf, "orders").select(
        (F.col("o_orderkey") + F.lit(BIG)).cast("string").alias("id"),
        F.concat(F.lit("12345678901234567"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("ancho"))
    typed, _ = cleaning.infer_types(text)
    return typed.select(F.col("id"), F.col("ancho").cast("string").alias("ancho"))


@query("count_big_ids", f"""
SELECT 'id' AS columna, CAST(o_orderkey + {BIG} AS VARCHAR) AS valor, count(*) AS n FROM orders GROUP BY ALL
UNION ALL SELECT 'ancho', {WIDE_SQL}, count(*) FROM orders GROUP BY ALL""")
def count_big_ids(spark, sf):
    ids = table(spark, sf, "orders").select(
        (F.col("o_orderkey") + F.lit(BIG)).alias("id"),
        F.concat(F.lit("12345678901234567"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).cast("decimal(38,0)").alias("ancho"))
    return value_counts(ids).select("columna", "valor", "n")
