"""Registry of queries and shared table helpers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the same result in DuckDB's dialect."""
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def documents_with_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the labels some of them have: the source of missing values."""
    return table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left").select(
        "doc_id", "lang", "source", "n_chars", "quality", "toxic")


DOC_LABELS = """(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def flat(df: DataFrame, places: int = 4) -> DataFrame:
    """Whole numbers as bigint, decimals rounded, lists as one text: values both engines can hash."""
    cells = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.IntegralType):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), places)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, "|")
        cells.append(c.alias(f.name))
    return df.select(*cells)


def stacked(source: str, columns: Sequence[str]) -> str:
    """SQL rows ``columna, x`` of several numeric columns."""
    return " UNION ALL ".join(f"SELECT '{c}' AS columna, {c}::DOUBLE AS x FROM {source}" for c in columns)


def stacked_text(source: str, columns: Sequence[str]) -> str:
    """SQL rows ``columna, valor`` of several columns as text."""
    return " UNION ALL ".join(f"SELECT '{c}' AS columna, CAST({c} AS VARCHAR) AS valor FROM {source}" for c in columns)


def normal(expr: str) -> str:
    """DuckDB form of the text normal form."""
    return (f"trim(regexp_replace(strip_accents(lower(coalesce({expr}, ''))), "
            f"'[\\s_\\-\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{3000}}]+', ' ', 'g'))")
