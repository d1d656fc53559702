"""Cleaning and type inference of loaded tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from varscope.functions.columns import PLAIN_NUMBER, TEXTO, kinds, quoted, ref
from varscope.functions.text import (
    DATE_MARK, DAY_FIRST, ODD_DATES, WHITE_SPACE, YEAR_FIRST, blank_to_null, common_date, in_common_shape, odd_date, parse_date,
    parse_number, reads_as_number,
)
from varscope.functions.vocab import NA_TOKENS
from varscope.operators.ordering import ordered_slice

# --- Fixed values: shares of a column's cells from which it reads as numbers or dates
NUMBER_SHARE = 0.9
DATE_MARK_SHARE = 0.6
DATE_SHARE = 0.9
WHOLE_NUMBER = r"^[+-]?\d+$"
# Digits that the widest exact type holds.
LONG_NUMBER = r"^[+-]?0*\d{1,38}$"


def text_columns(df: DataFrame) -> list[str]:
    return [name for name, kind in kinds(df).items() if kind == TEXTO]


def emptiness(df: DataFrame) -> tuple[int, int, list[str]]:
    """Rows, rows with at least one value, and columns without any: one scan, one row."""
    real = {name for name, kind in df.dtypes if kind in ("double", "float")}
    cells = [f"nanvl({quoted(c)}, NULL)" if c in real else quoted(c) for c in df.columns]
    some = " OR ".join(f"{cell} IS NOT NULL" for cell in cells)
    row = df.agg(F.expr("count(*) AS filas"), F.expr(f"count_if({some}) AS llenas"),
                 *[F.expr(f"count({cell}) AS n{i}") for i, cell in enumerate(cells)]).first()
    return row["filas"], row["llenas"], [c for i, c in enumerate(df.columns) if row[f"n{i}"] == 0]


def drop_empty_columns(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The table without columns that hold no value at all, and their names."""
    empty = emptiness(df)[2]
    return df.drop(*[ref(c) for c in empty]), empty


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Rows that hold a value in at least one column."""
    return df.na.drop(how="all")


def trim_text(df: DataFrame) -> DataFrame:
    """Text cells without outer whitespace; blank cells become null."""
    texts = text_columns(df)
    return df.withColumns({c: blank_to_null(ref(c)) for c in texts}) if texts else df


def missing_tokens_to_null(df: DataFrame, tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """Text cells equal to a missing-value token become null."""
    texts = text_columns(df)
    return df.withColumns({c: F.when(~ref(c).isin(list(tokens)), ref(c)) for c in texts}) if texts else df


def _text_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columna, v``: the cells of text columns that hold a value."""
    return df.selectExpr(*[f"CAST({quoted(c)} AS STRING) AS {quoted(c)}" for c in columns]).unpivot(
        [], [quoted(c) for c in columns], "columna", "v").filter("v IS NOT NULL")


def inference_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``columna, n`` and how many values read as each type, one row per text column, one scan.

    ``fechas`` counts dates of the common shapes; ``raras`` counts cells of no common shape that have a digit, among
    which dates of less common shapes can be (:func:`odd_date_counts`).
    """
    columns = text_columns(df) if columns is None else list(columns)
    v = F.col("v")
    # What several tests ask for is a column first, so that no expression is repeated in the ones that follow.
    cells = _text_cells(df, columns).select(
        "columna", "v", v.rlike(WHOLE_NUMBER).alias("_w"), v.rlike(YEAR_FIRST).alias("_y"), v.rlike(DAY_FIRST).alias("_d"),
        F.translate(v, WHITE_SPACE, "").alias("_p"))
    whole, year, day = F.col("_w"), F.col("_y"), F.col("_d")
    tests = {
        "digitos": whole, "enteros": whole & v.try_cast("bigint").isNotNull(), "largos": v.rlike(LONG_NUMBER),
        "decimales": v.rlike(PLAIN_NUMBER), "booleanos": F.lower(v).isin("true", "false"), "numeros": reads_as_number(F.col("_p")),
        "marcas": v.rlike(DATE_MARK), "fechas": common_date(v, year, day).isNotNull(), "raras": ~(year | day) & v.rlike(r"\d"),
    }
    # Cells are counted by the tests they pass, one number, so that one short aggregate serves all tests.
    passed = sum((F.when(test, 1 << i).otherwise(0) for i, test in enumerate(tests.values())), F.lit(0))
    counted = cells.select("columna", passed.alias("_m")).groupBy("columna", "_m").agg(F.count("*").alias("_n"))
    return counted.groupBy("columna").agg(F.sum("_n").alias("n"), *[
        F.sum(F.when(F.col("_m").bitwiseAND(1 << i) > 0, F.col("_n")).otherwise(0)).alias(name) for i, name in enumerate(tests)])


def odd_date_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columna, forma, n``: dates of each less common shape among the cells of no common one."""
    v = F.col("v")
    cells = _text_cells(df, columns).filter(~in_common_shape(v) & v.rlike(r"\d"))
    shapes = F.array(*[F.when(odd_date(v, shape).isNotNull(), shape) for shape in ODD_DATES])
    return cells.select("columna", F.explode(F.array_compact(shapes)).alias("forma")).groupBy("columna", "forma").agg(
        F.count("*").alias("n"))


def _could_be_dates(row) -> bool:
    return row["marcas"] / row["n"] >= DATE_MARK_SHARE and (row["fechas"] + row["raras"]) / row["n"] >= DATE_SHARE


def decide_type(row) -> str:
    """Type of a text column from its counts.

    First what a reader sees when every cell agrees, then the 90 % rules for mixed columns.
    """
    n = row["n"]
    if n == 0:
        return "texto"
    if row["enteros"] == n:
        return "bigint"
    if row["largos"] == n:
        return "decimal(38,0)"
    if row["digitos"] == n:
        return "texto"  # longer than any exact number: a double would merge different codes
    if row["decimales"] == n:
        return "double"
    if row["booleanos"] == n:
        return "boolean"
    if row["numeros"] / n >= NUMBER_SHARE:
        return "numero"
    if row["marcas"] / n >= DATE_MARK_SHARE and row["fechas"] / n >= DATE_SHARE:
        return "fecha"
    return "texto"


def convert(text: Column, target: str, odd: Sequence[int] = ODD_DATES) -> Column:
    """A text column read as the chosen type; cells that do not fit become null."""
    if target in ("bigint", "decimal(38,0)", "double", "boolean"):
        return text.try_cast(target)
    if target == "numero":
        return parse_number(text)
    if target == "fecha":
        return parse_date(text, odd)
    return text


def infer_types(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """The table with text columns converted where their content allows, and the chosen types.

    The only thing that reaches the driver is one row of counts per text column. Less common shapes of dates are looked
    for in a second scan, of the columns in which they can decide or occur, and only those found are read.
    """
    columns = text_columns(df) if columns is None else list(columns)
    if not columns:
        return df, {}
    rows = {r["columna"]: r.asDict() for r in inference_counts(df, columns).collect()}
    shapes: dict[str, list[int]] = {}
    rare = [c for c, r in rows.items() if r["raras"] and _could_be_dates(r)]
    if rare:
        for r in odd_date_counts(df, rare).orderBy("columna", "forma").collect():
            rows[r["columna"]]["fechas"] += r["n"]
            shapes.setdefault(r["columna"], []).append(r["forma"])
    chosen = {c: "texto" for c in columns} | {c: decide_type(r) for c, r in rows.items()}
    changed = {c: convert(ref(c), t, shapes.get(c, ())) for c, t in chosen.items() if t != "texto"}
    return (df.withColumns(changed) if changed else df), chosen


def cap_rows(df: DataFrame, limit: int, order_by: Sequence[str]) -> DataFrame:
    """The first rows in a given order (a file order does not exist on a cluster)."""
    return ordered_slice(df, [(ref(c), True) for c in order_by], 0, limit)


def cap_columns(df: DataFrame, limit: int) -> DataFrame:
    return df.select(*[ref(c) for c in df.columns[:limit]])
