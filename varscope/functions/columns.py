"""Column references, column kinds and number handling."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

ENTERO, DECIMAL, BOOL, FECHA, TEXTO = "entero", "decimal", "booleano", "fecha", "texto"

INFINITY = float("inf")


def ref(name: str) -> Column:
    """Column by its literal name, whatever characters the header holds."""
    return F.col(quoted(name))


def quoted(name: str) -> str:
    """A column name for use inside an SQL expression."""
    return "`" + name.replace("`", "``") + "`"


def sql_text(value: str) -> str:
    """A text literal for use inside an SQL expression."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_array(values: Iterable[str]) -> str:
    return "array(" + ", ".join(sql_text(v) for v in values) + ")"


def kind_of(data_type: T.DataType) -> str:
    """One of five kinds; anything that is not a number, flag or date counts as text."""
    if isinstance(data_type, T.IntegralType):
        return ENTERO
    if isinstance(data_type, T.DecimalType) and data_type.scale == 0 and data_type.precision <= 18:
        return ENTERO
    if isinstance(data_type, T.NumericType):
        return DECIMAL
    if isinstance(data_type, T.BooleanType):
        return BOOL
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return FECHA
    return TEXTO


def kinds(df: DataFrame, columns: Iterable[str] | None = None) -> dict[str, str]:
    """Kind of each column, in table order."""
    wanted = list(df.columns if columns is None else columns)
    by_name = {field.name: kind_of(field.dataType) for field in df.schema.fields}
    missing = [name for name in wanted if name not in by_name]
    if missing:
        raise ValueError(f"No hay ninguna columna llamada «{missing[0]}».")
    return {name: by_name[name] for name in wanted}


def numeric_columns(df: DataFrame) -> list[str]:
    return [name for name, kind in kinds(df).items() if kind in (ENTERO, DECIMAL)]


PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def finite_sql(name: str, kind: str) -> str:
    """SQL of :func:`finite`. Wide tables build one expression per column, and a parsed text is
    much cheaper to build from Python than the same tree of Column objects."""
    cell = quoted(name)
    if kind == ENTERO:
        return f"CAST({cell} AS DOUBLE)"
    if kind == DECIMAL:
        return f"CASE WHEN abs({cell}) < double('Infinity') THEN CAST({cell} AS DOUBLE) END"
    if kind == TEXTO:
        text = f"regexp_replace(CAST({cell} AS STRING), {sql_text('(?U)' + chr(92) + 's')}, '')"
        return f"CASE WHEN {text} RLIKE {sql_text(PLAIN_NUMBER)} THEN " \
               f"nullif(try_cast({text} AS DOUBLE), double('Infinity')) END"
    return "CAST(NULL AS DOUBLE)"


def finite(df: DataFrame, name: str) -> Column:
    """The column as a double; NaN, infinities and text that is not a number become null."""
    return F.expr(finite_sql(name, kinds(df, [name])[name]))


def present(df: DataFrame, name: str) -> Column:
    """True where the cell holds a value (null, NaN and infinities do not).

    Plain comparisons, which a scan can use; on a null number the result is null, not false.
    """
    if kinds(df, [name])[name] == DECIMAL:
        return (ref(name) > -INFINITY) & (ref(name) < INFINITY)
    return ref(name).isNotNull()


def rounded(value: Column, places: int = 6) -> Column:
    """Rounded double; a non-finite result is reported as null."""
    value = value.cast("double")
    return F.round(F.when(F.abs(value) < INFINITY, value), places)


# Java switches to an exponent outside [1e-3, 1e7); a decimal cast spells the digits out.
NUMBER_TEXT_SQL = (
    "CASE WHEN {x} = 0 OR abs({x}) BETWEEN 1e-3 AND 9999999.0 OR abs({x}) >= 1e16 OR abs({x}) < 1e-4 "
    "THEN CAST({x} AS STRING) ELSE regexp_replace("
    "CAST(CAST(CAST({x} AS STRING) AS DECIMAL(38,18)) AS STRING), '(\\\\.[0-9]+?)0+$', '$1') END"
)


def number_text(name: str) -> Column:
    """Plain text of a double column: ``3.0``, ``10000000.0``, ``12345678.9``, ``0.0001``."""
    return F.expr(NUMBER_TEXT_SQL.format(x=quoted(name)))


def short_number(name: str) -> Column:
    """Like :func:`number_text`, but whole numbers carry no decimals."""
    whole = f"CAST(CAST({quoted(name)} AS DECIMAL(38,0)) AS STRING)"
    return F.expr(f"CASE WHEN {quoted(name)} = rint({quoted(name)}) AND abs({quoted(name)}) < 1e18 "
                  f"THEN {whole} ELSE {NUMBER_TEXT_SQL.format(x=quoted(name))} END")


def numeric_long(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per cell that holds a number: ``keep…, columna, x``.

    A long frame lets one short aggregate serve every column, which the JIT compiles far better
    than hundreds of aggregate expressions in one wide row.
    """
    by_kind = kinds(df, columns)
    kept = [quoted(k) for k in keep]
    if not by_kind:
        return df.selectExpr(*kept, "CAST(NULL AS STRING) AS columna", "CAST(NULL AS DOUBLE) AS x").filter("false")
    wide = df.selectExpr(*kept, *[f"{finite_sql(c, kind)} AS {quoted(c)}" for c, kind in by_kind.items()])
    return wide.unpivot(kept, [quoted(c) for c in by_kind], "columna", "x").filter("x IS NOT NULL")


def local_rows(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """Small driver-made table as a local relation (through Arrow), planned without any task."""
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)
    plain = lambda v: v.asDict(recursive=True) if isinstance(v, Row) else v
    arrays = [
        pa.array([plain(row[i]) for row in rows], type=arrow.field(i).type) for i in range(len(struct))
    ]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), struct)


def column_rows(df: DataFrame, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Driver-made table with one row per column or rule (bounded by the width of the table)."""
    return local_rows(df.sparkSession, rows, schema)
