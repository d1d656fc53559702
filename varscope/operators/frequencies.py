"""Value counts and the frequency tables built from them."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from varscope.functions.columns import (
    BOOL, DECIMAL, ENTERO, FECHA, NUMBER_TEXT_SQL, TEXTO, finite_sql, kinds, local_rows, numeric_long,
    quoted, rounded, sql_text,
)
from varscope.functions.text import WHITE_SPACE, normalize, normalize_name
from varscope.functions.vocab import CONTINUA, DISCRETA, FREQUENCY_ROWS
from varscope.operators.ordering import range_parts

# Text above this length travels as its beginning and the digest of the whole; what leaves an
# operator is the whole text again, see :func:`restore_texts`.
LONG_TEXT = 256
HEAD = 80
LONGEST_WORD = 64
# Digits that every double holds exactly, and the number above which whole doubles have gaps.
DOUBLE_DIGITS, EXACT_DOUBLE = 15, 2**53
DIGEST_END = r"(?s)… #[0-9a-f]{64}$"


def _is_long(cell: str) -> str:
    """SQL test for text that is long and no known label, even once its blanks are left out."""
    return (f"length({cell}) > {LONG_TEXT} "
            f"AND length(translate({cell}, {sql_text(WHITE_SPACE + '_-')}, '')) > {LONGEST_WORD}")


def _digest(cell: str) -> str:
    return f"concat(left({cell}, {HEAD}), '… #', sha2({cell}, 256))"


def value_counts(
    df: DataFrame, columns: Sequence[str] | None = None, compact: bool = False, with_norm: bool = False
) -> DataFrame:
    """``columna, valor, valor_num, n``: how often each value of each column occurs.

    Columns of one kind are counted together on their native type (numbers are never printed
    before they are aggregated). Counts combine before the shuffle, so a value that fills a third
    of the table still arrives as one row per task.

    ``compact`` tells long texts apart by the SHA-256 of the whole text after its first
    characters, so that documents are counted without being shuffled; rows that are shown get
    their texts back from :func:`restore_texts`. ``with_norm`` adds the
    column ``norma``; long texts are normalised where they are read, labels after counting.
    """
    by_kind: dict[str, list[str]] = {}
    exact = {f.name: f.dataType.simpleString() for f in df.schema.fields
             if isinstance(f.dataType, T.DecimalType) and f.dataType.precision > DOUBLE_DIGITS}
    for name, kind in kinds(df, columns).items():
        # Decimals that a double cannot hold are counted on their own type, one group per type.
        own = exact.get(name) if kind == DECIMAL else None
        by_kind.setdefault(own or kind, []).append(name)
    if not by_kind:
        empty = "columna string, valor string, valor_num double, n bigint" + (", norma string" if with_norm else "")
        return local_rows(df.sparkSession, [], empty)

    def text_cell(c: str) -> str:
        cell = f"CAST({c} AS STRING)"
        return f"IF({_is_long(cell)}, {_digest(cell)}, {cell})" if compact else cell


    # kind -> (cell on its native type, its text, its number)
    shapes = {
        ENTERO: (lambda c: f"CAST({c} AS BIGINT)", "CAST(v AS STRING)", "CAST(v AS DOUBLE)"),
        DECIMAL: (None, NUMBER_TEXT_SQL.format(x="v"), "v"),
        TEXTO: (text_cell, "v", "CAST(NULL AS DOUBLE)"),
        FECHA: (lambda c: f"CAST({c} AS TIMESTAMP_NTZ)", "CAST(v AS STRING)", "CAST(NULL AS DOUBLE)"),
        BOOL: (lambda c: c, "IF(v, 'True', 'False')", "CAST(NULL AS DOUBLE)"),
    }
    for kind in by_kind:
        if kind.startswith("decimal("):
            shapes[kind] = (lambda c: c, "regexp_replace(CAST(v AS STRING), '(\\\\.[0-9]*?)0+$', '$1')" if not kind.endswith(",0)")
                            else "CAST(v AS STRING)", "CAST(v AS DOUBLE)")
    parts = []
    for kind, (cell, text, number) in shapes.items():
        names = by_kind.get(kind)
        if not names:
            continue
        if kind == TEXTO and compact and with_norm:
            parts.append(_text_counts_with_norm(df, names))
            continue
        wide = df.selectExpr(*[
            f"{finite_sql(c, kind) if cell is None else cell(quoted(c))} AS {quoted(c)}" for c in names])
        long = wide.unpivot([], [quoted(c) for c in names], "columna", "v").filter("v IS NOT NULL")
        counted = long.groupBy("columna", "v").agg(F.expr("count(*) AS n"))
        part = counted.selectExpr("columna", f"{text} AS valor", f"{number} AS valor_num", "n")
        parts.append(part.withColumn("norma", normalize(F.col("valor"))) if with_norm else part)
    return reduce(DataFrame.unionByName, parts)


def _text_counts_with_norm(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Compact counts of text columns in which long texts carry a digest of their normal form."""
    cells = {c: f"CAST({quoted(c)} AS STRING)" for c in names}
    long_forms = [F.when(F.expr(_is_long(cell)), F.sha2(normalize(F.expr(cell)), 256)) for cell in cells.values()]
    pairs = [
        F.struct(F.expr(f"IF({_is_long(cell)}, {_digest(cell)}, {cell})").alias("v"), form.alias("f")).alias(c)
        for (c, cell), form in zip(cells.items(), long_forms)
    ]
    counted = (
        df.select(*pairs).unpivot([], [quoted(c) for c in names], "columna", "p")
        .select("columna", F.col("p.v").alias("valor"), F.col("p.f").alias("_f")).filter("valor IS NOT NULL")
        .groupBy("columna", "valor", "_f").agg(F.expr("count(*) AS n"))
    )
    return counted.select("columna", "valor", F.lit(None).cast("double").alias("valor_num"), "n",
                          F.coalesce("_f", normalize(F.col("valor"))).alias("norma"))


def restore_texts(df: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Function that puts whole texts back into a few rows ``columna, valor, …`` of compact counts.

    ``df`` is the table that was counted. Only texts whose digest is among the rows leave the scan,
    once per task. The function takes rows of any number, whose digests are joined by a shuffle; only
    where they are ``limited``, the winners of a group limit, the digests are broadcast.
    """
    names = [c for c, kind in kinds(df).items() if kind == TEXTO]

    def restore(rows: DataFrame, limited: bool = False) -> DataFrame:
        if not names:
            return rows
        cells = {c: f"CAST({quoted(c)} AS STRING)" for c in names}
        pairs = df.selectExpr(*[
            f"IF({_is_long(cell)}, named_struct('v', {_digest(cell)}, 't', {cell}), NULL) AS {quoted(c)}"
            for c, cell in cells.items()])
        long = pairs.unpivot([], [quoted(c) for c in names], "columna", "p").filter("p IS NOT NULL").select(
            "columna", F.col("p.v").alias("valor"), F.col("p.t").alias("_entero"))
        wanted = rows.select("columna", "valor").filter(F.col("valor").rlike(DIGEST_END)).distinct()
        found = long.join(F.broadcast(wanted) if limited else wanted, ["columna", "valor"], "left_semi").groupBy("columna", "valor").agg(
            F.first("_entero").alias("_entero"))
        whole = F.coalesce("_entero", "valor")
        return rows.join(found, ["columna", "valor"], "left").withColumn("valor", whole).drop("_entero")
    return restore


def scale_position(value: Column, scale: Sequence[str]) -> Column:
    """Place of a label in a scale; labels outside it come last."""
    levels = F.array(*[F.lit(normalize_name(level)) for level in scale])
    place = F.array_position(levels, normalize(value))
    return F.when(place > 0, place).otherwise(F.lit(len(scale) + 1))


def display_keys(scales: dict[str, Sequence[str]] | None = None) -> list[Column]:
    """Sort keys of a frequency table: scale place, then number, then text by code point."""
    place, number = F.lit(0), F.col("valor_num")
    for name, scale in (scales or {}).items():
        here = F.col("columna") == name
        place = F.when(here, scale_position(F.col("valor"), scale)).otherwise(place)
        number = F.when(~here, number)
    # Beyond the whole numbers that a double tells apart the digits themselves decide.
    digits = F.when(F.abs(number) >= EXACT_DOUBLE, F.col("valor").try_cast("decimal(38,0)"))
    return [place, number, digits, F.col("valor")]


def display_order(scales: dict[str, Sequence[str]] | None = None) -> list[Column]:
    return [key.asc_nulls_last() for key in display_keys(scales)]


def _totals(counts: DataFrame) -> DataFrame:
    """One row per column: how many cells hold a value."""
    return counts.groupBy("columna").agg(F.sum("n").alias("_total"))


def _with_shares(rows: DataFrame, totals: DataFrame) -> DataFrame:
    share = lambda part: rounded(F.col(part) / F.col("_total"))
    return rows.join(F.broadcast(totals), "columna").select(
        "columna", "orden", "valor",
        F.col("n").alias("frecuencia_absoluta"),
        share("n").alias("frecuencia_relativa"),
        F.col("_acumulada").cast("bigint").alias("frecuencia_acumulada"),
        share("_acumulada").alias("frecuencia_relativa_acumulada"),
    )


def frequency_tables(
    counts: DataFrame,
    limit: int | None = FREQUENCY_ROWS,
    scales: dict[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Absolute, relative and cumulative frequencies of every column in ``counts``.

    ``limit`` keeps the first values in display order; shares stay relative to the whole column.
    With a limit the ranking is a group limit that Spark applies on both sides of the shuffle.
    Without one the running total is taken part by part over a range partitioning.
    """
    if limit is not None:
        ranked = Window.partitionBy("columna").orderBy(*display_order(scales))
        running = ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = (
            counts.withColumn("orden", F.row_number().over(ranked).cast("bigint"))
            .filter(F.col("orden") <= limit)
            .withColumn("_acumulada", F.sum("n").over(running))
        )
    else:
        rows = running_totals(counts, display_keys(scales))
    return _with_shares(rows, _totals(counts))


def running_totals(counts: DataFrame, order_keys: Sequence[Column]) -> DataFrame:
    """``orden`` and ``_acumulada`` over all values of each column, however many there are.

    Values are ranged by (column, order) and frozen with the number of the part they landed in.
    Each part is then summed alone, and the sums of the parts before it are added: no task ever
    holds more than one part.
    """
    names = [f"_k{i}" for i in range(len(order_keys))]
    keyed = counts.select("*", *[key.alias(name) for name, key in zip(names, order_keys)])
    keys = [F.col(name).asc_nulls_last() for name in names]
    parts = range_parts(keyed, [F.col("columna"), *keys])
    before = Window.partitionBy("columna").orderBy("_parte").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.groupBy("columna", "_parte").agg(F.sum("n").alias("_s"), F.count("*").alias("_r"))
        .select(
            "columna", "_parte",
            F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_n0"),
            F.coalesce(F.sum("_r").over(before), F.lit(0)).alias("_r0"),
        )
    )
    inside = Window.partitionBy("columna", "_parte").orderBy(*keys)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        parts.withColumn("orden", F.row_number().over(inside))
        .withColumn("_acumulada", F.sum("n").over(running))
        # One row per (column, part): bounded by the width of the table and the partition count.
        .join(F.broadcast(offsets), ["columna", "_parte"])
        .withColumn("orden", (F.col("orden") + F.col("_r0")).cast("bigint"))
        .withColumn("_acumulada", F.col("_acumulada") + F.col("_n0"))
        .drop("_parte", "_n0", "_r0", *names)
    )


def frequency_table(
    df: DataFrame, column: str, limit: int | None = None, scale: Sequence[str] | None = None
) -> DataFrame:
    """Frequency table of one column; see :func:`frequency_tables`."""
    return frequency_tables(
        value_counts(df, [column]), limit, {column: scale} if scale else None
    ).drop("columna")


def sturges_classes(n: int) -> int:
    """Number of classes for ``n`` values."""
    return max(2, math.ceil(1 + 3.322 * math.log10(n)))


def class_index(x: Column, low: Column, width: Column, classes: Column) -> Column:
    """Class of ``x`` among equal classes ``[low + i·width, low + (i+1)·width)``, last one closed.

    The quotient is only a first guess: it is moved by one where the class bounds say so, so that
    a value on an edge falls where comparing it with the bounds would put it.
    """
    guess = F.greatest(F.lit(0), F.least(F.floor((x - low) / width), classes - 1)).cast("int")
    return (
        F.when((guess > 0) & (x < low + guess * width), guess - 1)
        .when((guess < classes - 1) & (x >= low + (guess + 1) * width), guess + 1)
        .otherwise(guess)
    )


def class_bounds(df: DataFrame, columns: Sequence[str], classes: int | None = None) -> list[tuple]:
    """``(columna, n, minimo, maximo, clases)`` per column that has values; one small job."""
    rows = (
        numeric_long(df, columns).groupBy("columna")
        .agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
    )
    return [
        (r["columna"], r["n"], r["lo"], r["hi"], classes or sturges_classes(r["n"]))
        for r in rows
    ]


def histogram(df: DataFrame, bounds: Sequence[tuple]) -> DataFrame:
    """Counts per class for columns with the given bounds; empty classes are kept.

    Class edges travel with the rows as a broadcast of one row per column, and each value finds
    its class by arithmetic, so only (column, class) counts are shuffled.
    """
    schema = "columna string, total bigint, lo double, hi double, k int"
    edges = local_rows(df.sparkSession, [tuple(b) for b in bounds], schema).withColumn(
        "w", (F.col("hi") - F.col("lo")) / F.col("k")
    )
    counts = (
        numeric_long(df, [b[0] for b in bounds]).join(F.broadcast(edges), "columna")
        .withColumn("clase", F.when(F.col("w") == 0, 0).otherwise(
            class_index(F.col("x"), F.col("lo"), F.col("w"), F.col("k"))))
        .groupBy("columna", "clase").agg(F.count("*").alias("n"))
    )
    classes = edges.withColumn("clase", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    running = Window.partitionBy("columna").orderBy("clase").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    low = F.col("lo") + F.col("clase") * F.col("w")
    high = F.when(F.col("clase") == F.col("k") - 1, F.col("hi")).otherwise(
        F.col("lo") + (F.col("clase") + 1) * F.col("w"))
    return (
        classes.join(F.broadcast(counts), ["columna", "clase"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("_acumulada", F.sum("n").over(running))
        .select(
            "columna",
            (F.col("clase") + 1).cast("bigint").alias("clase"),
            F.col("k").cast("bigint").alias("clases"),
            rounded(F.col("w")).alias("amplitud"),
            F.format_string("[%.2f - %.2f%s", low, high,
                            F.when(F.col("clase") == F.col("k") - 1, "]").otherwise(")")).alias("intervalo"),
            rounded(low).alias("limite_inferior"),
            rounded(high).alias("limite_superior"),
            rounded((low + high) / 2).alias("marca_clase"),
            F.col("n").cast("bigint").alias("frecuencia_absoluta"),
            rounded(F.col("n") / F.col("total")).alias("frecuencia_relativa"),
            F.col("_acumulada").cast("bigint").alias("frecuencia_acumulada"),
            rounded(F.col("_acumulada") / F.col("total")).alias("frecuencia_relativa_acumulada"),
        )
    )


def grouped_tables(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Grouped frequency tables; a column with under two values or no spread has none."""
    bounds = [
        b for b in class_bounds(df, columns)
        if b[1] >= 2 and not math.isclose(b[2], b[3], rel_tol=1e-9)
    ]
    return histogram(df, bounds)


def frequency_bundle(
    df: DataFrame, classification: Sequence[tuple[str, str, Sequence[str] | None]],
    counts: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Ungrouped tables of all columns, and grouped tables of the quantitative ones.

    ``classification`` holds ``(columna, tipo, escala)`` per column.
    """
    names = [name for name, _, _ in classification]
    counts = value_counts(df, names) if counts is None else counts
    scales = {name: scale for name, _, scale in classification if scale}
    quantitative = [name for name, tipo, _ in classification if tipo in (DISCRETA, CONTINUA)]
    return frequency_tables(counts, FREQUENCY_ROWS, scales), grouped_tables(df, quantitative)
