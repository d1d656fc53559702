"""Rows of delimited text whose quoted fields go on over line breaks, read in splits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from varscope.functions.columns import quoted
from varscope.session import freeze

#: A field put behind every row: a parser that stopped before the end of the row does not find it.
END = "\x02fin\x02"
#: Whole rows, and pieces of a row that goes on over the end of a split: its beginning, middle and end.
WHOLE, BEGIN, MIDDLE, FINISH = range(4)
_PIECES = "archivo string, bloque bigint, clase int, cabecera boolean, texto string"


def _lines(spark: SparkSession, files: Sequence[str], encoding: str) -> DataFrame:
    """``archivo, bloque, linea``: lines between line feeds with the split they begin in, in the order of the file."""
    lines = spark.read.option("lineSep", "\n").text(list(files))
    value = F.col("value") if encoding == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    return lines.select(F.col("_metadata.file_path").alias("archivo"), F.col("_metadata.file_block_start").alias("bloque"), value.alias("linea"))


def _quotes(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))


def split_parity(lines: DataFrame) -> DataFrame:
    """``archivo, bloque, abierta``: whether a quoted field is open where a split begins, by the quotes before it.

    Quotes are counted per split, and the counts added over the splits of a file: one row per split.
    """
    counts = lines.groupBy("archivo", "bloque").agg(F.sum(_quotes(F.col("linea"))).alias("n"))
    before = Window.partitionBy("archivo").orderBy("bloque").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("archivo", "bloque", (F.coalesce(F.sum("n").over(before), F.lit(0)) % 2 == 1).alias("abierta"))


class _Assembler:
    """Rows of one split, put together from its lines."""

    def __init__(self, archivo: str, bloque: int, abierta: bool):
        self.key, self.open, self.header = (archivo, bloque), abierta, bloque == 0
        self.held: list[str] = []
        self.inside = abierta

    def add(self, lines: Sequence[str], counts: np.ndarray) -> Iterator[tuple]:
        parity = (int(self.open) + np.cumsum(counts)) % 2
        for line, still_open in zip(lines, parity.tolist()):
            self.held.append(line)
            if not still_open:
                yield from self._row(FINISH if self.inside else WHOLE)
        self.open = bool(parity[-1])

    def _row(self, kind: int) -> Iterator[tuple]:
        text = "\n".join(self.held)
        self.held, self.inside = [], False
        # A line end of two signs leaves its first one behind.
        text = text[:-1] if kind in (WHOLE, FINISH) and text.endswith("\r") else text
        if kind != WHOLE or text:
            yield (*self.key, kind, self.header and kind != FINISH, text)
            self.header = False

    def end(self) -> Iterator[tuple]:
        if self.held:
            yield from self._row(MIDDLE if self.inside else BEGIN)


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now = None
    for batch in batches:
        if not len(batch):
            continue
        found: list[tuple] = []
        keys = list(zip(batch["archivo"].to_pylist(), batch["bloque"].to_pylist()))
        edges = [0, *[n for n in range(1, len(keys)) if keys[n] != keys[n - 1]], len(keys)]
        counts, lines = pc.count_substring(batch["linea"], '"').to_numpy(zero_copy_only=False), batch["linea"].to_pylist()
        for a, b in zip(edges, edges[1:]):
            if now is None or now.key != keys[a]:
                found += now.end() if now else []
                now = _Assembler(*keys[a], batch["abierta"][a].as_py())
            found += now.add(lines[a:b], counts[a:b])
        yield _batch(found)
    if now is not None:
        yield _batch(list(now.end()))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
    return pa.record_batch([pa.array([r[n] for r in rows], kind) for n, kind in enumerate(kinds)],
                           names=["archivo", "bloque", "clase", "cabecera", "texto"])


def joined_rows(spark: SparkSession, files: Sequence[str], encoding: str) -> DataFrame:
    """``texto``: the rows of the files without their headers, each with the line breaks inside its quotes.

    A split is read by a task of its own, which starts inside or outside quotes as the parity of all quotes before it
    says. A row ends at a line break outside quotes. Rows that go on over the end of a split, two pieces per split at
    most, are put together afterwards; empty lines outside quotes are no rows.
    """
    lines = _lines(spark, files, encoding)
    # One row per split, as the driver's own list of splits has.
    pieces = lines.join(F.broadcast(freeze(split_parity(lines))), ["archivo", "bloque"]).select(
        "archivo", "bloque", "linea", "abierta").mapInArrow(_assemble, _PIECES)
    whole = pieces.filter((F.col("clase") == WHOLE) & ~F.col("cabecera")).select("texto")
    # The end of a row comes before the beginning of another in the same split.
    place = F.when(F.col("clase") == BEGIN, 1).otherwise(0)
    order = Window.partitionBy("archivo").orderBy("bloque", place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = pieces.filter(F.col("clase") != WHOLE).withColumn("fila", F.sum(place).over(order))
    across = parts.groupBy("archivo", "fila").agg(
        F.sort_array(F.collect_list(F.struct("bloque", place.alias("lugar"), "texto"))).alias("partes"),
        F.max("cabecera").alias("cabecera")).filter(~F.col("cabecera"))
    return whole.unionByName(freeze(across.select(F.concat_ws("\n", F.col("partes.texto")).alias("texto"))))


def parse_rows(rows: DataFrame, fields: T.StructType, delimiter: str) -> DataFrame:
    """The fields of ``rows``, and ``_bien``: whether the row was read to its end and has no more fields than named.

    It is not where quotes stand inside a field without being doubled, so that they do not tell where a row ends.
    """
    wide = T.StructType([*fields.fields, T.StructField("_resto", T.StringType())])
    options = {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true", "lineSep": "\n"}
    ended = F.concat(F.col("texto"), F.lit(delimiter + END))
    read = rows.select(F.from_csv(ended, wide.simpleString()[len("struct<"):-1].replace(":", " "), options).alias("_f"))
    names = [f.name for f in wide.fields]
    cells = [F.col(f"_f.{quoted(n)}") for n in names]
    ends = F.lit(False)
    for cell in cells:
        ends = ends | cell.eqNullSafe(F.lit(END))
    kept = [F.when(~cell.eqNullSafe(F.lit(END)), cell).alias(name) for cell, name in zip(cells[:-1], names)]
    return read.select(*kept, ends.alias("_bien"))
