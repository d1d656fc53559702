"""Catalogue of saved analyses: an append-only table partitioned by client.

Saving appends one row. Deleting appends the id to a second table, so that no file is rewritten
and a lost executor cannot leave half a catalogue. Readers take what was added and not removed.
What retention drops is removed in the same way, so that it never comes back. :meth:`Catalog.compact`
writes the live entries to a new generation of the tables when the small files have become many.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, Window, functions as F

from varscope.functions.vocab import HISTORY_PER_CLIENT

ENTRY = (
    "id string, nombre_archivo string, hoja string, filas bigint, columnas bigint, tamano_bytes bigint, "
    "resumen_tipos map<string,int>, ruta string, creado_en timestamp, cliente string"
)
REMOVED = "id string, borrado_en timestamp, cliente string"


def newest_per_group(df: DataFrame, group: str, newest_first: list, keep: int = HISTORY_PER_CLIENT) -> DataFrame:
    """The newest ``keep`` rows of every group at once, with their place ``orden``.

    Spark applies the group limit before the shuffle, so a group with most of the rows sends no
    more than ``keep`` of them per task.
    """
    order = Window.partitionBy(group).orderBy(*newest_first)
    return df.withColumn("orden", F.row_number().over(order).cast("bigint")).filter(F.col("orden") <= keep)


def without_removed(added: DataFrame, removed: DataFrame) -> DataFrame:
    """Entries that were added and not removed; both tables are keyed by client and id."""
    return added.join(removed.select("cliente", "id"), ["cliente", "id"], "left_anti")


def beyond_retention(live: DataFrame, keep: int = HISTORY_PER_CLIENT) -> DataFrame:
    """Entries older than the newest ``keep`` of their client, for all clients in one job."""
    order = Window.partitionBy("cliente").orderBy(F.desc("creado_en"), F.desc("id"))
    return live.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") > keep).drop("_n")


class Catalog:
    """Saved analyses under one folder."""

    def __init__(self, spark: SparkSession, folder: str, per_client: int = HISTORY_PER_CLIENT,
                 max_bytes: int | None = None):
        self.spark, self.per_client, self.max_bytes = spark, per_client, max_bytes
        self.folder = folder.rstrip("/")

    @property
    def generation(self) -> int:
        """The newest finished generation; its number is written last, so half a one is never seen."""
        return self._read(f"{self.folder}/generaciones", "numero int").agg(F.coalesce(F.max("numero"), F.lit(0))).first()[0]

    @property
    def added(self) -> str:
        return f"{self.folder}/analisis-{self.generation}"

    @property
    def removed(self) -> str:
        return f"{self.folder}/bajas-{self.generation}"

    def _live(self) -> DataFrame:
        return without_removed(self._read(self.added, ENTRY), self._read(self.removed, REMOVED))

    def _read(self, path: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def save(self, cliente: str, ruta: str, nombre_archivo: str, filas: int, columnas: int,
             resumen_tipos: Mapping[str, int], tamano_bytes: int = 0, hoja: str | None = None,
             creado_en: datetime | None = None) -> str | None:
        """Append one analysis and return its id; None when its file is above the size limit."""
        if self.max_bytes is not None and tamano_bytes > self.max_bytes:
            return None
        key = uuid.uuid4().hex[:16]
        when = creado_en or datetime.now(timezone.utc)
        row = (key, nombre_archivo, hoja, filas, columnas, tamano_bytes, dict(resumen_tipos), ruta, when, cliente)
        self.spark.createDataFrame([row], ENTRY).write.mode("append").partitionBy("cliente").parquet(self.added)
        self.prune(cliente)
        return key

    def prune(self, cliente: str | None = None) -> None:
        """Remove for good what retention drops, of one client or of all clients in one job."""
        live = self._live()
        live = live if cliente is None else live.filter(F.col("cliente") == cliente)
        self._remove(beyond_retention(live, self.per_client))

    def compact(self) -> None:
        """Write the live entries to a new generation, without the files of removed ones."""
        number = self.generation + 1
        live = self._live().repartition("cliente")
        live.write.mode("overwrite").partitionBy("cliente").parquet(f"{self.folder}/analisis-{number}")
        self.spark.createDataFrame([(number,)], "numero int").write.mode("append").parquet(f"{self.folder}/generaciones")

    def entries(self) -> DataFrame:
        """Entries that have not been removed, within the newest ones kept per client."""
        return newest_per_group(self._live(), "cliente", [F.desc("creado_en"), F.desc("id")], self.per_client)

    def list(self, cliente: str) -> DataFrame:
        """A client's entries, newest first; only that client's partition is read."""
        return self.entries().filter(F.col("cliente") == cliente).orderBy("orden").drop("orden")

    def fetch(self, cliente: str, key: str) -> Row | None:
        """One entry by id and client: another client's id gives nothing."""
        return self.list(cliente).filter(F.col("id") == key).first()

    def _remove(self, rows: DataFrame) -> None:
        rows.select("id", F.current_timestamp().alias("borrado_en"), "cliente").write.mode("append").partitionBy(
            "cliente").parquet(self.removed)

    def delete(self, cliente: str, key: str) -> bool:
        rows = self.list(cliente).filter(F.col("id") == key)
        if rows.isEmpty():
            return False
        self._remove(rows)
        return True

    def clear(self, cliente: str) -> int:
        """Remove all entries of a client and return how many were visible."""
        rows = self.list(cliente)
        count = rows.count()
        if count:
            self._remove(self._read(self.added, ENTRY).filter(F.col("cliente") == cliente))
        return count
