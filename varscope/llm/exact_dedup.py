"""Exact dedup: a persistent digest index, bucketed and sorted by digest, with a sort-merge anti-join for new data."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from varscope.llm.common import SPACE, new_path, whole_row, written


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, chars, digest): code points of the text, SHA-256 of the text without white space; null is empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.char_length(text).cast("bigint").alias("chars"),
                       F.unhex(F.sha2(F.regexp_replace(text, SPACE + "+", ""), 256)).alias("digest"))


class DigestIndex:
    """Digests seen so far, with the id that stays for each.

    A Parquet table bucketed and sorted by digest at ``location``, so that it can be opened again later and a join
    with it moves only the new rows. A new index has as many buckets as the session has shuffle partitions, so that a
    task of the exchange writes one bucket, and ids of type bigint, unless told otherwise. Both are kept beside the
    table, at ``location`` with ``.layout`` added, and hold for all who open it again; other arguments are refused.
    An index without a layout, from before it was kept, opens with the number of buckets that it was made with.
    """

    def __init__(self, spark: SparkSession, location: str | None = None, id_type: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.location = (location or new_path(spark, "digest-index")).rstrip("/")
        self.buckets, id_type = self._layout(id_type, buckets)
        buckets = self.buckets
        # A hash of the whole location, so that two indexes never share a name.
        self.name = "digest_index_" + hashlib.sha256(self.location.encode()).hexdigest()[:40]
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id {id_type}, group_size BIGINT) "
                  f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS "
                  f"LOCATION '{self.location}'")

    def _layout(self, id_type: str | None, buckets: int | None) -> tuple[int, str]:
        """Number of buckets and type of ids as kept beside the index; a new index keeps those asked for."""
        spark, place = self.spark, f"{self.location}.layout"
        known = self._read(place, "buckets int, id_type string")
        if known is None:
            if buckets is None and self._read(self.location, "digest binary") is not None:
                raise ValueError(f"{self.location} holds an index without a layout: give its number of buckets")
            kept = buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), self._type(id_type or "bigint")
            spark.range(1).select(F.lit(kept[0]).alias("buckets"), F.lit(kept[1]).alias("id_type")).coalesce(1).write.parquet(place)
            return kept
        kept = known["buckets"], known["id_type"]
        if buckets not in (None, kept[0]) or id_type is not None and self._type(id_type) != kept[1]:
            raise ValueError(f"{self.location} has {kept[0]} buckets and ids of type {kept[1]}, not {buckets} and {id_type}")
        return kept

    def _type(self, name: str) -> str:
        return self.spark.range(0).select(F.lit(None).cast(name).alias("id")).dtypes[0][1]

    def _read(self, place: str, schema: str) -> Row | None:
        """The first row at ``place``, None where there is none."""
        try:
            return self.spark.read.schema(schema).parquet(place).first()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def lookup(self) -> DataFrame:
        """The same rows without the buckets: a join exchanges both sides, so that a digest with a third of all rows
        can be split."""
        return self.spark.read.schema(self.table().schema).parquet(self.location)

    def add(self, rows: DataFrame) -> None:
        """Append the digests of ``rows`` (id, chars, digest) that the index lacks.

        Of equal texts within ``rows`` the one with the most code points, then the smallest id (null last) stays. The
        counts combine before the shuffle, so a text that fills a third of the rows is one row per task.
        """
        order = F.struct(-F.col("chars"), F.col("id").isNull(), F.col("id"))
        batch = rows.groupBy("digest").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("group_size"))
        batch = batch.select("digest", F.col("best.id").alias("keep_id"), "group_size")
        # The merge hint keeps the join a sort-merge join: the index side is read bucket by bucket, never broadcast.
        fresh = batch.join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        (fresh.repartition(self.buckets, "digest").write.mode("append").format("parquet")
         .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name))
        self.spark.catalog.refreshTable(self.name)


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest (hex), after adding the rows to the index.

    Texts are equal when identical without white space. Null and empty texts, and texts of white space alone, are
    one group. Repeated rows (same id and text) are members of one group and share ``kept``. Rows with a null id take
    part; a null id stays only where no other row is as long. A digest that an earlier batch brought keeps that
    batch's keep_id and group size. No rows give no rows. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    rows = written(digests(docs, id_col, text_col), "digests")
    if index is None:
        index = DigestIndex(spark, id_type=dict(rows.dtypes)["id"])
    index.add(rows)
    return rows.join(index.lookup(), "digest").select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("digest"))


def drop_exact_copies(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one per distinct text, with their columns as they are."""
    kept = exact_dedup(docs, index, id_col, text_col).where("kept").select(
        F.col(id_col).alias("keep_id"), F.col("digest").alias("kept_digest"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    # The whole row is one value beside the keys, so that no column of its own can clash with them.
    keyed = docs.select(whole_row(docs).alias("row"), F.col(id_col).alias("id"),
                        F.sha2(F.regexp_replace(text, SPACE + "+", ""), 256).alias("digest"))
    # Joined on id and digest together: copies differ in their ids, so that no key is hot.
    chosen = keyed.join(kept.distinct(), (F.col("digest") == F.col("kept_digest")) & F.col("id").eqNullSafe(F.col("keep_id")), "left_semi")
    return chosen.dropDuplicates(["id", "digest"]).select("row.*")
