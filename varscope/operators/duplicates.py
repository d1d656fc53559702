"""Fully duplicated rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from varscope.functions.columns import ref

LONG_TEXT = 64


def row_key(df: DataFrame, columns: Sequence[str] | None = None) -> list[Column]:
    """Columns that identify a row in a shuffle.

    Text longer than 64 characters is replaced by the SHA-256 of the whole text, which is 65
    characters with its mark and so cannot be mistaken for a short text. Wide documents are
    compared whole, yet only their digests travel.
    """
    keys = []
    for field in df.schema.fields:
        if columns is not None and field.name not in columns:
            continue
        cell = ref(field.name)
        if isinstance(field.dataType, (T.MapType, T.VariantType)):
            cell = F.to_json(cell)
        elif isinstance(field.dataType, T.StringType):
            cell = F.when(F.length(cell) > LONG_TEXT, F.concat(F.lit("#"), F.sha2(cell, 256))).otherwise(cell)
        keys.append(cell.alias(f"_r{len(keys)}"))
    return keys


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``filas_duplicadas``: rows equal to an earlier one in every column; nulls are equal.

    Copies of one row combine before the shuffle, so a row that fills a third of the table is
    one record per task.
    """
    groups = df.groupBy(*row_key(df, columns)).agg(F.count("*").alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("filas_duplicadas"))
