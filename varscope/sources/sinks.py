"""Writers: filtered data and the report tables, as folders of part files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, folder: str) -> None:
    """CSV with a header; every task writes its own part."""
    df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(folder)


def write_parquet(df: DataFrame, folder: str) -> None:
    df.write.mode("errorifexists").parquet(folder)


def write_report(tables: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """Each table of a report in a folder of its own."""
    for name, table in tables.items():
        (write_csv if fmt == "csv" else write_parquet)(table, f"{folder.rstrip('/')}/{name}")
