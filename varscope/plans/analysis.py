"""From a table or a file to its full report, with or without filters."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from varscope.functions.columns import local_rows, numeric_columns, numeric_long
from varscope.operators import quality
from varscope.operators.classify import classify, type_summary
from varscope.operators.correlation import correlation
from varscope.operators.describe import numeric_summary
from varscope.operators.filters import Filter, RANGO, apply_filters, drop_full_ranges
from varscope.operators.frequencies import frequency_bundle, restore_texts, value_counts
from varscope.operators.profile import (
    column_profile, filter_options, global_summary, samples, top_categories,
)
from varscope.plans import report
from varscope.sources import sinks
from varscope.sources.catalog import Catalog
from varscope.sources.delimited import load


@dataclass
class Analysis:
    """Report tables of one table; every member is a DataFrame that runs when it is used."""

    columnas: DataFrame
    resumen_numerico: DataFrame | None
    top_categorias: DataFrame
    correlacion: DataFrame
    filtros: DataFrame
    resumen: DataFrame
    filtros_activos: int = 0
    guardadas: list[DataFrame] = field(default_factory=list)

    def close(self) -> None:
        """Release what the report persisted for itself."""
        while self.guardadas:
            self.guardadas.pop().unpersist()


@dataclass
class Dataset:
    """A table, its classification fixed at load, and its value counts.

    The counts are persisted because most reports read them; lost partitions are recomputed.
    """

    df: DataFrame
    clasificacion: DataFrame
    conteos: DataFrame

    compacto: bool = False

    @classmethod
    def of(cls, df: DataFrame, compacto: bool = False) -> Dataset:
        """Classify a table. With ``compacto`` long texts are counted by digest, which spares tables of
        documents from shuffling whole texts; lists then read the texts they show from the table."""
        counts = value_counts(df, compact=compacto).persist()
        return cls(df, classify(df, counts=counts).persist(), counts, compacto)

    @classmethod
    def open(cls, spark: SparkSession, path: str, compacto: bool = False, **options) -> Dataset:
        return cls.of(load(spark, path, **options).df, compacto)

    def close(self) -> None:
        self.conteos.unpersist()
        self.clasificacion.unpersist()

    def scales(self) -> dict[str, Sequence[str]]:
        """Known order of each ordinal column; one row per column reaches the driver."""
        rows = self.clasificacion.filter(F.col("escala_orden").isNotNull()).select("columna", "escala_orden").collect()
        return {r["columna"]: list(r["escala_orden"]) for r in rows}

    def domains(self, filters: Iterable[Filter]) -> dict[str, tuple[float, float]]:
        """Smallest and largest number of each column with an active range filter; one row per column."""
        ranged = {f.columna for f in filters if f.tipo == RANGO and f.active}
        names = [c for c in numeric_columns(self.df) if c in ranged]
        if not names:
            return {}
        rows = numeric_long(self.df, names).groupBy("columna").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        return {r["columna"]: (r["lo"], r["hi"]) for r in rows}

    def analyse(self, filters: Iterable[Filter] = ()) -> Analysis:
        """Full report of the rows that pass the filters, keeping the classification of the load.

        A range over a column's whole domain is no filter.
        """
        filters = list(filters)
        visible, active = apply_filters(self.df, drop_full_ranges(filters, self.domains(filters)))
        counts = value_counts(visible, compact=self.compacto).persist() if active else self.conteos
        result = analyse(visible, counts, self.clasificacion, self.scales(), active,
                         restore_texts(visible) if self.compacto else None)
        if active:
            result.guardadas.append(counts)
        return result

    def frequencies(self, columns: Sequence[str], filters: Iterable[Filter] = ()) -> tuple[DataFrame, DataFrame]:
        """Ungrouped and grouped tables of the given columns only."""
        visible, active = apply_filters(self.df, filters)
        rows = self.clasificacion.filter(F.col("columna").isin(list(columns))).select(
            "columna", "tipo", "escala_orden").collect()
        counts = value_counts(visible, columns, self.compacto) if active else self.conteos.filter(
            F.col("columna").isin(list(columns)))
        plain, grouped = frequency_bundle(visible, [tuple(r) for r in rows], counts)
        return (restore_texts(visible)(plain) if self.compacto else plain), grouped

    def validate(self, filters: Iterable[Filter] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Findings in order, sources and score of the rows that pass the filters.

        The findings are a few rows; they are settled once, so that nothing stays persisted.
        """
        visible, _ = apply_filters(self.df, filters)
        found = local_rows(visible.sparkSession, [tuple(r) for r in quality.findings(visible).collect()], quality.FINDING)
        return quality.sorted_findings(found), quality.sources(visible), quality.score(found, visible.count())

    def export(self, folder: str, filters: Iterable[Filter] = (), fmt: str = "csv") -> None:
        """Write the filtered rows."""
        visible, _ = apply_filters(self.df, filters)
        (sinks.write_csv if fmt == "csv" else sinks.write_parquet)(visible, folder)

    def export_report(self, folder: str, filters: Iterable[Filter] = (), fmt: str = "parquet") -> None:
        """Write the data and the three report tables."""
        visible, active = apply_filters(self.df, filters)
        counts = value_counts(visible, compact=self.compacto).persist() if active else self.conteos
        profile = column_profile(visible, counts, self.clasificacion)
        tables = {
            "datos": visible, "clasificacion": report.classification_table(profile),
            "frecuencias": report.frequencies_table(counts, visible.columns, self.scales(),
                                                    restore_texts(visible) if self.compacto else None),
        }
        if numeric_columns(visible):
            tables["estadistica"] = report.statistics_table(numeric_summary(visible, counts=counts))
        sinks.write_report(tables, folder, fmt)
        if active:
            counts.unpersist()

    def save(self, catalog: Catalog, cliente: str, ruta: str, nombre_archivo: str, tamano_bytes: int = 0) -> str | None:
        types = {r["tipo"]: r["columnas"] for r in type_summary(self.clasificacion).collect()}
        return catalog.save(cliente, ruta, nombre_archivo, self.df.count(), len(self.df.columns), types, tamano_bytes)


def reopen(spark: SparkSession, catalog: Catalog, cliente: str, key: str, **options) -> Dataset | None:
    """Run today's analysis again on the stored source; nothing is saved anew."""
    entry = catalog.fetch(cliente, key)
    return None if entry is None else Dataset.open(spark, entry["ruta"], **options)


def analyse(
    df: DataFrame, counts: DataFrame | None = None, classification: DataFrame | None = None,
    scales: dict[str, Sequence[str]] | None = None, active: int = 0, restore=None,
) -> Analysis:
    """All report tables of one table over shared value counts.

    Counts and classification that are not given are persisted until :meth:`Analysis.close`.
    """
    held = []
    if counts is None:
        held.append(counts := value_counts(df).persist())
    if classification is None:
        held.append(classification := classify(df, counts=counts).persist())
    profile = column_profile(df, counts, classification)
    numeric = numeric_columns(df)
    return Analysis(
        columnas=profile.join(F.broadcast(samples(counts, restore)), "columna", "left"),
        resumen_numerico=numeric_summary(df, numeric, counts) if numeric else None,
        top_categorias=top_categories(counts, profile, scales=scales, restore=restore),
        correlacion=correlation(df, numeric),
        filtros=filter_options(df, counts, classification, restore),
        resumen=global_summary(df, profile),
        filtros_activos=active,
        guardadas=held,
    )
