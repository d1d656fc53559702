"""The report tables: classification, statistics and frequencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from varscope.functions.columns import number_text
from varscope.operators.frequencies import frequency_tables

NO_MODE = "Sin moda"
REPORT_COLUMNS = 10
REPORT_VALUES = 100


def classification_table(profile: DataFrame) -> DataFrame:
    """Nine fields per column, in table order."""
    return profile.orderBy("pos").select(
        F.col("columna").alias("Columna"), F.col("tipo").alias("Tipo de variable"), F.col("rol").alias("Rol"),
        F.col("confianza").alias("Confianza"), F.col("justificacion").alias("Justificación"),
        F.col("tipo_dato").alias("Tipo de dato"), F.col("unicos").alias("Valores únicos"),
        F.col("nulos").alias("Nulos"), F.col("porcentaje_nulos").alias("% Nulos"),
    )


def statistics_table(summary: DataFrame) -> DataFrame:
    """Eighteen fields per numeric column; modes in one cell."""
    # Modes are at most ten numbers, so the text is assembled on the one row of their column.
    modes = summary.select("columna", F.posexplode_outer("moda").alias("_i", "_m")).withColumn(
        "_t", number_text("_m")).groupBy("columna").agg(
        F.array_sort(F.collect_list(F.struct("_i", "_t"))).alias("_l")).select(
        "columna", F.array_join(F.transform("_l", lambda s: s["_t"]), ", ").alias("_moda"))
    rows = summary.join(F.broadcast(modes), "columna", "left")
    names = {
        "Columna": "columna", "N": "conteo", "Media": "media", "Mediana": "mediana", "Moda": None,
        "Desv. estándar": "desviacion_estandar", "Varianza": "varianza", "Mínimo": "minimo",
        "Máximo": "maximo", "Rango": "rango", "Q1": "q1", "Q2": "q2", "Q3": "q3", "IQR": "iqr",
        "Coef. variación": "coeficiente_variacion", "Asimetría": "asimetria", "Curtosis": "curtosis",
        "Atípicos": "atipicos",
    }
    mode = F.coalesce(F.nullif("_moda", F.lit("")), F.lit(NO_MODE))
    return rows.select(*[(mode if c is None else F.col(c)).alias(n) for n, c in names.items()])


def frequencies_table(
    counts: DataFrame, columns: Sequence[str], scales: dict[str, Sequence[str]] | None = None, restore=None
) -> DataFrame:
    """First hundred values in display order of the first ten columns."""
    shown = list(columns[:REPORT_COLUMNS])
    tables = frequency_tables(counts.filter(F.col("columna").isin(shown)), REPORT_VALUES, scales)
    tables = restore(tables) if restore else tables
    place = F.array_position(F.array(*[F.lit(c) for c in shown]), F.col("columna"))
    return tables.orderBy(place, "orden").select(
        F.col("columna").alias("Columna"), F.col("valor").alias("Valor"),
        F.col("frecuencia_absoluta").alias("Frec. absoluta"),
        F.col("frecuencia_relativa").alias("Frec. relativa"),
        F.col("frecuencia_acumulada").alias("Frec. acumulada"),
        F.col("frecuencia_relativa_acumulada").alias("Frec. rel. acumulada"),
    )
