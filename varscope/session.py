"""Session helpers: a builder for scripts and tests, and the checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", app: str = "varscope", **conf: str) -> SparkSession:
    """Session for tests and benchmarks. On a cluster use the session you are given."""
    n = 8 if cores == "*" else int(cores)
    settings = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def freeze(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint.

    The folder is the one the session names in ``spark.checkpoint.dir``; only when the session
    names none (a test on one machine) is a temporary folder used.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get(CHECKPOINT_KEY, None)
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="varscope-checkpoint-"))
    return df.checkpoint(eager=True)
