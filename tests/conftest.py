import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from varscope.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "varscope-tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def mixed(spark):
    """Fifteen noise sensors in three parks: a code, a name, a grade, a count and a measure."""
    rows = [(f"S/{i:02d}", ("Olivar", "Ribera", "Cumbre")[i % 8 // 3], ("Grave", "Leve", "Moderado")[i % 3], i * 5 % 7 + 1,
             round(11.25 + 1.37 * i + 0.6 * (i % 4), 2)) for i in range(15)]
    return spark.createDataFrame(
        rows, "`ID Sensor` string, Parque string, `Nivel de Ruido` string, `Cantidad de Lecturas` bigint, `Temperatura Media` double")
