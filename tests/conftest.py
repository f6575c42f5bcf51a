import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]


@pytest.fixture(scope="session")
def spark():
    from scriptmill.session import configure

    session = configure(SparkSession.builder.master("local[4]").config(
        "spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config(
        "spark.driver.memory", "8g")).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def apply(spark):
    """Values of a column function over literal inputs."""
    def run(fn, values, schema="x string"):
        rows = [v if isinstance(v, tuple) else (v,) for v in values]
        names = [part.split()[0] for part in schema.split(", ")]
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
        return [r[0] for r in df.orderBy("i").select(fn(*names)).collect()]
    return run
