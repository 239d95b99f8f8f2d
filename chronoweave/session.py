"""Session defaults shared by the bench, the tests and interactive use."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC because every as-of rule floors to UTC days; AQE re-plans skewed joins and small partitions.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str = "local[8]", shuffle_partitions: int = 8, driver_memory: str = "8g", **extra: str) -> SparkSession:
    """A session with this package's defaults; ``extra`` wins over them."""
    builder = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", shuffle_partitions).config("spark.driver.memory", driver_memory)
    for key, value in (DEFAULTS | extra).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
