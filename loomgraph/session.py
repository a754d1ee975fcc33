"""Session settings that the engine is meant to run under."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", name: str = "loomgraph", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session with UTC times, adaptive plans and Arrow transfers; on a cluster the cluster's own settings win."""
    spark = (
        SparkSession.builder.master(master)
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
