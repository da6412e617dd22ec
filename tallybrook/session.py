"""Session settings the library is meant to run with."""

from __future__ import annotations

from pyspark.sql import SparkSession

# UTC keeps calendar days independent of the machine; the rest are Spark's own tools
# against skew and for partition sizes, on by default in recent releases.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cpus: str = "8", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine.

    On a cluster build the session yourself with ``SETTINGS`` and name a shared
    ``spark.checkpoint.dir``.
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tallybrook")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cpus)
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
