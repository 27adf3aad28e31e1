"""Session factory for tests, the bench and scripts."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "folioqc") -> SparkSession:
    """A session with adaptive execution on, UTC times and Arrow transfer.

    On a cluster leave ``master`` to spark-submit and build the session there; every operator
    takes the session it is given and changes no setting that holds beyond its own query.
    """
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
