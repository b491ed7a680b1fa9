"""Session settings that the engine relies on; everything else is the cluster's own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("cadenza")
    if master:
        builder = builder.master(master)
    wanted = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    # plans are built from thousands of column expressions; noting the Python line of each takes longer than the rest
    wanted |= {"spark.python.sql.dataFrameDebugging.enabled": "false"} | conf
    return builder.config(map=wanted).getOrCreate()
