"""Session settings that the engine relies on."""

from pyspark.sql import SparkSession


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    b = SparkSession.builder.master(master).appName("sparktide")
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.enabled": "false"}
    for k, v in {**settings, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()
