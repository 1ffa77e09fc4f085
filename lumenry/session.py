"""Session factory."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "lumenry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with this library's defaults; what conf names wins."""
    builder = SparkSession.builder.appName(app).config(map=DEFAULTS | conf)
    return (builder.master(master) if master else builder).getOrCreate()
