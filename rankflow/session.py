"""Session defaults of the engine."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive plans, one time zone, Arrow batches; sizes are left to the cluster's own settings.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "rankflow", **conf: str) -> SparkSession:
    """The running session, or a new one with the defaults and ``conf`` (dots as ``__``)."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def options(spark: SparkSession) -> dict[str, str]:
    """The settings that matter here, by name."""
    names = [*DEFAULTS, "spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.master"]
    return {n: spark.conf.get(n) for n in names}
