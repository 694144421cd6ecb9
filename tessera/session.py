"""A session with the settings that the engine is tuned for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.ui.enabled": "false",
}


def session(master: str = "local[*]", **more: str) -> SparkSession:
    """On a cluster leave ``master`` to spark-submit and set shuffle partitions to two or three a core."""
    builder = SparkSession.builder.master(master).appName("tessera")
    for key, value in (SETTINGS | more).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def share_code(spark: SparkSession) -> None:
    """Let Python workers import this package even where it isn't on their path."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(p for p in (_ROOT, *paths) if p)
