"""Session factory: the settings every entry point of the library relies on."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

#: Settings that change results (time zone) or plans (adaptive execution); none names a machine.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def build(master: str | None = None, partitions: int | None = None, **extra: str) -> SparkSession:
    """A session with the library's defaults; master and shuffle partitions only where given."""
    builder = SparkSession.builder.appName("tremorline")
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel(os.environ.get("TREMORLINE_LOG", "ERROR"))
    return spark


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share, by `spark.checkpoint.dir`; a fresh local one only where they are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tremorline-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found
