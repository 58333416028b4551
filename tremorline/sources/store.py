"""Fitted models as Parquet rows of JSON, and exports that replace the last good one only when they have rows."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F


def _plain(x):
    if isinstance(x, np.ndarray):
        return x.tolist()
    if isinstance(x, np.generic):
        return x.item()
    raise TypeError(type(x).__name__)


def save_models(spark: SparkSession, models: dict[str, dict], path: str) -> None:
    """One row per model: its name and its parameters."""
    rows = [(k, json.dumps(v, default=_plain)) for k, v in models.items()]
    spark.createDataFrame(rows, "name string, parameters string").coalesce(1).write.mode("overwrite").parquet(path)


def load_models(spark: SparkSession, path: str, names: list[str] | None = None) -> dict[str, dict]:
    rows = spark.read.parquet(path)
    rows = rows.where(F.col("name").isin(names)) if names else rows
    return {r["name"]: json.loads(r["parameters"]) for r in rows.collect()}


def export(df: DataFrame, path: str, kind: str = "csv") -> int:
    """Replace an export; with no rows nothing is touched and an error is raised."""
    n = df.count()
    if not n:
        raise ValueError("no rows to export; the last export stays")
    df.write.mode("overwrite").format(kind).options(**({"header": "true"} if kind == "csv" else {})).save(path)
    return n
