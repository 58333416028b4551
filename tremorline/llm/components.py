"""Connected components of an edge table, by alternating star contractions in DataFrame operations.

Each round links every node to the smallest neighbour it knows (first from larger nodes, then from smaller ones) until
the edges no longer change; they then form one star per component. Minima are partial aggregates, so a node with very
many neighbours costs no more than others, and joins back to such a node are split by adaptive execution. Every
round is written to the shared folder, so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import textkit as K


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for each node of edges (a long, b long): root is the component's smallest node.

    Nulls and loops are ignored, so a node without a link to another is not in the result.
    """
    now = K.saved(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not mark["n"] or tuple(mark) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = tuple(mark)
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("m"))
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        now = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        now = K.saved(now, name)


def local(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node of its component, within one process."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        if (label[a] == low).all() and (label[b] == low).all():
            break
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
    return label
