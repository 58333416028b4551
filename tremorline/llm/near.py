"""Near copies of whole documents: exact Jaccard similarity of 5-word shingles, `SIMILAR` or more.

1. Each text is named by a hash of its words (A-Z lower-cased); texts of the same words are one from the start.
2. Candidates are groups of texts: those whose SimHash fingerprints of 5-word shingles the vantage-point trees of `simhash` link, and those
   that share one of `BANDS` bands of `ROWS` minima of their shingles. SimHash alone cannot reach this similarity: at 0.8 the
   fingerprints differ in some 10 of 64 bits, and a radius that takes them in leaves a tree nothing to cut off; a pair of
   similarity 0.8 shares a band with probability 0.997, one of 0.9 with 0.9999.
3. Of groups with the same members one stays. Shingle sets travel only for texts in a group, and each group's texts are verified
   exactly, as in `paragraphs`: no pair below the similarity is linked.
4. Components of the verified links are the groups of near copies.

Defined results: texts below 5 words match only equal words; null, empty and blank texts are one text without words; very long texts are read
whole; rows with equal ids and texts are one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit as K
from .components import components
from .paragraphs import SHINGLE, _colliding, _maybe_broadcast, _verifier
from .simhash import _LOWER, majority, pair_links

BANDS, ROWS = 8, 3
_SEEDS = K.mix(np.arange(101, BANDS * ROWS + 101, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class Texts:
    """All texts of a flat buffer: their names, and shingles of those of SHINGLE words or more (rows `row`)."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        low = _LOWER[buf]
        ws, we = K.words(buf, offsets)
        n = len(ws)
        h = K.Ranges(low)(ws, we)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(h * K.powers(n, K.BASES[1], False), out=self.sums[1:])
        self.inverse = K.powers(n + 1, K.BASES[1], True)
        per = np.bincount(K.rows_of(offsets, ws), minlength=len(offsets) - 1)
        begin = np.cumsum(per) - per
        self.name = self.over(begin, begin + per)
        self.row = np.flatnonzero(per >= SHINGLE)
        self.count = per[self.row] - SHINGLE + 1
        i = K.ranges(begin[self.row], self.count)
        self.shingles = self.over(i, i + SHINGLE)
        self.at = np.cumsum(self.count) - self.count

    def over(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return K.mix((self.sums[j] - self.sums[i]) * self.inverse[i] + (j - i).astype(np.uint64))

    def prints(self) -> np.ndarray:
        """SimHash fingerprints [rows]."""
        return majority(self.shingles, np.repeat(np.arange(len(self.row)), self.count), len(self.row))

    def keys(self) -> np.ndarray:
        """Band keys [rows, BANDS]."""
        out = np.zeros((len(self.row), BANDS), np.uint64)
        for b in range(BANDS if len(out) else 0):
            for seed in _SEEDS[b * ROWS : (b + 1) * ROWS]:
                out[:, b] = out[:, b] * np.uint64(0x100000001B3) + K.mix(np.minimum.reduceat(self.shingles * seed, self.at))
            out[:, b] = K.mix(out[:, b] + np.uint64(b))
        return out


def _each(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Texts]]:
    buf, offsets, _ = K.flat(batch.column("text"))
    for i, j in K.chunks(offsets):
        yield i, j, Texts(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, t in _each(batch):
            length, mark, has = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64), np.zeros(j - i, bool)
            length[t.row], mark[t.row], has[t.row] = BANDS, t.prints().view(np.int64), True
            keys = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)].astype(np.int32)), pa.array(t.keys().ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(c).slice(i, j - i) for c in ("doc_id", "text_key")] + [pa.array(t.name.view(np.int64)), pa.array(mark, mask=~has), keys], names=["doc_id", "text_key", "pid", "print", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, t in _each(batch):
            sets = [np.unique(t.shingles[a : a + n]).view(np.int64) for a, n in zip(t.at.tolist(), t.count.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(t.name[t.row].view(np.int64)), pa.array(sets, pa.list_(pa.int64()))], names=["pid", "shingles"])


def _groups(own: DataFrame) -> DataFrame:
    """(key, pid): candidate groups of several texts, each set of members once. own: pid, print, keys."""
    n = K.partitions(own.sparkSession)
    prints = K.saved(own.where("print is not null").select("pid", "print").distinct(), "near-prints")
    points = K.saved(prints.select("print").distinct(), "near-points")
    roots = components(pair_links(points, points.count()), "near-prints-linked").withColumnRenamed("node", "print")
    alike = prints.join(roots, "print", "left").select(F.xxhash64(F.lit("print"), F.coalesce("root", "print")).alias("key"), "pid")
    keys = own.select(F.explode("keys").alias("key"), "pid").unionByName(alike)
    found = K.saved(keys.repartition(n, "key").sortWithinPartitions("key", "pid").mapInArrow(_colliding, "key long, pid long"), "near-colliding")
    members = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("pid").cast("decimal(20,0)")).alias("h"), F.min("pid").alias("p"))
    return found.join(members.groupBy("n", "h", "p").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")


def clusters(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a plain hash of the text) and root, which names the group of near copies, of each document."""
    spark = docs.sparkSession
    K.ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    own = K.saved(docs.mapInArrow(_names, "doc_id long, text_key long, pid long, print long, keys array<long>"), "names")
    found = K.saved(_groups(own), "near-groups")
    one = own.join(found.select("pid").distinct(), "pid").groupBy("pid").agg(F.min("text_key").alias("text_key")).select("text_key").distinct()
    wanted = docs.join(_maybe_broadcast(K.saved(one, "near-texts")), "text_key", "left_semi").select("text")
    sets = wanted.mapInArrow(_sets, "pid long, shingles array<long>").dropDuplicates(["pid"])
    verified = found.join(sets, "pid").select("key", "pid", "shingles").repartition(K.partitions(spark), "key").sortWithinPartitions("key", "pid").mapInArrow(_verifier(3, 8), "a long, b long")
    roots = components(verified, "near-links").withColumnRenamed("node", "pid")
    return own.select("doc_id", "text_key", "pid").join(roots, "pid", "left").select("doc_id", "text_key", F.coalesce("root", "pid").alias("root"))
