"""SimHash near-duplicates: 64-bit fingerprints of 3-word shingles, linked at 3 or fewer differing bits.

Exact pairs come from vantage-point trees. A point and a radius part the fingerprints into those inside and those outside;
a fingerprint inside but within the link distance of the border is also sent outside, and by the triangle inequality
every linked pair then meets on one side. The top of the tree is built on the driver from a sample whose size
depends on the number of shards alone, and only decides which shard does which work; the shards' own trees do the rest down to
blocks that are compared in full. A part that no radius can divide is peeled ball by ball: fingerprints within the
distance of a centre are one component with it, so only those and the ring up to twice the distance are compared.

Work is on distinct fingerprints; copies cost nothing. Each shard returns a star of links per component it found, never
all pairs, and the components over all shards are computed by `components`. Each level of the tree leaves about `CHILD` of its
fingerprints on the larger side, copies at the border included; the depth is chosen so that shards hold `SHARD` at most at any size and are as many as partitions. A part
that no radius divides is one shard, whatever its size: fingerprints that all lie as near to each other as the links.

Defined results: null, empty or blank text has fingerprint zero, linked like any other; very long texts are read whole. component_id is
the smallest doc_id of the component; null where all its ids are null. Repeated rows each get their row; an empty table gives
none. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import textkit as K
from .components import components, local

NEAR, SHINGLE, SEED = 3, 3, 42
#: Fingerprints per shard aimed at, sampled per shard, and compared in full.
SHARD, SAMPLED, BLOCK = 20_000, 32, 256
#: Share of a node's fingerprints that its larger side holds, copies included, for fingerprints without structure.
CHILD = 0.64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LANES = np.uint64(0x0101010101010101)


def shingles(buf: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words joined by single spaces, and start, end and row of each shingle in them."""
    ws, we = K.words(buf, offsets)
    if not len(ws):
        return b"", ws, ws, ws
    size = we - ws + 1
    flat = _LOWER[np.append(buf, np.uint8(32))][K.ranges(ws, size)]
    end = np.cumsum(size) - 1
    flat[end] = 32
    start = end - size + 1
    row = K.rows_of(offsets, ws)
    per = np.bincount(row, minlength=len(offsets) - 1)
    left = np.cumsum(per)[row] - np.arange(len(ws))
    head = np.r_[True, row[1:] != row[:-1]]
    take = np.flatnonzero((left >= SHINGLE) | head)
    last = take + np.minimum(left[take], SHINGLE) - 1
    return flat.tobytes(), start[take], end[last], row[take]


def simhash(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The fingerprint of each row of a flat buffer."""
    import xxhash

    n = len(offsets) - 1
    data, start, end, row = shingles(buf, offsets)
    digest = xxhash.xxh64_digest
    h = np.frombuffer(b"".join([digest(data[a:b], SEED) for a, b in zip(start.tolist(), end.tolist(), strict=True)]), ">u8").astype(np.uint64)
    return majority(h, row, n)


def majority(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows the bits set in over half of its hashes; h is in order of row, rows without hashes are zero."""
    out = np.zeros(n, np.uint64)
    if not len(h):
        return out
    head = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    total = np.diff(np.r_[head, len(row)])
    place = np.arange(len(row)) - np.repeat(head, total)
    piece = np.flatnonzero(place % 255 == 0)  # at most 255 hashes, so that counts fit a byte
    owner = row[piece]
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    value = np.zeros(len(head), np.uint64)
    for s in range(8):  # eight counters side by side in each word
        lanes = np.add.reduceat((h >> np.uint64(s)) & _LANES, piece).astype("<u8").view(np.uint8).reshape(-1, 8)
        count = np.add.reduceat(lanes, first, axis=0, dtype=np.int64)
        for j in range(8):
            value |= (2 * count[:, j] > total).astype(np.uint64) << np.uint64(8 * j + s)
    out[row[head]] = value
    return out


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets, _ = K.flat(batch.column("text"))
        out = [simhash(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in K.chunks(offsets)]
        found = np.concatenate(out) if out else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(found.view(np.int64))], names=["doc_id", "text_key", "print"])


def prints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, print) in one narrow pass; the 64 bits as a signed long, text_key a plain hash of the text."""
    K.ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key")).mapInArrow(_prints, "doc_id long, text_key long, print long")


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def split(points: np.ndarray, rng: np.random.Generator, near: int = NEAR, tries: int = 4) -> tuple[np.uint64, int, float]:
    """A vantage point and radius, and the share of the points on the larger side with its copies."""
    best = (points[0], 0, 1.0)
    for vantage in rng.choice(points, min(tries, len(points)), replace=False):
        below = np.cumsum(np.bincount(distance(points, vantage), minlength=65))
        inside = below / len(points)
        outside = 1 - inside + inside - np.concatenate([np.zeros(near), inside[:-near]])  # with the copies of (radius - near, radius]
        worst = np.maximum(inside, outside)
        radius = int(np.argmin(worst))
        if worst[radius] < best[2]:
            best = (vantage, radius, float(worst[radius]))
    return best


class Top:
    """The upper levels of a vantage-point tree as arrays; leaves are shard numbers."""

    def __init__(self, sample: np.ndarray, depth: int, near: int = NEAR):
        self.vantage, self.radius, self.inner, self.outer, self.shards, self.near = [], [], [], [], 0, near
        self._grow(sample, depth, np.random.default_rng(7))
        self.vantage, self.radius, self.inner, self.outer = np.array(self.vantage, np.uint64), *(np.array(x, np.int64) for x in (self.radius, self.inner, self.outer))

    def _grow(self, sample: np.ndarray, depth: int, rng: np.random.Generator) -> int:
        """The new node's number, or -1 - shard for a leaf."""
        if depth > 0 and len(sample) > 1:
            vantage, radius, worst = split(sample, rng, self.near)
            if worst < 0.95:
                node = len(self.vantage)
                self.vantage.append(vantage), self.radius.append(radius), self.inner.append(0), self.outer.append(0)
                d = distance(sample, vantage)
                self.inner[node] = self._grow(sample[d <= radius], depth - 1, rng)
                self.outer[node] = self._grow(sample[d > radius - self.near], depth - 1, rng)
                return node
        self.shards += 1
        return -self.shards

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shard, index of point) for the home shard of each point and those whose border it is near."""
        index, node = np.arange(len(points)), np.full(len(points), 0 if len(self.vantage) else -1)
        shard, who = [], []
        while len(index):
            done = node < 0
            shard.append(-1 - node[done]), who.append(index[done])
            index, node = index[~done], node[~done]
            d = distance(points[index], self.vantage[node]).astype(np.int64) if len(index) else np.zeros(0, np.int64)
            inside, outside = d <= self.radius[node], d > self.radius[node] - self.near
            index, node = np.r_[index[inside], index[outside]], np.r_[self.inner[node[inside]], self.outer[node[outside]]]
        return np.concatenate(shard), np.concatenate(who)


def _within(points: np.ndarray, left: np.ndarray, right: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs between two index lists, in blocks."""
    a, b = [], []
    for i in range(0, len(left), 1024):
        for j in range(0, len(right), 4096):
            x, y = np.nonzero(distance(points[left[i : i + 1024], None], points[None, right[j : j + 4096]]) <= near)
            a.append(left[i + x]), b.append(right[j + y])
    return (np.concatenate(a), np.concatenate(b)) if a else (left[:0], left[:0])


def links(points: np.ndarray, near: int = NEAR) -> np.ndarray:
    """For each distinct point the smallest index in its component of links, by a vantage-point tree."""
    rng = np.random.default_rng(11)
    label = np.arange(len(points))
    pending: list[tuple[np.ndarray, np.ndarray]] = []

    def merge() -> None:
        nonlocal label
        pending.append((np.arange(len(points)), label))
        label = local(len(points), np.concatenate([p[0] for p in pending]), np.concatenate([p[1] for p in pending]))
        pending.clear()

    def add(a: np.ndarray, b: np.ndarray) -> None:
        pending.append((a, b))
        if sum(len(p[0]) for p in pending) > 4 * len(points) + 100_000:
            merge()

    stack = [np.arange(len(points))]
    while stack:
        own = stack.pop()
        if len(own) < 2:
            continue
        if len(own) <= BLOCK:
            x, y = np.nonzero(np.triu(distance(points[own, None], points[None, own]) <= near, 1))
            add(own[x], own[y])
            continue
        vantage, radius, worst = split(points[own], rng, near)
        if worst < 0.9:
            d = distance(points[own], vantage)
            stack += [own[d <= radius], own[d > radius - near]]
            continue
        while len(own):  # peel a ball: its members are linked to the centre, the ring around it is compared
            d = distance(points[own], points[own[0]])
            ball = own[d <= near]
            add(np.full(len(ball), own[0]), ball)
            add(*_within(points, ball, own[(d > near) & (d <= 2 * near)], near))
            own = own[d > near]
    merge()
    return label


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard: the links of each shard as a star per component."""

    def finish(parts: list[np.ndarray]) -> pa.RecordBatch:
        points = np.unique(np.concatenate(parts)).view(np.uint64)
        label = links(points)
        tied = np.flatnonzero(label != np.arange(len(points)))
        return pa.RecordBatch.from_arrays([pa.array(points[tied].view(np.int64)), pa.array(points[label[tied]].view(np.int64))], names=["a", "b"])

    shard, held = None, []
    for batch in batches:
        numbers, points = batch.column("shard").to_numpy(), batch.column("print").to_numpy()
        edges = np.r_[0, np.flatnonzero(np.diff(numbers)) + 1, len(numbers)]
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if i == j:
                continue
            if held and numbers[i] != shard:
                yield finish(held)
                held = []
            shard = numbers[i]
            held.append(points[i:j])
    if held:
        yield finish(held)


def pair_links(points: DataFrame, count: int) -> DataFrame:
    """Links (a, b) of the distinct prints: enough of them to span every component, none between unlinked prints."""
    spark = points.sparkSession
    enough = max(np.log(max(1.0, count / SHARD)) / -np.log(CHILD), np.log2(K.partitions(spark)))
    depth = int(max(0, min(np.ceil(enough), np.log2(max(1.0, count / (4 * BLOCK))))))
    share = min(1.0, SAMPLED * (1 << depth) / max(1, count))
    unit = F.pmod(F.xxhash64(F.col("print"), F.lit(1)), F.lit(1 << 40)) / float(1 << 40)
    sample = np.array([r[0] for r in points.where(unit < share).select("print").collect()], np.int64) if depth else np.zeros(0, np.int64)  # SAMPLED rows per shard
    top = spark.sparkContext.broadcast(Top(np.sort(sample).view(np.uint64), depth))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("print").to_numpy()
            shard, who = top.value.route(values.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(values[who])], names=["shard", "print"])

    routed = points.select("print").mapInArrow(route, "shard int, print long")
    return routed.repartition(max(K.partitions(spark), 1), "shard").sortWithinPartitions("shard").mapInArrow(_shards, "a long, b long")


def clusters(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, print, root (a print that names the component) and component_id of each document."""
    own = K.saved(prints(docs), "prints")
    points = K.saved(own.groupBy("print").agg(F.min("doc_id").alias("least")), "points")
    roots = components(pair_links(points, points.count()), "simhash-links")
    points = points.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    least = points.groupBy("root").agg(F.min("least").alias("component_id"))
    return own.join(points.join(least, "root").select("print", "root", "component_id"), "print")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each document."""
    return clusters(docs).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies.

    Near copies are those of `near`: texts linked by fingerprints of 5-word shingles or by bands, verified by exact Jaccard
    similarity. Rows with a null id come after all others. One row stays even where ids and texts
    repeat; null and blank texts are one group; an empty table stays empty; extra columns go.
    """
    from . import near

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = docs.select(*columns)
    found = K.saved(near.clusters(docs), "clusters")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("text_key").alias("_key"))).alias("best")
    keys = found.groupBy("root").agg(first).select("best.*")
    keyed = docs.withColumns({"_none": F.col("doc_id").isNull(), "_id": F.coalesce("doc_id", F.lit(0)).cast("long"), "_key": F.xxhash64("text")})
    kept = keyed.join(keys, ["_none", "_id", "_key"], "left_semi").select(*columns)
    repeated = found.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept
