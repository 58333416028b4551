"""Exact substring dedup by depth-limited radix sort of suffixes.

A byte goes if a string of `WIDTH` bytes that covers it also starts earlier (smaller document, or earlier in the same
one). Suffixes are ordered only through WIDTH bytes, and groups still equal at that depth are the repeated strings:

1. The most significant digit. Each WIDTH-byte window is keyed by its least `GRAM`-byte gram (by hash, leftmost first),
   which equal windows share. Neighbouring windows with the same gram at the same place form a run, about one per 38
   bytes of text; only (gram, hash of the run's bytes, place) is shuffled, and of a document's runs with equal bytes only the first: the
   others repeat it. Runs with equal bytes are repeats of the first of them, whole; a run whose gram occurs with no other bytes has
   no repeats. Equal means equal in two 64-bit hashes by different bases, of the gram and of the run: bytes are not compared here.
2. The remaining digits. For runs that share a gram but not their bytes, and only those, the bytes are fetched and their windows
   sorted by 8-byte digits, most significant first, groups of one leaving after each pass.
3. Repeated windows of each document are merged to spans and cut from its text.

Hot grams: a 1/64 sample of documents estimates how many runs a gram has; a document sends a gram once for each of its contents, so only
many documents make a gram hot. Runs of a gram above `HOT` are dealt by
(gram, bytes, salt) instead of by gram, and their windows are decided by a partial aggregate (the least place of each 128-bit
window hash) joined back, so no task holds all runs of a common passage. The sample only chooses the way; both are exact up
to collisions of hashes.

Defined results: null text is empty; matches never cross documents. Rows with the same doc_id and text are one
document, and each gets its result. Where ids repeat with different texts or are null, documents are ordered by id (null first), then a hash of
the text. Very long texts are read whole, in overlapping tiles; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit as K

WIDTH, GRAM = 100, 24
HOT, SALT, SAMPLE = 50_000, 64, 64
TILE = 1 << 22
#: Bits of a key that hold its place, in buffers of any length: the others, of its hash, choose the least, so equal texts choose alike everywhere.
PLACE = np.uint64(32)


def _sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of `width` values, from minima of blocks' prefixes and suffixes."""
    m = len(key)
    blocks = np.full(-(-m // width) * width, ~np.uint64(0))
    blocks[:m] = key
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: m - width + 1], ahead[width - 1 : m])


def runs(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start in buf, number of windows, gram hash and hash of the bytes of each run of windows."""
    n = len(buf)
    if n < WIDTH:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64), z.astype(np.uint64)
    gram = K.Ranges(buf).window(GRAM)
    least = _sliding_min(gram >> PLACE << PLACE | np.arange(len(gram), dtype=np.uint64), WIDTH - GRAM + 1)
    at = (least & ((np.uint64(1) << PLACE) - np.uint64(1))).astype(np.int64)
    good = np.ones(n - WIDTH + 1, bool)
    ends = np.unique(offsets[1:])
    bad = K.ranges(np.maximum(ends - WIDTH + 1, 0), ends - np.maximum(ends - WIDTH + 1, 0))
    good[bad[bad < len(good)]] = False
    begin = good.copy()
    begin[1:] &= ~good[:-1] | (at[1:] != at[:-1])
    last = good.copy()
    last[:-1] &= ~good[1:] | begin[1:]
    start, stop = np.flatnonzero(begin), np.flatnonzero(last)
    return start, stop - start + 1, gram[at[start]], K.Ranges(buf, 1)(start, stop + WIDTH)


def _tiles(buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, place of the tile in it, bytes, offsets); very long rows come in overlapping tiles."""
    for i, j in K.chunks(offsets):
        a, b = int(offsets[i]), int(offsets[j])
        if b - a <= TILE:
            yield i, 0, buf[a:b], offsets[i : j + 1] - a
            continue
        for t in range(a, b - WIDTH + 1, TILE):
            e = min(t + TILE + WIDTH - 1, b)
            yield i, t - a, buf[t:e], np.array([0, e - t])


def _again(row: np.ndarray, gram: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Which runs, in order of place, have the bytes of an earlier one of their row."""
    key = K.mix(full + row.astype(np.uint64) * np.uint64(K.BASES[0]))
    order = np.argsort(key, kind="stable")
    k, g = key[order], gram[order]
    out = np.zeros(len(row), bool)
    out[order[1:]] = (k[1:] == k[:-1]) & (g[1:] == g[:-1])
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs that are the first of their document with their bytes; and, as ~loc with gram 0, runs of windows that repeat such ones."""
    for batch in batches:
        buf, offsets, _ = K.flat(batch.column("text"))
        rid = batch.column("rid").to_numpy()
        for first, place, part, ends in _tiles(buf, offsets):
            start, count, gram, full = runs(part, ends)
            row = K.rows_of(ends, start)
            at, owner = start - ends[row] + place, rid[first + row]
            again = _again(row, gram, full)
            new = ~again
            yield pa.RecordBatch.from_arrays([pa.array(gram[new].view(np.int64)), pa.array(full[new].view(np.int64)), pa.array(owner[new]), pa.array(at[new] << 8 | count[new])], names=["gram", "full", "rid", "loc"])
            if again.any():
                late = _marks(np.repeat(owner[again], count[again]), K.ranges(at[again], count[again]))
                zero = pa.array(np.zeros(late.num_rows, np.int64))
                yield pa.RecordBatch.from_arrays([zero, zero, late.column("rid"), pa.array(~late.column("loc").to_numpy())], names=["gram", "full", "rid", "loc"])


def _decider(hot: np.ndarray):
    """Over rows sorted by (gram, full, rid, loc): kind 0 repeated whole, 1 to be compared, 2 to be compared (hot gram)."""

    def decide(gram: np.ndarray, full: np.ndarray, rid: np.ndarray, loc: np.ndarray) -> pa.RecordBatch:
        new_gram = np.r_[True, gram[1:] != gram[:-1]]
        first = np.flatnonzero(new_gram | np.r_[True, full[1:] != full[:-1]])
        size = np.diff(np.r_[first, len(gram)])
        repeat = (rid != np.repeat(rid[first], size)) | (loc != np.repeat(loc[first], size))
        group = np.cumsum(new_gram)[first] - 1
        several = np.bincount(group)[group] > 1
        is_hot = np.isin(gram[first], hot)
        kind = np.where(repeat, 0, -1)
        kind[first] = np.where(is_hot, 2, np.where(several, 1, -1))
        out = np.flatnonzero(kind >= 0)
        return pa.RecordBatch.from_arrays([pa.array(rid[out]), pa.array(loc[out]), pa.array(kind[out].astype(np.int32)), pa.array(np.where(kind[out] > 0, gram[out], 0))], names=["rid", "loc", "kind", "gram"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(c).to_numpy() for c in ("gram", "full", "rid", "loc")]
            late = now[3] < 0  # decided within its document
            if late.any():
                n = int(late.sum())
                yield pa.RecordBatch.from_arrays([pa.array(now[2][late]), pa.array(~now[3][late]), pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, np.int64))], names=["rid", "loc", "kind", "gram"])
                now = [x[~late] for x in now]
                if not len(now[0]):
                    continue
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            cut = int(np.flatnonzero(now[0] != now[0][-1])[-1]) + 1 if now[0][0] != now[0][-1] else 0  # the last gram may go on
            if cut:
                yield decide(*[x[:cut] for x in now])
            held = [x[cut:] for x in now]
        if held is not None:
            yield decide(*held)

    return run


def repeated_windows(buf: np.ndarray, start: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which windows (in order of place) have an equal earlier one in their group: most-significant-digit passes."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)]).tobytes()
    digits = np.ndarray((len(buf) + 1,), ">u8", padded, strides=(1,))
    live, own = np.arange(len(start)), group
    for depth in range(0, WIDTH, 8):
        digit = digits[start[live] + depth].astype(np.uint64)
        if depth + 8 > WIDTH:
            digit >>= np.uint64(8 * (depth + 8 - WIDTH))
        order = np.lexsort((digit, own))  # stable: places stay in order
        live, own, digit = live[order], own[order], digit[order]
        new = np.r_[True, (own[1:] != own[:-1]) | (digit[1:] != digit[:-1])] if len(live) else np.zeros(0, bool)
        number = np.cumsum(new) - 1
        keep = np.bincount(number)[number] > 1 if len(live) else new
        live, own = live[keep], number[keep]
        if not len(live):
            break
    out = np.zeros(len(start), bool)
    if len(live):
        out[live[np.r_[False, own[1:] == own[:-1]]]] = True
    return out


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted runs of each text."""
    for batch in batches:
        buf, offsets, _ = K.flat(batch.column("text"))
        rid = batch.column("rid").to_numpy()
        want = batch.column("want")
        row = np.repeat(np.arange(batch.num_rows), np.diff(want.offsets.to_numpy()))
        flat = want.flatten()
        loc, kind, gram = (flat.field(c).to_numpy() for c in ("loc", "kind", "gram"))
        data = buf.tobytes()
        place, count = loc >> 8, loc & 255
        begin = offsets[row] + place
        for i in range(0, len(row), 20_000):
            at = slice(i, i + 20_000)
            content = [data[b : b + n + WIDTH - 1] for b, n in zip(begin[at].tolist(), count[at].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(gram[at]), pa.array(kind[at]), pa.array(rid[row[at]]), pa.array(loc[at]), pa.array(content, pa.binary())], names=["gram", "kind", "rid", "loc", "content"])


def _marks(rid: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Runs of neighbouring repeated windows, of at most 255 each."""
    order = np.lexsort((place, rid))
    rid, place = rid[order], place[order]
    number = np.cumsum(np.r_[True, (rid[1:] != rid[:-1]) | (place[1:] != place[:-1] + 1)]) if len(rid) else place
    head = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(rid) else place
    inside = np.arange(len(rid)) - np.repeat(head, np.diff(np.r_[head, len(rid)]))
    head = np.flatnonzero(inside % 255 == 0)
    count = np.diff(np.r_[head, len(rid)])
    return pa.RecordBatch.from_arrays([pa.array(rid[head]), pa.array(place[head] << 8 | count)], names=["rid", "loc"])


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (gram, rid, loc): radix passes over whole groups, many at a time."""

    def work(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        gram, rid, loc = (table.column(c).to_numpy() for c in ("gram", "rid", "loc"))
        buf, offsets, _ = K.flat(table.column("content"))
        count = loc & 255
        row = np.repeat(np.arange(len(gram)), count)
        start = K.ranges(offsets[:-1], count)
        place = K.ranges(loc >> 8, count)
        group = (np.cumsum(np.r_[True, gram[1:] != gram[:-1]]) - 1)[row]
        order = np.lexsort((place, rid[row], group))
        row, start, place, group = row[order], start[order], place[order], group[order]
        found = repeated_windows(buf, start, group)
        return _marks(rid[row[found]], place[found])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        gram = batch.column("gram").to_numpy()
        held.append(batch)
        size += batch.num_rows
        if size >= 20_000 and gram[0] != gram[-1]:
            cut = int(np.flatnonzero(gram != gram[-1])[-1]) + 1
            yield work([*held[:-1], batch.slice(0, cut)])
            held, size = [batch.slice(cut)], batch.num_rows - cut
    if held:
        yield work(held)


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 4000):
            part = batch.slice(i, 4000)
            loc, rid = part.column("loc").to_numpy(), part.column("rid").to_numpy()
            buf, offsets, _ = K.flat(part.column("content"))
            count = loc & 255
            start = K.ranges(offsets[:-1], count)
            h = [K.Ranges(buf, k)(start, start + WIDTH).view(np.int64) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(h[0]), pa.array(h[1]), pa.array(np.repeat(rid, count)), pa.array(K.ranges(loc >> 8, count))], names=["h0", "h1", "rid", "place"])


def _ranked(docs: DataFrame) -> DataFrame:
    """docs with rid, a long in the order of documents: doc_id itself, or ranks where ids repeat or are null."""
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if not ids.limit(1).count():
        return docs.withColumn("rid", F.col("doc_id"))
    keyed = docs.withColumns({"_none": F.col("doc_id").isNull(), "_id": F.coalesce("doc_id", F.lit(0)).cast("long"), "_key": F.xxhash64("text")})
    names = ["_none", "_id", "_key"]
    order = [F.desc("_none"), "_id", "_key"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(rows, part, np.int32)), pa.array(np.arange(n, n + rows))], names=[*batch.schema.names, "part", "i"])
            n += rows

    spark = docs.sparkSession
    rows = keyed.select(*names).distinct().repartitionByRange(K.partitions(spark), *order).sortWithinPartitions(*order)
    rows = K.saved(rows.mapInArrow(number, "_none boolean, _id long, _key long, part int, i long"), "ranks")
    sizes = sorted((r["part"], r["count"]) for r in rows.groupBy("part").count().collect())  # a row per partition
    offsets = np.r_[0, np.cumsum([n for _, n in sizes])]
    base = spark.createDataFrame([(p, int(o)) for (p, _), o in zip(sizes, offsets[:-1], strict=True)], "part int, base long")
    ranks = rows.join(F.broadcast(base), "part").select(*names, (F.col("base") + F.col("i")).alias("rid"))
    return keyed.join(ranks, names).drop(*names)


def _hot(texts: DataFrame, hot: int) -> np.ndarray:
    """Grams with more than `hot` runs, and more than a quarter of a partition's, by a 1/64 sample of documents."""
    found = texts.where(F.pmod(F.xxhash64("rid"), F.lit(SAMPLE)) == 0).select("rid", "text").mapInArrow(_runs, "gram long, full long, rid long, loc long").where("loc >= 0")
    counts = K.saved(found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sampled-grams")
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(hot, total * SAMPLE // (4 * K.partitions(texts.sparkSession))) / SAMPLE
    return np.array(sorted(r["gram"] for r in counts.where(F.col("n") > least).select("gram").collect()), np.int64)  # at most 4 per partition


def marks(texts: DataFrame, hot: int = HOT) -> DataFrame:
    """(rid, loc) of runs of windows that repeat earlier ones; loc is place << 8 | number of windows. texts: rid, text."""
    spark = texts.sparkSession
    n = K.partitions(spark)
    common = _hot(texts, hot)
    rows = texts.select("rid", "text").mapInArrow(_runs, "gram long, full long, rid long, loc long")
    deal = F.xxhash64("gram")
    if len(common):
        listed = F.broadcast(spark.createDataFrame([(int(x), True) for x in common], "gram long, common boolean"))
        rows = rows.join(listed, "gram", "left")
        deal = F.when(F.col("common"), F.xxhash64("gram", "full", F.pmod(F.xxhash64("rid"), F.lit(SALT)))).otherwise(deal)
    deal = F.when(F.col("loc") < 0, F.xxhash64("rid", "loc")).otherwise(deal)
    rows = rows.withColumn("deal", F.pmod(deal, F.lit(n)).cast("int")).select("deal", "gram", "full", "rid", "loc")
    dealt = rows.repartitionById(n, "deal").sortWithinPartitions("gram", "full", "rid", "loc").select("gram", "full", "rid", "loc")
    decided = K.saved(dealt.mapInArrow(_decider(common), "rid long, loc long, kind int, gram long"), "decided")
    want = decided.where("kind > 0").groupBy("rid").agg(F.collect_set(F.struct("loc", "kind", "gram")).alias("want"))
    content = texts.select("rid", "text").join(want, "rid").select("rid", "text", "want").mapInArrow(_fetch, "gram long, kind int, rid long, loc long, content binary")
    out = decided.where("kind = 0").select("rid", "loc")
    if len(common):
        content = K.saved(content, "content")
        windows = content.where("kind = 2").mapInArrow(_window_hashes, "h0 long, h1 long, rid long, place long")
        first = windows.groupBy("h0", "h1").agg(F.min(F.struct("rid", "place")).alias("first"))
        late = windows.join(first, ["h0", "h1"]).where(F.struct("rid", "place") != F.col("first"))
        out = out.unionByName(late.select("rid", (F.col("place") * 256 + 1).alias("loc")))
        content = content.where("kind = 1")
    compared = content.select("gram", "rid", "loc", "content").repartition(n, "gram").sortWithinPartitions("gram", "rid", "loc").mapInArrow(_sorted_groups, "rid long, loc long")
    return out.unionByName(compared)


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def covered(offsets: np.ndarray, row: np.ndarray, loc: np.ndarray) -> np.ndarray:
    """Which bytes the marked windows cover."""
    begin = offsets[row] + (loc >> 8)
    change = np.zeros(int(offsets[-1]) + 1, np.int32)
    np.add.at(change, begin, 1)
    np.add.at(change, begin + (loc & 255) + WIDTH - 1, -1)
    return np.cumsum(change)[:-1] > 0


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets, _ = K.flat(batch.column("text"))
        spans = batch.column("spans")
        sizes = np.array([0 if n is None else n for n in spans.value_lengths().to_pylist()], np.int64)
        loc = spans.flatten().to_numpy()
        row = np.repeat(np.arange(batch.num_rows), sizes)
        gone = covered(offsets, row, loc)
        start = gone.copy()
        start[1:] &= ~gone[:-1]
        inner = offsets[1:-1][offsets[1:-1] < len(buf)]
        start[inner] = gone[inner]
        removed, begun = np.r_[0, np.cumsum(gone)], np.r_[0, np.cumsum(start)]
        kept = buf[~gone].tobytes()
        left = (offsets - removed[offsets]).tolist()
        digests = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(left[:-1], left[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(np.diff(removed[offsets])), pa.array(np.diff(begun[offsets])), pa.array(digests, pa.string())], names=[c.split()[0] for c in OUT.split(", ")])


def dedup(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of what is left of each document."""
    K.ship(docs.sparkSession)
    texts = _ranked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    spans = marks(texts, hot).groupBy("rid").agg(F.collect_list("loc").alias("spans"))
    return texts.select("rid", "doc_id", "text").join(spans, "rid", "left").select("doc_id", "text", "spans").mapInArrow(_cut, OUT)
