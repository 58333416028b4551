"""Near-duplicate passages by MinHash banding of paragraphs.

Paragraphs are defined by content: a text's words are cut before each word whose two-word hash is the least of some
`WINDOW` consecutive ones, so a passage repeated inside other text yields the same paragraphs there as elsewhere, wherever
line breaks fall. Paragraphs of at least `LEAST` words take part, as sets of 5-word shingles (A-Z lower-cased).

1. `BANDS` bands of `ROWS` minima each give a paragraph its keys (recall 0.97 at similarity 0.8, 0.998 at 0.9). Keys held by
   two or more distinct paragraphs are kept.
2. The shingle sets of those paragraphs are fetched and each key's paragraphs verified by exact Jaccard similarity of
   `SIMILAR` or more. In a large group only members that share a rare shingle and are not linked already are compared (see `filtered`), and
   middling groups are peeled ball by ball, for Jaccard distance is a metric (see `linked`); neither loses a component. All distinct paragraphs
   of a key are in one task, so a key's variants are bounded by an executor's memory; copies of a paragraph are one from the start.
3. Verified links are clustered by components. In each cluster the first occurrence (smallest document, earliest word) stays and the
   others are repeats.
4. Each repeat is extended in both directions, up to `REACH` words a side, while its words equal those around the occurrence that stays: over
   pieces too short to take part, and to the passage's ends inside pieces that reach past it. It goes on over changed, added and dropped
   words where `SHINGLE` equal ones follow and the whole repeat keeps an exact Jaccard similarity of `SIMILAR` (see `alike`), so an edited
   passage goes as one and not in fragments.
5. Extended repeats that adjoin in a document form runs; runs of at least `RUN` words are removed. Shorter ones, such as a
   common line, stay. A passage none of whose pieces takes part whole is missed.

Defined results: null, empty and blank texts have no paragraphs; very long texts are read whole. Rows with the same doc_id and text are one
document; ids that repeat with different texts or are null are ordered as in `substrings`. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from . import textkit as K
from .components import components, local
from .simhash import _LOWER
from .substrings import PLACE, _ranked, _sliding_min

WINDOW, LEAST, SHINGLE, RUN = 16, 8, 5, 16
BANDS, ROWS, SIMILAR = 5, 3, 0.8
#: Groups of at most so many paragraphs are compared pair by pair, all in one step; larger ones are filtered and peeled.
PAIRED = 48
#: Words that a repeat is extended by on each side; equal text further on has paragraphs of its own.
REACH = 64
#: Words passed over on either side where a repeat differs: one changed, added or dropped first, then two, then unequal numbers.
STEPS = ((1, 1), (1, 0), (0, 1), (2, 2), (2, 0), (0, 2), (2, 1), (1, 2), (3, 3))
#: Shingles of whole keys that one step verifies, about.
HELD = 400_000
#: Shingles that one step of exact similarities compares, about.
STEP = 500_000
#: At most so many (paragraph, cluster) or (paragraph) rows are broadcast.
SMALL = 200_000
_SEEDS = K.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class Units:
    """Paragraphs of all rows of a flat buffer: row, first and last word, bytes, and hashes over words."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        low = _LOWER[buf]
        self.ws, self.we = K.words(buf, offsets)
        n = len(self.ws)
        self.word_row = K.rows_of(offsets, self.ws)
        h = K.Ranges(low)(self.ws, self.we)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(h * K.powers(n, K.BASES[1], False), out=self.sums[1:])
        self.inverse = K.powers(n + 1, K.BASES[1], True)
        head = np.r_[True, self.word_row[1:] != self.word_row[:-1]] if n else np.zeros(0, bool)
        cut = head.copy()
        if n >= WINDOW + 1:
            pair = self.over(np.arange(n - 1), np.arange(2, n + 1))
            least = _sliding_min(pair >> PLACE << PLACE | np.arange(n - 1, dtype=np.uint64), WINDOW)
            at = (least & ((np.uint64(1) << PLACE) - np.uint64(1))).astype(np.int64)
            first = np.arange(len(at))
            cut[at[self.word_row[first] == self.word_row[first + WINDOW]]] = True  # the window and its last pair lie in one text
        self.begin = np.flatnonzero(cut)
        self.end = np.r_[self.begin[1:], n]
        keep = self.end - self.begin >= LEAST
        self.begin, self.end = self.begin[keep], self.end[keep]
        self.first = np.flatnonzero(head)

    def over(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Hashes of runs of words [i, j)."""
        return K.mix((self.sums[j] - self.sums[i]) * self.inverse[i] + (j - i).astype(np.uint64))

    def columns(self, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, hash, first word within the row, words, first and last byte within the row."""
        row = self.word_row[self.begin]
        heads = np.zeros(len(offsets), np.int64)
        heads[self.word_row[self.first]] = self.first
        return row, self.over(self.begin, self.end), self.begin - heads[row], self.end - self.begin, self.ws[self.begin] - offsets[row], self.we[self.end - 1] - offsets[row]

    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        """All shingles of all paragraphs, and how many each has."""
        count = self.end - self.begin - SHINGLE + 1
        i = K.ranges(self.begin, count)
        return self.over(i, i + SHINGLE), count

    def keys(self) -> np.ndarray:
        """Band keys [paragraphs, BANDS]."""
        s, count = self.shingles()
        out = np.zeros((len(count), BANDS), np.uint64)
        if len(count):
            at = np.cumsum(count) - count
            for b in range(BANDS):
                for r in range(ROWS):
                    out[:, b] = out[:, b] * np.uint64(0x100000001B3) + K.mix(np.minimum.reduceat(s * _SEEDS[b * ROWS + r], at))
                out[:, b] = K.mix(out[:, b] + np.uint64(b))
        return out


def _each(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, Units]]:
    buf, offsets, _ = K.flat(batch.column("text"))
    for i, j in K.chunks(offsets):
        part = offsets[i : j + 1] - offsets[i]
        yield i, part, Units(buf[offsets[i] : offsets[j]], part)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rid = batch.column("rid").to_numpy()
        for i, offsets, u in _each(batch):
            row, pid, word, words, a, b = u.columns(offsets)
            yield pa.RecordBatch.from_arrays([pa.array(pid.view(np.int64)), pa.array(rid[i + row]), *[pa.array(x.astype(np.int32)) for x in (word, words, a, b)]], names=["pid", "rid", "word", "words", "a", "b"])


PLACES = "pid long, rid long, word int, words int, a int, b int"


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, offsets, u in _each(batch):
            pid = u.over(u.begin, u.end)
            _, only = np.unique(pid, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.keys()[only].ravel().view(np.int64)), pa.array(np.repeat(pid[only], BANDS).view(np.int64))], names=["key", "pid"])


def _colliding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, pid): distinct rows of keys that have several paragraphs."""
    last: tuple[int, int] | None = None  # the row before, and whether it has been sent
    sent = False
    for batch in batches:
        if not batch.num_rows:
            continue
        key, pid = batch.column("key").to_numpy(), batch.column("pid").to_numpy()
        if last is not None:
            key, pid = np.r_[last[0], key], np.r_[last[1], pid]
        new = np.r_[True, (key[1:] != key[:-1]) | (pid[1:] != pid[:-1])]
        head = last is not None
        at = np.flatnonzero(new)
        k, p = key[at], pid[at]
        before, after = np.r_[False, k[1:] == k[:-1]], np.r_[k[1:] == k[:-1], False]
        many = before | after
        first_sent = head and sent
        if first_sent:
            many[0] = False
        many[-1:] &= before[-1:]  # a last row alone waits for the next batch
        if len(many) == 1 and first_sent:
            sent = True
        else:
            sent = bool(many[-1])
        last = (k[-1], p[-1])
        yield pa.RecordBatch.from_arrays([pa.array(k[many]), pa.array(p[many])], names=["key", "pid"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted distinct shingles of the wanted paragraphs of each text."""
    for batch in batches:
        want = batch.column("want")
        wanted = [set(np.asarray(x.as_py(), np.int64).tolist()) if x.is_valid else set() for x in want]
        for i, _, u in _each(batch):
            row, pid = u.word_row[u.begin], u.over(u.begin, u.end).view(np.int64)
            s, count = u.shingles()
            at = np.cumsum(count) - count
            out: dict[int, np.ndarray] = {}
            for r, p, a, n in zip(row.tolist(), pid.tolist(), at.tolist(), count.tolist(), strict=True):
                if p in wanted[i + r]:
                    out[p] = np.unique(s[a : a + n]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.list_(pa.int64()))], names=["pid", "shingles"])


def similarity(flat: np.ndarray, offsets: np.ndarray, i: np.ndarray, j: np.ndarray, least: float = 0.0) -> np.ndarray:
    """Exact Jaccard similarity of pairs of sets, given as sorted runs of one array; 0 where their sizes alone rule out `least`."""
    size = np.diff(offsets)
    if least and len(i):
        may = np.flatnonzero(np.minimum(size[i], size[j]) >= least * np.maximum(size[i], size[j]) - 1e-9)
        out = np.zeros(len(i))
        out[may] = similarity(flat, offsets, i[may], j[may])
        return out
    out = np.zeros(len(i))
    total = np.r_[0, np.cumsum(size[i] + size[j])]
    cuts = np.unique(np.searchsorted(total, np.arange(0, total[-1] + 1, STEP))).tolist() + [len(i)]
    for at, stop in zip(cuts[:-1], cuts[1:], strict=True):  # some STEP shingles at once, however large the sets
        x, y = i[at:stop], j[at:stop]
        pair = np.r_[np.repeat(np.arange(len(x)), size[x]), np.repeat(np.arange(len(y)), size[y])]
        value = flat[np.r_[K.ranges(offsets[x], size[x]), K.ranges(offsets[y], size[y])]]
        order = np.lexsort((value, pair))
        pair, value = pair[order], value[order]
        both = np.bincount(pair[1:][(pair[1:] == pair[:-1]) & (value[1:] == value[:-1])], minlength=len(x))
        out[at:stop] = both / (size[x] + size[y] - both)
    return out


def linked(flat: np.ndarray, offsets: np.ndarray, least: float = SIMILAR) -> tuple[np.ndarray, np.ndarray]:
    """Links that span every component of sets at least so similar, found by peeling balls.

    All sets within the link distance of a centre are linked to it; of their other links only those into the ring up
    to twice the distance can leave the ball, so only these are compared before the ball goes.
    """
    own = np.arange(len(offsets) - 1)
    a, b = [], []
    while len(own) > 1:
        s = similarity(flat, offsets, np.full(len(own), own[0]), own)
        s[0] = 1.0
        ball, ring = own[s >= least], own[(s < least) & (s >= 2 * least - 1 - 1e-12)]
        a.append(np.full(len(ball), own[0])), b.append(ball)
        step = max(1, 200_000 // max(1, len(ring)))
        for k in range(0, len(ball) if len(ring) else 0, step):
            x, y = np.repeat(ball[k : k + step], len(ring)), np.tile(ring, len(ball[k : k + step]))
            good = similarity(flat, offsets, x, y) >= least
            a.append(x[good]), b.append(y[good])
        own = own[s < least]
    return (np.concatenate(a), np.concatenate(b)) if a else (own[:0], own[:0])


def _pairs(head: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of positions inside runs given by first position and length."""
    left, right = [], []
    for m in np.unique(size).tolist():
        x, y = np.triu_indices(m, 1)
        base = head[size == m]
        left.append((base[:, None] + x).ravel()), right.append((base[:, None] + y).ravel())
    return (np.concatenate(left), np.concatenate(right)) if left else (head[:0], head[:0])


def _similar(ids: np.ndarray, offsets: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a few sets with many at least so similar; intersections are counted by products of membership matrices.

    ids are the sets' shared shingles, size their whole sizes. Rows and columns come in blocks, so memory does not depend on the number of sets.
    """
    own = np.diff(offsets)
    a, b = [], []
    for i in range(0, len(left), 256):
        x = left[i : i + 256]
        value = ids[K.ranges(offsets[x], own[x])]
        names = np.unique(value)
        owner, mine = np.repeat(np.arange(len(x)), own[x]), np.searchsorted(names, value)
        for j in range(0, len(right), 2048):
            y = right[j : j + 2048]
            both = np.zeros((len(x), len(y)), np.float32)
            if len(names):
                other = ids[K.ranges(offsets[y], own[y])]
                at = np.minimum(np.searchsorted(names, other), len(names) - 1)
                good = names[at] == other
                row, at = np.repeat(np.arange(len(y)), own[y])[good], at[good]
            for c in range(0, len(names), 2048):
                wide = min(2048, len(names) - c)
                ours, theirs = np.zeros((len(x), wide), np.float32), np.zeros((len(y), wide), np.float32)
                m, t = (mine >= c) & (mine < c + wide), (at >= c) & (at < c + wide)
                ours[owner[m], mine[m] - c] = 1
                theirs[row[t], at[t] - c] = 1
                both += ours @ theirs.T
            p, q = np.nonzero(both >= least * (size[x][:, None] + size[y][None] - both) - 1e-6)
            a.append(x[p]), b.append(y[q])
    return (np.concatenate(a), np.concatenate(b)) if a else (left[:0], left[:0])


class Merged:
    """Components of a group's sets as links between them become known."""

    def __init__(self, number: np.ndarray, count: np.ndarray, offsets: np.ndarray, least: float):
        """number: the dense numbers of all shingles, set by set; count: in how many sets each is."""
        self.size, self.least, self.label = np.diff(offsets), least, np.arange(len(offsets) - 1)
        shared = count[number] > 1  # others are in no intersection
        self.ids, self.offsets = number[shared], np.r_[0, np.cumsum(shared)][offsets]

    def similar(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _similar(self.ids, self.offsets, self.size, left, right, self.least)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        new = self.label[a] != self.label[b]
        if new.any():
            every = np.arange(len(self.label))
            self.label = local(len(every), np.r_[every, a[new]], np.r_[self.label, b[new]])

    def centres(self, rounds: int) -> None:
        """A few passes that link all sets near one of the largest rest to it: groups of near copies are mostly one component then."""
        own = np.arange(len(self.label))
        for _ in range(rounds):
            if len(own) < 2:
                break
            a, b = self.similar(own[:1], own)
            self.add(a, b)
            own = np.setdiff1d(own[1:], b)

    def across(self, own: np.ndarray) -> None:
        """All links of a list between different components; sets that are one already are not compared."""
        while len(own) > 1:
            name, count = np.unique(self.label[own], return_inverse=True, return_counts=True)[1:]
            if len(count) == 1:
                break
            small = np.argsort(count, kind="stable")
            take = small[: max(1, int(np.searchsorted(np.cumsum(count[small]), 256, "right")))]
            take = take[take != small[-1]] if len(take) == len(count) else take
            mine = np.isin(name, take)
            self.add(*self.similar(own[mine], own))
            own = own[~mine]


def filtered(flat: np.ndarray, offsets: np.ndarray, least: float = SIMILAR) -> tuple[np.ndarray, np.ndarray]:
    """The same links for a large group, by prefix filtering: similar sets share one of their rarest shingles.

    With shingles in order of their frequency in the group, two sets of the wanted similarity meet among the first
    |s| - ceil(least * |s|) + 1 of each. What all members have in common, like a line they quote, is last and is
    never compared. Members known to be one component are not compared again, so near copies cost a few passes.
    """
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)
    _, number, count = np.unique(flat, return_inverse=True, return_counts=True)
    merged = Merged(number, count, offsets, least)
    merged.centres(4)
    order = np.lexsort((number, count[number], row))
    place = np.arange(len(row)) - np.repeat(offsets[:-1], size)
    first = order[place < np.repeat(size - np.ceil(least * size - 1e-9) + 1, size)]
    first = first[np.lexsort((row[first], number[first]))]
    member, shingle = row[first], number[first]
    head = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]]) if len(shingle) else first
    many = np.diff(np.r_[head, len(shingle)])
    i, j = _pairs(head[many <= PAIRED], many[many <= PAIRED])
    i, j = member[i], member[j]
    new = merged.label[i] != merged.label[j]
    pair = np.unique(i[new] * len(size) + j[new])
    i, j = pair // len(size), pair % len(size)
    good = similarity(flat, offsets, i, j, least) >= least
    merged.add(i[good], j[good])
    wide = np.flatnonzero(many > PAIRED)
    if (many[wide].astype(np.int64) ** 2).sum() > len(size) ** 2:  # lists that overlap: each pair once instead
        merged.across(np.arange(len(size)))
        wide = wide[:0]
    for k in wide[np.argsort(many[wide], kind="stable")].tolist():
        own = member[head[k] : head[k] + many[k]]
        if (merged.label[own] != merged.label[own[0]]).any():
            merged.across(own)
    tied = np.flatnonzero(merged.label != np.arange(len(size)))
    return merged.label[tied], tied


def _verifier(paired: int = PAIRED, peeled: int = PAIRED):
    """Over rows sorted by key, with shingle sets: a star of links for each verified component of each key.

    Groups of at most `paired` members are compared pair by pair, all in one step, larger ones of at most `peeled` ball by ball.
    """

    def work(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        key, pid = table.column("key").to_numpy(), table.column("pid").to_numpy()
        lists = table.column("shingles").combine_chunks()
        offsets = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())].astype(np.int64)
        flat = lists.flatten().to_numpy()
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[head, len(key)])
        small = size <= paired
        i, j = _pairs(head[small], size[small])
        good = similarity(flat, offsets, i, j, SIMILAR) >= SIMILAR
        links = [(i[good], j[good])]
        for h, n in zip(head[~small].tolist(), size[~small].tolist(), strict=True):
            x, y = (linked if n <= peeled else filtered)(flat[offsets[h] : offsets[h + n]], offsets[h : h + n + 1] - offsets[h])
            links.append((h + x, h + y))
        label = local(len(key), *(np.concatenate(v) for v in zip(*links, strict=True)))
        tied = np.flatnonzero(label != np.arange(len(key)))
        return pa.RecordBatch.from_arrays([pa.array(pid[tied]), pa.array(pid[label[tied]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            held.append(batch)
            size += len(batch.column("shingles").flatten())
            if size >= HELD and key[0] != key[-1]:
                cut = int(np.flatnonzero(key != key[-1])[-1]) + 1
                yield work([*held[:-1], batch.slice(0, cut)])
                held = [batch.slice(cut)]
                size = len(held[0].column("shingles").flatten())
        if held:
            yield work(held)

    return run


def _maybe_broadcast(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL else df


def links(texts: DataFrame) -> DataFrame:
    """(node, root): the cluster of each distinct paragraph that is linked to a different one. texts: rid, text."""
    n = K.partitions(texts.sparkSession)
    keys = texts.select("text").mapInArrow(_keys, "key long, pid long")
    found = K.saved(keys.repartition(n, "key").sortWithinPartitions("key", "pid").mapInArrow(_colliding, "key long, pid long"), "colliding")
    wanted = K.saved(found.select("pid").distinct(), "colliding-paragraphs")
    first = texts.select("rid", "text").mapInArrow(_places, PLACES).select("pid", "rid").join(_maybe_broadcast(wanted), "pid").groupBy("pid").agg(F.min("rid").alias("rid"))
    want = first.groupBy("rid").agg(F.collect_list("pid").alias("want"))
    sets = texts.select("rid", "text").join(want, "rid").select("text", "want").mapInArrow(_sets, "pid long, shingles array<long>").dropDuplicates(["pid"])
    verified = found.join(sets, "pid").select("key", "pid", "shingles").repartition(n, "key").sortWithinPartitions("key", "pid").mapInArrow(_verifier(), "a long, b long")
    return components(verified, "paragraph-links")


def late_places(texts: DataFrame) -> DataFrame:
    """Paragraphs (rid, word, words, a, b, cluster, first) that have an earlier occurrence, the one that stays. texts: rid, text."""
    places = texts.select("rid", "text").mapInArrow(_places, PLACES)
    roots = K.saved(links(texts).select(F.col("node").alias("pid"), "root"), "roots")
    places = places.join(_maybe_broadcast(roots), "pid", "left").withColumn("cluster", F.coalesce("root", "pid")).drop("root", "pid")
    spot = F.struct("rid", "word", "a", "words")
    groups = places.groupBy("cluster").agg(F.min(spot).alias("first"), F.max(spot).alias("last")).where("first != last").select("cluster", "first")
    return K.saved(places.join(groups, "cluster").where(spot != F.col("first")).distinct(), "repeats")


def repeats(texts: DataFrame) -> DataFrame:
    """Runs of whole repeated paragraphs (rid, a, b, words, cluster, first_rid, first_a, run_words), not extended. texts: rid, text."""
    order = W.partitionBy("rid").orderBy("word")
    late = late_places(texts).withColumn("new", F.coalesce(F.lag(F.col("word") + F.col("words")).over(order) != F.col("word"), F.lit(True)))
    late = late.withColumn("run", F.sum(F.col("new").cast("int")).over(order))
    late = late.withColumn("run_words", F.sum("words").over(W.partitionBy("rid", "run"))).where(F.col("run_words") >= RUN)
    return late.select("rid", "a", "b", "words", "cluster", F.col("first.rid").alias("first_rid"), F.col("first.a").alias("first_a"), "run_words", "run")


def _word_hashes(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Row, and 32-bit hash, first and last byte of each of its words: words are compared only at the places that a repeat lines up."""
    buf, offsets, _ = K.flat(batch.column("text"))
    for i, j in K.chunks(offsets):
        part = offsets[i : j + 1] - offsets[i]
        low = _LOWER[buf[offsets[i] : offsets[j]]]
        ws, we = K.words(low, part)
        h = (K.Ranges(low)(ws, we) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        edges = np.searchsorted(ws, part)
        for r in range(j - i):
            x, y = edges[r], edges[r + 1]
            yield i + r, h[x:y], ws[x:y] - part[r], we[x:y] - part[r]


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the words before (nearest first, with their bytes) and after each wanted occurrence."""
    for batch in batches:
        out: list[tuple] = []
        want = batch.column("want")
        for r, h, a, _ in _word_hashes(batch):
            for w in want[r].as_py():
                i, j = w["word"], w["word"] + w["words"]
                out.append((w["cluster"], h[max(0, i - REACH) : i][::-1], a[max(0, i - REACH) : i][::-1].astype(np.int32), h[j : j + REACH]))
        kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["cluster", "before", "before_a", "after"])


def _same(h: np.ndarray, want: np.ndarray) -> int:
    """Equal words at the heads of two arrays."""
    n = min(len(h), len(want))
    differ = h[:n] != want[:n]
    return int(np.argmax(differ)) if differ.any() else n


#: Stand for the words before an extension, which both sides share; no hash is so large.
SHARED = [1 << 70, 1 << 71, 1 << 72, 1 << 73]


def _shingle_set(h: np.ndarray) -> set:
    """Shingles that end in h, which follows SHINGLE - 1 words that both sides share."""
    x = [*SHARED, *h.tolist()][-(len(h) + SHINGLE - 1) :]
    return {tuple(x[i : i + SHINGLE]) for i in range(len(h))}


def alike(h: np.ndarray, want: np.ndarray, lead: int) -> tuple[int, int]:
    """How many words at the heads of h and of want continue a repeat of `lead` equal words.

    Equal words always do. After words that differ, `SHINGLE` equal ones or more do, if the repeat as a whole, its lead included, keeps
    a Jaccard similarity of SIMILAR.
    """
    i = j = _same(h, want)
    while i < len(h) and j < len(want):
        ways = ((i + x, j + y, _same(h[i + x :], want[j + y :])) for x, y in STEPS)
        found = next((w for w in ways if w[2] >= SHINGLE), None)
        if found is None:
            break
        x, y = found[0] + found[2], found[1] + found[2]
        a, b, inside = _shingle_set(h[:x]), _shingle_set(want[:y]), max(0, lead - SHINGLE + 1)
        both = len(a & b) + inside
        if both < SIMILAR * (len(a) + len(b) + 2 * inside - both):
            break
        i, j = x, y
    return i, j


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The removed spans of each text: its repeats extended, disjoint, in runs of at least RUN words."""
    for batch in batches:
        out: list[tuple] = []
        rids, pieces = batch.column("rid").to_pylist(), batch.column("pieces")
        for r, h, a, b in _word_hashes(batch):
            found, spans, at, begin = sorted(pieces[r].as_py(), key=lambda p: p["word"]), [], 0, 0
            ends = [p["word"] + p["words"] for p in found]
            stop = ends[-1:]  # where the run of whole pieces that each piece is in ends
            for p, q in zip(found[-2::-1], found[:0:-1], strict=True):
                stop.append(stop[-1] if p["word"] + p["words"] == q["word"] else p["word"] + p["words"])
            for p, after, last in zip(found, [*[q["word"] for q in found[1:]], len(h)], stop[::-1], strict=True):
                i, j = p["word"], p["word"] + p["words"]
                left, back = alike(h[:i][::-1][:REACH], np.array(p["before"] or [], np.int32), last - i)
                back -= max(0, left - (i - at))
                left = min(left, i - at)
                begin = begin if spans and spans[-1][1] == i - left else i - left
                right = min(alike(h[j : j + REACH], np.array(p["after"] or [], np.int32), j - begin)[0], after - j)
                spans.append((i - left, j + right, p, back))
                at = j + right
            head = [k for k, s in enumerate(spans) if not k or spans[k - 1][1] != s[0]]
            for run, (x, y) in enumerate(zip(head, [*head[1:], len(spans)], strict=True)):
                size = spans[y - 1][1] - spans[x][0]
                for s, e, p, back in spans[x:y] if size >= RUN else []:
                    out.append((rids[r], int(a[s]), int(b[e - 1]), e - s, p["cluster"], p["first_rid"], p["before_a"][back - 1] if back > 0 else p["first_a"], size, run))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        columns = list(zip(*out, strict=True)) or [[]] * 9
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["rid", "a", "b", "words", "cluster", "first_rid", "first_a", "run_words", "run"])


def removed(texts: DataFrame) -> DataFrame:
    """Removed spans (rid, a, b, words, cluster, first_rid, first_a, run_words, run): extended repeats in runs. texts: rid, text."""
    order = W.partitionBy("rid").orderBy("word")
    late = late_places(texts).withColumns({
        "head": F.coalesce(F.lag(F.col("word") + F.col("words")).over(order) != F.col("word"), F.lit(True)),
        "tail": F.coalesce(F.lead("word").over(order) != F.col("word") + F.col("words"), F.lit(True)),
    })  # inside a run nothing is left to extend over
    firsts = late.where("head or tail").select("cluster", "first.rid", "first.word", "first.words").distinct().groupBy("rid").agg(F.collect_list(F.struct("cluster", "word", "words")).alias("want"))
    around = texts.select("rid", "text").join(firsts, "rid").select("text", "want").mapInArrow(_around, "cluster long, before array<int>, before_a array<int>, after array<int>").dropDuplicates(["cluster"])
    piece = F.struct("word", "words", "cluster", F.col("first.rid").alias("first_rid"), F.col("first.a").alias("first_a"), *[F.when(F.col(k), F.col(c)).alias(c) for k, c in (("head", "before"), ("head", "before_a"), ("tail", "after"))])
    pieces = late.join(around, "cluster", "left").groupBy("rid").agg(F.collect_list(piece).alias("pieces"))
    out = texts.select("rid", "text").join(pieces, "rid").mapInArrow(_extend, "rid long, a int, b int, words int, cluster long, first_rid long, first_a int, run_words long, run long")
    return K.saved(out, "removed").distinct()


def dedup(docs: DataFrame) -> DataFrame:
    """One row per removed paragraph as extended: doc_id, first and last byte, words, cluster, the document and byte of the occurrence
    that stays, and the words of the removed run it is part of."""
    K.ship(docs.sparkSession)
    texts = _ranked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    found = removed(texts)
    if texts.select("rid", "doc_id").where("not (rid <=> doc_id)").limit(1).count():
        names = K.saved(texts.select("rid", "doc_id").distinct(), "names")
        found = found.join(names, "rid").join(names.select(F.col("rid").alias("first_rid"), F.col("doc_id").alias("first_doc_id")), "first_rid")
    else:
        found = found.withColumns({"doc_id": F.col("rid"), "first_doc_id": F.col("first_rid")})
    return found.select("doc_id", F.col("a").cast("long").alias("start_byte"), F.col("b").cast("long").alias("end_byte"), F.col("words").alias("n_words"), "cluster", "first_doc_id", F.col("first_a").cast("long").alias("first_byte"), "run_words")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, cuts = batch.column("text").to_pylist(), batch.column("cuts").to_pylist()
        out = []
        for t, spans in zip(texts, cuts, strict=True):
            if spans:
                raw, at, parts = t.encode(), 0, []
                for s in sorted(spans, key=lambda s: s["a"]):
                    parts.append(raw[at : s["a"]])
                    at = s["b"]
                t = b"".join([*parts, raw[at:]]).decode()
            out.append(t)
        keep = ["doc_id", "lang", "source", "n_chars"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(out, pa.string())], names=[*keep, "text"])


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without their removed runs of paragraphs; n_chars is that of the text left.

    Every document stays, if only with an empty text; null texts stay null, rows with equal ids and texts lose the same runs, an empty table
    stays empty and extra columns go.
    """
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    K.ship(docs.sparkSession)
    texts = _ranked(docs.select(*columns))
    runs = removed(texts).groupBy("rid", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    cuts = runs.groupBy("rid").agg(F.collect_list(F.struct("a", "b")).alias("cuts"))
    rows = texts.join(cuts, "rid", "left").select("doc_id", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"), "text", "cuts")
    out = rows.mapInArrow(_cut, "doc_id long, lang string, source string, n_chars long, text string")
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
