"""Language-model scores by stupid backoff over n-gram counts of the whole corpus.

The score of a word is count(n-gram) / count(its context) for the longest n-gram that ends there and occurs at least `seen` times, times
`alpha` for each order skipped; single words are count / all words. With the default of 2 an n-gram that occurs once, which is
only in the place being scored, counts as unseen; with 1 no n-gram of a corpus scored by its own counts would ever back off.
A document's score is the sum of logarithms over its words (A-Z lower-cased).

Three steps, each a shuffle by a key that grows with the data:

1. Texts are cut into blocks of at most `block` bytes in the order they are read. Each block explodes its n-grams,
   adds up equal ones and asks for their totals: one row per (range of hashes, block), its hashes as compressed differences.
2. The count table is partitioned by hash; each partition adds up what all blocks hold of its n-grams and joins the totals to
   those that asked. A very common n-gram is one entry per block, however many documents hold it.
3. Totals meet their block again, every n-gram of a document takes its total, and sums per document (of all its blocks) are taken.

The number of hash ranges grows with the bytes of text, so a partition holds some `PART` bytes' worth of them at any size. A
text longer than a block is cut between words into several, each with the words before its first as context.
Blocks are cut again in step 3; their names hold a hash of their content, and a block that finds other totals than it
asked for raises. Inputs that are more than a scan are written first, so that they are read in the same order.

Defined results: null, empty or blank text has 0 words, log_score 0 and mean_log null; very long texts are scored whole; every row is scored
and counted, repeated ones and those with a null doc_id too; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit as K
from .simhash import _LOWER

ORDER, ALPHA, SEEN = 3, 0.4, 2
#: Bytes of text in a block, at most.
BLOCK = 8 << 20
#: Bytes of text, times the order, whose n-grams one range of hashes holds, about.
PART = 24 << 20
#: The key under which the number of all words is counted.
TOTAL = np.uint64(0)
_ROWS = pa.schema([("rk", pa.int64()), ("doc_id", pa.int64()), ("skip", pa.int32()), ("text", pa.large_binary())])


def _planes(x: np.ndarray) -> bytes:
    """64-bit values byte by byte from the highest, compressed: high bytes are mostly zero."""
    return pa.compress(x.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def _values(raw: bytes, n: int) -> np.ndarray:
    flat = np.frombuffer(pa.decompress(raw, 8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(8, -1).T).view(">u8").ravel().astype(np.uint64)


def packed(keys: np.ndarray) -> bytes:
    """Ascending keys as differences."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(_values(raw, n))


class Words:
    """Words of a block's texts and hashes of the n-grams that end at each; the first `skip` words of a text are context only."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, skip: np.ndarray, order: int):
        rows, hashes = [], []
        for i, j in K.chunks(offsets):
            part = offsets[i : j + 1] - offsets[i]
            low = _LOWER[buf[offsets[i] : offsets[j]]]
            ws, we = K.words(low, part)
            rows.append(K.rows_of(part, ws) + i)
            hashes.append(K.Ranges(low)(ws, we))
        self.row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        n = len(h)
        head = np.flatnonzero(np.r_[True, self.row[1:] != self.row[:-1]]) if n else np.zeros(0, np.int64)
        self.left = np.arange(n) - np.repeat(head, np.diff(np.r_[head, n]))  # words before this one in its text
        self.scored = self.left >= skip[self.row]
        self.grams, self.at = [], []
        for k in range(1, order + 1):
            last = np.flatnonzero(self.left >= k - 1)
            key = np.zeros(len(last), np.uint64)
            for step in range(k - 1, -1, -1):
                key = key * np.uint64(0x100000001B3) + h[last - step]
            self.grams.append(K.mix(key + np.uint64(k)))
            self.at.append(last)

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """Ascending distinct n-grams, and how often each ends at a scored word."""
        keys, counts = np.unique(np.concatenate(self.grams), return_counts=True)
        if not self.scored.all():
            context = np.concatenate([g[~self.scored[at]] for g, at in zip(self.grams, self.at, strict=True)])
            counts = counts - np.bincount(np.searchsorted(keys, context), minlength=len(keys))
        return np.r_[TOTAL, keys], np.r_[int(self.scored.sum()), counts]


class Block:
    """Consecutive texts: row keys, ids, words of context, and the texts as one buffer."""

    def __init__(self, name: tuple[int, int], rk: np.ndarray, ids: pa.Array, skip: np.ndarray, buf: np.ndarray, offsets: np.ndarray):
        self.rk, self.ids, self.skip, self.buf, self.offsets, self.slot = rk, ids, skip, buf, offsets, name[0] * 4 + name[1]
        mark = hashlib.blake2b(np.int64(name).tobytes() + offsets.tobytes(), digest_size=8)
        mark.update(buf)
        self.name = int.from_bytes(mark.digest(), "little", signed=True)

    def packed(self) -> bytes:
        sink = pa.BufferOutputStream()
        text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.rk), [None, pa.py_buffer(self.offsets.tobytes()), pa.py_buffer(self.buf.tobytes())])
        with pa.ipc.new_stream(sink, _ROWS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(pa.RecordBatch.from_arrays([pa.array(self.rk), self.ids, pa.array(self.skip, pa.int32()), text], schema=_ROWS))
        return sink.getvalue().to_pybytes()


def _pieces(buf: np.ndarray, limit: int, order: int) -> Iterator[tuple[int, int, int]]:
    """(first byte, last byte, words of context) of the parts of one long text, cut between words."""
    ws, we = K.words(buf, np.array([0, len(buf)]))
    edge = 0
    while edge < len(ws):
        back = max(0, edge - order + 1)
        stop = max(edge + 1, int(np.searchsorted(we, ws[back] + limit, "right")))
        yield int(ws[back]), int(we[stop - 1]), edge - back
        edge = stop


def blocks(batches: Iterator[pa.RecordBatch], order: int, limit: int) -> Iterator[Block]:
    """Blocks of one task's rows (doc_id, text), in the order they come."""
    from pyspark import TaskContext

    part, seq, row = TaskContext.get().partitionId(), 0, 0
    held: list[tuple] = []
    size = 0

    def flush() -> Block:
        nonlocal held, size, seq
        rk, ids, skip, buf, lengths = zip(*held, strict=True)
        out = Block((part, seq), np.concatenate(rk), pa.concat_arrays(ids), np.concatenate(skip), np.concatenate(buf), np.r_[0, np.cumsum(np.concatenate(lengths))].astype(np.int64))
        held, size, seq = [], 0, seq + 1
        return out

    for batch in batches:
        buf, offsets, _ = K.flat(batch.column("text"))
        ids = batch.column("doc_id")
        for i, j in K.chunks(offsets, limit):
            a, b = int(offsets[i]), int(offsets[j])
            if held and size + b - a > limit:
                yield flush()
            rk = np.arange(row + i, row + j) | part << 40
            if b - a <= limit:
                held.append((rk, ids.slice(i, j - i), np.zeros(j - i, np.int64), buf[a:b], np.diff(offsets[i : j + 1])))
                size += b - a
                continue
            for x, y, skip in list(_pieces(buf[a:b], limit, order)) or [(0, 0, 0)]:
                held.append((rk, ids.slice(i, 1), np.array([skip]), buf[a + x : a + y], np.array([y - x])))
                yield flush()
        row += batch.num_rows
    if held:
        yield flush()


def _ask(order: int, parts: int, slots: int, limit: int):
    """The n-grams of each block and their counts in it, one row per range of hashes."""
    edges = np.array([(p << 64) // parts for p in range(1, parts)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, order, limit):
            keys, counts = Words(block.buf, block.offsets, block.skip, order).counted()
            cut = np.r_[0, np.searchsorted(keys, edges), len(keys)]
            at = np.flatnonzero(np.diff(cut))
            spans = list(zip(cut[at].tolist(), cut[at + 1].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([
                pa.array(at.astype(np.int32)), pa.array(np.full(len(at), block.slot % slots, np.int32)), pa.array(np.full(len(at), block.name, np.int64)), pa.array([b - a for a, b in spans], pa.int32()),
                pa.array([packed(keys[a:b]) for a, b in spans], pa.binary()), pa.array([_planes(counts[a:b]) for a, b in spans], pa.binary()),
            ], names=["part", "slot", "block", "n", "keys", "counts"])

    return run


ASKED = "part int, slot int, block long, n int, keys binary, counts binary"
ROWS = "slot int, block long, part int, n int, data binary"


def _totals(table: pa.Table) -> pa.RecordBatch:
    """The totals of one range of hashes, for each block in the order of the keys it sent."""
    n = table.column("n").to_pylist()
    keys = np.concatenate([unpacked(x, m) for x, m in zip(table.column("keys").to_pylist(), n, strict=True)])
    counts = np.concatenate([_values(x, m) for x, m in zip(table.column("counts").to_pylist(), n, strict=True)])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.r_[True, keys[1:] != keys[:-1]]
    totals = np.empty(len(keys), np.uint64)
    totals[order] = np.add.reduceat(counts[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    ends = np.r_[0, np.cumsum(n)].tolist()
    back = pa.array([_planes(totals[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
    return pa.RecordBatch.from_arrays([*[table.column(c).combine_chunks() for c in ("slot", "block", "part", "n")], back], names=["slot", "block", "part", "n", "data"])


def _groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Runs of rows that agree in a column by which they come sorted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        value = batch.column(column).to_numpy()
        edges = np.r_[0, np.flatnonzero(np.diff(value)) + 1, len(value)].tolist()
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if held and held[-1].column(column)[0].as_py() != value[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _groups(batches, "part"):
        yield _totals(table)


def _own(order: int, slots: int, limit: int):
    """The blocks themselves, as rows before their answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, order, limit):
            yield pa.RecordBatch.from_arrays([pa.array([b.slot % slots], pa.int32()), pa.array([b.name]), pa.array([-1], pa.int32()), pa.array([0], pa.int32()), pa.array([b.packed()], pa.binary())], names=["slot", "block", "part", "n", "data"])

    return run


def scores(w: Words, rows: int, totals: list[np.ndarray], words: int, seen: int, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, log score and words scored as single words, for each text of a block. totals: by order, of w.grams."""
    n, order = len(w.row), len(totals)
    count = []
    for at, total in zip(w.at, totals, strict=True):
        c = np.zeros(n)
        c[at] = total
        count.append(c)
    value = alpha ** (order - 1) * count[0] / max(words, 1)
    single = np.ones(n, bool)
    for k in range(2, order + 1):
        last = w.at[k - 1][count[k - 1][w.at[k - 1]] >= seen]
        value[last] = alpha ** (order - k) * count[k - 1][last] / count[k - 2][last - 1]
        single[last] = False
    row, value, single = w.row[w.scored], value[w.scored], single[w.scored]
    return np.bincount(row, minlength=rows), np.bincount(row, np.log(value), minlength=rows), np.bincount(row, single, minlength=rows)


def _score(order: int, seen: int, alpha: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "block"):
            part, sizes, data = (table.column(c).to_pylist() for c in ("part", "n", "data"))
            if part[0] >= 0 or part[1:2] == [-1]:
                raise RuntimeError("the input was read in another order the second time; write it to a table first")
            docs = pa.ipc.open_stream(data[0]).read_all().combine_chunks()
            buf, offsets, _ = K.flat(docs.column("text"))
            w = Words(buf, offsets, docs.column("skip").to_numpy(), order)
            got = np.concatenate([_values(x, n) for x, n in zip(data[1:], sizes[1:], strict=True)]) if len(data) > 1 else np.zeros(0, np.uint64)
            keys, place = np.unique(np.concatenate(w.grams), return_inverse=True)
            if len(got) != len(keys) + 1:
                raise RuntimeError("the input was read in another order the second time; write it to a table first")
            each = np.split(got[1:][place], np.cumsum([len(g) for g in w.grams])[:-1])
            n, log, single = scores(w, docs.num_rows, each, int(got[0]), seen, alpha)
            yield pa.RecordBatch.from_arrays([docs.column("rk").combine_chunks(), docs.column("doc_id").combine_chunks(), pa.array(n.astype(np.int64)), pa.array(log.astype(np.float64)), pa.array(single.astype(np.int64))], names=["rk", "doc_id", "n", "log", "single"])

    return run


def score(docs: DataFrame, order: int = ORDER, seen: int = SEEN, alpha: float = ALPHA, block: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens, log_score, mean_log and n_unigram (words that backed off to single words) of each document."""
    spark = docs.sparkSession
    K.ship(spark)
    n = K.partitions(spark)
    src = K.steady(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "texts")
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, slots = max(n, -(-size * order // PART)), max(n, -(-size // (2 * block)))
    asked = src.mapInArrow(_ask(order, parts, slots, block), ASKED)
    answers = asked.repartitionById(parts, "part").sortWithinPartitions("part").mapInArrow(_answer, ROWS)
    both = src.mapInArrow(_own(order, slots, block), ROWS).unionByName(answers)
    each = both.repartitionById(slots, "slot").sortWithinPartitions("block", "part").mapInArrow(_score(order, seen, alpha), "rk long, doc_id long, n long, log double, single long")
    whole = each.groupBy("rk").agg(F.first("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.sum("log").alias("log_score"), F.sum("single").alias("n_unigram"))
    return whole.select("doc_id", "n_tokens", "log_score", F.when(F.col("n_tokens") > 0, F.col("log_score") / F.col("n_tokens")).alias("mean_log"), "n_unigram")


def registered(docs: DataFrame) -> DataFrame:
    out = score(docs)
    return out.withColumns({"log_score": F.round("log_score", 5), "mean_log": F.round("mean_log", 8)})


def sql(table: str = "documents", order: int = ORDER) -> str:
    """The same in DuckDB SQL."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    grams = [", ".join(f"w{k}" for k in range(j, 0, -1)) for j in range(1, order + 1)]
    words = ", ".join(f"CASE WHEN i >= {j} THEN w[i - {j - 1}] END AS w{j}" for j in range(1, order + 1))
    counts = ", ".join(f"c{j} AS MATERIALIZED (SELECT {g}, count(*) AS n FROM toks WHERE w{j} IS NOT NULL GROUP BY ALL)" for j, g in enumerate(grams, 1))
    joins = " ".join(f"LEFT JOIN c{j} ON " + " AND ".join(f"c{j}.w{k} = t.w{k}" for k in range(1, j + 1)) for j in range(1, order + 1))
    joins += " " + " ".join(f"LEFT JOIN c{j} p{j} ON " + " AND ".join(f"p{j}.w{k} = t.w{k + 1}" for k in range(1, j + 1)) for j in range(1, order))
    cases = " ".join(f"WHEN c{j}.n >= {SEEN} THEN {ALPHA ** (order - j)}::DOUBLE * c{j}.n / p{j - 1}.n" for j in range(order, 1, -1))
    return f"""
    WITH lists AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[^ \\t\\n\\x0B\\f\\r]+'), []) AS w FROM {table}),
    toks AS MATERIALIZED (SELECT doc_id, {words} FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM lists)),
    {counts},
    s AS (SELECT t.doc_id, CASE {cases} ELSE {ALPHA ** (order - 1)}::DOUBLE * c1.n / (SELECT count(*) FROM toks) END AS v, {"coalesce(c2.n >= " + str(SEEN) + ", false)" if order > 1 else "false"} AS several FROM toks t {joins}),
    d AS (SELECT doc_id, count(*) AS n, sum(ln(v)) AS l, count(*) FILTER (NOT several) AS u FROM s GROUP BY 1)
    SELECT x.doc_id, coalesce(n, 0)::BIGINT AS n_tokens, round(coalesce(l, 0.0::DOUBLE), 5) AS log_score, round(l / n, 8) AS mean_log, coalesce(u, 0)::BIGINT AS n_unigram
    FROM lists x LEFT JOIN d USING (doc_id)"""
