"""Homomorphic multiset hashes of documents.

A document is the multiset of its paragraphs (non-empty lines). Each paragraph is hashed to a wide vector, and
the fingerprint is the lane-wise sum of those vectors modulo powers of two. So the order of paragraphs does not
matter, equal multisets have equal sums, and a paragraph is inserted or deleted by one addition or subtraction.

The vector has two parts:
* 16 lanes modulo 2**32 taken from BLAKE2b-512 of the paragraph, which decide equality;
* `LANES` lanes modulo 2**32 in which each 3-word shingle of the paragraph adds +1 or -1 to the lane that its hash names.
  The cosine of two such sums estimates the cosine of the shingle multisets and is the likeness that is returned.

Defined results: null text is empty and has the fingerprint zero; a text of white space alone too. Two equal
fingerprints have likeness 1, a zero and a non-zero one 0. A very long text, or one line two thousand million times over, has exact sums. Rows with
equal ids, repeated rows too, are ordered by text; a null id counts as the smallest, and all rows of one id meet in one task. Extra
columns are ignored. An empty table gives an empty result. `updated` takes ids that occur on one side only as documents without
paragraphs on the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit as K

WIDE, LANES, SHINGLE = 16, 128, 3
HEX = WIDE * 8 + LANES * 8


def _wide(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    data = buf.tobytes()
    out = np.zeros((n, WIDE), np.uint32)
    if len(starts):
        blake = hashlib.blake2b
        raw = b"".join([blake(data[a:b]).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        out[owner[first]] = np.add.reduceat(np.frombuffer(raw, "<u4").reshape(-1, WIDE), first, axis=0, dtype=np.uint32)
    return out


def _lines(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    solid = buf != 10
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(buf))]
    begin[inner] = solid[inner]
    end[inner - 1] = solid[inner - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def vectors(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both parts of the fingerprints of all rows of a flat buffer."""
    n = len(offsets) - 1
    if not len(buf):
        return np.zeros((n, WIDE), np.uint32), np.zeros((n, LANES), np.uint32)
    starts, ends = _lines(buf, offsets)
    ws, we = K.words(buf, offsets)
    line = np.searchsorted(starts, ws, "right") - 1
    full = np.zeros(len(starts), bool)
    full[line] = True  # a paragraph has a word
    wide = _wide(buf, starts[full], ends[full], K.rows_of(offsets, starts[full]), n)
    per = np.bincount(line, minlength=len(starts))
    left = np.cumsum(per)[line] - np.arange(len(ws)) if len(ws) else np.zeros(0, np.int64)  # words to the line's end
    head = np.r_[True, line[1:] != line[:-1]] if len(ws) else np.zeros(0, bool)
    take = np.flatnonzero((left >= SHINGLE) | head)
    last = take + np.minimum(left[take], SHINGLE) - 1
    h = K.Ranges(buf)(ws[take], we[last])
    lane = (h >> np.uint64(40)).astype(np.int64) % LANES
    sign = 1.0 - 2.0 * (h & np.uint64(1)).astype(np.float64)
    sums = np.bincount(K.rows_of(offsets, ws[take]) * LANES + lane, sign, n * LANES)
    return wide, sums.astype(np.int64).astype(np.uint32).reshape(n, LANES)


def to_text(wide: np.ndarray, sums: np.ndarray) -> list[str]:
    raw = np.concatenate([wide.astype(">u4").view(np.uint8).reshape(len(wide), -1), sums.astype(">u4").view(np.uint8).reshape(len(sums), -1)], axis=1)
    every = raw.tobytes().hex()
    return [every[i * HEX : (i + 1) * HEX] for i in range(len(wide))]


def from_text(prints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex("".join(prints)), np.uint8).reshape(len(prints), HEX // 2)
    cut = WIDE * 4
    return np.ascontiguousarray(raw[:, :cut]).view(">u4").astype(np.uint32), np.ascontiguousarray(raw[:, cut:]).view(">u4").astype(np.uint32)


def fingerprint(text: str | None) -> str:
    return to_text(*vectors(*K.pack([(text or "").encode()])))[0]


def insert(prints: str, other: str) -> str:
    """The fingerprint of the union of two multisets, e.g. after a paragraph came in."""
    (w, s), (v, t) = from_text([prints]), from_text([other])
    return to_text(w + v, s + t)[0]


def delete(prints: str, other: str) -> str:
    """The fingerprint after the paragraphs of `other` went."""
    (w, s), (v, t) = from_text([prints]), from_text([other])
    return to_text(w - v, s - t)[0]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """0 to 1 for each pair of rows: 1 if equal, else the cosine of the signed lanes, at least 0."""
    equal = (a[0] == b[0]).all(axis=1) & (a[1] == b[1]).all(axis=1)
    x, y = a[1].view(np.int32).astype(np.float64), b[1].view(np.int32).astype(np.float64)
    norm = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    cos = np.divide((x * y).sum(axis=1), norm, out=np.zeros(len(norm)), where=norm > 0)
    return np.where(equal, 1.0, np.clip(cos, 0.0, 1.0))


def _fold(batches: Iterator[pa.RecordBatch], columns: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    def stored(batch: pa.RecordBatch) -> pa.RecordBatch:
        buf, offsets, _ = K.flat(batch.column("text"))
        out = []
        for i, j in K.chunks(offsets):
            out += to_text(*vectors(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(out, pa.string())], schema=schema)

    for batch in batches:
        yield stored(batch)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row, in one narrow pass."""
    from pyspark.sql.pandas.types import to_arrow_schema

    K.ship(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, fingerprint string"
    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)
    return src.mapInArrow(lambda it: _fold(it, ["doc_id"], arrow), schema)


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums (doc_id, fingerprint) of a batch's fingerprints, each taken off where `minus`."""
    for batch in batches:
        w, s = from_text(batch.column("fingerprint").to_pylist()) if batch.num_rows else (np.zeros((0, WIDE), np.uint32), np.zeros((0, LANES), np.uint32))
        minus = batch.column("minus").to_numpy(zero_copy_only=False).astype(bool)
        w[minus], s[minus] = -w[minus], -s[minus]
        ids = batch.column("doc_id").dictionary_encode()
        group = np.where(np.asarray(ids.indices.is_null()), len(ids.dictionary), ids.indices.fill_null(0).to_numpy())
        out = [np.zeros((len(ids.dictionary) + 1, x.shape[1]), np.uint32) for x in (w, s)]
        for total, x in zip(out, (w, s), strict=True):
            np.add.at(total, group, x)
        found = np.unique(group)
        names = pa.concat_arrays([ids.dictionary, pa.nulls(1, ids.dictionary.type)]).take(pa.array(found))
        yield pa.RecordBatch.from_arrays([names, pa.array(to_text(out[0][found], out[1][found]), pa.string()), pa.array(np.zeros(len(found), bool))], names=["doc_id", "fingerprint", "minus"])


def _summed(table: pa.Table) -> pa.Table:
    w, s = from_text(table.column("fingerprint").to_pylist())
    return pa.table({"doc_id": table.column("doc_id")[:1], "fingerprint": to_text(w.sum(axis=0, dtype=np.uint32)[None], s.sum(axis=0, dtype=np.uint32)[None])})


def updated(prints: DataFrame, inserted: DataFrame, deleted: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) after paragraphs (doc_id, text) came in and others went, without the documents' own texts.

    Changes are fingerprinted and summed per document batch by batch before the shuffle, so a document with very many costs no more than others.
    """
    rows = prints.select("doc_id", "fingerprint", F.lit(False).alias("minus"))
    for changes, minus in ((inserted, False), (deleted, True)):
        rows = rows.unionByName(fingerprints(changes).withColumn("minus", F.lit(minus)))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_changes, f"doc_id {kind}, fingerprint string, minus boolean").groupBy("doc_id").applyInArrow(_summed, f"doc_id {kind}, fingerprint string")


def _bucket(key, splits: list):
    """How many splits are <= key: two levels, so that many splits stay cheap per row."""
    if not splits:
        return F.lit(0)
    step = max(1, round(len(splits) ** 0.5))
    fine = F.array(*[F.lit(x).cast("long") for x in splits])
    coarse = F.array(*[F.lit(x).cast("long") for x in splits[::step]])
    skip = F.greatest(F.size(F.filter(coarse, lambda x: x <= key)) - 1, F.lit(0)) * step
    return (skip + F.size(F.filter(F.slice(fine, skip + 1, F.lit(step)), lambda x: x <= key))).cast("int")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows dealt by ranges of doc_id, in descending order in each partition.

    The texts are shuffled once. The row that follows a range's last row is sent along with `follows` true;
    after the last range that is the very first row. Needs columns doc_id (long) and text.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)).cast("long"))
    src = docs.select("doc_id", "text", key.alias("okey"))
    n = K.partitions(spark)
    found = src.agg(F.percentile_approx("okey", [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0]
    splits = sorted(set(found or []))
    src = src.withColumn("bucket", _bucket(F.col("okey"), splits))
    tops = sorted((r["bucket"], r["top"]) for r in src.groupBy("bucket").agg(F.max("okey").alias("top")).collect())  # a row per partition
    if not tops:
        return src.withColumn("follows", F.lit(False)).limit(0)
    target = [(top, tops[(k + 1) % len(tops)][0]) for k, (_, top) in enumerate(tops)]  # the highest follows the lowest bucket
    edge = F.broadcast(spark.createDataFrame(target, "okey long, goes int"))
    extra = src.join(edge, "okey").select("doc_id", "text", "okey", F.col("goes").alias("bucket"), F.lit(True).alias("follows"))
    every = src.withColumn("follows", F.lit(False)).unionByName(extra)
    return every.repartitionById(len(splits) + 1, "bucket").sortWithinPartitions("bucket", "follows", F.desc("okey"), "text")


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: tuple | None = None  # the last row, whose next row has not come yet

    def block(ids: list, texts: list[str], nexts: list[str]) -> pa.RecordBatch:
        half = [len(t) // 2 for t in texts]
        edited = [(t[: len(t) - h] + x[:h]).encode() for t, x, h in zip(texts, nexts, half, strict=True)]
        own = vectors(*K.pack([t.encode() for t in texts]))
        after = vectors(*K.pack([x.encode() for x in nexts[-1:]]))
        after = (np.concatenate([own[0][1:], after[0]]), np.concatenate([own[1][1:], after[1]]))
        changed = vectors(*K.pack(edited))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
                pa.array(to_text(*own)), pa.array(to_text(*changed)), pa.array(likeness(own, changed)), pa.array(likeness(own, after)),
            ],
            names=[c.split()[0] for c in OUT.split(", ")],
        )

    for batch in batches:
        ids, texts, follows, bucket = (batch.column(c).to_pylist() for c in ("doc_id", "text", "follows", "bucket"))
        rows = list(zip(ids, [t or "" for t in texts], follows, bucket, strict=True))
        if held:
            rows.insert(0, held)
        i = 0
        while i < len(rows) - 1:
            size, j = 0, i
            while j < len(rows) - 1 and not rows[j][2] and (j == i or size < K.CHUNK):
                size += len(rows[j][1])
                j += 1
            if j > i:
                yield block([r[0] for r in rows[i:j]], [r[1] for r in rows[i:j]], [r[1] for r in rows[i + 1 : j + 1]])
            i = j
            while i < len(rows) - 1 and rows[i][2]:
                i += 1
        held = rows[-1] if rows else None


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edit by the next document, with likenesses (columns `OUT`).

    The edit replaces the last floor(n_chars / 2) code points by as many first ones of the next document in
    descending doc_id; after the last document comes the first.
    """
    K.ship(docs.sparkSession)
    return with_next(docs).select("doc_id", "text", "follows", "bucket").mapInArrow(_compare, OUT)
