"""Vectorised text helpers: flat byte views of Arrow columns, range hashes and word bounds.

All work on one flat byte buffer for many texts, so the cost is a few numpy passes per byte and no
Python step per character. Callers cut a batch into chunks of bounded bytes first (`chunks`).
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U = np.uint64
#: Odd bases of the two polynomial hashes over the ring of integers modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX = U(0xD6E8FEB86659FD93)
#: Bytes of text that one vectorised step handles; a longer single text is a step of its own.
CHUNK = 1 << 20

_powers: dict[tuple[int, bool], np.ndarray] = {}


#: Rows of an Arrow batch, where the session has not chosen: batches of whole texts stay small next to a worker's own arrays.
BATCH = 2048
_DEFAULT_BATCH = "10000"


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did, with batches of bounded rows."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == _DEFAULT_BATCH:
        spark.conf.set(rows, str(BATCH))


_written: list[str] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a fresh one only where the session names none and driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        import tempfile

        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tremorline-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, remembered for `discard`."""
    path = f"{checkpoint_dir(spark)}/tremorline/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> int:
    """Delete every table that this process has written to the shared folder; call it once the results that read them are stored."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = len(_written)
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


#: Nodes of a plan that reads the same rows in the same order each time.
_STEADY = re.compile(r"[\s:+-]*(Project|Filter|Relation|LogicalRelation|LocalRelation|LogicalRDD|Union|SubqueryAlias)\b")


def steady(df: DataFrame, name: str) -> DataFrame:
    """df itself where its plan only scans, projects and filters; else written and read back, so that each pass meets the same order."""
    plan = df._jdf.queryExecution().optimizedPlan().treeString().strip().splitlines()
    return df if all(_STEADY.match(line) for line in plan) else saved(df, name)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def powers(n: int, base: int, inverse: bool) -> np.ndarray:
    """base**0 .. base**(n-1), or of its inverse, modulo 2**64; kept for the longest n so far."""
    have = _powers.get((base, inverse))
    if have is None or len(have) < n:
        step = pow(base, -1, 1 << 64) if inverse else base
        have = np.full(max(n, CHUNK + 4096), U(step))
        have[0] = 1
        np.cumprod(have, out=have)
        if len(have) <= 1 << 23:
            _powers[base, inverse] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U(32))
    x *= MIX
    x ^= x >> U(29)
    x *= MIX
    x ^= x >> U(32)
    return x


class Ranges:
    """64-bit hashes of any byte ranges of one buffer, each in constant time.

    H(s, e) scrambles sum of (byte + 1) * base**(i - s) over the range, and its length.
    """

    def __init__(self, buf: np.ndarray, which: int = 0):
        base, n = BASES[which], len(buf)
        self.sums = np.zeros(n + 1, U)
        np.cumsum((buf.astype(U) + U(1)) * powers(n, base, False), out=self.sums[1:])
        self.inverse = powers(n + 1, base, True)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(raw + (end - start).astype(U) * MIX)

    def window(self, width: int) -> np.ndarray:
        """Hashes of all ranges of one width, by start."""
        n = len(self.sums) - 1
        if n < width:
            return np.zeros(0, U)
        raw = (self.sums[width:] - self.sums[: n - width + 1]) * self.inverse[: n - width + 1]
        return mix(raw + U(width * int(MIX) % (1 << 64)))


def flat(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, null flags) of a string or binary Arrow column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        nulls = np.asarray(column.is_null())
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    else:
        nulls = np.zeros(len(column), bool)
    _, ends, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), nulls
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0], nulls


def pack(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a list of byte strings."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of rows of at most `limit` bytes together, or one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of bytes other than ASCII white space, cut at row borders."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~_SPACE[buf]
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(buf))]
    begin[inner] = solid[inner]
    end[inner - 1] = solid[inner - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def rows_of(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The row in which each byte position lies."""
    return np.searchsorted(offsets, at, "right") - 1


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All integers of the runs start .. start + length - 1, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - first, lengths)
