"""WARC archives: writing pages as (segmented) records with revisits, and reading them back whole.

Writing. A page's HTML is the payload of an HTTP response in chunked transfer framing. Of pages with equal payloads of
at least `REVISIT` bytes the one with the largest page_id becomes a response record and the others revisit records that
name it; smaller payloads are always responses. A block longer than `SEGMENT` bytes is cut into a first record and
continuation records that name their origin, number themselves and, the last one, state the total length. Spark's text
writer makes the files (gzip, records parted by two line ends as the format asks), so any store it can write will do.

Reading. Spark's binary-file reader hands over the archives; each is split into records by their lengths.
Segments are grouped by the identifier of their origin, ordered by segment number, and their total length is verified
before the chunked framing is decoded. Records that came in one piece carry no payload through that shuffle.

Defined results: a null html is empty and a null url omitted. Rows that share a page_id are all written (their record
identifiers get a suffix), and of equal payloads all rows with the largest page_id are responses; a null page_id counts as
the smallest and reads back as null. Very long pages are segmented and read back whole; an empty table gives no records; extra columns
are ignored. Incomplete or damaged records read back with complete = false and null payload columns.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit as K

REVISIT, SEGMENT, CHUNKED, PER_FILE = 1000, 8192, 4096, 20_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Copies of the table of repeated payloads, so that one very common payload is joined in so many tasks.
SALT = 16
#: At most so many decisions, of some 60 bytes each, are broadcast.
SMALL = 200_000
END = "\r\n"


def cuts(block: bytes, size: int) -> list[int]:
    """Ends of segments of at most `size` bytes, or one character, that split no UTF-8 character."""
    ends, at = [], 0
    while len(block) - at > size:
        end = at + size
        while end > at and block[end] & 0xC0 == 0x80:
            end -= 1
        if end == at:  # one character is longer than a segment
            end = at + size
            while end < len(block) and block[end] & 0xC0 == 0x80:
                end += 1
        ends.append(end)
        at = end
    return [*ends, len(block)] if at < len(block) else ends


def chunked(body: bytes, size: int = CHUNKED) -> bytes:
    """Chunked transfer framing of a body; no chunk splits a UTF-8 character, so the whole stays text."""
    ends = cuts(body, size) if body else []
    parts = [b"%x\r\n%b\r\n" % (j - i, body[i:j]) for i, j in zip([0, *ends[:-1]], ends, strict=True)] if ends else []
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(data: bytes) -> bytes | None:
    """The body of chunked framing (extensions and trailers are skipped); None where the framing is broken."""
    out, at = [], 0
    while True:
        line = data.find(b"\r\n", at)
        if line < 0:
            return None
        try:
            size = int(data[at:line].split(b";")[0].strip(), 16)
        except ValueError:
            return None
        at = line + 2
        if not size:
            return b"".join(out)
        if size < 0 or data[at + size : at + size + 2] != b"\r\n":
            return None
        out.append(data[at : at + size])
        at += size + 2


def _head(kind: str, record: str, length: int, *more: tuple[str, object]) -> str:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record}>"), ("WARC-Date", DATE), *more, ("Content-Length", length)]
    return "WARC/1.1" + END + "".join(f"{k}: {v}{END}" for k, v in lines if v is not None) + END


def records(record: str, url: str | None, payload: bytes, digest: str, refers: int | None, segment: int = SEGMENT) -> list[str]:
    """The record or records of one page, without the line ends that follow each."""
    target = quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url is not None else None
    start = f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}"
    named = [("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if refers is not None:
        block = f"{start}Content-Length: {len(payload)}{END}{END}"
        return [_head("revisit", record, len(block), ("WARC-Refers-To", f"<urn:page:{refers}>"), ("WARC-Profile", PROFILE), *named) + block]
    block = f"{start}Transfer-Encoding: chunked{END}{END}".encode() + chunked(payload)
    ends = cuts(block, segment)
    if len(ends) == 1:
        return [_head("response", record, len(block), *named) + block.decode()]
    out, at = [], 0
    for k, end in enumerate(ends, 1):
        part = block[at:end]
        if k == 1:
            head = _head("response", record, len(part), *named, ("WARC-Segment-Number", 1))
        else:
            total = len(block) if k == len(ends) else None
            head = _head("continuation", f"{record}:{k}", len(part), ("WARC-Segment-Origin-ID", f"<{record}>"), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", total))
        out.append(head + part.decode())
        at = end
    return out


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        out, held = [], 0
        columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to", "same_id"))
        for page, url, html, digest, refers, same in zip(*columns, strict=True):
            n += 1
            record = f"urn:page:{'none' if page is None else page}" + (f":p{part}-{n}" if same or page is None else "")
            new = records(record, url, html.encode() if html else b"", digest, refers)
            out += new
            held += sum(map(len, new))
            if held > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                out, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])


def planned(pages: DataFrame, least: int = REVISIT) -> DataFrame:
    """page_id, url, html, digest, refers_to (null for responses) and same_id of each page.

    Decisions are made on ids and digests alone. Only the pages that are not plain responses are joined to the HTML:
    broadcast where their counted number allows, so that the HTML is not shuffled at all, else by (page_id, digest).
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.sha1(html).alias("digest"), F.octet_length(html).alias("size"))
    lowest = F.lit(-(2**63)).cast("long")
    narrow = K.saved(rows.select(F.col("page_id").alias("id"), F.coalesce("page_id", lowest).alias("key"), "digest", "size"), "digests")
    repeated = narrow.where(F.col("size") >= least).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("key").alias("to")).where("n > 1")
    repeated = repeated.select("digest", "to", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    same = narrow.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and id is not null").select("id", F.lit(True).alias("same_id"))
    salted = narrow.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")).join(repeated, ["digest", "salt"], "left")
    nameless = salted.where("id is null").withColumn("same_id", F.lit(False))  # kept out of the join, where they would meet in one task
    salted = salted.where("id is not null").join(same, "id", "left").unionByName(nameless, allowMissingColumns=True)
    salted = salted.select("id", F.col("digest").alias("sha"), F.when(F.col("to") != F.col("key"), F.col("to")).alias("refers_to"), F.coalesce("same_id", F.lit(False)).alias("same_id"))
    special = K.saved(salted.where("refers_to is not null or same_id").distinct(), "special")
    special = F.broadcast(special) if special.count() <= SMALL else special
    out = rows.join(special, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("sha")), "left")
    return out.select("page_id", "url", "html", "digest", "refers_to", F.coalesce("same_id", F.lit(False)).alias("same_id"))


def write(pages: DataFrame, path: str) -> None:
    """Archives of the pages, below path."""
    K.ship(pages.sparkSession)
    lines = planned(pages).mapInArrow(_write, "value string")
    lines.write.option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", PER_FILE).text(path)


PARSED = "origin string, seg int, total long, page_id long, record_type string, refers_to long, digest string, payload_bytes long, whole boolean, part binary"
_FIELD = re.compile(rb"([A-Za-z-]+): ?([^\r\n]*)")
_PAGE = re.compile(rb"<urn:page:(-?\d+|none)")


def _page(value: bytes | None) -> int | None:
    m = _PAGE.match(value or b"")
    return int(m[1]) if m and m[1] != b"none" else None


def _body(block: bytes) -> bytes | None:
    """The payload of an HTTP response block."""
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep:
        return None
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _checked(block: bytes, digest: str | None) -> tuple[int | None, str | None, bool]:
    body = _body(block)
    if body is None:
        return None, None, False
    own = hashlib.sha1(body).hexdigest()
    return len(body), own, digest in (None, own)


def parse(data: bytes) -> Iterator[tuple]:
    """Rows (columns PARSED) of the records of one uncompressed archive."""
    at, size = 0, len(data)
    while at < size:
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0 or not data.startswith(b"WARC/", at):
            break
        field = dict(_FIELD.findall(data[at : stop + 2]))
        length = int(field.get(b"Content-Length", b"0"))
        block = data[stop + 4 : stop + 4 + length]
        at = stop + 4 + length + 4
        kind, record = field.get(b"WARC-Type", b"").decode(), field.get(b"WARC-Record-ID", b"").decode()
        number = field.get(b"WARC-Segment-Number")
        page = _page(field.get(b"WARC-Record-ID"))
        digest = field[b"WARC-Payload-Digest"].decode().removeprefix("sha1:").lower() if b"WARC-Payload-Digest" in field else None
        if number is not None:
            origin = field.get(b"WARC-Segment-Origin-ID", b"").decode() or record
            total = int(field[b"WARC-Segment-Total-Length"]) if b"WARC-Segment-Total-Length" in field else None
            first = kind != "continuation"
            yield origin, int(number), total, page if first else None, kind if first else None, None, digest, None, None, block
        elif kind == "revisit":
            m = re.search(rb"(?i)content-length: *(\d+)", block)
            yield record, 0, None, page, kind, _page(field.get(b"WARC-Refers-To")), digest, int(m[1]) if m else None, len(block) == length, None
        elif kind == "response":
            n, own, good = _checked(block, digest) if len(block) == length else (None, None, False)
            yield record, 0, None, page, kind, None, own, n, good, None


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in PARSED.split(", ")])
    for batch in batches:
        for content in batch.column("content"):
            data = content.as_py()
            if data[:2] == b"\x1f\x8b":
                plain, rest = [], data
                while rest[:2] == b"\x1f\x8b":  # members, one after the other
                    d = zlib.decompressobj(31)
                    plain.append(d.decompress(rest))
                    rest = d.unused_data
                data = b"".join(plain)
            rows, held = [], 0
            for row in parse(data):
                rows.append(row)
                held += len(row[-1] or b"")
                if held > 4 << 20 or len(rows) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


OUT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, segments int, complete boolean"


def assemble(parts: list[dict], digest: str | None) -> tuple[int | None, str | None, bool]:
    """Payload length, digest and soundness of a record from its ordered segments."""
    numbers = [p["seg"] for p in parts]
    block = b"".join(p["part"] for p in parts)
    if numbers != list(range(1, len(parts) + 1)) or parts[-1]["total"] != len(block):
        return None, None, False
    return _checked(block, digest)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            size, own, good = (r["payload_bytes"], r["digest"], bool(r["whole"])) if not r["parts"] else assemble(r["parts"], r["digest"])
            rows.append((r["page_id"], size, own, r["record_type"], r["refers_to"], max(1, len(r["parts"])), good))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_()), strict=True)],
            names=[c.split()[0] for c in OUT.split(", ")],
        )


def read(spark, path: str) -> DataFrame:
    """One row per response or revisit record of the archives below path (columns OUT)."""
    K.ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    rows = files.mapInArrow(_parse, PARSED)
    piece = F.when(F.col("part").isNotNull(), F.struct("seg", "total", "part"))
    best = [F.max(c).alias(c) for c in ("page_id", "record_type", "refers_to", "digest", "payload_bytes", "whole")]
    return rows.groupBy("origin").agg(*best, F.sort_array(F.collect_list(piece)).alias("parts")).drop("origin").mapInArrow(_finish, OUT)


def archived(pages: DataFrame) -> DataFrame:
    """Pages written to archives in the shared folder and read back."""
    spark = pages.sparkSession
    path = f"{K.checkpoint_dir(spark)}/tremorline/warc-{uuid.uuid4().hex}"
    write(pages, path)
    return read(spark, path)


def sql(table: str = "pages") -> str:
    """What archived() returns, but for the number of segments, in DuckDB SQL."""
    return f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM {table}),
    r AS (SELECT html, max(page_id) AS top FROM p WHERE n >= {REVISIT} GROUP BY 1)
    SELECT page_id, n::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest, CASE WHEN coalesce(top, page_id) = page_id THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN top <> page_id THEN top END AS refers_to, true AS complete FROM p LEFT JOIN r ON p.html = r.html"""
