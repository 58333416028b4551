import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tremorline.llm import registered
from tremorline.llm import warc as M


def expected(rows):
    top = {}
    for page, html in rows:
        p = (html or "").encode()
        if len(p) >= M.REVISIT:
            top[p] = max(top.get(p, page), page)
    out = []
    for page, html in rows:
        p = (html or "").encode()
        to = top.get(p, page)
        out.append((page, len(p), hashlib.sha1(p).hexdigest(), "response" if to == page else "revisit", None if to == page else to))
    return sorted(out, key=str)


def test_query(spark, sf):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = M.archived(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    assert all(r.complete for r in got)
    assert sorted([tuple(r)[:5] for r in got], key=str) == expected(rows)
    assert any(r.segments > 1 for r in got)


@pytest.mark.parametrize("small", [M.SMALL, 0])
def test_copies_and_odd_rows(spark, small, monkeypatch):
    monkeypatch.setattr(M, "SMALL", small)
    big, small = "é" * 40_000 + "\r\n\r\nWARC/1.1\r\n", "x" * 999
    rows = [(1, big), (2, big), (3, big), (4, small), (5, small), (6, None), (7, ""), (8, "y" * 1000), (9, "y" * 1000), (2, big), (10, "z" * 16384 * 3)]
    pages = spark.createDataFrame([(p, f"http://a b/\r\n{p}", h) for p, h in rows], "page_id long, url string, html string")
    pages = pages.withColumns({"digest": F.lit(1), "salt": F.lit("a"), "n": F.lit(2), "id": F.lit(3), "key": F.lit(1)})
    got = M.archived(pages).collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == expected(rows)
    none = spark.createDataFrame([(None, None, big), (None, None, None), (3, None, big)], "page_id long, url string, html string")
    got = {(r.page_id, r.record_type, r.refers_to) for r in M.archived(none).collect()}
    assert got == {(None, "revisit", 3), (None, "response", None), (3, "response", None)}
    assert M.archived(pages.limit(0)).count() == 0


def test_framing():
    for body in (b"", b"a", b"0\r\n\r\n" * 2000, bytes(range(256)) * 99):
        assert M.unchunked(M.chunked(body)) == body
    assert M.unchunked(b"5;ext=1\r\nhello\r\n0\r\nTrailer: x\r\n\r\n") == b"hello"
    assert M.unchunked(b"5\r\nhel") is None and M.unchunked(b"zz\r\n") is None


def test_damaged_segments(spark, tmp_path):
    text = "word " * 20_000
    parts = M.records("urn:page:5", "http://a/", text.encode(), hashlib.sha1(text.encode()).hexdigest(), None)
    assert len(parts) > 3
    archive = lambda xs: gzip.compress("".join(x + "\r\n\r\n" for x in xs).encode())
    for name, chosen, sound in (("whole", parts[::-1], True), ("gap", parts[:1] + parts[2:], False), ("cut", parts[:-1], False)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc.gz").write_bytes(archive(chosen[:2]) + archive(chosen[2:]))
        (r,) = M.read(spark, str(tmp_path / name)).collect()
        assert r.complete == sound and r.page_id == 5
        assert r.payload_bytes == (len(text) if sound else None)


@pytest.mark.parametrize("size", [3, 7, 16])
def test_segments_keep_characters_whole(size):
    block = "añ日\U0001f600b".encode() * 9
    at = 0
    for end in M.cuts(block, size):
        block[at:end].decode()
        assert 0 < end - at <= max(size, 4)
        at = end
    assert at == len(block)


def test_query_against_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    assert sorted(map(str, con.execute(M.sql()).fetchall())) == sorted(str(tuple(r)) for r in registered.op7(spark, sf).collect())
