import hashlib

import numpy as np
import pyarrow as pa
import pytest

from tremorline.llm import registered
from tremorline.llm import substrings as M


def slow(rows, width=M.WIDTH):
    """rows: (doc_id, text), one window at a time; -> (doc_id, n_bytes, n_removed, n_spans, sha)."""
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - width + 1):
            w = b[s : s + width]
            if w in seen:
                gone[s : s + width] = True
            seen.add(w)
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        out.append((doc, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def planted():
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdefgh ijé\n"))
    fresh = lambda n: "".join(rng.choice(letters, n))
    passage, edge = fresh(400), fresh(99)
    rows = [(i * 3, fresh(int(rng.integers(0, 300)))) for i in range(30)]
    rows += [(200 + i, fresh(40) + passage[i : 300 + i] + fresh(70)) for i in range(40)]
    rows += [(300, edge + "X"), (301, "Y" + edge), (302, edge + edge + edge), (303, None), (304, ""), (305, "a" * 1000), (306, "ab" * 300 + "c" + "ab" * 300), (307, "a" * 99), (308, "a" * 100)]
    near = fresh(900)
    rows += [(400 + i, near[: 50 * i] + "#" + near[50 * i :]) for i in range(15)]
    rows += [(500, fresh(100) + rows[0][1] + passage), (501, passage), (502, passage + passage)]
    return rows


@pytest.mark.parametrize("hot", [M.HOT, 0])
def test_planted(spark, hot, monkeypatch):
    monkeypatch.setattr(M, "SAMPLE", 1)
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in M.dedup(df, hot).collect()) == slow(rows)


def test_some_grams_hot(spark, monkeypatch):
    """A mix of both ways: only grams with more than 20 runs are hot."""
    monkeypatch.setattr(M, "SAMPLE", 1)
    monkeypatch.setattr(M.K, "partitions", lambda s: 1000)
    rows = planted()
    texts = spark.createDataFrame(rows, "rid long, text string")
    assert 0 < len(M._hot(texts, 20)) < 200
    assert sorted(tuple(r) for r in M.dedup(texts.withColumnRenamed("rid", "doc_id"), 20).collect()) == slow(rows)


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in registered.op8(spark, sf).collect()) == slow(rows)


def test_long_texts_in_tiles(spark, monkeypatch):
    rng = np.random.default_rng(2)
    t = "".join(rng.choice(list("abcdefgh"), 5000))
    buf = np.frombuffer((t + t).encode(), np.uint8)
    monkeypatch.setattr(M, "TILE", 700)
    monkeypatch.setattr(M.K, "CHUNK", 700)
    monkeypatch.setattr(M.K.chunks, "__defaults__", (700,))
    tiles = list(M._tiles(buf, np.array([0, len(buf)])))
    assert len(tiles) > 10
    seen = np.zeros(len(buf) - M.WIDTH + 1, int)
    for _, place, part, ends in tiles:
        for s, c in zip(*M.runs(part, ends)[:2]):
            seen[place + s : place + s + c] += 1
    assert (seen == 1).all()


def test_odd_rows(spark, odd_docs, no_docs):
    rows = M.dedup(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {(r.n_bytes, r.n_removed, r.kept_sha256) for r in rows if r.doc_id in (1, 2)} == {(0, 0, hashlib.sha256(b"").hexdigest())}
    assert len({tuple(r) for r in rows if r.doc_id == 5}) == 1
    assert M.dedup(no_docs).count() == 0
    t = "some text that is quite long, " * 10
    twice = spark.createDataFrame([(None, t), (4, t), (4, "x" + t), (4, t)], "doc_id long, text string")
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in M.dedup(twice).collect()}
    assert got[None, 300] == 270  # all but the first period
    assert got[4, 300] == 300 and got[4, 301] == 300


def test_periodic_texts_send_few_runs(spark):
    """Long texts of one letter, of a short and of a long period: a run of each content, not one of each byte."""
    rng = np.random.default_rng(2)
    long = "".join(rng.choice(list("abcdefgh "), 700))
    texts = ["a" * 200_000, "ab " * 60_000, long * 300]
    for t in texts:
        sent = sum(b.num_rows for b in M._runs(iter([pa.RecordBatch.from_arrays([pa.array([7]), pa.array([t])], names=["rid", "text"])])))
        assert sent < 2000, sent
    rows = [(i, t) for i, t in enumerate([*texts, "a" * 150, long[:300], "b" + "a" * 99])]
    assert sorted(tuple(r) for r in M.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == slow(rows)


def test_gram_choice_does_not_depend_on_the_buffer():
    """The same window chooses the same gram inside a short text and inside a long one."""
    rng = np.random.default_rng(9)
    long = rng.integers(97, 123, 3_000_000).astype(np.uint8)
    at = 2_500_000
    short = long[at : at + 5000]
    gram = [dict(zip(s.tolist(), g.tolist())) for s, _, g, _ in (M.runs(x, np.array([0, len(x)])) for x in (short, long))]
    same = [s for s in gram[0] if s and s + at in gram[1]]
    assert len(same) >= len(gram[0]) - 2 and all(gram[0][s] == gram[1][s + at] for s in same)
