import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tremorline.llm import registered
from tremorline.llm import simhash as M
from tremorline.llm import textkit as K
from tremorline.llm.components import components, local


def slow_print(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows):
    """rows: (doc_id, print). All pairs."""
    p = np.array([r[1] for r in rows], np.uint64)
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(p[i] ^ p[i + 1 :]) <= 3) + i + 1:
            a, b = find(i), find(int(j))
            label[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return {r[0]: least[find(i)] for i, r in enumerate(rows)}


def test_query(spark, sf):
    rows = registered.op6(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert r.fingerprint == f"{slow_print(texts[r.doc_id]):016x}"
    want = slow_components(sorted((r.doc_id, int(r.fingerprint, 16)) for r in rows))
    assert {r.doc_id: r.component_id for r in rows} == want


def test_prints_of_edge_texts():
    texts = ["", "  ", "One", "One TWO", "one two", "A B C D", "é È ß", "x\x0by\x0cz\tw", "a " * 3000, "word " * 256 + "end", "    z"]
    got = M.simhash(*K.pack([t.encode() for t in texts]))
    assert got.tolist() == [slow_print(t) for t in texts]


def planted(n, seed):
    """Random prints, chains of near ones and a dense ball."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, n, dtype=np.uint64)
    out = [base]
    for k in range(3):
        flips = np.array([np.bitwise_xor.reduce([np.uint64(1) << np.uint64(b) for b in rng.integers(0, 64, k + 1)]) for _ in range(n // 4)], np.uint64)
        out.append(base[: n // 4] ^ flips)
    ball = base[0] ^ np.array([np.bitwise_xor.reduce([np.uint64(1) << np.uint64(b) for b in rng.integers(0, 12, 6)]) for _ in range(n // 2)], np.uint64)
    return np.unique(np.concatenate([*out, ball]))


@pytest.mark.parametrize("seed", [1, 2])
def test_tree_finds_all_links(seed, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 16)
    p = planted(600, seed)
    a, b = np.nonzero(np.triu(np.bitwise_count(p[:, None] ^ p[None, :]) <= 3, 1))
    assert (M.links(p) == local(len(p), a, b)).all()
    top = M.Top(p[::5], 4)
    shard, who = top.route(p)
    homes = [set() for _ in p]
    for s, w in zip(shard.tolist(), who.tolist()):
        homes[w].add(s)
    assert all(homes[i] & homes[j] for i, j in zip(a.tolist(), b.tolist()))
    assert top.shards > 4


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr(M, "SHARD", 200)
    p = planted(900, 3)
    points = spark.createDataFrame([(int(x),) for x in p.view(np.int64)], "print long")
    roots = dict(tuple(r) for r in components(M.pair_links(points, len(p))).collect())
    a, b = np.nonzero(np.triu(np.bitwise_count(p[:, None] ^ p[None, :]) <= 3, 1))
    label = local(len(p), a, b)
    group = Counter(label.tolist())
    signed = p.view(np.int64).tolist()
    by = {}
    for i, x in enumerate(signed):
        if group[label[i]] > 1:
            by.setdefault(label[i], set()).add(roots[x])
        else:
            assert x not in roots
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(i, i + 1) for i in range(50)] + [(100, int(x)) for x in rng.integers(101, 400, 200)] + [(7, 7), (None, 3), (500, 501), (501, 500)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(51)} == {0} and got[501] == got[500] == 500
    assert {v for k, v in got.items() if 100 <= k < 400} == {100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd_docs, no_docs):
    rows = M.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    zero = [r for r in rows if r.doc_id in (1, 2, 3)]
    assert {(r.fingerprint, r.component_id) for r in zero} == {("0" * 16, 1)}
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert M.near_duplicates(no_docs).count() == 0
    kept = M.dedup_stage(None, odd_docs.withColumn("root", F.lit(1)), "")
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 4, 5, 6, 7, 8]
