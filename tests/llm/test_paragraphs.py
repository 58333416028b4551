import numpy as np
import pytest

from tremorline.llm import paragraphs as M
from tremorline.llm import registered
from tremorline.llm import textkit as K
from tremorline.llm.components import local


def words(rng, n):
    return [f"w{int(x)}" for x in rng.integers(0, 5000, n)]


def planted():
    rng = np.random.default_rng(8)
    passage = words(rng, 60)
    rows = []
    for i in range(60):
        w = words(rng, int(rng.integers(30, 200)))
        if i % 3 == 0:
            k = int(rng.integers(0, len(w)))
            w[k:k] = passage
        if i % 5 == 0:
            w[10:10] = "this common line is in many texts of the set".split()
        rows.append((i, " ".join(w).replace(" w7", "\nw7")))
    return rows, passage


def paragraphs_of(text):
    """Words cut one window at a time."""
    w = text.lower().split()
    buf, offsets = K.pack([text.encode()])
    u = M.Units(buf, offsets)
    pair = [int(u.over(np.array([i]), np.array([i + 2]))[0]) for i in range(len(w) - 1)]
    cuts = {0}
    for s in range(len(pair) - M.WINDOW + 1):
        cuts.add(min(range(s, s + M.WINDOW), key=lambda i: (pair[i] >> 32, i)))
    edges = [*sorted(cuts), len(w)]
    return [(a, tuple(w[a:b])) for a, b in zip(edges, edges[1:]) if b - a >= M.LEAST]


def slow(rows):
    """Removed (doc, first word, words) by comparing all paragraphs with all."""
    units = [(d, a, p) for d, t in sorted(rows) for a, p in paragraphs_of(t)]
    sets = [frozenset(p[i : i + M.SHINGLE] for i in range(len(p) - M.SHINGLE + 1)) for _, _, p in units]
    label = list(range(len(units)))
    for i in range(len(units)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= M.SIMILAR * len(sets[i] | sets[j]):
                x, y = label[i], label[j]
                label = [min(x, y) if v in (x, y) else v for v in label]
    out = []
    late = {(units[i][0], units[i][1]): len(units[i][2]) for i in range(len(units)) if label[i] != i}
    for (d, a), n in late.items():
        run, at = n, a
        while (prev := next(((x, k) for (e, x), k in late.items() if e == d and x + k == at), None)):
            run, at = run + prev[1], prev[0]
        at = a + n
        while (d, at) in late:
            run, at = run + late[d, at], at + late[d, at]
        if run >= M.RUN:
            out.append((d, a, n, run))
    return sorted(out)


def test_planted_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(M, "BANDS", 40)  # so many that banding misses nothing here
    monkeypatch.setattr(M, "ROWS", 1)
    monkeypatch.setattr(M, "_SEEDS", K.mix(np.arange(1, 41, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1))
    rows, passage = planted()
    texts = spark.createDataFrame(rows, "rid long, text string")
    _keys = M._keys
    seeds = M._SEEDS

    def keys(batches):
        M.BANDS, M.ROWS, M._SEEDS = 40, 1, seeds
        yield from _keys(batches)

    monkeypatch.setattr(M, "_keys", keys)
    found = M.repeats(texts).collect()
    got = []
    by = dict(rows)
    for r in found:
        got.append((r.rid, len(by[r.rid].encode()[: r.a].split()), r.words, r.run_words))
    assert sorted(got) == slow(rows)
    assert {r.rid for r in found} == {i for i in range(3, 60, 3)}


def test_default_bands_find_planted_passages(spark):
    rows, passage = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = M.dedup(df).collect()
    assert {r.doc_id for r in got} == set(range(3, 60, 3)) and {r.first_doc_id for r in got} == {0}
    by = dict(rows)
    for r in got:
        piece = by[r.doc_id].encode()[r.start_byte : r.end_byte].decode()
        assert len(piece.split()) == r.n_words and len(set(piece.split()) - set(passage)) <= 2  # a similar paragraph may reach past it


@pytest.mark.parametrize("n", [5, 120])
def test_peeling_equals_all_pairs(n):
    rng = np.random.default_rng(n)
    base = [rng.choice(60, 20, replace=False) for _ in range(4)]
    sets = []
    for i in range(n):
        s = base[i % 4].copy()
        s[: i % 5] = rng.integers(100, 130, i % 5)
        sets.append(np.unique(s))
    offsets = np.r_[0, np.cumsum([len(s) for s in sets])]
    flat = np.concatenate(sets)
    i, j = np.triu_indices(n, 1)
    sim = M.similarity(flat, offsets, i, j)
    want = [len(set(sets[x]) & set(sets[y])) / len(set(sets[x]) | set(sets[y])) for x, y in zip(i, j)]
    assert np.allclose(sim, want)
    whole = local(n, i[sim >= M.SIMILAR], j[sim >= M.SIMILAR])
    assert (local(n, *M.linked(flat, offsets)) == whole).all()
    assert (local(n, *M.filtered(flat, offsets)) == whole).all()
    assert (M.similarity(flat, offsets, i, j, M.SIMILAR) >= M.SIMILAR).tolist() == (sim >= M.SIMILAR).tolist()


def test_a_quoted_line_is_not_compared():
    """A thousand sets that share most shingles but are not similar, and one group of copies among them."""
    rng = np.random.default_rng(3)
    line = np.arange(9)
    sets = [np.unique(np.r_[line, rng.integers(100, 10**9, 7)]) for _ in range(1000)]
    copy = np.unique(np.r_[line, rng.integers(100, 10**9, 7)])
    sets += [np.unique(np.r_[copy[:-1], 10**9 + k]) for k in range(100)]
    offsets, flat = np.r_[0, np.cumsum([len(s) for s in sets])], np.concatenate(sets)
    seen = []
    plain = M.similarity

    def counted(f, o, i, j, least=0.0):
        seen.append(len(i))
        return plain(f, o, i, j, least)

    M.similarity = counted
    try:
        label = local(len(sets), *M.filtered(flat, offsets))
    finally:
        M.similarity = plain
    assert (label[:1000] == np.arange(1000)).all() and (label[1000:] == 1000).all()
    assert sum(seen) < 60_000


def test_colliding_over_batches():
    import pyarrow as pa

    rows = [(1, 1), (1, 1), (2, 5), (2, 6), (2, 6), (3, 1), (4, 1), (4, 2), (4, 3), (5, 9), (5, 9)]
    want = {(2, 5), (2, 6), (4, 1), (4, 2), (4, 3)}
    for size in range(1, 12):
        parts = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + size]], pa.int64()) for k in (0, 1)], names=["key", "pid"]) for i in range(0, len(rows), size)]
        got = [x for b in M._colliding(iter(parts)) for x in zip(b.column("key").to_pylist(), b.column("pid").to_pylist())]
        assert sorted(got) == sorted(want), size


def test_query_and_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = registered.op9(spark, sf).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id: r for r in M.dedup_stage(spark, docs, sf).collect()}
    assert kept.keys() == texts.keys()
    hit = {r.doc_id for r in found}
    for d, t in texts.items():
        assert kept[d].n_chars == len(kept[d].text)
        assert (kept[d].text != t) == (d in hit)
    assert all(r.first_doc_id <= r.doc_id and r.run_words >= M.RUN for r in found)


def test_odd_rows(odd_docs, no_docs):
    rows = M.dedup(odd_docs).collect()
    assert {r.doc_id for r in rows} <= {4}
    assert M.dedup(no_docs).count() == 0
    kept = M.dedup_stage(None, odd_docs, "")
    assert kept.count() == odd_docs.count()
    assert {r.n_chars for r in kept.collect() if r.doc_id == 1} == {None}


@pytest.mark.parametrize("seed", range(6))
def test_large_groups_of_whole_texts(seed):
    """Near copies of a few long sets, strangers, and sets between clusters: the components of all pairs."""
    rng = np.random.default_rng(seed)
    base = [rng.integers(0, 1 << 40, 200) for _ in range(3)]
    base.append(np.r_[base[0][:110], base[1][110:]])
    sets = []
    for i in range(260):
        s = base[i % 4].copy() if i % 9 else np.r_[base[0][:20], rng.integers(0, 1 << 40, 180)]
        k = int(rng.integers(0, 30))
        s[rng.choice(200, k, replace=False)] = rng.integers(0, 1 << 40, k)
        sets.append(np.unique(s))
    n = len(sets)
    offsets, flat = np.r_[0, np.cumsum([len(s) for s in sets])], np.concatenate(sets)
    i, j = np.triu_indices(n, 1)
    good = M.similarity(flat, offsets, i, j) >= M.SIMILAR
    want = local(n, i[good], j[good])
    assert (local(n, *M.filtered(flat, offsets)) == want).all() and (local(n, *M.linked(flat, offsets)) == want).all()


@pytest.mark.parametrize("changed", [15, 40])
def test_thousands_of_near_copies_take_seconds(changed):
    """Copies within the similarity, and copies that overlap as much but stay below it."""
    import time

    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 40, 500)
    sets = []
    for _ in range(2000):
        s = base.copy()
        s[rng.choice(500, changed, replace=False)] = rng.integers(0, 1 << 40, changed)
        sets.append(np.unique(s))
    offsets, flat = np.r_[0, np.cumsum([len(s) for s in sets])], np.concatenate(sets)
    began = time.perf_counter()
    a, b = M.filtered(flat, offsets)
    assert time.perf_counter() - began < 30
    i, j = rng.integers(0, 2000, (2, 2000))
    label = local(2000, a, b)
    assert (label[i] == label[j])[M.similarity(flat, offsets, i, j) >= M.SIMILAR].all()
