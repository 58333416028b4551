import hashlib

import numpy as np
import pytest

from tremorline.llm import fingerprints as M
from tremorline.llm import registered


def slow(text):
    """One paragraph, one shingle at a time."""
    wide, lanes = np.zeros(16, np.uint32), np.zeros(M.LANES, np.int64)
    for line in (text or "").split("\n"):
        w = line.split()
        if w:
            wide += np.frombuffer(hashlib.blake2b(line.encode()).digest(), "<u4")
    return wide


@pytest.fixture(scope="module")
def got(spark, sf):
    return [r.asDict() for r in registered.op5(spark, sf).collect()], {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_against_brute_force(got):
    rows, texts = got
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    order = sorted(texts, reverse=True)
    for r in rows:
        t = texts[r["doc_id"]]
        nxt = texts[order[(order.index(r["doc_id"]) + 1) % len(order)]]
        h = len(t) // 2
        edited = t[: len(t) - h] + nxt[:h]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == M.fingerprint(t) and r["edited_fingerprint"] == M.fingerprint(edited)
        assert (M.from_text([r["fingerprint"]])[0][0] == slow(t)).all()
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1


def test_edit_is_nearer_than_next(got):
    rows = [r for r in got[0] if r["n_chars"] > 400]
    assert np.mean([r["near_edited"] > r["near_next"] for r in rows]) > 0.95
    assert np.mean([r["near_edited"] for r in rows]) > 0.4


def test_order_insert_delete():
    a, b, c = "one two three four\n", "five six seven\n", "eight"
    whole = M.fingerprint(a + b + c)
    assert whole == M.fingerprint("eight\n" + b + a)
    assert M.insert(M.fingerprint(a + b), M.fingerprint(c)) == whole
    assert M.delete(whole, M.fingerprint(c)) == M.fingerprint(a + b)
    assert M.fingerprint(a + a) != M.fingerprint(a)
    assert M.fingerprint(None) == M.fingerprint("") == "0" * M.HEX


def test_odd_rows(odd_docs, no_docs):
    rows = M.edited_likeness(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    same = [r.fingerprint for r in rows if r.doc_id == 5]
    assert len(set(same)) == 1
    assert {r.n_chars for r in rows if r.doc_id in (1, 2)} == {0}
    assert M.edited_likeness(no_docs).count() == 0
    assert M.fingerprints(odd_docs).count() == odd_docs.count()
    one = odd_docs.where("doc_id = 6")
    (r,) = M.edited_likeness(one).collect()
    assert r.near_next == 1.0


def test_many_copies_of_a_line_do_not_wrap():
    line = "the same short line over and over\n"
    a, b = (M.vectors(*M.K.pack([(line * n + "another end\n").encode()])) for n in (50_000, 50_001))
    assert M.likeness(a, b)[0] > 0.999 and not (a[0] == b[0]).all()


def test_updates_of_a_table(spark):
    texts = {1: ["one line here", "two", "three words more"], 2: ["only this"], 3: []}
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    before = M.fingerprints(frame([(i, "\n".join(p)) for i, p in texts.items()]))
    inserted = frame([(1, "new paragraph"), (2, "only this"), (4, "fresh\nand more"), *[(3, f"line {k}") for k in range(500)]])
    deleted = frame([(1, "two"), (2, "only this"), (2, "only this")])
    got = {r.doc_id: r.fingerprint for r in M.updated(before, inserted, deleted).collect()}
    want = {1: "three words more\nnew paragraph\none line here", 2: "", 3: "\n".join(f"line {k}" for k in range(500)), 4: "and more\nfresh"}
    assert got == {i: M.fingerprint(t) for i, t in want.items()}
