import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tremorline.llm import ngrams as M
from tremorline.llm import registered


def slow(texts, order):
    words = [re.findall(r"[^ \t\n\x0b\f\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    count = Counter(tuple(w[i : i + k]) for w in words for k in range(1, order + 1) for i in range(len(w) - k + 1))
    total = sum(map(len, words))
    out = []
    for w in words:
        log, single = 0.0, 0
        for i, x in enumerate(w):
            for k in range(order, 0, -1):
                g = tuple(w[i - k + 1 : i + 1]) if i - k + 1 >= 0 else None
                if g and (k == 1 or count[g] >= M.SEEN):
                    log += math.log(M.ALPHA ** (order - k) * count[g] / (count[g[:-1]] if k > 1 else total))
                    single += k == 1
                    break
        out.append((len(w), log, single))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_brute_force(spark, sf, order):
    rows = spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()
    df = spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, pytest.approx(r.log_score), r.n_unigram) for r in M.score(df, order).collect()}
    for r, want in zip(rows, slow([r.text for r in rows], order)):
        assert want == got[r.doc_id]


def test_packed_keys():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**64, 1000, dtype=np.uint64))
    for k in (keys, keys[:1], keys[:0], np.array([0, 2**64 - 1], np.uint64)):
        assert (M.unpacked(M.packed(k), len(k)) == k).all()


@pytest.mark.parametrize("order", [1, 2, 3])
def test_small_blocks_cut_long_texts(spark, sf, order):
    """Blocks of 300 bytes: nearly every text is cut, and the results stay."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()
    df = spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, pytest.approx(r.log_score), r.n_unigram) for r in M.score(df, order, block=300).collect()}
    for r, want in zip(rows, slow([r.text for r in rows], order)):
        assert want == got[r.doc_id]


def test_every_ngram_counts_with_seen_of_one(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b d")], "doc_id long, text string")
    got = {r.doc_id: r.log_score for r in M.score(df, 2, seen=1).collect()}
    assert got[1] == pytest.approx(math.log(0.4 * 2 / 6) + math.log(2 / 2) + math.log(1 / 2))


def test_inputs_with_shuffles_are_written_first(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    a = sorted(tuple(r) for r in M.registered(df).select("doc_id", "n_tokens", "n_unigram").collect())
    b = sorted(tuple(r) for r in M.registered(df.repartition(5)).select("doc_id", "n_tokens", "n_unigram").collect())
    assert a == b


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(M.sql()).fetchall())
    got = sorted(tuple(r) for r in registered.op10(spark, sf).collect())
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:2] == w[:2] and g[4] == w[4] and g[2:4] == pytest.approx(w[2:4], abs=2e-5)


def test_odd_rows(odd_docs, no_docs):
    rows = M.score(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {(r.n_tokens, r.log_score, r.mean_log) for r in rows if r.doc_id in (1, 2, 3)} == {(0, 0.0, None)}
    a, b = [r for r in rows if r.doc_id == 5]
    assert a == b and a.n_unigram == 1  # its copy makes every pair seen
    assert M.score(no_docs).count() == 0
