import hashlib

import numpy as np
import pytest

import corpus_pipeline as P
from tremorline.llm import langid, mixing, paragraphs, pieces, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Every stage's input and output rows."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (name, stage) in enumerate(P.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, sf).write.parquet(path)
        after = spark.read.parquet(path)
        if k < len(P.STAGES) - 1:
            assert after.columns == COLUMNS, name
        out.append(({r.doc_id: r for r in docs.select(*COLUMNS).collect()}, {r.doc_id: r for r in after.collect()}, docs))
        docs = after
    return dict(zip([n for n, _ in P.STAGES], out))


def test_language_stage_keeps_documents_of_known_and_labelled_languages(stages):
    before, after, docs = stages["language_id"]
    names, prior, table = langid.fit(docs.withColumn("h", langid.held_out()).where("not h"))
    ids = sorted(before)
    want = set()
    for i, b, s, g in zip(ids, *langid.score([before[i].text or "" for i in ids], prior, table)):
        wrong = before[i].lang in names and before[i].lang != names[b] and s >= 0.9
        if b >= 0 and s >= 0.5 and g > 1 - 16 * np.log(2) and not wrong:
            want.add(i)
    assert set(after) == want
    assert all(after[i] == before[i] for i in after)


def test_simhash_stage_keeps_one_of_each_group(stages):
    from tests.llm.test_near import slow

    before, after, _ = stages["simhash_near_dedup"]
    assert set(after) == slow([(i, r.text) for i, r in before.items()])
    assert all(after[i] == before[i] for i in after)


def test_substring_stage_cuts_what_the_operator_found(stages, spark):
    before, after, docs = stages["substring_dedup"]
    spans = {}
    for r in paragraphs.dedup(docs).collect():
        spans.setdefault(r.doc_id, []).append((r.start_byte, r.end_byte))
    assert set(after) == set(before)
    for i, r in before.items():
        raw = r.text.encode()
        gone = np.zeros(len(raw), bool)
        own = sorted(spans.get(i, []))
        for k, (a, b) in enumerate(own):
            gone[a:b] = True
            if k and not raw[own[k - 1][1] : a].strip():
                gone[own[k - 1][1] : a] = True
        assert after[i].text == np.frombuffer(raw, np.uint8)[~gone].tobytes().decode()
        assert after[i].n_chars == len(after[i].text)


def test_mixing_stage_keeps_the_sampled(stages):
    before, after, docs = stages["mixing"]
    drawn = {r.doc_id: r._probability for r in mixing.probabilities(docs).collect()}
    assert set(after) == {i for i, p in drawn.items() if int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) / 2**32 < p}
    assert all(after[i] == before[i] for i in after)


def test_last_stage_encodes_every_text(stages):
    before, after, _ = stages["sentencepiece"]
    coder = pieces.Coder(pieces.load())
    assert set(after) == set(before)
    for r in after.values():
        assert r.token_ids == coder.encode(r.text) and r.n_tokens == len(r.token_ids)
        assert coder.decode(r.token_ids) == r.text


def test_run_is_the_chain_of_stages(stages, spark, sf):
    got = {r.doc_id: r.token_ids for r in P.run(spark, sf).collect()}
    assert got == {i: r.token_ids for i, r in stages["sentencepiece"][1].items()}


def test_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in P.STAGES:
            docs = stage(spark, docs, "")
            assert docs.columns[:5] == COLUMNS
        assert docs.count() <= 10
