import hashlib

import pytest

from tremorline.llm import pieces as M
from tremorline.llm import registered


@pytest.fixture(scope="module")
def vocabulary():
    return M.load()


@pytest.fixture(scope="module")
def coder(vocabulary):
    return M.Coder(vocabulary)


def slow(text, vocabulary):
    """Dynamic programme over all substrings of the whole text, without automaton, cuts or table."""
    score = {p: (s, i) for p, s, i in vocabulary["pieces"]}
    low = min(s for s, _ in score.values()) - M.UNKNOWN_LESS
    t = " " + text
    best = [(0.0, 0, None)]
    for end in range(1, len(t) + 1):
        found = None
        for start in range(max(0, end - 48), end):
            piece = score.get(t[start:end])
            if piece is None and end - start == 1:
                piece = (low, None)
            if piece is not None and (found is None or best[start][0] + piece[0] > found[0]):
                found = (best[start][0] + piece[0], start, piece[1])
        best.append(found)
    out, at = [], len(t)
    while at:
        _, start, i = best[at]
        out = ([i] if i is not None else [vocabulary["bytes"][b] for b in t[start:at].encode()]) + out
        at = start
    return out


TEXTS = ["Hello world", "  two  spaces ", "line\nbreak\n\n", "tab\there", "naïve çà où", "日本語 текст", "▁ literal", "a☃\U0001f9ff!", "x" * 50, "  \n  ", "internationalization of thereof"]


@pytest.mark.parametrize("text", TEXTS)
def test_against_plain_search(text, coder, vocabulary):
    assert coder.encode(text) == slow(text, vocabulary)
    assert coder.decode(coder.encode(text)) == text


def test_against_the_library(coder, tmp_path):
    """The library's own unigram search over the same pieces and scores (texts of known characters, where its floats are exact)."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    with open(M.MODEL, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    for piece in m.pieces:  # its floats lose the other scores beside those of runs of spaces
        piece.score = max(piece.score, -60000.0)
    sp = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    for text in ["Hello world", "thhaoner edsting of the", "le château où", "Zugeü chbetz vergeber", "for (int i = 0; i < n; i++)"]:
        assert coder.encode(text) == sp.encode(text), text


def test_query_round_trip(spark, sf, coder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = registered.op3(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id]
        assert r.n_tokens == len(r.token_ids) and r.decoded_chars == len(t)
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    for r in sorted(rows, key=lambda r: r.n_tokens)[:20]:
        assert r.token_ids == coder.encode(texts[r.doc_id])


def test_sample_of_texts_against_plain_search(spark, sf, coder, vocabulary):
    for r in spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 900").limit(15).collect():
        assert coder.encode(r.text) == slow(r.text, vocabulary)


def test_odd_rows(odd_docs, no_docs):
    rows = M.round_trip(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        if r.doc_id == 1:
            assert r.token_ids is None and r.n_tokens == 0 and r.decoded_sha256 is None
        if r.doc_id == 2:
            assert r.token_ids == [] and r.decoded_chars == 0
    assert M.round_trip(no_docs).count() == 0
    assert set(odd_docs.columns) < set(M.encode(odd_docs).columns)
