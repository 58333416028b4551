import numpy as np
import pytest

from tests.llm.test_paragraphs import words
from tremorline.llm import paragraphs as M


def test_share_of_repeated_words_removed(spark):
    """Passages of 60 to 400 words inside other text: nearly all of their words go."""
    rng = np.random.default_rng(12)
    rows, passages = [], []
    for i in range(150):
        p = [f"p{i}x{int(x)}" for x in rng.integers(0, 5000, [60, 100, 400][i % 3])]
        passages.append(p)
        for k in (0, 1):
            w = words(rng, 80)
            w[40:40] = p
            rows.append((2 * i + k, " ".join(w)))
    got = {}
    by = dict(rows)
    for r in M.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        piece = by[r.doc_id].encode()[r.start_byte : r.end_byte].decode().split()
        own = sum(x.startswith("p") for x in piece)
        assert len(piece) == r.n_words and own >= r.n_words - 2  # a similar paragraph may reach past the passage
        got[r.doc_id] = got.get(r.doc_id, 0) + own
    assert all(d % 2 for d in got)
    share = sum(got.values()) / sum(map(len, passages))
    assert share >= 0.97, share


@pytest.mark.parametrize("n,changes", [(51, 0), (60, 1), (100, 2)])
def test_edited_passages_go_whole(spark, n, changes):
    """Passages whose second copy has changed, added or dropped words (Jaccard of 0.8 and more): found, and to their ends."""
    rng = np.random.default_rng(n)
    rows, kept = [], []
    for i in range(200):
        p = [f"p{i}x{int(x)}" for x in rng.integers(0, 5000, n)]
        edited = list(p)
        for k in sorted(rng.choice(np.arange(1, n - 1), changes, replace=False).tolist(), reverse=True):
            edited[k : k + 1] = [[f"q{i}x{k}"], [], [p[k], f"q{i}x{k}"]][i % 3]
        for k, own in enumerate((p, edited)):
            w = words(rng, 80)
            w[40:40] = own
            rows.append((2 * i + k, " ".join(w)))
        kept.append(len(edited))
    got = {}
    by = dict(rows)
    for r in M.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        piece = by[r.doc_id].encode()[r.start_byte : r.end_byte].decode().split()
        own = sum(x[0] in "pq" for x in piece)
        assert own >= r.n_words - 2
        got[r.doc_id] = got.get(r.doc_id, 0) + own
    assert all(d % 2 for d in got)
    assert len(got) >= 0.97 * 200, len(got)
    assert sum(got.values()) >= 0.93 * sum(kept), sum(got.values()) / sum(kept)


def test_unlike_words_end_a_repeat():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 40, 60)
    other = h.copy()
    other[10:30] = 7
    assert M.alike(h, other, 20) == (10, 10)  # twenty words differ
    other = h.copy()
    other[[5, 12, 19, 26]] = 7
    assert M.alike(h, other, 10)[0] < 20  # too many changes for a similarity of 0.8
    assert M.alike(h, np.r_[h[:30], [7], h[30:]][:60], 60) == (59, 60)
    assert M.alike(h[:3], h[:3], 0) == (3, 3) and M.alike(h[:0], h, 9) == (0, 0)


def test_banding_recall_on_pairs_of_the_table(spark, sf):
    """Pairs of paragraphs of the table's texts with a Jaccard similarity of 0.8 or more that share a key."""
    from collections import defaultdict

    from tremorline.llm import textkit as K

    units = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        buf, offsets = K.pack([(r.text or "").encode()])
        u = M.Units(buf, offsets)
        keys, (s, count) = u.keys(), u.shingles()
        at = np.cumsum(count) - count
        for i, p in enumerate(u.over(u.begin, u.end).tolist()):
            units[p] = (frozenset(s[at[i] : at[i] + count[i]].tolist()), frozenset(keys[i].tolist()))
    holders = defaultdict(list)
    for p, (s, _) in units.items():
        for x in s:
            holders[x].append(p)
    pairs = {(a, b) for v in holders.values() if len(v) < 200 for a in v for b in v if a < b}
    true = [(a, b) for a, b in pairs if len(units[a][0] & units[b][0]) >= M.SIMILAR * len(units[a][0] | units[b][0])]
    found = sum(bool(units[a][1] & units[b][1]) for a, b in true)
    assert len(true) < 20 or found >= 0.93 * len(true), (found, len(true))
