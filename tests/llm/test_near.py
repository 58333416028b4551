import re
from collections import Counter

import numpy as np

from tremorline.llm import simhash
from tests.llm.test_simhash import slow_components, slow_print


def sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^ \t\n\x0b\f\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))))
    return out


def slow(rows):
    """Smallest id of each component of pairs of similarity 0.8 or more; rows: (id, text)."""
    rows = sorted(rows)
    s, label = sets([t for _, t in rows]), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]):
                x, y = sorted((label[i], label[j]))
                label = [x if v == y else v for v in label]
    return {rows[k][0] for k in set(label)}


def test_stage_against_all_pairs_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = slow(rows)
    assert {r.doc_id for r in simhash.dedup_stage(spark, docs, sf).collect()} == want
    three_bits = set(slow_components(sorted((i, slow_print(t)) for i, t in rows)).values())
    assert want < three_bits  # near copies that the query's rule leaves


def test_recall_of_edited_copies(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(300):
        w = [f"w{int(x)}" for x in rng.integers(0, 3000, int(rng.integers(50, 200)))]
        rows.append((2 * k, " ".join(w)))
        w[int(rng.integers(5, len(w) - 5))] = "changed"  # Jaccard 0.8 to 0.95
        rows.append((2 * k + 1, " ".join(w)))
    kept = Counter(r.doc_id % 2 for r in simhash.dedup_stage(spark, spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"), "").collect())
    want = Counter(i % 2 for i in slow(rows))
    assert kept[0] == want[0] == 300 and want[1] <= kept[1] <= want[1] + 3
