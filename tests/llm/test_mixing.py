import re
import hashlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tremorline.llm import mixing as M
from tremorline.llm import registered


def test_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(M.sql()).fetchall())
    got = sorted(tuple(r) for r in registered.op2(spark, sf).collect())
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:3] == w[:3] and g[5] == w[5] and g[3:5] == pytest.approx(w[3:5], abs=2e-9)


def slow_rake(cells, share, powers=M.POWERS, rounds=M.ROUNDS):
    """cells: (source, lang, topic) -> tokens; probabilities by the definition."""
    total, p = sum(cells.values()), dict.fromkeys(cells, share)
    targets = []
    for i, power in enumerate(powers.values()):
        size = defaultdict(float)
        for c, n in cells.items():
            size[c[i]] += n
        whole = sum(n**power for n in size.values())
        targets.append({k: share * total * n**power / whole for k, n in size.items()})
    for _ in range(rounds):
        for i, target in enumerate(targets):
            now = defaultdict(float)
            for c, n in cells.items():
                now[c[i]] += n * p[c]
            p = {c: min(1.0, p[c] * target[c[i]] / now[c[i]]) if now[c[i]] > 0 else p[c] for c in p}
    return p, targets


def test_probabilities_and_sample(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = M.probabilities(docs).collect()
    cells = defaultdict(int)
    for r in rows:
        cells[r._source, r._lang, r._topic] += r._tokens
    want, targets = slow_rake(cells, M.SHARE)
    for r in rows:
        assert r._probability == pytest.approx(want[r._source, r._lang, r._topic], rel=1e-9)
        assert r._tokens == len(re.findall(r"[^ \t\n\x0b\f\r]+", texts[r.doc_id]))
        assert r._sampled == (int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:8], 16) / 2**32 < r._probability)
    expected, got = sum(r._probability for r in rows), sum(r._sampled for r in rows)
    assert abs(expected - got) < 4 * expected**0.5
    reached = {(r.margin, r.category): r.expected for r in M.marginals(docs).collect()}
    assert reached["topic", "prose"] == pytest.approx(targets[2]["prose"], rel=0.05)
    assert sum(v for (m, _), v in reached.items() if m == "lang") == pytest.approx(M.SHARE * sum(cells.values()), rel=0.1)


def test_a_rare_cell_shrinks_nothing(spark):
    rows = [(i, " ".join(["word"] * 50), "en" if i % 2 else "fr", f"s{i % 4}") for i in range(400)]
    schema = "doc_id long, text string, lang string, source string"
    a = {r.doc_id: r._probability for r in M.probabilities(spark.createDataFrame(rows, schema)).collect()}
    b = {r.doc_id: r._probability for r in M.probabilities(spark.createDataFrame([*rows, (400, "one stray line", "en", "new")], schema)).collect()}
    assert b[400] == 1.0 and all(b[i] == pytest.approx(a[i], rel=0.05) for i in a)


def test_given_targets(spark):
    rows = [(i, " ".join(["word"] * 50), "en", f"s{i % 4}", f"t{i % 3}") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string")
    got = M.marginals(docs, "topic", targets={"source": {"s0": 3, "s1": 1, "s2": 1}}, share=0.25).collect()
    have = {(r.margin, r.category): r.expected for r in got}
    assert [have["source", f"s{k}"] for k in range(4)] == pytest.approx([9000, 3000, 3000, 0])
    assert [have["topic", f"t{k}"] for k in range(3)] == pytest.approx([5000] * 3)


def test_both_ways_of_raking_agree(spark):
    rows = [(f"s{i % 7}", f"l{i % 3}", f"t{i % 5}", (i * 37) % 101) for i in range(60)]
    cells = spark.createDataFrame(rows, "_source string, _lang string, _topic string, n long").groupBy("_source", "_lang", "_topic").agg(F.sum("n").alias("n"))
    one = {r[:3]: r.m for r in M.rake(cells, rounds=2).collect()}
    two = {r[:3]: r.m for r in M.rake(cells, rounds=2, small=0).collect()}
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], rel=1e-12) for k in one)


def test_plan_has_no_python(spark, sf):
    plan = registered.op2(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_odd_rows(odd_docs, no_docs):
    rows = M.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r.topic for r in rows if r.doc_id in (1, 2)} == {M.NONE}
    assert all(0 <= r.probability <= 1 for r in rows)
    assert M.mix(no_docs).count() == 0
    clash = odd_docs.withColumn("m", F.lit(1)).withColumn("n", F.lit(2))
    assert M.mix_stage(None, clash, "").columns == ["doc_id", "text", "lang", "source", "n_chars"]
