import math

import duckdb
import pytest

from tremorline.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(rows, names):
    def one(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 9) + 0.0
        return v

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(one(r[i]) for i in order) for r in rows), key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=2.1e-5)
    return a == b


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_duckdb(name, spark, sf, con):
    df = catalogue.QUERIES[name](spark, sf)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in cur.description]
    want = plain(cur.fetchall(), names)
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want) and len(got) > 0
    bad = [(g, w) for g, w in zip(got, want) if not all(same(x, y) for x, y in zip(g, w))]
    assert not bad, bad[:3]


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(name, spark, sf):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_stream_of_events_equals_replay(spark, sf):
    one, two = (sorted(tuple(r) for r in catalogue.QUERIES[n](spark, sf).select("node", "t", "level", "angle_deg", "handling_like").collect()) for n in ("fast_alarm_stream", "fast_alarm_replay"))
    assert one == two and one
