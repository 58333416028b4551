"""Queries that once stopped at a number of rows, on events beyond it."""

import numpy as np
import pytest

from tremorline.operators import models, signal
from tremorline.plans import catalogue


@pytest.fixture(scope="module")
def late(spark, tmp_path_factory):
    """Events of one kind with ids from 30,000, two hours apart, so that each is a session."""
    rng = np.random.default_rng(4)
    path = tmp_path_factory.mktemp("late")
    value, raw = rng.normal(50, 10, 900), rng.integers(0, 100, 900)
    rows = [(30_000 + i, i % 7, 1_704_067_200 + 7_200 * i, float(value[i] + (i > 450) * 0.05 * (i - 450)), '{"k": %d}' % raw[i]) for i in range(900)]
    spark.createDataFrame(rows, "event_id long, user_id long, s long, value double, props string").selectExpr(
        "event_id", "user_id", "timestamp_seconds(s) ts", "'click' event_type", "value", "props"
    ).write.parquet(f"{path}/events.parquet")
    return str(path)


def slopes(x, y):
    i, j = np.triu_indices(len(x), 1)
    return (y[j] - y[i]) / (x[j] - x[i])


def test_lag_of_late_events(spark, late):
    assert [(r.node, r.lag) for r in catalogue.QUERIES["stream_alignment"](spark, late).collect()] == [("click", 7)]


def test_best_lag_equals_direct_correlation():
    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (5, 9), (300, 128), (1000, 993)):
        a, b = rng.normal(size=n), rng.normal(size=m)
        full = np.correlate(a - a.mean(), b - b.mean(), "full")
        assert full[signal.best_lag(a, b) + m - 1] == pytest.approx(full.max(), abs=1e-9)


def test_slopes_over_all_sessions(spark, late):
    st = sorted((r.start_us, r.u) for r in catalogue.stab(spark, late).collect())
    assert len(st) == 900
    x, y = np.array(st).T
    (one,) = catalogue.QUERIES["theil_sen_slope"](spark, late).collect()
    assert one.slope == pytest.approx(np.median(slopes(x / 3.6e9, y)), abs=1e-6)
    (two,) = catalogue.QUERIES["trend_interval"](spark, late).collect()
    assert two.slope_day == pytest.approx(np.median(slopes(x / 8.64e10, y)), abs=1e-6)


@pytest.mark.parametrize("tied", [False, True])
def test_ranked_slopes_in_blocks(tied):
    rng = np.random.default_rng(1)
    x, y = np.arange(200.0), rng.integers(0, 3, 200) * 1.0 if tied else rng.normal(size=200)
    x[50] = x[49]
    i, j = np.triu_indices(200, 1)
    want = np.sort((y[j] - y[i])[x[i] != x[j]] / (x[j] - x[i])[x[i] != x[j]])
    ranks = [0, 7, len(want) // 2, len(want) - 1]
    assert models.ranked_slopes(x, y, lambda m: ranks, held=300) == want[ranks].tolist()


def test_calibration_of_late_events(spark, late):
    rows = {r.axis: r for r in catalogue.QUERIES["calibration_six_position"](spark, late).collect()}
    for k, bias, scale in zip("xyz", (0.1, -0.2, 0.05), (1.02, 0.97, 1.05)):
        assert rows[k].bias == pytest.approx(bias, abs=1e-9) and rows[k].scale == pytest.approx(scale, abs=1e-9)
