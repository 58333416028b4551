"""The preparation of a node's axes, filters, fault views, node models and the cointegration test against slow versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tremorline.operators import models, preparation as P, signal
from tremorline.operators import series as S


def one_at_a_time(b, a, x):
    """The direct form of a section, from its steady state at the first value."""
    gain = b.sum() / a.sum()
    xs, ys, out = [x[0]] * 2, [gain * x[0]] * 2, []
    for v in x:
        y = b[0] * v + b[1] * xs[0] + b[2] * xs[1] - a[1] * ys[0] - a[2] * ys[1]
        xs, ys = [v, xs[0]], [y, ys[0]]
        out.append(y)
    return np.array(out)


@pytest.mark.parametrize("n", [1, 5, 127, 128, 129, 700])
def test_blocks_equal_one_sample_at_a_time(n):
    x = np.random.default_rng(n).normal(size=n) + 4
    for b, a in signal.butter_lowpass(4, 0.4, 10.0):
        assert np.allclose(signal._section(b, a, x), one_at_a_time(b, a, x), atol=1e-9)


def rows(seed=0, n=300):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"node": "a", "us": np.arange(n) * 250_000, "x": rng.normal(size=n), "y": rng.normal(size=n) + 2, "z": rng.normal(size=n) + 9.8, "heat": np.sin(np.arange(n) / 20)})
    pdf.loc[[40, 200], "x"] = 50.0
    pdf.loc[7, "y"] = np.nan
    return pdf


def slow_hampel(x, width=7, sigmas=3):
    s = pd.Series(x)
    mid = s.rolling(width, center=True).median()
    off = (s - mid).abs()
    bad = off > sigmas * 1.4826 * off.rolling(width, center=True).median()
    return np.where(bad, mid, s), bad.to_numpy()


def test_whole_preparation_against_pandas(spark):
    pdf = rows()
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "node string, us long, x double, y double, z double, heat double")
    turn = ((1.0, 0.0, 0.0), (0.0, 0.8, -0.6), (0.0, 0.6, 0.8))
    how = P.Preparation(rate=4.0, accel=("x", "y", "z"), bias=(0.1, 0.2, 0.3), scale=(1.0, 2.0, 1.0), rotation=turn, ranges={"rot_x_cal": (-2.0, 2.0)}, step_s=0.25, spectrum=32)
    out = P.prepare(df, ["node"], ["us"], "RFM", how, F.col("us") < 30_000_000, "heat")
    got = out["rows"].orderBy("us").toPandas()
    cal = (pdf[["x", "y", "z"]].to_numpy() - [0.1, 0.2, 0.3]) * [1, 2, 1]
    rot = cal @ np.array(turn).T
    for k, c in enumerate(("rot_x_cal", "rot_y_cal", "rot_z_cal")):
        assert np.allclose(got[c], rot[:, k], equal_nan=True)
        low = signal.lowpass(pd.Series(rot[:, k]).ffill().bfill().to_numpy(), 4.0, 0.3)
        assert np.allclose(got[f"{c}_static"], low) and np.allclose(got[f"{c}_dynamic"], rot[:, k] - low, equal_nan=True)
        if c == "rot_x_cal":
            clean, bad = slow_hampel(rot[:, k])
            assert (got[f"{c}_glitch"] == bad).all() and bad[[40, 200]].all()
            assert np.allclose(got[f"{c}_filt"], signal.lowpass(pd.Series(clean).ffill().bfill().to_numpy(), 4.0, 0.99 * 2.0))
    early = (pdf["us"] < 30_000_000).to_numpy()
    early &= ~np.isnan(rot[:, 0])
    fit = np.linalg.lstsq(np.column_stack([np.ones(early.sum()), pdf["heat"][early]]), rot[early, 0], rcond=None)[0]
    assert np.allclose(got["rot_x_cal_confound_resid"], rot[:, 0] - fit[0] - fit[1] * pdf["heat"], equal_nan=True)
    faults = out["faults"].orderBy("us").toPandas()
    assert (faults["rot_x_cal_saturated"] == ((rot[:, 0] <= -1.96) | (rot[:, 0] >= 1.96))).all() and not faults["packet_loss"].any()
    base = {r.channel: r for r in out["baseline"].collect()}
    assert base["rot_x_cal"].mean == pytest.approx(rot[early, 0].mean()) and base["rot_x_cal"].std == pytest.approx(rot[early, 0].std(ddof=1))
    f, p = signal.welch(rot[early, 0], 4.0, 32)
    assert np.allclose(base["rot_x_cal"].pxx, p) and base["rot_x_cal"].dominant_freq == f[np.argmax(p)]
    features = {(r.axis, r.window_no): r for r in out["features"].collect()}
    assert {k[1] for k in features if k[0] == "rot_z_cal"} == set(range((300 - 40) // 20 + 1))
    w = rot[60:100, 2]
    one = features["rot_z_cal", 3]
    assert one.rms == pytest.approx(np.sqrt((w**2).mean())) and one.window_start == 60 * 250_000
    assert (one.dominant_freq, one.dominant_amp) == pytest.approx(signal.dominant(w, 4.0, 32))


def test_parts_without_inputs_are_missing(spark):
    df = spark.createDataFrame(rows()[["node", "us", "x", "y", "z"]].dropna(), "node string, us long, x double, y double, z double")
    assert set(P.prepare(df, ["node"], ["us"], "RFL", P.Preparation(rate=4.0))) == {"rows"}
    out = P.prepare(df, ["node"], ["us"], "RFL", P.Preparation(rate=1.0, accel=("x",)))
    assert set(out) == {"rows", "features"} and "dominant_freq" not in out["features"].columns and out["features"].count() == (299 - 60) // 30 + 1


def test_strongest_line_of_a_window(spark):
    t = np.arange(512) / 64
    df = spark.createDataFrame([(1, np.sin(2 * np.pi * 8 * t).tolist()), (2, [1.0] * 10), (3, None)], "id long, w array<double>")
    got = {r.id: r for r in signal.strongest(df, "w", 64.0).collect()}
    assert got[1].dominant_freq == 8.0 and got[2].dominant_freq is None and got[3].dominant_amp is None


def test_fault_flags_with_nulls_and_still_columns(spark):
    pdf = pd.DataFrame({"node": "a", "us": [i * 1_000_000 + (i > 30) * 9_000_000 for i in range(60)], "x": [1.0] * 60, "y": np.arange(60.0)})
    df = spark.createDataFrame(pdf, "node string, us long, x double, y double").withColumn("rtc_error", F.when(F.col("us") == 0, F.lit(True)))
    got = S.sample_flags(df, ["node"], ["us"], ["x", "y"], {"y": (0.0, 1000.0)}, 1.0).orderBy("us").collect()
    assert [r.x_flatline for r in got] == [i >= 19 for i in range(60)] and not any(r.y_flatline for r in got)
    assert [r.packet_loss for r in got] == [i == 31 for i in range(60)] and [r.rtc_error for r in got] == [i == 0 for i in range(60)]
    assert [r.y_saturated for r in got] == [i <= 10 for i in range(60)] and not any(r.isolated_sensor_deviation for r in got)
    assert [r.any_fault for r in got] == [i >= 19 or i <= 10 for i in range(60)]


def test_cointegration():
    rng = np.random.default_rng(4)
    walk = np.cumsum(rng.normal(size=400))
    stat, p, critical = models.cointegration(2 * walk + 1 + rng.normal(size=400), walk)
    assert p < 0.01 and stat < critical[0] < critical[1] < critical[2] < 0
    ps = [models.cointegration(np.cumsum(rng.normal(size=300)), np.cumsum(rng.normal(size=300)))[1] for _ in range(60)]
    assert np.mean(np.array(ps) < 0.05) < 0.2  # walks that are not tied together
    assert np.isnan(models.cointegration(np.arange(5.0), np.arange(5.0))[0])
    # without lagged differences the statistic is that of one plain regression
    y, x = rng.normal(size=30), rng.normal(size=30)
    line = np.polyfit(x, y, 1)
    e = y - np.polyval(line, x)
    d, before = np.diff(e), e[:-1]
    slope = (before @ d) / (before @ before)
    error = np.sqrt(((d - slope * before) ** 2).sum() / (len(d) - 1) / (before @ before))
    got = models.cointegration(y, x)[0]
    assert got == pytest.approx(slope / error, rel=1e-6) or abs(got) < abs(slope / error) * 2


def test_node_model_tiers():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4))
    far = rng.normal(size=(20, 4)) + 12
    for tier, n in (("full", 2), ("light", 1)):
        m = models.NodeModel(x[:200], x[200:260], tier)
        quiet, loud = m.scores(x[260:]), m.scores(far)
        assert len(quiet) == n and all((q > limit).mean() < 0.2 and (s > limit).all() for q, s, limit in zip(quiet, loud, m.limits))


def test_votes(spark):
    df = spark.createDataFrame([(v, s) for v in range(4) for s in (False, True)], "v int, s boolean")
    got = {(r.v, r.s): (r.three, r.two) for r in df.select("v", "s", models.votes_status(F.col("s"), F.col("v"), 3).alias("three"), models.votes_status(F.col("s"), F.col("v"), 2).alias("two")).collect()}
    assert [got[v, False] for v in range(4)] == [("OK", "OK"), ("WATCH", "WATCH"), ("WARNING", "ALARM"), ("ALARM", "ALARM")]
    assert all(got[v, True] == ("SENSOR", "SENSOR") for v in range(4))
