import numpy as np
import pytest

from tremorline.operators import kernels as N
from tremorline.operators import trackers
from tremorline.plans import monitor as M


@pytest.fixture(scope="module")
def export(spark):
    """Ten days of one tilt sensor that steps by a degree after five, is remounted after eight, and a load node."""
    rng = np.random.default_rng(3)
    rows, base = [], 1_789_000_000
    for s in range(60):  # a session every four hours, 25 minutes long
        for k in range(150):
            t = base + s * 14_400 + k * 10
            lean = np.radians(1.0 if s >= 30 else 0.0)
            v = np.array([np.sin(lean), 0.02, np.cos(lean)]) * 9.81 + rng.normal(0, 0.01, 3)
            if s >= 50:
                v = v[[2, 0, 1]]
            stamp = np.datetime64(t, "s").astype(str)
            rows.append(("RFM", "a", stamp + "Z", "RFM_0001,10/09/2026 10:00:00," + ",".join(f"{x:.4f}" for x in v) + ",1,2,3,4,5,6"))
            kg = 20.0 + (5.0 if s >= 35 else 0.0) + rng.normal(0, 0.01)
            rows.append(("RFL", "a", stamp + "Z", f"RFL_01,10/09/2026 10:00:00,{v[0]:.4f},{v[1]:.4f},{v[2]:.4f},1,2,3,4,5,6,500:{int(kg * 100)},{kg:.2f}kg,12"))
    return spark.createDataFrame(rows, "device string, site string, time string, value string").repartition(4)


@pytest.fixture(scope="module")
def out(export):
    cfg = M.TiltConfig(least_windows=20)
    return {k: v.cache() for k, v in M.run(export, cfg, M.TiltConfig(least_windows=20, norm_tolerance=0.04)).items()}


def test_tilt_finds_the_step_and_the_remount(out):
    s = {r.segment: r for r in out["tilt_segments"].collect()}
    assert set(s) == {0, 1} and s[0].name == "RFM_0001_s1"
    (event,) = [r for r in out["tilt_events"].collect() if r.kind == "EVENT"]
    assert event.segment == 0 and abs(event["shift"] - 1.0) < 0.05
    rows = out["tilt_sessions"].where("segment = 0").orderBy("start_us").collect()
    at = [r.state for r in rows].index("EVENT")
    assert abs(rows[at].start_us / 1e6 - (1_789_000_000 + 30 * 14_400)) < 3600


def test_load_and_fusion(out):
    (event,) = [r for r in out["load_events"].collect() if r.kind == "EVENT"]
    assert event.cell == "LC_A" and abs(event["shift"] - 5.0) < 0.1
    assert {(r.sensor_id, r.has_tilt) for r in out["nodes"].collect()} == {("RFL_01", True)}
    kinds = {r.fused_status for r in out["fused"].collect()}
    assert "LOAD_ONLY" in kinds and "UNEXPLAINED_TILT" in kinds


def test_dashboard(out):
    import json

    docs = {r.segment: json.loads(r.document) for r in out["dashboard"].collect()}
    assert set(docs) == {"RFM_0001_s1", "RFM_0001_s2"}
    first = docs["RFM_0001_s1"]
    assert first["sessions"] == len(first["session_rows"]) and first["events"] + first["drift_sessions"] == len(first["event_rows"])
    assert len(docs["RFM_0001_s2"]["event_rows"]) == docs["RFM_0001_s2"]["events"] + docs["RFM_0001_s2"]["drift_sessions"]


def test_references_for_alarms(spark, out):
    levels = trackers.detect_levels(out["tilt_sessions"].drop("state", "epoch", "shift", "z", "drift_day"), M.SEGMENT, N.LevelConfig())
    refs = {r.sensor_id: r for r in M.alarm_references(M.epochs(levels)).collect()}
    r = refs["RFM_0001"]
    assert r.segment in (0, 1) and r.small_deg >= 0.2 and r.step_deg >= 0.5
    if r.rx is not None:
        assert abs(r.rx**2 + r.ry**2 + r.rz**2 - 1) < 1e-9


def test_injected_rotations_and_control(spark):
    rng = np.random.default_rng(9)
    rows = []
    for s in range(40):
        for k in range(100):
            v = np.array([0.01, 0.02, 1.0]) * 9.81 + rng.normal(0, 0.01, 3)
            rows.append(("RFM_0001", (1_789_000_000 + s * 14_400 + k * 10) * 1_000_000, *v.tolist()))
    df = spark.createDataFrame(rows, "sensor_id string, us long, x double, y double, z double")
    out = {r.theta: r for r in M.raw_cases(df, [0.5, 1.5], 0.6, M.TiltConfig(least_windows=20)).collect()}
    assert not out[0.0].detected and out[0.5].detected and out[1.5].detected
    assert 0 < out[1.5].delay_h < 12


def test_feature_windows(spark):
    from pyspark.sql import functions as F

    df = spark.range(500).select(F.lit("n").alias("node"), (F.col("id") * 1_000_000).alias("us"), F.sin(F.col("id") / 5).alias("v"))
    df = df.withColumn("v", F.when(F.col("us") == 250_000_000, 50.0).otherwise(F.col("v")))
    rows = M.features(df, ["node"], ["us"], "v", 100, 50, 1.0).collect()
    assert len(rows) == 9 and max(r.peak for r in rows) < 1.1 and sum(r.outliers for r in rows) >= 2
