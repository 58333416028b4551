import numpy as np
import pytest

from tremorline.operators import kernels as N
from tremorline.operators import models, signal, thermal


def series(values, step_h=4.0, n=6, within=0.01):
    size = len(values)
    return N.StepTracker(np.arange(size) * step_h, np.array([values, np.zeros(size)], float), np.full(size, float(n)), np.full(size, within))


def test_quiet_series_never_alarms():
    rng = np.random.default_rng(0)
    t = series(rng.normal(0, 0.01, 60)).run()
    assert set(t.state[4:]) == {"OK"} and list(t.state[:4]) == ["BASE"] * 4


@pytest.mark.parametrize("step", [0.2, 0.5, 2.0])
def test_step_is_an_event_at_its_first_session_and_rebaselines(step):
    rng = np.random.default_rng(1)
    t = series(rng.normal(0, 0.005, 40) + step * (np.arange(40) >= 25)).run()
    assert t.state[25] == "EVENT" and "EVENT" not in t.state[26:] and t.epoch[30] == 1
    late = series(rng.normal(0, 0.005, 40) + step * (np.arange(40) >= 25))
    late.rebaseline = False
    late.run()
    assert late.state[25] == "EVENT" and late.state[26] == "ALARM" and set(late.state[27:]) == {"SETTLING"}  # later ones were never reached


def test_drift_single_hit_and_unarmed():
    rng = np.random.default_rng(2)
    assert "DRIFT" in series(np.arange(40) * 0.032 + rng.normal(0, 0.001, 40), step_h=2.0).run().state
    one = rng.normal(0, 0.005, 40)
    one[20] += 1
    t = series(one).run()
    assert t.state[20] == "HIT" and "EVENT" not in t.state
    assert set(series(rng.normal(0, 5, 20)).run().state) == {"UNARMED"}
    assert len(N.StepTracker(*[np.zeros(0)] * 1, np.zeros((2, 0)), np.zeros(0), np.zeros(0)).run().state) == 0


def test_level_detector_states():
    h = np.arange(30) * 6.0
    u = np.where(np.arange(30) >= 20, 0.5, 0.0)
    out = N.level_detector(h, u, np.zeros(30), np.full(30, 5))
    assert list(out["state"][:4]) == ["BASE"] * 4 and out["state"][20] == "EVENT" and out["epoch"][25] == 1
    out = N.level_detector(h, u, np.zeros(30), np.full(30, 5), rebaseline=False)
    assert set(out["state"][20:]) == {"ALARM"}
    u = np.where(np.arange(30) == 29, 0.5, 0.0)
    assert N.level_detector(h, u, np.zeros(30), np.full(30, 5))["state"][29] == "PENDING"
    u = np.where(np.arange(30) < 3, 0.9, 0.0)
    assert N.level_detector(h, u, np.zeros(30), np.full(30, 5), before=True)["state"][2] == "PREARM_SHIFT"


def lean(deg, n=1):
    return np.tile([np.sin(np.radians(deg)), 0, np.cos(np.radians(deg))], (n, 1)) * 9.81


def test_alarm_levels():
    clean = np.vstack([lean(0, 80)])
    t = np.arange(80) * 3.0
    assert N.replay(t, clean, (0, 0, 1)) == []
    jump = np.vstack([lean(0, 40), lean(2.5, 2), lean(0, 38)])
    assert [a["level"] for a in N.replay(t, jump, (0, 0, 1))][0] == "EVENT"
    moved = np.vstack([lean(0, 40), lean(0.6, 40)])
    assert [a["level"] for a in N.replay(t, moved)] == ["SESSION_STEP"]
    assert [a["level"] for a in N.replay(t, moved, (0, 0, 1))][:1] == ["STEP"]
    far = np.r_[t[:40], t[40:] + 121]
    assert N.replay(far, moved) == []  # a new session has a new base
    state = N.new_alarm((0, 0, 1))
    assert N.read_alarm(state, 0.0, (0, 0, 0)) is None and state["last"] is None
    small = N.replay(np.arange(100) * 3.0, np.vstack([lean(0.3, 100)]), (0, 0, 1))
    assert [a["level"] for a in small] == ["SMALL_STEP"]
    assert N.thresholds(0.1).step_deg == 0.8 and N.thresholds(0.0).small_deg == 0.2


def test_thermal_fit_and_attribution():
    hours = np.arange(0, 720.0)
    temp = 25 + 8 * np.sin(hours * 2 * np.pi / 24)
    inner = thermal.lagged(hours, temp, 4.0)
    at = np.arange(6, 700, 6.5)
    ts = thermal.aligned(at, hours, inner, 3.0)
    rng = np.random.default_rng(1)
    y = 0.05 * (ts - 25) + rng.normal(0, 0.003, len(at))
    f = thermal.fit(at, ts, thermal.aligned(at, hours, temp, 3.0) - ts, y, thermal.ThermalConfig(), gradient=False, k_max=0.15)
    assert f.trusted and abs(f.k_t - 0.05) < 0.002
    flat = thermal.fit(at, np.full(len(at), 20.0), np.zeros(len(at)), y, thermal.ThermalConfig(), gradient=False)
    assert not flat.trusted and "range" in flat.reason

    def track(ch):
        t = N.StepTracker(at, np.array([ch["u"]]), np.full(len(at), 5.0), np.full(len(at), 0.002)).run()
        return t.state, t.epoch, t.shift

    step = thermal.attribute(thermal.Sessions(at, {"u": y + (at > 400)}, [np.array([h]) for h in at]), track, hours, temp, k_max=0.15)
    real = [r for r in step["rows"] if r["raw_state"] == "EVENT" or r["temp_free_state"] == "EVENT"]
    assert any(r["verdict"] in ("NOT_TEMP", "MASKED_BY_TEMP") for r in real)
    warm = 25 + np.sin(hours * 2 * np.pi / 24) + 8 * (hours >= 400)
    moved = 0.1 * (thermal.aligned(at, hours, thermal.lagged(hours, warm, 4.0), 3.0) - 25) + rng.normal(0, 0.003, len(at))
    only = thermal.attribute(thermal.Sessions(at, {"u": moved}, [np.array([h]) for h in at]), track, hours, warm, k_max=0.15)
    hot = [r for r in only["rows"] if 395 < r["hours"] < 420 and r["raw_state"] == "EVENT"]
    assert hot and all(r["verdict"] == "TEMP_EXPLAINED" for r in hot) and only["fits"]["u"].trusted


def test_models():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0], [0, 0, 2.0]])
    x[:20] += 30
    mean, cov = models.robust_covariance(x, rng)
    d = models.distances(x, mean, cov)
    assert d[:20].min() > d[20:].max()
    f = models.Forest(x[20:], rng).score(x)
    assert f[:20].mean() > f[20:].mean() + 0.1
    t = models.Texture(x[20:320], np.arange(300) // 30)
    quiet = t.score(x[320:])[2].mean()
    assert quiet < 0.1 and t.score(x[:20])[2].all()
    assert np.allclose(np.linalg.eigvalsh(models.shrunk_covariance(x[:4])) > 0, True)
    error, limit = models.autoencoder_errors(x[20:], np.arange(380) < 300, 2)
    assert (error[300:] > limit).mean() < 0.1
    raw = rng.normal(size=(60, 3))
    raw = 9.81 * raw / np.linalg.norm(raw, axis=1)[:, None]
    bias, scale = models.six_position(raw / [1.1, 0.9, 1.0] + [0.2, -0.1, 0.3])
    assert np.allclose(bias, [0.2, -0.1, 0.3], atol=1e-6) and np.allclose(scale, [1.1, 0.9, 1.0], atol=1e-6)
    for g in ([0, 0, -1.0], [0.3, -0.4, 0.5], [0, 0, 1.0]):
        r = models.rotation_from_gravity(np.array(g))
        assert np.allclose(r @ np.array(g) / np.linalg.norm(g), [0, 0, 1]) and np.isclose(np.linalg.det(r), 1)
    slope, low, high = models.sen_interval(np.arange(40.0), np.arange(40.0) * 2 + rng.normal(size=40))
    assert low < 2 < high and abs(slope - 2) < 0.1


def test_signal():
    t = np.arange(2000) / 50
    slow, fast = np.sin(2 * np.pi * 0.05 * t), 0.5 * np.sin(2 * np.pi * 5 * t)
    low, rest = signal.static_dynamic(slow + fast, 50.0)
    assert np.abs(low - slow)[200:-200].max() < 0.03 and np.abs(rest - fast)[200:-200].max() < 0.05
    f, p = signal.welch(fast, 50.0)
    assert abs(f[np.argmax(p)] - 5) < 0.2 and abs(np.trapezoid(p, f) - fast.var()) < 0.01
    assert np.isnan(signal.dominant(fast[:100], 50.0)[0])
    x = np.random.default_rng(0).normal(size=300)
    assert signal.best_lag(x, x[7:]) == 7 and signal.best_lag(x[5:], x) == -5
    constant = signal.lowpass(np.full(50, 3.0), 50.0, 1.0)
    assert np.allclose(constant, 3.0)
