"""Sequential NumPy kernels: results that depend on decisions made for earlier rows, one small group at a time."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ..functions.robust import MAD


def mad(x: np.ndarray) -> float:
    x = np.asarray(x, float)
    return MAD * float(np.median(np.abs(x - np.median(x)))) if len(x) else 0.0


def theil_sen(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept: median of pairwise slopes, and the line through the medians."""
    i, j = np.triu_indices(len(x), 1)
    run = x[j] - x[i]
    rise = (y[j] - y[i]) * np.sign(run)
    good = run != 0
    slope = float(np.median(rise[good] / np.abs(run[good]))) if good.any() else float("nan")
    return slope, float(np.median(y) - slope * np.median(x))


@dataclass(frozen=True)
class StepConfig:
    """Parameters of the step and drift tracker; the defaults are those for tilt in degrees."""

    min_windows: int = 2
    arm_sessions: int = 4
    arm_hours: float = 6.0
    arm_tolerance: float | None = 0.25
    ref_sessions: int = 6
    floor: float = 0.10
    z_limit: float = 5.0
    sigma_min: float = 0.02
    persist: int = 2
    drift_hours: float = 48.0
    drift_sessions: int = 5
    drift_floor: float = 0.35
    drift_quantile: float = 0.995
    signed: bool = False


LOAD = StepConfig(arm_tolerance=None, floor=0.5, sigma_min=0.05, drift_hours=168.0, drift_floor=1.0, signed=True)


def session_noise(values: np.ndarray, n: np.ndarray, within: np.ndarray, cfg: StepConfig) -> float:
    """Noise of a session median from differences of neighbours and the scatter inside sessions."""
    use = n >= cfg.min_windows
    if use.sum() < 4:
        return cfg.sigma_min
    between = np.linalg.norm([mad(np.diff(c[use])) for c in values]) / np.sqrt(2)
    return float(max(cfg.sigma_min, between, np.median(within[use] / np.sqrt(n[use]))))


@dataclass
class StepTracker:
    """Steps and drift of a series of session medians with one or more channels.

    Sessions first settle until `arm_sessions` of them lie on a straight line. Each later one is compared with the median of the
    last accepted ones or, where they span long enough, with their Theil-Sen line at its time. Two
    hits in a row are an EVENT at the first; accepted sessions whose line is too steep are DRIFT.
    """

    hours: np.ndarray
    values: np.ndarray  # channels x sessions
    n: np.ndarray
    within: np.ndarray
    cfg: StepConfig = field(default_factory=StepConfig)
    sigma: float | None = None
    drift_limit: float | None = None
    rebaseline: bool = True

    def __post_init__(self) -> None:
        size = len(self.hours)
        self.state = np.full(size, "SETTLING", dtype=object)
        self.epoch = np.full(size, -1)
        self.shift, self.z, self.rate = (np.full(size, np.nan) for _ in range(3))
        self.quiet: list[float] = []
        self.used_sigma = self.cfg.sigma_min

    def _usable(self, start: int) -> np.ndarray:
        return start + np.flatnonzero(self.n[start:] >= self.cfg.min_windows)

    def _armed(self, start: int) -> np.ndarray | None:
        """The first sessions in a row that agree on a line."""
        cfg, use = self.cfg, self._usable(start)
        limit = cfg.arm_tolerance if cfg.arm_tolerance is not None else max(1.0, 3 * (self.sigma or cfg.sigma_min))
        for k in range(len(use) - cfg.arm_sessions + 1):
            own = use[k : k + cfg.arm_sessions]
            x = self.hours[own] - self.hours[own[0]]
            if x[-1] < cfg.arm_hours:
                continue
            off = [c[own] - np.polyval(np.polyfit(x, c[own], 1), x) for c in self.values]
            if np.linalg.norm(off, axis=0).max() <= limit:
                return own
        return None

    def _noise(self, start: int, armed: np.ndarray) -> float:
        if self.sigma is not None:
            return self.sigma
        if not self.cfg.signed:
            return session_noise(self.values[:, start:], self.n[start:], self.within[start:], self.cfg)
        inside = np.median(self.within[armed]) / np.sqrt(max(1, np.median(self.n[armed])))
        return float(max(self.cfg.sigma_min, mad(np.diff(self.values[0, armed])) / np.sqrt(2), inside))

    def _expected(self, accepted: np.ndarray, j: int) -> np.ndarray:
        cfg = self.cfg
        recent = accepted[self.hours[accepted] >= self.hours[j] - cfg.drift_hours]
        if len(recent) >= cfg.drift_sessions and self.hours[recent[-1]] - self.hours[recent[0]] >= cfg.arm_hours:
            return np.array([theil_sen(self.hours[recent] - self.hours[j], c[recent])[1] for c in self.values])
        return np.median(self.values[:, accepted[-cfg.ref_sessions :]], axis=1)

    def _steepness(self, accepted: np.ndarray, j: int) -> float:
        recent = accepted[self.hours[accepted] >= self.hours[j] - self.cfg.drift_hours]
        if len(recent) < self.cfg.drift_sessions:
            return float("nan")
        slopes = [theil_sen(self.hours[recent] - self.hours[j], c[recent])[0] * 24 for c in self.values]
        return float(slopes[0] if self.cfg.signed else np.linalg.norm(slopes))

    def _limit(self) -> float:
        if self.drift_limit is not None:
            return self.drift_limit
        if len(self.quiet) < 20:
            return self.cfg.drift_floor
        return max(self.cfg.drift_floor, float(np.quantile(np.abs(self.quiet), self.cfg.drift_quantile)))

    def _epoch(self, armed: np.ndarray, sigma: float, number: int) -> int | None:
        """Follow one epoch; the session of its event, if any."""
        cfg, accepted, hits = self.cfg, armed, []
        for j in self._usable(armed[-1] + 1):
            self.epoch[j] = number
            self.shift[j] = np.linalg.norm(self.values[:, j] - self._expected(accepted, j))
            noise = np.sqrt(sigma**2 + self.within[j] ** 2 / self.n[j])
            self.z[j] = self.shift[j] / noise
            if self.shift[j] > max(cfg.floor, cfg.z_limit * noise):
                self.state[j] = "HIT"
                hits.append(j)
                if len(hits) >= cfg.persist:
                    return hits[0]
                continue
            hits, accepted = [], np.append(accepted, j)
            rate = self.rate[j] = self._steepness(accepted, j)
            if np.isfinite(rate):
                self.quiet.append(rate)
            self.state[j] = "DRIFT" if np.isfinite(rate) and abs(rate) > self._limit() else "OK"
        return None

    def run(self) -> StepTracker:
        start, number = 0, 0
        while start < len(self.hours):
            armed = self._armed(start)
            if armed is None:
                self.state[start:] = "UNARMED"
                break
            self.state[start : armed[0]] = "SETTLING"
            self.state[armed], self.epoch[armed] = "BASE", number
            self.used_sigma = self._noise(start, armed)
            event = self._epoch(armed, self.used_sigma, number)
            if event is None:
                break
            if not self.rebaseline:
                late = np.arange(len(self.state)) >= event
                self.state[late & (self.state != "SETTLING")] = "ALARM"
                self.state[event] = "EVENT"
                break
            self.state[event] = "EVENT"
            self.epoch[event:] = -1
            start, number = event + 1, number + 1
        return self


@dataclass(frozen=True)
class LevelConfig:
    """Parameters of the frozen-reference level detector."""

    min_windows: int = 3
    ref_sessions: int = 4
    ref_hours: tuple[float, float] = (12.0, 72.0)
    agree: float = 0.10
    floor: float = 0.12
    persist: int = 2


def agreeing(use: np.ndarray, hours: np.ndarray, u: np.ndarray, v: np.ndarray, cfg: LevelConfig) -> np.ndarray | None:
    """The earliest start and then shortest run of sessions that spans long enough and stays near its median."""
    low, high = cfg.ref_hours
    for first in range(len(use)):
        span = hours[use[first:]] - hours[use[first]]
        for size in range(cfg.ref_sessions, int(np.searchsorted(span, high, "right")) + 1):
            if span[size - 1] < low:
                continue
            own = use[first : first + size]
            if np.hypot(u[own] - np.median(u[own]), v[own] - np.median(v[own])).max() <= cfg.agree:
                return own
    return None


def level_detector(hours: np.ndarray, u: np.ndarray, v: np.ndarray, n: np.ndarray, cfg: LevelConfig = LevelConfig(), rebaseline: bool = True, before: bool = False) -> dict[str, np.ndarray]:
    """Sessions against a frozen agreeing reference: columns state, epoch, shift, ref_u, ref_v."""
    size = len(hours)
    out = {"state": np.full(size, "SETTLING", dtype=object), "epoch": np.full(size, -1), **{k: np.full(size, np.nan) for k in ("shift", "ref_u", "ref_v")}}
    state, epoch, shift = out["state"], out["epoch"], out["shift"]
    start, number = 0, 0
    while start < size:
        use = start + np.flatnonzero(n[start:] >= cfg.min_windows)
        own = agreeing(use, hours, u, v, cfg)
        if own is None:
            state[start:], epoch[start:] = "UNARMED", -1
            break
        a, b, ru, rv = own[0], own[-1], np.median(u[own]), np.median(v[own])
        away = np.hypot(u - ru, v - rv)
        state[start:a], epoch[start:a] = "SETTLING", -1
        if before:
            early = use[use < a]
            far = np.r_[False, away[early] > cfg.floor, False]
            for i, j in zip(np.flatnonzero(~far[:-1] & far[1:]), np.flatnonzero(far[:-1] & ~far[1:]), strict=True):
                if j - i >= cfg.persist:
                    state[early[j - 1]], shift[early[j - 1]] = "PREARM_SHIFT", away[early[j - 1]]
        state[a : b + 1], epoch[a : b + 1] = "BASE", number
        out["ref_u"][a:], out["ref_v"][a:] = ru, rv
        run: list[int] = []
        event = None
        for j in range(b + 1, size):
            state[j], epoch[j] = "OK", number
            if n[j] < cfg.min_windows:
                continue
            shift[j] = away[j]
            run = [*run, j] if away[j] > cfg.floor else []
            if len(run) >= cfg.persist:
                event = run[0]
                break
        if event is None:
            if run:
                state[run[0] :] = "PENDING"
            break
        if not rebaseline:
            state[event:] = "ALARM"
            break
        state[event] = "EVENT"
        epoch[event:], shift[event + 1 :] = -1, np.nan
        out["ref_u"][event:] = out["ref_v"][event:] = np.nan
        start, number = event + 1, number + 1
    return out


# Real-time alarms: the state is a plain dictionary of numbers and lists, so any state store can hold it.


@dataclass(frozen=True)
class AlarmConfig:
    event_deg: float = 2.0
    step_deg: float = 0.5
    small_deg: float = 0.12
    fast: int = 6
    slow: int = 30
    base: int = 30
    hold: int = 10
    gap_s: float = 120.0
    handling_deg: float = 1.0


def _direction(vectors) -> np.ndarray:
    m = np.median(np.asarray(vectors, float), axis=-2)
    return m / np.linalg.norm(m, axis=-1, keepdims=True)


def _degrees(a, b):
    """Degrees between unit vectors, row by row."""
    return np.degrees(np.arccos(np.clip((np.asarray(a, float) * np.asarray(b, float)).sum(axis=-1), -1.0, 1.0)))


@dataclass(frozen=True)
class Level:
    """A level of alarm: the direction of the last `window` readings against a reference, beyond a limit `held` readings in a row."""

    name: str
    window: str | None  # field of AlarmConfig, or the reading itself
    against: str  # "ref", or "base": the first readings of the session
    limit: str
    held: str | int = 1

    def count(self, cfg: AlarmConfig) -> int:
        return getattr(cfg, self.held) if isinstance(self.held, str) else self.held


#: Levels in the order in which they are raised, at most one with a reading.
LEVELS = (
    Level("EVENT", None, "ref", "event_deg", 2), Level("STEP", "fast", "ref", "step_deg"), Level("SMALL_STEP", "slow", "ref", "small_deg", "hold"), Level("SESSION_STEP", "fast", "base", "step_deg"),
)


def new_alarm(ref=None) -> dict:
    """A node's state: reference direction, latches, and the session so far."""
    return {"ref": None if ref is None else (np.asarray(ref, float) / np.linalg.norm(ref)).tolist(), "latched": [], "last": None, "recent": [], "base": [], "runs": {}}


def rearm(state: dict, ref) -> dict:
    """After an alert was acknowledged: no latches, a new reference, a new session."""
    return new_alarm(ref)


def thresholds(quiet: float) -> AlarmConfig:
    """Limits from the largest shift of quiet sessions."""
    return AlarmConfig(small_deg=max(0.20, 3 * quiet), step_deg=max(0.50, 8 * quiet))


def _alert(t: float, level: str, lean: float, recent: np.ndarray, cfg: AlarmConfig) -> dict:
    handled = len(recent) >= 3 and _degrees(recent, _direction(recent)).max() > cfg.handling_deg
    return {"t": t, "level": level, "angle_deg": round(float(lean), 3), "handling_like": bool(handled)}


def read_alarm(state: dict, t: float, acc, cfg: AlarmConfig = AlarmConfig()) -> dict | None:
    """Take in one reading; the first level not raised before that it reaches, if any. Changes state."""
    size = float(np.linalg.norm(acc))
    if not np.isfinite(size) or size == 0:
        return None
    if state["last"] is None or t - state["last"] > cfg.gap_s:
        state.update(recent=[], base=[], runs={})
    state["last"] = t
    now = (np.asarray(acc, float) / size).tolist()
    state["recent"] = [*state["recent"], now][-max(cfg.fast, cfg.slow) :]
    state["base"] = [*state["base"], now][: cfg.base]
    alert = None
    for level in LEVELS:
        n = getattr(cfg, level.window) if level.window else 1
        against = state["ref"] if level.against == "ref" else (_direction(state["base"]) if len(state["base"]) >= cfg.base else None)
        if against is None or len(state["recent"]) < n:
            continue
        lean = float(_degrees(_direction(state["recent"][-n:]), against))
        run = state["runs"][level.name] = state["runs"].get(level.name, 0) + 1 if lean > getattr(cfg, level.limit) else 0
        if alert is None and run >= level.count(cfg) and level.name not in state["latched"]:
            state["latched"] = [*state["latched"], level.name]
            alert = _alert(t, level.name, lean, np.array(state["recent"]), cfg)
    return alert


def replay(t: np.ndarray, acc: np.ndarray, ref=None, cfg: AlarmConfig = AlarmConfig()) -> list[dict]:
    """All alerts of a history in time order, as reading by reading: rolling directions of whole sessions at once, then only
    the readings that reach a level are looked at, until every level has been raised."""
    t, acc = np.asarray(t, float), np.asarray(acc, float).reshape(-1, 3)
    size = np.linalg.norm(acc, axis=1)
    good = np.isfinite(size) & (size != 0)
    t, unit = t[good], acc[good] / size[good, None]
    n = len(t)
    if not n:
        return []
    head = np.flatnonzero(np.r_[True, np.diff(t) > cfg.gap_s])
    length = np.diff(np.r_[head, n])
    place = np.arange(n) - np.repeat(head, length)  # readings before this one in its session
    number = np.repeat(np.arange(len(head)), length)
    last = max(cfg.fast, cfg.slow)

    def rolling(width: int) -> np.ndarray:
        out = np.full((n, 3), np.nan)
        for at in range(width - 1, n, 200_000):
            stop = min(n, at + 200_000)
            view = np.lib.stride_tricks.sliding_window_view(unit[at - width + 1 : stop], width, axis=0)
            out[at:stop] = _direction(view.swapaxes(1, 2))
        out[place < width - 1] = np.nan
        return out

    base = np.full((len(head), 3), np.nan)
    for k in np.flatnonzero(length >= cfg.base):
        base[k] = _direction(unit[head[k] : head[k] + cfg.base])
    base = np.where((place >= cfg.base - 1)[:, None], base[number], np.nan)
    fixed = None if ref is None else np.broadcast_to(np.asarray(ref, float) / np.linalg.norm(ref), (n, 3))
    recent = {None: unit, **{w: rolling(getattr(cfg, w)) for w in ("fast", "slow")}}
    leans, reached = [], []
    for level in LEVELS:
        against = fixed if level.against == "ref" else base
        lean = np.full(n, np.nan) if against is None else _degrees(recent[level.window], against)
        over = lean > getattr(cfg, level.limit)
        broken = np.maximum.accumulate(np.where(over, head[number] - 1, np.arange(n)))
        leans.append(lean), reached.append(np.arange(n) - broken >= level.count(cfg))
    out, latched = [], set()
    for i in np.flatnonzero(np.any(reached, axis=0)).tolist():
        k = next((k for k in range(len(LEVELS)) if reached[k][i] and k not in latched), None)
        if k is None:
            continue
        latched.add(k)
        out.append(_alert(float(t[i]), LEVELS[k].name, leans[k][i], unit[max(head[number[i]], i - last + 1) : i + 1], cfg))
        if len(latched) == len(LEVELS):
            break
    return out
