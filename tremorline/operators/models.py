"""Robust covariance, isolation forest and a linear autoencoder: fits per group in NumPy, scores with voting."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .kernels import mad


def shrunk_covariance(x: np.ndarray) -> np.ndarray:
    """Ledoit-Wolf shrinkage of the sample covariance towards a multiple of the identity."""
    n, p = x.shape
    z = x - x.mean(axis=0)
    s = z.T @ z / n
    mu = np.trace(s) / p
    delta = ((s - mu * np.eye(p)) ** 2).sum()
    beta = min(((z**2).T @ (z**2) / n - s**2).sum() / n, delta)
    share = beta / delta if delta > 0 else 0.0
    return share * mu * np.eye(p) + (1 - share) * s


def robust_covariance(x: np.ndarray, rng: np.random.Generator, starts: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Minimum covariance determinant by concentration steps, rescaled to the median distance."""
    n, p = x.shape
    h = (n + p + 1) // 2
    best = (np.inf, None)
    for _ in range(starts):
        own = rng.choice(n, min(n, p + 1), replace=False)
        for _ in range(20):
            centre, cov = x[own].mean(axis=0), np.cov(x[own].T).reshape(p, p) + 1e-9 * np.eye(p)
            d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
            new = np.argsort(d, kind="stable")[:h]
            if set(new) == set(own):
                break
            own = new
        value = np.linalg.slogdet(np.cov(x[own].T).reshape(p, p) + 1e-9 * np.eye(p))[1]
        if value < best[0]:
            best = (value, own)
    own = best[1]
    centre, cov = x[own].mean(axis=0), np.cov(x[own].T).reshape(p, p) + 1e-9 * np.eye(p)
    d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
    return centre, cov * max(np.median(d) / max(p * (1 - 2 / (9 * p)) ** 3, 1e-9), 1e-9)


def distances(x: np.ndarray, centre: np.ndarray, cov: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", x - centre, np.linalg.pinv(cov), x - centre), 0))


class Forest:
    """An isolation forest: short paths isolate outliers. Scores rise with strangeness."""

    def __init__(self, x: np.ndarray, rng: np.random.Generator, trees: int = 100, sample: int = 256):
        self.size = min(sample, len(x))
        depth = int(np.ceil(np.log2(max(self.size, 2))))
        self.trees = [self._grow(x[rng.choice(len(x), self.size, replace=False)], depth, rng) for _ in range(trees)]

    @staticmethod
    def _mean_path(n) -> np.ndarray:
        n = np.asarray(n, float)
        return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))

    def _grow(self, x: np.ndarray, depth: int, rng: np.random.Generator):
        low, high = x.min(axis=0), x.max(axis=0)
        wide = np.flatnonzero(high > low)
        if depth == 0 or len(x) <= 1 or not len(wide):
            return float(self._mean_path(len(x)))
        f = int(rng.choice(wide))
        cut = float(rng.uniform(low[f], high[f]))
        left = x[:, f] < cut
        return f, cut, self._grow(x[left], depth - 1, rng), self._grow(x[~left], depth - 1, rng)

    def _walk(self, node, x: np.ndarray, own: np.ndarray, depth: int, out: np.ndarray) -> None:
        if isinstance(node, float):
            out[own] += depth + node
            return
        f, cut, left, right = node
        side = x[own, f] < cut
        self._walk(left, x, own[side], depth + 1, out)
        self._walk(right, x, own[~side], depth + 1, out)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for tree in self.trees:
            self._walk(tree, x, np.arange(len(x)), 0, total)
        return 2.0 ** (-total / len(self.trees) / max(float(self._mean_path(self.size)), 1e-9))


class Texture:
    """Robustly scaled features scored by distance and forest, with out-of-fold limits over groups."""

    def __init__(self, x: np.ndarray, groups: np.ndarray, quantile: float = 0.995, folds: int = 5, seed: int = 0):
        self.seed = seed
        names = np.unique(groups)
        folds = min(folds, len(names))
        held: list[np.ndarray] = []
        if folds >= 2:
            fold = np.searchsorted(names, groups) % folds
            held = [np.column_stack(self._fit(x[fold != k])(x[fold == k])) for k in range(folds) if (fold != k).sum() > x.shape[1] + 1]
        self.model = self._fit(x)
        scores = np.vstack(held) if held else np.column_stack(self.model(x))
        self.limits = np.quantile(scores, quantile, axis=0)

    def _fit(self, x: np.ndarray) -> Callable:
        rng = np.random.default_rng(self.seed)
        centre = np.median(x, axis=0)
        scale = np.maximum([mad(c) for c in x.T], 1e-4)
        z = (x - centre) / scale
        try:
            mean, cov = robust_covariance(z, rng) if len(z) >= 5 * z.shape[1] else (z.mean(axis=0), shrunk_covariance(z))
        except np.linalg.LinAlgError:
            mean, cov = z.mean(axis=0), shrunk_covariance(z)
        forest = Forest(z, rng)
        return lambda y: (distances((y - centre) / scale, mean, cov), forest.score((y - centre) / scale))

    def score(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d, f = self.model(x)
        over = (d > self.limits[0]) | (f > self.limits[1])
        return d, f, over & np.r_[over[:1], over[:-1]]  # two windows in a row


def texture(windows: DataFrame, key: list[str], features: list[str], train: float = 0.7) -> DataFrame:
    """Windows with distance, forest score and flag of a texture model fitted to the first part of each series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["session", "win"], kind="stable").reset_index(drop=True)
        x = pdf[features].to_numpy(float)
        n = max(int(len(pdf) * train), 1)
        if n < 4 * len(features):
            return pdf.assign(distance=np.nan, forest=np.nan, flag=False)
        d, f, flag = Texture(x[:n], pdf["session"].to_numpy()[:n]).score(x)
        return pdf.assign(distance=d, forest=f, flag=flag)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in windows.schema] + ["distance double, forest double, flag boolean"])
    return windows.groupBy(*key).applyInPandas(run, schema)


class NodeModel:
    """A node's model over scaled window features: distance, in the full tier also a forest, with limits from windows held out of the fit.

    The full tier uses the robust covariance, the light one, for nodes with little data, shrinkage.
    """

    def __init__(self, train: np.ndarray, held: np.ndarray, tier: str = "full", quantile: float = 0.995, seed: int = 0):
        rng = np.random.default_rng(seed)
        low, self.centre, high = np.quantile(train, [0.25, 0.5, 0.75], axis=0)
        self.scale = np.where(high > low, high - low, 1.0)
        z = (train - self.centre) / self.scale
        try:
            if tier != "full":
                raise np.linalg.LinAlgError
            self.mean, self.cov = robust_covariance(z, rng)
        except np.linalg.LinAlgError:
            self.mean, self.cov = z.mean(axis=0), shrunk_covariance(z)
        self.forest = Forest(z, rng) if tier == "full" else None
        self.limits = [float(np.quantile(s, quantile)) for s in self.scores(held if len(held) else train)]

    def scores(self, x: np.ndarray) -> list[np.ndarray]:
        z = (x - self.centre) / self.scale
        return [distances(z, self.mean, self.cov), *([self.forest.score(z)] if self.forest else [])]


def votes_status(sensor: Column, level: Column, detectors: int) -> Column:
    """The status of a number of agreeing detectors, held for some windows; sensor faults come first."""
    alarm = min(3, detectors)
    warn = 2 if alarm > 2 else 99
    return F.when(sensor, "SENSOR").when(level >= alarm, "ALARM").when(level >= warn, "WARNING").when(level >= 1, "WATCH").otherwise("OK")


def scored_windows(windows: DataFrame, key: list[str], order: str, features: list[str], tier: str = "full", train: float = 0.6, held: float = 0.2) -> DataFrame:
    """Windows with the scores and flags of their series' NodeModel: maha, flag_maha and, in the full tier, iso, flag_iso.

    The first `train` of each series fits it, the next `held` sets its limits. Too short a series has null scores and no flags.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        x = pdf[features].to_numpy(float)
        a, b = int(len(x) * train), int(len(x) * (train + held))
        names = ["maha", "iso"][: 2 if tier == "full" else 1]
        if a < 4 * len(features):
            return pdf.assign(**{n: np.nan for n in names}, **{f"flag_{n}": False for n in names})
        model = NodeModel(x[:a], x[a:b], tier)
        found = list(zip(names, model.scores(x), model.limits, strict=True))
        return pdf.assign(**{n: s for n, s, _ in found}, **{f"flag_{n}": s > limit for n, s, limit in found})

    extra = ["maha double"] + (["iso double"] if tier == "full" else []) + ["flag_maha boolean"] + (["flag_iso boolean"] if tier == "full" else [])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in windows.schema] + extra)
    return windows.groupBy(*key).applyInPandas(run, schema)


def region_rates(scored: DataFrame, key: list[str], fault: str, flags: list[str], status: str, after: str, order: str) -> DataFrame:
    """Per series and case: how often each flag, any flag and the fused status fire in the region `after`, and the hours to the first fused one.

    scored holds a copy of the windows for each case; the case without a fault gives the false alarms, over its own `after`.
    """
    fused = F.col(status).isin("WARNING", "ALARM", "SENSOR")
    some = F.lit(False)
    for c in flags:
        some = some | F.coalesce(F.col(c), F.lit(False))
    rows = scored.where(after)
    out = rows.groupBy(*key, fault).agg(
        *[F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double")).alias(c) for c in flags], F.avg(fused.cast("double")).alias("fused"), F.avg(some.cast("double")).alias("any_flag"),
        ((F.min(F.when(fused, F.col(order))) - F.min(order)) / 3.6e9).alias("delay_h"),
    )
    return out


def autoencoder_errors(x: np.ndarray, healthy: np.ndarray, parts: int = 3) -> tuple[np.ndarray, float]:
    """Reconstruction errors of a linear autoencoder (principal components) and the limit mean + 4 sigma over healthy rows.

    A stand-in for the recurrent network, which needs a library this engine does not require.
    """
    centre, scale = x[healthy].mean(axis=0), np.maximum(x[healthy].std(axis=0), 1e-9)
    z = (x - centre) / scale
    basis = np.linalg.svd(z[healthy], full_matrices=False)[2][:parts]
    error = ((z - z @ basis.T @ basis) ** 2).mean(axis=1)
    return error, float(error[healthy].mean() + 4 * error[healthy].std())


def six_position(raw: np.ndarray, g: float = 9.81, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Bias and scale per axis such that |(raw - bias) * scale| = g, by Gauss-Newton."""
    bias, scale = (raw.max(axis=0) + raw.min(axis=0)) / 2, np.ones(3)
    for _ in range(rounds):
        v = (raw - bias) * scale
        size = np.linalg.norm(v, axis=1)
        jac = np.hstack([-v * scale / size[:, None], v * (raw - bias) / size[:, None]])
        step = np.linalg.lstsq(jac, g - size, rcond=None)[0]
        bias, scale = bias + step[:3], scale + step[3:]
        if np.abs(step).max() < 1e-12:
            break
    return bias, scale


def six_position_rows(df: DataFrame, columns: list[str], g: float = 9.81, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """six_position over a table of any length: each round is one pass that sums the normal equations."""
    low_high = df.agg(*[f(c) for c in columns for f in (F.min, F.max)]).first()
    bias, scale = np.array([(low_high[2 * k] + low_high[2 * k + 1]) / 2 for k in range(3)]), np.ones(3)
    for _ in range(rounds):
        parts = df.select(*columns).mapInArrow(_normal_sums(bias, scale, g), "sums array<double>").collect()
        sums = np.sum([r.sums for r in parts], axis=0).reshape(6, 7)
        step = np.linalg.lstsq(sums[:, :6], sums[:, 6], rcond=None)[0]
        bias, scale = bias + step[:3], scale + step[3:]
        if np.abs(step).max() < 1e-12:
            break
    return bias, scale


def _normal_sums(bias: np.ndarray, scale: np.ndarray, g: float) -> Callable:
    """Sums of one partition: the Jacobian's products with itself and with the residuals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, 7))
        for batch in batches:
            raw = np.column_stack([c.to_numpy() for c in batch.columns])
            v = (raw - bias) * scale
            size = np.linalg.norm(v, axis=1)
            jac = np.hstack([-v * scale / size[:, None], v * (raw - bias) / size[:, None]])
            total += jac.T @ np.column_stack([jac, g - size])
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["sums"])

    return run


def rotation_from_gravity(mean: np.ndarray, target: np.ndarray = np.array([0.0, 0.0, 1.0])) -> np.ndarray:
    """The rotation that turns the mean gravity to the target; a half turn about a crossing axis where they are opposed."""
    a, b = mean / np.linalg.norm(mean), target / np.linalg.norm(target)
    v, c = np.cross(a, b), float(a @ b)
    if np.linalg.norm(v) < 1e-8:
        if c > 0:
            return np.eye(3)
        axis = np.eye(3)[np.argmin(np.abs(a))]
        axis = np.cross(a, axis)
        axis /= np.linalg.norm(axis)
        return 2 * np.outer(axis, axis) - np.eye(3)
    k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    return np.eye(3) + k + k @ k / (1 + c)


def _slopes(x: np.ndarray, y: np.ndarray, step: int) -> Iterator[np.ndarray]:
    """The slopes of all pairs of points with different x, in blocks of about `step`."""
    n = len(x)
    rows = max(1, step // max(1, n))
    for at in range(0, n - 1, rows):
        dx, dy = x[None, at + 1 :] - x[at : at + rows, None], y[None, at + 1 :] - y[at : at + rows, None]
        good = (np.arange(at + 1, n)[None, :] > np.arange(at, min(at + rows, n))[:, None]) & (dx != 0)
        yield dy[good] / dx[good]


def ranked_slopes(x: np.ndarray, y: np.ndarray, ranks: Callable[[int], list[int]], held: int = 4_000_000) -> list[float]:
    """The slopes at the ranks that `ranks` names for their number; at most about `held` are kept at a time."""
    low, high, count = np.inf, -np.inf, 0
    for s in _slopes(x, y, held):
        if len(s):
            low, high, count = min(low, s.min()), max(high, s.max()), count + len(s)
    out = []
    for rank in ranks(count) if count else []:
        a, b, below, inside = low, high, 0, count
        while inside > held and a < b:  # narrow [a, b] to the bin that holds the rank
            edges = np.unique(np.linspace(a, b, 1025))
            edges[0], edges[-1] = a, b
            at = np.zeros(len(edges), np.int64)
            for s in _slopes(x, y, held):
                s = s[(s >= a) & (s <= b)]
                at += np.bincount(np.searchsorted(edges, s), minlength=len(edges))  # bin k is (edge k - 1, edge k]
            upto = np.cumsum(at)
            k = int(np.searchsorted(upto, rank - below, "right"))
            inside = int(at[k])
            below += int(upto[k - 1]) if k else 0
            a, b = (a, a) if k == 0 else (np.nextafter(edges[k - 1], np.inf), edges[k])
        if a == b:
            out.append(float(a))
            continue
        kept = np.concatenate([s[(s >= a) & (s <= b)] for s in _slopes(x, y, held)])
        out.append(float(np.partition(kept, rank - below)[rank - below]))
    return out


def sen_interval(x: np.ndarray, y: np.ndarray, level: float = 0.95) -> tuple[float, float, float]:
    """Theil-Sen slope with its rank-based confidence interval; NaN where no two points have different x."""
    from statistics import NormalDist

    n = len(x)
    spread = NormalDist().inv_cdf(0.5 + level / 2) * np.sqrt(n * (n - 1) * (2 * n + 5) / 18)

    def ranks(m: int) -> list[int]:
        low, high = int(round((m - spread) / 2)), int(round((m + spread) / 2)) - 1
        return [(m - 1) // 2, m // 2, max(0, low), min(m - 1, high)]

    if not (found := ranked_slopes(x, y, ranks)):
        return float("nan"), float("nan"), float("nan")
    return (found[0] + found[1]) / 2, found[2], found[3]


# MacKinnon's response surfaces for the residual test of two series with a constant (Journal of Applied Econometrics 11, 1996; critical values of 2010).
COINT_CRITICAL = {0.01: (-3.89644, -10.9519, -22.527), 0.05: (-3.33613, -6.1101, -6.823), 0.10: (-3.04445, -4.2412, -2.720)}
COINT_SMALL_P, COINT_LARGE_P = (2.92, 1.5012, 0.039796), (2.1945, 0.64695, -0.29198, -0.042377)
COINT_LOWEST, COINT_TURN, COINT_HIGHEST = -18.86, -2.62, 0.92


def _least_squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Coefficients, residual sum of squares and the inverse of the products."""
    inverse = np.linalg.pinv(x.T @ x)
    coef = inverse @ (x.T @ y)
    return coef, float(((y - x @ coef) ** 2).sum()), inverse


def cointegration(y: np.ndarray, x: np.ndarray) -> tuple[float, float, tuple[float, float, float]]:
    """Engle-Granger: statistic, p-value and critical values (1, 5, 10 %) that the residual of y on x has a unit root.

    Residuals are tested with lagged differences, as many as Akaike's criterion picks of up to 12 (n / 100) ** 0.25. NaN with too few rows.
    """
    y, x = np.asarray(y, float), np.asarray(x, float)
    n = len(y)
    critical = tuple(sum(c / (n - 1) ** k for k, c in enumerate(row)) for row in COINT_CRITICAL.values()) if n > 1 else (np.nan,) * 3
    if n < 8:
        return float("nan"), float("nan"), critical
    base = np.column_stack([x, np.ones(n)])
    left = y - base @ _least_squares(base, y)[0]
    step = np.diff(left)
    most = min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)

    def design(lags: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        return np.column_stack([left[skip:-1], *[step[skip - k : len(step) - k] for k in range(1, lags + 1)]]), step[skip:]

    def criterion(lags: int) -> float:
        a, b = design(lags, most)
        return len(b) * np.log(max(_least_squares(a, b)[1], 1e-300) / len(b)) + 2 * a.shape[1]

    lags = min(range(most + 1), key=criterion)
    a, b = design(lags, lags)
    coef, rss, inverse = _least_squares(a, b)
    error = np.sqrt(rss / max(1, len(b) - a.shape[1]) * inverse[0, 0])
    stat = float(coef[0] / error) if error > 0 else float("-inf")
    if stat > COINT_HIGHEST:
        return stat, 1.0, critical
    if stat < COINT_LOWEST:
        return stat, 0.0, critical
    from statistics import NormalDist

    return stat, NormalDist().cdf(sum(c * stat**k for k, c in enumerate(COINT_SMALL_P if stat <= COINT_TURN else COINT_LARGE_P))), critical


def cointegrated(df: DataFrame, key: list[str], order: list[str], y: str, x: str) -> DataFrame:
    """The test for each series: n, statistic, p_value and whether the residual is a valid index (p below 0.05)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = {k: pdf[k].iloc[0] for k in key}
        pdf = pdf.sort_values(order, kind="stable").dropna(subset=[x, y])
        stat, p, _ = cointegration(pdf[y].to_numpy(float), pdf[x].to_numpy(float))
        return pd.DataFrame([{**name, "n": len(pdf), "statistic": stat, "p_value": p, "valid": bool(p < 0.05)}])

    names = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in key)
    return df.select(*dict.fromkeys([*key, *order, x, y])).groupBy(*key).applyInPandas(run, f"{names}, n long, statistic double, p_value double, valid boolean")
