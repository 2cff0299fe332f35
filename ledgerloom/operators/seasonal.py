"""The two models of a monthly series: seasonal ARIMA with a stepwise order search, and Holt-Winters smoothing.

Series are tens of numbers, so both are fitted inside the task that has the series, in numpy; candidates are evaluated side by side, one array element each.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np

SEASON = 12
#: Largest orders: autoregressive and moving-average terms, and seasonal ones.
MOST, MOST_SEASONAL = 3, 1
#: Inverse roots of a model's polynomials beyond this are too near the unit circle.
NEAREST = 0.99
#: The 5 % point of the KPSS level test; the strength of a season from which it is differenced.
KPSS_POINT, STRONG = 0.463, 0.64


# Seasonal ARIMA by conditional least squares


def differenced(y: np.ndarray, d: int, seasonal: int, season: int) -> np.ndarray:
    for _ in range(seasonal):
        y = y[season:] - y[:-season]
    return np.diff(y, n=d)


def kpss(y: np.ndarray) -> float:
    """The KPSS statistic of level stationarity, with Bartlett weights."""
    n, e = len(y), y - y.mean()
    lags = int(4 * (n / 100) ** 0.25)
    var = (e @ e) / n + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) / n for k in range(1, lags + 1) if k < n)
    return float((np.cumsum(e) ** 2).sum() / (n * n * var)) if var > 1e-12 else 0.0


def season_strength(y: np.ndarray, season: int) -> float:
    """One minus the share of the rest in season and rest, after a centred moving average."""
    if len(y) < 2 * season + 1:
        return 0.0
    weights = np.r_[0.5, np.ones(season - 1), 0.5] / season if season % 2 == 0 else np.ones(season) / season
    trend = np.convolve(y, weights, "valid")
    begin = (len(y) - len(trend)) // 2
    left = y[begin : begin + len(trend)] - trend
    at = (np.arange(len(left)) + begin) % season
    means = np.array([left[at == k].mean() if (at == k).any() else 0.0 for k in range(season)])
    rest = left - means[at]
    return max(0.0, 1 - rest.var() / left.var()) if left.var() > 1e-12 else 0.0


def orders_of_differences(y: np.ndarray, season: int) -> tuple[int, int]:
    """How often the series is differenced, by month and by season."""
    seasonal = int(season > 1 and season_strength(y, season) > STRONG)
    d = 0
    while d < 2 and len(differenced(y, d, seasonal, season)) > 6 and kpss(differenced(y, d, seasonal, season)) > KPSS_POINT:
        d += 1
    return d, seasonal


def _stable(raw: np.ndarray) -> np.ndarray:
    """Coefficients of a stationary polynomial from unbounded numbers (columns are candidates), by partial autocorrelations."""
    part = np.tanh(raw)
    out = np.zeros_like(part)
    for k in range(len(part)):
        before = out[:k].copy()
        out[:k] = before - part[k] * before[::-1]
        out[k] = part[k]
    return out


def _lags(terms: np.ndarray, seasonal: np.ndarray, season: int, sign: float) -> np.ndarray:
    """The product of both polynomials as weights of the lags from 1 on: autoregression has sign -1, moving averages +1."""
    m = terms.shape[1]
    out = np.zeros((max(len(terms) + season * len(seasonal), 1), m))
    out[: len(terms)] += terms
    if len(seasonal):
        out[season - 1] += seasonal[0]
        out[season : season + len(terms)] += sign * terms * seasonal[0]
    return out


class Arima:
    """One order (p, q, P, Q, with a mean or not) on a differenced series."""

    def __init__(self, w: np.ndarray, order: tuple[int, int, int, int], mean: bool, season: int):
        self.w, self.order, self.mean, self.season = w, order, mean, season
        self.scale = float(w.std()) or 1.0
        start = np.full(sum(order), 0.1)
        self.raw = np.r_[start, w.mean() / self.scale] if mean else start
        self.raw, self.sse = self._fitted(self.raw)
        n, k = len(w), len(self.raw) + 1
        ar, ma, _ = (x[..., 0] for x in self.weights(self.raw[:, None]))
        inverse = [abs(r) for poly in (np.r_[1.0, -ar], np.r_[1.0, ma]) for r in np.roots(poly)]
        edge = max(inverse, default=0.0) > NEAREST  # of a model that cancels itself or is hardly stationary, the fit says little
        self.aicc = np.inf if edge else n * np.log(max(self.sse / n, 1e-12 * self.scale**2 + 1e-300)) + 2 * k + 2 * k * (k + 1) / (n - k - 1)

    def weights(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lags of the autoregression and of the moving average, and the mean, of candidates in columns."""
        p, q, sp, sq = self.order
        cut = np.cumsum([p, q, sp, sq])
        ar, ma, sar, sma = raw[: cut[0]], raw[cut[0] : cut[1]], raw[cut[1] : cut[2]], raw[cut[2] : cut[3]]
        mean = raw[-1] * self.scale if self.mean else np.zeros(raw.shape[1])
        return _lags(_stable(ar), np.tanh(sar), self.season, -1.0), _lags(-_stable(ma), -np.tanh(sma), self.season, 1.0), mean

    def residuals(self, raw: np.ndarray) -> np.ndarray:
        """One-step errors, a row a month; what is before the first month is the mean, without error."""
        ar, ma, mean = self.weights(raw)
        n, reach = len(self.w), len(ma)
        x = np.zeros((n + len(ar), raw.shape[1]))
        x[len(ar) :] = self.w[:, None] - mean
        e = np.zeros((reach + n, raw.shape[1]))
        e[reach:] = x[len(ar) :]
        for k in range(len(ar)):
            e[reach:] -= ar[k] * x[len(ar) - 1 - k : len(ar) - 1 - k + n]
        used = np.flatnonzero(ma.any(axis=1))
        if len(used):
            used_ma, back = ma[used], reach - 1 - used
            for t in range(n):
                e[reach + t] -= (used_ma * e[back + t]).sum(axis=0)
        return e[reach:]

    def _fitted(self, raw: np.ndarray) -> tuple[np.ndarray, float]:
        """Levenberg-Marquardt with numeric derivatives; a step's candidates run side by side."""
        e = self.residuals(raw[:, None])[:, 0]
        best, damp = float(e @ e), 1e-2
        for _ in range(40 if len(raw) else 0):
            h = 1e-5
            moved = self.residuals(raw[:, None] + h * np.eye(len(raw)))
            jacobian = (moved - e[:, None]) / h
            square, down = jacobian.T @ jacobian, jacobian.T @ e
            tries = [damp * f for f in (0.1, 1.0, 10.0, 1000.0)]
            steps = np.stack([raw - np.linalg.lstsq(square + t * np.diag(np.diag(square) + 1e-8), down, rcond=None)[0] for t in tries], axis=1)
            steps = np.clip(steps, -6, 6) if not self.mean else np.vstack([np.clip(steps[:-1], -6, 6), steps[-1:]])
            found = self.residuals(steps)
            errors = (found * found).sum(axis=0)
            i = int(np.argmin(np.where(np.isfinite(errors), errors, np.inf)))
            if not errors[i] < best * (1 - 1e-7):
                break
            raw, e, best, damp = steps[:, i], found[:, i], float(errors[i]), tries[i]
        return raw, best

    def forecast(self, y: np.ndarray, d: int, seasonal: int, horizon: int) -> np.ndarray:
        """The next months of the series that was differenced."""
        ar, ma, mean = (x[..., 0] for x in self.weights(self.raw[:, None]))
        e = list(self.residuals(self.raw[:, None])[:, 0])
        w = list(self.w - mean)
        for _ in range(horizon):
            value = sum(a * w[-1 - k] for k, a in enumerate(ar) if k < len(w)) + sum(m * e[-1 - k] for k, m in enumerate(ma) if k < len(e))
            w.append(value)
            e.append(0.0)
        new = np.array(w[-horizon:]) + mean
        levels = [y]
        for _ in range(seasonal):
            levels.append(levels[-1][self.season :] - levels[-1][: -self.season])
        for _ in range(d):
            levels.append(np.diff(levels[-1]))
        for i in range(d, 0, -1):
            new = levels[seasonal + i - 1][-1] + np.cumsum(new)
        for i in range(seasonal, 0, -1):
            before = list(levels[i - 1][-self.season :])
            for v in new:
                before.append(before[-self.season] + v)
            new = np.array(before[self.season :])
        return new


def auto_arima(y: np.ndarray, season: int = SEASON) -> tuple[Arima, int, int]:
    """The model of least AICc of a stepwise search from four starts, and the orders of differences; season 1 has no seasonal terms."""
    d, seasonal = orders_of_differences(y, season)
    w = differenced(y, d, seasonal, season)
    most, known = MOST_SEASONAL if season > 1 else 0, {}

    def model(order: tuple[int, int, int, int], mean: bool) -> float:
        key = order, mean
        if key not in known:
            size = sum(order) + mean + 1
            fits = all(0 <= x <= m for x, m in zip(order, (MOST, MOST, most, most), strict=True)) and len(w) - size - 1 > 0 and len(w) > season * max(order[2:])
            known[key] = Arima(w, order, mean, season) if fits and (not mean or d + seasonal < 2) else None
        return known[key].aicc if known[key] is not None else np.inf

    mean = d + seasonal < 2
    starts = [(2, 2, most, most), (0, 0, 0, 0), (1, 0, most, 0), (0, 1, 0, most)]
    best = min([(o, mean) for o in starts] + [((0, 0, 0, 0), False)], key=lambda k: model(*k))
    while True:
        (p, q, sp, sq), m = best
        near = [((p + a, q + b, sp, sq), m) for a, b in itertools.product((-1, 0, 1), repeat=2)] + [((p, q, sp + a, sq + b), m) for a, b in itertools.product((-1, 0, 1), repeat=2)] + [((p, q, sp, sq), not m)]
        found = min(near, key=lambda k: model(*k))
        if not model(*found) < model(*best):
            return known[best], d, seasonal
        best = found


def arima(y: np.ndarray, horizon: int, season: int = SEASON) -> np.ndarray:
    model, d, seasonal = auto_arima(y, season)
    return model.forecast(y, d, seasonal, horizon)


# Holt-Winters

#: Candidate weights of level, trend and season that a search begins from.
GRID = [np.array(g) for g in itertools.product((0.1, 0.3, 0.5, 0.8), (0.0, 0.1, 0.3), (0.1, 0.3))]


def _start(y: np.ndarray, season: int, times: bool) -> tuple[float, float, np.ndarray]:
    """Level and trend before the first month, and the first season."""
    if not season:
        return y[0] - (y[1] - y[0] if len(y) > 1 else 0.0), (y[1] - y[0] if len(y) > 1 else 0.0), np.zeros(1)
    first, second = y[:season].mean(), y[season : 2 * season].mean()
    if times:
        trend = (second / first) ** (1 / season)
        level = first / trend ** ((season + 1) / 2)
        return level, trend, y[:season] / (level * trend ** np.arange(1, season + 1))
    trend = (second - first) / season
    level = first - trend * (season + 1) / 2
    return level, trend, y[:season] - (level + trend * np.arange(1, season + 1))


def _run(y: np.ndarray, x: np.ndarray, season: int, times: bool) -> tuple[np.ndarray, Callable[[int, int], np.ndarray]]:
    """Squared errors of candidates (columns: three weights, shifts of the first level and trend), and a candidate's forecast."""
    a, b, g = x[:3]
    level0, trend0, s0 = _start(y, season, times)
    level, trend = level0 + x[3] * (y.std() or 1.0), trend0 * np.exp(x[4] / 10) if times else trend0 + x[4] * (y.std() or 1.0) / 10
    s, error = [np.full(x.shape[1], v) for v in s0], np.zeros(x.shape[1])
    with np.errstate(all="ignore"):
        for t, v in enumerate(y):
            old = s[t % len(s)]
            base = level * trend if times else level + trend
            error = error + (v - (base * old if times else base + old)) ** 2
            new = a * (v / old if times else v - old) + (1 - a) * base
            trend = b * (new / level if times else new - level) + (1 - b) * trend
            if season:
                s[t % len(s)] = g * (v / base if times else v - base) + (1 - g) * old
            level = new

    def ahead(i: int, horizon: int) -> np.ndarray:
        h = np.arange(1, horizon + 1)
        after = np.array([s[(len(y) + k - 1) % len(s)][i] for k in h])
        return level[i] * trend[i] ** h * after if times else level[i] + trend[i] * h + after

    return np.where(np.isfinite(error), error, np.inf), ahead


def fitted(y: np.ndarray, season: int, times: bool) -> tuple[float, Callable[[int], np.ndarray]]:
    """Least squared error and the forecast of a form: the best of the grid, then ever smaller steps in all directions at once."""
    at = np.array([np.r_[g, 0.0, 0.0] for g in GRID]).T
    errors, ahead = _run(y, at, season, times)
    i = int(np.argmin(errors))
    best, error, out = at[:, i], errors[i], (ahead, i)
    moves = np.array(list(itertools.product((-1.0, 0.0, 1.0), repeat=5))).T
    step = np.array([0.15, 0.1, 0.1, 0.3, 0.3])
    for _ in range(24):
        at = best[:, None] + moves * step[:, None]
        at[:3] = np.clip(at[:3], [[1e-4], [0.0], [0.0]], 0.9999)
        errors, ahead = _run(y, at, season, times)
        i = int(np.argmin(errors))
        if errors[i] < error:
            best, error, out = at[:, i], errors[i], (ahead, i)
        else:
            step = step / 2
    return float(error), lambda horizon: out[0](out[1], horizon)


def holt_winters(y: np.ndarray, horizon: int, season: int = SEASON) -> np.ndarray:
    """Multiplicative where all values are positive, else additive, both from two seasons on; without them, or where a fit fails, Holt's trend alone."""
    forms = [(season, True), (season, False)] if season > 1 and len(y) >= 2 * season else []
    for of, times in [*(f for f in forms if not f[1] or (y > 0).all()), (0, False)]:
        error, ahead = fitted(y, of, times)
        values = ahead(horizon)
        if np.isfinite(error) and np.isfinite(values).all():
            return values
    return np.full(horizon, y[-1])
