"""The forecast models against simulated series and plain recursions."""

import datetime
import itertools

import numpy as np
import pandas as pd
import pytest

from ledgerloom.operators import forecast, seasonal


def simulated(n, ar=(), ma=(), sar=0.0, season=12, seed=0, mean=0.0):
    rng = np.random.default_rng(seed)
    e, y = rng.standard_normal(n + 200), np.zeros(n + 200)
    phi = np.r_[1.0, -np.array(ar)]
    if sar:
        phi = np.convolve(phi, np.r_[1.0, np.zeros(season - 1), -sar])
    for t in range(200, n + 200):
        y[t] = -sum(p * y[t - k] for k, p in enumerate(phi) if k) + e[t] + sum(m * e[t - 1 - k] for k, m in enumerate(ma))
    return y[200:] + mean


@pytest.mark.parametrize("ar, ma, order, seeds", [((0.8,), (), (1, 0), (0, 2, 3)), ((), (0.7,), (0, 1), (0, 1, 2)), ((0.5, 0.35), (), (2, 0), (3,)), ((), (), (0, 0), (0, 1, 2))])
def test_orders_are_recovered(ar, ma, order, seeds):
    for seed in seeds:
        model, d, s = seasonal.auto_arima(simulated(400, ar, ma, seed=seed, mean=10.0), season=1)
        assert (d, s) == (0, 0) and model.order[:2] == order
        found_ar, found_ma, _ = model.weights(model.raw[:, None])
        assert np.allclose(found_ar[: len(ar), 0], ar, atol=0.12) and np.allclose(found_ma[: len(ma), 0], ma, atol=0.12)


def test_seasonal_terms_are_recovered():
    model, d, s = seasonal.auto_arima(simulated(400, (0.4,), sar=0.5, seed=2))
    assert (d, s) == (0, 0) and model.order[0] == 1 and model.order[2] == 1


def test_differences_are_taken():
    rng = np.random.default_rng(2)
    walk, wave = np.cumsum(rng.standard_normal(200)), 5 * np.sin(np.arange(120) * 2 * np.pi / 12) + 0.1 * rng.standard_normal(120)
    assert seasonal.orders_of_differences(walk, 1)[0] == 1 and seasonal.orders_of_differences(wave, 12)[1] == 1
    assert seasonal.orders_of_differences(simulated(200, (0.3,)), 12) == (0, 0)


def test_residuals_and_forecasts_are_those_of_plain_recursions():
    y = np.cumsum(simulated(90, (0.5,), (0.3,), sar=0.3, seed=8) + 0.5)
    w = seasonal.differenced(y, 1, 1, 12)
    for order, mean in (((2, 1, 1, 1), True), ((0, 3, 0, 1), False), ((3, 0, 1, 0), True)):
        m = seasonal.Arima(w, order, mean, 12)
        ar, ma, mu = (x[..., 0] for x in m.weights(m.raw[:, None]))
        x, e = list(w - mu), []
        for t in range(len(w)):
            e.append(x[t] - sum(a * x[t - 1 - k] for k, a in enumerate(ar) if t > k) - sum(b * e[t - 1 - k] for k, b in enumerate(ma) if t > k))
        assert np.allclose(m.residuals(m.raw[:, None])[:, 0], e) and np.isclose(m.sse, np.sum(np.square(e)))
        z = list(y)
        for _ in range(6):
            t = len(x)
            x.append(sum(a * x[t - 1 - k] for k, a in enumerate(ar)) + sum(b * e[t - 1 - k] for k, b in enumerate(ma)))
            e.append(0.0)
            z.append(x[-1] + mu + z[-1] + z[-12] - z[-13])
        assert np.allclose(m.forecast(y, 1, 1, 6), z[-6:])


def test_fits_are_no_worse_than_true_parameters():
    """Least squares found from a fixed start reach those of the parameters that made the series."""
    for seed in range(4):
        m = seasonal.Arima(simulated(300, (0.6,), (0.4,), seed=seed), (1, 1, 0, 0), False, 12)
        true = np.array([[np.arctanh(0.6)], [np.arctanh(-0.4)]])
        assert m.sse <= (m.residuals(true) ** 2).sum() * 1.0001


SERIES = [np.array([12.0, 15, 11, 18, 22, 30, 41, 39, 25, 18, 14, 20] * 3) * np.linspace(1, 1.6, 36), np.r_[0.0, np.abs(np.sin(np.arange(47)) * 20)], np.linspace(5, 40, 30) + np.tile([0, 3.0, -2], 10), np.array([5.0, 9, 2, 8, 8, 3, 7, 10])]


def grid_error(y, season, times):
    """The least error over the first grid, one candidate at a time."""
    return min(float(seasonal._run(y, np.array([[*g, 0.0, 0.0]]).T, season, times)[0][0]) for g in itertools.product((0.1, 0.3, 0.5, 0.8), (0.0, 0.1, 0.3), (0.1, 0.3)))


@pytest.mark.parametrize("y", SERIES)
def test_smoothing_is_no_worse_than_its_grid(y):
    for season, times in ((12, True), (12, False), (0, False)):
        if season and (len(y) < 24 or times and (y <= 0).any()):
            continue
        error, ahead = seasonal.fitted(y, season, times)
        assert error <= grid_error(y, season, times) and np.isfinite(ahead(6)).all()


def test_forms_of_smoothing(monkeypatch):
    """Multiplicative where all values are positive, else additive, else Holt's."""
    asked, real = [], seasonal.fitted
    monkeypatch.setattr(seasonal, "fitted", lambda y, season, times: asked.append((season, times)) or real(y, season, times))
    grown = SERIES[0]
    values = seasonal.holt_winters(grown, 12)
    assert asked == [(12, True)] and np.allclose(values, [12.0, 15, 11, 18, 22, 30, 41, 39, 25, 18, 14, 20] * np.linspace(1.62, 1.81, 12), rtol=0.05)
    asked.clear()
    seasonal.holt_winters(SERIES[1], 6)
    assert asked == [(12, False)]
    asked.clear()
    assert np.allclose(seasonal.holt_winters(np.arange(10.0), 3), [10, 11, 12]) and asked == [(0, False)]
    asked.clear()
    monkeypatch.setattr(seasonal, "fitted", lambda y, season, times: asked.append((season, times)) or ((np.inf, lambda h: np.zeros(h)) if season else real(y, season, times)))
    seasonal.holt_winters(grown, 6)
    assert asked == [(12, True), (12, False), (0, False)]


def frame(values):
    months = [datetime.date(2020 + i // 12, i % 12 + 1, 1) for i in range(len(values))]
    return pd.DataFrame({"k": "a", "mes": months, "v": values})


def test_a_constant_series_is_deterministic():
    out = forecast._fit(["k"], "mes", "v")(frame([3.0] * 10 + [7.5] * 14))
    assert set(out["modelo"]) == {"DETERMINISTA"} and list(out["valor"]) == [7.5] * 6 and list(out["paso"]) == [1, 2, 3, 4, 5, 6] and out["mae"][0] == 0
    assert out["mes"][0] == datetime.date(2022, 1, 1)


def test_the_winner_has_the_smaller_error():
    rng = np.random.default_rng(7)
    for y in (SERIES[0] + rng.random(36), np.abs(np.cumsum(rng.standard_normal(40))) + 5, np.array([5.0, 9, 2, 8, 8, 3, 7, 10, 4, 6, 7, 5, 9])):
        out = forecast._fit(["k"], "mes", "v")(frame(y))
        season = 12 if len(y) >= 24 else 1
        mae = {m: float(np.abs(f(y[:-6], 6, season) - y[-6:]).mean()) for m, f in forecast.MODELS.items()}
        best = min(mae, key=mae.get)
        assert set(out["modelo"]) == {best} and out["mae"][0] == pytest.approx(mae[best], abs=1e-4)
        assert np.allclose(out["valor"], forecast.MODELS[best](y, 6, season), atol=0.006)


def test_series_that_cannot_be_trained():
    out = forecast._fit(["k"], "mes", "v")(frame([0.0] * 20 + [1.0] * 11))
    assert list(out["modelo"]) == ["NO_ENTRENABLE"] and list(out["paso"]) == [0]


def test_odd_series_have_a_forecast():
    for y in ([1.0] * 6, [0.0, 0, 0, 0, 0, 1], np.r_[np.zeros(30), 1e9], np.arange(13.0), [1e-9, 2e-9, 1e-9, 3e-9, 1e-9, 1e-9, 2e-9], np.tile([1.0, 100], 20)):
        for season in (1, 12):
            for model in forecast.MODELS.values():
                assert np.isfinite(model(np.asarray(y, dtype=float), 6, season)).all()
