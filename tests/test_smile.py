"""The smile of volatilities: its residuals add up to the target, a planted outlier is found, a smooth curve has none."""

import datetime as dt

import numpy as np

from ladderlake.operators import grouped

SCHEMA = "symbol string, expiry date, timestamp timestamp, strike_price double, ce_iv double"
KEY = (dt.date(2024, 1, 25), dt.datetime(2024, 1, 8, 9))


def test_smile_finds_what_was_planted(spark):
    curve = [12 + 0.002 * (k - 100) ** 2 for k in range(60, 141, 5)]
    bent = [v + (6 if i == 8 else 0) for i, v in enumerate(curve)]
    rows = [("A", *KEY, 60.0 + 5 * i, v) for i, v in enumerate(bent)] + [("B", *KEY, 60.0 + 5 * i, v) for i, v in enumerate(curve)] + [("C", *KEY, 60.0 + i, 10.0) for i in range(4)] + [("A", *KEY, 300.0, 200.0)]
    got = grouped.iv_smile(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.symbol, r.strike_price) for r in got if r.anomaly} == {("A", 100.0)}
    # the residuals of 17 strikes add up to 8.5; a quadratic is met in all its points; too few strikes have no curve
    assert abs(sum((r.iv - r.fitted) ** 2 for r in got if r.symbol == "A") / 8.5 - 1) < 0.01
    assert all(abs(r.fitted - r.iv) < 1e-6 and r.zscore == 0 for r in got if r.symbol == "B") and {r.symbol for r in got} == {"A", "B"}


def test_rows_of_one_strike_count_as_their_mean(spark):
    rows = [("A", *KEY, 100.0 + i, 20.0 + i) for i in range(6)] + [("A", *KEY, 102.0, 26.0), ("A", *KEY, 103.0, None)]
    got = {r.strike_price: r.iv for r in grouped.iv_smile(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {100.0: 20.0, 101.0: 21.0, 102.0: 24.0, 103.0: 23.0, 104.0: 24.0, 105.0: 25.0}
    assert grouped.iv_smile(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stiffness_against_a_grid():
    """Over uneven strikes, the curve is that of a grid of stiffnesses whose residuals come nearest to the target."""
    r = np.random.default_rng(3)
    for n in (5, 12, 60, 200):
        x = np.cumsum(r.choice([5.0, 10.0, 50.0], n)) + 1000
        y = 15 + 1e-5 * (x - x.mean()) ** 2 + r.normal(0, 2.5, n)
        target = max(0.5 * n, 3.0)
        fitted = grouped.smooth_to(x, y, target)
        at = (x - x[0]) / np.diff(x).mean()
        d = np.eye(n)
        for order in range(1, 5):
            d = np.diff(d, axis=0) / (at[order:] - at[:-order])[:, None]
        cubic = np.polyval(np.polyfit(at, y, 3), at)
        if ((y - cubic) ** 2).sum() <= target:
            assert np.allclose(fitted, cubic, atol=1e-3)
            continue
        assert abs(((y - fitted) ** 2).sum() / target - 1) < 0.01
        grid = [np.linalg.solve(np.eye(n) + 10.0**p * d.T @ d, y) for p in np.arange(-12, 12, 0.02)]
        best = min(grid, key=lambda f: abs(((y - f) ** 2).sum() - target))
        assert np.abs(best - fitted).max() < 0.1
