from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from repolume.operators import additive

FIRST = date(2022, 1, 3)


def series(spark, values, repository="o/r", first=FIRST):
    rows = [(repository, first + timedelta(days=i), int(v)) for i, v in enumerate(values) if v]
    return spark.createDataFrame(rows, "repository string, ds date, y long")


def waves(count):
    return np.tile([30, 25, 20, 15, 10, -50, -50], count // 7 + 1)[:count]


def test_coefficients_equal_least_squares():
    """The normal equations give what least squares gives with a row for each penalty."""
    rng = np.random.default_rng(1)
    for count in (1, 2, 9, 40, 900):
        days = np.unique(rng.integers(18000, 18000 + 2 * count, count))
        counts = rng.integers(1, 90, len(days)).astype(float)
        top, beta, sigma = additive.solve(days, counts)
        terms = additive.design(days)
        extra = np.diag(np.sqrt(additive.penalties()))
        want = np.linalg.lstsq(
            np.concatenate([terms, extra]), np.append(counts / top, np.zeros(len(extra))), rcond=None
        )[0]
        assert beta == pytest.approx(want, abs=1e-6)
        assert sigma == pytest.approx(np.sqrt(np.mean((counts / top - terms @ beta) ** 2)))


def test_planted_change_point_and_week_are_found(spark):
    n, bend = 400, 160
    t = np.arange(n)
    trend = 100 + 0.5 * t + 2.0 * np.maximum(0, t - bend)
    data = series(spark, np.round(trend + waves(n)))
    fitted = additive.fit(data)
    dates = F.sequence(F.lit(FIRST), F.lit(FIRST + timedelta(days=n - 1)))
    rows = additive.predict(fitted, dates).orderBy("forecast_date").collect()
    weekly = np.array([r.weekly for r in rows])
    assert np.abs(weekly - (waves(n) - waves(7).mean())).max() < 4
    found = np.array([r.trend for r in rows])
    assert np.abs(found - trend).max() < 0.02 * trend.max()  # the bend is rounded off
    slopes = np.diff(found)
    assert np.abs(slopes[: bend - 60] - 0.5).max() < 0.25
    assert np.abs(slopes[bend + 60 :] - 2.5).max() < 0.25
    events = data.select(
        F.col("repository").alias("repo_name"),
        F.explode(F.array_repeat(F.col("ds").cast("timestamp"), F.col("y").cast("int"))).alias("created_at"),
    )
    changes = {r.change_date: r.slope_change for r in additive.trend_changes(events).collect()}
    assert len(changes) == additive.CHANGES
    nearest = max(changes, key=lambda d: changes[d])
    assert abs((nearest - FIRST).days - bend) <= 13  # the points are 12.8 days apart
    near = [c for d, c in changes.items() if abs((d - FIRST).days - bend) <= 60]
    assert sum(near) == pytest.approx(2.0, abs=0.3)
    far = [c for d, c in changes.items() if abs((d - FIRST).days - bend) > 60]
    assert max(map(abs, far)) < 0.1
    # thirty days on, the trend after the bend goes on
    future = additive.additive_from_series(data, "2024-01-01").orderBy("forecast_date").collect()
    for k, r in enumerate(future):
        want = 100 + 0.5 * (n + k) + 2.0 * (n + k - bend) + waves(n + 31)[n + k]
        assert r.predicted_events == pytest.approx(want, abs=20)
        assert r.lower_bound <= r.predicted_events <= r.upper_bound


def test_yearly_wave_needs_two_years(spark):
    def level(count):
        t = np.arange(count)
        return np.round(200 + 80 * np.sin(2 * np.pi * (t + 4) / 365.25))

    long = additive.fit(series(spark, level(1100))).first()
    short = additive.fit(series(spark, level(700))).first()
    assert max(map(abs, short.yearly)) == 0
    future = additive.additive_from_series(series(spark, level(1100)), "2025-01-01").collect()
    want = level(1130)[1100:]
    got = [r.predicted_events for r in sorted(future, key=lambda r: r.forecast_date)]
    assert max(map(abs, long.yearly)) > 0.1
    assert np.abs(np.array(got) - want).max() < 15


def test_width_is_that_of_simulated_trend_changes(spark):
    rng = np.random.default_rng(3)
    n = 200
    data = series(spark, np.round(50 + 0.3 * np.arange(n) + rng.normal(0, 5, n)))
    fitted = additive.fit(data)
    row = fitted.first()
    ahead = 60
    last = FIRST + timedelta(days=n - 1 + ahead)
    half = additive.predict(fitted, F.array(F.lit(last))).first().half
    size, h = np.mean(np.abs(row.changes)), ahead / (n - 1)
    draws = []
    for _ in range(20_000):
        many = rng.poisson(additive.CHANGES * h)
        left = rng.uniform(0, h, many)  # time that each change has left
        draws.append((rng.laplace(0, size, many) * left).sum())
    want = row.top * additive.Z_95 * np.sqrt(row.sigma**2 + np.var(draws))
    assert half == pytest.approx(want, rel=0.03)


def test_short_and_empty_histories(spark):
    both = series(spark, [5], "o/one").unionByName(series(spark, [4, 0, 6], "o/two"))
    rows = additive.additive_from_series(both, "2022-02-01", 3).collect()
    assert len(rows) == 6
    assert all(r.predicted_events >= 0 and r.model_type == "additive" for r in rows)
    one = [r for r in rows if r.repository == "o/one"]
    assert [r.predicted_events for r in one] == [pytest.approx(5, abs=1)] * 3
    empty = both.where("y < 0")
    assert additive.additive_from_series(empty, "2022-02-01").collect() == []


def test_fit_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(5)
    data = None
    for k in range(5):
        one = series(spark, rng.integers(0, 9, 60), f"o/r{k}")
        data = one if data is None else data.unionByName(one)
    results = [
        sorted(map(tuple, additive.additive_from_series(data.repartition(n), "2022-05-01").collect()))
        for n in (1, 7)
    ]
    assert results[0] == results[1]
