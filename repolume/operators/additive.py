"""Additive forecast: a trend that bends at change points, with weekly and yearly waves.

    y / top = m + k t + sum_j d_j max(0, t - s_j) + weekly waves + yearly waves

t runs from 0 on a repository's first day to 1 on its last, and the ``CHANGES`` change points
s_j lie at equal distances in the first ``CHANGE_RANGE`` of that time. Waves are sines and
cosines of ``WEEKLY`` and ``YEARLY`` orders, if the history is long enough to tell them.
Coefficients are those of ridge regression: ``penalties`` says how dear each is.

Events are counted per repository and day; then each repository, a row per day that had
events, is one normal equation of fixed size, and all are solved in one job. What comes out
is a row of coefficients, from which any date is forecast by plain expressions.

The bounds are those of trend changes to come: as many for each length of the history as it
had change points, at any time, each as large as the past ones are on average (Laplace
distributed). The variance of their sum is known in closed form, so nothing is drawn.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolume.functions.timecols import AsOf, as_datetime, days_before
from repolume.operators.forecast import (
    PERIODS,
    Z_95,
    forecast_errors,
    training_series,
    whole_count,
)
from repolume.workers import ship

MODEL_TYPE = "additive"
CHANGES, CHANGE_RANGE = 25, 0.8
WEEKLY, YEARLY = 3, 10  # orders of the waves
WEEK, YEAR = 7.0, 365.25
WEEKLY_MIN_DAYS, YEARLY_MIN_DAYS = 14, 730
LEVEL_PENALTY, CHANGE_PENALTY, WAVE_PENALTY = 1e-6, 0.1, 0.01

FITTED = (
    "repository string, first_day date, last_day date, top double, level double, slope double, "
    "changes array<double>, weekly array<double>, yearly array<double>, sigma double"
)


def change_points() -> list[float]:
    return [CHANGE_RANGE * j / CHANGES for j in range(1, CHANGES + 1)]


def penalties() -> np.ndarray:
    waves = 2 * (WEEKLY + YEARLY)
    return np.array(
        [LEVEL_PENALTY] * 2 + [CHANGE_PENALTY] * CHANGES + [WAVE_PENALTY] * waves, float
    )


def _waves(days: np.ndarray, period: float, order: int, used: bool) -> np.ndarray:
    if not used:
        return np.zeros((len(days), 2 * order))
    angle = 2 * math.pi * days[:, None] * np.arange(1, order + 1) / period
    return np.concatenate([np.sin(angle), np.cos(angle)], axis=1)


def design(days: np.ndarray) -> np.ndarray:
    """One row of terms for each day, given as days since 1970 in rising order."""
    span = int(days[-1] - days[0])
    t = (days - days[0]) / max(span, 1)
    bends = np.maximum(0.0, t[:, None] - np.array(change_points()))
    return np.concatenate(
        [
            np.stack([np.ones(len(t)), t], axis=1),
            bends,
            _waves(days, WEEK, WEEKLY, span >= WEEKLY_MIN_DAYS),
            _waves(days, YEAR, YEARLY, span >= YEARLY_MIN_DAYS),
        ],
        axis=1,
    )


def solve(days: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray, float]:
    """The largest count, the coefficients of counts divided by it, and what is left over on
    the mean (root of the mean square)."""
    top = float(counts.max())
    terms, y = design(days), counts / top
    beta = np.linalg.solve(terms.T @ terms + np.diag(penalties()), terms.T @ y)
    rest = y - terms @ beta
    return top, beta, float(np.sqrt(np.mean(rest * rest)))


def fit(series: DataFrame) -> DataFrame:
    """One row of coefficients per repository, from rows (repository, ds, y)."""
    day = F.struct(F.unix_date("ds").alias("d"), F.col("y").cast("double").alias("y"))
    histories = (
        series.where(F.col("ds").isNotNull() & (F.col("y") > 0))
        .groupBy("repository")
        .agg(F.sort_array(F.collect_list(day)).alias("days"))
        .select("repository", F.col("days.d").alias("days"), F.col("days.y").alias("counts"))
    )
    bends = slice(2, 2 + CHANGES)
    weekly = slice(bends.stop, bends.stop + 2 * WEEKLY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, rows = batch.column(0), []
            for days, counts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                top, beta, sigma = solve(np.array(days, np.int64), np.array(counts))
                rows.append(
                    (
                        days[0],
                        days[-1],
                        top,
                        beta[0],
                        beta[1],
                        beta[bends].tolist(),
                        beta[weekly].tolist(),
                        beta[weekly.stop :].tolist(),
                        sigma,
                    )
                )
            columns = [list(column) for column in zip(*rows)] or [[] for _ in range(9)]
            kinds = [pa.int32()] * 2 + [pa.float64()] * 3 + [pa.list_(pa.float64())] * 3
            arrays = [pa.array(c, k) for c, k in zip(columns, [*kinds, pa.float64()])]
            arrays[:2] = [days.cast(pa.date32()) for days in arrays[:2]]
            yield pa.RecordBatch.from_arrays(
                [names, *arrays], names=[f.split()[0] for f in FITTED.split(", ")]
            )

    ship(series.sparkSession)
    return histories.mapInArrow(run, FITTED)


def _sum(terms: list[Column]) -> Column:
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def _wave_terms(name: str, date: Column, period: float, order: int) -> list[Column]:
    days = F.unix_date(date)
    terms = []
    for part, function in enumerate((F.sin, F.cos)):
        for k in range(1, order + 1):
            wave = function(F.lit(2 * math.pi) * days * F.lit(k) / F.lit(period))
            terms.append(F.col(name)[part * order + k - 1] * wave)
    return terms


def predict(fitted: DataFrame, dates: Column) -> DataFrame:
    """repository, forecast_date, trend, weekly, yearly, yhat and half (of the 95 % interval)
    for an array of dates of each fitted repository, in events."""
    rows = fitted.withColumn("forecast_date", F.explode(dates))
    span = F.greatest(F.datediff("last_day", "first_day"), F.lit(1)).cast("double")
    rows = rows.withColumn("t", F.datediff("forecast_date", "first_day") / span)
    bends = [
        F.col("changes")[j] * F.greatest(F.col("t") - F.lit(s), F.lit(0.0))
        for j, s in enumerate(change_points())
    ]
    size = F.aggregate("changes", F.lit(0.0), lambda a, x: a + F.abs(x)) / CHANGES
    ahead = F.greatest(F.col("t") - 1, F.lit(0.0))
    # CHANGES / span changes a day, each of variance 2 size^2 times its time squared
    drift = F.lit(2.0 * CHANGES / 3) * size * size * ahead * ahead * ahead
    top, date = F.col("top"), F.col("forecast_date")
    return rows.select(
        "repository",
        "forecast_date",
        (top * _sum([F.col("level"), F.col("slope") * F.col("t"), *bends])).alias("trend"),
        (top * _sum(_wave_terms("weekly", date, WEEK, WEEKLY))).alias("weekly"),
        (top * _sum(_wave_terms("yearly", date, YEAR, YEARLY))).alias("yearly"),
        (top * F.lit(Z_95) * F.sqrt(F.col("sigma") * F.col("sigma") + drift)).alias("half"),
    ).withColumn("yhat", F.col("trend") + F.col("weekly") + F.col("yearly"))


def _counts(predicted: DataFrame, training_date: AsOf) -> DataFrame:
    yhat, half = F.col("yhat"), F.col("half")
    return predicted.select(
        "repository",
        "forecast_date",
        whole_count(yhat).alias("predicted_events"),
        whole_count(yhat - half).alias("lower_bound"),
        whole_count(yhat + half).alias("upper_bound"),
        F.lit(MODEL_TYPE).alias("model_type"),
        F.lit(as_datetime(training_date).date()).alias("training_date"),
    )


def forecast_additive(
    events: DataFrame, training_date: AsOf, periods: int = PERIODS, repos=None
) -> DataFrame:
    """Forecast and 95 % bounds for the days after each repository's last day."""
    return additive_from_series(training_series(events, repos), training_date, periods)


def additive_from_series(
    series: DataFrame, training_date: AsOf, periods: int = PERIODS
) -> DataFrame:
    """``forecast_additive`` from a training series."""
    days = F.sequence(F.date_add("last_day", 1), F.date_add("last_day", periods))
    return _counts(predict(fit(series), days), training_date)


def trend_changes(events: DataFrame, repos=None) -> DataFrame:
    """repository, change_date, slope_change: at each change point, by how many events a day
    the trend's daily growth changes."""
    fitted = fit(training_series(events, repos))
    span = F.greatest(F.datediff("last_day", "first_day"), F.lit(1))
    points = F.arrays_zip(
        F.array(*map(F.lit, change_points())).alias("at"), F.col("changes").alias("by")
    )
    rows = fitted.select("repository", "first_day", "top", span.alias("span"), F.inline(points))
    return rows.select(
        "repository",
        F.date_add("first_day", F.floor(F.col("at") * F.col("span")).cast("int")).alias("change_date"),
        (F.col("by") * F.col("top") / F.col("span")).alias("slope_change"),
    )


def backtest(events: DataFrame, as_of: AsOf, holdout: int = 7, repos=None) -> DataFrame:
    """``forecast.backtest`` with this model: days, mae and coverage of the hold-out days."""
    edge = days_before(as_of, holdout).replace(hour=0, minute=0, second=0, microsecond=0)
    first, last = F.lit(edge.date()), F.lit(as_datetime(as_of).date())
    series = training_series(events, repos)
    fitted = fit(series.where(F.col("ds") < first))
    predicted = _counts(predict(fitted, F.sequence(first, last)), as_of)
    return forecast_errors(predicted, series.where(F.col("ds").between(first, last)))
