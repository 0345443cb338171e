"""Daily forecasts per repository.

The model is a straight trend plus weekday means and, as ``yearly`` says, month
means, fitted to the days that had events. ``yearly`` is True, False, or "auto": month
means for repositories with two years of history. All
repositories are fitted in one job: events are counted per (repository, day),
and what is left of a repository, one row per day, meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolume.functions.timecols import AsOf, as_datetime, day, days_before, in_repos, last_days

MODEL_TYPE = "trend_weekly"
# Fixed value: half width of a 95 % interval in standard deviations.
Z_95 = 1.959964
YEARLY_MIN_DAYS = 730
PERIODS = 30


def training_series(events: DataFrame, repos=None) -> DataFrame:
    """Events per repository and day (``ds``, ``y``); days without events are absent."""
    return in_repos(events, repos).groupBy(
        F.col("repo_name").alias("repository"), day(F.col("created_at")).alias("ds")
    ).agg(F.count("*").alias("y"))


def training_series_from_rollup(rollup: DataFrame, repos=None) -> DataFrame:
    """The same series from the daily rollup, without reading the events."""
    return in_repos(rollup, repos).groupBy(
        F.col("repo_name").alias("repository"), F.col("date").alias("ds")
    ).agg(F.sum("event_count").alias("y"))


def fit(series: DataFrame, yearly: bool | str = "auto") -> DataFrame:
    """One row of parameters per repository, among them whether month means are used."""
    repo = Window.partitionBy("repository")
    weekday = Window.partitionBy("repository", "dow")
    month = Window.partitionBy("repository", "month")
    x = F.datediff("ds", "first_day")
    line = F.col("intercept") + F.col("slope") * F.col("x")
    has_years = (
        F.datediff("last_day", "first_day") >= YEARLY_MIN_DAYS
        if yearly == "auto"
        else F.lit(bool(yearly))
    )
    fitted = (
        series.withColumns({
            "first_day": F.min("ds").over(repo),
            "last_day": F.max("ds").over(repo),
            "days": F.count("*").over(repo),
            "dow": F.dayofweek("ds"),
            "month": F.month("ds"),
            "y": F.col("y").cast("double"),
        })
        .withColumn("x", x.cast("double"))
        .withColumns({
            # a single day has no slope: the line is level through it
            "slope": F.when(F.col("days") == 1, 0.0).otherwise(
                F.regr_slope("y", "x").over(repo)
            ),
            "intercept": F.when(F.col("days") == 1, F.col("y")).otherwise(
                F.regr_intercept("y", "x").over(repo)
            ),
        })
        .withColumn("rest", F.col("y") - line)
        .withColumn("weekly", F.avg("rest").over(weekday))
        .withColumn("rest", F.col("rest") - F.col("weekly"))
        .withColumn("has_years", has_years)
        .withColumn("yearly", F.when(F.col("has_years"), F.avg("rest").over(month)).otherwise(0.0))
        .withColumn("rest", F.col("rest") - F.col("yearly"))
    )
    return fitted.groupBy("repository").agg(
        F.max("first_day").alias("first_day"),
        F.max("last_day").alias("last_day"),
        F.max("slope").alias("slope"),
        F.max("intercept").alias("intercept"),
        F.stddev_pop("rest").alias("sigma"),
        F.max("has_years").alias("has_years"),
        F.map_from_entries(F.collect_set(F.struct("dow", "weekly"))).alias("weekly"),
        F.map_from_entries(F.collect_set(F.struct("month", "yearly"))).alias("yearly"),
    )


def whole_count(value: Column) -> Column:
    """A count: not negative, truncated; values a rounding error below a whole
    number count as it."""
    return F.floor(F.round(F.greatest(F.lit(0.0), value), 6)).cast("double")


def forecast_repos(
    events: DataFrame,
    training_date: AsOf,
    periods: int = PERIODS,
    repos=None,
    yearly: bool | str = "auto",
) -> DataFrame:
    """Forecast and 95 % bounds for the days after each repository's last day."""
    return forecast_from_series(training_series(events, repos), training_date, periods, yearly)


def forecast_from_series(
    series: DataFrame,
    training_date: AsOf,
    periods: int = PERIODS,
    yearly: bool | str = "auto",
) -> DataFrame:
    """``forecast_repos`` from a training series."""
    days = F.sequence(F.date_add("last_day", 1), F.date_add("last_day", periods))
    return _predicted(fit(series, yearly), days, training_date)


def _predicted(fitted: DataFrame, dates: Column, training_date: AsOf) -> DataFrame:
    """Forecast rows of fitted repositories for an array of dates."""
    days = fitted.withColumn("forecast_date", F.explode(dates))
    x = F.datediff("forecast_date", "first_day")
    weekly = F.coalesce(F.try_element_at("weekly", F.dayofweek("forecast_date")), F.lit(0.0))
    yearly = F.coalesce(F.try_element_at("yearly", F.month("forecast_date")), F.lit(0.0))
    yhat = F.col("intercept") + F.col("slope") * x + weekly + yearly
    half = Z_95 * F.col("sigma")
    return days.withColumn("yhat", yhat).select(
        "repository",
        "forecast_date",
        whole_count(F.col("yhat")).alias("predicted_events"),
        whole_count(F.col("yhat") - half).alias("lower_bound"),
        whole_count(F.col("yhat") + half).alias("upper_bound"),
        F.lit(MODEL_TYPE).alias("model_type"),
        F.lit(as_datetime(training_date).date()).alias("training_date"),
    )


def backtest(
    events: DataFrame, as_of: AsOf, holdout: int = 7, repos=None, yearly: bool | str = "auto"
) -> DataFrame:
    """Fit without the last ``holdout`` days before ``as_of`` and compare, for every repository
    with earlier days: the hold-out days that had events, their mean absolute error and the
    share of them inside the bounds (NULL where no day had any). The forecast covers the
    hold-out days themselves, however long a repository was quiet before them."""
    edge = days_before(as_of, holdout).replace(hour=0, minute=0, second=0, microsecond=0)
    first, last = F.lit(edge.date()), F.lit(as_datetime(as_of).date())
    series = training_series(events, repos)
    fitted = fit(series.where(F.col("ds") < first), yearly)
    predicted = _predicted(fitted, F.sequence(first, last), as_of)
    return forecast_errors(predicted, series.where(F.col("ds").between(first, last)))


def forecast_errors(predicted: DataFrame, actual: DataFrame) -> DataFrame:
    """days, mae, coverage of each repository's forecast rows beside its series of counts."""
    actual = actual.withColumnRenamed("ds", "forecast_date")
    both = predicted.join(actual, ["repository", "forecast_date"], "left")
    inside = F.col("y").between(F.col("lower_bound"), F.col("upper_bound"))
    return both.groupBy("repository").agg(
        F.count("y").alias("days"),
        F.avg(F.abs(F.col("y") - F.col("predicted_events"))).alias("mae"),
        F.try_divide(F.count_if(inside), F.count("y")).alias("coverage"),
    )


def forecast_lookup(forecasts: DataFrame, repos=None) -> DataFrame:
    """Predictions by repository and date."""
    return in_repos(forecasts, repos, "repository").select(
        "repository", "forecast_date", F.col("predicted_events").alias("predicted")
    )


def forecast_series(forecasts: DataFrame, repository: str) -> DataFrame:
    """One repository's predictions in order of time."""
    return (
        in_repos(forecasts, [repository], "repository")
        .select(F.col("forecast_date").alias("time"), "predicted_events")
        .orderBy("time")
    )


def _recent_forecasts(forecasts: DataFrame, as_of: AsOf, days: int, repos) -> DataFrame:
    edge = F.lit(days_before(as_of, days).isoformat(sep=" ")).cast("timestamp_ntz")
    return in_repos(forecasts, repos, "repository").where(
        F.col("forecast_date").cast("timestamp_ntz") >= edge
    )


def forecast_vs_actual_long(
    events: DataFrame, forecasts: DataFrame, as_of: AsOf, days: int = 30, repos=None
) -> DataFrame:
    """Actual daily counts over all chosen repositories, and every forecast row,
    as (time, metric, value)."""
    actual = in_repos(last_days(events, as_of, days), repos).groupBy(
        day(F.col("created_at")).alias("time")
    ).agg(F.count("*").cast("double").alias("value"))
    predicted = _recent_forecasts(forecasts, as_of, days, repos).select(
        F.col("forecast_date").alias("time"),
        F.lit("predicted").alias("metric"),
        F.col("predicted_events").alias("value"),
    )
    return actual.withColumn("metric", F.lit("actual")).unionByName(predicted)


def forecast_vs_actual_wide(
    events: DataFrame, forecasts: DataFrame, as_of: AsOf, days: int = 30, repos=None
) -> DataFrame:
    """Actual count, prediction and bounds side by side per repository and day."""
    actual = training_series(last_days(events, as_of, days), repos).select(
        "repository", F.col("ds").alias("time"), F.col("y").alias("actual")
    )
    predicted = _recent_forecasts(forecasts, as_of, days, repos).select(
        "repository",
        F.col("forecast_date").alias("time"),
        F.col("predicted_events").alias("predicted"),
        "lower_bound",
        "upper_bound",
    )
    return actual.join(predicted, ["repository", "time"], "full_outer")
