"""The alert limits: one row, kept as a JSON file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolume.functions.timecols import AsOf, as_datetime

# The limits used where none are stored.
DEFAULTS = {
    "events_per_day": 100.0,
    "issues_per_day": 10.0,
    "cfr_threshold": 15.0,
    "mttr_threshold": 72.0,
    "lead_time_threshold": 72.0,
}
# Fixed value: how the stored limits were found.
METHOD = "mean + 3σ (normal distribution)"
_SCHEMA = ", ".join(f"{name} DOUBLE" for name in DEFAULTS)


def default_thresholds(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in DEFAULTS.items()])


def with_defaults(thresholds: DataFrame) -> DataFrame:
    """The five limits, a missing one replaced by its default."""
    return thresholds.select(
        *[
            (F.coalesce(F.col(k), F.lit(v)) if k in thresholds.columns else F.lit(v)).alias(k)
            for k, v in DEFAULTS.items()
        ]
    )


def load_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """The stored limits; a path that does not exist gives the defaults."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path):
        return default_thresholds(spark)
    return with_defaults(spark.read.schema(_SCHEMA).json(path, multiLine=True))


def with_stamp(thresholds: DataFrame, as_of: AsOf, method: str = METHOD) -> DataFrame:
    """Add when and how the limits were found."""
    return thresholds.withColumns(
        {"last_updated": F.lit(as_datetime(as_of).isoformat() + "+00:00"), "method": F.lit(method)}
    )


def save_thresholds(thresholds: DataFrame, path: str) -> None:
    """Store the one row of limits (all its columns), replacing what was there."""
    thresholds.coalesce(1).write.mode("overwrite").json(path)
