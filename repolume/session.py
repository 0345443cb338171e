"""A session for tests and benchmarks; on a cluster the job brings its own."""

from __future__ import annotations

from pyspark.sql import SparkSession


# Sketches, maps and lists are aggregated by hash up to this many keys in a task
# (a sketch is at most 4 KB) and by sorting beyond; the default is 128.
HASHED_KEYS = {"spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "10000"}

# What a cluster job should set when it starts. Shuffles begin with many
# partitions, and AQE joins small ones up to the advisory size and splits
# skewed ones, so the same settings serve a gigabyte and 100 TB.
CLUSTER_SETTINGS = {
    **HASHED_KEYS,
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join even if the next step then needs a shuffle of its own
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def apply_cluster_settings(builder: SparkSession.Builder, input_bytes: int) -> SparkSession.Builder:
    """The builder with ``CLUSTER_SETTINGS``, and shuffles that begin with as many partitions
    as make one of 256 MB if a job shuffles all of its input, 200 at least."""
    for key, value in CLUSTER_SETTINGS.items():
        builder = builder.config(key, value)
    partitions = max(200, -(-input_bytes // (256 << 20)))
    return builder.config(
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(partitions)
    )


def local_session(cores: int | str = "*", app: str = "repolume", **extra: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    for key, value in {**HASHED_KEYS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
