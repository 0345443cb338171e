"""Parquet tables by path: append, export, backup, retention, compaction, sizes.

Facts are partitioned by month (``event_month``, 202401) and, where a stream
writes them, by load under that: a repeated load overwrites its own partitions
only. A table is written in one of the two ways throughout.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repolume.functions.timecols import AsOf, as_datetime, days_before, month_key, time_literal

MONTH = "event_month"
SORT_KEY = ["created_at", "repo_name", "type"]
TARGET_FILE_BYTES = 256 * 1024 * 1024
# Compaction sorts pieces of about this many rows, or bytes in files, each in a task of its own,
# and puts neighbouring pieces together afterwards, in jobs of so many files.
PIECE_ROWS, PIECE_BYTES, FILES_A_JOB = 1_000_000, 64 * 1024 * 1024, 64
# Loads count from 0; compactions take numbers from -1 down, and restored rows whose backup
# was not kept by load have their own.
COMPACTED_LOAD, RESTORED_LOAD = -1, -1_000_000_000
LOAD = "load_id"
# Beside the months: which loads compaction has merged. Spark reads no folder with this sign.
MERGED_LOADS = "_merged_loads"
_MERGED = f"{MONTH} int, {LOAD} bigint, merged_into bigint"
# Beside the buckets of a table of issues: how many there are.
BUCKETS = "_buckets"


def _has_rows(df: DataFrame) -> bool:
    return not df.isEmpty()


def append_events(
    events: DataFrame, path: str, load_id: int | None = None, backfill: bool = False
) -> None:
    """Append event rows, filling ``_inserted_at`` and the month partition, each
    file sorted by time.

    With ``load_id`` the append can be repeated: the load has its own partition
    under each month and a second run replaces it; in months where compaction has
    merged the load, its rows are there already and it is left out. ``backfill``
    first spreads rows by month (splitting big months), for inputs that span many of them.
    """
    rows = events.withColumn(MONTH, month_key(F.col("created_at")))
    if "_inserted_at" not in rows.columns:
        rows = rows.withColumn("_inserted_at", F.current_timestamp())
    if backfill:
        rows = rows.hint("rebalance", MONTH)
    if load_id is None:
        ordered = rows.sortWithinPartitions(MONTH, *SORT_KEY)
        ordered.write.mode("append").partitionBy(MONTH).parquet(path)
        return
    merged = merged_months(events.sparkSession, path, load_id)
    if merged:
        rows = rows.where(~F.col(MONTH).isin(merged))
    replace_partitions(
        rows.withColumn(LOAD, F.lit(load_id).cast("bigint")).sortWithinPartitions(
            MONTH, LOAD, *SORT_KEY
        ),
        path,
    )


def partitions_of(table: DataFrame) -> list[str]:
    """The partition columns that a table of this module has."""
    return [c for c in (MONTH, LOAD) if c in table.columns]


def replace_partitions(rows: DataFrame, path: str) -> None:
    """Write rows over the partitions that they belong to, and no other."""
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions_of(rows))
        .parquet(path)
    )


def merged_loads(spark: SparkSession, path: str) -> DataFrame:
    """Month, load and the load that compaction has merged it into, of the table at ``path``."""
    if MERGED_LOADS not in folders(spark, path):
        return spark.createDataFrame([], _MERGED)
    return spark.read.schema(_MERGED).parquet(f"{path}/{MERGED_LOADS}").distinct()


def merged_months(spark: SparkSession, path: str, load_id: int) -> list[int]:
    """The months in which compaction has merged a load."""
    if MERGED_LOADS not in folders(spark, path):
        return []
    merged = merged_loads(spark, path)
    return [r[0] for r in merged.where(F.col(LOAD) == load_id).select(MONTH).distinct().collect()]


def _list_merged(merged: DataFrame, path: str, mode: str) -> None:
    """Add to the list of merged loads of the table at ``path``; nothing, if there are none."""
    if _has_rows(merged):
        merged.coalesce(1).write.mode(mode).parquet(f"{path}/{MERGED_LOADS}")


def append_rows(rows: DataFrame, path: str) -> None:
    """Append to a table without partitions (issues, forecasts, predictions)."""
    rows.write.mode("append").parquet(path)


def export_table(
    table: DataFrame, target: str, format: str = "parquet", **options: str
) -> bool:
    """Write a whole table over ``target``; an empty table is skipped and leaves
    the target as it was. Any sink format of the session works, JDBC included."""
    if not _has_rows(table):
        return False
    table.write.format(format).options(**options).mode("overwrite").save(target)
    return True


def append_forecasts(rows: DataFrame, path: str) -> None:
    """Append forecast rows, filling ``created_at``."""
    append_rows(rows.withColumn("created_at", F.current_timestamp()), path)


def store_issues(issues: DataFrame, path: str, fetch_id: int, buckets: int = 64) -> None:
    """Put fetched issues into the issue table, one row per id: that of the latest fetch.

    The table is kept in ``buckets`` partitions by a hash of the id; only those that a fetch
    touches are read and rewritten. Their number stays with the table, and another one is
    refused, as it would part the rows of an id. A repeated fetch replaces its own rows, an
    earlier one that comes late replaces none. ``sources.issues`` keeps fetches beside the
    table instead, for fetches that are small beside it.
    """
    spark = issues.sparkSession
    _keep_buckets(spark, path, buckets)
    bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")
    rows = issues.withColumn("fetch_id", F.lit(fetch_id).cast("bigint")).withColumn(
        "bucket", bucket
    )
    if table_exists(spark, path):
        stored = spark.read.parquet(path)
        touched = rows.select("bucket").distinct()
        rows = rows.unionByName(stored.join(touched, "bucket", "left_semi").select(*rows.columns))
    others = [c for c in issues.columns if c != "id"]
    (
        newest_rows(rows, ["bucket", "id"], "fetch_id", others)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket")
        .parquet(path)
    )


def newest_rows(rows: DataFrame, keys: list[str], fetch: str, others: list[str]) -> DataFrame:
    """Of each key the row of the latest fetch; of several there, the first in the order of
    ``others`` as JSON.

    Rows are shuffled as they are. Their JSON, as long as they are, is made after the shuffle,
    of rows that share key and fetch with another alone.
    """
    latest = Window.partitionBy(*keys).orderBy(F.desc(fetch))
    rows = rows.withColumn("_rank", F.rank().over(latest)).where("_rank = 1")
    rows = rows.withColumn("_many", F.count("*").over(Window.partitionBy(*keys)))
    tied = F.when(F.col("_many") > 1, F.to_json(F.struct(*others)))
    first = Window.partitionBy(*keys).orderBy(tied)
    rows = rows.withColumn("_rank", F.row_number().over(first)).where("_rank = 1")
    return rows.drop("_rank", "_many")


def _keep_buckets(spark: SparkSession, path: str, buckets: int) -> None:
    """Note the number of buckets of a new table; refuse another one for a table that is there."""
    noted = f"{path}/{BUCKETS}"
    if BUCKETS in folders(spark, path):
        held = spark.read.schema("buckets int").parquet(noted).agg(F.max("buckets")).first()[0]
    else:
        held = None
    if held is None and table_exists(spark, path):
        held = spark.read.parquet(path).agg(F.max("bucket")).first()[0] + 1
        if held <= buckets:  # not every bucket need have rows
            held = buckets
    if held is not None and held != buckets:
        raise ValueError(f"{path} is kept in {held} buckets, not {buckets}")
    if BUCKETS not in folders(spark, path):
        spark.createDataFrame([(buckets,)], "buckets int").write.mode("overwrite").parquet(noted)


def backup_table(table: DataFrame, folder: str, as_of: AsOf, path: str | None = None) -> str:
    """Copy a table, in its partitions, to a folder named by date and time; return its path.

    ``path`` is where the table is: of a table kept by load, the list of the loads that
    compaction has merged goes along, so that a load repeated after a restore doubles nothing.
    """
    spark = table.sparkSession
    if LOAD in table.columns and path is None:
        raise ValueError("a table kept by load is backed up with its path")
    target = f"{folder.rstrip('/')}/{as_datetime(as_of):%Y%m%d_%H%M%S}"
    if table_exists(spark, target):
        raise FileExistsError(target)
    if path is not None:
        _list_merged(merged_loads(spark, path), target, "overwrite")
    table.write.mode("append").partitionBy(*partitions_of(table)).parquet(target)
    return target


def restore_table(spark: SparkSession, backup: str, path: str) -> None:
    """Put a backup's rows into the table at ``path``, in the layout of that table, or of the
    backup if there is none.

    A table kept by load gets the backup's loads back: they replace loads of the same number,
    so restoring twice, or repeating a load after it, doubles nothing. Rows of a backup
    without loads get a load number of their own. A table without loads is appended to.

    Loads that compaction has merged, in the backup or in the table, stay merged: the backup's
    list joins that of the table, loads merged in the one and single in the other count once,
    and where the table's compaction has merged loads that the backup's merged rows lack,
    nothing is restored and an error says so.
    """
    rows = spark.read.parquet(backup)
    by_load = LOAD in (spark.read.parquet(path) if table_exists(spark, path) else rows).columns
    if by_load and LOAD not in rows.columns:
        rows = rows.withColumn(LOAD, F.lit(RESTORED_LOAD).cast("bigint"))
    if by_load:
        here, there = merged_loads(spark, path), merged_loads(spark, backup)
        replaced = rows.select(MONTH, F.col(LOAD).alias("merged_into")).distinct()
        lost = here.join(replaced, [MONTH, "merged_into"], "left_semi").join(
            there, [MONTH, LOAD, "merged_into"], "left_anti"
        )
        if _has_rows(lost):
            raise ValueError(f"{path} has merged loads that {backup} does not hold")
        single = rows.join(here.select(MONTH, LOAD).distinct(), [MONTH, LOAD], "left_anti")
        _list_merged(there.join(here, [MONTH, LOAD, "merged_into"], "left_anti"), path, "append")
        replace_partitions(single.select(*rows.columns), path)
        _remove_merged(spark, path)
        return
    rows = rows.drop(LOAD)
    rows.write.mode("append").partitionBy(*partitions_of(rows)).parquet(path)


def _write_sorted(
    rows: DataFrame, own: str, key: list[str], size: int, file_bytes: int, by: tuple = ()
) -> bool:
    """Write rows to ``own``/files, one folder for each value of the partition columns ``by``
    (first in ``key``), in files of about ``file_bytes``, each a range of ``key`` and in its
    order; tell whether each file was sorted as one piece. ``size`` is what the rows take in
    files now.

    A task sorts one piece of ``PIECE_ROWS`` or ``PIECE_BYTES``, whatever the size of a file.
    Files of several pieces are then put together piece after piece, without sorting again.
    """
    spark = rows.sparkSession
    files = max(1, -(-size // file_bytes))
    pieces = max(files, -(-rows.count() // PIECE_ROWS), -(-size // PIECE_BYTES))
    whole = pieces == files  # each piece is a file
    writer = rows.repartitionByRange(pieces, *key).sortWithinPartitions(*key).write
    writer.partitionBy(*by).parquet(f"{own}/{'files' if whole else 'pieces'}")
    if whole:
        return True
    schema = rows.drop(*by).schema
    for folder, found in _file_groups(spark, f"{own}/pieces", file_bytes):
        for at in range(0, len(found), FILES_A_JOB):
            parts = [
                reduce(DataFrame.unionByName, [spark.read.schema(schema).parquet(f) for f in group])
                .coalesce(1)
                for group in found[at : at + FILES_A_JOB]
            ]
            reduce(DataFrame.unionByName, parts).write.mode("append").parquet(
                f"{own}/files/{folder}".rstrip("/")
            )
    delete_folder(spark, f"{own}/pieces")
    return False


def _file_groups(
    spark: SparkSession, path: str, file_bytes: int
) -> list[tuple[str, list[list[str]]]]:
    """For each folder under ``path``, by its name there, the files in order of their names,
    in groups of about ``file_bytes``."""
    files, hadoop_path = _file_system(spark, path)
    out = []

    def walk(folder: str, at) -> None:
        groups, total = [], 0
        for status in sorted(
            files.listStatus(at), key=lambda x: (len(x.getPath().getName()), x.getPath().getName())
        ):
            name = status.getPath().getName()
            if name.startswith(("_", ".")):
                continue
            if status.isDirectory():
                walk(f"{folder}/{name}".lstrip("/"), status.getPath())
                continue
            if not groups or total + status.getLen() // 2 > file_bytes:
                groups, total = [*groups, []], 0
            groups[-1].append(status.getPath().toString())
            total += status.getLen()
        if groups:
            out.append((folder, groups))

    walk("", hadoop_path)
    return out


def _move_folder(spark: SparkSession, source: str, target: str) -> None:
    """Put a folder that was written whole in the place of another, or of none."""
    files, hadoop_path = _file_system(spark, source)
    place = spark._jvm.org.apache.hadoop.fs.Path(target)
    files.delete(place, True)
    files.mkdirs(place.getParent())
    if not files.rename(hadoop_path, place):
        raise OSError(f"{source} could not be moved to {target}")


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def delete_folder(spark: SparkSession, path: str) -> None:
    files, hadoop_path = _file_system(spark, path)
    files.delete(hadoop_path, True)


def file_exists(spark: SparkSession, path: str) -> bool:
    files, hadoop_path = _file_system(spark, path)
    return files.exists(hadoop_path)


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written at ``path``; an empty folder holds none."""
    return any(not name.startswith(("_", ".")) for name in folders(spark, path))


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly under a path, which need not exist."""
    files, hadoop_path = _file_system(spark, path)
    if not files.exists(hadoop_path):
        return []
    return sorted(
        status.getPath().getName()
        for status in files.listStatus(hadoop_path)
        if status.isDirectory()
    )


def remove_expired_backups(
    spark: SparkSession, folder: str, as_of: AsOf, days: int = 30
) -> list[str]:
    """Delete the backups older than ``days``; return their names."""
    cut = f"{days_before(as_of, days):%Y%m%d_%H%M%S}"
    expired = [name for name in folders(spark, folder) if name < cut]
    for name in expired:
        delete_folder(spark, f"{folder}/{name}")
    return expired


def delete_rows(table: DataFrame, condition) -> DataFrame:
    """The rows that stay when those matching ``condition`` are deleted; a row
    for which the condition is NULL stays."""
    return table.where(~F.coalesce(condition, F.lit(False)))


def retention_keep(events: DataFrame, as_of: AsOf, days: int = 90) -> DataFrame:
    """The rows within the retention period."""
    cut = time_literal(events, "created_at", days_before(as_of, days))
    return delete_rows(events, F.col("created_at") < cut)


def apply_retention(spark: SparkSession, path: str, as_of: AsOf, days: int = 90) -> None:
    """Delete expired rows in place.

    Months before the cut are dropped by path, unread; only the month the cut
    falls in is rewritten.
    """
    table = spark.read.parquet(path)
    partitions = partitions_of(table)
    cut = days_before(as_of, days)
    cut_month = cut.year * 100 + cut.month
    on_cut = table.where(F.col(MONTH) == cut_month)
    in_time = F.col("created_at") >= time_literal(table, "created_at", cut)
    parts = on_cut.groupBy(*partitions).agg(
        F.coalesce(F.max(in_time), F.lit(True)).alias("keep"),
        F.coalesce(F.min(in_time), F.lit(True)).alias("whole"),
    ).collect()

    if any(r["keep"] and not r["whole"] for r in parts):
        replace_partitions(retention_keep(on_cut, as_of, days), path)
    for r in parts:
        if not r["keep"]:
            delete_folder(spark, _partition_path(path, partitions, r))
    for name in folders(spark, path):
        key, _, month = name.partition("=")
        # rows without a time are in a month that is no number, and stay
        if key == MONTH and month.isdigit() and int(month) < cut_month:
            delete_folder(spark, f"{path}/{name}")


def _partition_path(path: str, partitions: list[str], row) -> str:
    none = "__HIVE_DEFAULT_PARTITION__"
    return "/".join([path] + [f"{p}={none if row[p] is None else row[p]}" for p in partitions])


def in_partitions(table: DataFrame, among: list[tuple]) -> DataFrame:
    """The rows of some partitions, each given as its values; by a flat list of loads for each
    month, by which Spark prunes the folders."""
    partitions = partitions_of(table)
    by_month: dict = {}
    for month, *load in among:
        by_month.setdefault(month, []).extend(load)
    chosen = F.lit(False)
    for month, loads in by_month.items():
        own = F.col(MONTH).eqNullSafe(F.lit(month))
        chosen |= own & F.col(LOAD).isin(loads) if LOAD in partitions else own
    return table.where(chosen)


def delete_in_place(
    spark: SparkSession, path: str, condition, among: list[tuple] | None = None
) -> None:
    """Delete the rows that match ``condition`` from the table at ``path``.

    Only partitions that hold such rows are rewritten, and those that hold no other row are
    removed; rows for which the condition is NULL stay. It can be repeated. ``among`` names
    the only partitions that may hold such rows, if that is known.
    """
    table = spark.read.parquet(path)
    partitions = partitions_of(table)
    if among is not None:
        table = in_partitions(table, among)
    matches = F.coalesce(condition, F.lit(False))
    touched = (
        table.groupBy(*partitions)
        .agg(F.max(matches).alias("some"), F.min(matches).alias("every"))
        .where("some")
        .collect()
    )  # one row per partition
    part = [r for r in touched if not r["every"]]
    for month in sorted({r[MONTH] for r in part}, key=lambda m: (m is None, m or 0)):
        own = [tuple(r[p] for p in partitions) for r in part if r[MONTH] == month]
        replace_partitions(delete_rows(in_partitions(table, own), condition), path)
    for r in touched:
        if r["every"]:
            delete_folder(spark, _partition_path(path, partitions, r))


def readable_size(size: Column) -> Column:
    """Bytes as text in the largest binary unit of which there is one, with two decimals."""
    text = F.lit(None).cast("string")
    for power, unit in enumerate(("B", "KiB", "MiB", "GiB", "TiB", "PiB")):
        scaled = F.format_string("%.2f " + unit, size / F.lit(float(1 << 10 * power)))
        text = scaled if power == 0 else F.when(size >= 1 << 10 * power, scaled).otherwise(text)
    return text


def table_rows(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Rows of each Parquet table, counted from the footers of its files."""
    parts = [
        spark.read.parquet(path).agg(F.lit(table).alias("table"), F.count("*").alias("rows"))
        for table, path in paths.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def table_sizes(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Bytes and files of each table, from the file listing alone: the contents
    column of the file source is not asked for, so no file is opened."""
    parts = [
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .agg(
            F.lit(table).alias("table"),
            F.sum("length").alias("bytes"),
            F.count("*").alias("files"),
        )
        for table, path in paths.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def crowded_months(
    spark: SparkSession, path: str, file_bytes: int = TARGET_FILE_BYTES, spare_files: int = 4
) -> list[tuple[int, int]]:
    """(month, files it needs) of the months with more than ``spare_files`` files beyond that,
    from the file listing alone."""
    month = F.regexp_extract("path", rf"/{MONTH}=(\d+)/", 1).try_cast("int")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    needed = F.ceil(F.sum("length") / F.lit(file_bytes))
    rows = (
        files.where(~F.contains("path", F.lit(f"/{MERGED_LOADS}/")))
        .groupBy(month.alias("month"))
        .agg(F.count("*").alias("files"), needed.alias("needed"))
        .where((F.col("files") > F.col("needed") + spare_files) & F.col("month").isNotNull())
        .orderBy("month")
        .collect()
    )  # one row per month
    return [(r["month"], int(r["needed"])) for r in rows]


def compact_in_place(
    spark: SparkSession,
    path: str,
    staging: str,
    file_bytes: int = TARGET_FILE_BYTES,
    spare_files: int = 4,
) -> list[int]:
    """Merge the many small files of the months that have them; return these months.

    A month is rewritten to ``staging``, then takes the place of its loads under a load number
    of its own. The merged loads and that number are listed beside the table first, so a load
    that is repeated later is left out and nothing doubles. A crash in between is mended by the
    next call: it removes the listed loads whose merged rows are in place, and leaves the
    others. Not to be run beside a load of the same months.
    """
    table = spark.read.parquet(path)
    partitions = partitions_of(table)
    _remove_merged(spark, path)
    done = []
    for month, _ in crowded_months(spark, path, file_bytes, spare_files):
        rows = spark.read.parquet(path).where(F.col(MONTH) == month)
        loads, into = [], COMPACTED_LOAD
        if LOAD in partitions:
            loads = [r[0] for r in rows.select(LOAD).distinct().collect()]
            merged_before = [n for n in loads if RESTORED_LOAD < n < 0]
            into = min(merged_before, default=0) - 1
            rows = rows.withColumn(LOAD, F.lit(into).cast("bigint"))
        own = f"{staging.rstrip('/')}/{month}"
        delete_folder(spark, own)
        size = table_sizes(spark, {"events": f"{path}/{MONTH}={month}"}).first()["bytes"]
        whole = _write_sorted(rows.drop(MONTH, LOAD), own, SORT_KEY, size, file_bytes)
        if loads:
            listed = spark.createDataFrame([(month, n, into) for n in loads], _MERGED)
            _list_merged(listed, path, "append")
        if whole:
            merged = spark.read.parquet(f"{own}/files").withColumn(MONTH, F.lit(month))
            if loads:
                merged = merged.withColumn(LOAD, F.lit(into).cast("bigint"))
            replace_partitions(merged, path)
        else:
            # written through Spark, files of many pieces would be sorted whole once more
            place = f"{path}/{MONTH}={month}" + (f"/{LOAD}={into}" if loads else "")
            _move_folder(spark, f"{own}/files", place)
        _remove_merged(spark, path, month)
        delete_folder(spark, own)
        done.append(month)
    return done


def _remove_merged(spark: SparkSession, path: str, month: int | None = None) -> None:
    """Remove the folders of merged loads, where the merged rows are in their place; in one
    month, or in all that have merged loads. Each month's folders are listed once."""
    if MERGED_LOADS not in folders(spark, path):
        return
    merged = merged_loads(spark, path)
    if month is not None:
        merged = merged.where(F.col(MONTH) == month)
    by_month: dict[int, list] = {}
    for row in merged.collect():  # one row per load and month that was merged
        by_month.setdefault(row[0], []).append(row)
    for number, rows in by_month.items():
        folder = f"{path}/{MONTH}={number}"
        there = set(folders(spark, folder))
        for row in rows:
            if {f"{LOAD}={row[1]}", f"{LOAD}={row[2]}"} <= there:
                delete_folder(spark, f"{folder}/{LOAD}={row[1]}")


def compact_events(
    spark: SparkSession, path: str, target: str, file_bytes: int = TARGET_FILE_BYTES
) -> None:
    """Rewrite the event table to ``target`` in files of about ``file_bytes``,
    sorted so that a time range touches few of them.

    Ranges of the sort key are used instead of one task per month, so a month
    of any size is split. Where the table is kept by load, the merged rows get
    a load number of their own, and later loads can be added to the target; the target lists
    the merged loads, those that were merged before included, and leaves them out when they
    are repeated there.
    """
    table = spark.read.parquet(path)
    partitions = [MONTH]
    if table_exists(spark, target):
        raise FileExistsError(target)
    if LOAD in table.columns:
        loads = table.select(MONTH, LOAD).distinct()
        listed = loads.unionByName(merged_loads(spark, path).select(MONTH, LOAD)).distinct()
        listed = listed.where(F.col(LOAD) != COMPACTED_LOAD).withColumn(
            "merged_into", F.lit(COMPACTED_LOAD).cast("bigint")
        )
        _list_merged(listed, target, "overwrite")
        table = table.withColumn(LOAD, F.lit(COMPACTED_LOAD).cast("bigint"))
        partitions.append(LOAD)
    total = table_sizes(spark, {"events": path}).first()["bytes"]
    staging = f"{target}/_staging"  # no reader looks there
    delete_folder(spark, staging)
    _write_sorted(table, staging, [MONTH, *SORT_KEY], total, file_bytes, tuple(partitions))
    for name in folders(spark, f"{staging}/files"):
        _move_folder(spark, f"{staging}/files/{name}", f"{target}/{name}")
    delete_folder(spark, staging)
