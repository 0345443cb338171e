"""Where jobs put the tables they write between steps.

On a cluster this is the shared folder named by ``spark.checkpoint.dir``; a
folder on one machine would not be seen by the executors.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    folder = spark.conf.get(SETTING, None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="repolume-"))
    return context.getCheckpointDir()


_MADE: dict[str, list[str]] = {}


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own for one run of one job. ``remove_written`` removes it."""
    path = f"{shared_folder(spark).rstrip('/')}/repolume/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def remove_written(spark: SparkSession) -> int:
    """Remove everything this application has written under paths of ``new_path``, once its
    results are read; return the number of paths."""
    paths = _MADE.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.delete(hadoop_path, True)
    return len(paths)
