"""This library's code for the Python workers of a job."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this library's code to the Python workers, unless they find it anyway: started
    in its folder, with it on PYTHONPATH, or from an archive given to the job."""
    package = Path(__file__).resolve().parent
    root = package.parent
    found = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    context = spark.sparkContext
    if (
        context.applicationId in _SHIPPED
        or not root.is_dir()
        or any(p and Path(p).resolve() == root for p in found)
    ):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="repolume-code-"), "repolume-code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(root))
    context.addPyFile(archive)  # served to the executors by the driver
    _SHIPPED.add(context.applicationId)
