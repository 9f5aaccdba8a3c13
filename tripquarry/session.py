"""Session settings that the library relies on; it works in a session it didn't build as well."""

from __future__ import annotations

import atexit
import functools
import os
import re
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.chunkBase64String.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(name: str = "tripquarry", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where they can't find it by their own path.

    Spark itself sends the archive to the executors; nothing relies on a folder they share.  The
    driver's own path and folder tell only of workers on one machine (``local``): those of a
    cluster always get it.
    """
    context, home = spark.sparkContext, str(ROOT.parent)
    found = home in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.getcwd() == home
    if found and re.fullmatch(r"local(\[.*\])?", context.master) or getattr(context, "_tripquarry_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="tripquarry-")
    atexit.register(shutil.rmtree, folder, True)  # Spark reads it again for each new executor
    archive = Path(folder, "tripquarry.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(ROOT.rglob("*.py")):
            out.write(path, path.relative_to(ROOT.parent))
    context.addPyFile(str(archive))
    context._tripquarry_shipped = True


def shipped(f):
    """``f(spark, ...)``, after the package has gone to the workers."""

    @functools.wraps(f)
    def run(spark: SparkSession, *args):
        ship(spark)
        return f(spark, *args)

    return run
