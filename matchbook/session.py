"""Session-level helpers: where intermediate tables live and how sizes are checked."""

from __future__ import annotations

import atexit
import pathlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: list[str] = []
_SHIPPED: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a private one on local masters only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if not _LOCAL_DIRS:
        _LOCAL_DIRS.append(tempfile.mkdtemp(prefix="spark-"))
        atexit.register(shutil.rmtree, _LOCAL_DIRS[0], ignore_errors=True)
    return _LOCAL_DIRS[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/matchbook/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a reused intermediate once to the shared folder and read it back.

    Lineage is cut by a real table, so a lost executor re-reads files instead of
    recomputing everything upstream, and several consumers share one computation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    package = pathlib.Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="spark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = shutil.make_archive(f"{folder}/matchbook", "zip", package.parent, package.name)
    sc.addPyFile(archive)
    _SHIPPED.add(app)
