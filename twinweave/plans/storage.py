"""Intermediate tables in the folder that the cluster names in spark.checkpoint.dir: lineage is cut there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
#: Paths by application and scope. A scope belongs to the thread that set it, so sessions and threads don't mix.
_tables: dict[tuple[str, str], list[str]] = {}
_scope: ContextVar[str] = ContextVar("scope", default="")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only where it names none and the session is local."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="twinweave-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, which belongs to the scope in force."""
    path = f"{shared_dir(spark)}/twinweave/{name}-{uuid.uuid4().hex}"
    _tables.setdefault((spark.sparkContext.applicationId, _scope.get()), []).append(path)
    return path


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, and any executor can read it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once in the shared folder and read from there afterwards."""
    return materialise(df, "cut")


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession, scope: str = "") -> None:
    """Delete the intermediate tables of a scope; DataFrames that come from them must no longer be read.

    Results of operators read such tables, so their scope, the unnamed one, is for the caller to release.
    """
    for path in _tables.pop((spark.sparkContext.applicationId, scope), []):
        delete(spark, path)


@contextmanager
def scratch(spark: SparkSession, scope: str) -> Iterator[None]:
    """Tables written inside belong to ``scope``; those that it had before are deleted first."""
    release(spark, scope)
    outer = _scope.set(scope)
    try:
        yield
    finally:
        _scope.reset(outer)


def save(df: DataFrame, path: str, scope: str = "") -> None:
    """Write a result as Parquet and delete the intermediate tables that it came from."""
    df.write.parquet(path)
    release(df.sparkSession, scope)
