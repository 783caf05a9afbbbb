"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def _top(spark: SparkSession) -> str:
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if top:
        return top.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = getattr(spark.sparkContext, "_kbspark_folder", None)
    if own is None:
        own = spark.sparkContext._kbspark_folder = tempfile.mkdtemp(prefix="kbspark-")
    return own


def shared_folder(spark: SparkSession, name: str) -> str:
    """An unused folder below the one that ``spark.checkpoint.dir`` names. In local mode that may be unset, and a fresh
    local one is taken, the same for the whole session; on a cluster its absence is an error, since executors wouldn't
    find a folder of the driver's."""
    return f"{_top(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into a shared folder and read again, so that what follows uses it without making it
    anew. The files stay until the caller clears the shared folder."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the store that Spark finds it in."""
    system, where = _path(spark, path)
    return system.makeQualified(where).toString()


def make_folder(spark: SparkSession, path: str) -> None:
    system, where = _path(spark, path)
    system.mkdirs(where)


def arrow_files(uri: str) -> tuple[fs.FileSystem, str] | None:
    """(Arrow's file system, path in it) of a URI with a scheme; none for a store that Arrow doesn't know or reach."""
    if uri.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    try:
        return fs.FileSystem.from_uri(uri)
    except (pa.ArrowException, OSError):
        return None


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The session's setting ``name`` is ``value`` meanwhile."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _path(spark, path)
    return system.exists(where)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``; none where it isn't there."""
    system, where = _path(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(where) if f.isDirectory()) if system.exists(where) else []


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete ``path`` with what is in it; nothing is read."""
    system, where = _path(spark, path)
    system.delete(where, True)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a write of Parquet to ``path`` has come to its end."""
    return exists(spark, f"{path}/_SUCCESS")


def once(df_of, spark: SparkSession, path: str) -> DataFrame:
    """The Parquet table at ``path``; where its write hasn't come to an end it is made by ``df_of()`` and written first."""
    if not finished(spark, path):
        df_of().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
