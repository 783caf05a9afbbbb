"""Helpers that several corpus operators share: where intermediate tables go, and how they are cut loose."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separators that word rules know: space, tab, LF, VT, FF, CR.
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: The same as a regular-expression class, for Java and Python alike.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI or path without a trailing slash.

    It is the one that ``spark.checkpoint.dir`` names. Where that is unset, local mode (tests, a laptop) takes a fresh
    local folder; on a cluster it is an error, since executors wouldn't find a folder of the driver's.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = getattr(spark.sparkContext, "_kbspark_shared_dir", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="kbspark-")
        spark.sparkContext._kbspark_shared_dir = own
        spark.sparkContext.setCheckpointDir(own)
    return own


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path below :func:`shared_dir` that nothing has used yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The result no longer depends on what made it: an executor that is lost later costs a re-read, not a
    recomputation. The files stay until the caller clears the shared folder.
    """
    spark, path = df.sparkSession, fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Let Arrow batches of whole texts hold ``rows`` rows at most, unless the session has its own setting: Spark's
    10,000 rows of long texts and their word lists are a few hundred megabytes for each task."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) == 10000:
        spark.conf.set(name, str(rows))


#: What tasks leave in a Python worker for later tasks of their own kind, such as remembered words.
WORKER_CACHES: dict = {}


def give_back() -> None:
    """Return freed memory of this Python worker to the system: Arrow's pool and the C library keep it otherwise,
    and a worker that serves one stage after another would hold the peak of each."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def lean(task):
    """``task`` (batches in, batches out) so that it begins without what other operators left in its worker, and
    gives its own memory back at the end."""

    def run(batches):
        from kbspark.llm import shared  # the worker's own module, not a copy in the closure

        shared.WORKER_CACHES.clear()
        yield from task(batches)
        shared.give_back()

    return run


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it several times in ``body(variable)``.

    Catalyst would otherwise repeat the expression at each use, inside lambdas even once per element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def split_join(rows: DataFrame, keyed: DataFrame, key: str, total: int, count: str = "n", parts: int = 256, floor: int = 100_000) -> DataFrame:
    """``rows`` inner-joined on ``key`` with ``keyed``, which has one slim row a key and the number of its ``rows`` in
    ``count``, so that no task gets all rows of a hot key: a key with more than ``total / parts`` of the ``total`` rows
    goes to all tasks by broadcast, and there are fewer than ``parts`` of them; the others are shuffled. Keys of up to
    ``floor`` rows, a few megabytes, are never hot, and where none is hot it is a plain join."""
    limit = max(total // parts, floor)
    hot = F.col(count) > F.lit(limit)
    if total <= limit or keyed.filter(hot).isEmpty():
        return rows.join(keyed, key)
    some = F.broadcast(keyed.filter(hot))
    rest = rows.join(some.select(key), key, "left_anti").join(keyed.filter(~hot), key)
    return rows.join(some, key).unionByName(rest)


def local_path(uri: str) -> str | None:
    """``uri`` as a plain path if it is one of the local (or mounted) file system, else None."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def file_system(uri: str):
    """(pyarrow file system, path in it) for any URI that Arrow knows: file, hdfs, s3, gs, abfs."""
    from pyarrow import fs

    path = local_path(uri)
    return (fs.LocalFileSystem(), path) if path else fs.FileSystem.from_uri(uri)


def parent_made(system, path: str) -> None:
    system.create_dir(os.path.dirname(path), recursive=True)
