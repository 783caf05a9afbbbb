"""Reading the given Parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


#: Gives the table of a folder and a name, as a stream for example.
Reader = Callable[[str, str], DataFrame]


def table(source: SparkSession | Reader, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir`` (any path or URI that Spark reads), read by a session or a function."""
    return source.read.parquet(f"{sf_dir}/{name}.parquet") if isinstance(source, SparkSession) else source(sf_dir, name)


def spread(df: DataFrame) -> DataFrame:
    """``df`` for costly work on each row: dealt to all cores where a small input has fewer parts than half of them, and
    as it is, without a shuffle, where it has enough."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def bucketed(df: DataFrame, name: str, keys: list[str], path: str, buckets: int = 64) -> DataFrame:
    """``df`` stored at ``path`` as table ``name`` of the session's catalog, bucketed and sorted by ``keys``: tables with the
    same keys and number of buckets are joined without a shuffle."""
    df.write.mode("overwrite").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return df.sparkSession.table(name)
