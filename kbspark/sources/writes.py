"""Writes: replaced chunks and upserted pages, as the tables that follow, and stored tables in buckets of tenants."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.operators.snapshots import replaceable
from kbspark.sources.shared import drop_folder, once

#: Partitions of a stored table; a rewrite touches those of its tenants only.
BUCKETS = 64


def replace_chunks(chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """``chunks`` in which the crawled chunks of every ``(domain, url)`` that ``fresh`` has are replaced by
    ``fresh``. URLs without new chunks keep the old ones; manual, uploaded and answered chunks stay."""
    keys = fresh.select("domain", "url").distinct()
    crawled, others = chunks.filter(replaceable(F.col("source"))), chunks.filter(~replaceable(F.col("source")))
    return crawled.join(keys, ["domain", "url"], "left_anti").unionByName(others).unionByName(fresh, allowMissingColumns=True)


def upsert_pages(stored: DataFrame, crawled: DataFrame, now: Column) -> DataFrame:
    """Page records by ``(domain, url)``: crawled values over stored ones, ``last_changed_at`` only where the
    hash differs, ``has_variants`` carried where the crawl says nothing. One pass, as a full outer join."""
    new = crawled.select(
        "domain", "url", *[F.col(c).alias(f"new_{c}") for c in ("content_hash", "priority", "used_renderer", "has_variants", "chunk_count")], F.lit(True).alias("seen")
    )
    both = stored.join(new, ["domain", "url"], "full_outer")
    differs = F.coalesce("seen", F.lit(False)) & ~F.col("content_hash").eqNullSafe(F.col("new_content_hash"))
    value = lambda c: F.coalesce(f"new_{c}", c).alias(c)
    return both.select(
        "domain", "url", value("content_hash"), value("priority"), value("used_renderer"), value("has_variants"), value("chunk_count"),
        F.when(F.col("seen"), now).otherwise(F.col("last_scraped_at")).alias("last_scraped_at"),
        F.when(differs, now).otherwise(F.col("last_changed_at")).alias("last_changed_at"),
    )


def bucket_of(domain: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(domain), F.lit(buckets)).cast("int")


def of_schema(rows: DataFrame, schema: str) -> DataFrame:
    """``rows`` with the columns of ``schema`` and their types; columns that it lacks are null, others go."""
    fields = rows.sparkSession.createDataFrame([], schema).schema.fields
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def _into(rows: DataFrame, path: str, buckets: int) -> None:
    placed = rows.withColumn("bucket", bucket_of(F.col("domain"), buckets))
    # A hot tenant's bucket is split over tasks, small ones share one.
    spread = placed.hint("rebalance", "bucket")
    spread.write.mode("overwrite").partitionBy("bucket").option("partitionOverwriteMode", "dynamic").parquet(path)


def store_rows(rows: DataFrame, path: str, schema: str, buckets: int = BUCKETS) -> None:
    """Write ``rows`` (with ``domain``) as a stored table of ``schema`` at ``path``: plain Parquet, a partition for each
    bucket of tenants. Buckets that the rows have are replaced, others stay."""
    _into(of_schema(rows, schema), path, buckets)


def stored_rows(spark: SparkSession, path: str, schema: str, domains: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The stored table at ``path``; with ``domains`` the buckets that hold them, and no other file is read."""
    rows = spark.read.schema(f"{schema}, bucket int").parquet(path)
    if domains is not None:
        touched = [r[0] for r in domains.select(bucket_of(F.col("domain"), buckets)).distinct().collect()]
        rows = rows.filter(F.col("bucket").isin(touched))
    return rows.drop("bucket")


def rewrite_stored(
    spark: SparkSession, path: str, schema: str, domains: DataFrame, change: Callable[[DataFrame], DataFrame], result: str, buckets: int = BUCKETS
) -> None:
    """Replace the buckets of ``domains`` (``domain``) in the stored table at ``path`` by ``change`` of their rows.

    The changed rows are written whole to ``result`` before any bucket is touched, and the buckets are then
    overwritten from there. A job that dies before leaves the old table; one that dies later is run again with the same
    ``result``, which is taken as it is, so that ``change`` never sees its own rows. A bucket has old rows or new ones at
    any time, or none for the moment between the deletion and the renaming of its folder, which the rerun mends.
    Buckets that lose all their rows are emptied.
    """
    old = lambda: stored_rows(spark, path, schema, domains, buckets)
    fresh = once(lambda: of_schema(change(old()), schema), spark, result)
    _into(fresh, path, buckets)
    kept = fresh.select(bucket_of(F.col("domain"), buckets).alias("b")).distinct()
    touched = domains.select(bucket_of(F.col("domain"), buckets).alias("b")).distinct()
    for r in touched.join(kept, "b", "left_anti").collect():
        drop_folder(spark, f"{path}/bucket={r[0]}")
