"""Snapshots of a knowledge base: create, prune, list, restore."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.schemas import PRESERVED_SOURCES

KEEP = 10


def replaceable(source: Column) -> Column:
    """Chunks that crawls own; a missing source counts as crawled."""
    return source.isNull() | ~source.isin(*PRESERVED_SOURCES)


def create_snapshot(chunks: DataFrame, mode: Column, created_at: Column, urls: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(snapshots, archived chunks) of every domain that has something to archive, or of given ``(domain, url)``s.

    ``affected_urls`` are the given URLs, else those of the archived chunks. Snapshot ids depend on domain,
    mode and time, so a repeated run makes the same ids.
    """
    old = chunks.filter(replaceable(F.col("source")))
    if urls is not None:
        old = old.join(urls.select("domain", "url").distinct(), ["domain", "url"], "left_semi")
    stamped = old.withColumns({"mode": mode, "created_at": created_at})
    snapshot_id = F.sha2(F.concat_ws("|", "domain", "mode", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS")), 256)
    archived = stamped.withColumn("snapshot_id", snapshot_id)
    made = archived.groupBy("snapshot_id", "domain", "mode", "created_at").agg(
        F.count("*").alias("chunk_count"), F.count_distinct("url").alias("page_count"), F.array_sort(F.collect_set("url")).alias("affected_urls")
    )
    if urls is not None:
        given = urls.groupBy("domain").agg(F.array_sort(F.collect_set("url")).alias("affected_urls"))
        made = made.drop("affected_urls").join(given, "domain")
    return made, archived.drop("mode")


def prune_snapshots(snapshots: DataFrame, archived: DataFrame, keep: int = KEEP) -> tuple[DataFrame, DataFrame]:
    """The newest ``keep`` snapshots of each domain, and the archived chunks that belong to them."""
    newest = Window.partitionBy("domain").orderBy(F.col("created_at").desc(), "snapshot_id")
    kept = snapshots.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= keep).drop("rn")
    return kept, archived.join(kept.select("snapshot_id"), "snapshot_id", "left_semi")


def restore_snapshot(chunks: DataFrame, archived: DataFrame, snapshot_id: Column, url: Column | None = None) -> DataFrame:
    """``chunks`` with the crawled chunks of the archived URLs replaced by the archived ones."""
    back = archived.filter(F.col("snapshot_id") == snapshot_id)
    if url is not None:
        back = back.filter(F.col("url") == url)
    back = back.drop("snapshot_id")
    touched = back.select("domain", "url", F.lit(True).alias("__touched")).distinct()
    marked = chunks.join(touched, ["domain", "url"], "left")
    stay = marked.filter(F.col("__touched").isNull() | ~replaceable(F.col("source"))).drop("__touched")
    return stay.unionByName(back, allowMissingColumns=True)


def list_snapshots(snapshots: DataFrame) -> DataFrame:
    """Snapshots, newest first within their domain (``position`` from 1)."""
    return snapshots.withColumn("position", F.row_number().over(Window.partitionBy("domain").orderBy(F.col("created_at").desc(), "snapshot_id")))


def snapshot_chunks(archived: DataFrame, snapshot_id: Column, url: Column | None = None) -> DataFrame:
    """The archived chunks of a snapshot by index, without embeddings."""
    found = archived.filter(F.col("snapshot_id") == snapshot_id)
    if url is not None:
        found = found.filter(F.col("url") == url)
    return found.drop("embedding").orderBy("chunk_index", "url")
