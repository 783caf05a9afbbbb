"""A whole refresh as one job that can be resumed: diff, chunks, vectors, snapshot, replaced chunks, pages, summary."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.functions.text import CrawlSettings
from kbspark.operators.chunks import chunk_id, embedded_once
from kbspark.operators.crawl import diff_pages, page_hash_updates, refresh_summary
from kbspark.operators.snapshots import create_snapshot
from kbspark.plans.build import refresh_chunks
from kbspark.schemas import CHUNKS, PAGES, SNAPSHOTS
from kbspark.sources.archive import ChunkArchive
from kbspark.sources.shared import once
from kbspark.sources.writes import BUCKETS, of_schema, replace_chunks, rewrite_stored, store_rows, stored_rows, upsert_pages


@dataclass
class KnowledgeBase:
    """Where the stored tables lie: chunks and pages in buckets of tenants, snapshots, the chunk archive and vectors."""

    path: str
    buckets: int = BUCKETS

    def at(self, name: str) -> str:
        return f"{self.path.rstrip('/')}/{name}"

    def create(self, chunks: DataFrame, pages: DataFrame) -> None:
        store_rows(chunks, self.at("chunks"), CHUNKS, self.buckets)
        store_rows(pages, self.at("pages"), PAGES, self.buckets)
        chunks.sparkSession.createDataFrame([], SNAPSHOTS).write.mode("ignore").parquet(self.at("snapshots"))

    def chunks(self, spark: SparkSession, domains: DataFrame | None = None) -> DataFrame:
        return stored_rows(spark, self.at("chunks"), CHUNKS, domains, self.buckets)

    def pages(self, spark: SparkSession, domains: DataFrame | None = None) -> DataFrame:
        return stored_rows(spark, self.at("pages"), PAGES, domains, self.buckets)

    def snapshots(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(SNAPSHOTS).parquet(self.at("snapshots"))

    def archive(self, spark: SparkSession) -> ChunkArchive:
        return ChunkArchive(spark, self.at("archive"), CHUNKS, self.buckets)


def run_steps(spark: SparkSession, folder: str, steps: list[tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]]) -> dict[str, DataFrame]:
    """The result of each step, in order. A step's result is a Parquet table in ``folder``; one that is there whole is
    finished and isn't run again, so a job that died goes on where it was."""
    done: dict[str, DataFrame] = {}
    for name, step in steps:
        done[name] = once(lambda step=step: step(done), spark, f"{folder.rstrip('/')}/{name}")
    return done


def refresh_job(
    base: KnowledgeBase, crawled: DataFrame, embed: Callable[[list[str]], np.ndarray], now: Column, folder: str, seconds: Column | None = None, settings: CrawlSettings = CrawlSettings()
) -> DataFrame:
    """Refresh the stored sites of ``crawled`` (``domain, page_seq, url, text, content_hash, priority``) and return a
    summary for each. ``folder`` is the job's own: called again with it, the job goes on after its last finished step.

    What will be replaced is archived before anything is changed, then chunks are replaced, then pages updated. Steps
    that change a stored table do so from a result that is saved first, and give the same if they are repeated.
    ``now`` must not depend on when a step runs. ``seconds``: how long the crawl took, for the summary.
    """
    spark, folder = crawled.sparkSession, folder.rstrip("/")
    domains = crawled.select("domain").distinct()
    told = lambda name: spark.createDataFrame([(name,)], "step string")

    def affected(done: dict[str, DataFrame]) -> DataFrame:
        return done["chunks"].select("domain", "url").distinct()

    def vectors(done: dict[str, DataFrame]) -> DataFrame:
        rows = embedded_once(done["chunks"], base.at("vectors"), embed)
        whole = rows.withColumns({"source": F.lit("scraped"), "created_at": now, "chunk_id": chunk_id(F.col("domain"), F.col("url"), F.col("content"))})
        return of_schema(whole, CHUNKS)

    def archived(done: dict[str, DataFrame]) -> DataFrame:
        stored = base.chunks(spark, domains).withColumn("_made", F.col("created_at"))
        made, old = create_snapshot(stored, F.lit("rescrape"), now, affected(done))
        made = once(lambda: made, spark, f"{folder}/_snapshots")
        # Chunks keep their own time, so that unchanged ones are the same rows in every snapshot.
        base.archive(spark).add(old.withColumn("created_at", F.col("_made")).drop("_made"))
        known = base.snapshots(spark).select("snapshot_id")
        of_schema(made.join(known, "snapshot_id", "left_anti"), SNAPSHOTS).write.mode("append").parquet(base.at("snapshots"))
        return told("archived")

    def replaced(done: dict[str, DataFrame]) -> DataFrame:
        fresh = done["vectors"]
        rewrite_stored(spark, base.at("chunks"), CHUNKS, fresh.select("domain").distinct(), lambda old: replace_chunks(old, fresh), f"{folder}/_chunks", base.buckets)
        return told("replaced")

    def upserted(done: dict[str, DataFrame]) -> DataFrame:
        diffed = done["diff"]
        written = page_hash_updates(diffed).select("domain", "url_key", "page_seq", F.lit(True).alias("written"))
        counts = done["chunks"].groupBy("domain", "url").agg(F.count("*").cast("int").alias("chunk_count"))
        rows = diffed.join(written, ["domain", "url_key", "page_seq"], "left").join(counts, ["domain", "url"], "left")
        seen = rows.select(
            "domain", F.coalesce("stored_url", "url").alias("url"), F.when(F.col("written"), F.col("content_hash")).otherwise(F.col("stored_hash")).alias("content_hash"),
            "priority", F.lit(None).cast("boolean").alias("used_renderer"), "has_variants", F.when(F.col("change") == "changed", F.coalesce("chunk_count", F.lit(0))).alias("chunk_count"),
        )
        rewrite_stored(spark, base.at("pages"), PAGES, domains, lambda old: upsert_pages(old, seen.dropDuplicates(["domain", "url"]), now), f"{folder}/_pages", base.buckets)
        return told("upserted")

    def summary(done: dict[str, DataFrame]) -> DataFrame:
        return refresh_summary(done["diff"], done["chunks"], F.lit(0.0) if seconds is None else seconds)

    steps = [
        ("diff", lambda done: diff_pages(crawled, base.pages(spark, domains))), ("chunks", lambda done: refresh_chunks(done["diff"], crawled, settings)),
        ("vectors", vectors), ("archived", archived), ("replaced", replaced), ("upserted", upserted), ("summary", summary),
    ]
    return run_steps(spark, folder, steps)["summary"]


__all__ = ["KnowledgeBase", "run_steps", "refresh_job"]
