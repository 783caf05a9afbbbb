"""Streaming jobs run over the given tables as streams, to the end of what is there."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from kbspark.functions.html import page_column
from kbspark.operators.chunks import hashing_embedder
from kbspark.plans import chat_queries, kb_queries, views
from kbspark.plans.build import stored_chunks
from kbspark.sources.pages import crawled_pages
from kbspark.sources.shared import saved, shared_folder
from kbspark.sources.tables import Reader, spread, table
from kbspark.streaming import build, jobs

QUERIES: dict = {}
ORACLES: dict = {}
LIMIT = 30
_STORE = "spark.sql.streaming.stateStore.providerClass"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def streamed(spark: SparkSession) -> Reader:
    """Reads tables as streams, so that the views' rules apply to streams too."""

    def read(sf_dir: str, name: str) -> DataFrame:
        path = f"{sf_dir}/{name}.parquet"
        # As a pattern, since a stream's plain path must be a folder and a small table may be one file.
        return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")

    return read


def collected(spark: SparkSession, rows: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All micro-batches of a stream as a table, with their ``batch``."""
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = shared_folder(spark, name)
    jobs.run_to_end(rows, f"{out}-checkpoint", mode, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    return spark.read.schema(StructType([*rows.schema.fields, StructField("batch", IntegerType())])).parquet(out)


@query(kb_queries.ORACLES["p_dedup_paragraphs"])
def r_incremental_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_folder(spark, "dedup")
    dedup = jobs.IncrementalDedup(spark, f"{out}-state", lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    jobs.run_to_end(views.crawl(streamed(spark), sf_dir), f"{out}-checkpoint", "append", dedup)
    return spark.read.schema("domain string, page_seq long, url string, idx int, para string").parquet(out).select("domain", "page_seq", "idx", "para")


@query()
def r_incremental_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawled pages in four batches, then the end of all crawls: the rows of ``w1_chunks``."""
    raw = crawled_pages(table(spark, sf_dir, "pages"))
    pages = saved(spread(raw).withColumn("text", page_column(F.col("html"))["text"]).drop("html").withColumn("last", F.lit(False)), "crawl")
    out = shared_folder(spark, "build")
    job = build.IncrementalBuild(spark, f"{out}-state", lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    edges = [float("-inf"), *pages.approxQuantile("page_seq", [0.25, 0.5, 0.75], 0.05), float("inf")]
    for n, (low, high) in enumerate(zip(edges, edges[1:])):
        job(pages.filter((F.col("page_seq") > low) & (F.col("page_seq") <= high)), n)
    job(build.end_of_crawls(pages), len(edges) - 1)
    chunks = spark.read.parquet(out).drop("batch")
    whole = stored_chunks(chunks, hashing_embedder(), kb_queries.now())
    return whole.select("chunk_id", "domain", "url", "content", "source", "label", "chunk_index", F.size("source_urls").alias("n_urls"), F.size("embedding").alias("dim"))


@query(f"WITH {views.CRAWL} SELECT domain, count(*) AS pages, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS chars, arg_max(url, page_seq) AS url FROM crawl GROUP BY 1")
def r_crawl_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = collected(spark, jobs.crawl_progress(views.crawl(streamed(spark), sf_dir)), "progress", "update")
    return rows.groupBy("domain").agg(F.max_by(F.struct("pages", "chars", "url"), "batch").alias("x")).select("domain", "x.*")


@query(f"""WITH {views.METERED}, r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ts, message_id) AS n FROM metered)
SELECT message_id, CASE WHEN plan = 'free' THEN least(n, {LIMIT}) ELSE n END AS rn, plan <> 'free' OR n <= {LIMIT} AS accepted, plan = 'free' AND n = {LIMIT} + 1 AS notice,
  CASE WHEN plan = 'free' THEN CASE n WHEN 15 THEN 50 WHEN 23 THEN 75 WHEN 27 THEN 90 END END AS threshold FROM r""")
def r_quota_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_folder(spark, "quota")
    meter = jobs.QuotaMeter(spark, f"{out}-state", lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), LIMIT)
    jobs.run_to_end(views.metered(streamed(spark), sf_dir), f"{out}-checkpoint", "append", meter)
    rows = spark.read.schema("domain string, message_id long, rn long, accepted boolean, notice boolean, threshold int, period_start date").parquet(out)
    return rows.select("message_id", "rn", "accepted", "notice", "threshold")


@query(f"WITH RECURSIVE {chat_queries.FOLD} SELECT domain, session_token, seq, array_to_string(open, ';') AS pending, flag AS handoff_pending, notice FROM fold WHERE k > 0")
def r_handoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = collected(spark, jobs.handoff_stream(chat_queries.turns(streamed(spark), sf_dir)), "handoffs")
    return rows.select("domain", "session_token", "seq", F.array_join("pending", ";").alias("pending"), "handoff_pending", "notice")


@query(f"WITH {views.METERED} SELECT domain, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest FROM metered GROUP BY 1")
def r_live_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = collected(spark, jobs.live_counts(views.metered(streamed(spark), sf_dir)), "counts", "update")
    last = rows.groupBy("domain").agg(F.max_by(F.struct("n", "latest"), "batch").alias("x"))
    return last.select("domain", "x.n", F.date_format("x.latest", "yyyy-MM-dd HH:mm:ss").alias("latest"))


@query(f"WITH {views.LOGS} SELECT log_id, level FROM logs WHERE created_at >= TIMESTAMP '2024-02-15' - INTERVAL 30 DAY")
def r_retained_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = collected(spark, views.logs(streamed(spark), sf_dir), "logs")
    return jobs.retained_logs(rows, dt.datetime(2024, 2, 15)).select("log_id", "level")


@query(f"WITH {views.LOGS} SELECT log_id, level FROM logs WHERE created_at >= TIMESTAMP '2024-02-15' - INTERVAL 30 DAY")
def r_log_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log kept by days, after the expired ones are dropped."""
    stream, now = views.logs(streamed(spark), sf_dir), dt.datetime(2024, 2, 15)
    fields = ", ".join(f"`{c}` {t}" for c, t in stream.dtypes)
    out = shared_folder(spark, "log-store")
    store = jobs.LogStore(spark, f"{out}/days", fields)
    jobs.run_to_end(stream, f"{out}/checkpoint", "append", store.append)
    store.expire(now)
    return store.rows(now).select("log_id", "level")
