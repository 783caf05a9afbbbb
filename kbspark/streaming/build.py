"""The knowledge-base build while crawls run: chunks of normal pages batch by batch, thin pages at a crawl's end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.functions.text import CrawlSettings, url_key
from kbspark.operators.chunks import chunk_pages, dedup_chunks, group_thin_pages
from kbspark.operators.paragraphs import rebuild_pages
from kbspark.plans.build import first_of_each_url
from kbspark.sources.shared import drop_folder, subfolders
from kbspark.streaming.jobs import first_copies

#: What a crawl's later batches need of its earlier ones.
STATE = {
    "visited": "domain string, url_key string",
    "paras": "domain string, para_hash string, n long",
    "hashes": "domain string, content_hash string",
    "thin": "domain string, page_seq long, url string, text string",
    "ended": "domain string",
}


class CrawlState:
    """Tables of rows (``domain`` and more) that batches leave for later ones, until the crawl of their domain ends.

    Each table is a folder a batch; before every ``every``-th batch those of crawls that still run are put together in
    one, and folders that no rerun of the last batch can ask for are deleted, so what a batch reads doesn't grow with
    the number of batches or of crawls that are over.
    """

    def __init__(self, spark: SparkSession, path: str, every: int = 16):
        self.spark, self.path, self.every = spark, path.rstrip("/"), every

    def _numbers(self, name: str, kind: str) -> list[int]:
        return [int(f.split("=")[1]) for f in subfolders(self.spark, f"{self.path}/{name}") if f.startswith(f"{kind}=")]

    def _since(self, name: str, start: int, before: int) -> DataFrame:
        """The rows of batches from ``start`` on, with their ``batch``."""
        schema, made = f"{STATE[name]}, batch int", [n for n in self._numbers(name, "batch") if start <= n < before]
        if not made:
            return self.spark.createDataFrame([], schema)
        folders = [f"{self.path}/{name}/batch={n}" for n in sorted(made)]
        return self.spark.read.option("basePath", f"{self.path}/{name}").schema(schema).parquet(*folders)

    def rows(self, name: str, before: int) -> DataFrame:
        """The rows of ``name`` that batches before ``before`` have left for crawls that haven't ended by then."""
        start = max((n for n in self._numbers(name, "sums") if n <= before), default=0)
        held = self._since(name, start, before)
        if start:
            sums = self.spark.read.schema(STATE[name]).parquet(f"{self.path}/{name}/sums={start}")
            held = held.unionByName(sums.withColumn("batch", F.lit(start - 1)))
        ends = self._since("ended", start, before).groupBy("domain").agg(F.max("batch").alias("end"))
        return held.join(ends, "domain", "left").filter("end IS NULL OR batch > end").drop("end", "batch")

    def put(self, name: str, rows: DataFrame, batch: int) -> DataFrame:
        path = f"{self.path}/{name}/batch={batch}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(STATE[name]).parquet(path)

    def compact(self, before: int) -> None:
        for name in STATE:
            if name != "ended":
                rows = self.rows(name, before)
                rows = rows.groupBy("domain", "para_hash").agg(F.sum("n").alias("n")) if name == "paras" else rows
                rows.write.mode("overwrite").parquet(f"{self.path}/{name}/sums={before}")
            for kind, last in (("batch", before - 1), ("sums", before)):  # a rerun of the last batch needs what was before it
                for n in self._numbers(name, kind):
                    if n < last - self.every:
                        drop_folder(self.spark, f"{self.path}/{name}/{kind}={n}")


class IncrementalBuild:
    """Chunks of sites while they are crawled, equal to those of :func:`kbspark.plans.build.build_chunks` over all pages.

    A batch has pages (``domain, page_seq, url, text``) in the order of the crawl and, with ``last`` true, a row for each
    domain whose crawl is over. The sink gets the batch's new chunks: those of pages with enough content at once, those
    of thin pages, grouped by folder, when their crawl ends. What the crawl has seen before counts: URLs visited,
    paragraphs kept, contents of chunks. A crawl after the end marker starts anew.

    The state is :class:`CrawlState`. A batch that is run again doesn't see what it has left itself, and replaces
    it, so it gives the same chunks. Pages without domain or URL: as any, under the null key. Null text: thin. Empty batch: no chunks.
    """

    def __init__(self, spark: SparkSession, state_path: str, sink: Callable[[DataFrame, int], None], settings: CrawlSettings = CrawlSettings(), every: int = 16):
        self.spark, self.sink, self.settings, self.state = spark, sink, settings, CrawlState(spark, state_path, every)

    def _staged(self, rows: DataFrame, name: str, batch: int) -> DataFrame:
        path = f"{self.state.path}/work/{name}/batch={batch % 2}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        state, marked = self.state, self._staged(batch, "pages", batch_id)
        over = F.coalesce(F.col("last"), F.lit(False))
        ended = marked.filter(over).select("domain").distinct()
        pages = first_of_each_url(marked.filter(~over).select("domain", "page_seq", "url", "text"))
        keyed = pages.withColumn("url_key", url_key(F.col("url"))).join(state.rows("visited", batch_id), ["domain", "url_key"], "left_anti")
        pages = self._staged(keyed, "fresh", batch_id)
        kept, long = first_copies(pages, state.rows("paras", batch_id), self.settings)
        kept = self._staged(kept, "kept", batch_id)
        cols = ["domain", "page_seq", "url", "idx", "para"]
        rebuilt = self._staged(rebuild_pages(pages, kept.select(*cols).unionByName(long.select(*cols))), "rebuilt", batch_id)
        thin = pages.join(rebuilt.filter("thin").select("domain", "page_seq"), ["domain", "page_seq"], "left_semi").select("domain", "page_seq", "url", "text")
        thin = state.put("thin", thin, batch_id)
        waiting = state.rows("thin", batch_id).unionByName(thin).join(ended, "domain", "left_semi")
        chunks = dedup_chunks(chunk_pages(rebuilt.filter("NOT thin"), F.col("paras")).unionByName(group_thin_pages(waiting, self.settings)))
        chunks = self._staged(chunks.join(state.rows("hashes", batch_id), ["domain", "content_hash"], "left_anti"), "chunks", batch_id)
        self.sink(chunks, batch_id)
        state.put("visited", pages.select("domain", "url_key"), batch_id)
        state.put("paras", kept.groupBy("domain", "para_hash").agg(F.count("*").alias("n")), batch_id)
        state.put("hashes", chunks.select("domain", "content_hash"), batch_id)
        state.put("ended", ended, batch_id)
        if (batch_id + 1) % state.every == 0:
            state.compact(batch_id + 1)


def end_of_crawls(pages: DataFrame) -> DataFrame:
    """The end markers of all domains of ``pages``."""
    nothing = F.lit(None)
    return pages.select("domain").distinct().select(
        "domain", nothing.cast("long").alias("page_seq"), nothing.cast("string").alias("url"), nothing.cast("string").alias("text"), F.lit(True).alias("last")
    )


__all__ = ["IncrementalBuild", "CrawlState", "end_of_crawls"]
