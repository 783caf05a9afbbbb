"""Workloads over all tenants: full knowledge-base build and smart refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.functions.html import page_column
from kbspark.functions.text import CrawlSettings, content_hash, priority, url_key
from kbspark.operators.chunks import chunk_id, chunk_pages, dedup_chunks, embed_chunks, group_thin_pages
from kbspark.operators.crawl import changed_thin_groups, diff_pages, page_hash_updates
from kbspark.operators.paragraphs import dedup_paragraphs, rebuild_pages, split_pages
from kbspark.sources.pages import crawled_pages
from kbspark.sources.shared import saved


#: Repeated pages whose keys may be broadcast, about 50 bytes each.
BROADCAST_PAGES = 500_000


def first_of_each_url(pages: DataFrame, broadcast_pages: int = BROADCAST_PAGES) -> DataFrame:
    """One page for each url key of a domain, the first crawled. Keys are ranked without the html; the pages that
    are repeats, usually few, are then taken out, and as long as they are few (counted) no html is shuffled."""
    keys = pages.select("domain", "page_seq", url_key(F.col("url")).alias("key"))
    first = keys.groupBy("domain", "key").agg(F.min("page_seq").alias("first"), F.count("*").alias("n")).filter("n > 1")
    repeats = keys.join(first, ["domain", "key"]).filter("page_seq <> first").select("domain", "page_seq")
    if repeats.count() <= broadcast_pages:
        repeats = F.broadcast(repeats)
    return pages.join(repeats, ["domain", "page_seq"], "left_anti")


def extracted_pages(raw: DataFrame) -> DataFrame:
    """``(domain, page_seq, url, text, content_hash, priority, links, needs_render)`` of raw pages."""
    read = crawled_pages(raw).withColumn("page", page_column(F.col("html")))
    return read.select(
        "domain", "page_seq", "url", F.col("page.text").alias("text"), content_hash(F.col("page.text")).alias("content_hash"),
        priority(F.col("url")).alias("priority"), F.col("page.links").alias("links"), F.col("page.needs_render").alias("needs_render"),
    )


def build_chunks(pages: DataFrame, settings: CrawlSettings = CrawlSettings()) -> DataFrame:
    """All chunks of pages with ``text``: boilerplate out, long pages chunked, thin pages grouped, equal chunks
    once. Thin pages are cut from their original text, not the deduplicated one.

    The texts are saved once, so html is read by one task a page, and so are the rebuilt pages that both branches use.
    """
    pages = saved(pages.select("domain", "page_seq", "url", "text"), "page-texts")
    return _chunks_of(pages, pages, settings)


def _chunks_of(pages: DataFrame, thin: DataFrame, settings: CrawlSettings) -> DataFrame:
    """Chunks of ``pages`` that aren't thin, and of the groups of ``thin``: those that are, where it is ``pages`` itself."""
    rebuilt = saved(rebuild_pages(pages, dedup_paragraphs(split_pages(pages, settings))), "rebuilt-pages")
    normal = chunk_pages(rebuilt.filter("NOT thin"), F.col("paras"))
    if thin is pages:
        thin = pages.join(rebuilt.filter("thin").select("domain", "page_seq"), ["domain", "page_seq"], "left_semi")
    return dedup_chunks(normal.unionByName(group_thin_pages(thin, settings)))


def stored_chunks(chunks: DataFrame, embed, now: Column, known: DataFrame | None = None) -> DataFrame:
    """Chunks as the chunk table keeps them, embedded."""
    whole = embed_chunks(chunks, embed, known=known)
    return whole.withColumns({"source": F.lit("scraped"), "created_at": now, "chunk_id": chunk_id(F.col("domain"), F.col("url"), F.col("content"))})


def texts_of(crawled: DataFrame, pages: DataFrame, broadcast_pages: int = BROADCAST_PAGES) -> DataFrame:
    """The rows of ``crawled`` that ``pages`` (domain, url_key, page_seq) names. As long as they are few (counted) their keys
    go to the texts; otherwise both meet by ``(domain, url_key)``, without a shuffle where the crawl is bucketed so."""
    keyed = crawled if "url_key" in crawled.columns else crawled.withColumn("url_key", url_key(F.col("url")))
    wanted = pages.groupBy("domain", "url_key").agg(F.collect_set("page_seq").alias("_seqs"))
    wanted = F.broadcast(wanted) if pages.count() <= broadcast_pages else wanted
    return keyed.join(wanted, ["domain", "url_key"]).filter(F.array_contains("_seqs", F.col("page_seq"))).drop("_seqs")


def refresh_chunks(diffed: DataFrame, crawled: DataFrame, settings: CrawlSettings = CrawlSettings()) -> DataFrame:
    """Chunks that a refresh writes: of changed pages, deduplicated among themselves, and of thin groups with a
    changed member. A changed page that turns out thin after dedup gives none and keeps its old chunks."""
    keys = ["domain", "url_key", "page_seq"]
    cols = ["domain", "page_seq", "url", "text"]
    changed = saved(texts_of(crawled, diffed.filter("change = 'changed'").select(*keys)).select(*cols), "changed-pages")
    thin = saved(texts_of(crawled, changed_thin_groups(diffed).select(*keys)).select(*cols), "thin-pages")
    return _chunks_of(changed, thin, settings)


def refresh(crawled: DataFrame, stored: DataFrame, settings: CrawlSettings = CrawlSettings()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(diff, new chunks, page rows to write) of a crawl against the stored pages."""
    diffed = saved(diff_pages(crawled, stored), "diffed-pages")
    return diffed, refresh_chunks(diffed, crawled, settings), page_hash_updates(diffed)


__all__ = ["first_of_each_url", "extracted_pages", "build_chunks", "stored_chunks", "texts_of", "refresh_chunks", "refresh"]
