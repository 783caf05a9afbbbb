"""Paragraph operators: split, filter, cross-page boilerplate, thin pages, rebuilt text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions.text import CrawlSettings, content_length, is_heading, keep_para, paragraphs, strip_block_marker

BOILERPLATE_MAX = 200
MAX_HEADINGS = 5
THIN_PAGE = 300


def split_pages(pages: DataFrame, settings: CrawlSettings = CrawlSettings()) -> DataFrame:
    """``(domain, page_seq, url, idx, para)``: the kept paragraphs of each page (``domain, page_seq, url, text``)."""
    each = pages.select("domain", "page_seq", "url", F.posexplode(paragraphs(F.col("text"))).alias("idx", "para"))
    return each.filter(keep_para(F.col("para"), settings))


def dedup_paragraphs(paras: DataFrame) -> DataFrame:
    """Drop paragraphs of up to 200 characters that the domain's earlier pages had: a heading may stand five
    times, anything else once. Longer ones pass untouched and are not shuffled. A page without ``page_seq`` comes last.

    The rank filter is a plain ``rn <= 5``, which Spark applies in part before the exchange, so a footer on a
    million pages sends five rows from each map task.
    """
    bare = strip_block_marker(F.col("para"))
    marked = paras.withColumns({"bare_len": F.length(bare), "heading": is_heading(bare), "para_hash": F.sha2(bare, 256)})
    short = marked.filter(F.col("bare_len") <= BOILERPLATE_MAX)
    order = Window.partitionBy("domain", "para_hash").orderBy(F.col("page_seq").asc_nulls_last(), "idx")
    first = short.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= MAX_HEADINGS)
    first = first.filter(F.col("heading") | (F.col("rn") == 1)).drop("rn")
    return first.unionByName(marked.filter(F.col("bare_len") > BOILERPLATE_MAX)).drop("bare_len", "heading", "para_hash")


def rebuild_pages(pages: DataFrame, kept: DataFrame) -> DataFrame:
    """``(domain, page_seq, url, paras, filtered_len, thin)`` for every page, ``paras`` its kept paragraphs in
    order. A page with nothing kept is thin."""
    by_page = kept.groupBy("domain", "page_seq").agg(F.array_sort(F.collect_list(F.struct("idx", "para"))).alias("p"))
    joined = pages.select("domain", "page_seq", "url").join(by_page, ["domain", "page_seq"], "left")
    paras = F.coalesce(F.transform("p", lambda x: x["para"]), F.array().cast("array<string>"))
    size = F.length(F.array_join(paras, "\n\n"))
    return joined.select("domain", "page_seq", "url", paras.alias("paras"), size.alias("filtered_len"), (size < THIN_PAGE).alias("thin"))


def estimate_content_len(pages: DataFrame) -> DataFrame:
    """``pages`` with ``content_len``, the size that the refresh uses to tell thin pages: no cross-page dedup."""
    return pages.withColumn("content_len", content_length(F.col("text")))
