"""Crawl frontier and refresh diff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions.html import resolved_links
from kbspark.functions.text import content_length, group_url, url_key, url_part
from kbspark.operators.paragraphs import THIN_PAGE
from kbspark.sources.shared import saved

MAX_PAGES = 500


def frontier_step(pages: DataFrame, visited: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """The next URLs to fetch: ``(domain, url_key, url, subdomain, rank)``.

    ``pages`` has ``domain, base_host, url, links``; ``visited`` has ``domain, url_key``. Links are resolved
    against their page; those on the base host or below it stay, one for each key, without the visited ones.
    Subdomains go first, then by key; a domain gets no more than ``max_pages`` in all.
    Null links or base host: nothing to follow. Repeated pages and links: once. Empty tables: nothing.
    """
    linked = pages.select("domain", "base_host", F.explode(resolved_links(F.col("url"), F.col("links"))).alias("url"))
    host = url_part(F.col("url"), 2)
    own = linked.filter((host == F.col("base_host")) | host.endswith(F.concat(F.lit("."), F.col("base_host"))))
    keyed = own.select("domain", url_key(F.col("url")).alias("url_key"), "url", (host != F.col("base_host")).alias("subdomain"))
    fresh = keyed.groupBy("domain", "url_key").agg(F.min("url").alias("url"), F.max("subdomain").alias("subdomain"))
    seen = visited.select("domain", "url_key").distinct()
    fresh = fresh.join(seen, ["domain", "url_key"], "left_anti")
    room = seen.groupBy("domain").agg(F.count("*").alias("fetched"))
    order = Window.partitionBy("domain").orderBy(F.col("subdomain").desc(), "url_key")
    ranked = fresh.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max_pages)
    return ranked.join(room, "domain", "left").filter(F.col("rank") + F.coalesce("fetched", F.lit(0)) <= max_pages).drop("fetched")


def crawl_to_end(pages: DataFrame, starts: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """``(domain, url_key, url, round)``: all that a crawl fetches that begins at ``starts`` (``domain, url``) and follows
    links in rounds, breadth first. ``pages`` (``domain, base_host, url, links``) are what can be fetched.

    A round looks at the links of the pages fetched in the round before alone, leaves out what was visited, and is
    written, so the next one reads it and not how it came about. A site gets no more than ``max_pages`` URLs; of a round
    that goes over it, :func:`frontier_step`'s order decides. A URL that can't be fetched counts and leads nowhere.
    Repeated pages of a key: all their links. Null domain or URL: not followed. No starts: empty.
    """
    web = saved(pages.filter("domain IS NOT NULL AND url IS NOT NULL").withColumn("url_key", url_key(F.col("url"))), "web")
    first = starts.filter("domain IS NOT NULL AND url IS NOT NULL").groupBy("domain", url_key(F.col("url")).alias("url_key")).agg(F.min("url").alias("url"))
    rank = F.row_number().over(Window.partitionBy("domain").orderBy("url_key"))
    fresh = saved(first.withColumn("rank", rank).filter(F.col("rank") <= max_pages).select("domain", "url_key", "url", F.lit(0).alias("round")), "crawl-round")
    visited, n = fresh, 0
    while not fresh.isEmpty():
        n += 1
        fetched = web.join(fresh.select("domain", "url_key"), ["domain", "url_key"], "left_semi")
        found = frontier_step(fetched, visited, max_pages)
        fresh = saved(found.select("domain", "url_key", "url", F.lit(n).alias("round")), "crawl-round")
        # Sixteen rounds are one table again.
        visited = visited.unionByName(fresh)
        if n % 16 == 0:
            visited = saved(visited, "crawl-visited")
    return visited


def page_facts(crawled: DataFrame) -> DataFrame:
    """``crawled`` without its texts: what a diff needs of them is ``thin`` (too little content) and ``text_len``; adds
    ``url_key`` where it isn't there yet."""
    known = {} if "url_key" in crawled.columns else {"url_key": url_key(F.col("url"))}
    facts = {"thin": content_length(F.col("text")) < THIN_PAGE, "text_len": F.coalesce(F.length("text"), F.lit(0))}
    return crawled.withColumns(known | facts).drop("text")


def diff_pages(crawled: DataFrame, stored: DataFrame, stale_days: int | None = None, now: Column | None = None) -> DataFrame:
    """``crawled`` pages (``domain, url, text, content_hash, priority``) without their texts, with ``change``: changed,
    unchanged or thin_changed (handled through its group), :func:`page_facts`, and what the stored row knew.

    Only keys, hashes and facts are joined; texts stay where they are. Where both tables are bucketed by ``(domain,
    url_key)`` (:func:`kbspark.sources.tables.bucketed`) nothing is shuffled at all. With ``stale_days``, pages not
    scraped for so long count as changed too. Stored pages that this crawl did not see are left alone.

    Several stored rows with one key: the last by ``last_scraped_at, url``. Repeated crawled rows: each on its own. Null text: thin,
    length 0. Null hash: changed unless the stored one is null too. Null domain or URL: not known, so changed.
    """
    latest = Window.partitionBy("domain", "url_key").orderBy(F.col("last_scraped_at").desc_nulls_last(), F.col("url").desc())
    keyed = stored if "url_key" in stored.columns else stored.withColumn("url_key", url_key(F.col("url")))
    known = (
        keyed.withColumn("rn", F.row_number().over(latest))
        .filter("rn = 1")
        .select("domain", "url_key", F.lit(True).alias("known"), F.col("url").alias("stored_url"), F.col("content_hash").alias("stored_hash"), "has_variants", "last_scraped_at")
    )
    joined = page_facts(crawled).join(known, ["domain", "url_key"], "left")
    changed = ~F.col("stored_hash").eqNullSafe(F.col("content_hash")) | F.col("known").isNull()
    if stale_days is not None:
        changed = changed | F.coalesce(F.col("last_scraped_at") < (now if now is not None else F.current_timestamp()) - F.expr(f"INTERVAL {int(stale_days)} DAYS"), F.lit(False))
    return joined.withColumn("hash_changed", changed).withColumn(
        "change",
        F.when(F.col("thin"), F.when(F.col("hash_changed"), "thin_changed").otherwise("unchanged"))
        .when(F.col("hash_changed") | (F.col("priority") == "high"), "changed")
        .otherwise("unchanged"),
    )


def changed_thin_groups(diffed: DataFrame) -> DataFrame:
    """All thin pages of the groups of which a member changed."""
    thin = diffed.filter("thin").withColumn("group", group_url(F.col("url")))
    touched = thin.groupBy("domain", "group").agg(F.bool_or("hash_changed").alias("touched")).filter("touched")
    return thin.join(touched, ["domain", "group"], "left_semi")


def page_hash_updates(diffed: DataFrame) -> DataFrame:
    """Pages whose stored hash is rewritten: changed ones, and high-priority ones with 300 characters or more."""
    return diffed.filter(F.col("hash_changed") | ((F.col("priority") == "high") & (F.col("text_len") >= THIN_PAGE)))


def format_duration(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.when(s < 60, F.format_string("%ds", s)).otherwise(F.format_string("%dm %ds", F.floor(s / 60).cast("long"), s % 60))


def refresh_summary(diffed: DataFrame, new_chunks: DataFrame, seconds: Column) -> DataFrame:
    """``(domain, checked, changed, unchanged, chunks_updated, duration)``."""
    pages = diffed.groupBy("domain").agg(
        F.count("*").alias("checked"),
        F.count_if(F.col("change") != "unchanged").alias("changed"),
        F.count_if(F.col("change") == "unchanged").alias("unchanged"),
    )
    made = new_chunks.groupBy("domain").agg(F.count("*").alias("chunks_updated"))
    return pages.join(made, "domain", "left").select(
        "domain", "checked", "changed", "unchanged", F.coalesce("chunks_updated", F.lit(0)).alias("chunks_updated"), format_duration(seconds).alias("duration")
    )


def refresh_due(tenants: DataFrame, now: Column) -> DataFrame:
    """Tenants whose refresh is due: enabled, at this UTC hour, and daily, never run, or 6 days ago."""
    due = (F.col("refresh_interval") == "daily") | F.col("last_refresh_at").isNull() | (F.col("last_refresh_at") <= now - F.expr("INTERVAL 6 DAYS"))
    return tenants.filter(F.col("refresh_enabled") & (F.col("refresh_hour") == F.hour(now)) & due)


def crawl_totals(pages: DataFrame) -> DataFrame:
    """``(domain, pages, chars)`` of a crawl."""
    return pages.groupBy("domain").agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("chars"))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("domain", "url").agg(F.count("*").alias("chunk_count"))
