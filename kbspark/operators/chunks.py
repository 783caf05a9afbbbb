"""Chunks: from pages, from groups of thin pages, from manual entries and owner replies; dedup and embedding."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions.chunking import TARGET, chunk_rows
from kbspark.functions.text import CrawlSettings, group_url, keep_para, kept_paragraphs, paragraphs, strip_block_marker, trim
from kbspark.sources.shared import saved


def chunk_id(domain: Column, url: Column, content: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", domain, url, content), 256)


def chunk_pages(pages: DataFrame, paras: Column) -> DataFrame:
    """One row for each chunk of each page (``domain, page_seq, url`` and an array of kept paragraphs)."""
    slim = pages.select("domain", "page_seq", "url", F.transform(paras, strip_block_marker).alias("paras"))
    return chunk_rows(slim, F.col("paras")).drop("paras")


def chunk_texts(pages: DataFrame, settings: CrawlSettings = CrawlSettings()) -> DataFrame:
    """Chunks of pages straight from their ``text``, without cross-page dedup."""
    return chunk_pages(pages, kept_paragraphs(F.col("text"), settings))


def thin_cards(pages: DataFrame, settings: CrawlSettings = CrawlSettings()) -> DataFrame:
    """``(domain, group, page_seq, url, h1, card)``: a card of each thin page for its parent folder."""
    parts = paragraphs(F.col("text"))
    titles = F.filter(parts, lambda p: p.startswith("[H1] "))
    h1 = F.nullif(trim(F.substr(F.get(titles, F.lit(0)), F.lit(6))), F.lit(""))
    body = F.transform(F.filter(parts, lambda p: ~p.startswith("[H1] ") & keep_para(p, settings)), strip_block_marker)
    card = F.concat(
        F.lit("[Source: "), F.col("url"), F.lit("]"),
        F.coalesce(F.concat(F.lit("\n[H1] "), h1), F.lit("")),
        F.when(F.size(body) > 0, F.concat(F.lit("\n\n"), F.array_join(body, "\n\n"))).otherwise(""),
    )
    return pages.select("domain", group_url(F.col("url")).alias("group"), "page_seq", "url", h1.alias("h1"), card.alias("card"))


#: Pages of a group that one task packs: as many as have their number in a stretch of this length.
PART_PAGES = 20_000
ROOM = TARGET - 10


def _starts(p: np.ndarray) -> np.ndarray:
    """For a pack that starts at each card the first card behind it; ``p`` are running lengths from 0. A pack ends before
    the card that would fill it, but never before it has any characters."""
    full = np.searchsorted(p, p[:-1] + ROOM, side="right") - 1
    begun = np.searchsorted(p, p[:-1], side="right")
    return np.minimum(np.maximum(full, begun), len(p) - 1)


def _first_start(p: np.ndarray, size: int, n: int) -> int:
    """The first of ``n`` cards that doesn't go into a pack of ``size`` characters from before."""
    full = int(np.searchsorted(p, ROOM - size, side="right")) - 1
    begun = int(np.searchsorted(p, 0, side="right")) if size == 0 else 0
    return min(max(full, begun), n)


def _running(group: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    group = group.sort_values(["page_seq", "url"], kind="stable")
    return group, np.concatenate([[0], np.cumsum(group["n"].to_numpy(dtype=np.int64))])


def _thin_packs(lengths: DataFrame, part_pages: int) -> DataFrame:
    """The pack of each thin page (``domain, group, page_seq, url, n``), numbered in a group from 0.

    A group's pages are cut into parts by their number. Each part tells, for every card that could be the first of a pack
    there, how many packs follow and what the last one holds (a few numbers, since few cards fit into a pack); from
    those the state before each part follows part by part, and each part then packs its own pages.
    """
    parted = lengths.withColumn("part", F.coalesce(F.floor(F.col("page_seq") / part_pages), F.lit(2**62)))
    key = ["domain", "group", "part"]

    def outline(group: pd.DataFrame) -> pd.DataFrame:
        group, p = _running(group)
        m, starts = len(group), _starts(p)
        packs, last = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
        for i in range(m - 1, -1, -1):
            j = starts[i]
            packs[i], last[i] = packs[j] + 1, last[j] if j < m else p[m] - p[i]
        f = _first_start(p, 0, m)
        row = [*group[key].iloc[0], m, int(p[m]), p[: f + 2].tolist(), packs[: f + 1].tolist(), last[: f + 1].tolist()]
        return pd.DataFrame([row], columns=[*key, "m", "chars", "head", "packs", "last"])

    def chain(parts: pd.DataFrame) -> pd.DataFrame:
        pack, size, out = 0, 0, []
        for r in parts.sort_values("part").itertuples():
            out.append((r.domain, r.group, r.part, pack, size))
            f = _first_start(np.asarray(r.head), size, r.m)
            pack, size = (pack + int(r.packs[f]), int(r.last[f])) if f < r.m else (pack, size + r.chars)
        return pd.DataFrame(out, columns=[*key, "pack", "size"])

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group, p = _running(group)
        m, starts, pack = len(group), _starts(p), int(group["pack"].iloc[0])
        i, packs = _first_start(p, int(group["size"].iloc[0]), m), np.full(m, pack)
        while i < m:
            pack += 1
            packs[i : starts[i]] = pack
            i = starts[i]
        return group[["domain", "group", "page_seq", "url"]].assign(pack=packs)

    kinds = "domain string, group string, part long"
    outlines = parted.groupBy(*key).applyInPandas(outline, f"{kinds}, m long, chars long, head array<long>, packs array<long>, last array<long>")
    before = outlines.groupBy("domain", "group").applyInPandas(chain, f"{kinds}, pack long, size long")
    met = parted.join(before, key)
    return met.groupBy(*key).applyInPandas(fill, "domain string, group string, page_seq long, url string, pack int")


def group_thin_pages(pages: DataFrame, settings: CrawlSettings = CrawlSettings(), part_pages: int = PART_PAGES) -> DataFrame:
    """Chunks of thin pages, packed by parent folder in page order.

    Cards are made once and saved. Only (page_seq, length) goes through the packing, in parts of a group; the cards meet
    their pack in an aggregation. Null URL: in the group without URL. Null text: a card without content. Repeated rows: a
    card each. Pages without ``page_seq``: last. Empty table: no chunk. Other columns: ignored.
    """
    cards = saved(thin_cards(pages, settings), "thin-cards")
    lengths = cards.select("domain", "group", "page_seq", "url", F.coalesce(F.length("card"), F.lit(0)).alias("n"))
    packs = _thin_packs(lengths, part_pages)
    held = cards.join(packs, ["domain", "group", "page_seq", "url"]).groupBy("domain", "group", "pack")
    rows = held.agg(F.array_sort(F.collect_list(F.struct("page_seq", "url", "h1", "card"))).alias("c"))
    titles = F.filter(F.transform("c", lambda x: x["h1"]), lambda h: h.isNotNull())
    label = F.when(F.size(titles) == 0, "Group").otherwise(
        F.concat(F.array_join(F.slice(titles, 1, 3), ", "), F.when(F.size(titles) > 3, ", …").otherwise(""))
    )
    content = F.concat(F.lit("[Source: "), F.col("group"), F.lit("]\n\n\n\n"), F.array_join(F.transform("c", lambda x: x["card"]), "\n\n"))
    nothing = F.lit(None).cast("string")
    return rows.select(
        "domain", F.get("c", F.lit(0))["page_seq"].alias("page_seq"), F.col("group").alias("url"), trim(content).alias("content"),
        F.col("pack").alias("chunk_index"), nothing.alias("page_h1"), nothing.alias("section_h2"), label.alias("label"),
        F.transform("c", lambda x: x["url"]).alias("source_urls"),
    )


def dedup_chunks(chunks: DataFrame) -> DataFrame:
    """The first chunk of each content in a domain, in page and chunk order; adds ``content_hash``."""
    hashed = chunks.withColumn("content_hash", F.sha2("content", 256))
    order = Window.partitionBy("domain", "content_hash").orderBy("page_seq", "chunk_index", "url")
    return hashed.withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic embedder for tests and offline runs: signed word hashes, unit length."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for row, text in zip(out, texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % dim] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    return embed


def embed_chunks(chunks: DataFrame, embed: Callable[[list[str]], np.ndarray], batch: int = 128, known: DataFrame | None = None) -> DataFrame:
    """``chunks`` with ``embedding``, ``batch`` texts a call and in order. Contents that ``known``
    (``content_hash, embedding``) has are taken from there and not embedded again."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts, out = s.tolist(), []
            for k in range(0, len(texts), batch):
                out += list(np.asarray(embed(texts[k : k + batch]), dtype=np.float32))
            yield pd.Series(out, dtype=object)

    if known is None:
        return chunks.withColumn("embedding", vectors("content"))
    have = known.select("content_hash", "embedding").dropDuplicates(["content_hash"])
    fresh = chunks.join(have, "content_hash", "left_anti").withColumn("embedding", vectors("content"))
    return fresh.unionByName(chunks.join(have, "content_hash").select(*fresh.columns))


def entry_chunks(entries: DataFrame) -> DataFrame:
    """Chunks of manual entries and uploads (``domain, source, label, text``): they carry content, label and
    source and no headings or index. An entry without any chunk is rejected, so it has no row."""
    url = F.concat(F.col("source"), F.lit("://"), F.col("domain"), F.lit("/"), F.col("label"))
    bare = F.transform(kept_paragraphs(F.col("text")), strip_block_marker)
    named = entries.select("domain", "source", F.col("label").alias("entry"), url.alias("url"), bare.alias("paras"))
    return chunk_rows(named, F.col("paras")).select("domain", "source", F.col("entry").alias("label"), "url", "content")


def replace_entry_chunks(chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """``chunks`` in which those of every (domain, label, source) in ``fresh`` are replaced by ``fresh``."""
    keys = fresh.select("domain", "label", "source").distinct()
    return chunks.join(keys, ["domain", "label", "source"], "left_anti").unionByName(fresh, allowMissingColumns=True)


def owner_reply_chunks(replies: DataFrame) -> DataFrame:
    """One question-and-answer chunk for each answered question (``domain, answered array<string>, reply,
    add_to_kb boolean or null, tenant_default boolean``)."""
    wanted = replies.filter(F.coalesce(F.col("add_to_kb"), F.col("tenant_default"), F.lit(False)))
    each = wanted.select("domain", "reply", F.explode("answered").alias("q"))
    return each.select(
        "domain", F.concat(F.lit("owner-reply://"), F.col("domain")).alias("url"),
        F.concat(F.lit("Q: "), F.col("q"), F.lit("\nA: "), F.col("reply")).alias("content"),
        F.lit("owner_reply").alias("source"), F.substring("q", 1, 120).alias("label"),
    )


def embedded_once(chunks: DataFrame, path: str, embed: Callable[[list[str]], np.ndarray], batch: int = 128, part_texts: int = 50_000) -> DataFrame:
    """``chunks`` (with ``content`` and ``content_hash``) with ``embedding`` from the store at ``path``, a Parquet table of one
    vector a content, shared by all tenants and runs.

    Contents that the store lacks are embedded once each, however many chunks have them, in parts of about
    ``part_texts`` that are appended one after the other: a run that fails keeps the parts before, and the next one
    goes on from there. Null content: null embedding, not stored. Repeated rows: each gets the vector.
    """
    spark = chunks.sparkSession
    schema = "content_hash string, embedding array<float>"
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    store = lambda: spark.read.schema(schema).parquet(path)
    texts = chunks.filter("content IS NOT NULL").groupBy("content_hash").agg(F.first("content").alias("content"))
    lacking = saved(texts.join(store(), "content_hash", "left_anti"), "texts-to-embed")
    parts = -(-lacking.count() // part_texts)

    def vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(0, len(frame), batch):
                some = frame.iloc[k : k + batch]
                yield pd.DataFrame({"content_hash": some["content_hash"], "embedding": list(np.asarray(embed(some["content"].tolist()), np.float32))})

    for k in range(parts):
        part = lacking.filter(F.pmod(F.xxhash64("content_hash"), F.lit(parts)) == k)
        part.mapInPandas(vectors, schema).write.mode("append").parquet(path)
    return chunks.join(store(), "content_hash", "left")
