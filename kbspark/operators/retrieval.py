"""Retrieval: exact per-tenant vector top-k, threshold, siblings and budgeted context."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kbspark.functions.text import trim

TOP_K, THRESHOLD, OFFSET, FLOOR, BUDGET = 10, 0.75, 0.15, 0.50, 6000


def dot_product(a: Column, b: Column) -> Column:
    """Sum of products in double; the cosine of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dot_products(a: pa.Array, b: pa.Array) -> pa.Array:
    """:func:`dot_product` of two list columns, row by row; null where a list or an element is null or the lengths differ."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(a), pc.list_value_length(b)), False)
    x, y = a.filter(fits), b.filter(fits)
    sizes, u, v = pc.list_value_length(x).to_numpy(), x.flatten(), y.flatten()
    product = u.to_numpy(zero_copy_only=False).astype(float) * v.to_numpy(zero_copy_only=False).astype(float)
    gone = np.concatenate([[0], np.cumsum(pc.or_(pc.is_null(u), pc.is_null(v)).to_numpy(zero_copy_only=False))])
    ends = np.cumsum(sizes)
    # One more place, so that an empty list at the end has one to point to.
    total = np.add.reduceat(np.append(np.nan_to_num(product), 0.0), ends - sizes) if len(sizes) else np.empty(0)
    out, where = np.full(len(a), np.nan), np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    out[where] = np.where(sizes > 0, total, 0.0)
    bad = np.ones(len(a), bool)
    bad[where] = gone[ends] > gone[ends - sizes]
    return pa.array(out, mask=bad)


#: Tenants with more vectors than one cell takes, about 50 bytes each, up to which their sizes are broadcast.
BROADCAST_TENANTS = 500_000


def _celled(rows: DataFrame, of: str, key: str, other: str, sizes: DataFrame) -> DataFrame:
    """``rows`` dealt by a hash of ``key`` to the ``of`` cells of their domain, once for each of its ``other`` cells."""
    met = rows.join(sizes, "domain", "left")
    own = F.pmod(F.xxhash64(key), F.coalesce(F.col(of), F.lit(1)))
    each = F.explode(F.sequence(F.lit(0), (F.coalesce(F.col(other), F.lit(1)) - 1).cast("int")))
    return met.select(F.col("domain").alias(f"{of}_domain"), own.cast("int").alias(f"{of}_cell"), each.alias(f"{other}_cell"), *[x for x in rows.columns if x != "domain"])


def vector_topk(queries: DataFrame, chunks: DataFrame, k: int = TOP_K, query_block: int = 1024, list_size: int = 4096) -> DataFrame:
    """``(query_id, domain, chunk_id, score, rank)``: each query's ``k`` best chunks of its domain, exactly.

    ``queries`` has ``query_id, domain, vector``; ``chunks`` has ``chunk_id, domain, embedding``. Rows without a domain or
    a vector have no hits. A domain is a grid of cells of about ``list_size`` chunks and ``query_block`` queries, as many as
    its size needs; each cell is one matrix product and keeps its own best ``k`` for each query, so no task grows with a
    tenant, and what goes to the final ranking is small. Ties (at 12 digits) go to the lower chunk_id.
    """
    asked = queries.select("query_id", "domain", "vector").filter("domain IS NOT NULL AND vector IS NOT NULL")
    held = chunks.select("chunk_id", "domain", "embedding").filter("domain IS NOT NULL AND embedding IS NOT NULL")
    # Only tenants that need more than one cell are listed: at most one for each list_size chunks or query_block queries.
    counts = lambda df, name, size: df.groupBy("domain").agg(F.ceil(F.count("*") / size).cast("int").alias(name)).filter(F.col(name) > 1)
    sizes = counts(held, "c", list_size).join(counts(asked, "q", query_block), "domain", "full")
    if sizes.count() <= BROADCAST_TENANTS:
        sizes = F.broadcast(sizes)
    left = _celled(asked, "q", "query_id", "c", sizes).groupBy("q_domain", "q_cell", "c_cell")
    right = _celled(held, "c", "chunk_id", "q", sizes).groupBy("c_domain", "q_cell", "c_cell")
    q_type, c_type = queries.schema["query_id"].dataType.simpleString(), chunks.schema["chunk_id"].dataType.simpleString()
    out = to_arrow_schema(StructType.fromDDL(f"query_id {q_type}, domain string, chunk_id {c_type}, score double"))

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return out.empty_table()
        scores = np.round(matrix(a["vector"]) @ matrix(b["embedding"]).T, 12)
        keep = min(k, b.num_rows)
        order = pc.sort_indices(b["chunk_id"]).to_numpy()
        scores = scores[:, order]  # by id, so that of equal scores the first column wins
        least = np.partition(scores, -keep, axis=1)[:, -keep]
        tops = []
        for row, low in zip(scores, least):
            near = np.flatnonzero(row >= low)
            tops.append(near[np.argsort(-row[near], kind="stable")[:keep]])
        at, of = np.concatenate(tops), np.repeat(np.arange(a.num_rows), keep)
        ids = b["chunk_id"].take(pa.array(order[at]))
        return pa.table([a["query_id"].take(pa.array(of)), a["q_domain"].take(pa.array(of)), ids, pa.array(scores[of, at])], schema=out)

    scored = left.cogroup(right).applyInArrow(best, f"query_id {q_type}, domain string, chunk_id {c_type}, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def primary_hits(top: DataFrame, chunks: DataFrame, tenants: DataFrame, default: float = THRESHOLD) -> DataFrame:
    """Hits at or above their tenant's threshold, with the chunk's columns and the threshold used."""
    limits = tenants.select("domain", F.coalesce("rag_threshold", F.lit(default)).alias("threshold"))
    cut = top.join(limits, "domain", "left").withColumn("threshold", F.coalesce("threshold", F.lit(default)))
    hits = cut.filter(F.col("score") >= F.col("threshold"))
    return hits.join(chunks.drop("domain", "embedding"), "chunk_id")


def sibling_expand(primary: DataFrame, chunks: DataFrame, queries: DataFrame, offset: float = OFFSET, floor: float = FLOOR) -> DataFrame:
    """Other chunks of the pages that primary hits (not owner replies) come from, at a lower threshold and
    without limit: ``(query_id, domain, chunk_id, score, url, content, source)``.

    Scores are made by columns of vectors; contents stay in Spark and meet only what is over the threshold. Null source: as any
    page's chunk. Null vector, or one of another length: no sibling. Repeated hits: once. Equal scores: all. No hits: empty.
    """
    pages = primary.filter(~F.col("source").eqNullSafe(F.lit("owner_reply"))).select("query_id", "domain", "url", "threshold").distinct()
    others = chunks.filter(~F.col("source").eqNullSafe(F.lit("owner_reply")))
    slim = others.select("domain", "url", "chunk_id", "embedding")
    met = pages.join(slim, ["domain", "url"]).join(primary.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    score = F.arrow_udf(dot_products, "double")(F.col("vector"), F.col("embedding"))
    scored = met.join(queries.select("query_id", "vector"), "query_id").withColumn("score", score)
    limit = F.greatest(F.lit(floor), F.col("threshold") - offset)
    near = scored.filter(F.col("score") >= limit).select("query_id", "domain", "chunk_id", "score")
    return near.join(others.select("domain", "chunk_id", "url", "content", "source"), ["domain", "chunk_id"]).select("query_id", "domain", "chunk_id", "score", "url", "content", "source")


def pack_context(primary: DataFrame, siblings: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``(query_id, context, sources)``: page hits by score, then siblings by score, up to the first chunk that
    would pass ``budget`` characters; sources are the packed pages in order of their first chunk."""
    cols = ["query_id", "chunk_id", "score", "url", "content"]
    ranked = (
        primary.filter(~F.col("source").eqNullSafe(F.lit("owner_reply"))).select(*cols, F.lit(0).alias("kind"))
        .unionByName(siblings.select(*cols, F.lit(1).alias("kind")))
        .withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy("kind", F.round("score", 12).desc(), "chunk_id")))
    )
    order = Window.partitionBy("query_id").orderBy("at")
    before = F.coalesce(F.sum(F.length("content") + 2).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fits = ranked.withColumn("fits", before + F.length("content") <= budget)
    packed = fits.withColumn("all_fit", F.min("fits").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("all_fit")
    rows = packed.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", "url", "content"))).alias("p"))
    context = trim(F.array_join(F.transform("p", lambda x: x["content"]), "\n\n"))
    return rows.select("query_id", context.alias("context"), F.array_distinct(F.transform("p", lambda x: x["url"])).alias("sources"))


def owner_reply_context(primary: DataFrame) -> DataFrame:
    """All owner replies among the primary hits, by score and without budget."""
    mine = primary.filter(F.col("source") == "owner_reply").groupBy("query_id")
    rows = mine.agg(F.array_sort(F.collect_list(F.struct((-F.round("score", 12)).alias("s"), "chunk_id", "content"))).alias("p"))
    return rows.select("query_id", F.array_join(F.transform("p", lambda x: x["content"]), "\n\n").alias("owner_context"))


def retrieve(queries: DataFrame, chunks: DataFrame, tenants: DataFrame, k: int = TOP_K, default: float = THRESHOLD, offset: float = OFFSET, floor: float = FLOOR, budget: int = BUDGET) -> DataFrame:
    """One row for each query: ``context, owner_context, sources, top_score`` (0 where nothing was found)."""
    top = vector_topk(queries, chunks, k)
    primary = primary_hits(top, chunks, tenants, default)
    packed = pack_context(primary, sibling_expand(primary, chunks, queries, offset, floor), budget)
    best = top.groupBy("query_id").agg(F.max("score").alias("top_score"))
    joined = queries.select("query_id", "domain").join(packed, "query_id", "left").join(owner_reply_context(primary), "query_id", "left").join(best, "query_id", "left")
    return joined.select(
        "query_id", "domain", F.coalesce("context", F.lit("")).alias("context"), F.coalesce("owner_context", F.lit("")).alias("owner_context"),
        F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), F.coalesce("top_score", F.lit(0.0)).alias("top_score"),
    )


def cached_answers(queries: DataFrame, cache: DataFrame, min_score: float = 0.95) -> DataFrame:
    """Cached answers for queries at a similarity of ``min_score`` or more: ``(query_id, cache_id, score)``.
    ``cache`` has ``cache_id, domain, embedding``."""
    near = vector_topk(queries, cache.withColumnRenamed("cache_id", "chunk_id"), 1)
    return near.filter(F.col("score") >= min_score).select("query_id", F.col("chunk_id").alias("cache_id"), "score")


def invalidate_cache(cache: DataFrame, changed: DataFrame) -> DataFrame:
    """``cache`` (with ``chunk_ids`` that each answer used) without answers that used a chunk in ``changed``."""
    used = cache.select("cache_id", F.explode("chunk_ids").alias("chunk_id")).join(changed.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return cache.join(used.select("cache_id").distinct(), "cache_id", "left_anti")
