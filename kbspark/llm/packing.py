"""Packing into optimal length buckets: boundaries by dynamic programming over the global length histogram,
then token-budget batches inside each bucket."""

from __future__ import annotations

import numpy as np
import pandas as pd
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.llm import shared
from kbspark.llm.shared import small_batches, written
from kbspark.llm.tokens import encoder, in_pieces

#: Characters whose tokens are counted at once, and distinct words that a task remembers meanwhile.
PIECE_CHARS, CACHE_WORDS = 1_000_000, 100_000


def optimal_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """At most ``buckets`` bucket lengths (ascending, the last the greatest length) with the least padding in
    total when each sequence is padded to the first bucket that holds it.

    Exact, by dynamic programming: with C and S the running counts and sums of length, the best cost of the
    first j lengths in k buckets is the least over i of cost(k-1, i) + L_j (C_j - C_i) - (S_j - S_i). As lines
    in L_j those are met in order of slope, so a hull of lines gives each k in one pass over the histogram.
    All numbers are Python integers.
    """
    order = sorted(zip(lengths, counts))
    length = [x for x, _ in order]
    n = len(length)
    if not n:
        return []
    total, weight = [0], [0]
    for x, c in order:
        total.append(total[-1] + c)
        weight.append(weight[-1] + c * x)
    best: list[int | None] = [0] + [None] * n
    back: list[list[int]] = []
    result: tuple[int, int] | None = None
    for k in range(1, min(buckets, n) + 1):
        now: list[int | None] = [None] * (n + 1)
        came = [0] * (n + 1)
        hull: list[tuple[int, int, int]] = []  # slope, height, index
        head = 0
        for j in range(1, n + 1):
            if best[j - 1] is not None:
                line = (-total[j - 1], best[j - 1] + weight[j - 1], j - 1)
                while len(hull) - head >= 2 and _hidden(hull[-2], hull[-1], line):
                    hull.pop()
                hull.append(line)
            x = length[j - 1]
            while len(hull) - head >= 2 and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
                head += 1
            if len(hull) > head:
                slope, height, i = hull[head]
                now[j] = x * total[j] - weight[j] + slope * x + height
                came[j] = i
        back.append(came)
        if result is None or now[n] < result[0]:
            result = (now[n], k)
        best = now
    out, j = [], n
    for k in range(result[1], 0, -1):
        out.append(length[j - 1])
        j = back[k - 1][j]
    return out[::-1]


def _hidden(a: tuple, b: tuple, c: tuple) -> bool:
    """Whether line b is nowhere lowest between a and c; slopes fall from a to c."""
    return (c[1] - a[1]) * (a[0] - b[0]) <= (b[1] - a[1]) * (a[0] - c[0])


def token_counts(vocabulary: str):
    """A column function: ids that the vocabulary gives a whole text (null: 0).

    Spark deals tasks to the idle Python workers of an executor in turn, so a task leaves no encoder behind: an executor
    holds one for each running task, however many workers earlier stages have started.
    """

    def count(text: Column) -> Column:
        @F.pandas_udf("long")
        def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            shared.WORKER_CACHES.clear()
            for b in batches:
                texts = b.fillna("").tolist()
                found = [n for i, j in in_pieces(texts, PIECE_CHARS) for n in encoder(vocabulary, CACHE_WORDS).count(texts[i:j])]
                yield pd.Series(found, dtype=np.int64)
            shared.WORKER_CACHES.clear()
            shared.give_back()

        return of(text)

    return count


def pack(
    docs: DataFrame,
    length: Column,
    id_col: str = "doc_id",
    max_len: int = 4096,
    buckets: int = 16,
    batch_tokens: int = 131_072,
    rows_per_salt: int = 100_000,
) -> DataFrame:
    """Deal documents into padded batches; every token of every document is in exactly one row's range.

    A document longer than ``max_len`` tokens becomes consecutive pieces of ``max_len`` and a rest. The
    histogram of piece lengths has ``max_len`` rows at most, so its size on the driver is bounded whatever the
    corpus; the boundaries come from :func:`optimal_boundaries`. A batch of a bucket holds
    ``batch_tokens // bucket_len`` pieces (1 at least), all padded to ``bucket_len``; only the last batch of a
    bucket is shorter.

    Ranks inside a bucket, which may hold most rows, are made in two steps: row numbers inside (bucket, salt),
    with salts of about ``rows_per_salt`` rows, plus the rows of the salts before. Only ids and lengths move.

    Returns ``(id_col, piece, start, n_tokens, bucket, bucket_len, batch, slot)``: tokens ``start`` to
    ``start + n_tokens`` of the document in ``slot`` of batch ``batch`` of bucket ``bucket``. Documents without
    tokens have one piece of 0 tokens in the first bucket. Null ids and repeated rows: each row is packed.
    Empty table: empty result. Columns of ``docs`` other than the id are not carried.
    """
    if max_len < 1 or buckets < 1 or batch_tokens < 1:
        raise ValueError("max_len, buckets and batch_tokens must be positive")
    small_batches(docs.sparkSession)
    sized = docs.select(F.col(id_col).alias("id"), length.cast("long").alias("n"))
    last = F.greatest(F.lit(0), F.ceil(F.col("n") / max_len) - 1).cast("long")
    pieces = sized.select(
        "id", "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece")
    ).select("id", "piece", (F.col("piece") * max_len).alias("start"), F.least(F.lit(max_len).cast("long"), F.col("n") - F.col("piece") * max_len).alias("n_tokens"))
    pieces = written(pieces, "pieces")
    histogram = pieces.groupBy("n_tokens").agg(F.count("*").alias("c")).collect()
    bounds = optimal_boundaries([r.n_tokens for r in histogram], [r.c for r in histogram], buckets)
    rows = sum(r.c for r in histogram)
    salts = max(1, -(-rows // rows_per_salt))
    array = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array(F.lit(0))
    placed = pieces.withColumn("bucket", F.size(F.filter(array, lambda b: b < F.col("n_tokens")))).withColumn(
        "salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts))
    )
    within = Window.partitionBy("bucket", "salt")
    ranked = placed.withColumn("rank", F.row_number().over(within.orderBy("id", "piece")) - 1)
    sizes = placed.groupBy("bucket", "salt").agg(F.count("*").alias("size"))
    before = Window.partitionBy("bucket").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", "salt", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    at = F.col("offset") + F.col("rank")
    bucket_len = F.get(array, F.col("bucket")).cast("long")
    room = F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.greatest(bucket_len, F.lit(1)))).cast("long")
    return (
        ranked.join(offsets, ["bucket", "salt"])
        .select("id", "piece", "start", "n_tokens", "bucket", bucket_len.alias("bucket_len"), at.alias("at"), room.alias("room"))
        .select(
            F.col("id").alias(id_col), "piece", "start", "n_tokens", "bucket", "bucket_len",
            F.floor(F.col("at") / F.col("room")).cast("long").alias("batch"), (F.col("at") % F.col("room")).cast("int").alias("slot"),
        )
    )
