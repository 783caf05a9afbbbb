"""Checks before and around the knowledge base: secrets in sources, follow-ups, semantic boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.operators.retrieval import dot_product

#: Patterns of what must not be embedded.
SECRETS = {
    "password": r"(?i)\b(password|passwd|pwd)\s*[:=]\s*\S{4,}",
    "api_key": r"(?i)\b(api[_-]?key|secret|token)\s*[:=]\s*[\"']?[A-Za-z0-9_\-]{16,}",
    "jwt": r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
}
CARD = r"\b(\d[ -]?){12,18}\d\b"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c: c.cast("int"))
    doubled = F.transform(each, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return (F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0) & (F.length(digits) > 0)


def sensitive(text: Column) -> Column:
    """The kinds of sensitive content in a text, in order of the table, cards last."""
    kinds = [F.when(text.rlike(p), F.lit(name)) for name, p in SECRETS.items()]
    cards = F.transform(F.regexp_extract_all(text, F.lit(f"({CARD})"), 1), lambda c: F.regexp_replace(c, "[ -]", ""))
    kinds.append(F.when(F.exists(cards, luhn), F.lit("card")))
    return F.filter(F.array(*kinds), lambda k: k.isNotNull())


def withhold_sensitive(sources: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(sources that may be embedded, withheld ones with ``findings``)."""
    marked = sources.withColumn("findings", sensitive(F.coalesce(F.col(text_col), F.lit(""))))
    return marked.filter(F.size("findings") == 0).drop("findings"), marked.filter(F.size("findings") > 0)


def handoff_followups(conversations: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Conversations with an open handoff that the owner was last told of ``hours`` ago or more."""
    return conversations.filter(F.col("handoff_pending") & (F.col("last_notified_at") <= now - F.expr(f"INTERVAL {int(hours)} HOURS")))


def semantic_boundaries(paras: DataFrame, min_similarity: float = 0.65) -> DataFrame:
    """``paras`` (``domain, page_seq, idx, para, embedding``) with ``segment``, which rises where a paragraph is less
    similar to the one before than ``min_similarity``."""
    order = Window.partitionBy("domain", "page_seq").orderBy("idx")
    before = F.lag("embedding").over(order)
    starts = paras.withColumn("starts", (before.isNotNull() & (dot_product(before, F.col("embedding")) < min_similarity)).cast("int"))
    return starts.withColumn("segment", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("starts")


def semantic_chunks(paras: DataFrame, min_similarity: float = 0.65, cap: int = 1800) -> DataFrame:
    """``(domain, page_seq, segment, part, content)``: segments as chunks, cut where they pass ``cap`` characters."""
    marked = semantic_boundaries(paras, min_similarity)
    order = Window.partitionBy("domain", "page_seq", "segment").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    sized = marked.withColumn("part", F.floor((F.sum(F.length("para") + 2).over(order) - 1) / cap))
    rows = sized.groupBy("domain", "page_seq", "segment", "part").agg(F.array_sort(F.collect_list(F.struct("idx", "para"))).alias("p"))
    return rows.select("domain", "page_seq", "segment", "part", F.array_join(F.transform("p", lambda x: x["para"]), "\n\n").alias("content"))
