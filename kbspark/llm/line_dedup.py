"""Line dedup by site-relative frequency: built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm.shared import ASCII_SPACE, let, written

#: Flagged lines that may be broadcast: 32-byte keys, so 16 MB at most.
BROADCAST_LINES = 500_000


def _key(line: Column) -> Column:
    """The 128-bit key of a line without outer white space; null for a blank line."""
    bare = F.btrim(line, F.lit(ASCII_SPACE))
    return F.when(bare != "", F.md5(bare))


def _host(host_col: str) -> Column:
    return F.coalesce(F.col(host_col).cast("string"), F.lit(""))


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", max_ratio: float = 0.1, min_pages: int = 5) -> DataFrame:
    """``(__ld_host, __ld_key, __ld_total)`` of the lines found on more than ``max_ratio`` of their host's pages and on
    ``min_pages`` pages at least, with the host's pages.

    A page counts once for each of its lines, so keys are made distinct inside the row and then counted
    with a map-side combine; a line on every page of a hot host costs one row a task.
    """
    lines = F.array_distinct(F.filter(F.transform(F.split(F.col(text_col), "\n"), _key), lambda k: k.isNotNull()))
    slim = docs.select(_host(host_col).alias("__ld_host"), lines.alias("__ld_keys"))
    # The host's page total rides along as a null key, so one pass over the texts makes both counts.
    keys = F.explode(F.concat(F.coalesce(F.col("__ld_keys"), F.array()), F.array(F.lit(None).cast("string"))))
    counts = slim.select("__ld_host", keys.alias("__ld_key")).groupBy("__ld_host", "__ld_key").agg(F.count("*").alias("__ld_n"))
    counts = written(counts.filter(F.col("__ld_key").isNull() | (F.col("__ld_n") >= min_pages)), "line-counts")
    totals = counts.filter(F.col("__ld_key").isNull()).select("__ld_host", F.col("__ld_n").alias("__ld_total"))
    found = counts.filter(F.col("__ld_key").isNotNull()).join(totals, "__ld_host")
    return found.filter(F.col("__ld_n") > max_ratio * F.col("__ld_total")).select("__ld_host", "__ld_key", "__ld_total")


def _filled(lines: Column) -> Column:
    return F.size(F.filter(lines, lambda x: F.btrim(x, F.lit(ASCII_SPACE)) != ""))


def drop_boilerplate_lines(
    docs: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    max_ratio: float = 0.1,
    min_pages: int = 5,
    broadcast_lines: int = BROADCAST_LINES,
    hot_parts: int = 256,
    counts: bool = True,
) -> DataFrame:
    """``docs`` with the boilerplate lines of each host taken out of ``text_col``, and with ``counts`` two new
    columns: ``n_lines`` (lines with text before) and ``n_removed``.

    Lines are compared without outer white space and within their host only; blank lines stay. The
    number of flagged lines of a host is at most its mean lines a page divided by ``max_ratio``, whatever
    its pages, so one array a host holds them; a page's own are found in it by one hash intersection. If all hosts'
    flagged lines are few enough (counted, not guessed) they are broadcast and the texts are never shuffled; beyond that
    texts meet their host's array in a shuffle, where a host with more than 1/256 of all pages is cut into as many
    parts as that takes, row by row, so that copies and null texts don't meet either.

    Null text: stays null, counts 0. Null host: all such rows are one host, the same as the empty name.
    Repeated rows: each counts as a page. A text whose lines all go becomes empty and stays as a row.
    Empty table: empty result. With ``counts`` a column named ``n_lines`` or ``n_removed`` is replaced; without,
    all columns but the text are as they were.
    """
    flagged = written(boilerplate(docs, host_col, text_col, max_ratio, min_pages), "boilerplate")
    sets = flagged.groupBy("__ld_host").agg(F.sort_array(F.collect_set("__ld_key")).alias("__ld_set"), F.max("__ld_total").alias("__ld_total"))
    base = docs.withColumn("__ld_host", _host(host_col))
    if flagged.count() <= broadcast_lines:
        joined = base.join(F.broadcast(sets), "__ld_host", "left")
    else:
        share = F.greatest(F.lit(1), F.lit(docs.count()) / hot_parts)
        sized = sets.withColumn("__ld_parts", F.ceil(F.col("__ld_total") / share).cast("int"))
        hot = F.broadcast(sized.filter("__ld_parts > 1").select("__ld_host", "__ld_parts"))  # fewer than hot_parts hosts
        salted = sized.withColumn("__ld_salt", F.explode(F.sequence(F.lit(0), F.col("__ld_parts") - 1))).drop("__ld_parts")
        row = F.pmod(F.monotonically_increasing_id(), F.coalesce("__ld_parts", F.lit(1))).cast("int")
        joined = base.join(hot, "__ld_host", "left").withColumn("__ld_salt", row).join(salted.hint("shuffle_hash"), ["__ld_host", "__ld_salt"], "left")
    lines = F.split(F.col(text_col), "\n")
    touched = F.col(text_col).isNotNull() & F.col("__ld_set").isNotNull()
    flags = let(F.transform(lines, _key), lambda keys: let(F.array_intersect(keys, F.col("__ld_set")), lambda here: F.transform(keys, lambda k: F.coalesce(F.array_contains(here, k), F.lit(False)))))
    joined = joined.withColumn("__ld_cut", F.when(touched, flags))
    kept = F.filter(lines, lambda x, i: ~F.get(F.col("__ld_cut"), i))
    cut = F.size(F.filter("__ld_cut", lambda c: c))
    new = {text_col: F.when(touched & F.exists("__ld_cut", lambda c: c), F.array_join(kept, "\n")).otherwise(F.col(text_col))}
    if counts:
        new["n_lines"] = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(_filled(lines)).cast("long")
        new["n_removed"] = F.when(touched, cut).otherwise(F.lit(0)).cast("long")
    own = [c for c in docs.columns if not (counts and c in ("n_lines", "n_removed"))]
    return joined.withColumns(new).select(*own, *(["n_lines", "n_removed"] if counts else []))
