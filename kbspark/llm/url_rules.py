"""URL filters: fixed host/path rules, then association rules mined by FP-growth. Built-in functions only."""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm.shared import written

#: (verdict, host, path) of the fixed rules.
FIXED_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"^[\s\S]*?://([^/?#]*)([^?#]*)"
#: Association rules that may be broadcast (each a handful of short tokens).
BROADCAST_RULES = 100_000


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL: scheme, host labels, path segments with numbers masked, query keys, fragment mark."""
    masked = F.regexp_replace(url_path(url), r"[0-9]+", "0")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    some = lambda parts, tag: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(tag), x))
    return F.array_distinct(
        F.concat(
            some(F.array(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), "s:"),
            some(F.split(url_host(url), r"\."), "h:"),
            some(F.split(masked, r"[/]"), "p:"),
            some(F.transform(F.split(query, "&"), lambda kv: F.split(kv, "=")[0]), "q:"),
            F.when(url.contains("#"), F.array(F.lit("f:"))).otherwise(F.array().cast("array<string>")),
        )
    )


def matched_rule(host: Column, path: Column, rules=FIXED_RULES) -> tuple[Column, Column]:
    """(rule as text, its verdict) of the longest rule that fits, null where none does.

    A rule fits its host and all subdomains where the path starts with the rule's. The rules are a short
    configured list, tried longest first in one expression; of equally long ones the longer host wins.
    """
    name, says = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, says = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(says)
    return name, says


def _folded(rows: DataFrame, least: int) -> DataFrame:
    """``(token, name, members, n, bad)`` of the tokens that occur with the mark in ``least`` rows or more of ``rows`` (row,
    tokens, bad): tokens found in exactly the same rows are one item, named by the least of them."""
    each = rows.select("row", "bad", F.explode("tokens").alias("token"))
    found = each.groupBy("token").agg(
        F.count_if("bad").alias("bad"), F.count("*").alias("n"), F.expr("bit_xor(xxhash64(row))").alias("x"), F.expr("bit_xor(xxhash64(row, 1))").alias("y")
    )
    classes = found.filter(F.col("bad") >= least).groupBy("n", "bad", "x", "y").agg(F.sort_array(F.collect_list("token")).alias("members"))
    return classes.select(F.explode("members").alias("token"), F.col("members")[0].alias("name"), "members", "n", "bad")


def marked_sets(rows: DataFrame, items: DataFrame, least: int) -> DataFrame:
    """``(antecedent, bad, n)``: the sets of two items or more that ``least`` marked rows or more hold, with how many
    rows and marked rows do. FP-growth sees marked rows only; the sets it finds are then counted in the distinct
    baskets of the others, each by way of its rarest item."""
    each = rows.select("row", "bad", F.explode("tokens").alias("token")).join(items.select("token"), "token")
    baskets = written(each.groupBy("row", "bad").agg(F.array_sort(F.collect_list("token")).alias("items")), "url-baskets")
    marked = baskets.filter("bad AND size(items) > 1").select("items")
    n = marked.count()
    if n < least:
        return rows.sparkSession.createDataFrame([], "antecedent array<string>, bad long, n long")
    # Half a row less, so that rounding can't ask for one more.
    sets = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n).fit(marked).freqItemsets.filter("size(items) > 1")
    sets = written(sets.select(F.array_sort("items").alias("antecedent"), F.col("freq").alias("bad")), "url-sets")
    others = baskets.filter("NOT bad AND size(items) > 1").groupBy("items").agg(F.count("*").alias("n"))
    met = others.withColumn("token", F.explode("items")).join(_filed(sets), "token").filter(F.size(F.array_except("antecedent", "items")) == 0)
    more = met.groupBy("antecedent").agg(F.sum("n").alias("more"))
    return sets.join(more, "antecedent", "left").select("antecedent", "bad", (F.col("bad") + F.coalesce("more", F.lit(0))).alias("n"))


def mined_rules(
    labelled: DataFrame, min_support: float = 0.002, min_count: int = 5, min_confidence: float = 0.5
) -> DataFrame:
    """``(antecedent array<string>, members array<array<string>>, confidence, support)`` of token sets that mark bad URLs.

    ``labelled`` has ``url`` and ``bad`` (boolean). A set is a rule if it and the mark occur together in ``min_support``
    of the rows and in ``min_count`` rows, at ``min_confidence``, and if no part of it is a rule already. Rules may
    have any number of tokens.

    Before Spark's FP-growth counts sets, what can't add a rule is left out: tokens too rare with the mark, tokens of
    every row, and tokens that are a rule alone, since any set with one is redundant. Tokens that always occur together
    are one item: a site whose URLs share 30 tokens has one set and not 2 ** 30. ``members`` has the tokens of each item
    of ``antecedent``, any of which stands for it.
    """
    rows = written(
        labelled.filter(F.col("url").isNotNull()).select(
            F.monotonically_increasing_id().alias("row"), F.array_distinct(url_tokens(F.col("url"))).alias("tokens"), F.coalesce(F.col("bad"), F.lit(False)).alias("bad")
        ),
        "url-tokens",
    )
    n = rows.count()
    least = max(1, math.ceil(min(1.0, max(min_support, min_count / max(1, n))) * n - 1e-9))
    tokens = written(_folded(rows, least), "url-items")
    sure = F.col("bad") / F.col("n") >= min_confidence
    named = tokens.filter("token = name").select("name", "members", "n", "bad")
    alone = named.filter(sure).select(F.array("name").alias("antecedent"), "bad", "n")
    rest = marked_sets(rows, named.filter(~sure & (F.col("n") < n)).select(F.col("name").alias("token")), least).filter(sure)
    rules = written(alone.unionByName(rest), "url-rules")
    # A rule whose part is a rule adds nothing: the part fits wherever it does. The part's rarest token is in the rule.
    parts = _filed(rules).select(F.col("antecedent").alias("part"), "token")
    each = rules.select("antecedent", F.explode("antecedent").alias("token"))
    inside = (F.size("part") < F.size("antecedent")) & (F.size(F.array_except("part", "antecedent")) == 0)
    redundant = each.join(parts, "token").filter(inside).select("antecedent").distinct()
    kept = rules.join(redundant, "antecedent", "left_anti")
    wide = kept.select("antecedent", F.explode("antecedent").alias("name")).join(named.select("name", "members"), "name").groupBy("antecedent").agg(F.collect_list("members").alias("members"))
    return kept.join(wide, "antecedent").select("antecedent", "members", (F.col("bad") / F.col("n")).alias("confidence"), (F.col("bad") / n).alias("support"))


def _filed(rules: DataFrame) -> DataFrame:
    """``(antecedent, token)``: each rule with the one of its tokens that fewest rules share."""
    each = rules.select("antecedent", F.explode("antecedent").alias("token"))
    common = each.groupBy("token").agg(F.count("*").alias("n"))
    return each.join(common, "token").groupBy("antecedent").agg(F.min_by("token", F.struct("n", "token")).alias("token"))


def rule_hits(urls: DataFrame, rules: DataFrame, broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """The ``url`` of ``urls`` (distinct) that some rule fits, by an inverted index from token to rules.

    Each rule is filed under the tokens of one item, that which fewest rules share, and only URLs with such a token
    look at it; the rest of the rule is then checked in place.
    """
    rules = written(rules.select("antecedent", "members"), "pruned-rules")
    filed = rules.join(_filed(rules).withColumnRenamed("token", "name"), "antecedent")
    under = F.element_at(F.filter("members", lambda m: F.array_contains(m, F.col("name"))), 1)
    index = filed.select("members", F.explode(under).alias("token")).groupBy("token").agg(F.collect_list("members").alias("rules"))
    if rules.count() <= broadcast_rules:
        index = F.broadcast(index)
    met = urls.select("url", url_tokens(F.col("url")).alias("tokens")).withColumn("token", F.explode("tokens")).join(index, "token")
    fits = F.exists("rules", lambda r: F.forall(r, lambda m: F.arrays_overlap(m, F.col("tokens"))))
    return met.filter(fits).select("url").distinct()


def _judged(pages: DataFrame, urls: DataFrame, total: int, parts: int = 256) -> DataFrame:
    """``pages`` with ``__hit`` of ``urls`` (url, n, hit). URLs with more than ``total / parts`` of the pages, fewer than
    ``parts``, are looked up in a broadcast, and neither they nor null URLs meet in one task."""
    hot = F.col("n") > F.lit(total // parts)
    some = F.broadcast(urls.filter(hot).select(F.col("url").alias("__hot"), F.col("hit").alias("__hot_hit")))
    rest = urls.filter(~hot & F.col("hit")).select(F.col("url").alias("__url"), F.lit(True).alias("__cold_hit"))
    # Rows that are settled get a key of their own, which no URL equals.
    own = F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string"))
    looked = pages.join(some, F.col("url") == F.col("__hot"), "left")
    keyed = looked.withColumn("__key", F.when(F.col("url").isNull() | F.col("__hot").isNotNull(), own).otherwise(F.col("url")))
    joined = keyed.join(rest, F.col("__key") == F.col("__url"), "left")
    return joined.withColumn("__hit", F.coalesce("__hot_hit", "__cold_hit", F.lit(False)))


def filter_urls(
    pages: DataFrame,
    labelled: DataFrame,
    fixed_rules=FIXED_RULES,
    min_support: float = 0.002,
    min_count: int = 5,
    min_confidence: float = 0.5,
) -> DataFrame:
    """``pages`` with host, path, rule (the fixed rule that decided, or null), mined (some mined rule fits)
    and verdict.

    The longest fixed rule decides; where none fits, the page is blocked if a mined rule fits its URL.
    Null URL or none with ``://``: host and path empty, no rule, allowed. Repeated rows and URLs: judged
    alike, since the verdict depends on the URL alone. Empty tables: no rules, or an empty result. Columns
    of ``pages`` with the names of result columns are replaced.
    """
    urls = written(pages.filter(F.col("url").isNotNull()).groupBy("url").agg(F.count("*").alias("n")), "urls")
    hits = rule_hits(urls, mined_rules(labelled, min_support, min_count, min_confidence))
    urls = written(urls.join(hits.withColumn("hit", F.lit(True)), "url", "left").fillna(False, "hit"), "judged-urls")
    out = ("host", "path", "rule", "mined", "verdict")
    joined = _judged(pages, urls, pages.count())
    name, says = matched_rule(F.col("host"), F.col("path"), fixed_rules)
    return (
        joined.withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
        .withColumns({"rule": name, "mined": F.col("__hit"), "verdict": F.coalesce(says, F.when(F.col("__hit"), "block").otherwise("allow"))})
        .select(*[c for c in pages.columns if c not in out], *out)
    )
