"""Counts, lists and admin reads over all tenants; paging is by row number inside a tenant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.schemas import PRESERVED_SOURCES
from kbspark.sources.shared import saved

#: What each role may do.
ROLES = {
    "superadmin": [
        "conversations.view", "conversations.reply", "knowledge.view", "knowledge.edit", "settings.view", "settings.edit",
        "billing.view", "billing.edit", "users.view", "users.manage", "livechat.use", "impersonation.use", "entities.manage",
    ],
    "owner": [
        "conversations.view", "conversations.reply", "knowledge.view", "knowledge.edit", "settings.view", "settings.edit",
        "billing.view", "billing.edit", "users.view", "users.manage", "livechat.use",
    ],
    "agent": [
        "conversations.view", "conversations.reply", "knowledge.view", "livechat.use",
    ],
    "readonly": [
        "conversations.view", "knowledge.view", "settings.view", "billing.view", "users.view",
    ],
}


#: Characters of a URL that make a bucket: host and the first folders.
PREFIX = 48


#: Rows of a bucket beyond which it is cut into ranges of its own.
HOT_BUCKET = 1_000_000


def running(
    df: DataFrame, by: list[str], bucket: Column, order: list[Column], sums: dict[str, Column], totals: dict[str, str] | None = None, descending: bool = False, hot_bucket: int | None = None
) -> DataFrame:
    """``df`` with the running sum of each of ``sums`` in its group by ``order``, its own row included, and the group's
    whole sum of those named in ``totals``.

    ``bucket`` never falls as the order goes on (never rises, if ``descending``): rows are added up inside a bucket,
    and the sums of the buckets before it are put on top, so a large group is spread over as many tasks as it has buckets.
    Buckets of more than ``hot_bucket`` rows (counted) are first cut into ranges of the order, which are buckets then, so
    that a group with all its rows in one is spread too; rows equal in the order stay together.
    Rows with null keys or buckets are a group or bucket like any other. Empty table: empty result.
    """
    keyed = df.withColumns({"_key": F.struct(*by, bucket.alias("_bucket")), "_sub": F.lit(0), **{f"_v_{n}": v for n, v in sums.items()}})
    counted = [F.count("*").alias("_rows"), *[F.sum(f"_v_{n}").alias(f"_n_{n}") for n in sums]]
    counts = saved(keyed.groupBy("_key", "_sub").agg(*counted), "bucket-sums")
    most = HOT_BUCKET if hot_bucket is None else hot_bucket
    hot = counts.filter(F.col("_rows") > most).select("_key", "_rows")
    rows = hot.agg(F.sum("_rows")).first()[0]
    if rows:
        # There are fewer hot buckets than rows / most.
        large = keyed.join(F.broadcast(hot.select("_key")), "_key", "left_semi")
        parts = max(2, -(-rows // max(1, most // 2)))
        cut = saved(large.repartitionByRange(parts, "_key", *order).withColumn("_sub", F.spark_partition_id()), "hot-buckets")
        keyed = keyed.join(F.broadcast(hot.select("_key")), "_key", "left_anti").unionByName(cut)
        fresh = cut.groupBy("_key", "_sub").agg(*counted)
        counts = counts.filter(F.col("_rows") <= most).unionByName(fresh)
    group = Window.partitionBy(*[F.col(f"_key.{c}") for c in by])
    upto = group.orderBy(F.col("_key._bucket").desc() if descending else F.col("_key._bucket").asc(), "_sub").rowsBetween(Window.unboundedPreceding, 0)
    whole = [F.sum(f"_n_{n}").over(group).alias(name) for n, name in (totals or {}).items()]
    offsets = counts.select("_key", "_sub", *[(F.sum(f"_n_{n}").over(upto) - F.col(f"_n_{n}")).alias(f"_b_{n}") for n in sums], *whole)
    inside = Window.partitionBy("_key", "_sub").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    added = keyed.withColumns({f"_i_{n}": F.sum(f"_v_{n}").over(inside) for n in sums}).join(offsets, ["_key", "_sub"])
    return added.withColumns({n: F.col(f"_b_{n}") + F.col(f"_i_{n}") for n in sums}).drop("_key", "_sub", *[f"_{x}_{n}" for n in sums for x in "vib"])


def carried(df: DataFrame, by: list[str], bucket: Column, order: list[Column], values: list[str]) -> DataFrame:
    """``df`` with each of the columns ``values`` as it was last set (not null) in its group by ``order``, in its own row or
    before.

    ``bucket`` never falls as the order goes on: what was last set inside a bucket is found first, then the last of the
    buckets before it, so a large group is spread over as many tasks as it has buckets. Rows with null keys or
    buckets are a group or bucket like any other (a null bucket is the first). Equal places in ``order``: any of their values.
    """
    keyed = df.withColumn("_key", F.struct(*by, bucket.alias("_bucket"))).withColumn("_order", F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)]))
    last = keyed.groupBy("_key").agg(*[F.max_by(F.when(F.col(v).isNotNull(), F.struct(v)), F.when(F.col(v).isNotNull(), F.col("_order"))).alias(f"_l_{v}") for v in values])
    group = Window.partitionBy(*[F.col(f"_key.{c}") for c in by]).orderBy("_key._bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = last.select("_key", *[F.last(f"_l_{v}", ignorenulls=True).over(group)[v].alias(f"_b_{v}") for v in values])
    inside = Window.partitionBy("_key").orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)
    met = keyed.withColumns({f"_i_{v}": F.last(v, ignorenulls=True).over(inside) for v in values}).join(before, "_key")
    return met.withColumns({v: F.coalesce(f"_i_{v}", f"_b_{v}") for v in values}).drop("_key", "_order", *[f"_{x}_{v}" for v in values for x in "ib"])


def placed(df: DataFrame, by: list[str], bucket: Column, order: list[Column], descending: bool = False) -> DataFrame:
    """``df`` with ``position`` (from 1) in its group by ``order``, and the group's ``total``; see :func:`running`."""
    return running(df, by, bucket, order, {"position": F.lit(1)}, {"position": "total"}, descending)


def paged(df: DataFrame, by: list[str], bucket: Column, order: list[Column], size: int, descending: bool = False) -> DataFrame:
    """``df`` with ``position`` (from 1), ``page`` (from 1), and ``total`` and ``pages`` of its group; see :func:`placed`."""
    rows = placed(df, by, bucket, order, descending)
    return rows.withColumns({"page": F.ceil(F.col("position") / size), "pages": F.ceil(F.col("total") / size)})


def tenant_stats(tenants: DataFrame, chunks: DataFrame, pages: DataFrame, messages: DataFrame) -> DataFrame:
    """``(domain, chunks, pages, conversations, messages, last_scraped_at)``, zero where there is nothing."""
    per = lambda df, **aggs: df.groupBy("domain").agg(*[a.alias(n) for n, a in aggs.items()])
    sessions = messages.groupBy("domain", "session_token").agg(F.count("*").alias("n"))
    parts = [
        per(chunks, chunks=F.count("*")),
        per(pages, pages=F.count("*"), last_scraped_at=F.max("last_scraped_at")),
        per(sessions, conversations=F.count("*"), messages=F.sum("n")),
    ]
    out = tenants.select("domain")
    for p in parts:
        out = out.join(p, "domain", "left")
    return out.na.fill(0, ["chunks", "pages", "conversations", "messages"])


def model_stats(messages: DataFrame, since: Column) -> DataFrame:
    """``(domain, total, large, small, with_context, avg_top_score)`` of assistant messages with a model, in
    conversations that were active at or after ``since``; their older messages count too."""
    active = messages.groupBy("domain", "session_token").agg(F.max("ts").alias("last")).filter(F.col("last") >= since)
    told = messages.filter("role = 'assistant' AND model IS NOT NULL").join(active.select("domain", "session_token"), ["domain", "session_token"], "left_semi")
    return told.groupBy("domain").agg(
        F.count("*").alias("total"), F.count_if(F.col("model").contains("large")).alias("large"), F.count_if(F.col("model").contains("small")).alias("small"),
        F.count_if(F.coalesce("had_context", F.lit(False))).alias("with_context"), F.avg("top_score").alias("avg_top_score"),
    )


def shares(stats: DataFrame) -> DataFrame:
    """Whole per cents of the parts in ``total``, and the mean score to three places."""
    pct = lambda c: F.when(F.col("total") > 0, F.round(F.col(c) / F.col("total") * 100)).otherwise(0).cast("int").alias(f"{c}_pct")
    return stats.select("domain", "total", pct("large"), pct("small"), pct("with_context"), F.round("avg_top_score", 3).alias("avg_top_score"))


def kb_entries(chunks: DataFrame) -> DataFrame:
    """``(domain, label, source, count, created_at)`` of manual, uploaded and answered entries, newest first."""
    own = chunks.filter(F.col("source").isin(*PRESERVED_SOURCES) & F.col("label").isNotNull() & (F.col("label") != ""))
    rows = own.groupBy("domain", "label").agg(F.min_by("source", F.struct("created_at", "source")).alias("source"), F.count("*").alias("count"), F.min("created_at").alias("created_at"))
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("domain").orderBy(F.col("created_at").desc(), "label")))


def page_chunk_sizes(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """``pages`` with ``sizes``, the lengths of their chunks by index; empty where there are none. Lengths are
    taken before the shuffle, so no content moves."""
    lengths = chunks.select("domain", "url", "chunk_index", F.length("content").alias("n"))
    sizes = lengths.groupBy("domain", "url").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "n"))), lambda x: x["n"]).alias("sizes"))
    return pages.join(sizes, ["domain", "url"], "left").withColumn("sizes", F.coalesce("sizes", F.array().cast("array<int>")))


def chunks_for_url(chunks: DataFrame, urls: DataFrame) -> DataFrame:
    """Chunks of each ``(domain, url)`` asked for, their own or grouped from it: two equi-joins instead of an OR."""
    own = chunks.select("domain", F.col("url").alias("asked"), "chunk_id")
    grouped = chunks.select("domain", F.explode("source_urls").alias("asked"), "chunk_id")
    keys = own.union(grouped).join(urls.select("domain", F.col("url").alias("asked")).distinct(), ["domain", "asked"], "left_semi").distinct()
    found = keys.join(chunks.drop("domain", "embedding"), "chunk_id")
    return found.withColumn("position", F.row_number().over(Window.partitionBy("domain", "asked").orderBy("chunk_index", "chunk_id")))


def conversation_list(messages: DataFrame, size: int = 20) -> DataFrame:
    """Conversations by last activity with page numbers and an 80-character preview of the last message."""
    rows = messages.groupBy("domain", "session_token").agg(F.count("*").alias("messages"), F.max("ts").alias("last_active_at"), F.max_by("content", "seq").alias("last"))
    preview = F.when(F.length("last") > 80, F.concat(F.substring("last", 1, 80), F.lit("…"))).otherwise(F.col("last"))
    listed = rows.withColumn("preview", preview).drop("last")
    return paged(listed, ["domain"], F.date_trunc("hour", "last_active_at"), [F.col("last_active_at").desc(), F.col("session_token")], size, descending=True)


def page_search(pages: DataFrame, pattern: str | None = None, rendered: bool | None = None, priority: str | None = None, size: int = 50) -> DataFrame:
    """Stored pages that fit the filters, by URL, paged inside each tenant; see :func:`paged`.

    ``pattern`` is a regular expression, any case. Null URL: first, and in no search by pattern. Null ``used_renderer``: not
    rendered. Null domain: a tenant of its own. Repeated rows: a place each, equal URLs in any order. Empty table: empty result.
    Very long URLs: by their first 48 characters, then whole.
    """
    found = pages
    if pattern:
        found = found.filter(F.col("url").rlike(f"(?i){pattern}"))
    if rendered is not None:
        found = found.filter(F.coalesce("used_renderer", F.lit(False)) == rendered)
    if priority:
        found = found.filter(F.col("priority") == priority)
    return paged(found, ["domain"], F.substring("url", 1, PREFIX), [F.col("url")], size)


def log_search(logs: DataFrame, now: Column, level: str | None = None, source: str | None = None, domain: str | None = None, size: int = 50, days: int = 30) -> DataFrame:
    """Log rows of the last ``days`` days that fit the filters, newest first, paged over the whole log.

    The position is a rank over all rows: inside each minute, plus the rows of later minutes.
    """
    found = logs.filter(F.col("created_at") >= now - F.expr(f"INTERVAL {int(days)} DAYS"))
    for name, value in (("level", level), ("source", source), ("domain", domain)):
        if value is not None:
            found = found.filter(F.col(name) == value)
    return paged(found, [], F.date_trunc("minute", "created_at"), [F.col("created_at").desc(), F.col("log_id")], size, descending=True)


def _members(users: DataFrame) -> DataFrame:
    each = users.select("email", "superadmin", F.posexplode("memberships").alias("at", "m"))
    first = Window.partitionBy("email", "m.entity_domain").orderBy("at")
    return each.withColumn("rn", F.row_number().over(first)).filter("rn = 1").select("email", F.col("m.entity_domain").alias("domain"), F.col("m.roles").alias("roles"), F.col("m.permissions").alias("permissions"))


#: Superadmins of one array, how many of them, an e-mail address each, are broadcast, and the pairs that one task makes.
ADMIN_BLOCK, BROADCAST_ADMINS, TASK_PAIRS = 1000, 100_000, 20_000_000


def tenants_visible(users: DataFrame, tenants: DataFrame) -> DataFrame:
    """``(email, domain, position)``: every tenant for superadmins, the tenants of their memberships for others,
    newest first.

    What superadmins see is every tenant for each of them, a row for each pair by definition. Tenants are placed once
    for all superadmins, whose addresses meet them as arrays of about ``ADMIN_BLOCK``, by the number of the array. They are dealt
    out so that a task makes about ``TASK_PAIRS`` pairs, however small their own table is, and the arrays are taken apart last, in
    the same step as whatever follows.
    """
    admins = users.filter("superadmin").select("email")
    n = admins.count()
    tasks = -(-n * tenants.count() // TASK_PAIRS)
    blocks = max(1, -(-n // ADMIN_BLOCK))
    arrays = admins.groupBy(F.pmod(F.xxhash64("email"), F.lit(blocks)).alias("block")).agg(F.collect_list("email").alias("emails"))
    if n <= BROADCAST_ADMINS:
        arrays = F.broadcast(arrays)
    listed = placed(tenants.select("domain", "created_at"), [], F.date_trunc("day", "created_at"), [F.col("created_at").desc(), F.col("domain")], descending=True)
    listed = listed.select("domain", "position")
    if tasks > users.sparkSession.sparkContext.defaultParallelism:
        listed = listed.repartition(tasks)
    dealt = listed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    all_of = dealt.join(arrays, "block").select("emails", "domain", "position")
    own = _members(users.filter("NOT superadmin")).select("email", "domain").join(tenants.select("domain", "created_at"), "domain")
    place = F.row_number().over(Window.partitionBy("email").orderBy(F.col("created_at").desc(), "domain"))
    both = all_of.unionByName(own.select(F.array("email").alias("emails"), "domain", place.cast("long").alias("position")))
    return both.select(F.explode("emails").alias("email"), "domain", "position")


def resolve_permissions(users: DataFrame) -> DataFrame:
    """``(email, domain, permission)``: what roles give and what is granted directly, each once. Of several
    memberships in one domain the first counts; unknown roles give nothing."""
    spark = users.sparkSession
    presets = spark.createDataFrame([(r, p) for r, ps in ROLES.items() for p in ps], "role string, permission string")
    members = _members(users)
    by_role = members.select("email", "domain", F.explode("roles").alias("role")).join(F.broadcast(presets), "role").select("email", "domain", "permission")
    direct = members.select("email", "domain", F.explode("permissions").alias("permission"))
    return by_role.union(direct).distinct()


def team(users: DataFrame) -> DataFrame:
    return _members(users).select("domain", "email", F.array_sort("roles").alias("roles"))


def pending_invites(invites: DataFrame, now: Column) -> DataFrame:
    return invites.filter(F.col("accepted_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))


def redeemable_codes(codes: DataFrame, now: Column, kind: str | None = None) -> DataFrame:
    fine = F.col("active") & (F.col("max_uses").isNull() | (F.col("use_count") < F.col("max_uses"))) & (F.col("expires_at").isNull() | (F.col("expires_at") > now))
    return codes.filter(fine if kind is None else fine & (F.col("type") == kind))


def ministry_requests(tenants: DataFrame) -> DataFrame:
    """Tenants that asked for ministry mode and don't have it yet, newest request first."""
    return tenants.filter(F.col("ministry_requested_at").isNotNull() & ~F.coalesce("church_mode", F.lit(False))).orderBy(F.col("ministry_requested_at").desc(), "domain")


def usage_panel(tenants: DataFrame, limit: int = 100) -> DataFrame:
    """``(domain, used, limit, pct)``: the free plan has a limit, the others have none."""
    top = F.when(F.col("plan") == "free", F.lit(limit))
    return tenants.select("domain", F.col("message_count").alias("used"), top.alias("limit"), F.when(top.isNotNull(), F.least(F.lit(100), F.round(F.col("message_count") / top * 100).cast("int"))).alias("pct"))


def purge_tenants(tables: dict[str, DataFrame], gone: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(the tables without the domains in ``gone``, rows deleted by table and domain). Archived chunks go by
    the snapshots of the domain, memberships are taken out of users."""
    keys = gone.select("domain").distinct()
    left, counts = {}, None
    for name, df in tables.items():
        if name == "users":
            each = df.select("email", F.posexplode("memberships").alias("at", "m"))
            stay = each.join(keys, F.col("m.entity_domain") == F.col("domain"), "left_anti")
            nested = stay.groupBy("email").agg(F.array_sort(F.collect_list(F.struct("at", "m"))).alias("ms"))
            kept = F.coalesce(F.transform("ms", lambda x: x["m"]), F.slice("memberships", 1, 0))
            left[name] = df.join(nested, "email", "left").withColumn("memberships", kept).drop("ms")
            continue
        if name == "archived_chunks" and "snapshots" in tables:
            ids = tables["snapshots"].join(keys, "domain", "left_semi").select("snapshot_id")
            left[name] = df.join(ids, "snapshot_id", "left_anti")
            dropped = df.join(ids, "snapshot_id", "left_semi")
        else:
            left[name], dropped = df.join(keys, "domain", "left_anti"), df.join(keys, "domain", "left_semi")
        n = dropped.groupBy("domain").agg(F.count("*").alias("deleted")).select(F.lit(name).alias("table"), "domain", "deleted")
        counts = n if counts is None else counts.union(n)
    return left, counts


def unanswered_questions(messages: DataFrame) -> DataFrame:
    """``(domain, week, question, times)``: visitor questions whose answer had no context, most frequent first."""
    order = Window.partitionBy("domain", "session_token").orderBy("seq")
    asked = messages.withColumns({"question": F.lag("content").over(order), "asker": F.lag("role").over(order)})
    open_ = asked.filter("role = 'assistant' AND asker = 'user' AND NOT coalesce(had_context, false)")
    return open_.groupBy("domain", F.date_trunc("week", "ts").alias("week"), F.lower(F.btrim("question")).alias("question")).agg(F.count("*").alias("times"))


def usage_study(messages: DataFrame) -> DataFrame:
    """``(domain, conversations, messages, per_conversation, per_day)``."""
    sessions = messages.groupBy("domain", "session_token").agg(F.count("*").alias("n"), F.to_date(F.min("ts")).alias("day"))
    return sessions.groupBy("domain").agg(
        F.count("*").alias("conversations"), F.sum("n").alias("messages"), (F.sum("n") / F.count("*")).alias("per_conversation"), (F.count("*") / F.count_distinct("day")).alias("per_day")
    )


def usage_tiers(study: DataFrame, limits: tuple[int, ...] = (100, 250, 500)) -> DataFrame:
    """One row: tenants, and how many stay under each number of messages."""
    return study.agg(F.count("*").alias("tenants"), *[F.count_if(F.col("messages") < n).alias(f"under_{n}") for n in limits])
