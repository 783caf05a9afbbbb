"""The model's tables as views of the given ones, in Spark and in SQL: one rule a table, the same in both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.functions.text import content_hash, priority
from kbspark.sources.tables import table

QUERY_EVERY = 50

#: Regular-expression class of JavaScript's white space, for RE2.
RE2_WS = r"[\t\n\x0b\x0c\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as crawled pages: the source is the tenant, the language a folder."""
    docs = table(spark, sf_dir, "documents")
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/"), F.when(F.col("doc_id") % 9 == 0, "news").otherwise(F.col("lang")), F.lit("/"), F.col("doc_id").cast("string"))
    pages = docs.select(F.col("source").alias("domain"), F.col("doc_id").alias("page_seq"), url.alias("url"), "text")
    return pages.withColumns({"content_hash": content_hash(F.col("text")), "priority": priority(F.col("url"))})


CRAWL = """crawl AS (SELECT source AS domain, doc_id AS page_seq,
  'https://' || source || '.example.com/' || CASE WHEN doc_id % 9 = 0 THEN 'news' ELSE lang END || '/' || doc_id AS url, text, sha256(text) AS content_hash,
  CASE WHEN doc_id % 9 = 0 THEN 'high' ELSE 'normal' END AS priority FROM documents)"""


def stored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an earlier crawl left: every eleventh page is missing, every seventh had another text."""
    old = crawl(spark, sf_dir).filter(F.col("page_seq") % 11 != 0)
    hashed = F.when(F.col("page_seq") % 7 == 0, F.concat(F.lit("old-"), F.col("content_hash"))).otherwise(F.col("content_hash"))
    then = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return old.select(
        "domain", F.regexp_replace("url", "^https:", "http:").alias("url"), hashed.alias("content_hash"), "priority", F.lit(False).alias("used_renderer"),
        (F.col("page_seq") % 2 == 0).alias("has_variants"), F.lit(1).alias("chunk_count"), then.alias("last_scraped_at"), then.alias("last_changed_at"),
    )


STORED = """stored AS (SELECT domain, page_seq, replace(url, 'https:', 'http:') AS url, CASE WHEN page_seq % 7 = 0 THEN 'old-' || content_hash ELSE content_hash END AS content_hash,
  priority, page_seq % 2 = 0 AS has_variants FROM crawl WHERE page_seq % 11 <> 0)"""


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as stored chunks: the label is the tenant, twenty vectors a page."""
    v = table(spark, sf_dir, "embeddings")
    n = F.col("vec_id")
    source = F.when(n % 17 == 0, "owner_reply").when(n % 19 == 0, "manual").when(n % 13 == 0, None).otherwise("scraped")
    return v.select(
        n.alias("chunk_id"), F.concat(F.lit("d"), F.col("label").cast("string")).alias("domain"), F.concat(F.lit("u"), F.floor(n / 20).cast("string")).alias("url"),
        (n % 20).cast("int").alias("chunk_index"), source.alias("source"), F.concat(F.lit("entry "), (n % 29).cast("string")).alias("label"),
        F.concat(F.repeat(F.lit("word "), (F.lit(40) + n % 300).cast("int")), n.cast("string")).alias("content"), "embedding",
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n.cast("decimal(18,6)"))).alias("created_at"),
        F.array(F.concat(F.lit("u"), F.floor(n / 20).cast("string")), F.concat(F.lit("g"), F.floor(n / 100).cast("string"))).alias("source_urls"),
    )


CHUNKS = """chunks AS (SELECT vec_id AS chunk_id, 'd' || label AS domain, 'u' || (vec_id // 20) AS url, CAST(vec_id % 20 AS INTEGER) AS chunk_index,
  CASE WHEN vec_id % 17 = 0 THEN 'owner_reply' WHEN vec_id % 19 = 0 THEN 'manual' WHEN vec_id % 13 = 0 THEN NULL ELSE 'scraped' END AS source, 'entry ' || (vec_id % 29) AS label,
  repeat('word ', CAST(40 + vec_id % 300 AS INTEGER)) || vec_id AS content, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS embedding,
  TIMESTAMP '2024-01-01' + to_seconds(vec_id) AS created_at, ['u' || (vec_id // 20), 'g' || (vec_id // 100)] AS source_urls FROM embeddings)"""


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50 is also a question."""
    return vector_chunks(spark, sf_dir).filter(F.col("chunk_id") % QUERY_EVERY == 0).select(F.col("chunk_id").alias("query_id"), "domain", F.col("embedding").alias("vector"))


ASKED = f"asked AS (SELECT chunk_id AS query_id, domain, embedding AS vector FROM chunks WHERE chunk_id % {QUERY_EVERY} = 0)"


def tenant_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenants of the vectors; every third has a threshold of its own, the others the default."""
    return vector_chunks(spark, sf_dir).select("domain").distinct().withColumn("rag_threshold", F.when(F.substring("domain", 2, 9).cast("int") % 3 == 0, F.lit(0.3)))


LIMITS = "limits AS (SELECT DISTINCT domain, CASE WHEN CAST(domain[2:] AS INTEGER) % 3 = 0 THEN 0.3 ELSE 0.25 END AS threshold FROM chunks)"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as stored messages, at one hour a conversation and one minute a turn."""
    c = table(spark, sf_dir, "conversations").filter("role <> 'system'")
    n = F.col("conv_id") * 7 + F.col("turn") * 13
    told = F.col("role") == "assistant"
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    ts = start + F.make_dt_interval(F.lit(0), F.col("conv_id").cast("int"), F.col("turn").cast("int"))
    score = (n % 100) / 100.0
    return c.select(
        F.concat(F.lit("t"), (F.col("conv_id") % 10).cast("string")).alias("domain"), F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_token"),
        F.col("turn").alias("seq"), "role", F.col("text").alias("content"), ts.alias("ts"), F.lit(None).cast("boolean").alias("seen_by_visitor"),
        F.when(told & (n % 5 != 4), F.when(n % 3 == 0, "large-model").otherwise("small-model")).alias("model"),
        F.when(told & (n % 4 != 3), score).alias("top_score"), F.when(told, score >= 0.3).alias("had_context"),
        F.when(n % 3 == 0, "complex").when(n % 3 == 1, "simple").alias("route"), "conv_id",
    )


MESSAGES = """messages AS (SELECT 't' || (conv_id % 10) AS domain, 's' || conv_id AS session_token, turn AS seq, role, text AS content,
  TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn) AS ts,
  CASE WHEN role = 'assistant' AND n % 5 <> 4 THEN CASE WHEN n % 3 = 0 THEN 'large-model' ELSE 'small-model' END END AS model,
  CASE WHEN role = 'assistant' AND n % 4 <> 3 THEN (n % 100) / 100.0 END AS top_score, CASE WHEN role = 'assistant' THEN (n % 100) / 100.0 >= 0.3 END AS had_context,
  CASE n % 3 WHEN 0 THEN 'complex' WHEN 1 THEN 'simple' END AS route, conv_id
  FROM (SELECT *, conv_id * 7 + turn * 13 AS n FROM conversations WHERE role <> 'system'))"""


def signalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant messages with signals put at their end by a rule of their number."""
    m = messages(spark, sf_dir).filter("role = 'assistant'")
    n = F.col("conv_id") + F.col("seq")
    q = F.concat(F.lit("Question "), (F.col("conv_id") % 4).cast("string"), F.lit(" about opening hours?"))
    tail = (
        F.when(n % 4 == 0, F.concat(F.lit(" [HANDOFF_REQUESTED: "), q, F.lit("]")))
        .when(n % 4 == 1, F.concat(F.lit("\n[HANDOFF_CANCEL: "), q, F.lit("]  ")))
        .when(n % 4 == 2, F.lit(" [OPTIONS: Yes | No || Maybe later |Call me| Five ] "))
        .otherwise(F.lit(" [OPTIONS: a | b] then more"))
    )
    return m.withColumn("reply", F.concat(F.coalesce("content", F.lit("")), tail))


SIGNALLED = """signalled AS (SELECT *, coalesce(content, '') || CASE (conv_id + seq) % 4
  WHEN 0 THEN ' [HANDOFF_REQUESTED: Question ' || (conv_id % 4) || ' about opening hours?]'
  WHEN 1 THEN chr(10) || '[HANDOFF_CANCEL: Question ' || (conv_id % 4) || ' about opening hours?]  '
  WHEN 2 THEN ' [OPTIONS: Yes | No || Maybe later |Call me| Five ] ' ELSE ' [OPTIONS: a | b] then more' END AS reply
  FROM messages WHERE role = 'assistant')"""


def metered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as visitor messages: the user is the tenant, every third pays."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").cast("string").alias("domain"), F.col("event_id").alias("message_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("user_id") % 3 == 0, "infinity").otherwise("free").alias("plan"),
    )


METERED = "metered AS (SELECT CAST(user_id AS VARCHAR) AS domain, event_id AS message_id, ts, CASE WHEN user_id % 3 = 0 THEN 'infinity' ELSE 'free' END AS plan FROM events)"


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as tenants."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    base = F.lit("2024-03-01 00:00:00").cast("timestamp")
    ago = lambda days: base - F.make_dt_interval(days.cast("int"))
    return c.select(
        F.concat(F.lit("c"), k.cast("string")).alias("domain"), F.col("c_name").alias("name"), F.when(F.col("c_mktsegment") == "BUILDING", "free").otherwise("infinity").alias("plan"),
        ago(k % 365).alias("created_at"), (k % 3 != 0).alias("refresh_enabled"), (k % 24).cast("int").alias("refresh_hour"), F.when(k % 2 == 0, "daily").otherwise("weekly").alias("refresh_interval"),
        F.when(k % 5 != 0, ago(k % 10)).alias("last_refresh_at"), (k * 7 % 160).cast("int").alias("message_count"), (k % 4 == 0).alias("church_mode"),
        F.when(k % 6 == 0, ago(k % 30)).alias("ministry_requested_at"), F.when(k % 2 == 0, F.concat(F.lit("+1-"), k.cast("string"))).alias("owner_phone"),
        F.when(k % 7 != 0, F.concat(F.lit("o"), k.cast("string"), F.lit("@example.com"))).alias("owner_email"),
        F.when(k % 3 == 0, F.array(F.lit("sms"), F.lit("email"))).when(k % 3 == 1, F.array(F.lit("sms"))).alias("quota_alert_channels"), k.alias("k"), F.lit(None).cast("string").alias("timezone"),
    )


TENANTS = """tenants AS (SELECT 'c' || k AS domain, c_name AS name, CASE WHEN c_mktsegment = 'BUILDING' THEN 'free' ELSE 'infinity' END AS plan,
  TIMESTAMP '2024-03-01' - to_days(CAST(k % 365 AS INTEGER)) AS created_at, k % 3 <> 0 AS refresh_enabled, k % 24 AS refresh_hour, CASE WHEN k % 2 = 0 THEN 'daily' ELSE 'weekly' END AS refresh_interval,
  CASE WHEN k % 5 <> 0 THEN TIMESTAMP '2024-03-01' - to_days(CAST(k % 10 AS INTEGER)) END AS last_refresh_at, CAST(k * 7 % 160 AS INTEGER) AS message_count, k % 4 = 0 AS church_mode,
  CASE WHEN k % 6 = 0 THEN TIMESTAMP '2024-03-01' - to_days(CAST(k % 30 AS INTEGER)) END AS ministry_requested_at, CASE WHEN k % 2 = 0 THEN '+1-' || k END AS owner_phone,
  CASE WHEN k % 7 <> 0 THEN 'o' || k || '@example.com' END AS owner_email, CASE k % 3 WHEN 0 THEN ['sms', 'email'] WHEN 1 THEN ['sms'] END AS quota_alert_channels, k
  FROM (SELECT *, c_custkey AS k FROM customer))"""


def payment_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as payment events of their customers, in order of the order key."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("seq"), F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.when(k % 5 == 0, "deleted").when(k % 5 == 1, "updated").when(k % 5 == 2, "payment_failed").otherwise("checkout").alias("type"),
        F.when((k % 5 != 2) & (k % 23 != 0), F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("domain"), F.concat(F.lit("cus"), F.col("o_custkey").cast("string")).alias("customer"),
        F.when(k % 2 == 0, "payment").otherwise("subscription").alias("mode"), F.when(k % 3 == 0, "past_due").otherwise("active").alias("status"), (k % 7 == 0).alias("addon"),
    )


PAYMENTS = """payments AS (SELECT o_orderkey AS seq, o_orderdate AS ts, CASE o_orderkey % 5 WHEN 0 THEN 'deleted' WHEN 1 THEN 'updated' WHEN 2 THEN 'payment_failed' ELSE 'checkout' END AS type,
  CASE WHEN o_orderkey % 5 <> 2 AND o_orderkey % 23 <> 0 THEN 'c' || o_custkey END AS domain, 'cus' || o_custkey AS customer, CASE WHEN o_orderkey % 2 = 0 THEN 'payment' ELSE 'subscription' END AS mode,
  CASE WHEN o_orderkey % 3 = 0 THEN 'past_due' ELSE 'active' END AS status, o_orderkey % 7 = 0 AS addon FROM orders)"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as snapshots of their customers."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("snapshot_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("domain"), F.lower("o_orderstatus").alias("mode"), F.col("o_orderdate").cast("timestamp").alias("created_at")
    )


def archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the archived chunks of those snapshots."""
    i = table(spark, sf_dir, "lineitem")
    return i.select(F.col("l_orderkey").cast("string").alias("snapshot_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("url"), F.col("l_linenumber").alias("chunk_index"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log rows."""
    e = table(spark, sf_dir, "events")
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_id") % 10 == 0, "warn").otherwise("info")
    return e.select(F.col("event_id").alias("log_id"), level.alias("level"), F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("domain"), F.col("props").alias("meta"), F.col("ts").cast("timestamp").alias("created_at"))


LOGS = """logs AS (SELECT event_id AS log_id, CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 10 = 0 THEN 'warn' ELSE 'info' END AS level, event_type AS source,
  CAST(user_id AS VARCHAR) AS domain, props AS meta, ts AS created_at FROM events)"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as users: each is a member of two tenants, of one of them twice; a few see everything."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    role = F.when(k % 3 == 0, "owner").when(k % 3 == 1, "agent").otherwise("stranger")
    at = lambda n: F.concat(F.lit("c"), (k * n % 97 + 1).cast("string"))
    member = lambda d, r, p: F.struct(d.alias("entity_domain"), r.alias("roles"), p.alias("permissions"))
    rows = F.array(
        member(at(3), F.array(role), F.array(F.lit("knowledge.view"), F.lit("billing.view"))),
        member(at(5), F.array(F.lit("readonly")), F.array().cast("array<string>")),
        member(at(3), F.array(F.lit("superadmin")), F.array().cast("array<string>")),
    )
    return s.select(F.concat(F.lit("u"), k.cast("string"), F.lit("@example.com")).alias("email"), (k % 50 == 0).alias("superadmin"), rows.alias("memberships"))
