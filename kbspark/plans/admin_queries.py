"""Queries of the dashboard and of administration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.operators import analytics as an
from kbspark.plans import views
from kbspark.plans.views import CHUNKS, LOGS, MESSAGES, TENANTS
from kbspark.sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def at(text: str):
    return F.lit(text).cast("timestamp")


def text_of(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@query(f"""WITH {MESSAGES}, t AS (SELECT DISTINCT domain FROM messages UNION SELECT 'none'), m AS (SELECT domain, count(DISTINCT session_token) AS conversations, count(*) AS messages FROM messages GROUP BY 1),
c AS (SELECT 't' || (label % 10) AS domain, count(*) AS chunks FROM embeddings GROUP BY 1), p AS (SELECT 't' || (page_id % 12) AS domain, count(*) AS pages, max(page_id) AS last FROM pages GROUP BY 1)
SELECT domain, coalesce(chunks, 0) AS chunks, coalesce(pages, 0) AS pages, coalesce(conversations, 0) AS conversations, coalesce(messages, 0) AS messages, last AS last_scraped_at
FROM t LEFT JOIN m USING (domain) LEFT JOIN c USING (domain) LEFT JOIN p USING (domain)""")
def a_tenant_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.messages(spark, sf_dir)
    named = lambda n, k: F.concat(F.lit("t"), (F.col(n) % k).cast("string")).alias("domain")
    owners = m.select("domain").union(m.select(F.lit("none"))).distinct()
    chunks = table(spark, sf_dir, "embeddings").select(named("label", 10))
    pages = table(spark, sf_dir, "pages").select(named("page_id", 12), F.col("page_id").alias("last_scraped_at"))
    return an.tenant_stats(owners, chunks, pages, m).select("domain", "chunks", "pages", "conversations", "messages", "last_scraped_at")


SINCE = "TIMESTAMP '2024-01-02'"
STATS = f"""{MESSAGES}, act AS (SELECT domain, session_token FROM messages GROUP BY 1, 2 HAVING max(ts) >= {SINCE}),
stats AS (SELECT domain, count(*) AS total, count(*) FILTER (contains(model, 'large')) AS large, count(*) FILTER (contains(model, 'small')) AS small, count(*) FILTER (had_context) AS with_context, avg(top_score) AS score
  FROM messages JOIN act USING (domain, session_token) WHERE role = 'assistant' AND model IS NOT NULL GROUP BY 1)"""


@query(f"WITH {STATS} SELECT domain, total, large, small, with_context, round(score, 6) AS avg_top_score FROM stats")
def a_model_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.model_stats(views.messages(spark, sf_dir), at("2024-01-02 00:00:00")).withColumn("avg_top_score", F.round("avg_top_score", 6))


@query(f"""WITH {STATS} SELECT domain, total, CAST(round(large / total * 100) AS INTEGER) AS large_pct, CAST(round(small / total * 100) AS INTEGER) AS small_pct,
  CAST(round(with_context / total * 100) AS INTEGER) AS with_context_pct, round(score, 3) AS avg_top_score FROM stats""")
def a_model_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.shares(an.model_stats(views.messages(spark, sf_dir), at("2024-01-02 00:00:00")))


@query(f"""WITH {CHUNKS}, g AS (SELECT domain, label, arg_min(source, (created_at, source)) AS source, count(*) AS count, min(created_at) AS created_at FROM chunks WHERE source IN ('manual', 'upload', 'owner_reply') GROUP BY 1, 2)
SELECT domain, label, source, count, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, row_number() OVER (PARTITION BY domain ORDER BY created_at DESC, label) AS position FROM g""".replace("ORDER BY created_at DESC", "ORDER BY g.created_at DESC"))
def a_kb_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = an.kb_entries(views.vector_chunks(spark, sf_dir))
    return rows.select("domain", "label", "source", "count", text_of("created_at"), F.col("position").cast("long").alias("position"))


@query(f"""WITH {CHUNKS}, p AS (SELECT DISTINCT domain, url FROM chunks UNION ALL SELECT DISTINCT domain, 'empty' FROM chunks),
s AS (SELECT domain, url, string_agg(CAST(length(content) AS VARCHAR), ',' ORDER BY chunk_index, length(content)) AS sizes FROM chunks GROUP BY 1, 2) SELECT domain, url, coalesce(sizes, '') AS sizes FROM p LEFT JOIN s USING (domain, url)""")
def a_page_chunk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.vector_chunks(spark, sf_dir)
    pages = c.select("domain", "url").distinct().union(c.select("domain", F.lit("empty")).distinct())
    return an.page_chunk_sizes(pages, c).select("domain", "url", F.array_join(F.col("sizes").cast("array<string>"), ",").alias("sizes"))


@query(f"""WITH {CHUNKS}, asked AS (SELECT DISTINCT domain, 'g' || (chunk_id // 100) AS url FROM chunks UNION SELECT domain, url FROM chunks),
f AS (SELECT DISTINCT c.domain, a.url AS asked, chunk_id, chunk_index FROM chunks c JOIN asked a ON a.domain = c.domain AND (c.url = a.url OR list_contains(source_urls, a.url)))
SELECT domain, asked, chunk_id, row_number() OVER (PARTITION BY domain, asked ORDER BY chunk_index, chunk_id) AS position FROM f""")
def a_chunks_for_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.vector_chunks(spark, sf_dir)
    asked = c.select("domain", F.element_at("source_urls", 2).alias("url")).union(c.select("domain", "url"))
    return an.chunks_for_url(c, asked).select("domain", "asked", "chunk_id", F.col("position").cast("long").alias("position"))


@query(f"""WITH {MESSAGES}, g AS (SELECT domain, session_token, count(*) AS messages, max(ts) AS last_active_at, arg_max(coalesce(content, ''), seq) AS last FROM messages GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY last_active_at DESC, session_token) AS position, count(*) OVER (PARTITION BY domain) AS total FROM g)
SELECT domain, session_token, messages, CASE WHEN length(last) > 80 THEN left(last, 80) || '…' ELSE last END AS preview, position, CAST(ceil(position / 4) AS BIGINT) AS page, CAST(ceil(total / 4) AS BIGINT) AS pages, total FROM n""")
def a_conversation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = an.conversation_list(views.messages(spark, sf_dir), size=4)
    return rows.select("domain", "session_token", "messages", F.coalesce("preview", F.lit("")).alias("preview"), F.col("position").cast("long").alias("position"), F.col("page").cast("long").alias("page"), F.col("pages").cast("long").alias("pages"), "total")


@query(f"""WITH {views.CRAWL}, f AS (SELECT domain, url FROM crawl WHERE regexp_matches(url, '(?i)/NEWS/') AND priority = 'high')
SELECT domain, url, row_number() OVER (PARTITION BY domain ORDER BY url) AS position, CAST(ceil(row_number() OVER (PARTITION BY domain ORDER BY url) / 5) AS BIGINT) AS page, count(*) OVER (PARTITION BY domain) AS total FROM f""")
def a_page_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = views.crawl(spark, sf_dir).select("domain", "url", "priority", F.lit(False).alias("used_renderer"))
    rows = an.page_search(pages, "/NEWS/", rendered=False, priority="high", size=5)
    return rows.select("domain", "url", F.col("position").cast("long").alias("position"), F.col("page").cast("long").alias("page"), "total")


@query(f"""WITH {LOGS}, f AS (SELECT * FROM logs WHERE level = 'info' AND created_at >= TIMESTAMP '2024-02-10' - INTERVAL 30 DAY)
SELECT log_id, row_number() OVER (ORDER BY created_at DESC, log_id) AS position, CAST(ceil(row_number() OVER (ORDER BY created_at DESC, log_id) / 50) AS BIGINT) AS page, count(*) OVER () AS total FROM f""")
def a_log_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = an.log_search(views.logs(spark, sf_dir), at("2024-02-10 00:00:00"), level="info")
    return rows.select("log_id", F.col("position").cast("long").alias("position"), F.col("page").cast("long").alias("page"), "total")


_USERS = """users AS (SELECT 'u' || s_suppkey || '@example.com' AS email, s_suppkey % 50 = 0 AS superadmin, s_suppkey AS k, 'c' || (s_suppkey * 3 % 97 + 1) AS d1, 'c' || (s_suppkey * 5 % 97 + 1) AS d2 FROM supplier)"""


@query(f"""WITH {TENANTS}, {_USERS}, seen AS (SELECT email, domain FROM users, tenants WHERE superadmin UNION SELECT email, unnest([d1, d2]) FROM users WHERE NOT superadmin)
SELECT email, domain, row_number() OVER (PARTITION BY email ORDER BY created_at DESC, domain) AS position FROM seen JOIN tenants USING (domain)""")
def a_tenants_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = an.tenants_visible(views.users(spark, sf_dir), views.tenants(spark, sf_dir))
    return rows.withColumn("position", F.col("position").cast("long"))


_PRESETS = ", ".join(f"('{r}', '{p}')" for r, ps in an.ROLES.items() for p in ps)
MEMBERS = f"""{_USERS}, members AS (SELECT email, d1 AS domain, CASE k % 3 WHEN 0 THEN 'owner' WHEN 1 THEN 'agent' ELSE 'stranger' END AS role, ['knowledge.view', 'billing.view'] AS granted FROM users
  UNION ALL SELECT email, d2, 'readonly', [] FROM users WHERE d1 <> d2)"""


@query(f"""WITH {MEMBERS}, presets(role, permission) AS (VALUES {_PRESETS})
SELECT email, domain, permission FROM members JOIN presets USING (role) UNION SELECT email, domain, unnest(granted) FROM members""")
def a_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.resolve_permissions(views.users(spark, sf_dir))


@query(f"WITH {MEMBERS} SELECT domain, email, role AS roles FROM members")
def a_team(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.team(views.users(spark, sf_dir)).withColumn("roles", F.array_join("roles", ","))


@query("""SELECT p_partkey AS token FROM part WHERE p_partkey % 3 <> 0 AND (p_partkey % 5 = 0 OR p_size > 25)""")
def a_pending_invites(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k, base = F.col("p_partkey"), at("2024-01-01 00:00:00")
    invites = p.select(k.alias("token"), F.when(k % 5 != 0, base + F.make_dt_interval(F.col("p_size"))).alias("expires_at"), F.when(k % 3 == 0, base).alias("accepted_at"))
    return an.pending_invites(invites, base + F.expr("INTERVAL 25 DAYS")).select("token")


@query("""SELECT p_partkey AS code, p_type AS type FROM part WHERE p_partkey % 4 <> 0 AND (p_partkey % 6 = 0 OR p_size < 30) AND (p_partkey % 5 = 0 OR p_size > 10) AND p_type = 'ECONOMY'""")
def a_redeemable_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k, base = F.col("p_partkey"), at("2024-01-01 00:00:00")
    codes = p.select(
        k.alias("code"), F.col("p_type").alias("type"), (k % 4 != 0).alias("active"), F.when(k % 6 != 0, F.lit(30)).alias("max_uses"), F.col("p_size").alias("use_count"),
        F.when(k % 5 != 0, base + F.make_dt_interval(F.col("p_size"))).alias("expires_at"),
    )
    return an.redeemable_codes(codes, base + F.expr("INTERVAL 10 DAYS"), "ECONOMY").select("code", "type")


@query(f"WITH {TENANTS} SELECT domain FROM tenants WHERE ministry_requested_at IS NOT NULL AND NOT church_mode")
def a_ministry_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.ministry_requests(views.tenants(spark, sf_dir)).select("domain")


@query(f"""WITH {TENANTS} SELECT domain, message_count AS used, CASE WHEN plan = 'free' THEN 100 END AS "limit", CASE WHEN plan = 'free' THEN least(100, message_count) END AS pct FROM tenants""")
def a_usage_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.usage_panel(views.tenants(spark, sf_dir))


@query(f"""WITH gone AS (SELECT 'c' || c_custkey AS domain FROM customer WHERE c_custkey % 10 = 0), s AS (SELECT CAST(o_orderkey AS VARCHAR) AS snapshot_id, 'c' || o_custkey AS domain FROM orders),
{TENANTS} SELECT 'tenants' AS "table", count(*) AS kept FROM tenants WHERE domain NOT IN (SELECT domain FROM gone) UNION ALL SELECT 'snapshots', count(*) FROM s WHERE domain NOT IN (SELECT domain FROM gone)
UNION ALL SELECT 'archived_chunks', count(*) FROM lineitem WHERE CAST(l_orderkey AS VARCHAR) NOT IN (SELECT snapshot_id FROM s JOIN gone USING (domain))
UNION ALL SELECT 'deleted', (SELECT count(*) FROM tenants JOIN gone USING (domain)) + (SELECT count(*) FROM s JOIN gone USING (domain)) + (SELECT count(*) FROM lineitem JOIN s ON CAST(l_orderkey AS VARCHAR) = snapshot_id JOIN gone USING (domain))
UNION ALL SELECT 'memberships', sum(m) FROM (SELECT (CASE WHEN d1 NOT IN (SELECT domain FROM gone) THEN 2 ELSE 0 END) + (CASE WHEN d2 NOT IN (SELECT domain FROM gone) THEN 1 ELSE 0 END) AS m FROM (SELECT * FROM (SELECT 'c' || (s_suppkey * 3 % 97 + 1) AS d1, 'c' || (s_suppkey * 5 % 97 + 1) AS d2 FROM supplier)))""")
def a_purge_tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = views.tenants(spark, sf_dir)
    gone = owners.filter("k % 10 = 0")
    tables = {"tenants": owners.select("domain"), "snapshots": views.snapshots(spark, sf_dir), "users": views.users(spark, sf_dir)}
    archive = views.archived(spark, sf_dir).join(tables["snapshots"].select("snapshot_id", "domain"), "snapshot_id")
    left, deleted = an.purge_tenants(tables | {"archived_chunks": archive}, gone)
    count = lambda name, df: df.agg(F.count("*").alias("kept")).select(F.lit(name).alias("table"), "kept")
    rows = count("tenants", left["tenants"]).union(count("snapshots", left["snapshots"])).union(count("archived_chunks", left["archived_chunks"]))
    rows = rows.union(deleted.agg(F.sum("deleted").alias("kept")).select(F.lit("deleted"), "kept"))
    return rows.union(left["users"].agg(F.sum(F.size("memberships")).alias("kept")).select(F.lit("memberships"), "kept"))


@query(f"""WITH {MESSAGES}, p AS (SELECT *, lag(content) OVER w AS q, lag(role) OVER w AS asker FROM messages WINDOW w AS (PARTITION BY domain, session_token ORDER BY seq))
SELECT domain, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, lower(trim(q)) AS question, count(*) AS times FROM p WHERE role = 'assistant' AND asker = 'user' AND NOT coalesce(had_context, false) GROUP BY 1, 2, 3""")
def d_unanswered_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.unanswered_questions(views.messages(spark, sf_dir)).withColumn("week", F.date_format("week", "yyyy-MM-dd"))


STUDY = f"""{MESSAGES}, s AS (SELECT domain, session_token, count(*) AS n, CAST(min(ts) AS DATE) AS day FROM messages GROUP BY 1, 2),
study AS (SELECT domain, count(*) AS conversations, CAST(sum(n) AS BIGINT) AS messages, round(sum(n) / count(*), 6) AS per_conversation, round(count(*) / count(DISTINCT day), 6) AS per_day FROM s GROUP BY 1)"""


@query(f"WITH {STUDY} SELECT * FROM study")
def d_usage_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.usage_study(views.messages(spark, sf_dir)).withColumns({"per_conversation": F.round("per_conversation", 6), "per_day": F.round("per_day", 6)})


@query(f"WITH {STUDY} SELECT count(*) AS tenants, count(*) FILTER (messages < 40) AS under_40, count(*) FILTER (messages < 55) AS under_55 FROM study")
def d_usage_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.usage_tiers(an.usage_study(views.messages(spark, sf_dir)), (40, 55))
