"""Queries of the knowledge base: text, chunks, crawl diff, snapshots, writes, retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbspark.functions import text as t
from kbspark.functions.chunking import TARGET
from kbspark.functions.html import page_column
from kbspark.operators import chunks as ch
from kbspark.operators import crawl as cr
from kbspark.operators import paragraphs as pa
from kbspark.operators import retrieval as rt
from kbspark.operators import scans
from kbspark.operators import snapshots as sn
from kbspark.plans import build, refresh_job, serve, views
from kbspark.plans.views import ASKED, CHUNKS, CRAWL, LIMITS, RE2_WS, STORED
from kbspark.schemas import CHUNKS as CHUNK_SCHEMA
from kbspark.sources.archive import ChunkArchive
from kbspark.sources.pages import crawled_pages, marked_uploads, site_domain, write_uploads
from kbspark.sources.shared import saved, setting, shared_folder
from kbspark.sources.tables import spread, table
from kbspark.sources.writes import replace_chunks, upsert_pages



def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


_TRIM = f"regexp_replace(x, '^{RE2_WS}+|{RE2_WS}+$', '', 'g')"
_KEEP = r"""(length(bare) >= CASE WHEN starts_with(p, '[SB]') THEN 4 ELSE 20 END
  OR regexp_matches(bare, '^\[H[123]\] ') OR regexp_matches(bare, '[^\t\n\x0b\f\r ]+@[^\t\n\x0b\f\r ]+\.[^\t\n\x0b\f\r ]+') OR regexp_matches(bare, '\(?\d{3}\)?[\s.\-]\d{3}[\s.\-]\d{4}')
  OR regexp_matches(bare, '[$€£¥]\s*\d[\d.,]*') OR regexp_matches(bare, '(?i)\d{1,2}(:\d{2})?\s*(am|pm|a\.m\.|p\.m\.)')
  OR regexp_matches(bare, '(?i)\b(suite|ste\.?|apt\.?|unit|floor|fl\.?)\s*[\w\d-]+'))"""
PARAS = f"""{CRAWL},
cut AS (SELECT domain, page_seq, url, list_filter(list_transform(regexp_split_to_array(text, '\\n+'), lambda x: {_TRIM}), lambda x: x <> '') AS ps FROM crawl WHERE text IS NOT NULL),
each AS (SELECT domain, page_seq, url, unnest(range(len(ps))) AS idx, unnest(ps) AS p FROM cut),
kept AS (SELECT * FROM (SELECT *, regexp_replace(p, '^(\\[SB\\])+', '') AS bare FROM each) WHERE {_KEEP}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY domain, sha256(bare) ORDER BY page_seq, idx) AS rn FROM kept WHERE length(bare) <= 200),
deduped AS (SELECT domain, page_seq, url, idx, p FROM ranked WHERE rn = 1 OR (rn <= 5 AND regexp_matches(bare, '^\\[H[123]\\] '))
  UNION ALL SELECT domain, page_seq, url, idx, p FROM kept WHERE length(bare) > 200)"""


@query(f"WITH {PARAS} SELECT page_seq, CAST(idx AS INTEGER) AS idx, bare AS para FROM kept")
def p_kept_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pa.split_pages(views.crawl(spark, sf_dir))
    return rows.select("page_seq", "idx", t.strip_block_marker(F.col("para")).alias("para"))


@query(f"WITH {PARAS} SELECT domain, page_seq, CAST(idx AS INTEGER) AS idx, p AS para FROM deduped")
def p_dedup_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pa.dedup_paragraphs(pa.split_pages(views.crawl(spark, sf_dir))).select("domain", "page_seq", "idx", "para")


@query(f"""WITH {PARAS}, sizes AS (SELECT page_seq, string_agg(p, chr(10) || chr(10) ORDER BY idx) AS text FROM deduped GROUP BY 1)
SELECT page_seq, coalesce(text, '') AS text, coalesce(length(text), 0) AS filtered_len, coalesce(length(text), 0) < 300 AS thin FROM crawl LEFT JOIN (SELECT page_seq, text FROM sizes) USING (page_seq)""".replace("FROM crawl LEFT JOIN", "FROM (SELECT page_seq FROM crawl) LEFT JOIN"))
def p_rebuilt_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = views.crawl(spark, sf_dir)
    rows = pa.rebuild_pages(pages, pa.dedup_paragraphs(pa.split_pages(pages)))
    return rows.select("page_seq", F.array_join("paras", "\n\n").alias("text"), F.col("filtered_len").cast("long").alias("filtered_len"), "thin")


LENGTHS = f"""{PARAS}, est AS (SELECT page_seq, sum(length(bare)) + 2 * (count(*) - 1) AS n FROM kept GROUP BY 1),
crawled AS (SELECT crawl.*, coalesce(est.n, 0) AS content_len FROM crawl LEFT JOIN est USING (page_seq))"""


@query(f"WITH {LENGTHS} SELECT page_seq, CAST(content_len AS BIGINT) AS content_len FROM crawled")
def p_content_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pa.estimate_content_len(views.crawl(spark, sf_dir)).select("page_seq", F.col("content_len").cast("long").alias("content_len"))


_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1))"
_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


@query(f"""SELECT page_id, {_HOST} || CASE {_PATH} WHEN '' THEN '/' ELSE {_PATH} END AS url_key,
  regexp_extract(url, '^([a-z]+)://', 1) || '://' || {_HOST} || regexp_extract(regexp_replace({_PATH}, '/$', ''), '^(.+)/[^/]*$', 1) || '/' AS group_url,
  regexp_replace({_HOST}, '^www\\.', '') AS site, CASE WHEN regexp_matches(url, '(?i)/(menu|hours|events|specials|news|blog|sermons|schedule|calendar)') THEN 'high' ELSE 'normal' END AS priority,
  regexp_extract({_HOST}, '(([^.]+\\.){{0,2}}[^.]+)$', 1) AS domain FROM pages""")
def t_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", t.url_key(u).alias("url_key"), t.group_url(u).alias("group_url"), t.site_of(u).alias("site"), t.priority(u).alias("priority"), site_domain(u).alias("domain"))


_MONEY = r"[$€£¥]\s*\d[\d.,]*"


@query(f"""SELECT doc_id, sha256(text) AS content_hash, regexp_matches(text, '{_MONEY}') AS has_price, regexp_matches(text, '{_MONEY}\\s*[-–—]\\s*[$€£¥]?\\s*\\d[\\d.,]*') AS has_range,
  doc_id % 2 = 0 AND (doc_id % 3 = 0 OR regexp_matches(text, '{_MONEY}\\s*[-–—]\\s*[$€£¥]?\\s*\\d[\\d.,]*') OR NOT regexp_matches(text, '{_MONEY}')) AS sweep FROM documents""")
def t_hash_and_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, n = F.col("text"), F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id", t.content_hash(x).alias("content_hash"), t.has_price(x).alias("has_price"), t.has_price_range(x).alias("has_range"), t.needs_variant_sweep(x, n % 2 == 0, n % 3 == 0).alias("sweep")
    )


@query("""SELECT page_id AS page_seq, url, sha256(html) AS html_hash FROM pages WHERE html IS NOT NULL AND NOT contains(html, chr(0))""")
def io_crawled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawled_pages(table(spark, sf_dir, "pages")).select("page_seq", "url", F.sha2("html", 256).alias("html_hash"))


@query()
def t_extracted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = build.extracted_pages(spread(table(spark, sf_dir, "pages")))
    return rows.select("page_seq", "url", "text", "content_hash", "priority", F.size("links").alias("n_links"), "needs_render")


@query()
def c_page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.chunk_texts(views.crawl(spark, sf_dir)).select("page_seq", "url", "chunk_index", "content", "page_h1", "section_h2", "label")


#: Thin pages as cards in page order; a card opens a pack, or joins the one before it while that has room.
CARDS = f"""{LENGTHS}, parts AS (SELECT page_seq, idx, p, regexp_replace(p, '^(\\[SB\\])+', '') AS bare, starts_with(p, '[H1] ') AS title FROM each),
body AS (SELECT page_seq, string_agg(bare, chr(10) || chr(10) ORDER BY idx) AS body FROM parts WHERE NOT title AND {_KEEP} GROUP BY 1),
heads AS (SELECT page_seq, arg_min(nullif({_TRIM.replace('(x,', '(p[6:],')}, ''), idx) AS h1 FROM parts WHERE title GROUP BY 1),
cards AS (SELECT domain, page_seq, url, h1, regexp_extract(url, '^(.*/)[^/]*$', 1) AS grp, '[Source: ' || url || ']' || coalesce(chr(10) || '[H1] ' || h1, '') || coalesce(chr(10) || chr(10) || body, '') AS card
  FROM crawled LEFT JOIN body USING (page_seq) LEFT JOIN heads USING (page_seq) WHERE content_len < 300),
dealt AS (SELECT *, row_number() OVER (PARTITION BY domain, grp ORDER BY page_seq, url) AS k FROM cards),
packed AS (SELECT domain, grp, k, CAST(0 AS BIGINT) AS pack, length(card) AS size FROM dealt WHERE k = 1
  UNION ALL SELECT d.domain, d.grp, d.k, CASE WHEN p.size > 0 AND p.size + length(d.card) + 10 > {TARGET} THEN p.pack + 1 ELSE p.pack END, CASE WHEN p.size > 0 AND p.size + length(d.card) + 10 > {TARGET} THEN 0 ELSE p.size END + length(d.card)
  FROM packed p JOIN dealt d ON d.domain = p.domain AND d.grp = p.grp AND d.k = p.k + 1)"""


@query(f"""WITH RECURSIVE {CARDS}, chunked AS (SELECT domain, grp, pack, string_agg(card, chr(10) || chr(10) ORDER BY k) AS cards, list(h1 ORDER BY k) FILTER (h1 IS NOT NULL) AS titles, count(*) AS n FROM dealt JOIN packed USING (domain, grp, k) GROUP BY 1, 2, 3)
SELECT domain, grp AS url, CAST(pack AS INTEGER) AS chunk_index, {_TRIM.replace('(x,', "('[Source: ' || grp || ']' || repeat(chr(10), 4) || cards,")} AS content,
  CASE WHEN titles IS NULL THEN 'Group' ELSE array_to_string(titles[1:3], ', ') || CASE WHEN len(titles) > 3 THEN ', …' ELSE '' END END AS label, CAST(n AS INTEGER) AS n_urls FROM chunked""")
def c_thin_group_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = pa.estimate_content_len(views.crawl(spark, sf_dir)).filter(F.col("content_len") < pa.THIN_PAGE)
    return ch.group_thin_pages(pages).select("domain", "url", "chunk_index", "content", "label", F.size("source_urls").alias("n_urls"))


@query("""SELECT source AS domain, doc_id AS page_seq, sha256(text) AS content_hash FROM documents
  QUALIFY row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) = 1""")
def c_dedup_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("domain"), F.col("doc_id").alias("page_seq"), F.lit(0).alias("chunk_index"), F.lit("").alias("url"), F.col("text").alias("content"))
    return ch.dedup_chunks(d).select("domain", "page_seq", "content_hash")


@query()
def c_embedded_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("domain"), F.lit("upload").alias("source"), F.col("doc_id").cast("string").alias("label"), "text")
    rows = ch.embed_chunks(ch.entry_chunks(d), ch.hashing_embedder())
    return rows.select("domain", "source", "label", "url", F.sha2("content", 256).alias("content_hash"), F.size("embedding").alias("dim"))


@query(f"""WITH {views.MESSAGES}, r AS (SELECT domain, conv_id, seq, role, content, lag(content) OVER w AS q, lag(role) OVER w AS asker FROM messages WINDOW w AS (PARTITION BY domain, session_token ORDER BY seq))
SELECT domain, 'owner-reply://' || domain AS url, 'Q: ' || q || chr(10) || 'A: ' || content AS content, 'owner_reply' AS source, left(q, 120) AS label FROM r
WHERE role = 'assistant' AND asker = 'user' AND (conv_id % 3 = 0 OR (conv_id % 3 = 1 AND conv_id % 2 = 0))""")
def c_owner_reply_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("domain", "session_token").orderBy("seq")
    m = views.messages(spark, sf_dir).withColumns({"q": F.lag("content").over(order), "asker": F.lag("role").over(order)}).filter("role = 'assistant' AND asker = 'user'")
    add = F.when(F.col("conv_id") % 3 == 0, F.lit(True)).when(F.col("conv_id") % 3 == 2, F.lit(False))
    replies = m.select("domain", F.array("q").alias("answered"), F.col("content").alias("reply"), add.alias("add_to_kb"), (F.col("conv_id") % 2 == 0).alias("tenant_default"))
    return ch.owner_reply_chunks(replies)


def built(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(build.first_of_each_url(crawled_pages(table(spark, sf_dir, "pages"))))
    return build.build_chunks(pages.withColumn("text", page_column(F.col("html"))["text"]).drop("html"))


@query()
def w1_chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).groupBy("domain").agg(F.count("*").alias("chunks"), F.count_distinct("url").alias("urls"), F.sum(F.length("content")).alias("chars"))


@query()
def w1_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = build.stored_chunks(built(spark, sf_dir), ch.hashing_embedder(), now())
    return whole.select("chunk_id", "domain", "url", "content", "source", "label", "chunk_index", F.size("source_urls").alias("n_urls"), F.size("embedding").alias("dim"))


@query()
def w2_refresh_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, fresh, _ = build.refresh(views.crawl(spark, sf_dir), views.stored_pages(spark, sf_dir))
    return fresh.select("domain", "url", "chunk_index", "content_hash", "label")


_SITE = f"regexp_extract({_HOST}, '(([^.]+\\.){{0,2}}[^.]+)$', 1)"


@query(f"""WITH fine AS (SELECT *, {_HOST} || CASE {_PATH} WHEN '' THEN '/' ELSE {_PATH} END AS url_key, {_HOST} AS host, {_SITE} AS domain FROM pages WHERE html IS NOT NULL AND NOT contains(html, chr(0))),
links AS (SELECT domain, host, regexp_extract(url, '^([^:]+://[^/?#]*)', 1) AS origin, unnest(regexp_extract_all(html, '<a [^>]*href="(/[^"]*)"', 1)) AS href FROM fine),
own AS (SELECT domain, host || regexp_extract(href, '^[^?#]*') AS url_key, min(origin || href) AS url, max(host <> domain) AS subdomain FROM links GROUP BY 1, 2),
seen AS (SELECT DISTINCT domain, url_key FROM fine), fetched AS (SELECT domain, count(*) AS n FROM seen GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY subdomain DESC, url_key) AS rank FROM own ANTI JOIN seen USING (domain, url_key))
SELECT domain, url_key, url, subdomain, CAST(rank AS INTEGER) AS rank FROM ranked JOIN fetched USING (domain) WHERE rank + n <= {cr.MAX_PAGES}""")
def j_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(crawled_pages(table(spark, sf_dir, "pages")))
    linked = pages.select("domain", F.col("domain").alias("base_host"), "url", page_column(F.col("html"), keep_nav_links=True)["links"].alias("links"))
    return cr.frontier_step(linked, pages.select("domain", t.url_key(F.col("url")).alias("url_key")))


DIFF = f"""{LENGTHS}, {STORED},
diffed AS (SELECT c.*, s.content_hash IS DISTINCT FROM c.content_hash AS hash_changed, content_len < 300 AS thin FROM crawled c LEFT JOIN stored s USING (page_seq)),
classed AS (SELECT *, CASE WHEN thin THEN CASE WHEN hash_changed THEN 'thin_changed' ELSE 'unchanged' END WHEN hash_changed OR priority = 'high' THEN 'changed' ELSE 'unchanged' END AS change,
  regexp_extract(url, '^(.*/)[^/]*$', 1) AS grp FROM diffed)"""


def diffed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cr.diff_pages(views.crawl(spark, sf_dir), views.stored_pages(spark, sf_dir))


@query(f"WITH {DIFF} SELECT page_seq, hash_changed, thin, change, hash_changed OR (priority = 'high' AND length(text) >= 300) AS hash_update FROM classed")
def j_diff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = diffed(spark, sf_dir)
    updates = cr.page_hash_updates(d).select("page_seq", F.lit(True).alias("hash_update"))
    return d.join(updates, "page_seq", "left").select("page_seq", "hash_changed", "thin", "change", F.coalesce("hash_update", F.lit(False)).alias("hash_update"))


@query(f"WITH {DIFF} SELECT domain, page_seq, grp AS \"group\" FROM classed WHERE thin AND (domain, grp) IN (SELECT (domain, grp) FROM classed WHERE thin AND hash_changed)")
def j_changed_thin_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cr.changed_thin_groups(diffed(spark, sf_dir)).select("domain", "page_seq", "group")


@query(f"""WITH {DIFF} SELECT domain, count(*) AS checked, count(*) FILTER (change <> 'unchanged') AS changed, count(*) FILTER (change = 'unchanged') AS unchanged,
  count(*) FILTER (change = 'changed') AS chunks_updated, '2m 5s' AS duration FROM classed GROUP BY 1""")
def j_refresh_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = diffed(spark, sf_dir)
    return cr.refresh_summary(d, d.filter("change = 'changed'").select("domain"), F.lit(125.7))


@query("""SELECT source AS domain, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1""")
def a_crawl_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cr.crawl_totals(views.crawl(spark, sf_dir))


@query(f"WITH {CHUNKS} SELECT domain, url, count(*) AS chunk_count FROM chunks GROUP BY 1, 2")
def a_chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cr.chunk_counts(views.vector_chunks(spark, sf_dir))


@query(f"""WITH {views.TENANTS} SELECT domain FROM tenants WHERE refresh_enabled AND refresh_hour = 5
  AND (refresh_interval = 'daily' OR last_refresh_at IS NULL OR last_refresh_at <= TIMESTAMP '2024-03-01 05:00:00' - INTERVAL 6 DAY)""")
def j_refresh_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cr.refresh_due(views.tenants(spark, sf_dir), F.lit("2024-03-01 05:00:00").cast("timestamp")).select("domain")


@query(f"""WITH {CHUNKS}, old AS (SELECT * FROM chunks WHERE source IS NULL OR source NOT IN ('manual', 'upload', 'owner_reply'))
SELECT domain, 'full' AS mode, count(*) AS chunk_count, count(DISTINCT url) AS page_count, array_to_string(list_sort(list(DISTINCT url)), ',') AS affected FROM old GROUP BY 1""")
def s_create_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, _ = sn.create_snapshot(views.vector_chunks(spark, sf_dir), F.lit("full"), now())
    return made.select("domain", "mode", "chunk_count", "page_count", F.array_join("affected_urls", ",").alias("affected"))


_SNAPS = "snaps AS (SELECT CAST(o_orderkey AS VARCHAR) AS snapshot_id, 'c' || o_custkey AS domain, o_orderdate AS created_at FROM orders)"


@query(f"""WITH {_SNAPS}, kept AS (SELECT * FROM snaps QUALIFY row_number() OVER (PARTITION BY domain ORDER BY created_at DESC, snapshot_id) <= 10)
SELECT snapshot_id, count(l_orderkey) AS chunks FROM kept LEFT JOIN lineitem ON CAST(l_orderkey AS VARCHAR) = snapshot_id GROUP BY 1""")
def s_prune_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, chunks = sn.prune_snapshots(views.snapshots(spark, sf_dir), views.archived(spark, sf_dir))
    return kept.join(chunks.groupBy("snapshot_id").agg(F.count("*").alias("chunks")), "snapshot_id", "left").select("snapshot_id", F.coalesce("chunks", F.lit(0)).alias("chunks"))


@query(f"WITH {_SNAPS} SELECT snapshot_id, domain, row_number() OVER (PARTITION BY domain ORDER BY created_at DESC, snapshot_id) AS position FROM snaps")
def s_list_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sn.list_snapshots(views.snapshots(spark, sf_dir)).select("snapshot_id", "domain", F.col("position").cast("long").alias("position"))


_ARCH = """arch AS (SELECT chunk_id + 1000000 AS chunk_id, domain, url, 'scraped' AS source FROM chunks WHERE chunk_id % 3 = 0 AND (source IS NULL OR source = 'scraped'))"""


def _fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = views.vector_chunks(spark, sf_dir).filter("chunk_id % 3 = 0 AND (source IS NULL OR source = 'scraped')")
    return old.withColumns({"chunk_id": F.col("chunk_id") + 1000000, "source": F.lit("scraped")})


@query(f"""WITH {CHUNKS}, {_ARCH} SELECT chunk_id, domain, url, source FROM chunks WHERE source IN ('manual', 'upload', 'owner_reply') OR (domain, url) NOT IN (SELECT (domain, url) FROM arch)
UNION ALL SELECT chunk_id, domain, url, source FROM arch""")
def s_restore_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = _fresh(spark, sf_dir).withColumn("snapshot_id", F.lit("s1"))
    return sn.restore_snapshot(views.vector_chunks(spark, sf_dir), back, F.lit("s1")).select("chunk_id", "domain", "url", "source")


@query(ORACLES["s_restore_snapshot"])
def io_replace_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_chunks(views.vector_chunks(spark, sf_dir), _fresh(spark, sf_dir)).select("chunk_id", "domain", "url", "source")


@query(f"""WITH {CRAWL}, {STORED}, new AS (SELECT * FROM crawl WHERE page_seq % 5 <> 0)
SELECT page_seq, coalesce(n.content_hash, s.content_hash) AS content_hash, s.has_variants, CASE WHEN n.page_seq IS NOT NULL THEN '2024-02-01 00:00:00' ELSE '2024-01-01 00:00:00' END AS last_scraped_at,
  CASE WHEN n.page_seq IS NOT NULL AND s.content_hash IS DISTINCT FROM n.content_hash THEN '2024-02-01 00:00:00' ELSE '2024-01-01 00:00:00' END AS last_changed_at
FROM stored s FULL JOIN new n USING (page_seq)""")
def io_upsert_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = views.crawl(spark, sf_dir).filter("page_seq % 5 <> 0").withColumns({"url": F.regexp_replace("url", "^https:", "http:"), "used_renderer": F.lit(False), "has_variants": F.lit(None).cast("boolean"), "chunk_count": F.lit(2)})
    rows = upsert_pages(views.stored_pages(spark, sf_dir), new, now())
    return rows.select(F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("page_seq"), "content_hash", "has_variants", stamp("last_scraped_at"), stamp("last_changed_at"))


TOP = f"""{CHUNKS}, {ASKED}, {LIMITS},
scored AS (SELECT query_id, q.domain, chunk_id, list_dot_product(vector, embedding) AS score FROM asked q JOIN chunks c USING (domain)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id) AS rank FROM scored) WHERE rank <= 10),
primary_hits AS (SELECT top.*, threshold, url, source, content FROM top JOIN limits USING (domain) JOIN chunks USING (chunk_id) WHERE score >= threshold)""".replace(
    "JOIN chunks USING (chunk_id)", "JOIN (SELECT chunk_id, url, source, content FROM chunks) USING (chunk_id)"
)
SIBLINGS = f"""{TOP}, hit_pages AS (SELECT DISTINCT query_id, domain, url, threshold FROM primary_hits WHERE source IS DISTINCT FROM 'owner_reply'),
siblings AS (SELECT query_id, p.domain, chunk_id, list_dot_product(vector, embedding) AS score, url, content, source FROM hit_pages p JOIN chunks USING (domain, url) JOIN (SELECT query_id, vector FROM asked) USING (query_id)
  WHERE source IS DISTINCT FROM 'owner_reply' AND list_dot_product(vector, embedding) >= greatest(0.05, threshold - 0.15) AND (query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM primary_hits))"""
PACKED = f"""{SIBLINGS}, lined AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY kind, round(score, 12) DESC, chunk_id) AS spot FROM (
  SELECT query_id, chunk_id, score, url, content, 0 AS kind FROM primary_hits WHERE source IS DISTINCT FROM 'owner_reply' UNION ALL SELECT query_id, chunk_id, score, url, content, 1 FROM siblings)),
sized AS (SELECT *, coalesce(sum(length(content) + 2) OVER (PARTITION BY query_id ORDER BY spot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(content) <= 6000 AS fits FROM lined),
fitting AS (SELECT *, min(CAST(fits AS INTEGER)) OVER (PARTITION BY query_id ORDER BY spot) AS ok FROM sized),
first_urls AS (SELECT query_id, url, min(spot) AS spot FROM fitting WHERE ok = 1 GROUP BY 1, 2)"""


def top(spark: SparkSession, sf_dir: str):
    chunks, asked = views.vector_chunks(spark, sf_dir), views.vector_queries(spark, sf_dir)
    hits = rt.vector_topk(asked, chunks)
    return chunks, asked, hits, rt.primary_hits(hits, chunks, views.tenant_limits(spark, sf_dir), default=0.25)


@query(f"WITH {TOP} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM top")
def v_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(spark, sf_dir)[2].select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {CHUNKS}, b AS (SELECT chunk_id, embedding, lag(embedding) OVER (PARTITION BY domain, url ORDER BY chunk_index) AS before FROM chunks) SELECT chunk_id, round(list_dot_product(before, embedding), 6) AS score FROM b WHERE before IS NOT NULL")
def v_dot_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("embedding").over(Window.partitionBy("domain", "url").orderBy("chunk_index"))
    rows = views.vector_chunks(spark, sf_dir).withColumn("before", before).filter("before IS NOT NULL")
    return rows.select("chunk_id", F.round(rt.dot_product(F.col("before"), F.col("embedding")), 6).alias("score"))


@query(f"WITH {TOP} SELECT query_id, chunk_id, round(score, 6) AS score, source, url FROM primary_hits")
def v_primary_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(spark, sf_dir)[3].select("query_id", "chunk_id", F.round("score", 6).alias("score"), "source", "url")


@query(f"WITH {SIBLINGS} SELECT query_id, chunk_id, round(score, 6) AS score, url FROM siblings")
def v_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, asked, _, primary = top(spark, sf_dir)
    return rt.sibling_expand(primary, chunks, asked, 0.15, 0.05).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "url")


@query(f"""WITH {PACKED}, ctx AS (SELECT query_id, trim(string_agg(content, chr(10) || chr(10) ORDER BY spot)) AS context FROM fitting WHERE ok = 1 GROUP BY 1),
src AS (SELECT query_id, string_agg(url, ',' ORDER BY spot) AS sources FROM first_urls GROUP BY 1),
own AS (SELECT query_id, string_agg(content, chr(10) || chr(10) ORDER BY round(score, 12) DESC, chunk_id) AS owner_context FROM primary_hits WHERE source = 'owner_reply' GROUP BY 1),
best AS (SELECT query_id, max(score) AS top_score FROM top GROUP BY 1)
SELECT query_id, domain, coalesce(context, '') AS context, coalesce(owner_context, '') AS owner_context, coalesce(sources, '') AS sources, round(coalesce(top_score, 0), 6) AS top_score
FROM asked LEFT JOIN ctx USING (query_id) LEFT JOIN src USING (query_id) LEFT JOIN own USING (query_id) LEFT JOIN best USING (query_id)""")
def v_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, asked = views.vector_chunks(spark, sf_dir), views.vector_queries(spark, sf_dir)
    rows = rt.retrieve(asked, chunks, views.tenant_limits(spark, sf_dir), default=0.25, offset=0.15, floor=0.05)
    return rows.select("query_id", "domain", "context", "owner_context", F.array_join("sources", ",").alias("sources"), F.round("top_score", 6).alias("top_score"))


@query(f"""WITH {CHUNKS}, {ASKED}, cached AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(vector, embedding), 12) DESC, chunk_id) AS rn,
  list_dot_product(vector, embedding) AS score FROM asked JOIN chunks USING (domain))
SELECT query_id, chunk_id AS cache_id, round(score, 6) AS score FROM cached WHERE rn = 1 AND score >= 0.95""")
def d_cached_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = views.vector_chunks(spark, sf_dir).select(F.col("chunk_id").alias("cache_id"), "domain", "embedding")
    return rt.cached_answers(views.vector_queries(spark, sf_dir), cache).withColumn("score", F.round("score", 6))


@query(f"WITH {CHUNKS} SELECT c.chunk_id AS cache_id FROM chunks c WHERE NOT (c.chunk_id % 7 = 0 OR (c.chunk_id + 1) % 7 = 0)")
def d_invalidated_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.vector_chunks(spark, sf_dir)
    cache = c.select(F.col("chunk_id").alias("cache_id"), F.array("chunk_id", F.col("chunk_id") + 1).alias("chunk_ids"))
    ids = c.select(F.explode(F.array("chunk_id", F.col("chunk_id") + 1)).alias("chunk_id")).filter("chunk_id % 7 = 0")
    return rt.invalidate_cache(cache, ids).select("cache_id")


@query(f"""WITH {DIFF} SELECT page_seq, hash_changed OR page_seq % 11 <> 0 AS due FROM classed""")
def d_stale_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = cr.diff_pages(views.crawl(spark, sf_dir), views.stored_pages(spark, sf_dir), stale_days=14, now=now())
    return d.select("page_seq", F.col("hash_changed").alias("due"))


_S = {"password": r"(?i)\b(password|passwd|pwd)\s*[:=]\s*\S{4,}", "api_key": r'(?i)\b(api[_-]?key|secret|token)\s*[:=]\s*["\x27]?[A-Za-z0-9_\-]{16,}', "jwt": r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+",
      "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "ssn": r"\b\d{3}-\d{2}-\d{4}\b"}
_LUHN = """list_sum(list_transform(range(1, length(n) + 1), lambda i: CASE WHEN i % 2 = 0 THEN CASE WHEN CAST(n[-i] AS INTEGER) > 4 THEN CAST(n[-i] AS INTEGER) * 2 - 9 ELSE CAST(n[-i] AS INTEGER) * 2 END ELSE CAST(n[-i] AS INTEGER) END)) % 10 = 0"""


@query(f"""WITH cards AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '\\b(\\d[ -]?){{12,18}}\\d\\b'), lambda c: regexp_replace(c, '[ -]', '', 'g'))) AS n FROM documents),
good AS (SELECT DISTINCT doc_id FROM cards WHERE {_LUHN}),
found AS (SELECT doc_id, array_to_string(list_filter([{', '.join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in _S.items())}, CASE WHEN doc_id IN (SELECT doc_id FROM good) THEN 'card' END], lambda x: x IS NOT NULL), ',') AS findings FROM documents)
SELECT * FROM found WHERE findings <> ''""")
def d_sensitive_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, withheld = scans.withhold_sensitive(table(spark, sf_dir, "documents"))
    return withheld.select("doc_id", F.array_join("findings", ",").alias("findings"))


@query(f"""WITH {CHUNKS}, b AS (SELECT *, lag(embedding) OVER w AS before FROM chunks WINDOW w AS (PARTITION BY domain, url ORDER BY chunk_index)),
s AS (SELECT chunk_id, domain, url, chunk_index, CASE WHEN before IS NOT NULL AND list_dot_product(before, embedding) < 0.05 THEN 1 ELSE 0 END AS starts FROM b)
SELECT chunk_id, CAST(sum(starts) OVER (PARTITION BY domain, url ORDER BY chunk_index) AS BIGINT) AS segment FROM s""")
def d_semantic_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.vector_chunks(spark, sf_dir)
    paras = c.select("chunk_id", "domain", F.col("url").alias("page_seq"), F.col("chunk_index").alias("idx"), F.col("content").alias("para"), "embedding")
    return scans.semantic_boundaries(paras, 0.05).select("chunk_id", "segment")


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS snapshot_id, 'p' || l_partkey AS url, l_linenumber AS chunk_index FROM lineitem WHERE l_orderkey IN (SELECT max(o_orderkey) FROM orders GROUP BY o_custkey)""")
def s_snapshot_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").cast("string").alias("newest"))
    rows = views.archived(spark, sf_dir).join(newest, F.col("snapshot_id") == F.col("newest"))
    return sn.snapshot_chunks(rows, F.col("newest")).drop("newest", "o_custkey")


@query(f"""WITH {CHUNKS}, b AS (SELECT *, lag(embedding) OVER w AS before FROM chunks WINDOW w AS (PARTITION BY domain, url ORDER BY chunk_index)),
s AS (SELECT *, sum(CASE WHEN before IS NOT NULL AND list_dot_product(before, embedding) < 0.05 THEN 1 ELSE 0 END) OVER (PARTITION BY domain, url ORDER BY chunk_index) AS segment FROM b),
p AS (SELECT *, floor((sum(length(content) + 2) OVER (PARTITION BY domain, url, segment ORDER BY chunk_index) - 1) / 1800) AS part FROM s)
SELECT domain, url AS page, CAST(segment AS BIGINT) AS segment, CAST(part AS BIGINT) AS part, string_agg(content, chr(10) || chr(10) ORDER BY chunk_index) AS content FROM p GROUP BY 1, 2, 3, 4""")
def d_semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.vector_chunks(spark, sf_dir)
    paras = c.select("domain", F.col("url").alias("page_seq"), F.col("chunk_index").alias("idx"), F.col("content").alias("para"), "embedding")
    return scans.semantic_chunks(paras, 0.05).withColumnRenamed("page_seq", "page")


@query(f"""WITH {TOP}, {views.METERED}, n AS (SELECT chunk_id AS query_id, row_number() OVER (PARTITION BY domain ORDER BY chunk_id) AS rn FROM chunks WHERE chunk_id % {views.QUERY_EVERY} = 0),
hit AS (SELECT DISTINCT query_id FROM primary_hits)
SELECT query_id, domain, rn <= 3 AS accepted, CASE WHEN rn <= 3 THEN hit.query_id IS NOT NULL END AS had_context, CASE WHEN rn <= 3 THEN CASE WHEN query_id % 100 = 0 THEN 'small' ELSE 'large' END END AS model
FROM asked JOIN n USING (query_id) LEFT JOIN hit USING (query_id)""")
def w3_answered_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = views.vector_queries(spark, sf_dir)
    turns = asked.select("query_id", "domain", "vector", F.when(F.col("query_id") % 100 == 0, "simple").otherwise("complex").alias("route"), F.lit("question").alias("text"))
    metered = turns.select("domain", F.col("query_id").alias("message_id"), F.lit("free").alias("plan"), F.lit("2024-01").alias("period_start"), F.lit("2024-01-01").cast("timestamp").alias("ts"))
    return serve.answered_turns(turns, metered, views.vector_chunks(spark, sf_dir), views.tenant_limits(spark, sf_dir), limit=3, default=0.25, offset=0.15, floor=0.05)


def hand_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written by a rule of their number: structure, links, a protected address and, on every fifth, a mount point."""
    n = F.col("doc_id").cast("string")
    start = F.lit('<html><head><title>t</title></head><body><nav><a href="/menu">menu</a></nav><header>Top</header><h1>Title ')
    rest = F.lit('</p><ul><li>one</li><li>two</li></ul><p>Write to <a href="/cdn-cgi/l/email-protection#2a4b6a4804434e">x</a></p><a href="/next/')
    end = F.lit('">go</a><a href="#top">up</a><a href="mailto:x@y.z">m</a><footer>foot</footer></body></html>')
    html = F.concat(start, n, F.lit("</h1><p>A paragraph &amp; more<br>of "), n, rest, n, end)
    mount = F.lit('<html><body><div id="__next"></div><script src="/_next/static/main.js"></script></body></html>')
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, mount).otherwise(html).alias("html"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'Top' || chr(10) || chr(10) || '[H1] Title ' || doc_id || chr(10) || chr(10) || '[SB]A paragraph & more' || chr(10) || 'of ' || doc_id
  || chr(10) || chr(10) || '[SB]one, two' || chr(10) || chr(10) || '[SB]Write to a@b.id' || chr(10) || chr(10) || 'goupm' END AS text,
  CASE WHEN doc_id % 5 = 0 THEN '' ELSE '/next/' || doc_id END AS links, doc_id % 5 = 0 AS needs_render FROM documents""")
def t_hand_made_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = hand_made(spark, sf_dir).withColumn("page", page_column(F.col("html")))
    return pages.select("doc_id", F.col("page.text").alias("text"), F.array_join("page.links", " ").alias("links"), F.col("page.needs_render").alias("needs_render"))


def regular_pages(spark: SparkSession, sf_dir: str, paras) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL")
    return d.select(F.col("source").alias("domain"), F.col("doc_id").alias("page_seq"), F.concat(F.lit("https://a.org/"), F.col("doc_id").cast("string")).alias("url"), paras.alias("paras"))


def _numbered(n, text):
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.concat(F.lit(text), F.lpad(k.cast("string"), 3, "0")))


@query("""WITH d AS (SELECT doc_id, 20 + 10 * (doc_id % 2) + 12 * CAST(doc_id % 6 = 5 AS INTEGER) AS n FROM documents),
c AS (SELECT doc_id, n, unnest(range(CAST(ceil((n - 1) / 11.0) AS BIGINT))) AS k FROM d)
SELECT doc_id, CAST(k AS INTEGER) AS chunk_index, 'Part' AS section_h2, '[Source: https://a.org/' || doc_id || ']' || chr(10) || '[H1] Title' || chr(10) || '[H2] Part' || chr(10) || chr(10)
  || array_to_string(list_transform(range(11 * k, least(11 * k + 12, n)), lambda i: 'Sentence ' || lpad(CAST(i AS VARCHAR), 3, '0') || ' ' || repeat('y', 86) || '.'), ' ') AS content FROM c""")
def c_sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paragraph too long for a chunk, of regular sentences: each chunk repeats the last sentence of the one before."""
    n = (F.lit(20) + 10 * (F.col("doc_id") % 2) + 12 * (F.col("doc_id") % 6 == 5).cast("int")).cast("int")
    long = F.array_join(F.transform(_numbered(n, "Sentence "), lambda x: F.concat(x, F.lit(" " + "y" * 86 + "."))), " ")
    rows = ch.chunk_pages(regular_pages(spark, sf_dir, F.array(F.lit("[H1] Title"), F.lit("[H2] Part"), long)), F.col("paras"))
    return rows.select(F.col("page_seq").alias("doc_id"), "chunk_index", "section_h2", "content")


@query("""WITH d AS (SELECT doc_id, 3 + doc_id % 6 AS n FROM documents), c AS (SELECT doc_id, n, unnest(CASE WHEN n > 6 THEN [0, 1] ELSE [0] END) AS k FROM d)
SELECT doc_id, CAST(k AS INTEGER) AS chunk_index, 'Title' AS label, '[Source: https://a.org/' || doc_id || ']' || chr(10) || '[H1] Title' || chr(10) || chr(10) || CASE k WHEN 1 THEN repeat('x', 200) || chr(10) || chr(10) ELSE '' END
  || array_to_string(list_transform(range(5 * k, CASE WHEN n > 6 AND k = 0 THEN 5 ELSE n END), lambda i: 'Paragraph ' || lpad(CAST(i AS VARCHAR), 3, '0') || ' ' || repeat('x', 280)), chr(10) || chr(10)) AS content FROM c""")
def c_paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of one size: more than six make a chunk of five, and the next repeats the last 200 characters."""
    paras = F.transform(_numbered((3 + F.col("doc_id") % 6).cast("int"), "Paragraph "), lambda x: F.concat(x, F.lit(" " + "x" * 280)))
    rows = ch.chunk_pages(regular_pages(spark, sf_dir, F.concat(F.array(F.lit("[H1] Title")), paras)), F.col("paras"))
    return rows.select(F.col("page_seq").alias("doc_id"), "chunk_index", "label", "content")


@query("""SELECT source AS domain, sha256('Opening hours of place ' || (doc_id % 40) || ' are from nine to five.') AS content_hash, count(*) AS chunks, 64 AS dim FROM documents GROUP BY 1, 2""")
def c_embedded_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Opening hours of place "), (F.col("doc_id") % 40).cast("string"), F.lit(" are from nine to five."))
    chunks = table(spark, sf_dir, "documents").select(F.col("source").alias("domain"), text.alias("content")).withColumn("content_hash", F.sha2("content", 256))
    rows = ch.embedded_once(chunks, shared_folder(spark, "vectors"), ch.hashing_embedder())
    return rows.groupBy("domain", "content_hash").agg(F.count("*").alias("chunks"), F.max(F.size("embedding")).alias("dim"))


_KEPT = "(source IS NULL OR source NOT IN ('manual', 'upload', 'owner_reply'))"


def ten_snapshots(spark: SparkSession, sf_dir: str) -> tuple[ChunkArchive, DataFrame]:
    """The archive of ten snapshots of an unchanged knowledge base, pruned to the newest three, and these."""
    chunks = views.vector_chunks(spark, sf_dir).select("domain", "url", "chunk_id", "content", "created_at", "source")
    folder = shared_folder(spark, "archive")
    archive = ChunkArchive(spark, folder, "domain string, url string, chunk_id long, content string, created_at timestamp", 8)
    made = None
    for day in range(1, 11):
        snapshots, old = sn.create_snapshot(chunks.withColumn("_made", F.col("created_at")), F.lit("full"), F.lit(f"2024-03-{day:02d} 00:00:00").cast("timestamp"))
        archive.add(old.withColumn("created_at", F.col("_made")))
        made = snapshots if made is None else made.unionByName(snapshots)
    kept, _ = sn.prune_snapshots(made, made, 3)
    kept = saved(kept.select("domain", "snapshot_id", "created_at"), "kept-snapshots")
    archive.prune(kept, f"{folder}-prune")
    return archive, kept


@query(f"WITH {CHUNKS} SELECT domain, count(*) AS rows, 3 * count(*) AS members FROM chunks WHERE {_KEPT} GROUP BY 1")
def s_archive_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ten_snapshots(spark, sf_dir)[0].counts()


@query(f"WITH {CHUNKS} SELECT domain, chunk_id, url, sha256(content) AS content_hash, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM chunks WHERE {_KEPT}")
def s_archive_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive, kept = ten_snapshots(spark, sf_dir)
    newest = kept.groupBy("domain").agg(F.max_by("snapshot_id", "created_at").alias("snapshot_id"))
    return archive.archived(newest).select("domain", "chunk_id", "url", F.sha2("content", 256).alias("content_hash"), stamp("created_at"))


def linked_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a web: page n of a site links to pages 2n + 1 and 3n + 2, of which some can't be fetched."""
    d = table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL")
    host = F.concat(F.col("source"), F.lit(".example.com"))
    links = F.transform(F.array(2 * F.col("doc_id") + 1, 3 * F.col("doc_id") + 2), lambda k: F.concat(F.lit("/p/"), k.cast("string")))
    return d.select(F.col("source").alias("domain"), host.alias("base_host"), F.concat(F.lit("https://"), host, F.lit("/p/"), F.col("doc_id").cast("string")).alias("url"), links.alias("links"))


@query("""WITH RECURSIVE reach AS (SELECT DISTINCT source AS domain, CAST(unnest(range(12)) AS BIGINT) AS k FROM documents
  UNION SELECT r.domain, unnest([2 * r.k + 1, 3 * r.k + 2]) AS k FROM reach r JOIN documents d ON d.source = r.domain AND d.doc_id = r.k)
SELECT domain, domain || '.example.com/p/' || k AS url_key FROM reach""")
def j_crawl_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    web = linked_web(spark, sf_dir)
    each = web.select("domain", "base_host").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(11))))
    starts = each.select("domain", F.concat(F.lit("https://"), "base_host", F.lit("/p/"), F.col("k").cast("string")).alias("url"))
    return cr.crawl_to_end(web, starts, max_pages=1_000_000).select("domain", "url_key")


@query(f"""WITH {DIFF}, updated AS (SELECT c.domain, c.page_seq, s.url AS stored_url, c.url AS crawled_url, s.content_hash AS old_hash, c.content_hash AS new_hash, s.page_seq IS NOT NULL AS known,
  c.hash_changed OR (c.priority = 'high' AND length(c.text) >= 300) AS written FROM classed c LEFT JOIN stored s ON c.page_seq = s.page_seq)
SELECT domain, coalesce(stored_url, crawled_url) AS url, CASE WHEN written THEN new_hash ELSE old_hash END AS content_hash, '2024-02-01 00:00:00' AS last_scraped_at,
  CASE WHEN known AND (NOT written OR old_hash = new_hash) THEN '2024-01-01 00:00:00' ELSE '2024-02-01 00:00:00' END AS last_changed_at FROM updated""")
def w2_refreshed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored pages after a whole refresh job."""
    folder, crawled = shared_folder(spark, "refresh"), saved(views.crawl(spark, sf_dir), "crawl")
    base = refresh_job.KnowledgeBase(f"{folder}/base", 8)
    base.create(spark.createDataFrame([], CHUNK_SCHEMA), views.stored_pages(spark, sf_dir))
    refresh_job.refresh_job(base, crawled, ch.hashing_embedder(), now(), f"{folder}/job")
    return base.pages(spark).select("domain", "url", "content_hash", stamp("last_scraped_at"), stamp("last_changed_at"))


@query(f"""WITH t AS (SELECT {_TRIM} AS text FROM (SELECT text AS x FROM documents WHERE text IS NOT NULL))
SELECT 'txt' AS kind, CASE WHEN text = '' THEN 'empty' END AS reason, CASE WHEN text <> '' THEN sha256(text) END AS content_hash, count(*) AS files FROM t GROUP BY ALL""")
def io_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document written as an upload of its own, and the uploads read: accepted texts and rejects."""
    folder = shared_folder(spark, "uploads")
    write_uploads(spread(table(spark, sf_dir, "documents").select("text")), folder)
    marked = marked_uploads(spark, folder).filter("reason IS NULL OR kind = 'txt'")
    hashed = marked.select("kind", "reason", F.when(F.col("reason").isNull(), F.sha2("text", 256)).alias("content_hash"))
    # A file counts as 4 MB by default, which makes a task of every 32 small ones.
    with setting(spark, "spark.sql.files.openCostInBytes", "128k"):
        both = saved(hashed, "uploads-read")
    return both.groupBy("kind", "reason", "content_hash").agg(F.count("*").alias("files"))
