import datetime as dt
import random

import duckdb
import numpy as np
import pyarrow as pa_
import pytest
from pyspark.sql import functions as F

from kbspark.functions import text as t
from kbspark.operators import analytics as an
from kbspark.operators import chunks as ch
from kbspark.operators import conversations as cv
from kbspark.operators import crawl as cr
from kbspark.operators import metering as mt
from kbspark.operators import paragraphs as pa
from kbspark.operators import retrieval as rt
from kbspark.operators import scans
from kbspark.operators import snapshots as sn
from kbspark.plans import kb_queries
from kbspark.sources.pages import crawled_pages, read_uploads, site_domain, write_uploads
from kbspark.sources.shared import saved
from kbspark.sources.writes import replace_chunks, upsert_pages
from kbspark.streaming import queries as streaming_queries


def values(spark, column, rows, name="x", kind="string"):
    df = spark.createDataFrame([(r,) for r in rows], f"{name} {kind}")
    return [r[0] for r in df.select(column).collect()]


def ts(text):
    return dt.datetime.fromisoformat(text)


@pytest.mark.parametrize("settings,extra", [(t.CrawlSettings(), False), (t.CrawlSettings(True, True), True)])
def test_keep_para(spark, settings, extra):
    cases = {
        "x" * 19: False, "x" * 20: True, "[SB]abc": False, "[SB]abcd": True, "[SB][SB]abcd": True, "[H2] ab": True, "a@b.co": True, "(555) 123-4567": True,
        "$ 5": True, "5 pm": True, "12 amazing": True, "Ste 4": True, "steward": True, "@handle": extra, "http://x.y": extra, "plain": False,
    }
    got = values(spark, t.keep_para(F.col("x"), settings), list(cases))
    assert dict(zip(cases, got)) == cases


def test_keep_para_has_ascii_word_edges(spark):
    # Java's own \b and \s would turn most of these round.
    cases = {
        "Gäste da": True, "höflich": True, "Éunit 5": True, "xunit 5": False, "éa": False, "$\x0b5": False, "5\x0bpm": False, "unit\x0b5": False, "555\x0b555-5555": False,
        "$ 5": True, "xſte 5": True, "ſte 5": False, "unit ſ": True, "unit \u212a": True, "unit é": False,
    }
    got = values(spark, t.keep_para(F.col("x")), list(cases))
    assert dict(zip(cases, got)) == cases
    assert values(spark, t.has_price(F.col("x")), ["$ 5", "$\x0b5"]) == [True, False]


@pytest.mark.parametrize("q", [kb_queries.p_kept_paragraphs, kb_queries.p_dedup_paragraphs, streaming_queries.r_incremental_dedup])
def test_paragraphs_of_odd_texts_equal_sql(spark, tmp_path, q):
    odd = [*range(1, 10), *range(11, 0x180), 0x17F, 0x2003, 0x2028, 0x212A, 0x3000, 0xFEFF, 0x1F600]
    each = "{c}unit 5\nunit {c}\nG{c}ste da\n{c}te 5\nx{c}te 5\n5{c}pm\n5 {c}m\n${c}5\na@{c}.d\n555{c}555-5555\n[SB]abc{c}\n[SB]{c}abc\n{c}\naaaaaaaaaaaaaaaaaaa{c}\n[H1]{c}x"
    texts = [each.replace("{c}", chr(c)) for c in odd] + [None, "", "\n \n", "a\0b\nunit\x005"]
    rows = [(k, x, "en", f"src{k % 3}") for k, x in enumerate(texts)] + [(None, "[SB]unit 5\nlate", "en", "src0")]  # no place: after all others
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql = (kb_queries.ORACLES | streaming_queries.ORACLES)[q.__name__]
    df = q(spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in df.collect())


def test_urls(spark):
    u = F.col("x")
    urls = ["https://WWW.A.com:443/staff/kelly/?q=1#f", "http://a.com/about", "http://a_b.com:8080/x/y", "https://a.com", "not a url"]
    assert values(spark, t.url_key(u), urls) == ["www.a.com/staff/kelly/", "a.com/about", "a_b.com/x/y", "a.com/", "not a url"]
    assert values(spark, t.group_url(u), urls) == ["https://www.a.com/staff/", "http://a.com/", "http://a_b.com:8080/x/", "https://a.com/", "not a url"]
    assert values(spark, t.site_of(u), urls)[:2] == ["a.com", "a.com"]
    assert values(spark, site_domain(u), ["https://m.x.example.net/a", "http://x.org"]) == ["x.example.net", "x.org"]
    assert values(spark, t.priority(u), ["https://blog.x/", "https://x/a/Menu", "https://x/m"]) == ["high", "high", "normal"]


def test_trim_knows_unicode_space(spark):
    assert values(spark, t.trim(F.col("x")), ["  a　", "﻿", None]) == ["a", "", None]


def pages_of(spark, texts, domain="d"):
    return spark.createDataFrame([(domain, i, f"https://{domain}.com/s/{i}", x) for i, x in enumerate(texts)], "domain string, page_seq long, url string, text string")


def test_dedup_and_thin(spark):
    line, long = "a repeated footer line of text", "z" * 201
    pages = pages_of(spark, [f"[SB]{line}\n[H2] Head\n{long}"] + [f"{line}\n[H2] Head\n{long}\n" for _ in range(6)] + ["", None])
    kept = pa.dedup_paragraphs(pa.split_pages(pages))
    rows = {(r.page_seq, r.para) for r in kept.collect()}
    assert {p for p, x in rows if "footer" in x} == {0}
    assert {p for p, x in rows if x.startswith("[H2]")} == {0, 1, 2, 3, 4}
    assert len([1 for _, x in rows if x == long]) == 7
    built = {r.page_seq: (r.filtered_len, r.thin) for r in pa.rebuild_pages(pages, kept).collect()}
    assert built[0] == (len("[SB]" + line) + len("[H2] Head") + 201 + 4, True) and built[7] == (0, True) and built[8] == (0, True)
    other = pa.dedup_paragraphs(pa.split_pages(pages.repartition(8)))
    assert {(r.page_seq, r.idx, r.para) for r in other.collect()} == {(r.page_seq, r.idx, r.para) for r in kept.collect()}


def test_thin_groups(spark):
    texts = [f"[H1] Person {i}\n[SB]Staff member number {i}" for i in range(4)]
    rows = ch.group_thin_pages(pages_of(spark, texts)).collect()
    assert len(rows) == 1 and rows[0].url == "https://d.com/s/" and rows[0].label == "Person 0, Person 1, Person 2, …"
    assert rows[0].content.startswith("[Source: https://d.com/s/]\n\n\n\n[Source: https://d.com/s/0]\n[H1] Person 0\n\nStaff member number 0\n\n[Source:")
    assert rows[0].source_urls == [f"https://d.com/s/{i}" for i in range(4)]
    many = ch.group_thin_pages(pages_of(spark, [f"[SB]{'x' * 400} {i}" for i in range(7)])).collect()
    assert len(many) == 4 and {r.label for r in many} == {"Group"}


@pytest.mark.parametrize("part_pages", [1, 7, 1000])
def test_thin_packs_equal_one_pass(spark, part_pages):
    rng = np.random.default_rng(part_pages)
    rows = [(f"d{i % 2}", "g", i, f"u{i}", int(n)) for i, n in enumerate(rng.choice([0, 1, 30, 60, 200, 595, 600, 1180, 1190, 1191, 3000], 260))]
    df = spark.createDataFrame(rows, "domain string, group string, page_seq long, url string, n int")
    got = {(r.domain, r.page_seq): r.pack for r in ch._thin_packs(df, part_pages).collect()}
    for domain in ("d0", "d1"):
        pack, size = 0, 0
        for d, _, i, _, n in rows:
            if d != domain:
                continue
            if size > 0 and size + n + 10 > 1200:
                pack, size = pack + 1, 0
            size += n
            assert got[d, i] == pack
    assert len(got) == len(rows)


def test_embedding_is_batched_and_reused(spark):
    df = ch.dedup_chunks(spark.createDataFrame([("d", i, i, "u", f"text {i % 3}") for i in range(6)], "domain string, page_seq long, chunk_index int, url string, content string"))
    assert df.count() == 3
    known = ch.embed_chunks(df.filter("page_seq = 0"), ch.hashing_embedder(8))
    got = {r.content: r.embedding for r in ch.embed_chunks(df, lambda texts: np.ones((len(texts), 8), np.float32), known=known).collect()}
    assert got["text 1"] == [1.0] * 8 and abs(sum(x * x for x in got["text 0"]) - 1) < 1e-5


def test_entries_and_replies(spark):
    fresh = ch.entry_chunks(spark.createDataFrame([("d", "manual", "Hours", "We open at nine every day of the week."), ("d", "manual", "Empty", "no")], "domain string, source string, label string, text string"))
    rows = fresh.collect()
    assert [r.label for r in rows] == ["Hours"] and rows[0].url == "manual://d/Hours"
    old = spark.createDataFrame([("d", "manual", "Hours", "u", "old"), ("d", "upload", "Hours", "u", "other")], "domain string, source string, label string, url string, content string")
    assert sorted(r.content[:5] for r in ch.replace_entry_chunks(old, fresh).collect()) == ["[Sour", "other"]
    replies = spark.createDataFrame([("d", ["q" * 130, "b"], "yes", None, True), ("d", ["c"], "no", False, True)], "domain string, answered array<string>, reply string, add_to_kb boolean, tenant_default boolean")
    got = ch.owner_reply_chunks(replies).collect()
    assert len(got) == 2 and len(got[0].label) == 120 and got[1].content == "Q: b\nA: yes"


def test_frontier(spark):
    pages = spark.createDataFrame([("a.com", "a.com", "https://a.com/x/", ["y", "../z?q=1", "https://m.a.com/", "https://evil.com/", "http://[bad", "/x/"])], "domain string, base_host string, url string, links array<string>")
    seen = spark.createDataFrame([("a.com", "a.com/x/")], "domain string, url_key string")
    rows = sorted(cr.frontier_step(pages, seen).collect(), key=lambda r: r["rank"])
    assert [r.url_key for r in rows] == ["m.a.com/", "a.com/x/y", "a.com/z"] and [r.subdomain for r in rows] == [True, False, False]
    assert cr.frontier_step(pages, seen, max_pages=2).count() == 1


def test_diff(spark):
    long = "long text " * 40
    crawl = pages_of(spark, [long, long + "new", long, "thin page with few words", "thin page with other words", long])
    crawl = crawl.withColumns({"content_hash": t.content_hash(F.col("text")), "priority": F.when(F.col("page_seq") == 2, "high").otherwise("normal")})
    old = crawl.filter("page_seq <> 5").withColumns({"content_hash": F.when(F.col("page_seq").isin(1, 4), "x").otherwise(F.col("content_hash")), "has_variants": F.lit(True), "last_scraped_at": F.lit(ts("2024-01-01")), "url": F.regexp_replace("url", "https", "http")})
    d = cr.diff_pages(crawl, old)
    assert [r.change for r in d.orderBy("page_seq").collect()] == ["unchanged", "changed", "changed", "unchanged", "thin_changed", "changed"]
    assert sorted(r.page_seq for r in cr.changed_thin_groups(d).collect()) == [3, 4]
    assert sorted(r.page_seq for r in cr.page_hash_updates(d).collect()) == [1, 2, 4, 5]
    assert values(spark, cr.format_duration(F.col("x")), [5.9, 125.0], kind="double") == ["5s", "2m 5s"]


def chunk_rows(spark, rows):
    return spark.createDataFrame(rows, "domain string, url string, source string, content string")


def test_snapshots(spark):
    chunks = chunk_rows(spark, [("d", "u1", None, "a"), ("d", "u1", "scraped", "b"), ("d", "u2", "manual", "c"), ("e", "v", "upload", "d")])
    made, archive = sn.create_snapshot(chunks, F.lit("full"), F.lit(ts("2024-01-01")))
    assert [(r.domain, r.chunk_count, r.page_count, r.affected_urls) for r in made.collect()] == [("d", 2, 1, ["u1"])]
    now = chunk_rows(spark, [("d", "u1", "scraped", "new"), ("d", "u1", "manual", "m"), ("d", "u3", "scraped", "x")])
    back = sn.restore_snapshot(now, archive, F.lit(made.first().snapshot_id))
    assert sorted(r.content for r in back.collect()) == ["a", "b", "m", "x"]
    twelve = spark.createDataFrame([(f"s{i:02d}", "d", ts(f"2024-01-{i + 1:02d}")) for i in range(12)] + [("t1", "e", ts("2024-01-01"))], "snapshot_id string, domain string, created_at timestamp")
    rows = twelve.select("snapshot_id", F.lit("u").alias("url"))
    kept, left = sn.prune_snapshots(twelve, rows)
    assert kept.count() == 11 and left.count() == 11 and "s00" not in {r.snapshot_id for r in left.collect()}


def test_writes(spark):
    old = chunk_rows(spark, [("d", "u1", None, "old"), ("d", "u1", "manual", "m"), ("d", "u2", "scraped", "keep")])
    fresh = chunk_rows(spark, [("d", "u1", "scraped", "new")])
    assert sorted(r.content for r in replace_chunks(old, fresh).collect()) == ["keep", "m", "new"]
    stored = spark.createDataFrame([("d", "u", "h", "normal", False, True, 1, ts("2024-01-01"), ts("2024-01-01"))], "domain string, url string, content_hash string, priority string, used_renderer boolean, has_variants boolean, chunk_count int, last_scraped_at timestamp, last_changed_at timestamp")
    crawl = spark.createDataFrame([("d", "u", "h", "high", False, None, 2), ("d", "w", "k", "normal", False, None, 1)], "domain string, url string, content_hash string, priority string, used_renderer boolean, has_variants boolean, chunk_count int")
    rows = {r.url: r for r in upsert_pages(stored, crawl, F.lit(ts("2024-02-01"))).collect()}
    assert rows["u"].last_changed_at == ts("2024-01-01") and rows["u"].last_scraped_at == ts("2024-02-01") and rows["u"].has_variants and rows["u"].priority == "high"
    assert rows["w"].last_changed_at == ts("2024-02-01")


def test_uploads_and_pages(spark, tmp_path):
    for name, data in {"a.txt": b" hello ", "b.MD": b"# x", "c.pdf": b"x", "d.csv": b"  ", "e.txt": b"\xff\xfe"}.items():
        (tmp_path / name).write_bytes(data)
    good, bad = read_uploads(spark, str(tmp_path))
    assert sorted((r.kind, r.text) for r in good.collect()) == [("md", "# x"), ("txt", "hello")]
    assert sorted(r.reason for r in bad.collect()) == ["empty", "not UTF-8", "unsupported type"]
    raw = spark.createDataFrame([(1, "https://a.b/c", "<p>", "text/html; charset=x"), (2, "u", "a\0b", "text/html"), (3, "u", "x", "image/png"), (4, "u", None, "text/html")], "page_id long, url string, html string, content_type string")
    assert [r.page_seq for r in crawled_pages(raw).collect()] == [1]


def test_written_uploads_are_read_back(spark, tmp_path):
    texts = [f"text {k}" for k in range(2500)] + ["", " \n ", None, "two\nlines\r\n", "ünï 💡\0", "x" * 300_000]
    rows = spark.createDataFrame([(x,) for x in texts], "text string").coalesce(1)
    write_uploads(rows, str(tmp_path / "up"))
    good, bad = read_uploads(spark, str(tmp_path / "up"))
    assert sorted((r.kind, r.text) for r in good.collect()) == sorted(("txt", x.strip()) for x in texts if x and x.strip())
    assert [(r.kind, r.reason) for r in bad.collect()] == [("txt", "empty")] * 2
    folders = sorted(f for f in (tmp_path / "up").iterdir())
    assert [len(list(f.iterdir())) for f in folders] == [1000, 1000, 505]  # no checksums, no folder of all files
    write_uploads(rows.limit(0), str(tmp_path / "none"))
    assert [df.count() for df in read_uploads(spark, str(tmp_path / "none"))] == [0, 0]


def test_uploads_go_to_stores_that_only_spark_knows(spark, tmp_path):
    (tmp_path / "real").mkdir()
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.uploads.link./in", f"file://{tmp_path}/real")
    write_uploads(spark.createDataFrame([("a",), ("b\nc",), (None,), ("",)], "text string"), "viewfs://uploads/in/up")
    good, bad = read_uploads(spark, "viewfs://uploads/in/up")
    assert sorted(r.text for r in good.collect()) == ["a", "b\nc"] and [r.reason for r in bad.collect()] == ["empty"]


def test_uploads_query_opens_each_file_once(spark, tmp_path, monkeypatch):
    texts = [("same",), ("same ",), ("other",), ("",), (None,)]
    spark.createDataFrame(texts, "text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen = []

    def counted(df, name):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString().count("binaryFile"))
        return saved(df, name)

    monkeypatch.setattr(kb_queries, "saved", counted)
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    df = kb_queries.io_uploads(spark, str(tmp_path))
    assert sorted((r.reason or "", r.files) for r in df.collect()) == [("", 1), ("", 2), ("empty", 1)]
    assert seen == [1] and "binaryFile" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert spark.conf.get("spark.sql.files.openCostInBytes") == cost


def test_topk_against_numpy(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(300, 8))
    vectors[7] = vectors[8]
    rows = [(i, f"d{i % 3}", [float(x) for x in v]) for i, v in enumerate(vectors)]
    chunks = spark.createDataFrame(rows, "chunk_id long, domain string, embedding array<double>")
    asked = chunks.filter("chunk_id < 20").select(F.col("chunk_id").alias("query_id"), "domain", F.col("embedding").alias("vector"))
    got = {}
    for r in rt.vector_topk(asked, chunks, k=4, query_block=3, list_size=16).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    for q in range(20):
        same = [i for i in range(300) if i % 3 == q % 3]
        assert got[q] == sorted(same, key=lambda i: (-round(float(vectors[q] @ vectors[i]), 12), i))[:4]
    assert rt.vector_topk(asked.limit(0), chunks).count() == 0


def test_topk_of_a_large_tenant_is_a_grid(spark):
    rng = np.random.default_rng(5)
    vectors = rng.integers(-2, 3, size=(400, 4)).astype(float)  # many ties
    rows = [(f"c{i:03d}", "big" if i % 10 else None if i % 20 else "small", [float(x) for x in v] if i != 7 else None) for i, v in enumerate(vectors)]
    chunks = spark.createDataFrame(rows, "chunk_id string, domain string, embedding array<float>").withColumn("q", F.lit(1))
    asked = chunks.filter("chunk_id < 'c050'").select(F.col("chunk_id").alias("query_id"), "domain", F.col("embedding").alias("vector"))
    got = {}
    for r in rt.vector_topk(asked, chunks, k=5, query_block=7, list_size=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    for i, (q, domain, v) in enumerate(rows[:50]):
        mates = [r for r in rows if domain is not None and v is not None and r[1] == domain and r[2] is not None]
        assert got.get(q, []) == [r[0] for r in sorted(mates, key=lambda r: (-float(np.dot(v, r[2])), r[0]))][:5]


def test_positions_across_buckets(spark):
    rows = [(d, b, i) for i, (d, b) in enumerate([("a", 1), ("a", 1), ("a", 2), ("a", None), (None, 3), (None, 1), ("b", 2)] * 3)]
    df = spark.createDataFrame(rows, "domain string, bucket int, id int")
    got = {r.id: (r.position, r.total, r.page, r.pages) for r in an.paged(df, ["domain"], F.col("bucket"), [F.col("bucket").desc(), F.col("id")], 5, descending=True).collect()}
    for domain in ("a", "b", None):
        mine = sorted((r for r in rows if r[0] == domain), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        for n, r in enumerate(mine, 1):
            assert got[r[2]] == (n, len(mine), -(-n // 5), -(-len(mine) // 5))


def test_context_stops_at_first_misfit(spark):
    hits = spark.createDataFrame([("q", 1, 0.9, "u1", "a" * 10, "scraped"), ("q", 2, 0.8, "u1", "b" * 30, None), ("q", 3, 0.7, "u2", "c", "scraped"), ("q", 4, 0.95, "o", "Q: A:", "owner_reply")], "query_id string, chunk_id long, score double, url string, content string, source string")
    none = hits.filter("false")
    assert rt.pack_context(hits, none, budget=20).first().asDict() == {"query_id": "q", "context": "a" * 10, "sources": ["u1"]}
    assert rt.pack_context(hits, none, budget=60).first().sources == ["u1", "u2"]
    assert rt.owner_reply_context(hits).first().owner_context == "Q: A:"


def test_signals(spark):
    replies = ["Ok. [HANDOFF_REQUESTED: open late? ]", "x [OPTIONS: a | b||c|d|e] [HANDOFF_REQUESTED: q]", "y [HANDOFF_REQUESTED: q] [OPTIONS: a]", "z [HANDOFF_CANCEL: q] more", None]
    rows = values(spark, cv.parse_signals(F.col("x")), replies)
    assert (rows[0].text, rows[0].handoff) == ("Ok.", "open late?")
    assert (rows[1].text, rows[1].handoff, rows[1].options_raw) == ("x", "q", "a | b||c|d|e")
    assert rows[2].handoff is None and rows[2].options_raw == "a" and rows[2].text == "y [HANDOFF_REQUESTED: q]"
    assert rows[3].cancel is None and rows[3].text == replies[3] and rows[4].text is None
    assert values(spark, cv.parse_options(F.col("x")), ["a | b||c|d|e"]) == [["a", "b", "c", "d"]]


def test_handoff_fold():
    fold = cv.fold_handoff
    assert fold([], False, [("When do you open?", None), ("when do you open", None)]) == (["When do you open?"], True, [True, False])
    assert fold(["a"], True, [(None, "b")]) == (["a"], True, [False])
    assert fold(["a"], True, [("new question here", "a")]) == (["new question here"], True, [False])
    assert fold(["a"], True, [(None, "a")]) == ([], False, [False])


def test_periods(spark):
    d = dt.date
    assert [x[1:] for x in mt.fold_periods([d(2024, 1, 31), d(2024, 3, 1), d(2024, 3, 2), d(2024, 12, 5)])] == [(d(2024, 1, 31), d(2024, 3, 2))] * 2 + [(d(2024, 3, 2), d(2024, 4, 2)), (d(2024, 12, 5), d(2025, 1, 5))]
    assert values(spark, mt.next_reset(F.col("x")), [d(2023, 1, 31), d(2024, 1, 31), d(2024, 12, 15)], kind="date") == [d(2023, 3, 3), d(2024, 3, 2), d(2025, 1, 15)]
    rows = spark.createDataFrame([("a", ts("2024-01-31T10:00:00")), ("a", ts("2024-03-02T00:00:00")), ("b", ts("2024-03-01T00:00:00"))], "domain string, ts timestamp")
    assert {(r.domain, str(r.period_start)) for r in mt.billing_periods(rows).collect()} == {("a", "2024-01-31"), ("a", "2024-03-02"), ("b", "2024-03-01")}


def test_quota(spark):
    rows = spark.createDataFrame([("f", i, ts("2024-01-01"), "free", "p") for i in range(103)] + [("p", i, ts("2024-01-01"), "infinity", "p") for i in range(103)], "domain string, message_id long, ts timestamp, plan string, period_start string")
    out = mt.quota_outcome(rows)
    assert out.filter("NOT accepted").count() == 3 and [r.message_id for r in out.filter("notice").collect()] == [100]
    assert sorted((r.message_id, r.threshold) for r in mt.quota_warnings(out).collect()) == [(49, 50), (74, 75), (89, 90)]


def test_plan_history(spark):
    e = [(1, "checkout", "d", "c1", "subscription", "active", False), (2, "updated", "d", None, None, "past_due", False), (3, "payment_failed", None, "c1", None, None, False), (4, "deleted", "d", None, None, None, False), (5, "checkout", None, "c", "payment", None, False), (6, "updated", "zz", None, None, "active", False), (7, "payment_failed", None, "unknown", None, None, False)]
    events = spark.createDataFrame([(s, ts(f"2024-01-0{s}"), *r) for s, *r in e], "seq long, ts timestamp, type string, domain string, customer string, mode string, status string, addon boolean")
    known = spark.createDataFrame([("d",)], "domain string")
    got = [(r.seq, r.plan, r.plan_status) for r in mt.plan_history(events, known).orderBy("seq").collect()]
    assert got == [(1, "infinity", "active"), (2, "infinity", "past_due"), (3, "infinity", "past_due"), (4, "free", "canceled")]
    asked = spark.createDataFrame([("d", 1, ts("2023-12-31")), ("d", 2, ts("2024-01-01")), ("d", 3, ts("2024-02-01"))], "domain string, message_id long, ts timestamp")
    assert [r.plan for r in mt.as_of_plan(asked, mt.plan_history(events, known)).orderBy("message_id").collect()] == ["free", "infinity", "free"]


def test_permissions(spark):
    rows = [("a@x", False, [("d", ["agent", "nobody"], ["billing.view", "knowledge.view"]), ("d", ["owner"], [])]), ("s@x", True, [])]
    users = spark.createDataFrame(rows, "email string, superadmin boolean, memberships array<struct<entity_domain: string, roles: array<string>, permissions: array<string>>>")
    got = {r.permission for r in an.resolve_permissions(users).collect()}
    assert got == set(an.ROLES["agent"]) | {"billing.view"}
    tenants = spark.createDataFrame([("d", ts("2024-01-01")), ("e", ts("2024-01-02"))], "domain string, created_at timestamp")
    assert sorted((r.email, r.domain, r.position) for r in an.tenants_visible(users, tenants).collect()) == [("a@x", "d", 1), ("s@x", "d", 2), ("s@x", "e", 1)]
    left, counts = an.purge_tenants({"users": users, "tenants": tenants}, spark.createDataFrame([("d",)], "domain string"))
    assert [len(r.memberships) for r in left["users"].orderBy("email").collect()] == [0, 0] and counts.first().deleted == 1


@pytest.mark.parametrize("broadcast", [100, 0])
def test_pairs_of_superadmins_are_dealt_out(spark, monkeypatch, broadcast):
    monkeypatch.setattr(an, "ADMIN_BLOCK", 7)
    monkeypatch.setattr(an, "BROADCAST_ADMINS", broadcast)
    monkeypatch.setattr(an, "TASK_PAIRS", 100, raising=False)
    rows = [(f"s{k}@x", True, [("t1", ["owner"], [])]) for k in range(30)] + [("a@x", False, [("t3", ["owner"], []), ("t5", ["agent"], []), ("t3", ["agent"], []), ("gone", [], [])]), ("n@x", False, [])]
    users = spark.createDataFrame(rows, "email string, superadmin boolean, memberships array<struct<entity_domain: string, roles: array<string>, permissions: array<string>>>")
    tenants = spark.createDataFrame([(f"t{k}", ts("2024-01-01") + dt.timedelta(minutes=k // 2)) for k in range(40)], "domain string, created_at timestamp")  # all of one day
    seen = an.tenants_visible(users, tenants)
    place = {d: n for n, d in enumerate(sorted((f"t{k}" for k in range(40)), key=lambda d: (-(int(d[1:]) // 2), d)), 1)}
    want = [(f"s{k}@x", d, n) for k in range(30) for d, n in place.items()] + [("a@x", "t5", 1), ("a@x", "t3", 2)]
    assert sorted((r.email, r.domain, r.position) for r in seen.collect()) == sorted(want)
    if broadcast:
        counts = [r["count"] for r in seen.groupBy(F.spark_partition_id()).count().collect()]
        assert len(counts) >= 8 and max(counts) <= 300


def test_sensitive(spark):
    texts = ["password: hunter22", "card 4111 1111 1111 1111 ok", "card 4111 1111 1111 1112", "123-45-6789", "clean", None]
    assert values(spark, scans.sensitive(F.coalesce("x", F.lit(""))), texts) == [["password"], ["card"], [], ["ssn"], [], []]


def test_classifier(spark):
    raw = ['{"route": "simple", "reason": "r"}', 'x {"route": "complex"}', "none", '{"route": "x"}', '{"route": }', None]
    got = values(spark, cv.parse_classifier(F.col("x")), raw)
    assert [(r.route, r.reason) for r in got] == [("simple", "r"), ("complex", ""), ("complex", "parse_failed"), ("complex", "invalid_route"), ("complex", "classifier_error"), ("complex", "classifier_error")]


def test_no_thresholds_are_the_usual_ones(spark):
    seen = spark.createDataFrame([(d, ts("2024-01-01"), n, n, "free", True) for d in ("none", "empty", "own") for n in range(1, 101)], "domain string, period_start timestamp, message_id long, rn long, plan string, accepted boolean")
    lists = spark.createDataFrame([("empty", []), ("own", [20]), ("other", [1])], "domain string, thresholds array<int>")
    got = sorted((r.domain, r.message_id, r.threshold) for r in mt.quota_warnings(seen, lists).collect())
    assert got == sorted([(d, t, t) for d in ("none", "empty") for t in (50, 75, 90)] + [("own", 20, 20)])


def test_crawl_to_end_equals_a_plain_queue(spark):
    rng = random.Random(3)
    rows, starts = [], []
    for d in ("a.com", "b.org"):
        for k in range(60):
            links = [f"/{rng.randrange(80)}" for _ in range(rng.choice([0, 1, 3, 2]))] + (["https://elsewhere.net/x"] if k % 7 == 0 else []) + ([f"https://sub.{d}/{k}?x"] if k % 11 == 0 else [])
            rows.append((d, d, f"https://{d}/{k}", links if k % 13 != 5 else None))
        starts.append((d, f"https://{d}/0"))
        starts.append((d, f"http://{d}/1#top"))
    web = spark.createDataFrame(rows + [rows[5], (None, "x", "https://x/1", ["/2"])], "domain string, base_host string, url string, links array<string>")
    begin = spark.createDataFrame(starts + [(None, "https://x/1")], "domain string, url string")
    links = {u: ls or [] for _, _, u, ls in rows}
    want = {}
    for d in ("a.com", "b.org"):
        queue, seen = [f"https://{d}/0", f"https://{d}/1"], {f"{d}/0": 0, f"{d}/1": 0}
        while queue:
            url = queue.pop(0)
            for link in links.get(url, []):
                to = link if "://" in link else f"https://{d}{link}"
                key = to.split("://")[1].split("?")[0]
                if (key.split("/")[0] == d or key.split("/")[0].endswith("." + d)) and key not in seen:
                    seen[key] = seen[url.split("://")[1]] + 1
                    queue.append(f"https://{key}")
        want |= {(d, k): n for k, n in seen.items()}
    got = {(r.domain, r.url_key): r.round for r in cr.crawl_to_end(web, begin).collect()}
    assert got == want and max(want.values()) > 3
    capped = cr.crawl_to_end(web, begin, max_pages=10).groupBy("domain").count().collect()
    assert all(r["count"] == 10 for r in capped)
    assert cr.crawl_to_end(web, begin.limit(0)).count() == 0


def test_dot_products_of_columns():
    rows = [([1.0, 2.0], [3.0, 4.0]), ([], []), (None, [1.0]), ([1.0], None), ([1.0], [1.0, 2.0]), ([1.0, None], [1.0, 1.0]), ([2.0], [0.5]), ([3.0, 1.0], [2.0, 4.0]), ([], []), ([], [])]
    a, b = (pa_.array(x, pa_.list_(pa_.float32())) for x in zip(*rows))
    assert rt.dot_products(a, b).to_pylist() == [11.0, 0.0, None, None, None, None, 1.0, 10.0, 0.0, 0.0]
    assert rt.dot_products(a.slice(6), b.slice(6)).to_pylist() == [1.0, 10.0, 0.0, 0.0]
    assert rt.dot_products(a.slice(0, 0), b.slice(0, 0)).to_pylist() == []
    assert rt.dot_products(a.slice(1, 1), b.slice(1, 1)).to_pylist() == [0.0]


def test_page_search_and_outbox_of_awkward_rows(spark):
    rows = [("a", "https://x/b", None, "high"), ("a", "https://x/b", True, "high"), ("a", None, False, None), (None, "https://x/Z", True, "normal"), ("a", "https://x/" + "y" * 5000, True, "high")]
    pages = spark.createDataFrame(rows, "domain string, url string, used_renderer boolean, priority string")
    found = sorted((str(r.domain), str(r.url)[:11], r.position, r.total) for r in an.page_search(pages).collect())
    assert found == [("None", "https://x/Z", 1, 1), ("a", "None", 1, 4), ("a", "https://x/b", 2, 4), ("a", "https://x/b", 3, 4), ("a", "https://x/y", 4, 4)]
    assert an.page_search(pages, pattern="x/z").count() == 1 and an.page_search(pages, rendered=False).count() == 2
    assert an.page_search(pages.limit(0)).count() == 0
    tenants = spark.createDataFrame([("a", "A", None, "a@x", None), ("b", "B", "1", None, []), ("c", "C", "2", "c@x", ["sms"])], "domain string, name string, owner_phone string, owner_email string, quota_alert_channels array<string>")
    kinds = [("a", "handoff", None), ("a", "handoff", None), ("b", "quota_warning", None), ("c", "quota_warning", "t"), ("c", "handoff", "z" * 500), (None, "handoff", "x"), ("zz", "handoff", "x")]
    events = spark.createDataFrame([(d, k, "s", x, "r", 50, 5, 10) for d, k, x in kinds], "domain string, kind string, session_token string, text string, reason string, threshold int, used int, limit int")
    sent = sorted((r.domain, r.kind, r.channel) for r in cv.notification_outbox(events, tenants).collect())
    assert sent == [("a", "handoff", "email")] * 2 + [("c", "handoff", "email"), ("c", "handoff", "sms"), ("c", "quota_warning", "sms")]
    assert cv.notification_outbox(events.limit(0), tenants).count() == 0
