import datetime as dt
import os
import random

from pyspark.sql import functions as F

from kbspark.operators import conversations as cv
from kbspark.operators import paragraphs as pa
from kbspark.operators.metering import THRESHOLDS, fold_periods
from kbspark.plans import chat_queries
from kbspark.sources.tables import table
from kbspark.streaming import jobs
from kbspark.streaming import queries as q

SF = "/root/testdata/sf0.001"


def test_incremental_dedup_equals_batch(spark, tmp_path):
    line = "a footer line that every page has"
    rows = [("d", i, f"u{i}", f"{line}\n[H2] Same heading\nown paragraph number {i} of the page\n{line}") for i in range(9)]
    pages = spark.createDataFrame(rows, "domain string, page_seq long, url string, text string")
    out = {}
    dedup = jobs.IncrementalDedup(spark, str(tmp_path / "seen"), lambda df, n: out.update({n: df.collect()}))
    for n, (a, b) in enumerate([(0, 2), (2, 3), (3, 9)]):
        dedup(pages.filter((F.col("page_seq") >= a) & (F.col("page_seq") < b)), n)
        dedup(pages.filter((F.col("page_seq") >= a) & (F.col("page_seq") < b)), n)  # a batch that runs again changes nothing
    dedup.compact(str(tmp_path / "compact"), 3)
    assert jobs.IncrementalDedup(spark, str(tmp_path / "compact"), print).counts(9).count() == dedup.counts(9).select("domain", "para_hash").distinct().count()
    whole = pa.dedup_paragraphs(pa.split_pages(pages)).collect()
    rows = [tuple(r) for n in out for r in out[n]]
    assert sorted(rows) == sorted((r.domain, r.page_seq, r.url, r.idx, r.para) for r in whole)


def test_handoff_stream_equals_fold(spark):
    streamed = q.r_handoffs(spark, SF)
    last = {r.session_token: r for r in streamed.orderBy("seq").collect()}
    batch = cv.handoff_state(chat_queries.turns(spark, SF)).collect()
    assert {r.session_token: (";".join(r.pending), r.handoff_pending) for r in batch} == {k: (r.pending, r.handoff_pending) for k, r in last.items()}


def test_live_counts(spark):
    got = {r.domain: r.n for r in q.r_live_counts(spark, SF).collect()}
    assert sum(got.values()) == table(spark, SF, "events").count()


def test_incremental_dedup_reads_sums(spark, tmp_path):
    line = "a footer line that every page has"
    rows = [("d", i, f"u{i}", f"{line}\n[H2] Same heading\nown paragraph number {i} of the page") for i in range(8)]
    pages = spark.createDataFrame(rows, "domain string, page_seq long, url string, text string")
    out = {}
    dedup = jobs.IncrementalDedup(spark, str(tmp_path / "seen"), lambda df, n: out.update({n: df.collect()}), every=2)
    for n in range(8):
        dedup(pages.filter(F.col("page_seq") == n), n)
        if n in (3, 4):
            dedup(pages.filter(F.col("page_seq") == n), n)
    whole = pa.dedup_paragraphs(pa.split_pages(pages)).collect()
    assert sorted(tuple(r) for n in out for r in out[n]) == sorted((r.domain, r.page_seq, r.url, r.idx, r.para) for r in whole)
    files = [r[0] for r in dedup.counts(8).select(F.input_file_name()).distinct().collect()]
    assert files and all("before=8" in f for f in files)


def metered_one_by_one(rows, limit, thresholds):
    """(message, count, accepted, notice, threshold, period start) of messages in the order given."""
    held, out = {}, {}
    for domain, message, ts, plan in rows:
        day = ts.date()
        m = held.get(domain)
        if m is None or day >= m["reset"]:
            ((_, start, reset),) = fold_periods([day])
            m = held[domain] = {"start": start, "reset": reset, "n": 0, "told": set(), "noticed": False}
        free = plan == "free"
        accepted = not free or m["n"] < limit
        notice = not accepted and not m["noticed"]
        m["noticed"] |= notice
        m["n"] += accepted
        hit = [t for t in thresholds.get(domain) or THRESHOLDS if free and accepted and t not in m["told"] and 100 * m["n"] >= limit * t]
        m["told"] |= set(hit)
        out[message] = (m["n"], accepted, notice, max(hit, default=None), m["start"])
    return out


def test_quota_meter_equals_one_by_one(spark, tmp_path):
    rng = random.Random(11)
    start = dt.datetime(2024, 1, 29)
    rows = [(rng.choice("abbbbc"), i, start + dt.timedelta(hours=rng.randrange(24 * 75)), rng.choice(["free"] * 9 + ["paid", None])) for i in range(300)]
    rows.sort(key=lambda r: (r[2], r[1]))
    batches = [rows[:90], rows[90:91], rows[91:220], rows[220:]]
    batches[1].append(("b", 1000, start, "free"))  # late
    own = {"b": [10, 40, 100], "c": []}
    thresholds = spark.createDataFrame(list(own.items()), "domain string, thresholds array<int>")
    got = {}
    meter = jobs.QuotaMeter(spark, str(tmp_path / "state"), lambda df, n: got.update({r.message_id: (r.rn, r.accepted, r.notice, r.threshold, r.period_start) for r in df.collect()}), 20, thresholds)
    for n, batch in enumerate(batches):
        df = spark.createDataFrame(batch, "domain string, message_id long, ts timestamp, plan string")
        for _ in range(2 if n == 2 else 1):  # a batch that runs again changes nothing
            meter(df.unionByName(spark.createDataFrame([(None, -1, start, "free"), ("a", -2, None, "free")], df.schema)), n)
    expected = metered_one_by_one([r for b in batches for r in sorted(b, key=lambda r: (r[2], r[1]))], 20, own)
    assert got == expected


def test_quota_meter_forgets_idle_tenants(spark, tmp_path):
    rows = {}
    meter = jobs.QuotaMeter(spark, str(tmp_path / "state"), lambda df, n: rows.update({(n, r.domain, r.message_id): r.rn for r in df.collect()}), 20, idle_days=20)
    day = dt.datetime(2024, 1, 5)
    batch = lambda *m: spark.createDataFrame([(d, i, day + dt.timedelta(days=k), "free") for d, i, k in m], "domain string, message_id long, ts timestamp, plan string")
    meter(batch(("idle", 1, 0), ("busy", 2, 0)), 0)
    meter(batch(("busy", 3, 40), ("busy", 4, 41)), 1)
    state = lambda n: {r.domain for r in spark.read.parquet(f"{tmp_path}/state/batch={n}").collect()}
    assert state(1) == {"idle", "busy"}  # its period ended 9 days before the newest message
    meter(batch(("busy", 5, 60)), 2)
    assert state(2) == {"busy"}
    meter(batch(("idle", 6, 61), ("busy", 7, 61)), 3)
    assert rows[3, "idle", 6] == 1 and rows[3, "busy", 7] == 4
    assert sorted(x for x in os.listdir(tmp_path / "state") if x.startswith("batch=")) == ["batch=2", "batch=3"]


def test_idle_sessions_lose_their_state(spark, tmp_path):
    """Batches a file each; after the idle time of event time a session starts anew, others go on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    day = dt.datetime(2024, 1, 5)
    schema = "domain string, session_token string, seq long, ts timestamp, handoff string, cancel string"
    turns = [[("d", "idle", 1, 0, "q1"), ("d", "busy", 1, 0, "b1")], [("d", "busy", 2, 50, "b2")], [("d", "busy", 3, 100, "b3")], [("d", "busy", 4, 150, "b4")], [("d", "idle", 2, 160, "q2"), ("d", "busy", 5, 161, "b5")]]
    for n, batch in enumerate(turns):
        rows = [(d, s, k, day + dt.timedelta(minutes=m), q, None) for d, s, k, m, q in batch]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/part={n}"))
        os.utime(next((tmp_path / f"in/part={n}").glob("*.parquet")), (1_700_000_000 + n, 1_700_000_000 + n))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/part=*"))
    out = []
    jobs.run_to_end(jobs.handoff_stream(stream, idle_minutes=60), str(tmp_path / "check"), "append", lambda df, n: out.extend(df.collect()))
    pending = {(r.session_token, r.seq): r.pending for r in out}
    assert pending["busy", 5] == ["b1", "b2", "b3", "b4", "b5"]
    assert pending["idle", 1] == ["q1"] and pending["idle", 2] == ["q2"]


def test_expired_days_of_a_log_are_dropped(spark, tmp_path):
    now = dt.datetime(2024, 3, 1, 12)
    store = jobs.LogStore(spark, str(tmp_path / "log"), "log_id long, created_at timestamp", 30)
    rows = lambda *days: spark.createDataFrame([(i, None if d is None else now - dt.timedelta(days=d)) for i, d in days], "log_id long, created_at timestamp")
    assert store.rows(now).count() == 0 and store.expire(now) == []
    store.append(rows((1, 0), (2, 29), (3, 30), (4, 31), (5, 45), (6, None)), 0)
    for _ in range(2):  # a batch that runs again changes nothing
        store.append(rows((7, 1), (8, 31), (9, 30.2)), 1)
    left = lambda: sorted(r.log_id for r in store.rows(now).collect())
    assert left() == [1, 2, 3, 6, 7]
    assert store.expire(now) == ["2024-01-16", "2024-01-30"]
    assert left() == [1, 2, 3, 6, 7] and store.expire(now) == []
    assert spark.read.parquet(str(tmp_path / "log")).count() == 6  # the boundary day stays whole
