"""The refresh as one job, the archive that stores a chunk once, vectors made once, and diffs that don't move texts."""

import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_build import made_pages

from kbspark.functions import text as t
from kbspark.operators import chunks as ch
from kbspark.operators import crawl as cr
from kbspark.plans import build, refresh_job
from kbspark.sources.archive import ChunkArchive
from kbspark.sources.tables import bucketed

def at(day):
    return F.lit(day).cast("timestamp")


def crawl(spark, changed=()):
    rows = [(d, n, u, (x + f"\n[H2] News\nAnd a line that was not there before, number {n} of them" if n in changed else x)) for d, n, u, x in made_pages()]
    df = spark.createDataFrame(rows, "domain string, page_seq long, url string, text string")
    return df.withColumns({"content_hash": t.content_hash(F.col("text")), "priority": t.priority(F.col("url"))})


def created(spark, path):
    base, pages = refresh_job.KnowledgeBase(path, 4), crawl(spark)
    chunks = build.stored_chunks(build.build_chunks(pages), ch.hashing_embedder(8), at("2024-01-01"))
    manual = spark.createDataFrame([("d0", "manual://d0/x", "typed in", "manual", "x", "m1")], "domain string, url string, content string, source string, label string, chunk_id string")
    chunks = chunks.drop("page_seq", "content_hash").unionByName(manual, allowMissingColumns=True)
    rows = pages.filter("page_seq <> 23").select(
        "domain", "url", "content_hash", "priority", F.lit(False).alias("used_renderer"), F.lit(True).alias("has_variants"), F.lit(1).alias("chunk_count"), at("2024-01-01").alias("last_scraped_at"), at("2024-01-01").alias("last_changed_at")
    )
    base.create(chunks, rows)
    return base


def tables(spark, base):
    key = lambda df: sorted(map(str, df.collect()))
    return key(base.chunks(spark)), key(base.pages(spark)), key(base.snapshots(spark)), key(base.archive(spark).archived().select("snapshot_id", "chunk_id", "url", "content"))


@pytest.fixture(scope="module")
def plain(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("plain")
    base = created(spark, str(path / "base"))
    before = tables(spark, base)
    shutil.copytree(path / "base", path / "copy")
    summary = refresh_job.refresh_job(base, crawl(spark, {0, 4, 9, 30}), ch.hashing_embedder(8), at("2024-02-01"), str(path / "job")).collect()
    return path, before, tables(spark, base), sorted(map(str, summary))


def test_refresh_replaces_archives_and_updates(spark, plain):
    _, before, after, _ = plain
    assert before[0] != after[0] and before[2] == [] and after[2] and after[3]
    assert any("manual://d0/x" in r for r in after[0])
    gone = {r for r in before[0] if r not in after[0]}
    assert len(gone) == len(after[3])  # what was replaced is in the archive
    assert any("d1.com/a/23" in r for r in after[1]) and not any("d1.com/a/23" in r for r in before[1])


def test_a_job_that_stops_after_any_step_is_resumed(spark, plain, tmp_path, monkeypatch):
    path, _, after, summary = plain
    shutil.copytree(path / "copy", tmp_path / "base")
    base, runs = refresh_job.KnowledgeBase(str(tmp_path / "base"), 4), []
    steps = refresh_job.run_steps

    def stopping(spark, folder, given):
        runs.append(1)
        return steps(spark, folder, given[: len(runs)]) if len(runs) < len(given) else steps(spark, folder, given)

    monkeypatch.setattr(refresh_job, "run_steps", lambda *a: stopping(*a) | {"summary": None} if len(runs) < 6 else stopping(*a))
    for _ in range(7):
        got = refresh_job.refresh_job(base, crawl(spark, {0, 4, 9, 30}), ch.hashing_embedder(8), at("2024-02-01"), str(tmp_path / "job"))
    assert tables(spark, base) == after and sorted(map(str, got.collect())) == summary
    again = refresh_job.refresh_job(base, crawl(spark, {0, 4, 9, 30}), ch.hashing_embedder(8), at("2024-02-01"), str(tmp_path / "job"))
    assert tables(spark, base) == after and again.count() == len(summary)


def test_a_step_that_dies_after_its_change_gives_the_same_again(spark, plain, tmp_path):
    """The marker of each changing step is lost, as where the driver dies between the change and its note."""
    path, _, after, _ = plain
    shutil.copytree(path / "copy", tmp_path / "base")
    base = refresh_job.KnowledgeBase(str(tmp_path / "base"), 4)
    run = lambda: refresh_job.refresh_job(base, crawl(spark, {0, 4, 9, 30}), ch.hashing_embedder(8), at("2024-02-01"), str(tmp_path / "job"))
    run()
    for step in ("replaced", "upserted"):
        shutil.rmtree(tmp_path / "job" / step)
        run()
        assert tables(spark, base) == after


def test_archive_stores_a_chunk_once(spark, tmp_path):
    schema = "domain string, url string, content string, n int"
    rows = [("a", "u1", "x", 1), ("a", "u1", "x", 1), ("a", "u2", None, 2), ("b", "u1", "x", 1)]
    chunks, archive = spark.createDataFrame(rows, schema), ChunkArchive(spark, str(tmp_path / "archive"), schema, 4)
    for k in range(10):
        archive.add(chunks.withColumn("snapshot_id", F.concat(F.lit(f"s{k}-"), "domain")))
    archive.add(chunks.withColumn("snapshot_id", F.concat(F.lit("s9-"), "domain")))  # once more
    counts = {r.domain: (r.rows, r.members) for r in archive.counts().collect()}
    assert counts == {"a": (2, 30), "b": (1, 10)}
    back = archive.archived(spark.createDataFrame([("a", "s3-a")], "domain string, snapshot_id string"))
    assert sorted(map(str, back.select("domain", "url", "content", "n").collect())) == sorted(str(r) for r in chunks.filter("domain = 'a'").collect())
    archive.add(spark.createDataFrame([("a", "u9", "new", 1, "s10-a")], schema + ", snapshot_id string"))
    kept = spark.createDataFrame([("s10-a",), ("s1-b",)], "snapshot_id string")
    for _ in range(2):
        archive.prune(kept, str(tmp_path / "prune"))
        assert {r.domain: (r.rows, r.members) for r in archive.counts().collect()} == {"a": (1, 1), "b": (1, 1)}


def test_each_content_is_embedded_once(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def counting(fail=None):
        def embed(texts):
            import uuid

            if fail and any(x.startswith(fail) for x in texts):
                raise RuntimeError("the service is away")
            (log / uuid.uuid4().hex).write_text("\n".join(texts))
            return np.array([[len(x), 1.0] for x in texts])

        return embed

    rows = [(d, f"text {k % 12}") for d in "abc" for k in range(30)] + [("a", None)]
    chunks = spark.createDataFrame(rows, "domain string, content string").withColumn("content_hash", F.sha2("content", 256))
    store = str(tmp_path / "store")
    with pytest.raises(Exception):
        ch.embedded_once(chunks, store, counting("text 7"), 2, 3).collect()
    kept = spark.read.parquet(store).count()
    got = ch.embedded_once(chunks, store, counting(), 2, 3).collect()
    assert kept < 12 and len(got) == len(rows)
    assert all((r.embedding is None) == (r.content is None) and (r.content is None or r.embedding == [len(r.content), 1.0]) for r in got)
    calls = [x for f in log.iterdir() for x in f.read_text().split("\n")]
    in_store = spark.read.parquet(store).count()
    assert in_store == 12 and len(calls) - len(set(calls)) <= 3  # texts of the part that failed, at most
    ch.embedded_once(chunks.unionByName(chunks.withColumn("domain", F.lit("z"))), store, counting(), 2, 3).collect()
    assert len([x for f in log.iterdir() for x in f.read_text().split("\n")]) == len(calls)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_diff_moves_no_text(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pages = crawl(spark)
        pages.write.parquet(str(tmp_path / "crawl"))
        crawled = spark.read.parquet(str(tmp_path / "crawl"))
        stored = crawled.select("domain", "url", "content_hash", F.lit(True).alias("has_variants"), at("2024-01-01").alias("last_scraped_at"))
        plan = plan_of(cr.diff_pages(crawled, stored))
        below = plan[plan.index("Exchange") :]
        outputs = [line for line in plan.split("\n") if "Exchange" in line]
        assert outputs and "text" in plan
        for k, line in enumerate(plan.split("\n")):
            if "Exchange" in line:  # what an exchange moves is what the project below it gives
                project = next(x for x in plan.split("\n")[k + 1 :] if "Project" in x)
                assert ", text#" not in project.split("AS")[0] and "[text#" not in project
        assert below
        key = lambda df, name: bucketed(df.withColumn("url_key", t.url_key(F.col("url"))), name, ["domain", "url_key"], str(tmp_path / name), 4)
        both = cr.diff_pages(key(crawled, "crawl_b"), key(stored, "stored_b"))
        assert "Exchange" not in plan_of(both)
        texts = build.texts_of(spark.table("crawl_b"), both.filter("change = 'changed'"), 0)
        assert texts.count() == 0
        assert sorted(map(str, both.select("page_seq", "change", "thin").collect())) == sorted(map(str, cr.diff_pages(crawled, stored).select("page_seq", "change", "thin").collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS crawl_b")
        spark.sql("DROP TABLE IF EXISTS stored_b")
