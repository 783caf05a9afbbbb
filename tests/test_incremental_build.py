"""Builds while a crawl runs: any split into batches gives the chunks of one build."""

import random

import pytest
from pyspark.sql import functions as F
from test_build import made_pages

from kbspark.plans import build, kb_queries
from kbspark.streaming import queries
from kbspark.streaming.build import IncrementalBuild, end_of_crawls

COLUMNS = ["domain", "page_seq", "url", "content", "chunk_index", "page_h1", "section_h2", "label", "source_urls", "content_hash"]


def pages_of(spark):
    rows = made_pages()
    rows += [("d0", 50, rows[3][2] + "?again", "[H1] An old page\nwhich was fetched before under another query"), ("d1", 51, rows[4][2], rows[4][3])]
    return spark.createDataFrame(rows, "domain string, page_seq long, url string, text string").withColumn("last", F.lit(False))


def rows_of(df):
    return sorted((tuple(str(x) for x in r) for r in df.select(*COLUMNS).collect()))


@pytest.fixture(scope="module")
def expected(spark):
    return rows_of(build.build_chunks(build.first_of_each_url(pages_of(spark).drop("last"))))


def built(spark, tmp_path, splits, reruns=(), every=2):
    pages, out = pages_of(spark), {}
    job = IncrementalBuild(spark, str(tmp_path / "state"), lambda df, n: out.update({n: rows_of(df)}), every=every)
    batches = [pages.filter((F.col("page_seq") >= a) & (F.col("page_seq") < b)) for a, b in zip(splits, splits[1:])] + [end_of_crawls(pages)]
    for n, batch in enumerate(batches):
        for _ in range(2 if n in reruns else 1):
            job(batch, n)
    return out, job


@pytest.mark.parametrize("splits, reruns", [([0, 99], ()), ([0, 7, 8, 20, 99], (1, 4)), ([0, 3, 6, 9, 12, 15, 18, 99], (3, 5))])
def test_any_split_gives_the_chunks_of_one_build(spark, tmp_path, expected, splits, reruns):
    out, _ = built(spark, tmp_path, splits, reruns)
    assert sorted(r for n in out for r in out[n]) == expected
    last = max(out)
    assert out[last] and any(out[n] for n in out if n != last)  # normal pages at once, thin ones at the end


def test_a_crawl_after_the_end_starts_anew_and_old_folders_go(spark, tmp_path, expected):
    out, job = built(spark, tmp_path, [0, 10, 99], every=2)
    again = {}
    job.sink = lambda df, n: again.update({n: rows_of(df)})
    pages = pages_of(spark)
    for n, (a, b) in enumerate([(0, 5), (5, 9), (9, 14), (14, 99)], 3):
        job(pages.filter((F.col("page_seq") >= a) & (F.col("page_seq") < b)), n)
    one = pages.filter("domain = 'd1'").limit(0).unionByName(end_of_crawls(pages.filter("domain = 'd1'")))
    job(one, 7)
    job(end_of_crawls(pages.filter("domain = 'd0'")), 8)
    assert sorted(r for n in again for r in again[n]) == expected
    assert min(job.state._numbers("thin", "batch")) > 0
    assert job.state.rows("visited", 9).count() == 0


def test_a_page_with_its_end_marker_and_an_empty_batch(spark, tmp_path, expected):
    pages, out = pages_of(spark), {}
    job = IncrementalBuild(spark, str(tmp_path / "state"), lambda df, n: out.update({n: rows_of(df)}))
    job(pages.limit(0), 0)
    job(pages.unionByName(end_of_crawls(pages)), 1)
    assert out[0] == [] and out[1] == expected


def test_query_gives_the_rows_of_the_build(spark):
    folder = "/root/testdata/sf0.001"
    key = lambda df: sorted(tuple(str(x) for x in r) for r in df.collect())
    assert key(queries.r_incremental_build(spark, folder)) == key(kb_queries.w1_chunks(spark, folder))
