"""Stored tables: replaced in buckets, resumed where a job has died."""

import pytest
from pyspark.sql import functions as F

from kbspark.sources import writes

SCHEMA = "domain string, url string, content string, source string"


def rows_of(spark, path):
    return sorted((tuple(r) for r in writes.stored_rows(spark, path, SCHEMA).collect()), key=str)


@pytest.fixture
def stored(spark, tmp_path):
    old = [(f"d{k}", f"u{u}", f"old {k} {u}", s) for k in range(30) for u, s in ((1, "scraped"), (1, None), (2, "scraped"), (2, "manual"))]
    path = str(tmp_path / "chunks")
    writes.store_rows(spark.createDataFrame(old, SCHEMA), path, SCHEMA, 8)
    assert rows_of(spark, path) == sorted(old, key=str)
    return path, old


def changed(spark):
    fresh = spark.createDataFrame([(f"d{k}", "u1", f"new {k}", "scraped") for k in (3, 4, 11)], SCHEMA)
    return fresh, lambda old: writes.replace_chunks(old, fresh)


def test_only_touched_buckets_are_read_and_written(spark, stored, tmp_path):
    path, old = stored
    fresh, change = changed(spark)
    before = {f: m for f, m in files(path)}
    writes.rewrite_stored(spark, path, SCHEMA, fresh.select("domain"), change, str(tmp_path / "result"), 8)
    want = [r for r in old if not (r[0] in ("d3", "d4", "d11") and r[1] == "u1")] + [tuple(r) for r in fresh.collect()]
    assert rows_of(spark, path) == sorted(want, key=str)
    touched = {r[0] for r in fresh.select(writes.bucket_of(F.col("domain"), 8)).collect()}
    same = {f for f, m in files(path) if before.get(f) == m}
    assert {f for f in before if f"bucket={f.split('bucket=')[1][0]}" not in {f"bucket={b}" for b in touched}} <= same


def files(path):
    import os

    return [(os.path.join(d, f), os.stat(os.path.join(d, f)).st_mtime_ns) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")]


@pytest.mark.parametrize("dies", ["before the result", "before the buckets", "between two buckets"])
def test_a_job_that_dies_is_run_again(spark, stored, tmp_path, monkeypatch, dies):
    path, old = stored
    fresh, change = changed(spark)
    plain, result, calls = writes._into, str(tmp_path / "result"), []

    def broken(*args):
        raise RuntimeError("killed")

    def half(rows, to, buckets):  # one bucket is new, of another the folder has gone and is not there yet
        some = sorted({r[0] for r in rows.select(writes.bucket_of(F.col("domain"), buckets)).collect()})
        plain(rows.filter(writes.bucket_of(F.col("domain"), buckets) == some[0]), to, buckets)
        writes.drop_folder(spark, f"{to}/bucket={some[-1]}")
        raise RuntimeError("killed")

    def once_only(rows):
        calls.append(1)
        return change(rows)

    with monkeypatch.context() as m:
        if dies != "before the result":
            m.setattr(writes, "_into", broken if dies == "before the buckets" else half)
        with pytest.raises(RuntimeError):
            writes.rewrite_stored(spark, path, SCHEMA, fresh.select("domain"), broken if dies == "before the result" else once_only, result, 8)
    found = rows_of(spark, path)
    if dies != "between two buckets":
        assert found == sorted(old, key=str)
    else:  # old or new rows of a page, never both
        for k in (3, 4, 11):
            contents = {r[2] for r in found if r[0] == f"d{k}" and r[1] == "u1"}
            assert not ({f"new {k}", f"old {k} 1"} <= contents)
    writes.rewrite_stored(spark, path, SCHEMA, fresh.select("domain"), once_only, result, 8)
    want = [r for r in old if not (r[0] in ("d3", "d4", "d11") and r[1] == "u1")] + [tuple(r) for r in fresh.collect()]
    assert rows_of(spark, path) == sorted(want, key=str)
    assert len(calls) == 1


def test_a_bucket_that_loses_all_rows_is_emptied(spark, stored, tmp_path):
    path, old = stored
    gone = spark.createDataFrame([(f"d{k}",) for k in range(30)], "domain string")
    writes.rewrite_stored(spark, path, SCHEMA, gone, lambda rows: rows.filter("domain = 'd1'"), str(tmp_path / "result"), 8)
    assert {r[0] for r in rows_of(spark, path)} == {"d1"}
