import gzip
import hashlib
import os
import uuid
from collections import Counter

from pyspark.sql import functions as F

from kbspark.llm import warc


def test_round_trip(spark, tmp_path):
    big, other = "<p>é" + "x" * 1200, "<p>" + "y" * 5000
    rows = [(1, "http://a/1", big), (2, "http://a/2\r\nX: y", big), (3, None, "small"), (4, "http://a/4", "small"), (5, "u", other), (6, "u", None), (7, "u", ""), (9, "u", big), (None, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit("clash"), "key": F.lit(1), "kind": F.lit("k")})
    made = warc.write_archives(pages.repartition(3), str(tmp_path), roll_bytes=300)
    got = {r.page_id: r for r in warc.read_archives(made, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for key, url, html in rows:
        body = (html or "").encode()
        assert got[key].payload_bytes == len(body) and got[key].payload_digest == hashlib.sha1(body).hexdigest()
    assert {k: (r.record_type, r.refers_to) for k, r in got.items() if r.record_type == "revisit"} == {1: ("revisit", 9), 2: ("revisit", 9), None: ("revisit", 9)}
    assert made.count() > 1 and not [f for f in os.listdir(tmp_path) if f.startswith("_temporary")]
    for row in made.collect():
        data = (tmp_path / row.file).read_bytes()
        assert hashlib.sha1(data).hexdigest() == row.sha1 and gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_same_rows_same_bytes(spark, tmp_path):
    """Whatever the partitions; and shards are exact quantiles of the payload bytes."""
    rows = [(i if i % 7 else None, f"u{i}", f"{i % 50}" + "z" * (i * 40)) for i in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    made = []
    for n in (1, 3, 8):
        folder = str(tmp_path / str(n))
        manifest = warc.write_archives(pages.repartition(n), folder, shard_bytes=50_000)
        made.append(manifest.orderBy("shard", "part").select("shard", "part", "file", "n_records", "sha1").collect())
        assert warc.read_archives(manifest, folder).count() == 120
    assert made[0] == made[1] == made[2] and len(made[0]) > 3
    order = sorted(((k is not None, k or 0, hashlib.sha1(t.encode()).hexdigest(), len(t)) for k, _, t in rows))
    at, want = 0, Counter()
    for _, _, _, n in order:
        want[at // 50_000] += 1
        at += n
    assert [r.n_records for r in made[0]] == [want[k] for k in sorted(want)]


def test_ids_are_uuids(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a" * 30)] * 400 + [(None, "u", None)], "page_id long, url string, html string")
    made = warc.write_archives(pages, str(tmp_path))
    records = [fields for r in made.collect() for fields, _ in warc.read_records(str(tmp_path), r.file)]
    assert len(records) == 401 + made.count()
    for fields in records:
        assert str(uuid.UUID(fields["WARC-Record-ID"][1:-1].removeprefix("urn:uuid:"))) in fields["WARC-Record-ID"]


def test_repeats_and_empty(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "q" * 2000), (1, "u", "q" * 2000), (0, "u", "q" * 2000)], "page_id long, url string, html string")
    rows = warc.read_archives(warc.write_archives(pages, str(tmp_path)), str(tmp_path)).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in rows) == [(0, "revisit", 1), (1, "response", None), (1, "response", None)]
    none = warc.write_archives(pages.limit(0), str(tmp_path))
    assert none.count() == 0 and warc.read_archives(none, str(tmp_path)).count() == 0


def test_another_jobs_open_files_stay(spark, tmp_path):
    other = tmp_path / "_temporary-other"
    other.mkdir()
    (other / "open").write_text("x")
    warc.write_archives(spark.createDataFrame([(1, "http://a", "html")], "page_id long, url string, html string"), str(tmp_path))
    assert (other / "open").read_text() == "x" and len([f for f in os.listdir(tmp_path) if f.startswith("_temporary")]) == 1
