import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from kbspark.llm import decontam, near_dup, oracles, packing, quality, queries
from kbspark.sources.tables import table
from test_near_dup import brute as near_brute
from tests_same import same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(oracles.ORACLES))
def test_query_against_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    same(df.collect(), df.columns, duck, oracles.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracles.ORACLES)))
def test_other_queries_run(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert "doc_id" in df.columns
    n, docs = df.count(), table(spark, SF, "documents").count()
    assert n >= docs if name.split("_")[0] in ("op1", "op2", "op4", "op6") else n > 0


def test_stages(spark):
    docs = table(spark, SF, "documents")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, seen, SF)
        assert after.columns == docs.columns, name
        seen = spark.createDataFrame(after.collect(), docs.schema)
    assert 0 < seen.count() < docs.count()
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in seen.collect()}


def test_stage_decisions(spark):
    docs, labels, bench = table(spark, SF, "documents"), table(spark, SF, "labels"), table(spark, SF, "benchmark")
    kept = {r.doc_id for r in corpus_pipeline.keep_good(spark, docs, SF).collect()}
    assert kept == {r.doc_id for r in quality.score_documents(docs, labels).filter("predicted = 1").collect()}
    ones = {r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, SF).collect()}
    assert ones == {r.class_id for r in near_dup.near_duplicates(docs).collect()}
    clean = {r.doc_id for r in corpus_pipeline.drop_benchmark(spark, docs, SF).collect()}
    bad = {r.doc_id for r in decontam.contaminated(docs, bench).collect()}
    assert clean == {r.doc_id for r in docs.collect()} - bad


def plain_lines(rows):
    """Line dedup in plain Python: {doc_id: text}."""
    pages, seen = Counter(r.source for r in rows), Counter()
    space = " \t\n\x0b\x0c\r"
    for r in rows:
        seen.update((r.source, x) for x in {x.strip(space) for x in (r.text or "").split("\n")} if x)
    gone = {k for k, n in seen.items() if n >= 5 and n > 0.1 * pages[k[0]]}
    return {r.doc_id: r.text and "\n".join(x for x in r.text.split("\n") if (r.source, x.strip(space)) not in gone) for r in rows}


def plain_contaminated(docs, items):
    """Ids of documents with a benchmark passage, by comparing at every shift."""
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    number = {}
    coded = lambda t: np.array([number.setdefault(w, len(number)) for w in words(t)], int)
    items, out = [coded(t) for t in items], set()
    for i, text in docs.items():
        d = coded(text)
        for v in items:
            least = 11 if len(v) >= 13 else -(-8 * len(v) // 10)
            if len(d) == 0 or np.isin(d, v).sum() < least:
                continue
            for shift in range(-len(v), len(d)):
                lo, hi = max(0, -shift), min(len(v), len(d) - shift)
                equal = v[lo:hi] == d[lo + shift : hi + shift]
                if equal.sum() >= least:
                    s, e = decontam.longest_overlap(equal, 0.8)
                    if len(v) < 13 or e - s >= 13:
                        out.add(i)
    return out


def test_run_against_plain_python(spark):
    """Each stage's rows from those before it, without Spark; only the classifier's verdicts are taken as they are."""
    docs = table(spark, SF, "documents")
    good = corpus_pipeline.keep_good(spark, docs, SF).collect()
    texts = plain_lines(good)
    classes = near_brute(sorted(texts.items()))
    texts = {i: t for i, t in texts.items() if classes[i] == i}
    texts = {i: t for i, t in texts.items() if i not in plain_contaminated({i: t}, [r.text for r in table(spark, SF, "benchmark").collect()])}
    tokens = Tokenizer.from_file(queries.vocabulary())
    want = {i: len(tokens.encode(t or "", add_special_tokens=False).ids) for i, t in texts.items()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {i: sum(r.n_tokens for r in got if r.doc_id == i) for i in {r.doc_id for r in got}} == want
    pieces = Counter(min(4096, n - a) for n in want.values() for a in range(0, max(1, n), 4096))
    bounds = sorted({r.bucket_len for r in got})
    assert bounds == packing.optimal_boundaries(list(pieces), list(pieces.values()), 16)
    assert all(r.bucket_len == min(b for b in bounds if b >= r.n_tokens) for r in got)
    slots = Counter((r.bucket, r.batch) for r in got)
    assert all(n <= max(1, 131_072 // max(1, bounds[b])) for (b, _), n in slots.items()) and len({(r.bucket, r.batch, r.slot) for r in got}) == len(got)


def test_stages_take_odd_rows(spark, odd):
    seen = odd.select("doc_id", "text", "lang", "source", "n_chars", "score", "id", "held_out", "words", "bands")
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, seen, SF)
        rows = after.collect()
        if name != "packing":
            assert after.columns == seen.columns, name
            seen = spark.createDataFrame(rows, seen.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0
