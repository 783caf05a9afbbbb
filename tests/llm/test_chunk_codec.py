import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kbspark.llm import chunk_codec as C
from kbspark.llm.queries import QUERIES, vocabulary
from tokenizers import Tokenizer

SIGNS = [*"ab'sretvm d\n\t  \x1c\x85é́Σς12३中🙂 ", "<|endoftext|>", "<|startoftext|>", "'re", "'ll", "İ", "ﬁ"]


@pytest.fixture(scope="module")
def words():
    return vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library(words):
    tokenizer = Tokenizer.from_file(words)
    return lambda text: tuple(tokenizer.encode(text or "", add_special_tokens=False).ids)


def texts(seed, n):
    """Texts that share long stretches, at any offset and with joins inside words, marks and special strings."""
    r = random.Random(seed)
    some = lambda k: "".join(r.choice(SIGNS) for _ in range(k))
    common = [some(r.choice([300, 900, 3000])) for _ in range(25)]
    return ["".join(r.choice(common) if r.random() < 0.6 else some(r.choice([0, 1, 5, 80, 600])) for _ in range(r.choice([0, 1, 2, 5]))) for _ in range(n)]


def test_ids_and_texts_are_the_librarys(spark, words, library):
    rows = list(enumerate(texts(1, 300)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = C.decode(C.encode(docs, words), words).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((i, library(t)) for i, t in rows)
    tokenizer = Tokenizer.from_file(words)
    assert all(r.decoded == tokenizer.decode(list(r.ids), skip_special_tokens=False) for r in got)


def test_awkward_rows(spark, words, library):
    long = "abc" * 40_000
    rows = [(1, None), (2, ""), (3, " " * 5000), (4, "x" * 50_000), (5, long + " " + long), (5, long + " " + long), (None, "no id"), (None, "no id"), (6, "é" * 3000 + " " + "é" * 3000)]
    docs = spark.createDataFrame([(*r, "clash", 3, [1]) for r in rows], "doc_id long, text string, ids string, row long, chunk array<int>")
    got = C.encode(docs, words).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((i, library(t)) for i, t in rows)
    assert C.encode(docs.limit(0), words).collect() == []
    assert C.decode(spark.createDataFrame([(1, None), (2, [])], "k int, ids array<int>"), words).collect()[0]["decoded"] is None


def test_other_id_types_and_columns(spark, words, library):
    docs = spark.createDataFrame([("k", "some text"), (None, "more")], "name string, body string")
    got = {r.name: tuple(r.ids) for r in C.encode(docs, words, "name", "body").collect()}
    assert got == {"k": library("some text"), None: library("more")}


def test_shared_chunks_are_encoded_once(spark, words):
    r = random.Random(3)
    passage = " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(600))
    docs = spark.createDataFrame([(i, f"own{i} " + passage + f" end{i}") for i in range(40)], "doc_id long, text string").repartition(4)
    keys = C.shared_keys(docs)
    assert keys.filter("n = 40").count() == keys.count() > 2
    sieve = C.build_sieve(keys, "h1", keys.count())
    pieces = C.text_pieces(docs.select(F.col("doc_id").alias("id"), "text"), words, sieve, "bigint")
    own = pieces.filter("ids IS NOT NULL").agg(F.sum(F.size("ids"))).first()[0]
    whole = C.encode(docs, words).agg(F.sum(F.size("ids"))).first()[0]
    assert own < 0.5 * whole  # the rest comes from the chunks
    sent = pieces.filter("chunk IS NOT NULL").count()
    assert sent <= 4 * keys.count()  # once a task


def test_cuts_depend_on_content_alone():
    r = np.random.default_rng(0)
    passage = r.integers(97, 105, 20_000, dtype=np.uint8)
    passage[r.integers(0, 20_000, 4000)] = 32
    stretches = []
    for before in (0, 1, 777):
        data = np.concatenate([np.full(before, 120, np.uint8), passage])
        starts, ends = C.cores(data, np.array([0, len(data)]))
        stretches.append({data[a:z].tobytes() for a, z in zip(starts, ends)})
    assert len(stretches[0]) > 20
    assert all(len(s & stretches[0]) >= len(s) - 2 for s in stretches)


def test_a_run_of_one_letter_is_not_cut_everywhere():
    for letter in range(256):
        starts, ends = C.cores(np.full(3000, letter, np.uint8), np.array([0, 3000]))
        assert len(starts) <= 2


def test_rolling_hash_is_of_its_window():
    data = np.random.default_rng(1).integers(0, 256, 500, dtype=np.uint8)
    h = C.rolling(data)
    for i in range(C.WINDOW, 500, 37):
        assert h[i] == C.rolling(data[i - C.WINDOW + 1 : i + 1])[-1]


def test_buffers_of_slices():
    column = pa.array(["ab", "", "cde", "é"]).slice(1, 3)
    data, bounds = C.buffer_of(column)
    assert data.tobytes() == "cdeé".encode() and bounds.tolist() == [0, 0, 3, 5]
    assert list(C.pieces_of(column, 3)) == [(0, 2), (2, 3)]


def test_query(spark, library):
    import hashlib

    import pyarrow.parquet as pq

    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    got = QUERIES["op12_bpe_codec"](spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        ids = library(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def workers_of_a_task(node):
    """The most Python steps that one task runs at a time, in a plan below ``node``."""
    if node.nodeName() == "AdaptiveSparkPlan":
        return workers_of_a_task(node.executedPlan())
    children = [node.children().apply(k) for k in range(node.children().size())]
    below = max(map(workers_of_a_task, children), default=0)
    if "Exchange" in node.nodeName():
        assert below <= 1
        return 0
    return below + ("InArrow" in node.nodeName())


def test_a_task_of_the_result_has_one_python_worker(spark, words):
    docs = spark.createDataFrame(list(enumerate(texts(4, 60))), "doc_id long, text string")
    assert workers_of_a_task(C.decode(C.encode(docs, words), words)._jdf.queryExecution().executedPlan()) == 2
    got = QUERIES["op12_bpe_codec"](spark, "/root/testdata/sf0.001")
    assert workers_of_a_task(got._jdf.queryExecution().executedPlan()) == 1


def test_one_step_and_two_give_the_same(spark, words, library):
    rows = [*enumerate(texts(5, 200)), (None, None), (7, ""), (7, ""), (8, "one of its kind")]
    docs = spark.createDataFrame(rows, "name long, body string").repartition(5)
    got = C.encode_decode(docs, words, "name", "body")
    assert got.columns == ["name", "ids", "decoded"]
    tokenizer = Tokenizer.from_file(words)
    expected = [(i, library(t), tokenizer.decode(list(library(t)), skip_special_tokens=False)) for i, t in rows]
    assert Counter((r.name, tuple(r.ids), r.decoded) for r in got.collect()) == Counter(expected)
    assert C.encode_decode(docs.limit(0), words, "name", "body").collect() == []


def test_decoding_in_ranges(spark, words, library):
    some = [library("the first of them"), None, (), library("a " * 50), (), None, library("end")]
    encoded = spark.createDataFrame([(k, list(v) if v is not None else None) for k, v in enumerate(some)], "k int, ids array<int>").coalesce(1)
    tokenizer = Tokenizer.from_file(words)
    for limit in (1, 3, 1_000_000):
        got = {r.k: r.decoded for r in C.decode(encoded, words, limit=limit).collect()}
        assert got == {k: None if v is None else tokenizer.decode(list(v), skip_special_tokens=False) for k, v in enumerate(some)}
