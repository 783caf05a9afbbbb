import random
from itertools import combinations

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kbspark.llm import packing
from kbspark.llm.queries import vocabulary
from kbspark.llm.tokens import Encoder, in_pieces


def cost(bounds, histogram):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in histogram.items())


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(0, 60), st.integers(1, 50), min_size=1, max_size=8), st.integers(1, 5))
def test_boundaries_are_optimal(histogram, k):
    got = packing.optimal_boundaries(list(histogram), list(histogram.values()), k)
    top = max(histogram)
    best = min(cost([*c, top], histogram) for r in range(k) for c in combinations([n for n in histogram if n != top], min(r, len(histogram) - 1)))
    assert len(got) <= k and got == sorted(got) and cost(got, histogram) == best


def test_no_lengths():
    assert packing.optimal_boundaries([], [], 4) == []


@pytest.mark.parametrize("rows_per_salt", [3, 1000])
def test_every_token_once(spark, rows_per_salt):
    rows = [(i, n) for i, n in enumerate([0, 1, 5, 5, 5, 7, 20, 33, 64, 65, 200, 0, 3] * 4)] + [(None, 4), (3, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, n long")
    got = packing.pack(docs, F.col("n"), max_len=64, buckets=4, batch_tokens=128, rows_per_salt=rows_per_salt).collect()
    assert sum(r.n_tokens for r in got) == sum(n for _, n in rows)
    assert len({r.bucket_len for r in got}) <= 4 and all(r.n_tokens <= r.bucket_len for r in got)
    groups = {}
    for r in got:
        groups.setdefault((r.bucket, r.batch), []).append(r)
    last = {}
    for (bucket, batch), rs in groups.items():
        room = max(1, 128 // max(1, rs[0].bucket_len))
        assert sorted(r.slot for r in rs) == list(range(len(rs))) and len(rs) <= room
        last.setdefault(bucket, []).append((batch, len(rs), room))
    for batches in last.values():
        assert [b for b, _, _ in sorted(batches)] == list(range(len(batches))) and all(n == room for _, n, room in sorted(batches)[:-1])
    piece = [(r.piece, r.start, r.n_tokens) for r in got if r.doc_id == 10]
    assert sorted(piece) == [(0, 0, 64), (1, 64, 64), (2, 128, 64), (3, 192, 8)]


def test_odd_cases(spark, odd):
    got = packing.pack(odd, packing.token_counts(vocabulary())(F.col("text"))).collect()
    assert {r.doc_id for r in got} == {1, 2, 3, 4, 5, 6, 7, 8, None} and sum(r.n_tokens == 0 for r in got) == 2
    assert packing.pack(odd.limit(0), F.lit(1)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(odd, F.lit(1), max_len=0)


def held_in_workers(spark):
    """What is left in the Python workers that tasks find: the most of any."""

    def left(batches):
        from kbspark.llm import shared

        for b in batches:
            yield pa.record_batch([pa.array([len(shared.WORKER_CACHES)] * b.num_rows, pa.int64())], ["n"])

    return max(r.n for r in spark.range(0, 32, 1, 16).mapInArrow(left, "n long").collect())


def test_counting_leaves_no_encoder_in_a_worker(spark):
    texts = ["the first text of all", "", None, "a naïve 漢字 text  with   odd\u00a0spaces <|endoftext|> ", "x" * 3000] * 8
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.n for r in docs.select("doc_id", packing.token_counts(vocabulary())(F.col("text")).alias("n")).collect()}
    whole = Tokenizer.from_file(vocabulary())
    assert got == {i: len(whole.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert held_in_workers(spark) == 0


def test_counts_with_a_full_table():
    some = random.Random(3)
    texts = [" ".join(f"{some.choice(['w', 'é', '漢', 'A1', '--'])}{some.randrange(400)}" for _ in range(some.randrange(60))) + some.choice(["", " ", "\n"]) for _ in range(300)]
    small, whole = Encoder(vocabulary(), cache_words=50), Tokenizer.from_file(vocabulary())
    want = [len(whole.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [n for i, j in in_pieces(texts, 2000) for n in small.count(texts[i:j])] == want
