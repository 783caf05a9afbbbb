import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from kbspark.llm import token_io, tokens
from kbspark.llm.queries import vocabulary


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(vocabulary())


def test_encoder_equals_library(plain):
    rng = random.Random(2)
    parts = ["a", "b", " ", " ", "\n", ",", ".", "'s", "'", "1", "é", "\u3000", "漢", "🙂", "٣", "T", "\t", "\x85", "\x1c", "\xa0", "  ", "\r\n", "<|endoftext|>", "<|", "ñu", "ª", "×", "\0", "don't", "the", " of"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["end <|endoftext|> of text", "two  <|endoftext|>", "", " ", "a "]
    small, large = tokens.Encoder(vocabulary(), 40), tokens.Encoder(vocabulary())
    for k in range(0, len(texts), 100):
        some = texts[k : k + 100]
        want = [np.asarray(e.ids, "<u4").tobytes() for e in plain.encode_batch(some, add_special_tokens=False)]
        assert small.encode(some) == want and large.encode(some) == want and large.count(some) == [len(w) // 4 for w in want]
        assert len(small.words.keys) <= max(40, sum(len(t.split(" ")) for t in some))
    assert small.encode([]) == []


@pytest.mark.parametrize("kind", ["bit", "byte"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint64).astype("<u4")
    assert (token_io.from_planes(token_io.to_planes(ids, kind), n) == ids).all()
    low = (ids & 1).astype("<u4")
    assert (token_io.from_planes(token_io.to_planes(low, kind), n) == low).all()


def expected(plain, rows):
    at, out = 0, []
    for doc_id, text in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("planes", ["bit", "byte"])
def test_files(spark, plain, tmp_path, planes):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma."]) for _ in range(rng.randint(0, 300)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    made = token_io.write_tokens(docs, str(tmp_path), vocabulary(), block=64, planes=planes, shard_tokens=1000)
    got = sorted(map(tuple, token_io.read_documents(made, str(tmp_path)).collect()))
    assert got == expected(plain, rows)
    shards = made.orderBy("shard", "part").collect()
    assert len(shards) > 3 and all(a.last_doc < b.first_doc for a, b in zip(shards, shards[1:]))
    reader = token_io.ShardReader(str(tmp_path), shards[0].file)
    whole = reader.ids(0, shards[0].n_tokens)
    assert len(whole) == shards[0].n_tokens and (reader.ids(60, 200) == whole[60:200]).all()


def test_special_strings_and_document_limit(spark, plain, tmp_path):
    rows = [(i, f"{'x ' * (i % 5)}<|endoftext|> after {i}") for i in range(30)]
    made = token_io.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), str(tmp_path), vocabulary(), shard_docs=4)
    assert max(r.n_docs for r in made.collect()) == 4
    assert sorted(map(tuple, token_io.read_documents(made, str(tmp_path)).collect())) == expected(plain, rows)
    assert plain.encode("end <|endoftext|> of text").ids.count(50256) == 1


def test_odd_cases(spark, plain, odd, tmp_path):
    made = token_io.write_tokens(odd, str(tmp_path), vocabulary(), block=1024)
    rows = token_io.read_documents(made, str(tmp_path)).collect()
    assert len(rows) == 10 and [r.doc_id for r in sorted(rows, key=lambda r: r.start)] == [None, 1, 2, 3, 4, 5, 6, 6, 7, 8]
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3)} == {1}
    none = token_io.write_tokens(odd.limit(0), str(tmp_path), vocabulary())
    assert none.count() == 0 and token_io.read_documents(none, str(tmp_path)).count() == 0
