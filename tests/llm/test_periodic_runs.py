import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from kbspark.llm import periodic_runs as R
from kbspark.llm.queries import QUERIES


def brute(words, repeats=4, least=6):
    """Every stretch of equal words a period apart, for every period; of periods of one interval the least."""
    best = {}
    for q in range(1, len(words) // repeats + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, repeats * q) and j > i:
                best.setdefault((i, j + q), q)
            i = j + 1 if j == i else j
    return sorted((s, e - s, q) for (s, e), q in best.items())


def collapsed(words, found):
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def found(docs, repeats=4, least=6):
    flat, bounds = np.array([w for d in docs for w in d], np.int64), np.cumsum([0, *map(len, docs)]).astype(np.int64)
    of, start, length, period = R.runs(flat, bounds, repeats, least)
    return [sorted(zip(start[of == k].tolist(), length[of == k].tolist(), period[of == k].tolist())) for k in range(len(docs))]


def drawn(r):
    n, k = r.choice([0, 1, 5, 6, 7, 30, 100, 200]), r.choice([1, 2, 2, 3, 5, 20])
    if r.random() < 0.4:
        return [r.randrange(k) for _ in range(n)]
    if r.random() < 0.2:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b
    out = []
    while len(out) < n:
        block = [r.randrange(k) for _ in range(r.randint(1, 9))] * r.randint(1, 9)
        block = (block + [k + 1]) * r.randint(1, 6) if r.random() < 0.3 else block
        out += block[: r.randint(1, len(block))]
    return out


@pytest.mark.parametrize("repeats, least", [(4, 6), (3, 3), (5, 12)])
def test_runs_equal_brute_force(repeats, least):
    r, n = random.Random(repeats), 0
    for _ in range(250):
        docs = [drawn(r) for _ in range(r.randint(1, 6))]
        got = found(docs, repeats, least)
        assert got == [brute(d, repeats, least) for d in docs]
        n += sum(map(len, got))
    assert n > 500


def test_long_runs_and_runs_of_runs():
    inner = [1, 2, 1, 2, 1, 2, 1, 2, 3] * 5 + [7, 8]
    docs = [[5] * 3000, list(range(900)) * 4 + list(range(899)), inner * 4 + inner[:10]]
    got = found(docs)
    assert got[0] == [(0, 3000, 1)] and got[1] == [(0, 4499, 900)]
    assert got[2] == brute(docs[2])


def test_a_hash_that_meets_anothers_is_found_out(monkeypatch):
    plain = R.Equal._same
    monkeypatch.setattr(R.Equal, "_same", lambda self, a, b, n: plain(self, a, b, n) | (n == 9))
    r = random.Random(8)
    docs = [drawn(r) for _ in range(60)]
    start, period, end = np.array([0]), np.array([3]), np.array([40])
    words = np.array([1, 2] * 30)
    s, q, e = R.verified(words, np.zeros(60, np.int64), start, period, end, 4, 6)
    assert (s.tolist(), q.tolist(), e.tolist()) == ([0], [2], [60])
    found(docs)  # ends


def test_grammar_derives_the_words():
    r = random.Random(2)
    symbols = np.array([r.randrange(4) for _ in range(400)] + [1, 2, 3] * 60)
    stretch = np.repeat([0, 1], [400, 180])
    g = R.Grammar(symbols, stretch)
    assert len(g.used_rule) == len(symbols) - 2  # inner nodes of two binary trees
    for rule, at in zip(g.used_rule, g.used_place):
        n, first = g.length[rule], g.place[rule]
        assert (symbols[at : at + n] == symbols[first : first + n]).all() and 0 < g.half[rule] < n


def test_operator_on_awkward_rows(spark, odd):
    got = {r.doc_id: r for r in R.periodic_runs(odd).collect()}
    assert R.periodic_runs(odd).count() == odd.count()
    assert got[2].n_words == 0 and got[2].runs == [] and got[2].collapsed == "" and got[4].collapsed == ""
    assert R.periodic_runs(odd.limit(0)).collect() == []
    text = "go on\x0b" * 7 + "stop  now"
    row = R.periodic_runs(spark.createDataFrame([("k", text)], "name string, body string"), "name", "body").first()
    assert (row.n_words, [tuple(x) for x in row.runs], row.collapsed) == (16, [(0, 14, 2)], "go on stop now")
    with pytest.raises(ValueError):
        R.periodic_runs(odd, repeats=2)


def looped(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_query_equals_brute_force(spark):
    import pyarrow.parquet as pq

    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    rows = QUERIES["op13_periodic_runs"](spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    sha, some = lambda s: hashlib.sha256(s.encode()).hexdigest(), 0
    for r in rows:
        words = looped(r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or ""))
        runs = brute(words) if len(words) < 4000 else [(0, 0, 0)]
        if runs == [(0, 0, 0)]:
            continue
        top = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        want = (len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda x: (x[0], x[2])))), sha(collapsed(words, runs)))
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == want
        some += len(runs)
    assert some > 3
