import random
from collections import Counter
from functools import partial
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbspark.llm import components as components_module
from kbspark.llm import near_dup
from kbspark.llm.components import components
from kbspark.llm.shared import split_join


def brute(rows, threshold=0.8):
    bags = {}
    for i, text in rows:
        w = (text or "").lower().split()
        bags[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None
    root = {i: i for i in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(bags)
    for a in ids:
        for b in ids:
            if a < b and bags[a] and bags[b]:
                both = sum((bags[a] & bags[b]).values())
                if both >= threshold * (sum(bags[a].values()) + sum(bags[b].values()) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: find(i) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows, n = [], 0
    for _ in range(14):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "  "), (n + 3, "one"), (n + 4, "One"), (n + 5, "a b " * 90), (n + 6, "a b " * 100)]
    return rows


def test_against_brute_force(spark):
    rows = corpus(4)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=5)
    want = brute(rows)
    assert {r.doc_id: r.class_id for r in got.collect()} == want
    sizes = Counter(want.values())
    assert all(r.class_size == sizes[r.class_id] for r in got.collect())


def test_large_group_of_near_copies(spark):
    """All copies share most of one text and differ by a word each; nothing is listed pairwise."""
    base = [f"b{k}" for k in range(150)]
    rows = [(i, " ".join(base[: i % 100] + [f"own{i}"] + base[i % 100 + 1 :])) for i in range(600)]
    got = {r.class_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=50).collect()}
    assert got == {0}


def test_odd_cases(spark, odd):
    rows = near_dup.near_duplicates(odd).collect()
    assert len(rows) == 10
    by = {r.doc_id: (r.class_id, r.class_size) for r in rows}
    assert by[6] == (6, 2) and by[2] == (2, 1) and by[None] == (None, 1)
    kept = near_dup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == 10
    assert near_dup.near_duplicates(odd.limit(0)).count() == 0


def test_one_id_with_two_texts(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"c{k}" for k in range(40))
    rows = [(1, a), (1, b), (2, a + " tail"), (3, b + " tail")]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_size) for r in got) == [(1, 2), (1, 2), (2, 2), (3, 2)]


def test_one_row_of_each_class_stays(spark):
    """Ids shared by different texts and rows without id: no class may go whole, and no copy may stay."""
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"c{k}" for k in range(40))
    rows = [(5, a), (9, a + " tail"), (2, b), (5, b + " tail"), (None, a + " end"), (None, "d e f g h i"), (7, "d e f g h i j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r.doc_id, r.text[0]) for r in near_dup.drop_near_duplicates(docs, threshold=0.5).collect())
    assert kept == [(2, "c"), (5, "a"), (7, "d")]
    got = {(r.doc_id, r.class_id, r.class_size) for r in near_dup.near_duplicates(docs, threshold=0.5).collect()}
    assert got == {(5, 5, 3), (9, 5, 3), (None, 5, 3), (2, 2, 2), (5, 2, 2), (None, 7, 2), (7, 7, 2)}


def test_split_join_keeps_every_row(spark):
    rows = [(0, k) for k in range(900)] + [(k, k) for k in range(1, 200)]
    left = spark.createDataFrame(rows, "a long, b long")
    keyed = left.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("m")).filter("a % 3 <> 1")
    for floor in (0, 100_000):
        got = sorted((r.a, r.b, r.m) for r in split_join(left, keyed, "a", len(rows), floor=floor).select("a", "b", "m").collect())
        assert got == sorted((a, b, a) for a, b in rows if a % 3 != 1)


def test_blocks_meet_every_open_pair_once_sent_linearly(spark):
    """5,000 members of one band, 40 of them outside its largest class: every pair that is still open meets in a block,
    and rows sent stay near the members, where blocks of all against all would send 13 rows a member."""
    known = spark.createDataFrame([(1, n, n if n % 125 == 3 else 10**6) for n in range(5000)], "band long, node long, root long")
    sent = near_dup._dealt(known, near_dup._open(known), 5000, 400).collect()
    assert len(sent) < 1.2 * 5000
    outside, places = [n for n in range(5000) if n % 125 == 3], {}
    for r in sent:
        places.setdefault(r.node, set()).add((r.i, r.j))
    assert all(places[o] & places[n] for o in outside for n in range(5000))
    # The same with 3 classes of like size: all pairs between classes meet, and no block has one class alone.
    known = spark.createDataFrame([(1, n, n % 3) for n in range(300)], "band long, node long, root long")
    sent = near_dup._dealt(known, near_dup._open(known), 300, 40).collect()
    places = {}
    for r in sent:
        places.setdefault(r.node, set()).add((r.i, r.j))
    assert all(places[x] & places[y] for x in range(300) for y in range(x) if (x - y) % 3)


def test_crowd_in_one_band(spark):
    """Texts that share a long passage but are under the threshold, with near copies among them: every band of the
    passage is wide, and the copies are found by a second band."""
    rng = random.Random(5)
    shared = [f"s{k}" for k in range(80)]
    rows = []
    for i in range(60):
        own = [f"o{i}x{k}" for k in range(35)]
        rows.append((2 * i, " ".join(shared + own)))
        if i % 3 == 0:
            own[rng.randrange(30)] = "changed"
            rows.append((2 * i + 1, " ".join(shared + own)))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=4).collect()
    assert {r.doc_id: r.class_id for r in got} == brute(rows)


@pytest.mark.parametrize("floor", [0, 100_000])
def test_components(spark, monkeypatch, floor):
    monkeypatch.setattr(components_module, "split_join", partial(split_join, floor=floor))
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[k] == 100 for k in range(100, 140)) and 200 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def crowd(seed, n, words=300, edits=5):
    """Texts made of one base with edits: most pairs are a little below 0.8, some above."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    rows = []
    for i in range(n):
        copy = list(base)
        for k in rng.sample(range(words), edits if i % 4 else 3):
            copy[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    return rows


@pytest.mark.parametrize("block", [2, 5, 400])
def test_wide_bands_lose_no_pair(spark, block):
    """A pair at 0.8 that shares one band is linked, however many members the band has: bands are few here, so that
    most pairs share one at most."""
    rows = crowd(1, 60) + [(i + 1000, t) for i, t in crowd(2, 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bands = {r.id: set(r.bands) for r in near_dup._signed(df, "doc_id", "text", 5, 3, 2).collect()}
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(df, bands=3, rows=2, block=block).collect()}
    bags = {i: Counter(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)) for i, t in rows}
    close, once = 0, 0
    for a, b in combinations(sorted(bags), 2):
        both = sum((bags[a] & bags[b]).values())
        near = both >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - both)
        if near and bands[a] & bands[b]:
            close, once = close + 1, once + (len(bands[a] & bands[b]) == 1)
            assert got[a] == got[b]
    assert close > 10 and once > 0
    want = brute(rows)
    assert all(want[a] == want[b] for a, b in combinations(got, 2) if got[a] == got[b])


def crowd_rows(spark, n, edits, words=1000):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(words)]
    held = []
    for i in range(n):
        copy = [hash(w) for w in base]
        for k in range(edits):
            copy[words // edits * k + rng.randrange(words // edits - 5)] = rng.randrange(2**62)
        held.append((i, *near_dup.bag(np.array(copy, np.int64), 5)))
    return spark.createDataFrame([(i, u.view(np.int64).tolist(), c.tolist()) for i, u, c in held], "node long, shingles array<long>, counts array<long>")


def test_a_crowd_below_the_threshold_comes_apart(spark):
    """500 texts of one base, any two at 0.59 (29 edits of 1,000 words): by their rarest shingles hardly any two meet."""
    bags = crowd_rows(spark, 500, 29)
    one = bags.first()
    assert 0.55 < near_dup.overlap(*(np.array(x) for x in (one.shingles, one.counts, *bags.filter("node = 7").first()[1:]))) < 0.62
    rare = near_dup._rare(bags, bags.select("node", F.col("node").alias("root")), 0.8)
    assert near_dup._open(rare.withColumnRenamed("part", "root"), 2).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] < 50
    above = crowd_rows(spark, 20, 10)  # at 0.9 they do
    rare = near_dup._rare(above, above.select("node", F.col("node").alias("root")), 0.8)
    assert near_dup._open(rare.withColumnRenamed("part", "root"), 2).agg(F.max("n")).first()[0] > 12
