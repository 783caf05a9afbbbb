import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from kbspark.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string"


def ordered(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in turns.items()}


def grown(turns, every=100, heads=6):
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % heads
        out[c] = turns.get(c - int(math.fmod(c, every)), [])[:h] + own[h:]
    return out


def brute(turns):
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(int)
    for c, path in turns.items():
        ends[tuple(path)].append(c)
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha(ends[p])) for p, m in members.items()), key=str)


def nodes(df):
    return sorted((tuple(r) for r in df.select(*T._NUMBERS, "ends_sha256").collect()), key=str)


def drawn(seed, convs):
    """Conversations with shared beginnings: few words, so that paths branch at every depth; no ties of turn."""
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-500, 90_000_000), convs):
        numbers = r.sample([None, *range(-3, 12)], r.choice([1, 1, 2, 5, 9]))
        rows += [(c, t, r.choice(["user", "bot", None]), r.choice(["a", "bb", "", None, "🙂é"])) for t in numbers]
    return rows


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_trie_equals_plain_one_with_any_number_of_shards(spark, shards):
    rows = drawn(shards, 300)
    got = nodes(T.prefix_trie(spark.createDataFrame(rows, SCHEMA), shards))
    assert got == brute(ordered(rows))


def test_copies_ends_in_several_blocks_and_a_long_conversation(spark):
    rows = [(c * 50_000, t, "user", "same") for c in range(60) for t in range(3)]
    rows += [(7, t, "user", f"turn {t}") for t in range(700)] + [(9, t, "user", f"turn {t}") for t in range(650)]
    got = nodes(T.prefix_trie(spark.createDataFrame(rows, SCHEMA), 5))
    assert got == brute(ordered(rows))


def test_rebuilt_conversations(spark):
    rows = drawn(5, 60) + [(c, t, "user", f"{c % 7} {t}") for c in [*range(100, 180), *range(1001, 1090), 300, 301, -150, -100, -101] for t in range(c % 8 + 1)]
    turns = ordered(rows)
    got = nodes(T.trie_nodes(T.regrown(T.gathered(T.turn_keys(spark.createDataFrame(rows, SCHEMA)))), 6))
    want = grown(turns)
    assert [] in want.values()
    assert got == brute(want)


def test_awkward_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert nodes(T.prefix_trie(empty)) == []
    rows = [(1, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (None, 0, "user", "lost"), (2, 1, "", ""), (2, 5, "user", "x"), (3, 1, "user", "long " * 50_000)]
    wide = spark.createDataFrame([(*r, "clash", 1, [2]) for r in rows], SCHEMA + ", path string, shard int, turns array<int>")
    got = nodes(T.prefix_trie(wide, 4))
    assert got == brute(ordered(rows))
    assert [r for r in got if r[1] == 0][0][:6] == (1, 0, None, 3, 2, 2)


def test_turns_that_swap_role_and_text_differ(spark):
    rows = [(1, 0, "ab", "c"), (2, 0, "a", "bc"), (3, 0, "c", "ab")]
    assert nodes(T.prefix_trie(spark.createDataFrame(rows, SCHEMA), 2)) == brute(ordered(rows))


def test_every_node_but_the_skeleton_lies_in_one_shard():
    trie, parents = T.skeleton([(1, 1, 2, 2), (1, 1, 3, 3), (4, 4)])
    assert parents == [-1, 0, 1, 1, 0]
    shard = T.Shard(trie)
    shard.add((1, 1, 2, 2), [5, 7], 2, 10, "e")
    shard.add((1, 1, 2, 2, 9, 9), [5, 7, 3], 3, 4, "f")
    rows = shard.end()
    assert [(r[0], r[1], r[3], r[8], r[9]) for r in rows] == [(4, 3, 3, None, 2), (4, 2, 5, 2, None), (4, 1, 5, 1, None), (4, 0, 5, 0, None)]


def test_ties_of_turn_go_by_role_and_text(spark):
    r = random.Random(1)
    rows = [(c, r.choice([None, 1, 2]), r.choice(["bot", "user", None]), r.choice("xyz") * r.randrange(4)) for c in range(40) for _ in range(6)]
    assert nodes(T.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(7), 3)) == brute(ordered(rows))
