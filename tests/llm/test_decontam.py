import random
from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kbspark.llm import decontam


@settings(max_examples=300, deadline=None)
@given(st.lists(st.booleans(), max_size=30))
def test_longest_overlap(bits):
    equal, n = np.array(bits, bool), len(bits)
    best = max([j - i for i in range(n) for j in range(i + 1, n + 1) if 1000 * equal[i:j].sum() >= 800 * (j - i)], default=0)
    s, e = decontam.longest_overlap(equal, 0.8)
    assert e - s == best and (e == s or equal[s:e].mean() >= 0.8 - 1e-9)


def test_masks_lose_no_stretch():
    """Every stretch of 13 to 25 words with one substitution in five has a seed."""
    for n, k in ((n, n // 5) for n in range(13, 26)):
        for wrong in combinations(range(n), k):
            assert any(all(s + i not in wrong for i, c in enumerate(m) if c == "1") for m in decontam.MASKS for s in range(n - len(m) + 1)), (n, wrong)


def brute(docs, items):
    out = set()
    for d, text in docs:
        w = [x for x in __import__("re").findall(r"[^\W_]+", (text or "").lower())]
        for i, item in items:
            v = __import__("re").findall(r"[^\W_]+", (item or "").lower())
            for shift in range(-len(v), len(w)):
                pairs = [(k, k + shift) for k in range(len(v)) if 0 <= k + shift < len(w)]
                equal = np.array([v[a] == w[b] for a, b in pairs], bool)
                s, e = decontam.longest_overlap(equal, 0.8)
                if e - s >= 13 if len(v) >= 13 else 10 * equal.sum() >= 8 * len(v) > 0:
                    out.add((d, i))
    return out


def test_against_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(3000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(3, 60)))) for i in range(25)]
    docs = []
    for d in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(0, 150))]
        if d % 2:
            part = rng.choice(items)[1].split()
            a = rng.randint(0, max(0, len(part) - 14))
            part = [w if rng.random() > 0.1 else "zzz" for w in part[a : a + rng.randint(12, 60)]]
            at = rng.randint(0, len(text))
            text[at:at] = part
        docs.append((d, " ".join(text).capitalize()))
    docs += [(100, None), (101, "")]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items + [(90, None), (91, "zzz")], "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == brute(docs, items + [(91, "zzz")])


def test_odd_cases(spark, odd):
    bench = spark.createDataFrame([(1, "people of the town who like it"), (1, "people of the town who like it"), (2, None), (3, "")], "item_id long, text string")
    rows = decontam.contaminated(odd, bench).collect()
    assert [(r.doc_id, r.item_id, r.equal, r.doc_word) for r in rows] == [(1, 1, 7, 11)]
    left = decontam.decontaminate(odd, bench)
    assert left.columns == odd.columns and left.count() == 9
    assert decontam.contaminated(odd.limit(0), bench).count() == 0 and decontam.contaminated(odd, bench.limit(0)).count() == 0


def test_short_masks_lose_no_item():
    for n in range(1, 13):
        allowed = (2 * n) // 10
        for wrong in combinations(range(n), allowed):
            assert any(all(q + i not in wrong for i, c in enumerate(m) if c == "1") for m, q in decontam.whole_masks(n, 0.8)), (n, wrong)


def test_short_items_against_the_plain_share(spark):
    """Items under 13 words over their whole length at 0.8, in integers; words beyond the document's ends are unequal."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    items = [(i, [rng.choice(words) for _ in range(i % 12 + 1)]) for i in range(36)]
    docs = []
    for d in range(150):
        text, part = [rng.choice(words) for _ in range(rng.randint(0, 30))], list(rng.choice(items)[1])
        for k in rng.sample(range(len(part)), min(len(part), rng.randint(0, 3))):
            part[k] = "zzz"
        at = rng.choice([0, len(text), rng.randint(0, len(text))])
        text[at:at] = part[1:] if d % 5 == 0 and at == 0 else part
        docs.append((d, text))
    want = set()
    for d, w in docs:
        for i, v in items:
            for shift in range(-len(v), len(w) + 1):
                same = sum(0 <= k + shift < len(w) and w[k + shift] == v[k] for k in range(len(v)))
                if 10 * same >= 8 * len(v):
                    want.add((d, i))
    frames = [spark.createDataFrame([(k, " ".join(w)) for k, w in rows], f"{c} long, text string") for rows, c in ((docs, "doc_id"), (items, "item_id"))]
    got = decontam.contaminated(*frames).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(10 * r.equal >= 8 * r.item_words for r in got) and any(r.equal < r.item_words for r in got)


def test_one_changed_word_in_short_items_and_repetitive_texts(spark):
    ten, four = "the quick brown fox jumps over a lazy sleeping dog", "alpha beta gamma delta"
    items = spark.createDataFrame([(1, ten), (2, four), (3, "na " * 40)], "item_id long, text string")
    docs = [(1, f"so {ten.replace('jumps', 'leaps')} it was"), (2, f"an {four} end"), (3, f"an {four.replace('beta', 'zeta')} end"), (4, "na " * 3000), (5, "na na")]
    found = spark.createDataFrame(docs, "doc_id long, text string")
    for seeds in (0, 1_000_000):
        got = {(r.doc_id, r.item_id, r.equal, r.doc_word) for r in decontam.contaminated(found, items, broadcast_seeds=seeds).collect()}
        assert got == {(1, 1, 9, 1), (2, 2, 4, 1), (4, 3, 40, 0)}
