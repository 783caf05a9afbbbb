import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kbspark.llm import licenses
from kbspark.llm.license_templates import TELLING, TEMPLATES


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcdefg"), max_size=14), st.lists(st.sampled_from("abcdefg"), max_size=14))
def test_alignment_is_a_common_subsequence(a, b):
    pairs = licenses.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))


def test_alignment_by_anchors():
    a, b = "x a y b z c w".split(), "q a y r b z z c w".split()
    assert [a[i] for i, _ in licenses.patience(a, b)] == list("aybzcw")
    assert licenses.rising([(0, 3), (1, 1), (2, 2), (3, 0), (4, 5)]) == [(1, 1), (2, 2), (4, 5)]


def test_every_template_is_found_in_noise():
    rng = random.Random(1)
    s = licenses.Scanner(TEMPLATES, 0.8, 1.5)
    for name, text in TEMPLATES.items():
        words = text.split()
        changed = [w if rng.random() > 0.05 or len(words) < 20 else "changed" for w in words]
        noise = [rng.choice(["the", "of", "lorem", "ipsum", "under", "license"]) for _ in range(300)]
        found = s.scan(" ".join(noise[:150] + changed + noise[150:]))
        best = [f[0] for f in found]
        assert name in best or name == "BSD-2-Clause" and "BSD-3-Clause" in best, (name, found)


def test_bound_loses_nothing():
    """What the scanner skips, a full alignment with each stretch would not have found either."""
    rng = random.Random(2)
    templates = {"t1": "a b c d e f g h i j", "t2": "p q r s t a b c"}
    s = licenses.Scanner(templates, 0.8, 1.5)
    for _ in range(300):
        words = [rng.choice("abcdefghijpqrstxyz") for _ in range(rng.randint(0, 30))]
        if rng.random() < 0.5:
            t = rng.choice(list(templates.values())).split()
            words[5:5] = [w if rng.random() > 0.1 else "x" for w in t]
        found = {f[0] for f in s.scan(" ".join(words))}
        for name, t in templates.items():
            t = t.split()
            hit = any(sum(w == v for w, v in zip(t, words[k : k + len(t)])) >= 0.8 * len(t) for k in range(len(words)))
            if hit and name not in found:
                assert found, (name, words)


def test_one_template_against_every_window():
    """A template is found exactly where some window of the text, as wide as allowed, has enough of it in order."""
    rng = random.Random(12)
    template = "a b c d e a f g h b"
    s = licenses.Scanner({"t": template}, 0.8, 1.5)
    width, t = int(1.5 * 10) + 8, template.split()
    seen = set()
    for _ in range(250):
        words = [rng.choice("abcdefghxyz") for _ in range(rng.randint(0, 34))]
        if rng.random() < 0.6:
            part = [w for w in t if rng.random() > 0.15]
            for _ in range(rng.randint(0, 4)):
                part.insert(rng.randint(0, len(part)), "x")
            words[7:7] = part
        want = any(lcs(t, words[k : k + width]) >= 8 for k in range(max(1, len(words))))
        assert bool(list(s.scan(" ".join(words)))) == want, words
        seen.add(want)
    assert seen == {True, False}


def test_odd_cases(spark, odd):
    assert licenses.scan_licenses(odd).count() == 0 and licenses.scan_licenses(odd.limit(0)).count() == 0
    docs = spark.createDataFrame([(1, "Released under the MIT License."), (1, "Released under the MIT License.\nx\nLicensed under CC BY-NC 4.0."), (2, None)], "doc_id long, text string")
    rows = licenses.scan_licenses(docs).collect()
    assert sorted((r.doc_id, r.license, r.coverage, r.first_word) for r in rows) == [(1, "notice: CC-BY-NC-4.0", 1.0, 6), (1, "notice: MIT", 1.0, 0), (1, "notice: MIT", 1.0, 0)]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def test_repeated_and_adjacent_copies_are_all_found():
    s = licenses.Scanner(TEMPLATES, 0.8, 1.5)
    mit = "Released under the MIT License. "
    assert [f[0] for f in s.scan(mit * 3)] == ["notice: MIT"] * 3
    assert [(f[0], f[1]) for f in s.scan("x y " * 50 + TEMPLATES["MIT"] * 2)] == [("MIT", 1.0)] * 2
    scrambled = " ".join(sorted(TEMPLATES["Zlib"].split()))
    assert [f[0] for f in s.scan(f"{scrambled} {TEMPLATES['Zlib']} {scrambled}")].count("Zlib") == 1


def test_exact_share_is_enough():
    s = licenses.Scanner({"five": "a b c d e"}, 0.8, 1.5)
    for gone in "abcde":
        assert [f[:3] for f in s.scan("x " + "abcde".replace(gone, "y").replace("", " "))] == [("five", 0.8, 4)], gone


def test_scanner_against_brute_force():
    """As many stretches as an earliest-end scan of all stretches finds, each of them a true one."""
    rng = random.Random(5)
    for _ in range(400):
        template = [rng.choice("abcdef") for _ in range(rng.randint(3, 10))]
        n, need = len(template), -(-8 * len(template) // 10)
        width, words = int(1.5 * n) + 8, []
        for _ in range(rng.randint(0, 4)):
            words += [w if rng.random() > 0.1 else "z" for w in template] if rng.random() < 0.6 else [rng.choice("abcdefyz") for _ in range(6)]
        first = next((e for e in range(len(words) + 1) if lcs(template, words[max(0, e - width) : e]) >= need), None)
        found = licenses.Scanner({"t": " ".join(template)}, 0.8, 1.5).scan(" ".join(words))
        assert bool(found) == (first is not None), (template, words)
        start = 0
        for _, cover, matched, _, s, e in found:
            assert start <= s and e - s <= width and need <= matched <= lcs(template, words[s:e])
            assert not any(lcs(template, words[max(start, k - width) : k]) >= need for k in range(start, s + 1)), (template, words)
            start = e
        assert not any(lcs(template, words[max(start, k - width) : k]) >= need for k in range(start, len(words) + 1)), (template, words)


def test_licenses_that_resemble_each_other_keep_their_names():
    from kbspark.llm.license_templates import TELLING

    s = licenses.Scanner(TEMPLATES, 0.8, 1.5, TELLING)
    for name, text in TEMPLATES.items():
        assert [f[:2] for f in s.scan(f"x y z {text} x y z")] == [(name, 1.0)], name
    named = {
        "Released under the Apache License.": ["notice: Apache"],
        "Released under the GNU General Public License.": ["notice: GPL"],
        "It was released last year under a law that the new license covers.": [],
        "Licensed under CC BY-SA 3.0.": [],
        "This work is licensed under the GNU General Public License.": ["notice: GPL"],
        "Released under MIT License. Released under the MIT": ["notice: MIT", "notice: MIT"],
    }
    for text, names in named.items():
        assert [f[0] for f in s.scan(text)] == names, text


@pytest.mark.parametrize("name", ["Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"])
def test_whole_long_texts_give_their_name_alone(name):
    """As published, and with a word in thirty replaced; other licenses that the text speaks of don't count in it."""
    scanner = licenses.Scanner(TEMPLATES, 0.8, 1.5, TELLING)
    text = TEMPLATES[f"text: {name}"]
    n = len(licenses.words_of(text))
    assert scanner.scan(text) == [(f"text: {name}", 1.0, n, n, 0, n)]
    words = licenses.words_of("some words before " + text + " and some behind")
    edited = [w if k % 30 or k < 90 else "replaced" for k, w in enumerate(words)]
    ((found, cover, *_, start, end),) = scanner.scan(" ".join(edited))
    assert found == f"text: {name}" and 0.94 < cover < 1 and start == 3 and end in range(n, n + 4)


def test_a_text_without_its_title_is_not_told():
    scanner = licenses.Scanner(TEMPLATES, 0.8, 1.5, TELLING)
    other = TEMPLATES["text: LGPL-2.1"].replace("2.1", "2").replace("Lesser", "Library").replace("LESSER", "LIBRARY")
    assert [r[0] for r in scanner.scan(other)] == []
