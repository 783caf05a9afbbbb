import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from kbspark.llm import line_dedup, quality_rules, url_rules


def test_counts(spark):
    texts = ["a b c d e f a b c d e", "x", None, "one two three four five six seven eight nine ten\n\none\none", "a a a a a a a", "\x1cab cd"]
    rows = quality_rules.quality_rules(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.n_repeat_words for r in rows] == [10, 0, 0, 0, 7, 0]
    assert [r.n_words for r in rows] == [11, 1, 0, 12, 7, 2] and rows[3].n_dup_lines == 1 and rows[5].word_chars == 5
    assert [r.base_failed for r in rows] == [True, True, True, False, True, True]


def test_thresholds(spark):
    good = "the town and the people of the town are in the news for a week with that story again " * 1
    bad = " ".join(f"w{i}###" for i in range(40))
    rows = quality_rules.quality_rules(spark.createDataFrame([(0, good), (1, bad)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.base_failed, r.kept) for r in rows] == [(False, True), (False, False)]


def test_rules_odd_cases(spark, odd):
    rows = quality_rules.quality_rules(odd)
    assert rows.count() == 10 and rows.filter("kept IS NULL OR base_failed IS NULL").count() == 0
    assert quality_rules.quality_rules(odd.limit(0)).count() == 0
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit", [500_000, 0])
def test_lines(spark, limit):
    rows = [(i, f"own line {i}\n  footer \nlast {i}" if i % 2 else f"own line {i}", "h") for i in range(20)] + [(50, "footer\nx", "other"), (51, "footer", "h")]
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), broadcast_lines=limit).collect()}
    assert got[1].text == "own line 1\nlast 1" and (got[1].n_lines, got[1].n_removed) == (3, 1)
    assert got[2].text == "own line 2" and got[50].text == "footer\nx" and got[51].text == ""


def test_hot_host_is_cut_by_row(spark):
    """Copies and null texts of a hot host don't meet in one task, and the result is that of the broadcast way."""
    rows = [(i, "footer\nsame text" if i % 3 else None, "hot") for i in range(300)] + [(400 + i, f"footer\nown {i}", f"h{i % 9}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    a = line_dedup.drop_boilerplate_lines(docs, broadcast_lines=0, hot_parts=8)
    assert sorted(map(str, a.collect())) == sorted(map(str, line_dedup.drop_boilerplate_lines(docs).collect()))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    assert a.select(F.spark_partition_id()).distinct().count() > 1
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_lines_odd_cases(spark, odd):
    rows = line_dedup.drop_boilerplate_lines(odd, broadcast_lines=0)
    assert rows.count() == 10 and rows.filter("doc_id = 2").first().text is None
    rows = line_dedup.drop_boilerplate_lines(odd)
    assert rows.count() == 10 and rows.filter("doc_id = 2").first().text is None
    assert line_dedup.drop_boilerplate_lines(odd, counts=False).columns == odd.columns
    assert line_dedup.drop_boilerplate_lines(odd.limit(0)).count() == 0


def test_host_path_and_fixed_rules(spark):
    cases = {
        "http://A.Example.ORG/es/1?q#f": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "https://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
        "x://my.org/": ("my.org", "/", "org/", "allow"), "http://badexample.org/es/": ("badexample.org", "/es/", "org/", "allow"),
        "http://a.com/fr/x": ("a.com", "/fr/x", "com/fr/", "allow"), "http://a.com/de/x": ("a.com", "/de/x", "com/de/", "block"),
        "http://a.com": ("a.com", "", None, "allow"), "nothing": ("", "", None, "allow"), None: ("", "", None, "allow"), "http://É.com/x#/de/": ("É.com", "/x", None, "allow"),
        "a\nb://h/p://q": ("h", "/p:", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "clash", "r") for i, u in enumerate(cases)], "page_id long, url string, host string, verdict string")
    none = spark.createDataFrame([], "url string, bad boolean")
    got = [tuple(r) for r in url_rules.filter_urls(pages, none).orderBy("page_id").select("host", "path", "rule", "verdict").collect()]
    want = [v if v[0] != "h" else ("h", "/p://q", None, "allow") for v in cases.values()]
    assert got == want


def test_mined_rules(spark):
    rows = [(f"http://spam.net/buy/{i}", True) for i in range(30)] + [(f"http://fine.net/read/{i}", i % 10 == 0) for i in range(60)] + [(None, True), ("http://x.net/y", None)]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    rules = url_rules.mined_rules(labelled)
    found = {m for r in rules.collect() for m in r.members[0]}
    assert "h:spam" in found and "p:buy" in found and all(len(r.antecedent) == 1 for r in rules.collect())
    pages = spark.createDataFrame([(1, "https://spam.net/other"), (2, "http://fine.net/read/9"), (2, "http://fine.net/read/9"), (3, None)], "page_id long, url string")
    got = sorted((r.page_id, r.mined, r.verdict) for r in url_rules.filter_urls(pages, labelled).collect())
    assert got == [(1, True, "block"), (2, False, "allow"), (2, False, "allow"), (3, False, "allow")]
    assert url_rules.filter_urls(pages.limit(0), labelled).count() == 0
    assert [r.n for r in spark.range(1).select(F.size(url_rules.url_tokens(F.lit("http://a.a.com/1/2?x=1&x=2#z"))).alias("n")).collect()] == [6]


def test_rules_of_any_length_against_brute_force(spark):
    """Only host label, folder, query key and fragment mark together are bad; any three of them are so half the time
    at most, and less where more good rows have them."""
    from itertools import combinations, product

    parts = ["q.net", "/buy", "?ref=1", "#x"]
    rows = []
    for some in range(16):
        host, folder, query, mark = (p if some >> k & 1 else "" for k, p in enumerate(parts))
        rows += [(f"http://{host or 'ok.net'}{folder or '/read'}/{i}{query}{mark}", some == 15) for i in range(30 if some.bit_count() == 3 else 20)]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    tokens = labelled.select(url_rules.url_tokens(F.col("url")).alias("t"), "bad").collect()
    bad, every = {}, {}
    for r in tokens:
        for n in range(1, len(r.t) + 1):
            for s in combinations(sorted(r.t), n):
                every[s] = every.get(s, 0) + 1
                bad[s] = bad.get(s, 0) + r.bad
    rules = {s for s in bad if bad[s] >= 5 and bad[s] >= 0.5 * every[s]}
    least = {s for s in rules if not any(set(o) < set(s) for o in rules)}
    got = {tuple(sorted(s)) for r in url_rules.mined_rules(labelled).collect() for s in product(*r.members)}
    assert got == least and min(map(len, got)) == 4
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    blocked = {r.page_id for r in url_rules.filter_urls(pages, labelled).filter("mined").collect()}
    assert blocked == {i for i, (_, b) in enumerate(rows) if b}


def test_site_with_many_common_tokens(spark):
    """40 tokens in every bad URL are one item; a page with any one of them is met, and repeated and null URLs keep rows."""
    long = "/".join(f"part{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(40))
    rows = [(f"http://bad.net/{long}/{i}", True) for i in range(20)] + [(f"http://good.org/x/{i}", False) for i in range(30)]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    rules = url_rules.mined_rules(labelled).collect()
    assert len(rules) == 1 and len(rules[0].members[0]) == 42
    pages = spark.createDataFrame([(i, "http://z.org/partbc") for i in range(50)] + [(60, None), (61, None), (62, "http://z.org/none"), (63, "http://bad.com/")], "page_id long, url string")
    got = {r.page_id: r.mined for r in url_rules.filter_urls(pages, labelled).collect()}
    assert got == {**{i: True for i in range(50)}, 60: False, 61: False, 62: False, 63: True}


@pytest.mark.parametrize("keys", [8, 11, 14])
def test_tokens_that_are_rules_alone_make_no_sets(spark, monkeypatch, keys):
    """Bad URLs with many query keys, each missing now and then: 2 ** keys sets if they were all counted."""
    r, seen = random.Random(keys), []
    plain = url_rules.marked_sets
    monkeypatch.setattr(url_rules, "marked_sets", lambda rows, items, least: seen.append(plain(rows, items, least)) or seen[-1])
    bad = [(f"http://a.com/x/{i}?" + "&".join(f"k{k}=1" for k in range(keys) if r.random() > 0.03), True) for i in range(300)]
    rows = bad + [(f"http://a.com/y/{i}", False) for i in range(320)]
    got = {tuple(x.antecedent) for x in url_rules.mined_rules(spark.createDataFrame(rows, "url string, bad boolean")).collect()}
    assert got == {("p:x",), *((f"q:k{k}",) for k in range(keys))}
    assert seen[0].count() == 0


def test_sets_are_counted_in_all_rows(spark):
    """Tokens that are no rule alone, with a rule of two and one of three among them; found as by counting every set."""
    r = random.Random(4)
    rows = []
    for i in range(400):
        some = {k for k in range(6) if r.random() < 0.5}
        bad = ({0, 1} <= some or {2, 3, 4} <= some) if r.random() < 0.95 else r.random() < 0.2
        rows.append(("http://a.com/x?" + "&".join(f"k{k}" for k in sorted(some)), bad))
    counts = Counter()
    for url, bad in rows:
        keys = [k for k in url.split("?")[1].split("&") if k]
        for n in range(1, 7):
            for s in combinations(keys, n):
                counts[s, bad] += 1
    rule = {s for s, bad in counts if counts[s, True] >= 5 and counts[s, True] >= 0.7 * (counts[s, True] + counts[s, False])}
    want = {s for s in rule if not any(set(o) < set(s) for o in rule)}
    got = url_rules.mined_rules(spark.createDataFrame(rows, "url string, bad boolean"), min_confidence=0.7).collect()
    assert {tuple(sorted(t[2:] for t in x.antecedent)) for x in got} == want and max(map(len, want)) >= 2
    for x in got:
        s = tuple(sorted(t[2:] for t in x.antecedent))
        assert x.confidence == counts[s, True] / (counts[s, True] + counts[s, False])
