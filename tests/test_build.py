"""Builds and refreshes against the same steps one page after the other."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kbspark.functions import text as t
from kbspark.functions.chunking import chunk_page
from kbspark.plans import build

WORDS = "door open river stone green light paper table window garden".split()


def made_pages():
    rng = random.Random(4)
    line = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    shared, long = [line(6) for _ in range(3)], line(60)
    rows = []
    for i in range(24):
        parts = ["[H1] Title " + str(i % 5), rng.choice(shared), *[line(rng.choice([2, 8, 40])) for _ in range(rng.choice([1, 2, 30]))], "[H2] Same head", long if i % 6 == 0 else "[SB]ok " + str(i), rng.choice(shared)]
        rows.append((f"d{i % 2}", i, f"https://d{i % 2}.com/{'ab'[i % 3 == 0]}/{i}", "\n".join(parts)))
    rows += [("d0", 30, "https://d0.com/a/30", rows[2][3]), ("d0", 31, "https://d0.com/a/31", ""), ("d0", 32, "https://d0.com/c/32", None)]
    return rows


def bare(p):
    return p[4:] if p.startswith("[SB]") else p


def kept(text):
    parts = [p.strip() for p in (text or "").split("\n") if p.strip()]
    return [p for p in parts if len(bare(p)) >= (4 if p.startswith("[SB]") else 20) or p.startswith(("[H1] ", "[H2] "))]


def rebuilt(rows):
    seen, out = Counter(), {}
    for domain, n, _, text in sorted(rows, key=lambda r: r[1]):
        mine = []
        for p in kept(text):
            if len(bare(p)) <= 200:
                seen[domain, bare(p)] += 1
                if seen[domain, bare(p)] > (5 if p.startswith("[H") else 1):
                    continue
            mine.append(p)
        out[n] = mine
    return out


def thin_chunks(rows):
    groups, out = defaultdict(list), []
    for domain, n, url, text in sorted(rows, key=lambda r: r[1]):
        parts = [p.strip() for p in (text or "").split("\n") if p.strip()]
        h1 = next((p[5:] for p in parts if p.startswith("[H1] ")), None)
        body = "\n\n".join(bare(p) for p in kept(text) if not p.startswith("[H1] "))
        groups[domain, url.rsplit("/", 1)[0] + "/"].append((n, f"[Source: {url}]" + (f"\n[H1] {h1}" if h1 else "") + (f"\n\n{body}" if body else "")))
    for (domain, group), cards in groups.items():
        packs, size = [[]], 0
        for n, card in cards:
            if size and size + len(card) + 10 > 1200:
                packs, size = [*packs, []], 0
            packs[-1].append((n, card))
            size += len(card)
        out += [(domain, pack[0][0], group, k, f"[Source: {group}]\n\n\n\n" + "\n\n".join(c for _, c in pack)) for k, pack in enumerate(packs)]
    return out


def unique(chunks):
    first = {}
    for domain, n, url, k, content in sorted(chunks, key=lambda c: (c[1], c[3], c[2])):
        first.setdefault((domain, content), (domain, url, k, content))
    return sorted(first.values())


def normal_chunks(rows, paras):
    return [(d, n, u, c["chunk_index"], c["content"]) for d, n, u, _ in rows if n in paras for c in chunk_page([bare(p) for p in paras[n]], u)]


def size(paras):
    return len("\n\n".join(paras))


def found(df):
    return sorted((r.domain, r.url, r.chunk_index, r.content) for r in df.collect())


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(made_pages(), "domain string, page_seq long, url string, text string")


def test_build(pages):
    rows, paras = made_pages(), rebuilt(made_pages())
    thin = [r for r in rows if size(paras[r[1]]) < 300]
    assert 5 < len(thin) < len(rows) - 5
    long = {n: p for n, p in paras.items() if size(p) >= 300}
    assert found(build.build_chunks(pages)) == unique(normal_chunks(rows, long) + thin_chunks(thin))


def test_refresh(pages):
    rows = made_pages()
    changed = {n for _, n, _, _ in rows if n % 4 == 0}
    crawl = pages.withColumns({"content_hash": t.content_hash(F.col("text")), "priority": F.lit("normal")})
    stored = crawl.withColumns({"content_hash": F.when(F.col("page_seq").isin(*changed), "old").otherwise(F.col("content_hash")), "has_variants": F.lit(False), "last_scraped_at": F.lit("2024-01-01").cast("timestamp")})
    thin = {n for _, n, _, text in rows if size([bare(p) for p in kept(text)]) < 300}
    fresh = [r for r in rows if r[1] in changed - thin]
    paras = {n: p for n, p in rebuilt(fresh).items() if size(p) >= 300}
    group = lambda r: (r[0], r[2].rsplit("/", 1)[0])
    touched = {group(r) for r in rows if r[1] in thin & changed}
    members = [r for r in rows if r[1] in thin and group(r) in touched]
    assert paras and members
    _, chunks, _ = build.refresh(crawl, stored)
    assert found(chunks) == unique(normal_chunks(fresh, paras) + thin_chunks(members))
