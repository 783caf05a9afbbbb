"""License scans by patience alignment of texts with license templates."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.license_templates import TELLING, TEMPLATES
from kbspark.llm.quality_rules import STOP_WORDS
from kbspark.llm.shared import lean, small_batches

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched positions of two word lists, rising in both.

    Words that occur once in each are anchors; the longest chain of anchors that rises in both is kept, and
    the gaps between its links are aligned the same way. A gap without anchors keeps its equal head and tail.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1}
        anchors = [(i, place[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in place]
        chain = rising(anchors)
        edges = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
        out += chain
        if chain:
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:]) if k > i + 1 and m > j + 1]
    return sorted(out)


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of ``pairs`` (sorted by their first) that rises in the second."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        back[k] = at[p - 1] if p else -1
        if p == len(tops):
            tops.append(j)
            at.append(k)
        else:
            tops[p], at[p] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def common(words: Iterable[int], n: int) -> Iterator[int]:
    """Length of the longest common subsequence of a template of ``n`` words with the words so far, after each
    word; a word comes as the bits of its places in the template."""
    full = row = (1 << n) - 1
    for places in words:
        met = row & places
        row = ((row + met) | (row - met)) & full
        yield n - row.bit_count()


class Scanner:
    """Templates ready for scanning; the same in every task."""

    def __init__(self, templates: dict[str, str], coverage: float, slack: float, telling: dict | None = None):
        self.coverage, self.slack, self.telling = coverage, slack, telling or {}
        self.words = {name: words_of(t) for name, t in templates.items()}
        self.counts = {name: Counter(w) for name, w in self.words.items()}
        # Whole numbers, so that a coverage met exactly counts.
        self.need = {name: max(1, -(-round(1000 * coverage) * len(w) // 1000)) for name, w in self.words.items()}
        self.places = {name: self._places(w) for name, w in self.words.items()}
        self.mirrored = {name: self._places(w[::-1]) for name, w in self.words.items()}
        spread = Counter(w for c in self.counts.values() for w in c)
        self.keys: dict[str, list[str]] = defaultdict(list)
        for name, counts in self.counts.items():
            # Enough of the rarer words that a text without any of them can't reach the coverage.
            missing = 0
            for w in sorted(counts, key=lambda w: (w in STOP_WORDS, spread[w], -len(w), w)):
                self.keys[w].append(name)
                missing += counts[w]
                if missing > len(self.words[name]) - self.need[name]:
                    break
        self.key_words = frozenset(self.keys)

    @staticmethod
    def _places(words: list[str]) -> dict[str, int]:
        out: dict[str, int] = defaultdict(int)
        for k, w in enumerate(words):
            out[w] |= 1 << k
        return dict(out)

    def told(self, name: str, words: list[str], barred: bool = True) -> bool:
        """Whether a stretch holds the words that tell this license from others, and none of those barred."""
        phrases, others = self.telling.get(name, ((), ()))
        text = f" {' '.join(words)} " if phrases or others else ""
        return all(f" {p} " in text for p in phrases) and not (barred and any(f" {b} " in text for b in others))

    def stretches(self, name: str, where: dict[str, list[int]], words: list[str]) -> Iterator[tuple[int, int, int]]:
        """(first word, end, common words) of stretches of the text, at most ``slack`` times the template long,
        that have enough of its words in order. They don't overlap: the one that is complete first is taken, grown or
        cut to where its words are dense, and the scan goes on behind it."""
        counts, need, n = self.counts[name], self.need[name], len(self.words[name])
        if sum(min(c, len(where.get(w, ()))) for w, c in counts.items()) < need:
            return
        # A stretch is part of the text: a phrase that the text lacks isn't in one.
        if not self.told(name, words, barred=False):
            return
        spots = sorted((i, w) for w in counts for i in where.get(w, ()))
        width = int(self.slack * n) + 8
        ahead = [self.places[name][w] for _, w in spots]
        behind = [self.mirrored[name][w] for _, w in spots]
        at = [i for i, _ in spots]
        have: Counter = Counter()
        held, left = 0, 0
        start, wait = 0, 0  # spots before ``start`` belong to earlier stretches; none before ``wait`` can end one
        for k, (i, w) in enumerate(spots):
            have[w] += 1
            held += have[w] <= counts[w]
            while at[left] <= i - width:
                old = spots[left][1]
                held -= have[old] <= counts[old]
                have[old] -= 1
                left += 1
            if held < need or k < wait:
                continue
            lo, most = max(left, start), 0
            for j, most in zip(range(k, lo - 1, -1), common(reversed(behind[lo : k + 1]), n)):
                if most >= need:
                    break
            if most < need:
                wait = k + need - most  # each further word adds one at most
                continue
            a, z, best = self._fit(at, ahead, behind, start, j, k, need, n, width)
            if self.told(name, words[at[a] : at[z] + 1]):
                most = best
            elif self.told(name, words[at[j] : i + 1]):
                a, z = j, k
            else:
                continue
            yield at[a], at[z] + 1, most
            start = wait = z + 1

    @staticmethod
    def _fit(at: list[int], ahead: list[int], behind: list[int], start: int, a: int, z: int, need: int, n: int, width: int) -> tuple[int, int, int]:
        """The spots ``a`` to ``z`` grown or cut in turns at each end, to most common words less words between."""
        best = None
        while True:
            old, hi = best, bisect_left(at, at[a] + width)
            for j, m in zip(range(a, hi), common(ahead[a:hi], n)):
                score = 2 * m - (at[j] - at[a] + 1)
                if m >= need and (best is None or score > best[0]):
                    best, z = (score, m), j
            lo = max(start, bisect_left(at, at[z] - width + 1))
            for j, m in zip(range(z, lo - 1, -1), common(reversed(behind[lo : z + 1]), n)):
                score = 2 * m - (at[z] - at[j] + 1)
                if m >= need and score > best[0]:
                    best, a = (score, m), j
            if best == old:
                return a, z, best[1]

    def scan(self, text: str) -> list[tuple[str, float, int, int, int, int]]:
        """(template, coverage, matched words, its words, first word, end) of licenses in a text; where several
        templates claim the same words, the one with most matched words, then the best covered."""
        if not text:
            return []
        words = words_of(text)
        present = self.key_words.intersection(words)
        if not present:
            return []
        names = {n for w in present for n in self.keys[w] if len(words) >= self.need[n]}
        if not names:
            return []
        vocabulary = {w for n in names for w in self.counts[n]}
        where: dict[str, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in vocabulary:
                where[w].append(i)
        found = []
        for name in sorted(names):
            template = self.words[name]
            for lo, hi, most in self.stretches(name, where, words):
                matched = len(patience(template, words[lo:hi]))
                if matched < self.need[name]:
                    matched = most  # repeated words hide the anchors
                found.append((matched / len(template), matched, name, lo, hi))
        out: list = []
        for cover, n, name, s, e in sorted(found, key=lambda f: (-f[1], -f[0], f[2], f[3])):
            if all(e <= x[4] or s >= x[5] for x in out):
                out.append((name, cover, n, len(self.words[name]), s, e))
        return sorted(out, key=lambda x: (x[4], x[0]))


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, str] | None = None,
    coverage: float = 0.8,
    slack: float = 1.5,
    telling: dict | None = None,
) -> DataFrame:
    """One row for each license found in each document: ``(id_col, license, coverage, matched, template_words,
    first_word, end_word)``, positions counted in words of the text.

    A template is found where a stretch of the text, ``slack`` times its length plus 8 words at most, has
    ``coverage`` of its words in order. ``matched`` is what the patience alignment with that stretch matches, or the
    longest common subsequence where repeated words keep the alignment under the coverage. Stretches that can't
    reach it are skipped by bounds on their words, which lose nothing. A stretch counts only if it holds the phrases
    that ``telling`` requires of its template, such as name and version, and no word that it bars. No shuffle.

    Null or empty text: no row. Several licenses, or one several times: a row each. Where templates claim
    the same words: the more matched words, the better coverage, then the name. Very long texts: n log n. Repeated rows: each is scanned. Empty table:
    empty result. Other columns are not carried.
    """
    small_batches(docs.sparkSession)
    scanner = Scanner(templates or TEMPLATES, coverage, slack, telling if templates else telling or TELLING)
    id_type = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for k, text in enumerate(b.column("text")):
                for found in scanner.scan(text.as_py() or ""):
                    at.append(k)
                    rows.append(found)
            if rows:
                types = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                names = ["id", "license", "coverage", "matched", "template_words", "first_word", "end_word"]
                yield pa.record_batch([b.column("id").take(pa.array(at)), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names)

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {id_type}, license string, coverage double, matched long, template_words long, first_word long, end_word long"
    return slim.mapInArrow(lean(scan), schema).withColumnRenamed("id", id_col)
