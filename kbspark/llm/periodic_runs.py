"""Periodic runs of words from a grammar: Re-Pair turns repeated word pairs into rules, runs that cross the middle of
a rule are computed once a rule, and every place where the rule is used has them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm.chunk_codec import pieces_of
from kbspark.llm.shared import SPACE_CLASS, lean, let, small_batches

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Pairs of a rule and a period that are tested at a time; it bounds memory, not what is tested.
TESTS = 2_000_000


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the words of all texts, bounds of each text in them); words are runs of anything but ASCII white space."""
    lists = pc.ascii_split_whitespace(texts)
    flat, bounds = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    some = np.diff(np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1]) > 0 if len(flat) else np.zeros(0, bool)
    return flat.filter(pa.array(some)), np.concatenate([[0], np.cumsum(some)])[bounds - bounds[0]]


def dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each key among the distinct ones, how often each is there)."""
    _, number, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return number, counts


def candidates(words: np.ndarray, doc: np.ndarray, repeats: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, symbols, stretches) of the words that a run of ``repeats`` periods or more can hold: a run has each of
    its words ``repeats`` times and each of its pairs once less, so words and pairs that are rarer in their document
    cut it into stretches; stretches of fewer than ``least`` words hold no run. Symbols differ between documents."""
    symbol, counts = dense(doc * (int(words.max(initial=0)) + 1) + words)
    at = np.flatnonzero(counts[symbol] >= repeats)
    if len(at) < 2:
        return at[:0], at[:0], at[:0]
    symbol, counts = dense(symbol[at])
    meets = (np.diff(at) == 1) & (doc[at[1:]] == doc[at[:-1]])
    pair, counts = dense(symbol[:-1] * len(counts) + symbol[1:])
    # Pairs over a gap may be counted too: that lets more through.
    meets &= counts[pair] >= repeats - 1
    stretch = np.concatenate([[0], np.cumsum(~meets)])
    long = np.bincount(stretch)[stretch] >= least
    return at[long], symbol[long], dense(stretch[long])[0]


class Grammar:
    """Re-Pair over several stretches at once, in rounds.

    A round replaces every pair that is more frequent than the pairs overlapping it (ties: in the order of a hash) by
    a new symbol, until no pair occurs twice; what is left of a stretch is folded by twos. ``half`` and ``length``
    have the expansion of each rule's left side and its own in words, ``place`` one place of it; ``used_rule`` and
    ``used_place`` are all places of all rules, the derivation's inner nodes.
    """

    def __init__(self, symbols: np.ndarray, stretch: np.ndarray):
        self.rules = 0
        self.half, self.length, self.place, self.used_rule, self.used_place = [], [], [], [], []
        self.symbol, self.stretch = symbols.copy(), stretch
        self.at, self.size = np.arange(len(symbols)), np.ones(len(symbols), np.int64)
        while self._replaced(*self._frequent()):
            pass
        while self._replaced(*self._folded()):
            pass
        for name in ("half", "length", "place", "used_rule", "used_place"):
            setattr(self, name, np.concatenate(getattr(self, name) or [np.empty(0, np.int64)]))

    def _frequent(self) -> tuple[np.ndarray, np.ndarray]:
        """(positions to replace, number of the pair there) of a round."""
        n = len(self.symbol) - 1
        if n < 1:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        pair, counts = dense(self.symbol[:-1] * (int(self.symbol.max()) + 1) + self.symbol[1:])
        joins = (self.stretch[:-1] == self.stretch[1:]) & (counts[pair] >= 2)
        kind = np.arange(len(counts), dtype=np.uint64) * _MIX
        kind ^= kind >> np.uint64(31)
        rank = np.empty(len(counts), np.int64)
        rank[np.lexsort((kind, counts))] = np.arange(len(counts))
        rank = np.where(joins, rank[pair], -1)
        # Equal ranks in a row are one symbol repeated: every second pair of such a block.
        first = np.flatnonzero(np.diff(rank, prepend=-2) != 0)
        top = rank[first]
        wins = (top >= 0) & (top > np.append(-1, top[:-1])) & (top > np.append(top[1:], -1))
        block = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
        where = np.flatnonzero(wins[block] & ((np.arange(n) - first[block]) % 2 == 0))
        return where, pair[where]

    def _folded(self) -> tuple[np.ndarray, np.ndarray]:
        first = np.flatnonzero(np.diff(self.stretch, prepend=-1))
        inside = np.arange(len(self.stretch)) - np.repeat(first, np.diff(np.append(first, len(self.stretch))))
        where = np.flatnonzero((inside[:-1] % 2 == 0) & (self.stretch[:-1] == self.stretch[1:]))
        return where, np.arange(len(where))

    def _replaced(self, where: np.ndarray, kind: np.ndarray) -> bool:
        if not len(where):
            return False
        _, one, number = np.unique(kind, return_index=True, return_inverse=True)
        size = self.size[where] + self.size[where + 1]
        self.half.append(self.size[where[one]])
        self.length.append(size[one])
        self.place.append(self.at[where[one]])
        self.used_rule.append(self.rules + number)
        self.used_place.append(self.at[where])
        self.rules += len(one)
        self.symbol[where] = int(self.symbol.max()) + 1 + number
        self.size[where] = size
        stays = np.ones(len(self.symbol), bool)
        stays[where + 1] = False
        self.symbol, self.size, self.at, self.stretch = self.symbol[stays], self.size[stays], self.at[stays], self.stretch[stays]
        return True


class Equal:
    """How far two places of a word sequence agree, by a polynomial hash of its beginnings and binary search."""

    def __init__(self, symbols: np.ndarray):
        value = (symbols.astype(np.uint64) + np.uint64(1)) * _MIX
        value ^= value >> np.uint64(29)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        value ^= value >> np.uint64(32)
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(symbols), np.uint64(0xD6E8FEB86659FD93))]))
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(value * self.power[:-1])])

    def _same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the ``n`` words from ``a`` on are those from ``b`` on; a <= b."""
        return (self.sums[a + n] - self.sums[a]) * self.power[b - a] == self.sums[b + n] - self.sums[b]

    def reach(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
        """Equal words from ``a`` and ``b`` on, ``most`` at most; forwards (``step`` 1) or, -1, backwards before them."""
        low, high = np.zeros(len(a), np.int64), most.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_] + 1) // 2
            back = mid if step < 0 else 0
            same = self._same(a[open_] - back, b[open_] - back, mid)
            low[open_] = np.where(same, mid, low[open_])
            high[open_] = np.where(same, high[open_], mid - 1)
            open_ = open_[low[open_] < high[open_]]
        return low


def crossing_runs(g: Grammar, symbols: np.ndarray, repeats: int, least: int) -> tuple[np.ndarray, ...]:
    """(rule, start, end, period) of the runs inside each rule's expansion that cross its middle and are ``repeats``
    periods and ``least`` words long at least; start and end count from the expansion's start. For every period the
    words a period apart are compared around the middle and a period before it: a run of three periods or more
    that crosses the middle has one of both in the stretch of equal words that makes it."""
    rules = np.flatnonzero(g.length >= least)
    tests, equal, out = g.length[rules] // repeats, Equal(symbols), []
    ends = np.cumsum(tests)
    for a in range(0, int(ends[-1]) if len(ends) else 0, TESTS):
        k = np.arange(a, min(a + TESTS, int(ends[-1])))
        row = np.searchsorted(ends, k, "right")
        rule, q = rules[row], k - (ends - tests)[row] + 1
        low, high = g.place[rule], g.place[rule] + g.length[rule]
        for back in (0, 1):
            x = low + g.half[rule] - back * q
            inside = (x >= low) & (x + q < high)
            inside[inside] = symbols[x[inside]] == symbols[x[inside] + q[inside]]
            some = np.flatnonzero(inside)
            x, p, first, last = x[some], q[some], low[some], high[some]
            start = x - equal.reach(x, x + p, x - first, -1)
            end = x + p + equal.reach(x, x + p, last - x - p, 1)
            fits = (end - start >= np.maximum(least, repeats * p)) & (start < first + g.half[rule[some]]) & (end > first + g.half[rule[some]])
            out.append(np.stack([rule[some], start - first, end - first, p])[:, fits])
    found = np.concatenate(out, 1) if out else np.empty((4, 0), np.int64)
    # The least period of an interval: its multiples cover the same words.
    found = found[:, np.lexsort(found[::-1])]
    fresh = np.any(np.diff(found[:3], prepend=-1, axis=1) != 0, axis=0)
    return tuple(found[:, fresh])


def runs(words: np.ndarray, bounds: np.ndarray, repeats: int = 4, least: int = 6) -> tuple[np.ndarray, ...]:
    """(document, start, length, period) of all runs, by document, start and period. ``words`` are the word numbers of
    all documents one after the other, ``bounds`` lie between documents."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at, symbols, stretch = candidates(words, doc, repeats, least)
    g = Grammar(symbols, stretch)
    rule, start, end, period = crossing_runs(g, symbols, repeats, least)
    # Every place of a rule has its runs. What the border of the expansion cuts off is part of the whole run, which
    # the rule that holds it entirely has found: maximal ones stay.
    first, last = np.searchsorted(rule, g.used_rule, "left"), np.searchsorted(rule, g.used_rule, "right")
    n = last - first
    which = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    start, end, period = np.repeat(g.used_place, n) + start[which], np.repeat(g.used_place, n) + end[which], period[which]
    reaches = lambda x, y: (x >= 0) & (y < len(symbols)) & (stretch[x] == stretch[np.minimum(y, len(symbols) - 1)]) & (symbols[x] == symbols[np.minimum(y, len(symbols) - 1)])
    whole = ~(reaches(start - 1, start - 1 + period) | reaches(end - period, end))
    found = np.unique(np.stack([start[whole], period[whole], end[whole]]), axis=1)
    start, period, end = verified(symbols, stretch, *found, repeats, least)
    begin = at[start] if len(start) else start
    of = doc[begin]
    order = np.lexsort((period, begin))
    return of[order], (begin - bounds[of])[order], (end - start)[order], period[order]


def verified(symbols: np.ndarray, stretch: np.ndarray, start: np.ndarray, period: np.ndarray, end: np.ndarray, repeats: int, least: int) -> tuple[np.ndarray, ...]:
    """The runs, each held against the words themselves. Where one fails, a hash has met another's: then the runs of
    that stretch are taken from the words, period by period."""
    bad = {int(stretch[s]) for s, q, e in zip(start.tolist(), period.tolist(), end.tolist()) if not np.array_equal(symbols[s : e - q], symbols[s + q : e])}
    if not bad:
        return start, period, end
    stays = ~np.isin(stretch[start], list(bad))
    out = {(s, q, e) for s, q, e in zip(start[stays].tolist(), period[stays].tolist(), end[stays].tolist())}
    for k in bad:
        a, z = np.searchsorted(stretch, k, "left"), np.searchsorted(stretch, k, "right")
        least_period: dict = {}
        for q in range(1, (z - a) // repeats + 1):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], symbols[a : z - q] == symbols[a + q : z], [0]])))
            for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
                if e + q - s >= max(least, repeats * q):
                    least_period.setdefault((a + s, a + e + q), q)
        out |= {(s, q, e) for (s, e), q in least_period.items()}
    return tuple(np.array(sorted(out), np.int64).reshape(-1, 3).T)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeats: int = 4, least: int = 6) -> DataFrame:
    """``(id_col, n_words, runs, collapsed)``: the periodic runs of each whole text, an array of structs ``start,
    length, period`` (long, in words) by start and period, and its words joined by one space without those that a run
    repeats, that is all of a run behind its first period.

    A run is a longest stretch of words that are equal a period apart, ``period`` being the least such number, with
    ``length >= max(least, repeats * period)``. Words are runs of anything but ASCII white space.

    Each document is one task's work, n log n in its words: words and pairs too rare for a run are left out first, a
    Re-Pair grammar is made of the rest, and each rule is looked at once whatever its number of places. Words are
    compared in the end, so no hash decides.

    Null and empty texts: no words, no runs, empty ``collapsed``. Null or repeated ids, repeated rows: a result each.
    Ties: none, the runs are all given. Very long texts: one row, held in one task. Empty table: no row. Other columns: ignored.
    """
    if repeats < 3:
        raise ValueError("runs of fewer than three periods aren't found by this method")
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for a, z in pieces_of(column):
                flat, bounds = words_of(column.slice(a, z - a))
                codes = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
                of, start, length, period = runs(codes, bounds, repeats, least)
                structs = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], fields=list(kind))
                rows = np.searchsorted(of, np.arange(z - a + 1)).astype(np.int32)
                gone = np.zeros(len(codes) + 1, np.int64)
                np.add.at(gone, bounds[of] + start + period, 1)
                np.add.at(gone, bounds[of] + start + length, -1)
                kept = np.cumsum(gone[:-1]) == 0
                left = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept)])[bounds].astype(np.int32)), flat.filter(pa.array(kept)))
                yield pa.record_batch(
                    [batch.column(0).slice(a, z - a), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(rows), structs), pc.binary_join(left, " ")],
                    [id_col, "n_words", "runs", "collapsed"],
                )

    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return slim.mapInArrow(lean(found), schema)


def looped(text: Column, number: Column) -> Column:
    """The words of ``text`` joined by spaces, those from word a on repeating with period p: a = g % n and p = 1 +
    (n - a) // (3 + g % 8) with n words and g = ``number``; a text without words as it is."""

    def again(words: Column) -> Column:
        n = F.size(words)
        a = (number % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + number % 8))).cast("int")
        word = lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), word), " ")

    words = F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")
    return let(words, lambda w: F.when(F.size(w) > 0, again(w)).otherwise(text))


__all__ = ["periodic_runs", "runs", "looped"]
