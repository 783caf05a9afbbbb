"""Benchmark decontamination by spaced seeds: fixed masks that ignore some word positions find places where a
document and a benchmark item agree in spite of substituted words, and an alignment there is the proof."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm.shared import lean, small_batches, split_join, written

#: Fixed masks: 1 compares a word, 0 ignores it; each compares six. Every stretch of 13 words with up to 2
#: substitutions, of 15 with 3, of 20 with 4 and of 25 with 5 has a place where one of them fits: the set was found
#: by a greedy search over all such patterns, and a test goes through them again.
MASKS = ("1110111", "1111011", "1110100011", "11000011011")
#: Seeds of items that may be broadcast: 24 bytes each.
BROADCAST_SEEDS = 1_000_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-cased runs of letters and digits of a whole text, in order."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the compared words of ``mask`` at each place where it fits (int64)."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.int64)
    w, h = words.view(np.uint64), np.full(n, len(mask), np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            h += w[k : k + n]
            h *= _MULTIPLIER
            h ^= h >> np.uint64(29)
    return h.view(np.int64)


def least_equal(n: int, share: float) -> int:
    """Equal words that make ``share`` of ``n`` words, in whole numbers."""
    return max(1, -(-round(1000 * share) * n // 1000))


def whole_masks(n: int, share: float) -> dict[tuple[str, int], None]:
    """(mask, its first word in the item) for an item of ``n`` words that counts whole: with k substitutions allowed,
    the words are cut into blocks and each mask ignores k of them, so wherever the substitutions are, some mask
    compares none of them. Masks begin and end with a compared word, so an item cut off at the end of a document by
    no more than k words is met too."""
    k = n - least_equal(n, share)
    # More blocks leave more words compared; four are rare enough.
    blocks = next((b for b in range(k + 1, n) if n - k * -(-n // b) >= 4), n)
    block_of = [i * blocks // n for i in range(n)]
    out = {}
    for gone in combinations(range(blocks), k):
        mask = "".join("0" if b in gone else "1" for b in block_of)
        out[mask.strip("0"), mask.index("1")] = None
    return out


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(all values, bounds of each list) of an Arrow list column."""
    values = column.values.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    return values, column.offsets.to_numpy().astype(np.int64)


class Sieve:
    """A bitmap of seed hashes with two probes; it has no false negatives and a size fixed beforehand."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.map = bits, words.view(np.uint8)

    @staticmethod
    def probes(h: Column, bits: int) -> list[Column]:
        return [F.shiftrightunsigned(h, 64 - bits), h.bitwiseAND(F.lit((1 << bits) - 1))]

    def holds(self, h: np.ndarray) -> np.ndarray:
        u = h.view(np.uint64)
        at = u >> np.uint64(64 - self.bits)
        first = np.flatnonzero((self.map[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)
        at = u[first] & np.uint64((1 << self.bits) - 1)
        return first[((self.map[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1) == 1]


def build_sieve(hashes: DataFrame, column: str, n: int, max_bits: int = 27) -> Sieve:
    """A sieve of ``n`` hashes: 256 bits a hash up to 2**max_bits bits (16 MB), so what goes to the driver and
    to the tasks is bounded; beyond that it only lets more through, and the join that follows is exact."""
    bits = min(max_bits, max(16, int(256 * max(1, n) - 1).bit_length()))
    at = F.explode(F.array(*Sieve.probes(F.col(column), bits)))
    set_bits = hashes.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("set")
    )
    words = np.zeros(1 << (bits - 6), np.int64)
    found = set_bits.toArrow()
    words[found.column("word").to_numpy()] = found.column("set").to_numpy()
    return Sieve(bits, words)


def longest_overlap(equal: np.ndarray, share: float) -> tuple[int, int]:
    """(start, end) of the longest stretch in which at least ``share`` of the places are equal; the first of
    equally long ones. Linear after a sort."""
    if not equal.any():
        return 0, 0
    # Whole numbers, so that a share met exactly counts.
    s = np.concatenate([[0], np.cumsum(np.where(equal, 1000 - round(1000 * share), -round(1000 * share)))])
    low = np.minimum.accumulate(s)
    best = (0, 0)
    # The running minimum falls, so the earliest start for an end is found by binary search in it.
    starts = np.searchsorted(-low, -s, side="left")
    lengths = np.arange(len(s)) - starts
    j = int(np.argmax(lengths))
    if lengths[j] > 0:
        best = (int(starts[j]), j)
    return best


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    min_overlap: int = 13,
    share: float = 0.8,
    min_item_words: int = 1,
    reach: int = 256,
    masks: tuple[str, ...] = MASKS,
    broadcast_seeds: int = BROADCAST_SEEDS,
) -> DataFrame:
    """``(id_col, item_col, overlap, equal, item_words, coverage, doc_word)``: the documents and benchmark items
    that share a stretch of ``min_overlap`` aligned words of which at least ``share`` are equal, with the best such
    stretch of the pair. Items with fewer words than that count only whole, where ``share`` of all their words are
    equal; under five words, where one substitution is more than a fifth, that is word for word. ``doc_word`` is the
    first word of the stretch in the document.

    Documents pass a fixed-size sieve of the benchmark's seeds in one scan; what it lets through is joined
    on the exact seed hash and only those places are aligned, up to ``reach`` words on each side. The shifts of a place
    against an item are gathered first, so both texts travel once however repetitive they are. Items under
    ``min_overlap`` words get masks for their length that lose no place with the substitutions ``share`` allows
    (:func:`whole_masks`). ``min_item_words`` leaves shorter items out; by default none.

    Null or empty texts and items: never match. Repeated items: each is reported. Repeated documents with
    one id: reported once an item. Null ids stay null. Very long texts: linear. Empty tables: empty result.
    Other columns are not carried.
    """
    small_batches(docs.sparkSession)
    items = benchmark.select(F.col(item_col).alias("item"), word_hashes(F.col(item_text)).alias("words")).filter(F.size("words") >= min_item_words)
    items = written(items, "items")
    short = sorted(r.n for r in items.filter(F.size("words") < min_overlap).select(F.size("words").alias("n")).distinct().collect())
    masks_of = {n: list(whole_masks(n, share)) for n in short}
    every = list(dict.fromkeys([*masks, *(m for ms in masks_of.values() for m, _ in ms)]))

    def item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, bounds = _flat(b.column("words"))
            ids, out_i, out_q, out_h = b.column("item").to_numpy(zero_copy_only=False), [], [], []
            for k in range(b.num_rows):
                w = values[bounds[k] : bounds[k + 1]]
                if len(w) >= min_overlap:
                    found = [(np.arange(len(h)), h) for h in (seeds(w, mask) for mask in masks)]
                else:
                    found = [(np.array([q]), seeds(w[q : q + len(mask)], mask)) for mask, q in masks_of[len(w)]]
                for q, h in found:
                    out_h.append(h)
                    out_q.append(q)
                    out_i.append(np.full(len(h), k))
            if out_h:
                rows = np.concatenate(out_i)
                yield pa.record_batch([b.column("item").take(pa.array(rows)), pa.array(np.concatenate(out_q)), pa.array(np.concatenate(out_h))], ["item", "q", "h"])

    item_type = items.schema["item"].dataType.simpleString()
    of_items = written(items.mapInArrow(lean(item_seeds), f"item {item_type}, q long, h long"), "item-seeds")
    n_seeds = of_items.count()
    sieve = build_sieve(of_items, "h", n_seeds)
    id_type = docs.schema[id_col].dataType.simpleString()

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches of documents around seeds that pass the sieve."""
        for b in batches:
            values, bounds = _flat(b.column("words"))
            at, hs = [], []
            for mask in every:
                h = seeds(values, mask)
                hit = sieve.holds(h)
                inside = bounds[np.searchsorted(bounds, hit, side="right")] >= hit + len(mask)
                at.append(hit[inside])
                hs.append(h[hit[inside]])
            at, hs = np.concatenate(at), np.concatenate(hs)
            if not len(at):
                continue
            order = np.argsort(at, kind="stable")
            at, hs = at[order], hs[order]
            doc = np.searchsorted(bounds, at, side="right") - 1
            new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] - at[:-1] > reach)]))
            ends = np.append(new[1:], len(at))
            rows = []
            for a, z in zip(new, ends):
                lo, hi = max(bounds[doc[a]], at[a] - reach), min(bounds[doc[a] + 1], at[z - 1] + reach)
                rows.append((lo - bounds[doc[a]], values[lo:hi], [{"h": int(x), "p": int(p - lo)} for x, p in zip(hs[a:z], at[a:z])]))
            first, words, hits = zip(*rows)
            ids = b.column("id").take(pa.array(doc[new]))
            hit_type = pa.list_(pa.struct([("h", pa.int64()), ("p", pa.int64())]))
            yield pa.record_batch([ids, pa.array(first, pa.int64()), pa.array(words, pa.list_(pa.int64())), pa.array(hits, hit_type)], ["id", "first", "words", "hits"])

    slim = docs.select(F.col(id_col).alias("id"), word_hashes(F.col(text_col)).alias("words"))
    found = slim.mapInArrow(lean(places), f"id {id_type}, first long, words array<long>, hits array<struct<h: long, p: long>>")
    found = written(found.withColumn("place", F.monotonically_increasing_id()), "places")
    hits = found.select("place", F.explode("hits").alias("hit")).select("place", F.col("hit.h").alias("h"), F.col("hit.p").alias("p"))
    if n_seeds <= broadcast_seeds:
        met = hits.join(F.broadcast(of_items), "h")
    else:  # a seed that many places share is dealt over 16 tasks
        salts = of_items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        met = hits.withColumn("salt", F.pmod("place", F.lit(16)).cast("int")).join(salts, ["h", "salt"])
    # A place is a stretch of one text, so it has no more shifts against an item than the two have words.
    lines = met.groupBy("place", "item").agg(F.collect_set(F.col("p") - F.col("q")).alias("shifts"))
    lines = written(lines, "shifts")
    sized = items.select("item", F.col("words").alias("item_words")).join(lines.groupBy("item").agg(F.count("*").alias("n")), "item")
    pairs = split_join(lines, sized, "item", lines.count()).join(found.select("place", "id", "first", "words"), "place")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dv, db = _flat(b.column("words"))
            iv, ib = _flat(b.column("item_words"))
            keep, out = [], []
            for k, (shifts, first) in enumerate(zip(b.column("shifts").to_pylist(), b.column("first").to_pylist())):
                d, i = dv[db[k] : db[k + 1]], iv[ib[k] : ib[k + 1]]
                best = None
                for shift in shifts:
                    lo, hi = max(0, -shift), min(len(i), len(d) - shift)
                    equal = i[lo:hi] == d[lo + shift : hi + shift]
                    if len(i) < min_overlap:
                        # A short item counts whole, words beyond the document's ends as unequal ones.
                        s, e = (0, len(equal)) if equal.sum() >= least_equal(len(i), share) else (0, 0)
                    else:
                        s, e = longest_overlap(equal, share)
                    if e - s >= (min_overlap if len(i) >= min_overlap else 1):
                        same = int(equal[s:e].sum())
                        best = max(best or (), (same, e - s, -(first + lo + shift + s)))
                if best:
                    keep.append(k)
                    out.append((best[1], best[0], len(i), best[0] / len(i), -best[2]))
            if keep:
                take = pa.array(keep)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
                yield pa.record_batch([b.column("id").take(take), b.column("item").take(take), *(pa.array(c, t) for c, t in zip(zip(*out), types))], ["id", "item", "overlap", "equal", "item_words", "coverage", "doc_word"])

    proven = pairs.select("id", "item", "shifts", "first", "words", "item_words").mapInArrow(
        lean(align), f"id {id_type}, item {item_type}, overlap long, equal long, item_words long, coverage double, doc_word long"
    )
    best = proven.groupBy("id", "item").agg(F.max(F.struct("equal", "overlap", -F.col("doc_word"), "item_words", "coverage")).alias("b"))
    return best.select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), "b.overlap", "b.equal", "b.item_words", "b.coverage", (-F.col("b.col3")).alias("doc_word")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that :func:`contaminated` finds; its columns as they are.

    Rows with a null id are kept or dropped together, as the rows of one document.
    """
    bad = contaminated(docs, benchmark, id_col=id_col, **options).select(F.col(id_col).alias("__bad")).distinct()
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("__bad")), "left_anti")
