"""Near-duplicate classes by BagMinHash: band, verify the multiset overlap, and join what is linked.

Texts become bags of five-word shingles. Equal bags are one node from the start. Nodes that share a band
are candidates, but pairs are not listed: first every node is compared with the least node of each of its
bands, which settles all bands of two and most groups of copies. Of the bands whose members are then still in
several classes, those with many members outside the largest are taken apart by rare shingles that two texts at
the threshold must share; the largest class of each is compared with the members outside it, and those with one
another, in blocks inside tasks, which give back the links that join classes and nothing else.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.llm.bagminhash import band_keys, mix, signatures
from kbspark.llm.components import components
from kbspark.llm.shared import SPACE_CLASS, give_back, lean, small_batches, split_join, written

#: Classes of bag sizes in which rare shingles are compared.
SIZES = 1.02
#: Elements that one call to the signature code takes; a longer text is taken alone.
CHUNK = 150_000


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-cased words (runs without ASCII white space) of a whole text."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE_CLASS + "+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def row_key(id_col: str, text_col: str) -> Column:
    """A 64-bit key of a row's id and text; never null."""
    return F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("\0")), F.coalesce(F.col(text_col), F.lit("")))


def bag(words: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes in order, how often each occurs). A text of fewer words is one shingle."""
    w = words.view(np.uint64)
    if not len(w):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    k = min(shingle, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = mix(h ^ w[i : i + len(h)])
    return np.unique(h, return_counts=True)


def print_of(shingles: np.ndarray, counts: np.ndarray) -> bytes:
    """A 128-bit print of a bag."""
    return hashlib.blake2b(shingles.tobytes() + counts.tobytes(), digest_size=16).digest()


def _lists(column) -> Iterator[np.ndarray]:
    values = column.values.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    bounds = column.offsets.to_numpy()
    for a, b in zip(bounds, bounds[1:]):
        yield values[a:b]


def _signed(docs: DataFrame, id_col: str, text_col: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """``(id, key, print, size, bands)``: :func:`row_key`, a 128-bit print of the bag, its weight, its band keys; null
    print for no words."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start, held, size = 0, [], 0
            for k, words in enumerate(_lists(b.column("words"))):
                held.append(bag(words, shingle))
                size += len(held[-1][0])
                if size >= CHUNK or k + 1 == b.num_rows:
                    yield out(b.slice(start, len(held)), held)
                    start, held, size = k + 1, [], 0

    def out(own, bags) -> pa.RecordBatch:
        lengths = [len(u) for u, _ in bags]
        doc = np.repeat(np.arange(len(bags)), lengths)
        keys = band_keys(signatures(doc, np.concatenate([u for u, _ in bags]), np.concatenate([c for _, c in bags]), len(bags), bands * rows), bands)
        prints = [print_of(u, c) if len(u) else None for u, c in bags]
        sizes = [int(c.sum()) for _, c in bags]
        return pa.record_batch(
            [own.column("id"), own.column("key"), pa.array(prints, pa.binary()), pa.array(sizes, pa.int64()), pa.array(list(keys), pa.list_(pa.int64()))],
            ["id", "key", "print", "size", "bands"],
        )

    slim = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), word_hashes(F.col(text_col)).alias("words"))
    return slim.mapInArrow(lean(sign), f"id {id_type}, key long, print binary, size long, bands array<long>")


def _bags(docs: DataFrame, id_col: str, text_col: str, shingle: int, wanted: DataFrame) -> DataFrame:
    """``(node, shingles, counts)`` for the nodes of ``wanted`` (node, key, print), from the text of the row with that key.

    Other texts stop at a bitmap of at most 16 MB before anything is shuffled, and each task passes a key on once, so
    repeated rows don't meet. Beyond some 100 million wanted rows the bitmap is full and all texts are shuffled once.
    """
    from kbspark.llm.decontam import build_sieve

    sieve = docs.sparkSession.sparkContext.broadcast(build_sieve(wanted, "key", wanted.count()))

    def wanted_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: set[int] = set()
        for b in batches:
            keys = b.column("key").to_numpy()
            hit = [k for k in sieve.value.holds(keys).tolist() if not (keys[k] in passed or passed.add(keys[k]))]
            if hit:
                yield b.take(pa.array(hit))

    slim = docs.select(row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    some = slim.mapInArrow(lean(wanted_only), "key long, text string").select("key", word_hashes(F.col("text")).alias("words"))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [bag(w, shingle) for w in _lists(b.column("words"))]
            # Should two rows have one key, the node's is the one with its print.
            own = [k for k, ((u, c), p) in enumerate(zip(found, b.column("print").to_pylist())) if print_of(u, c) == p]
            longs = pa.list_(pa.int64())
            yield pa.record_batch(
                [b.column("node").take(pa.array(own, pa.int64())), pa.array([found[k][0].view(np.int64) for k in own], longs), pa.array([found[k][1] for k in own], longs)],
                ["node", "shingles", "counts"],
            )

    joined = some.join(wanted, "key").select("node", "print", "words")
    return joined.mapInArrow(lean(bags), "node long, shingles array<long>, counts array<long>").dropDuplicates(["node"])


def overlap(u: np.ndarray, c: np.ndarray, v: np.ndarray, d: np.ndarray) -> float:
    """The weighted Jaccard similarity of two bags."""
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    both = int(np.minimum(c[i], d[j]).sum())
    return both / (int(c.sum()) + int(d.sum()) - both)


def similarities(bags: list[tuple[np.ndarray, np.ndarray]], columns: int = 4096) -> np.ndarray:
    """All weighted Jaccard similarities of two different bags of some, exactly: the n-th copy of a shingle is an
    element of its own, so overlaps are products of 0/1 rows, taken over ``columns`` elements at a time.
    Elements of one bag alone are left out, so the diagonal says nothing."""
    n = len(bags)
    doc = np.repeat(np.arange(n), [len(u) for u, _ in bags])
    u, c = (np.concatenate(x) for x in zip(*bags))
    at, element = _elements(u, c)
    doc = doc[at]
    _, element, seen = np.unique(element, return_inverse=True, return_counts=True)
    common = seen[element] > 1
    doc, element = doc[common], element[common]
    _, element = np.unique(element, return_inverse=True)
    order = np.argsort(element, kind="stable")
    doc, element = doc[order], element[order]
    both = np.zeros((n, n), np.float32)
    for a in range(0, int(element[-1]) + 1 if len(element) else 0, columns):
        lo, hi = np.searchsorted(element, [a, a + columns])
        x = np.zeros((n, columns), np.float32)
        x[doc[lo:hi], element[lo:hi] - a] = 1
        both += x @ x.T
    size = np.array([int(k.sum()) for _, k in bags], float)
    return both / np.maximum(size[:, None] + size[None, :] - both, 1)


def _forest(nodes: np.ndarray, roots: np.ndarray, same: np.ndarray) -> list[tuple[int, int]]:
    """Links of ``same`` that join classes not joined before; one fewer than the classes at most."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(same, 1))):
        a, b = find(int(roots[i])), find(int(roots[j]))
        if a != b:
            parent[a] = b
            out.append((int(nodes[i]), int(nodes[j])))
    return out


def _elements(u: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``u``, hash) of the elements of bags one after the other: the n-th copy of a shingle is one of its own."""
    at = np.repeat(np.arange(len(u)), c)
    copy = np.arange(len(at)) - np.repeat(np.cumsum(c) - c, c)
    return at, mix(u[at].view(np.uint64) ^ mix(copy.astype(np.uint64)))


def _rare(bags: DataFrame, crowd: DataFrame, threshold: float) -> DataFrame:
    """``(band, node, part)``: the nodes of ``crowd`` (node, root) by their rarest elements, as bands of another kind.

    Bags of sizes m and n at the threshold t have o = t / (1 + t) * (m + n) elements or more in common. In any order of
    all elements one of these is among the first m - o + 1 of the one bag and the first n - o + 1 of the other; with
    the rarest first (counted over the crowd) few others have it too. No pair at the threshold is lost.

    Sizes are in classes of a factor ``SIZES``, and a band is an element and two classes that pairs may have, so that
    o is known almost exactly. Nodes of one class are parted by ``root``, those of two by class: parts meet one another.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, roots = b.column("node").to_numpy(), b.column("root").to_numpy()
            for k, (u, c) in enumerate(zip(_lists(b.column("shingles")), _lists(b.column("counts")))):
                element = _elements(u, c)[1].view(np.int64)
                n = len(element)
                yield pa.record_batch([pa.array(x) for x in (np.full(n, nodes[k]), np.full(n, roots[k]), np.full(n, n), element)], ["node", "root", "size", "element"])

    each = bags.join(crowd, "node").mapInArrow(lean(spread), "node long, root long, size long, element long")
    each = written(each, "crowd-elements")
    counts = written(each.groupBy("element").agg(F.count("*").alias("n")), "crowd-counts")
    ranked = split_join(each, counts, "element", each.count())
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("n", "element")))
    class_of = lambda n: F.floor(F.log(n.cast("double")) / math.log(SIZES) + 1e-9).cast("int")
    least_of = lambda k: F.ceil(F.pow(F.lit(SIZES), k) - 1e-6)
    own, others = class_of(F.col("size")), F.sequence(class_of(F.greatest(F.lit(1), F.ceil(threshold * F.col("size") - 1e-9))), class_of(F.floor(F.col("size") / threshold + 1e-9)))
    common = lambda k: F.ceil(threshold / (1 + threshold) * (F.col("size") + least_of(k)) - 1e-6)
    reach = F.filter(others, lambda k: F.col("rank") <= F.col("size") - common(k) + 1)
    met = ranked.filter("n > 1").withColumn("own", own).withColumn("other", F.explode(reach))
    band = F.xxhash64("element", F.least("own", "other"), F.greatest("own", "other"))
    return met.select(band.alias("band"), "node", F.when(F.col("own") == F.col("other"), F.col("root")).otherwise(F.col("own")).alias("part"))


def _open(known: DataFrame, least: int = 3) -> DataFrame:
    """``(band, n, root, others)`` of the bands in ``known`` (band, node, root) with ``least`` members or more in several
    classes: the root of the largest class and the members outside it. Of bands with equal members one is given."""
    of_class = known.groupBy("band", "root").agg(F.count("*").alias("c"), F.expr("bit_xor(xxhash64(node))").alias("x"), F.sum("node").alias("s"))
    most = F.max(F.struct("c", "root"))
    bands = of_class.groupBy("band").agg(F.sum("c").alias("n"), F.count("*").alias("roots"), most.alias("most"), F.expr("bit_xor(x)").alias("x"), F.sum("s").alias("s"))
    some = bands.filter((F.col("n") >= least) & (F.col("roots") > 1)).groupBy("n", "x", "s").agg(F.min_by(F.struct("band", "most"), "band").alias("one"))
    return some.select("one.band", "n", "one.most.root", (F.col("n") - F.col("one.most.c")).alias("others"))


def _dealt(known: DataFrame, found: DataFrame, total: int, block: int) -> DataFrame:
    """``(band, i, j, node, root)``: the members of open bands dealt to blocks. A band of ``block`` members is one; of
    others, with k members outside the largest class, those make ceil(k / block) blocks that meet one another
    (i <= j) and the blocks of the class (j < 0), so a member is sent about k / block times and not n / block times."""
    met = split_join(known, found.withColumnRenamed("root", "most"), "band", total)
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / F.lit(block))).cast("int")
    whole, inner = F.col("n") <= block, F.col("root") == F.col("most")
    own = F.pmod(F.xxhash64("node"), F.when(inner, F.col("in_parts")).otherwise(F.col("out_parts"))).cast("int")
    up_to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    mine = F.col("mine")
    outside = F.concat(
        F.transform(up_to("out_parts"), lambda o: place(F.least(mine, o), F.greatest(mine, o))), F.transform(up_to("in_parts"), lambda g: place(mine, -1 - g))
    )
    inside = F.transform(up_to("out_parts"), lambda o: place(o, -1 - mine))
    places = F.when(whole, F.array(place(F.lit(0), F.lit(0)))).when(inner, inside).otherwise(outside)
    placed = met.withColumns({"in_parts": blocks(F.col("n") - F.col("others")), "out_parts": blocks(F.col("others"))}).withColumn("mine", own)
    return placed.withColumn("at", F.explode(places)).select("band", "at.i", "at.j", "node", "root")


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float, shingle: int, bands: int, rows: int, block: int) -> DataFrame:
    """``(id, key, low, class_id, class_size)`` for each row of ``docs``; ``low`` is (no id, id, key) of the row that
    stands for the class, null for rows without words."""
    small_batches(docs.sparkSession)
    signed = written(_signed(docs, id_col, text_col, shingle, bands, rows), "signed")
    full = signed.filter(F.col("print").isNotNull())
    nodes = written(
        full.groupBy("print")
        .agg(F.min("key").alias("key"), F.max("size").alias("size"), F.first("bands").alias("bands"), F.count("*").alias("rows"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("low"))
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    # Bands with two nodes or more, each row with its band's least node.
    each = nodes.select("node", "size", F.explode("bands").alias("band"))
    shared = each.groupBy("band").agg(F.min(F.struct("node", "size")).alias("leader"), F.count("*").alias("n")).filter("n > 1")
    members = split_join(each, written(shared, "shared-bands"), "band", bands * nodes.count())
    members = written(members.select("band", "node", "size", "n", F.col("leader.node").alias("leader"), F.col("leader.size").alias("leader_size")), "members")
    wanted = members.select("node").distinct().join(nodes.select("node", "key", "print"), "node")
    bags = written(_bags(docs, id_col, text_col, shingle, written(wanted, "wanted")), "bags")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = [list(_lists(b.column(n))) for n in ("u", "c", "v", "d")]
            good = [k for k, (u, c, v, d) in enumerate(zip(*sides)) if overlap(u.view(np.uint64), c, v.view(np.uint64), d) >= threshold]
            if good:
                yield b.select(["a", "b"]).take(pa.array(good))

    # Where the bags' sizes alone rule a link out, it isn't tried.
    near = F.least("size", "leader_size") >= threshold * F.greatest("size", "leader_size")
    pairs = written(members.filter(F.col("leader") != F.col("node")).filter(near).select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    # A leader's bag goes to as many places as its pairs need, so those of a hot leader don't meet in one task.
    parts = pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / 1000).cast("int"))
    salted = split_join(pairs, parts, "a", pairs.count()).select("a", "b", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("salt"))
    bags_a = bags.join(parts.select(F.col("a").alias("node"), "parts"), "node").select(
        F.col("node").alias("a"), F.col("shingles").alias("u"), F.col("counts").alias("c"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt")
    )
    with_a = salted.join(bags_a, ["a", "salt"])
    with_b = with_a.join(bags.select(F.col("node").alias("b"), F.col("shingles").alias("v"), F.col("counts").alias("d")), "b")
    stars = written(with_b.mapInArrow(lean(linked), "a long, b long"), "stars")
    classes = written(components(stars, "star-classes"), "star-classes")

    known = written(members.filter("n > 2").join(classes, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root")), "known")
    found = written(_open(known), "open-bands")
    total = known.count()
    # Bands with many members outside the largest class give way to the rare shingles of their members.
    crowd = split_join(known, found.filter(F.col("others") > block).select("band", "n"), "band", total).select("node", "root").distinct()
    crowd = written(crowd, "crowd")
    rare = written(_rare(bags, crowd, threshold).withColumnRenamed("part", "root"), "rare-shingles")
    apart = _dealt(rare, written(_open(rare, 2), "open-rare"), rare.count(), block).drop("root").join(crowd, "node").select("band", "i", "j", "node", "root")
    dealt = _dealt(known, found.filter(F.col("others") <= block), total, block).unionByName(apart)

    def block_links(group: pd.DataFrame) -> pd.DataFrame:
        held = [(np.asarray(u, np.int64), np.asarray(c, np.int64)) for u, c in zip(group["shingles"], group["counts"])]
        found = _forest(group["node"].to_numpy(), group["root"].to_numpy(), similarities(held) >= threshold)
        del held
        give_back()
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    more = dealt.join(bags, "node").groupBy("band", "i", "j").applyInPandas(block_links, "a long, b long")
    more = written(more, "more-links")
    linked_nodes = components(stars.union(more), "classes")
    placed = written(nodes.select("print", "node", "rows", "low").join(linked_nodes, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    names = placed.groupBy("root").agg(F.min("low").alias("low"), F.sum("rows").alias("class_size"), F.count("*").alias("n"))
    of_print = split_join(placed.select("print", "root", "rows"), names, "root", placed.count()).select("print", "rows", "low", F.col("low.id").alias("class_id"), "class_size")
    named = split_join(full.select("id", "key", "print"), written(of_print, "named"), "print", full.count(), count="rows")
    alone = signed.filter(F.col("print").isNull()).select("id", "key", F.lit(None).cast(names.schema["low"].dataType).alias("low"), F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return named.select(*alone.columns).union(alone)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.8,
    shingle: int = 5,
    bands: int = 32,
    rows: int = 5,
    block: int = 400,
) -> DataFrame:
    """``(id_col, class_id, class_size)`` for every row of ``docs``: rows are in one class if a chain of links
    with weighted Jaccard similarity of at least ``threshold`` joins their texts, and ``class_id`` is the
    least id of the class.

    Similarity is of bags of ``shingle`` lower-cased words, exactly computed for every link that is used.
    Candidates share one of ``bands`` bands of ``rows`` components; with 32 bands of 5 a pair at 0.8 is missed
    with a chance of 3e-6, and at 0.9 of 4e-13. The first comparison has a row for each member and band, never for
    each pair. Where a band of n members keeps several classes after it, the k members outside the largest class are
    compared with all: k * n / ``block`` + n rows are shuffled with their bags, and k * n overlaps computed. Members of bands
    with k above ``block`` meet by their rarest shingles instead, a ninth of them for texts of one size, which loses no
    pair at the threshold: a crowd of texts below 0.6 whose differences are their own comes apart. Each block returns
    at most one link fewer than it has classes. What remains quadratic is a crowd of texts that share a band and are all
    between 0.6 and the threshold.

    Null text, or one without words: a class of its own. Fewer words than ``shingle``: one shingle. Equal texts:
    one class. Rows with one id and several texts: each text has its class, and the id counts in class_id of each.
    Null ids: linked as any row; class_id is null only where all ids of a class are. Very long texts: taken whole.
    Empty table: empty result. Other columns are not carried.
    """
    found = _classes(docs, id_col, text_col, threshold, shingle, bands, rows, block)
    return found.select(F.col("id").alias(id_col), "class_id", "class_size")


def drop_near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.8,
    shingle: int = 5,
    bands: int = 32,
    rows: int = 5,
    block: int = 400,
) -> DataFrame:
    """``docs`` with one document of each class of :func:`near_duplicates`, its columns as they are: the one with the
    least id, of several texts with that id the one with the least hash, and one without id only where no other has
    one. Rows with the same id and the same text are one document and stay or go together. Texts without words stay."""
    found = _classes(docs, id_col, text_col, threshold, shingle, bands, rows, block)
    stays = F.col("id").eqNullSafe(F.col("low.id")) & (F.col("key") == F.col("low.key"))
    gone = found.filter(F.col("low").isNotNull() & ~stays).select(F.col("id").alias("__gone"), F.col("key").alias("__gone_key")).distinct()
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col("__gone")) & (row_key(id_col, text_col) == F.col("__gone_key")), "left_anti")
