"""The trie of all conversations' beginnings by a splitter skeleton: conversations are range-partitioned by their
sequence of turns, the trie of the partition borders is known to every task, and only its nodes reach over shards."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm.shared import written

#: Conversation ids of one block have this many low bits of their own, so a block is 65,536 ids at most.
BLOCK_BITS = 16
#: Turns that the sample for the shard borders has, expected; it bounds the skeleton too.
SAMPLE_TURNS = 2_000_000
_NUMBERS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
_SHARD_ROW = ", ".join(f"{c} long" for c in _NUMBERS) + ", ends_sha256 string, skeleton int, parent_skeleton int, last_chars long"


def turn_keys(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, head, hi, lo, chars)`` of conversation rows: a 128-bit hash of (role, text), the code points
    of the text and, for ties, its first 64. Null role or text: empty. Rows without ``conv_id`` belong to no conversation
    and are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.substring(text, 1, 64).alias("head"),
        F.xxhash64(role, text).alias("hi"),
        F.xxhash64(F.lit(0x5EED), text, role).alias("lo"),
        F.length(text).cast("long").alias("chars"),
    )


def gathered(keys: DataFrame) -> DataFrame:
    """``(conv_id, turns)``: the keys of each conversation in order of ``turn``, null first, ties by role, the first 64
    characters of the text and its hash.

    A conversation's keys are one row, 32 bytes a turn and about 100 while they are sorted, whatever the length of its texts.
    """
    rows = F.sort_array(F.collect_list(F.struct("turn", "role", "head", "hi", "lo", "chars")))
    return keys.groupBy("conv_id").agg(F.transform(rows, lambda t: F.struct(t["hi"], t["lo"], t["chars"])).alias("turns"))


def ends_of(members: DataFrame) -> DataFrame:
    """``(path, chars, n, conv_id, ends)`` for each distinct path of ``members`` (conv_id, path, chars): how many
    conversations take it to its end, the least of them, and the SHA-256 of all their ids, ascending and joined by
    commas.

    Ids are joined in blocks of 65,536 numbers on many tasks. Where a path has several blocks they are hashed one
    after the other, held one at a time; a SHA-256 can't be put together from parts.
    """
    block = F.shiftright("conv_id", BLOCK_BITS)
    ids = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",")
    blocks = written(
        members.groupBy("path", block.alias("block")).agg(
            F.first("chars").alias("chars"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), ids.alias("ids")
        ),
        "trie-blocks",
    )
    paths = blocks.groupBy("path").agg(
        F.first("chars").alias("chars"), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"),
        F.count("*").alias("blocks"), F.when(F.count("*") == 1, F.sha2(F.first("ids"), 256)).alias("ends"),
    )
    many = paths.filter("blocks > 1").select("path")
    key = F.struct(F.xxhash64("path"), F.xxhash64(F.lit(1), "path"))
    waiting = blocks.join(many, "path", "left_semi").select(key.cast("struct<a:long,b:long>").alias("key"), "block", "ids")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, out = None, None, []
        for batch in batches:
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids"))):
                if (a, b) != now:
                    if sha:
                        out.append((*now, sha.hexdigest()))
                    now, sha = (a, b), hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
        if sha:
            out.append((*now, sha.hexdigest()))
        columns = list(zip(*out)) or [(), (), ()]
        yield pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["a", "b", "long_ends"])

    in_order = waiting.select("key.a", "key.b", "block", "ids").repartition("a", "b").sortWithinPartitions("a", "b", "block")
    long_ends = in_order.mapInArrow(hashed, "a long, b long, long_ends string").select(F.struct("a", "b").alias("key"), "long_ends")
    out = paths.withColumn("key", key.cast("struct<a:long,b:long>")).join(long_ends, "key", "left")
    return out.select("path", "chars", "n", "conv_id", F.coalesce("ends", "long_ends").alias("ends"))


def skeleton(borders: list[tuple[int, ...]]) -> tuple[dict, list[int]]:
    """(trie, parents): the trie of the border paths as nested ``{turn: (number, trie)}``, root 0 left out, and the
    number of each node's parent."""
    root: dict = {}
    parents = [-1]
    for path in borders:
        here, at = root, 0
        for k in range(0, len(path), 2):
            turn = path[k : k + 2]
            if turn not in here:
                here[turn] = (len(parents), {})
                parents.append(at)
            at, here = here[turn]
    return root, parents


class Open:
    """A node whose subtree is still being read: what is known of it so far, and finished children, which wait for
    its least member."""

    __slots__ = ("n", "conv", "children", "leaves", "saved", "ends", "chars", "number", "below", "waiting")

    def __init__(self, chars: int, number: int | None, below: dict | None):
        self.n, self.conv, self.children, self.leaves, self.saved = 0, None, 0, 0, 0
        self.ends, self.chars, self.number, self.below, self.waiting = None, chars, number, below, []


class Shard:
    """Reads the distinct paths of a shard in ascending order and gives rows for all nodes that end in it: finished
    ones, and partial ones of the skeleton (``skeleton`` holds their number). Holds the open path and what waits on
    it, never more than the shard's nodes."""

    def __init__(self, trie: dict):
        self.stack, self.path, self.trie, self.rows = [Open(0, 0, trie)], (), trie, []

    def close(self) -> None:
        node, depth = self.stack.pop(), len(self.stack)
        up = self.stack[-1] if self.stack else None
        if node.number is None:
            node.leaves, node.saved = node.leaves or 1, node.saved + (node.n - 1) * node.chars
            self.rows += [(r[0], r[1], node.conv, *r[2:], None, None, None) for r in node.waiting]
            own = (node.conv, depth, node.n, node.children, node.leaves, node.saved, node.ends)
            if up.number is None:
                up.waiting.append(own)
            else:
                self.rows.append((own[0], depth, None, *own[2:], None, up.number, None))
            up.children += 1
        else:
            self.rows.append((node.conv, depth, None, node.n, node.children, node.leaves, node.saved, node.ends, node.number, None, node.chars))
        if up:
            up.n, up.leaves, up.saved = up.n + node.n, up.leaves + node.leaves, up.saved + node.saved
            up.conv = node.conv if up.conv is None else min(up.conv, node.conv)

    def add(self, path: tuple[int, ...], chars: list[int], n: int, conv: int, ends: str) -> None:
        same = 0
        while same < len(self.path) and self.path[same : same + 2] == path[same : same + 2]:
            same += 2
        while len(self.stack) > same // 2 + 1:
            self.close()
        for k in range(same, len(path), 2):
            below = self.stack[-1].below
            number, below = below.get(path[k : k + 2], (None, None)) if below else (None, None)
            self.stack.append(Open(chars[k // 2], number, below))
        top, self.path = self.stack[-1], path
        top.n, top.ends = top.n + n, ends
        top.conv = conv if top.conv is None else min(top.conv, conv)

    def end(self) -> list[tuple]:
        while self.stack:
            self.close()
        out, self.rows, self.stack, self.path = self.rows, [], [Open(0, 0, self.trie)], ()
        return out


def combined(partial: DataFrame, parents: list[int]) -> list[tuple]:
    """The skeleton's nodes from the sums of their parts: what their own skeleton children add is one pass from the
    last node to the root (children are numbered after their parents)."""
    sums = partial.groupBy("skeleton").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), *(F.sum(c).alias(c) for c in _NUMBERS[3:]),
        F.max("ends_sha256").alias("ends"), F.max("last_chars").alias("chars"),
    )
    nodes = {r["skeleton"]: r.asDict() for r in sums.collect()}
    for k in sorted(nodes, reverse=True):
        nodes[k] |= {"more_leaves": nodes[k].get("more_leaves", 0), "more_saved": nodes[k].get("more_saved", 0)}
        own = nodes[k]
        own["more_leaves"] += own["n_children"] == 0
        own["more_saved"] += (own["n_convs"] - 1) * own["chars"]
        if k:
            up = nodes[parents[k]]
            up["n_children"] += 1
            up["more_leaves"] = up.get("more_leaves", 0) + own["more_leaves"]
            up["more_saved"] = up.get("more_saved", 0) + own["more_saved"]
    return [
        (v["conv_id"], v["depth"], nodes[parents[k]]["conv_id"] if k else None, v["n_convs"], v["n_children"], v["n_leaves"] + v["more_leaves"], v["saved_tokens"] + v["more_saved"], v["ends"], k)
        for k, v in nodes.items()
    ]


def borders_of(paths: DataFrame, shards: int) -> list[tuple[int, ...]]:
    """Paths that cut all of them into ``shards`` ranges: quantiles of a sample drawn by hash, of ``SAMPLE_TURNS``
    turns expected. They decide how even the shards are, never what comes out."""
    n, mean = paths.agg(F.count("*"), F.avg(F.size("chars"))).first()
    wanted = max(2 * shards, min(20 * shards, int(SAMPLE_TURNS // max(1.0, mean or 0))))
    draw = F.pmod(F.xxhash64(F.lit(7), "path"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, wanted / max(1, n)))
    drawn = sorted(tuple(r[0]) for r in paths.filter(draw).select("path").collect())
    return sorted({drawn[len(drawn) * k // shards] for k in range(1, shards)}) if drawn else []


def trie_nodes(conversations: DataFrame, shards: int | None = None) -> DataFrame:
    """All nodes of the trie of ``conversations`` (``conv_id``, ``turns``: array of structs ``hi, lo, chars``), one row
    a node: ``conv_id`` (least member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256``, all counts long.

    A node is a distinct beginning of conversations, from the root (depth 0, no parent) on; its members are the
    conversations that begin so. ``n_leaves`` counts the childless nodes of its subtree, itself included,
    ``saved_tokens`` adds up (members - 1) times the code points of its last text over that subtree, and ``ends_sha256`` is the
    hash of the ids, ascending and joined by commas, of the conversations that end at it (none: of "").

    Equal conversations are one path before anything is sorted, so a group of copies is one row. Paths go to the
    range between two border paths that they lie in; a node that is no beginning of a border has all its members in
    one shard, which finishes it. Nodes of the skeleton, at most the turns of the borders, get their sums from the shards by reduction.
    ``shards``: by default the session's shuffle partitions, or one for each 200,000 paths if that is more.

    Conversations without turns: members of the root that end there. Empty table: no node. Repeated ``conv_id``:
    counted as often as it is there.
    """
    spark = conversations.sparkSession
    flat = F.flatten(F.transform("turns", lambda t: F.array(t["hi"], t["lo"])))
    members = conversations.select("conv_id", flat.alias("path"), F.transform("turns", lambda t: t["chars"]).alias("chars"))
    paths = written(ends_of(members), "trie-paths")
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), paths.count() // 200_000)
    borders = borders_of(paths, shards)
    trie, parents = skeleton(borders)
    none = hashlib.sha256(b"").hexdigest()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = [bisect_right(borders, tuple(p)) for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of, pa.int32())], [*batch.schema.names, "shard"])

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, now = Shard(trie), None
        for batch in batches:
            for path, chars, n, conv, ends, s in zip(*(batch.column(c).to_pylist() for c in ("path", "chars", "n", "conv_id", "ends", "shard"))):
                if now is not None and s != now:
                    yield as_batch(shard.end())
                now = s
                shard.add(tuple(path), chars, n, conv, ends)
            if shard.rows:
                yield as_batch(shard.rows)
                shard.rows = []
        if now is not None:
            yield as_batch(shard.end())

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        fields = [(f.split(" ")[0], {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}[f.split(" ")[1]]) for f in _SHARD_ROW.split(", ")]
        columns = zip(*rows) if rows else [()] * len(fields)
        return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(columns, fields)], [f for f, _ in fields])

    dealt = paths.mapInArrow(placed, "path array<long>, chars array<long>, n long, conv_id long, ends string, shard int")
    dealt = dealt.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "path")
    rows = written(dealt.mapInArrow(finished, _SHARD_ROW), "trie-shards")
    top = combined(rows.filter("skeleton IS NOT NULL"), parents)
    columns = [*_NUMBERS, "ends_sha256"]
    tops = spark.createDataFrame(top, ", ".join(f"{c} long" for c in _NUMBERS) + ", ends_sha256 string, skeleton int")
    over = F.broadcast(tops.select(F.col("skeleton").alias("parent_skeleton"), F.col("conv_id").alias("top_conv_id")))
    below = rows.filter("skeleton IS NULL").join(over, "parent_skeleton", "left")
    below = below.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "top_conv_id"))
    out = below.select(*columns).unionByName(tops.select(*columns))
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(none)))


def prefix_trie(turns: DataFrame, shards: int | None = None) -> DataFrame:
    """:func:`trie_nodes` of rows ``(conv_id, turn, role, text)``; texts are read once and never shuffled.

    Null role or text: empty. Null turn: before all others. Ties in ``turn``: by role, the text's first 64 characters, then its hash. Repeated rows: a turn each. Rows
    without conv_id: left out. Other columns: ignored. Empty table: no node. Very long texts cost their hash only.
    """
    return trie_nodes(gathered(turn_keys(turns)), shards)


def crc(value: Column) -> Column:
    return F.crc32(value.cast("string").cast("binary"))


def regrown(conversations: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """Conversations (``conv_id``, ``turns``) whose first h turns are those of the conversation ``conv_id - conv_id %
    every`` as it was, h = crc32(conv_id as text) % ``heads``; none where that conversation is absent."""
    base = F.col("conv_id") - F.col("conv_id") % every
    first = conversations.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    h = (crc(F.col("conv_id")) % heads).cast("int")
    own = conversations.select("conv_id", base.alias("base"), h.alias("h"), "turns")
    # Most turns are a conversation's own; only the few first ones travel.
    joined = own.join(first, "base", "left")
    head = F.coalesce(F.slice("head", 1, F.col("h")), F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return joined.select("conv_id", F.concat(head, rest).alias("turns"))


__all__ = ["prefix_trie", "trie_nodes", "turn_keys", "gathered", "regrown"]
