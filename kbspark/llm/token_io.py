"""Token-id output: fixed-size id blocks, bit- or byte-plane shuffled, each plane compressed, with an index.

A shard file is::

    b"KBTOKEN1"
    chunk 0 | chunk 1 | ...            each chunk: its planes, one zstandard frame a plane
    footer: zstandard frame of JSON    {"planes", "block", "chunks": [[offset, ids, [plane sizes]]...],
                                        "docs": [[doc_id, n_tokens]...]}
    footer size, 8 bytes little-endian | b"KBTOKEN1"

Every chunk but the last holds ``block`` ids, so the chunk of the k-th id of a shard is ``k // block``, and a
range of ids is read from its chunks alone. A plane gathers the same bit (or byte) of all ids of a block: the
high planes of a 50,000-word vocabulary are all zero and vanish, the others are skewed and compress. Byte planes
are the default: on the test documents they take 1.30 bytes an id against 1.50 for bit planes, in less time.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.llm.shared import file_system, parent_made, small_batches, written
from kbspark.llm.tokens import encoder, in_pieces

MAGIC = b"KBTOKEN1"
MANIFEST = "shard int, part int, file string, n_docs long, n_tokens long, first_doc long, last_doc long"


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids: 4 byte planes, or 32 bit planes of ceil(n / 8) bytes.

    A plane of zeros is stored as nothing.
    """
    by_byte = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4).T
    if kind == "byte":
        return [p.tobytes() if p.any() else b"" for p in by_byte]
    if kind != "bit":
        raise ValueError(f"planes must be 'bit' or 'byte', not {kind!r}")
    bits = [(p >> b) & 1 if p.any() else None for p in by_byte for b in range(8)]
    return [b"" if b is None or not b.any() else np.packbits(b).tobytes() for b in bits]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The ids of a block from its planes (4: bytes, 32: bits)."""
    out = np.zeros((n, 4), np.uint8)
    for k, p in enumerate(planes):
        if p and len(planes) == 4:
            out[:, k] = np.frombuffer(p, np.uint8)
        elif p:
            out[:, k // 8] |= np.unpackbits(np.frombuffer(p, np.uint8), count=n) << (k % 8)
    return out.reshape(-1).view("<u4")


class ShardWriter:
    """Writes one shard file chunk by chunk under a name of its own; holds one block of ids at a time."""

    def __init__(self, folder: str, shard: int, part: int, block: int, planes: str):
        import zstandard

        self.name = f"tokens-{shard:06d}-{part:04d}-{uuid.uuid4().hex}.kbt"
        system, path = file_system(folder)
        parent_made(system, f"{path}/{self.name}")
        self.out = system.open_output_stream(f"{path}/{self.name}")
        self.out.write(MAGIC)
        self.pack = zstandard.ZstdCompressor(level=3).compress
        self.block, self.planes, self.at, self.waiting, self.held = block, planes, len(MAGIC), [], 0
        self.chunks: list = []
        self.docs: list = []
        self.tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append([doc_id, len(ids) // 4])
        self.waiting.append(ids)
        self.held += len(ids)
        self.tokens += len(ids) // 4
        if self.held >= 4 * self.block:
            data = b"".join(self.waiting)
            whole = len(data) // (4 * self.block) * 4 * self.block
            for k in range(0, whole, 4 * self.block):
                self._chunk(data[k : k + 4 * self.block])
            self.waiting, self.held = [data[whole:]], len(data) - whole

    def _chunk(self, data: bytes) -> None:
        packed = [self.pack(p) if p else p for p in to_planes(np.frombuffer(data, "<u4"), self.planes)]
        self.chunks.append([self.at, len(data) // 4, [len(p) for p in packed]])
        for p in packed:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> tuple:
        if self.held:
            self._chunk(b"".join(self.waiting))
        footer = self.pack(json.dumps({"planes": self.planes, "block": self.block, "chunks": self.chunks, "docs": self.docs}).encode())
        self.out.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
        self.out.close()
        ids = [d[0] for d in self.docs]
        return self.name, len(ids), self.tokens, ids[0], ids[-1]


class ShardReader:
    """Reads a shard file through its index; holds one chunk at a time."""

    def __init__(self, folder: str, name: str):
        import zstandard

        system, path = file_system(folder)
        self.file = system.open_input_file(f"{path}/{name}")
        self.unpack = zstandard.ZstdDecompressor().decompress
        size = self.file.size()
        length, magic = struct.unpack("<Q8s", self.file.read_at(16, size - 16))
        if magic != MAGIC:
            raise ValueError(f"{name} has no {MAGIC.decode()} footer")
        self.index = json.loads(self.unpack(self.file.read_at(length, size - 16 - length)))

    def chunk(self, k: int) -> np.ndarray:
        offset, n, sizes = self.index["chunks"][k]
        data, planes, at = self.file.read_at(sum(sizes), offset), [], 0
        for s in sizes:
            planes.append(self.unpack(data[at : at + s]) if s else b"")
            at += s
        return from_planes(planes, n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the shard, from the chunks that hold them."""
        b = self.index["block"]
        parts = [self.chunk(k)[max(0, start - k * b) : stop - k * b] for k in range(start // b, -(-stop // b))]
        return np.concatenate(parts) if parts else np.empty(0, "<u4")

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc_id, first id in the shard, ids, their crc32), chunk after chunk."""
        k, data, used, start = -1, b"", 0, 0
        for doc_id, n in self.index["docs"]:
            crc, left = 0, 4 * n
            while left:
                if used == len(data):
                    k, used = k + 1, 0
                    data = self.chunk(k).tobytes()
                take = min(left, len(data) - used)
                crc = zlib.crc32(memoryview(data)[used : used + take], crc)
                used, left = used + take, left - take
            yield doc_id, start, n, crc
            start += n


def write_tokens(
    docs: DataFrame,
    folder: str,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int | None = 2,
    block: int = 65_536,
    planes: str = "byte",
    shard_tokens: int = 64_000_000,
    shard_docs: int = 500_000,
) -> DataFrame:
    """Encode ``docs`` into shard files in ``folder``, ids in ascending order of ``id_col``, and return the
    manifest: one row a shard with ``base``, the ids of all shards before it.

    Rows are dealt by ranges of (id, text hash), so equal ids may be split too; each task sorts its range
    and writes files of about ``shard_tokens`` ids and ``shard_docs`` documents at most, which bounds the index that a
    reader holds. ``base`` is a window over the manifest alone, one row a file. A file has a name that no other attempt uses, and only
    those that the written manifest names belong to the result: a task that is lost or run twice leaves an
    orphan, never a wrong or doubled shard.

    The ids of a text are those that the tokenizers library gives it, strings of special tokens included.
    Null text: encoded as empty, so only the end id (nothing where ``end_id`` is None). Null ids come first.
    Repeated rows: all written. Very long texts: split over chunks. Empty table: no shard.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    keys = ["doc_id", F.xxhash64("text")]
    dealt = slim.repartitionByRange(*keys).sortWithinPartitions(*keys)
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, writer, part, rows = TaskContext.get().partitionId(), None, 0, []
        encode = encoder(vocabulary).encode
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = batch.column("text").to_pylist()
            for a, b in in_pieces(texts):
                for doc_id, data in zip(ids[a:b], encode(texts[a:b])):
                    writer = writer or ShardWriter(folder, shard, part, block, planes)
                    writer.add(doc_id, data + end)
                    if writer.tokens >= shard_tokens or len(writer.docs) >= shard_docs:
                        rows.append((shard, part, *writer.close()))
                        writer, part = None, part + 1
        if writer:
            rows.append((shard, part, *writer.close()))
        names = [f.split(" ")[0] for f in MANIFEST.split(", ")]
        types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names)

    manifest = written(dealt.mapInArrow(write, MANIFEST), "token-manifest")
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, read from the shard files of a manifest.

    One task a shard at most, one chunk of ids in memory at a time.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                got = list(ShardReader(folder, row["file"]).documents())
                for a in range(0, len(got), 50_000):
                    ids, starts, ns, crcs = zip(*got[a : a + 50_000])
                    yield pa.record_batch(
                        [pa.array(ids, pa.int64()), pa.array([row["base"] + s for s in starts], pa.int64()), pa.array(ns, pa.int64()), pa.array(crcs, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    shards = max(1, manifest.count())
    return manifest.select("file", "base").repartition(shards).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


__all__ = ["write_tokens", "read_documents", "ShardReader", "ShardWriter", "to_planes", "from_planes"]
