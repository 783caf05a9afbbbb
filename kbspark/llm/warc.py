"""WARC output: deterministic sharded archives, and reading them back.

Records are range-sorted by key, written as one gzip member each, and files are rolled by compressed size.
Ranges are exact quantiles of the payload bytes in order of key and digest. Headers and digests are made anew from the
payload, and nothing in a file depends on clock, host, attempt or partitions, so the same rows give the same bytes.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.llm.shared import file_system, lean, parent_made, small_batches, split_join, written

#: One fixed date for all records: the input has none, and a clock would make files differ by run.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, part int, file string, n_records long, n_bytes long, sha1 string, first_key long, last_key long"
CRLF = b"\r\n"
#: Compressed bytes that go to the decompressor at once; what lies behind a record's end is copied.
SLICE = 8192


def record_id(key: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'kbspark:page:{key}')}>"


def info_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'kbspark:file:{name}')}>"


def labelled_digest(hex_digest: str) -> str:
    """A hex SHA-1 as WARC writes it."""
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _clean(value: str) -> str:
    """A header value on one line: control characters become percent codes."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def _headers(first: str, fields: list[tuple[str, str]]) -> bytes:
    return "\r\n".join([first, *(f"{k}: {v}" for k, v in fields), "", ""]).encode()


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """One record, uncompressed. A revisit has the HTTP header but no payload."""
    http = _headers("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))])
    block = http + (payload if refers_to is None else b"")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(key)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _clean(url or "")),
        ("WARC-Payload-Digest", labelled_digest(digest)),
        ("WARC-Block-Digest", labelled_digest(hashlib.sha1(block).hexdigest())),
        ("X-Page-Id", "" if key is None else str(key)),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-Id", str(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _headers("WARC/1.1", fields) + block + CRLF + CRLF


def _member(data: bytes) -> bytes:
    """A gzip member without name or time."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class ArchiveWriter:
    """One archive, written under a temporary name and moved to its own when it is whole."""

    def __init__(self, folder: str, shard: int, part: int, run: str):
        self.attempt = uuid.uuid4().hex
        self.name = f"pages-{shard:06d}-{part:04d}"
        self.system, self.folder = file_system(folder)
        self.temporary = f"{self.folder}/_temporary-{run}/{self.name}-{self.attempt}"
        parent_made(self.system, self.temporary)
        self.out = self.system.open_output_stream(self.temporary)
        self.sha1, self.bytes, self.keys = hashlib.sha1(), 0, []
        self._put(_member(_headers("WARC/1.1", [
            ("WARC-Type", "warcinfo"), ("WARC-Record-ID", info_id(self.name)),
            ("WARC-Date", DATE), ("WARC-Filename", f"{self.name}.warc.gz"), ("Content-Type", "application/warc-fields"), ("Content-Length", "0"),
        ]) + CRLF + CRLF))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha1.update(data)
        self.bytes += len(data)

    def add(self, key: int | None, data: bytes) -> None:
        self._put(_member(data))
        self.keys.append(key)

    def close(self) -> tuple:
        """Moves the file to a name made of shard, part and content: attempts that wrote the same bytes meet in
        one file, and any other stays apart and out of the manifest."""
        self.out.close()
        digest = self.sha1.hexdigest()
        final = f"{self.name}-{digest[:16]}.warc.gz"
        self.system.move(self.temporary, f"{self.folder}/{final}")
        return final, len(self.keys), self.bytes, digest, self.keys[0], self.keys[-1]


def read_records(folder: str, name: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(WARC headers, block) of each record of an archive, one record in memory at a time."""
    system, path = file_system(folder)
    with system.open_input_stream(f"{path}/{name}", compression=None) as src:
        held, at = memoryview(b""), 0
        while True:
            z, parts = zlib.decompressobj(31), []
            while not z.eof:
                if at == len(held):
                    held, at = memoryview(src.read(1 << 20)), 0
                if not len(held):
                    if parts:
                        raise ValueError(f"{name} ends inside a record")
                    return
                some = held[at : at + SLICE]
                parts.append(z.decompress(some))
                at += len(some) - len(z.unused_data)
            head, _, body = b"".join(parts).partition(CRLF + CRLF)
            fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
            yield fields, body[: int(fields["Content-Length"])]


def revisits(slim: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """``(key, digest, refers)`` of the rows of ``slim`` (key, digest, bytes) whose payload of ``min_bytes`` bytes or more
    some row with a larger key has too: ``refers`` is the largest of those keys.

    Digests are grouped with a map-side combine and those that occur once are gone before the join.
    """
    some = slim.filter(F.col("bytes") >= min_bytes)
    groups = some.groupBy("digest").agg(F.count("*").alias("n"), F.max("key").alias("refers")).filter("n > 1")
    met = split_join(some.select("key", "digest"), groups, "digest", some.count())
    return met.filter(~F.col("key").eqNullSafe(F.col("refers"))).select("key", "digest", "refers").distinct()


def shard_starts(slim: DataFrame, shard_bytes: int) -> list[tuple]:
    """The least (key, digest) of each shard but the first, where ``shard_bytes`` more bytes are full, in order.

    Exact and the same however ``slim`` is partitioned: rows are sorted by ranges, each range's bytes are added up, and a
    row's place is that of its range plus that in it.
    """
    order = ("none", "key", "digest")  # rows without a key come first
    ranked = slim.withColumn("none", F.col("key").isNotNull()).repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    ranked = written(ranked, "warc-ranges")
    in_order = Window.partitionBy("range").orderBy(*order)
    sizes = ranked.groupBy("range").agg(F.sum("bytes").alias("size"))  # one row a partition
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    within = F.sum("bytes").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes")
    placed = ranked.withColumn("within", within).join(F.broadcast(offsets), "range")
    shard = F.floor((F.col("offset") + F.col("within")) / F.lit(shard_bytes))
    starts = placed.groupBy(shard.alias("shard")).agg(F.min(F.struct(*order)).alias("start")).orderBy("shard").collect()
    return [tuple(r.start) for r in starts[1:]]


def _shard_of(none: Column, key: Column, digest: Column, starts: list[tuple]) -> Column:
    """How many of ``starts`` a row has reached, by two short searches: of blocks of starts, then in the block."""
    if not starts:
        return F.lit(0)
    rows = F.array(*[F.struct(F.lit(n).alias("none"), F.lit(k).cast("long").alias("key"), F.lit(d).alias("digest")) for n, k, d in starts])
    width = max(1, round(len(starts) ** 0.5))
    own = F.struct(none.alias("none"), key.alias("key"), digest.alias("digest"))
    reached = lambda some: F.size(F.filter(some, lambda s: s <= own))
    block = reached(F.array(*[F.get(rows, F.lit(k)) for k in range(0, len(starts), width)])) - 1
    return F.when(block < 0, 0).otherwise(block * width + reached(F.slice(rows, F.greatest(block, F.lit(0)) * width + 1, width)))


def write_archives(
    pages: DataFrame,
    folder: str,
    key_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = 1000,
    roll_bytes: int = 256 * 1024 * 1024,
    shard_bytes: int | None = None,
) -> DataFrame:
    """Write ``pages`` as archives into ``folder`` and return the manifest, one row a file.

    Of rows with equal payloads of ``min_bytes`` bytes or more, that with the largest key is a response and
    the others revisit it; all else are responses. A file ends after the record that takes it past
    ``roll_bytes`` compressed bytes, and with its shard, which has about ``shard_bytes`` bytes of payload (by default 32 MB,
    or more where that made over 10,000 shards). Files are complete before they get their names, and only those in the
    written manifest count; temporary files of lost attempts are swept at the end.

    Null payload: empty. Null URL: empty header. Null keys come first and have an empty id header. Rows that
    repeat the largest key with the same payload are all responses. Empty table: no file, empty manifest.
    """
    small_batches(pages.sparkSession)
    run = uuid.uuid4().hex  # of this job alone: another one may write into the same folder
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    key, digest = F.col(key_col).cast("long"), F.sha1(F.encode(payload, "UTF-8"))
    slim = written(pages.select(key.alias("key"), digest.alias("digest"), F.octet_length(payload).cast("long").alias("bytes")), "warc-digests")
    total = slim.agg(F.sum("bytes")).first()[0] or 0
    starts = shard_starts(slim, shard_bytes or max(1 << 25, total // 10_000))
    rows = pages.select(
        key.alias("key"), digest.alias("digest"), F.lit(1).alias("kind"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"),
        F.lit(None).cast("long").alias("refers"),
    )
    # Notes of what a row revisits travel to its range on their own and sort just before it, so that payloads
    # are shuffled once.
    notes = revisits(slim, min_bytes).select(
        "key", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("payload"), "refers"
    )
    both = rows.unionByName(notes)
    both = both.withColumn("shard", _shard_of(F.col("key").isNotNull(), F.col("key"), F.col("digest"), starts).cast("int"))
    # A shard is in one task as a whole, whatever ranges of shards Spark takes.
    dealt = both.repartitionByRange(len(starts) + 1, "shard").sortWithinPartitions("shard", "key", "digest", "kind", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, writer, part, out, note = -1, None, 0, [], (None, None, None)

        def closed() -> None:
            if writer:
                out.append((shard, part, *writer.close()))

        for batch in batches:
            shards, keys, urls, texts, refers, digests, kinds = (batch.column(n) for n in ("shard", "key", "url", "payload", "refers", "digest", "kind"))
            for i in range(batch.num_rows):
                key = keys[i].as_py()
                if kinds[i].as_py() == 0:
                    note = (key, digests[i].as_py(), refers[i].as_py())
                    continue
                payload = texts[i].as_py().encode()
                digest = hashlib.sha1(payload).hexdigest()
                if digest != digests[i].as_py():
                    raise ValueError(f"payload of record {key} changed between its digest and its writing")
                if shards[i].as_py() != shard:
                    closed()
                    shard, writer, part = shards[i].as_py(), None, 0
                elif writer and writer.bytes >= roll_bytes:
                    closed()
                    writer, part = None, part + 1
                writer = writer or ArchiveWriter(folder, shard, part, run)
                refers_to = note[2] if note[:2] == (key, digest) else None
                writer.add(key, record(key, urls[i].as_py(), payload, refers_to, digest))
        closed()
        names = [f.split(" ")[0] for f in MANIFEST.split(", ")]
        types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(names), types)], names)

    manifest = written(dealt.mapInArrow(lean(write), MANIFEST), "warc-manifest")
    system, path = file_system(folder)
    left = f"{path}/_temporary-{run}"
    if system.get_file_info(left).type.name == "Directory":
        system.delete_dir(left)
    return manifest


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to, url)`` of every record in the archives
    of a manifest. A response's size and digest are computed from its payload, and a digest that differs from
    the header fails the read; a revisit's come from its headers."""

    def rows_of(name: str):
        for fields, block in read_records(folder, name):
            if fields["WARC-Type"] == "warcinfo":
                continue
            http, _, payload = block.partition(CRLF + CRLF)
            stated = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
            if fields["WARC-Type"] == "response":
                size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                if digest != stated:
                    raise ValueError(f"{name}: {fields['WARC-Record-ID']} has another payload than its digest says")
            else:
                size, digest = int(http.rpartition(b"Content-Length: ")[2]), stated
            key, refers = fields["X-Page-Id"], fields.get("X-Refers-To-Page-Id")
            yield int(key) if key else None, size, digest, fields["WARC-Type"], refers and int(refers), fields["WARC-Target-URI"]

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                held = []
                for row in rows_of(name):
                    held.append(row)
                    if len(held) == 20_000:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
                        held = []
                if held:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types)], names)

    files = max(1, manifest.count())
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    return manifest.select("file").repartition(files).mapInArrow(lean(read), schema)
