"""BPE ids of whole texts with shared stretches encoded once: a rolling hash cuts texts where their content says so,
chunks that occur again are encoded in one place, and joins are repaired from white space to white space."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.decontam import Sieve, build_sieve
from kbspark.llm.shared import WORKER_CACHES, lean, small_batches, split_join, written
from kbspark.llm.tokens import Table, gathered, joined

#: Bytes that the rolling hash looks at, and the mean distance of two cuts.
WINDOW, MEAN = 32, 512
#: Shorter chunks (without the words at their ends) are encoded where they are.
LEAST = 64
#: Distinct words, and keys of chunks already sent, that a worker remembers.
CACHE_WORDS, CACHE_CHUNKS = 400_000, 200_000
_MULTIPLIER = np.uint32(0x9E3779B1)
#: Letters (lower-cased) whose class and normal form no Unicode version changes; what else a plain word may hold; its pre-tokens.
_LETTERS = "a-zà-öø-ÿ"
_PLAIN = re.compile(rf"[!-~{_LETTERS}]*")
_PRETOKENS = re.compile(rf" ?(?:'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+)")
_SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
with np.errstate(over="ignore"):
    _VALUES = (np.arange(256, dtype=np.uint32) + np.uint32(1)) * _MULTIPLIER
    _VALUES ^= _VALUES >> np.uint32(15)
_PIECE = "row long, piece int, id {id}, ids array<int>, h1 long, h2 long, chunk binary"


class WordEncoder:
    """Texts to the ids that the tokenizers library gives them (``add_special_tokens=False``), for a vocabulary whose
    pre-tokens hold no white space: the ids of a text are those of its words in a row, special strings included.

    Distinct words of a batch are looked up in a bounded table. Of new plain ones, lower-cased, only pre-tokens not met
    before go to the library's model; others, and any with a part of a special string, go to the library as they are.
    A vocabulary file with another normal form or other pre-tokens is used by whole words alone.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words, self.pretokens = Table(cache_words), Table(cache_words)
        self.marks = {t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()}
        signs = ByteLevel(add_prefix_space=False, use_regex=False)
        chars = [c for k in range(33, 256) if _PLAIN.fullmatch(c := chr(k))]
        self.bytes_of = {ord(c): signs.pre_tokenize_str(c)[0][0] for c in chars}
        probe = "a b\tc\nd\x0be\x0cf\rg"
        if self._raw([probe])[0].tolist() != self._raw(probe.split())[0].tolist():
            raise ValueError(f"white space is part of the tokens of {path}")
        # A probe with every plain character, alone and between others, tells whether the pre-tokens are those known here.
        probes = ["".join(p) for c in chars for p in ((c,), ("a", c, "z"), ("1", c, "."), ("'", c), ("É", c))] + ["it's", "we'RE'll", "x''d12"]
        self.known = True
        self.known = self._raw(probes)[0].tolist() == self._encoded(probes)[0].tolist()

    def _raw(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return joined([e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

    def _pretokens(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        tokenize, bytes_of = self.tokenizer.model.tokenize, self.bytes_of
        return joined([[t.id for t in tokenize(p if p.isascii() else p.translate(bytes_of))] for p in some])

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many for each) of words."""
        if not self.known:
            return self._raw(words)
        low = [w.lower() for w in words]
        plain = np.array([_PLAIN.fullmatch(w) is not None and not any(m in w for m in self.marks) and w != "" for w in low], bool)
        found = pa.array(_PRETOKENS.findall("".join([" " + w for w, p in zip(low, plain) if p])), pa.string()).dictionary_encode()
        first = pc.starts_with(found.dictionary, " ").to_numpy(zero_copy_only=False)[found.indices.to_numpy()]
        bare = pc.ascii_ltrim_whitespace(found.dictionary).dictionary_encode()
        rows = self.pretokens.rows_of(bare.dictionary, self._pretokens)[bare.indices.to_numpy()][found.indices.to_numpy()]
        ids = gathered(rows, self.pretokens.ids, self.pretokens.sizes)
        sizes = np.add.reduceat(self.pretokens.sizes[rows], np.flatnonzero(first)) if len(rows) else np.empty(0, np.int64)
        if plain.all():
            return ids, sizes
        other, counts = self._raw([w for w, p in zip(words, plain) if not p])
        at = np.empty(len(words), np.int64)
        at[plain], at[~plain] = np.arange(len(sizes)), len(sizes) + np.arange(len(counts))
        sizes = np.concatenate([sizes, counts])
        return gathered(at, np.concatenate([ids, other]), sizes), sizes[at]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds of each text in them)."""
        lists = pc.ascii_split_whitespace(texts)
        bounds = lists.offsets.to_numpy().astype(np.int64)
        found = lists.flatten().dictionary_encode()
        rows = self.words.rows_of(found.dictionary, self._encoded)[found.indices.to_numpy()]
        ends = np.concatenate([[0], np.cumsum(self.words.sizes[rows])])
        return gathered(rows, self.words.ids, self.words.sizes), ends[bounds - bounds[0]]


def word_encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker for a vocabulary file."""
    if ("words", path) not in WORKER_CACHES:
        WORKER_CACHES["words", path] = WordEncoder(path)
    return WORKER_CACHES["words", path]


def rolling(data: np.ndarray, block: int = 1 << 17) -> np.ndarray:
    """A hash (uint32) of the ``WINDOW`` bytes that end at each place; the first ``WINDOW - 1`` are of fewer. Blocks fit
    the processor's cache."""
    out = np.empty(len(data), np.uint32)
    for a in range(0, len(data), block):
        before = min(a, WINDOW - 1)
        out[a : a + block] = _rolled(data[a - before : a + block])[before:]
    return out


def _rolled(data: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = _VALUES[data]
        factor, width = _MULTIPLIER, 1
        while width < WINDOW:
            h[width:] += h[:-width] * factor
            factor, width = factor * factor, 2 * width
    return h


def cores(data: np.ndarray, bounds: np.ndarray, mean: int = MEAN, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the chunks of texts (bytes one after the other, ``bounds`` between them), each without the
    part before its first and after its last ASCII white space, where a cut may have split a word.

    A cut is a place whose rolling hash falls below a bound and whose ``WINDOW`` bytes all are of one text; of cuts
    less than ``WINDOW`` apart only the first stays, so a run of one letter isn't cut everywhere. Equal stretches are
    cut equally wherever they stand, but for their first ``WINDOW`` bytes.
    """
    hits = np.flatnonzero(rolling(data) < np.uint32(2**32 // mean)) + 1
    text = np.searchsorted(bounds, hits, "right") - 1
    hits = hits[hits - bounds[np.minimum(text, len(bounds) - 2)] >= WINDOW] if len(bounds) > 1 else hits[:0]
    hits = hits[np.diff(hits, prepend=-WINDOW) >= WINDOW]
    cuts = np.unique(np.concatenate([bounds, hits]))
    spaces = np.flatnonzero(_SPACES[data])
    left, right = cuts[:-1], cuts[1:]
    # A text's own ends are as good as white space.
    after = np.append(spaces, len(data))[np.searchsorted(spaces, left)] + 1
    before = np.append(-1, spaces)[np.searchsorted(spaces, right)]
    whole = np.isin(cuts, bounds)
    starts = np.where(whole[:-1], left, after)
    ends = np.where(whole[1:], right, before)
    fits = ends - starts >= least
    return starts[fits], ends[fits]


def keys_of(data: memoryview, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 128-bit hash of each stretch, as rows of two int64."""
    from xxhash import xxh3_128_digest

    return np.frombuffer(b"".join([xxh3_128_digest(data[a:z]) for a, z in zip(starts.tolist(), ends.tolist())]), np.int64).reshape(-1, 2)


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, bounds) of a string column without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces_of(texts: pa.Array, limit: int = 3_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text, to bound what is held."""
    yield from ranges_of(buffer_of(texts)[1], limit)


def ranges_of(bounds: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` items, of rows with ``bounds`` between them."""
    start = 0
    while start < len(bounds) - 1:
        stop = max(start + 1, int(np.searchsorted(bounds, int(bounds[start]) + limit, "left")))
        yield start, min(stop, len(bounds) - 1)
        start = stop


def shared_keys(docs: DataFrame) -> DataFrame:
    """``(h1, h2, n)`` of the chunks that occur twice or more in all texts."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, z in pieces_of(texts):
                data, bounds = buffer_of(texts.slice(a, z - a))
                k = keys_of(memoryview(data), *cores(data, bounds))
                yield pa.record_batch([pa.array(k[:, 0]), pa.array(k[:, 1])], ["h1", "h2"])

    return docs.select("text").mapInArrow(lean(keys), "h1 long, h2 long").groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1")


def known_chunks(texts: pa.Array, sieve: Sieve) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, keys) of the chunks that the sieve knows."""
    data, bounds = buffer_of(texts)
    starts, ends = cores(data, bounds)
    keys = keys_of(memoryview(data), starts, ends)
    known = sieve.holds(np.ascontiguousarray(keys[:, 0]))
    return np.searchsorted(bounds, starts[known], "right") - 1, starts[known], ends[known], keys[known]


def lists_of(ids: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))


def tokens_of(tokenizer, vocabulary: str) -> pa.Array:
    """The token of each id."""
    if tokenizer.decoder is not None:
        raise ValueError(f"{vocabulary} has a decoder of its own")
    return pa.array([tokenizer.id_to_token(k) for k in range(tokenizer.get_vocab_size())], pa.string())


def decoded_texts(ids: pa.ListArray, tokens: pa.Array) -> pa.Array:
    """The tokens of each list, joined by a space; null for null."""
    at = ids.offsets.to_numpy()
    found = tokens.take(ids.values.slice(at[0], at[-1] - at[0]))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(at - at[0]), found, mask=ids.is_null() if ids.null_count else None), " ")


def whole_texts(docs: DataFrame, vocabulary: str, sieve: Sieve, id_type: str, decoded: bool = False) -> DataFrame:
    """``(id, ids)`` of the rows (id, text) without a chunk that the sieve knows; with ``decoded``, also what
    :func:`decode` gives for them."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(vocabulary)
        tokens = tokens_of(encoder.tokenizer, vocabulary) if decoded else None
        for batch in batches:
            column = batch.column("text")
            for a, z in pieces_of(column):
                texts, own = column.slice(a, z - a), np.ones(z - a, bool)
                own[known_chunks(texts, sieve)[0]] = False
                own = pa.array(own)
                ids = lists_of(*encoder.encode(texts.filter(own)))
                more = {"decoded": decoded_texts(ids, tokens)} if decoded else {}
                yield pa.RecordBatch.from_pydict({"id": batch.column("id").slice(a, z - a).filter(own), "ids": ids, **more})

    return docs.mapInArrow(lean(encoded), f"id {id_type}, ids array<int>" + ", decoded string" * decoded)


def text_pieces(docs: DataFrame, vocabulary: str, sieve: Sieve, id_type: str) -> DataFrame:
    """The rows of ``docs`` (id, text) that hold a chunk the sieve knows, as pieces: ids of what is encoded where it
    stands, from the last white space of the chunk before it to the first of the next, and keys of those chunks.
    ``row`` numbers rows over all tasks. Each task adds a row with the text of a chunk the first time that it meets it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sent, row = word_encoder(vocabulary), set(), TaskContext.get().partitionId() << 40
        for batch in batches:
            column = batch.column("text")
            for a, z in pieces_of(column):
                texts = column.slice(a, z - a)
                some = pa.array(np.unique(known_chunks(texts, sieve)[0]))
                if len(some):
                    yield from pieces(encoder, texts.take(some), batch.column("id").slice(a, z - a).take(some), row, sent)
                row += len(some)

    def pieces(encoder: WordEncoder, texts: pa.Array, ids: pa.Array, first: int, sent: set) -> Iterator[pa.RecordBatch]:
        data, bounds = buffer_of(texts)
        where, starts, ends, keys = known_chunks(texts, sieve)
        # Own stretches: from a text's start or a chunk's end to the next chunk's start or the text's end.
        of = np.concatenate([np.arange(len(texts)), where])
        own = np.concatenate([bounds[:-1], ends])
        order = np.lexsort((own, np.arange(len(own)) >= len(texts), of))
        own, of = own[order], of[order]
        chunk = np.concatenate([np.full(len(texts), -1), np.arange(len(starts))])[order]
        nexts = np.append(chunk[1:], -1)
        stops = np.where(nexts >= 0, np.append(starts, 0)[nexts], bounds[of + 1])
        offsets = np.stack([own, stops], 1).reshape(-1).astype(np.int32)
        offsets = np.append(offsets, offsets[-1])
        stretches = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data))
        encoded, at = encoder.encode(stretches.take(pa.array(np.arange(0, 2 * len(own), 2))))
        # Pieces in order: before each own stretch but a text's first comes the chunk that ends there.
        n = 1 + (chunk >= 0)
        place = np.cumsum(n) - n
        total = int(n.sum())
        is_own = np.zeros(total, bool)
        is_own[place + n - 1] = True
        text = np.repeat(of, n)
        new = np.flatnonzero(np.diff(text, prepend=-1))
        number = np.arange(total) - np.repeat(new, np.diff(np.append(new, total)))
        sizes = np.zeros(total, np.int64)
        sizes[is_own] = np.diff(at)
        lists = lists_of(encoded, np.concatenate([[0], np.cumsum(sizes)]))
        key = np.zeros((total, 2), np.int64)
        key[~is_own] = keys[chunk[chunk >= 0]]
        columns = [pa.array(first + text), pa.array(number.astype(np.int32)), ids.take(pa.array(text))]
        columns += [pc.if_else(pa.array(is_own), lists, pa.scalar(None, lists.type)), pa.array(key[:, 0], mask=is_own), pa.array(key[:, 1], mask=is_own)]
        names = ["row", "piece", "id", "ids", "h1", "h2", "chunk"]
        yield pa.record_batch([*columns, pa.nulls(total, pa.binary())], names)
        texts_of = {}
        for k, (h, s, e) in enumerate(zip(map(tuple, keys.tolist()), starts.tolist(), ends.tolist())):
            if h not in sent:
                sent.add(h)
                texts_of[h] = data[s:e].tobytes()
        if len(sent) > CACHE_CHUNKS:
            sent.clear()
        if texts_of:
            m = len(texts_of)
            h = np.array(list(texts_of), np.int64)
            gone = [pa.nulls(m, t) for t in (pa.int64(), pa.int32(), ids.type, lists.type)]
            yield pa.record_batch([*gone, pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(list(texts_of.values()), pa.binary())], names)

    return docs.mapInArrow(lean(cut), _PIECE.format(id=id_type))


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids)``: for each row the ids (array<int>) that the tokenizers library gives its whole text with
    ``add_special_tokens=False`` and a vocabulary file whose tokens hold no white space.

    1. Texts are cut by a rolling hash and the 128-bit hashes of their chunks counted (16 bytes a chunk travel).
    2. Those that occur twice or more are set in a sieve of 16 MB at most. Texts without a chunk that it knows are encoded
       where they are read. Of the others a task sends each such chunk once, and encodes what lies between them.
       What the sieve lets through by mistake is treated as shared, which is as right; a full one makes all chunks so.
    3. A shared chunk is encoded once, whatever the number of texts that hold it, and its ids meet the places by a join
       on its hash; hot ones go to all tasks by broadcast.

    Where two pieces meet, the text from the last white space before to the first behind is encoded anew: there both
    sides agree with the whole text for certain, since no token, normal form or special string reaches over white
    space. A chunk without white space inside is part of the next such stretch.

    Null text: as empty. Empty text: no ids. Null or repeated ids, repeated rows: a result each. Very long texts: one row, held in
    one task. Empty table: no row. Other columns: ignored.
    """
    whole, again = _parts(docs, vocabulary, id_col, text_col)
    return whole.unionByName(again)


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids, decoded)``: what :func:`decode` gives for :func:`encode`, with one Python worker for each task of
    the result instead of two: texts that are encoded where they are read are decoded by the same step, and only those
    put together from pieces go to a step of their own."""
    whole, again = _parts(docs, vocabulary, id_col, text_col, decoded=True)
    return whole.unionByName(decode(again, vocabulary))


def _parts(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, decoded: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(id_col, ids)`` of the texts encoded where they are read (with ``decoded`` also that) and of those put together."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keys = written(shared_keys(slim), "codec-keys")
    sieve = build_sieve(keys, "h1", keys.count())
    id_type = dict(docs.dtypes)[id_col]
    pieces = written(text_pieces(slim, vocabulary, sieve, id_type), "codec-pieces")
    whole = whole_texts(slim, vocabulary, sieve, id_type, decoded).withColumnRenamed("id", id_col)
    open_rows = pieces.filter("row IS NOT NULL")
    places = open_rows.filter("h1 IS NOT NULL").select("row", "piece", "h1", "h2")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = lists_of(*word_encoder(vocabulary).encode(batch.column("chunk").cast(pa.string())))
            yield pa.record_batch([batch.column("h1"), batch.column("h2"), batch.column("n"), ids], ["h1", "h2", "n", "ids"])

    counted = pieces.filter("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.first("chunk", ignorenulls=True).alias("chunk"), F.count("row").alias("n"))
    of_chunk = written(counted.mapInArrow(lean(chunks), "h1 long, h2 long, n long, ids array<int>"), "codec-chunks")
    met = split_join(places, of_chunk, ["h1", "h2"], places.count(), floor=1000).select("row", "piece", "ids")
    own = open_rows.filter("h1 IS NULL")
    parts = own.select("row", "piece", "ids").unionByName(met)
    in_order = F.sort_array(F.collect_list(F.struct("piece", "ids")))
    again = parts.groupBy("row").agg(F.flatten(F.transform(in_order, lambda p: p["ids"])).alias("ids"))
    ids = own.filter("piece = 0").select("row", F.col("id").alias(id_col))
    return whole, again.join(ids, "row").select(id_col, "ids")


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids", limit: int = 1_000_000) -> DataFrame:
    """``encoded`` with ``decoded``: what the tokenizers library's ``decode(ids, skip_special_tokens=False)`` gives,
    for a vocabulary file without decoder (tokens joined by a space). Null ids: null. A task holds the tokens of about
    ``limit`` ids at a time."""
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokens = tokens_of(Tokenizer.from_file(vocabulary), vocabulary)
        for batch in batches:
            for a, z in ranges_of(batch.column(ids_col).offsets.to_numpy(), limit):
                part = batch.slice(a, z - a)
                yield pa.RecordBatch.from_arrays([*part.columns, decoded_texts(part.column(ids_col), tokens)], [*batch.schema.names, "decoded"])

    small_batches(encoded.sparkSession, 1000)
    return encoded.mapInArrow(lean(texts), ", ".join(f"`{c}` {t}" for c, t in encoded.dtypes) + ", decoded string")


__all__ = ["encode", "decode", "encode_decode", "WordEncoder", "cores", "rolling"]
