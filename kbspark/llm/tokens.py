"""Encoding texts with a public byte-level BPE vocabulary inside Spark tasks."""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from kbspark.llm.shared import WORKER_CACHES

#: A space before a character that is no white space always starts a new pre-token of byte-level BPE.
_CUT = re.compile(r" (?=\S)")
#: Texts with other spaces, for Arrow; its idea of white space is a superset of the tokenizer's.
_ODD = r" ([\s\v\x1c-\x1f\x85\p{Z}]|$)"
#: Letters whose class no Unicode version changes; what else a plain word may hold; and its pre-tokens.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_PLAIN = re.compile(rf"[\t\n\r!-~{_LETTERS}]*")
_PRETOKENS = re.compile(rf"'(?:[sdmt]|re|ve|ll)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
#: Distinct words that a worker remembers, and as many pre-tokens; about 60 bytes each.
CACHE_WORDS = 400_000


def encoder(path: str, cache_words: int = CACHE_WORDS) -> "Encoder":
    """The encoder of this Python worker for a vocabulary file; later tasks of the worker find its words."""
    if (path, cache_words) not in WORKER_CACHES:
        WORKER_CACHES[path, cache_words] = Encoder(path, cache_words)
    return WORKER_CACHES[path, cache_words]


class Table:
    """Ids of strings met before: a bounded column of strings, and their ids one after the other."""

    def __init__(self, limit: int):
        self.limit, self.keys = limit, pa.array([], pa.string())
        self.ids, self.sizes = np.empty(0, np.uint32), np.empty(0, np.int64)

    def rows_of(self, keys: pa.Array, encode) -> np.ndarray:
        """The row of each of some distinct strings. New ones are added with what ``encode`` (strings to all ids and
        the number of each) gives them; when the table is full, those that this call doesn't ask for go first."""
        rows = pc.index_in(keys, value_set=self.keys).fill_null(-1).to_numpy().astype(np.int64)
        missing = rows < 0
        new = keys.filter(pa.array(missing))
        if len(self.keys) + len(new) > self.limit:
            held = rows[~missing]
            self.ids, self.sizes = gathered(held, self.ids, self.sizes), self.sizes[held]
            self.keys, rows[~missing] = self.keys.take(pa.array(held)), np.arange(len(held))
        if len(new):
            ids, sizes = encode(new.to_pylist())
            rows[missing] = len(self.keys) + np.arange(len(new))
            self.keys = pa.concat_arrays([self.keys, new])
            self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        return rows


def gathered(rows: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ids of some rows of a table, one after the other."""
    starts, n = np.cumsum(sizes) - sizes, sizes[rows]
    ends = np.cumsum(n)
    return ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[rows] - ends + n, n)]


def joined(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum())), sizes


class Encoder:
    """Whole texts to the ids that the ``tokenizers`` library gives them with ``add_special_tokens=False``.

    Byte-level BPE never merges across a cut before a space that a non-space follows, so the ids of a text are
    those of its space-separated words in a row. The distinct words of a batch are looked up in a bounded table;
    of new ones only the pre-tokens not met before go to the library's model. The first word of a text, words with
    letters outside Latin and texts with the string of a special token go to the library as they are.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        signs = ByteLevel(add_prefix_space=False, use_regex=False)
        chars = [*map(chr, [9, 10, 13, *range(32, 127)]), *(chr(c) for c in range(0xC0, 0x250) if c not in (0xD7, 0xF7))]
        self.bytes_of = {ord(c): signs.pre_tokenize_str(c)[0][0] for c in chars}
        self.pretokens, self.words = Table(cache_words), Table(cache_words)

    def _raw(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return joined([e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

    def _pretokens(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        tokenize, bytes_of = self.tokenizer.model.tokenize, self.bytes_of
        return joined([[t.id for t in tokenize(p.translate(bytes_of))] for p in some])

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many for each) of words that follow a space."""
        plain = [_PLAIN.fullmatch(w) is not None for w in words]
        found = pa.array(_PRETOKENS.findall("".join([" " + w for w, p in zip(words, plain) if p])), pa.string()).dictionary_encode()
        rows = self.pretokens.rows_of(found.dictionary, self._pretokens)[found.indices.to_numpy()]
        first = pc.starts_with(found.dictionary, " ").to_numpy(zero_copy_only=False)[found.indices.to_numpy()]
        ids = gathered(rows, self.pretokens.ids, self.pretokens.sizes)
        sizes = np.add.reduceat(self.pretokens.sizes[rows], np.flatnonzero(first)) if len(rows) else np.empty(0, np.int64)
        if all(plain):
            return ids, sizes
        other, counts = self._raw([" " + w for w, p in zip(words, plain) if not p])
        at, plain = np.empty(len(words), np.int64), np.array(plain)
        at[plain], at[~plain] = np.arange(len(sizes)), len(sizes) + np.arange(len(counts))
        sizes = np.concatenate([sizes, counts])
        return gathered(at, np.concatenate([ids, other]), sizes), sizes[at]

    def _words(self, texts: list[str]) -> pa.ListArray:
        """Each text as its first word and those behind a space; whole where a special token's string is in it."""
        whole = {k for s in self.special for k, t in enumerate(texts) if s in t}
        column = pa.array(texts, pa.string())
        odd = whole.union(np.flatnonzero(pc.match_substring_regex(column, _ODD).to_numpy(zero_copy_only=False)).tolist())
        lists = pc.split_pattern(column, " ")
        if not odd:
            return lists
        own = pa.array([[texts[k]] if k in whole else _CUT.split(texts[k]) for k in sorted(odd)], lists.type)
        order = np.arange(len(texts))
        order[sorted(odd)] = len(texts) + np.arange(len(odd))
        return pa.concat_arrays([lists, own]).take(pa.array(order))

    def _placed(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row of each word of all texts, bounds of each text in them, ids of the first words' rows, which follow those of
        the table, and how many ids each row has)."""
        lists = self._words(texts)
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        inner = np.ones(bounds[-1], bool)
        inner[bounds[:-1]] = False
        flat = lists.flatten()
        words = flat.filter(pa.array(inner)).dictionary_encode()
        heads = flat.take(pa.array(bounds[:-1])).dictionary_encode()
        rows = np.empty(len(inner), np.int64)
        rows[inner] = self.words.rows_of(words.dictionary, self._encoded)[words.indices.to_numpy()]
        rows[bounds[:-1]] = len(self.words.sizes) + heads.indices.to_numpy()
        first, counts = self._raw(heads.dictionary.to_pylist())
        return rows, bounds, first, np.concatenate([self.words.sizes, counts])

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds of each text in them)."""
        rows, bounds, first, sizes = self._placed(texts)
        ids = gathered(rows, np.concatenate([self.words.ids, first]), sizes)
        return ids, np.concatenate([[0], np.cumsum(sizes[rows])])[bounds]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        ids, bounds = self.encode_flat(texts)
        data = ids.tobytes()
        return [data[4 * a : 4 * z] for a, z in zip(bounds.tolist(), bounds[1:].tolist())]

    def count(self, texts: list[str]) -> list[int]:
        """The number of ids of each text; they are not put together."""
        rows, bounds, _, sizes = self._placed(texts)
        return np.diff(np.concatenate([[0], np.cumsum(sizes[rows])])[bounds]).tolist()


def in_pieces(texts, limit_chars: int = 6_000_000):
    """Index ranges of ``texts`` whose characters add up to about ``limit_chars``, to bound what is held."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit_chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def ids_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<u4")


__all__ = ["Encoder", "encoder", "in_pieces", "ids_of"]
