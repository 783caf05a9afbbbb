"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm import shared
from kbspark.llm.quality_rules import STOP_WORDS
from kbspark.llm.shared import lean, small_batches, written

_STOP = frozenset(STOP_WORDS)

#: The document statistics, in the order of :func:`statistics`.
STATISTICS = (
    "log_chars", "log_words", "mean_word", "sd_word", "longest_word", "distinct_words", "top_word", "stop_words",
    "upper_chars", "digit_chars", "space_chars", "punct_chars", "symbol_chars", "bang_chars", "pipe_chars",
    "line_words", "dup_lines", "same_neighbours", "odd_ended_words", "upper_words", "no_letter_words", "distinct_pairs",
)


_CLASSES = [np.frombuffer(c, np.uint8) for c in (bytes(range(65, 91)), b"0123456789", b".,;:'\"()-?", b"#*$%&<>@^~", b"!", b"|")]


def statistics(text: str | None) -> list[float]:
    """Numbers that describe a whole text; all zero for an empty one. Linear in its length."""
    text = text or ""
    words, n = text.split(), len(text)
    m = len(words)
    if not m:
        return [0.0] * len(STATISTICS)
    lengths = np.fromiter(map(len, words), np.int64, m)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    bytes_ = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    upper, digits, punct, symbols, bangs, pipes = (int(bytes_[c].sum()) for c in _CLASSES)
    capitals = stops = odd = plain = 0
    for w, c in counts.items():
        if w.isupper():
            capitals += c
        if w.lower() in _STOP:
            stops += c
        if not w[-1].isalnum():
            odd += c
        if not w[0].isalpha() and not any(map(str.isalpha, w)):
            plain += c
    same = sum(map(str.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    return [
        np.log1p(n), np.log1p(m), lengths.mean(), lengths.std(), np.log1p(lengths.max()), len(counts) / m,
        max(counts.values()) / m, stops / m, upper / n, digits / n, (n - int(lengths.sum())) / n, punct / n, symbols / n,
        bangs / n, pipes / n, np.log1p(m / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)), same / m, odd / m,
        capitals / m, plain / m, pairs / m,
    ]


def statistics_column(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shared.WORKER_CACHES.clear()
        for batch in texts:
            yield pd.Series([statistics(t) for t in batch], dtype=object)
        shared.give_back()

    return of(text)


@dataclass
class Model:
    """A fitted classifier; a few hundred kilobytes whatever the corpus."""

    mean: np.ndarray
    sd: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps_x: np.ndarray
    steps_y: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features (and a constant) of rows of statistics."""
        z = np.clip((x - self.mean) / self.sd, -8, 8)
        f = np.cos(z @ self.directions + self.phases) * np.sqrt(2.0 / len(self.phases))
        return np.hstack([f, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores in 0 to 1. A thousandth of the score is the uncalibrated one, which keeps the
        order of rows inside a flat step of the isotonic fit."""
        raw = self.raw(x)
        return np.clip(0.999 * np.interp(raw, self.steps_x, self.steps_y) + 0.001 * np.clip(raw, 0, 1), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over points sorted by ``x``: (block centres, block means)."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, w):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    out = np.array(blocks)
    return out[:, 0] / out[:, 2], out[:, 1] / out[:, 2]


def _stack(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=float).reshape(len(column), len(STATISTICS))


def fit(
    rows: DataFrame,
    n_features: int = 384,
    width: float = 1.0,
    ridge: float = 1e-3,
    max_rows: int = 200_000,
    bins: int = 1000,
    seed: int = 7,
    tasks: int = 12,
) -> Model:
    """Fit on ``rows`` with ``stats`` (array of statistics), ``label`` (0 or 1) and ``fold`` (calibration rows
    have fold 4, the others fit the ridge weights).

    ``max_rows`` bounds the labelled rows used, drawn by a hash of the statistics; what reaches the driver is
    then bounded too: one matrix of n_features squared from each of ``tasks`` partitions, and one sum for
    each of ``bins`` score bins. The kernel width is ``width`` times the square root of the number of
    statistics, in units of their standard deviation.
    """
    n = rows.count()
    if n > max_rows:
        share = int(2**30 * max_rows / n)
        rows = rows.filter(F.pmod(F.xxhash64("stats"), F.lit(2**30)) < share)
    rows = written(rows.select("stats", "label", "fold").repartition(tasks), "quality-rows")
    d = len(STATISTICS)
    sums = rows.select(F.count("*"), *[f(F.col("stats")[i]) for i in range(d) for f in (F.avg, F.stddev_pop)]).first()
    generator = np.random.default_rng(seed)
    model = Model(
        mean=np.array([sums[1 + 2 * i] or 0.0 for i in range(d)]),
        sd=np.array([max(sums[2 + 2 * i] or 0.0, 1e-6) for i in range(d)]),
        directions=generator.normal(size=(d, n_features)) / (width * np.sqrt(d)),
        phases=generator.uniform(0, 2 * np.pi, n_features),
        weights=np.zeros(n_features + 1),
        steps_x=np.array([0.0, 1.0]),
        steps_y=np.array([0.0, 1.0]),
    )
    if not sums[0]:
        return model
    k = n_features + 1

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k + 1))
        for b in batches:
            x = b.to_pandas()
            z = model.features(_stack(x["stats"]))
            total[:, :k] += z.T @ z
            total[:, k] += z.T @ x["label"].to_numpy(float)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["sums"])

    parts = rows.filter("fold <> 4").mapInArrow(lean(normal), "sums binary").collect()
    total = sum(np.frombuffer(p.sums).reshape(k, k + 1) for p in parts)
    size = max(1.0, total[k - 1, k - 1])
    model.weights = np.linalg.solve(total[:, :k] + ridge * size / k * np.eye(k), total[:, k])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.to_pandas()
            raw = model.raw(_stack(x["stats"]))
            at = np.clip(((raw + 0.5) / 2 * bins).astype(int), 0, bins - 1)
            yield pa.record_batch([pa.array(at), pa.array(raw), pa.array(x["label"].to_numpy(float))], ["bin", "raw", "y"])

    held = rows.filter("fold = 4").mapInArrow(lean(scored), "bin long, raw double, y double")
    found = held.groupBy("bin").agg(F.avg("raw").alias("x"), F.avg("y").alias("y"), F.count("*").alias("w")).collect()
    if found:
        x, y, w = np.array(sorted((r.x, r.y, float(r.w)) for r in found)).T
        model.steps_x, model.steps_y = isotonic(x, y, w)
    return model


def fold_of(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5: 0 is held out, 4 calibrates."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)).cast("int")


def _scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int, carry: list[str]) -> DataFrame:
    """``(__id, __fold, __score, __row)`` for every document, ``__row`` a struct of the columns in ``carry``."""
    small_batches(docs.sparkSession)
    stats = written(
        docs.select(
            F.col(id_col).alias("__id"), fold_of(id_col).alias("__fold"), statistics_column(F.col(text_col)).alias("__stats"),
            F.struct(*carry).alias("__row") if carry else F.lit(None).cast("int").alias("__row"),
        ),
        "quality-stats",
    )
    marks = labels.filter(F.col(label_col).isNotNull()).select(F.col(id_col).alias("__key"), F.col(label_col).cast("double").alias("label"))
    known = stats.filter("__fold <> 0").select("__id", "__fold", "__stats").join(marks, F.col("__id") == F.col("__key"))
    model = fit(known.select(F.col("__stats").alias("stats"), "label", F.col("__fold").alias("fold")), max_rows=max_rows)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(model.score(_stack(b)))

    return stats.select("__id", "__fold", score("__stats").alias("__score"), "__row")


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = 0.3,
    max_rows: int = 200_000,
) -> DataFrame:
    """``(id_col, held_out, score, predicted)`` for every document, the score from its whole text alone.

    Labels are learnt only from rows whose fold is not 0. Statistics are computed once per document, in
    Arrow batches, and written (about 180 bytes each); the fit and the scoring read them.

    Null text: scored as empty. Null labels and ids: not learnt from. Documents with several label rows: each
    counts. Repeated documents: each gets its row. No labels at all: the score is 0 to 1 but says nothing. Empty
    table: empty result. Other columns of ``docs`` are left out.
    """
    rows = _scored(docs, labels, id_col, text_col, label_col, max_rows, [])
    return rows.select(
        F.col("__id").alias(id_col), (F.col("__fold") == 0).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted")
    )


def keep_good_documents(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = 0.3,
    max_rows: int = 200_000,
) -> DataFrame:
    """``docs`` without the documents that :func:`score_documents` predicts to be bad; all columns as they are,
    whatever their names. Cases as there."""
    rows = _scored(docs, labels, id_col, text_col, label_col, max_rows, docs.columns)
    return rows.filter(F.col("__score") >= threshold).select("__row.*")
