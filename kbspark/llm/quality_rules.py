"""Quality rules: a table of thresholds compiled into one projection, built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm.shared import ASCII_SPACE, SPACE_CLASS, let

SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he this are or his from at which "
    "le la les de des du et un une en que qui est pour dans sur pas par au avec "
    "der die das und zu den von mit sich ist im nicht ein eine auf dem als für auch "
    "el los las y del se su por con una no para lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes if ``low <= metric <= high`` (either may be None); documents of fewer than
    ``from_words`` words pass unseen, since ratios over a few words say little."""

    metric: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


#: The production table. Ratios are a word unless named otherwise.
RULES = (
    Rule("mean_word_chars", 1.5, 25.0),
    Rule("symbol_ratio", None, 0.25),
    Rule("shout_ratio", None, 0.5),
    Rule("stop_word_ratio", 0.01, None, from_words=60),
    Rule("dup_line_ratio", None, 0.6),
    Rule("repeat_word_ratio", None, 0.2),
)


def _chars_in(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def word_array(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of ``text`` in order."""
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more, each word once.

    Windows become 64-bit hashes with their positions; sorting brings equal ones together, so the cost
    is n log n however long the text. Only texts in which some window repeats are sorted at all. The
    comparison is by hash within one text: 20,000 windows collide with a chance of about 1e-11.
    """

    def marked(pairs: Column) -> Column:
        return F.filter(
            pairs,
            lambda x, i: (x["h"] == F.get(pairs, i - 1)["h"]).eqNullSafe(True)
            | (x["h"] == F.get(pairs, i + 1)["h"]).eqNullSafe(True),
        )

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def of_hashes(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        sorted_positions = let(pairs, lambda s: F.sort_array(F.transform(marked(s), lambda x: x["i"])))
        return F.when(F.size(hashes) == F.size(F.array_distinct(hashes)), F.lit(0).cast("long")).otherwise(
            let(sorted_positions, covered)
        )

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - WINDOW)
        return F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(
        let(F.transform(words, lambda w: F.xxhash64(w)), lambda ws: let(windows(ws), of_hashes))
    )


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``__qr`` of counts over the whole text. Null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def counts(w: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(ASCII_SPACE)) != "")
        return let(
            lines,
            lambda ls: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.translate(text, ASCII_SPACE, "")).cast("long").alias("word_chars"),
                _chars_in(text, SYMBOLS).cast("long").alias("n_symbols"),
                F.size(ls).cast("long").alias("n_lines"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                _repeat_words(w).alias("n_repeat_words"),
                F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
                F.size(F.filter(w, lambda x: x.endswith("!!"))).cast("long").alias("n_shouts"),
            ),
        )

    return docs.withColumn("__qr", let(word_array(text), counts))


#: Metrics that rules may name, over the counts.
METRICS = {
    "n_words": lambda c: c("n_words").cast("double"),
    "mean_word_chars": lambda c: c("word_chars") / c("n_words"),
    "symbol_ratio": lambda c: c("n_symbols") / c("n_words"),
    "shout_ratio": lambda c: c("n_shouts") / c("n_words"),
    "stop_word_ratio": lambda c: c("n_stop_words") / c("n_words"),
    "dup_line_ratio": lambda c: c("n_dup_lines") / c("n_lines"),
    "repeat_word_ratio": lambda c: c("n_repeat_words") / c("n_words"),
}


def verdict(rules=RULES, column: str = "__qr") -> Column:
    """All rules as one boolean expression. Texts without words divide by nothing and pass it; the word
    minimum, which belongs to the base test, stops them."""
    c = lambda name: F.col(f"{column}.{name}")
    out = F.lit(True)
    for r in rules:
        value = F.when(c("n_words") > 0, METRICS[r.metric](c))
        fine = F.lit(True)
        if r.low is not None:
            fine = fine & (value >= r.low)
        if r.high is not None:
            fine = fine & (value <= r.high)
        out = out & F.coalesce((c("n_words") < r.from_words) | fine, F.lit(True))
    return out


def quality_rules(docs: DataFrame, text_col: str = "text", rules=RULES, min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """``docs`` with counts, ``base_failed`` and ``kept`` after its own columns; one row in, one row out.

    Base test: fewer than ``min_words`` words, or more than ``max_repeat_percent`` of them in repeated
    5-word windows. ``kept`` is false where that fails, else what the threshold table says.

    Null or empty text: all counts 0, base_failed. Ties and repeated rows: each row is judged alone.
    Very long text: n log n in its words. Empty table: empty result with the same columns. A column of
    ``docs`` that has the name of a result column is replaced by it.
    """
    m = measured(docs, text_col)
    c = lambda name: F.col(f"__qr.{name}")
    failed = (c("n_words") < min_words) | (100 * c("n_repeat_words") > max_repeat_percent * c("n_words"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return m.withColumns(
        {n: c(n) for n in names} | {"base_failed": failed, "kept": ~failed & verdict(rules)}
    ).drop("__qr")
