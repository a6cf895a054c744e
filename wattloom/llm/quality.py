"""Quality rules as one projection of column expressions (operator 3).

The rules are rows of a table: a measure and the range it must lie in. `verdict` compiles them into one condition, and
all measures are ordinary Spark expressions over the text, without user functions.

Defined cases: a null text has no words, all counts are 0 and the base rule rejects it; measures that divide by a
count of 0 are 0; very long texts are counted whole; rows are judged one by one, so repeated rows agree.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from .common import GAP, words_of

MIN_WORDS = 50
MAX_REPEATED = 0.5
SYMBOLS = "#*$%&|<>"
# Frequent words of English, Spanish, French and German.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "have", "he", "in", "is", "it", "not", "of", "on",
    "or", "that", "the", "this", "to", "was", "were", "with", "you",
    "al", "con", "de", "del", "el", "en", "es", "la", "las", "lo", "los", "no", "para", "por", "que", "se", "su", "sus",
    "un", "una", "y", "au", "ce", "dans", "des", "du", "est", "et", "il", "le", "les", "ne", "nous", "pas", "pour",
    "qui", "sur", "une", "vous", "à",
    "auf", "aus", "das", "dem", "den", "der", "die", "ein", "eine", "für", "ich", "im", "ist", "mit", "nicht", "sich",
    "sie", "und", "von", "zu",
)


class Rule(NamedTuple):
    measure: str
    low: float
    high: float


RULES = (
    Rule("mean_word_chars", 2.0, 12.0),
    Rule("symbol_ratio", 0.0, 0.06),
    Rule("shout_ratio", 0.0, 0.1),
    Rule("upper_ratio", 0.0, 0.4),
    Rule("stop_word_ratio", 0.08, 1.0),
    Rule("dup_line_ratio", 0.0, 0.4),
    Rule("bullet_line_ratio", 0.0, 0.9),
    Rule("ellipsis_line_ratio", 0.0, 0.3),
)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def _count(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def _repeated_starts() -> Column:
    """Ascending positions of 3-word windows that occur twice or more, from `_windows`: their hashes with positions, sorted."""
    w = F.col("_windows")
    same = lambda i, j: F.get(w, i)["h"] == F.get(w, j)["h"]
    repeated = F.filter(
        F.transform(w, lambda x, i: F.when(F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)), x["at"])),
        lambda at: at.isNotNull(),
    )
    return F.sort_array(repeated)


def measured(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The columns of `docs` prefixed by nothing but `doc_id`, with the counts and the measures of the rules."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_text"))
    rows = rows.withColumns({"_words": words_of(F.col("_text")), "_lines": F.split(F.col("_text"), "\n")})
    rows = rows.withColumn("_full", F.filter("_lines", lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    words, n = F.col("_words"), F.size("_words")
    window = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    starts = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("_hashes", F.transform(starts, window))
    # Only texts in which some window repeats are sorted.
    placed = F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("at")))
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    rows = rows.withColumn("_windows", F.when(repeats, F.sort_array(placed)).otherwise(F.array().cast("array<struct<h:bigint,at:int>>")))
    rows = rows.withColumn("_starts", _repeated_starts())
    at = F.col("_starts")
    # A window's three words, less those of the next repeated window.
    covered = F.transform(at, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - x, F.lit(3))))
    counts = rows.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("_text", GAP, "")).cast("long").alias("word_chars"),
        _count(F.col("_text"), SYMBOLS).alias("n_symbols"),
        (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long").alias("n_dup_lines"),
        F.aggregate(covered, F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words"),
        F.size("_full").cast("long").alias("n_lines"),
        F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        _count(F.col("_text"), "!?").alias("n_shouts"),
        (F.length("_text") - F.length(F.regexp_replace("_text", "[A-Z]", ""))).cast("long").alias("n_upper"),
        F.size(F.filter("_full", lambda line: line.rlike(r"^\s*[-*•]"))).cast("long").alias("n_bullets"),
        F.size(F.filter("_full", lambda line: line.rlike(r"(\.\.\.|…)\s*$"))).cast("long").alias("n_ellipses"),
    )
    c = F.col
    return counts.withColumns(
        {
            "mean_word_chars": _ratio(c("word_chars"), c("n_words")),
            "symbol_ratio": _ratio(c("n_symbols"), c("word_chars")),
            "shout_ratio": _ratio(c("n_shouts"), c("word_chars")),
            "upper_ratio": _ratio(c("n_upper"), c("word_chars")),
            "stop_word_ratio": _ratio(c("n_stop_words"), c("n_words")),
            "dup_line_ratio": _ratio(c("n_dup_lines"), c("n_lines")),
            "bullet_line_ratio": _ratio(c("n_bullets"), c("n_lines")),
            "ellipsis_line_ratio": _ratio(c("n_ellipses"), c("n_lines")),
        }
    )


def verdict(rules: Sequence[Rule] = RULES) -> Column:
    """The rule table as one condition."""
    return reduce(lambda a, r: a & F.col(r.measure).between(r.low, r.high), rules, F.lit(True))


def base_failed(min_words: int = MIN_WORDS, max_repeated: float = MAX_REPEATED) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > int(100 * max_repeated) * F.col("n_words"))


def quality(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, counts, measures, base_failed and kept of every document."""
    rows = measured(docs).withColumn("base_failed", base_failed())
    return rows.withColumn("kept", ~F.col("base_failed") & verdict(rules))
