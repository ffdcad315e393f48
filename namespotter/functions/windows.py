"""Array-valued column expressions that cut texts into windows and grams
(W1, W2, W5, W8) and the helpers the candidate filters use.

All of them work inside one row with higher-order functions, so cutting a
document into windows needs no shuffle; ``explode`` afterwards spreads the
windows of one long text over the rows of its partition.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c

def _empty_strings() -> Column:
    return F.array().cast("array<string>")


def word_windows(words, size: int = 3, sep: str = " ") -> Column:
    """Every run of ``size`` consecutive words joined by ``sep``,
    stride 1.  A text with fewer than ``size`` words has none."""
    w = _c(words)
    n = F.size(w)
    return F.when(
        n >= size,
        F.transform(F.sequence(F.lit(0), n - size),
                    lambda i: F.array_join(F.slice(w, i + 1, size), sep)),
    ).otherwise(_empty_strings())


def word_chunks(words, size: int = 256) -> Column:
    """Consecutive chunks of ``size`` words, stride ``size``; the last
    chunk holds the remainder."""
    w = _c(words)
    n = F.size(w)
    return F.when(
        n > 0,
        F.transform(F.sequence(F.lit(0), n - 1, F.lit(size)),
                    lambda i: F.array_join(F.slice(w, i + 1, size), " ")),
    ).otherwise(_empty_strings())


def word_spans(words, max_len: int = 10) -> Column:
    """Every span of 1..max_len words from every start, as structs
    (start, n_words, span) with 0-based start."""
    w = _c(words)
    n = F.size(w)
    spans = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.transform(
            F.sequence(F.lit(1), F.least(F.lit(max_len), n - i)),
            lambda k: F.struct(i.alias("start"), k.alias("n_words"),
                               F.array_join(F.slice(w, i + 1, k), " ").alias("span"))))
    return F.when(n > 0, F.flatten(spans)).otherwise(
        F.array().cast("array<struct<start:int,n_words:int,span:string>>"))


def char_ngrams(s, n: int) -> Column:
    """Character n-grams of a string, in order, repeats kept; none when
    the string is shorter than n.  A zero-width lookahead makes the regex
    engine return every overlapping n-gram natively (no lambda per gram)."""
    return F.regexp_extract_all(_c(s), F.lit(f"(?s)(?=(.{{{n}}}))"), 1)
