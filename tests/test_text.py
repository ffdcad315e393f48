"""Normalisers and windows against Python's own string semantics."""
import re

from pyspark.sql import functions as F

from namespotter.functions.text import alnum_lower, split_ws, strip_punct, vector_terms, word_tokens, ascii_clean
from namespotter.functions.windows import char_ngrams, word_windows, word_spans

SAMPLES = ["Hello, World!", "a & b  c", "café_au-lait 2²", "x\u0085y z\x1cw", "  lead trail  ",
           "İstanbul Ünïcode", "tab\there\nnew", "", "áb", "emoji 😀 ok"]


def py_strip_punct(t):
    return re.sub(r"[^\w\s]", "", t.lower())


def py_alnum(t):
    return "".join(c.lower() for c in t if c.isalnum())


def test_normalisers_match_python(spark):
    df = spark.createDataFrame([(s,) for s in SAMPLES], "t string")
    rows = df.select("t", strip_punct("t").alias("n1"), alnum_lower("t").alias("n2"),
                     split_ws("t").alias("n6"), word_tokens("t").alias("n3"),
                     vector_terms("t").alias("n5")).collect()
    for r in rows:
        assert r.n1 == py_strip_punct(r.t), r.t
        assert r.n2 == py_alnum(r.t), r.t
        assert list(r.n6) == r.t.split(), r.t
        assert list(r.n3) == re.findall(r"\w+", r.t.lower()), r.t
        assert list(r.n5) == re.findall(r"(?u)\b\w\w+\b", r.t.lower()), r.t


def test_ascii_clean(spark):
    df = spark.createDataFrame([("  café\tbar\x01  baz ",)], "t string")
    assert df.select(ascii_clean("t")).first()[0] == "caf bar baz"


def test_windows_and_grams(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"], "hello"), (["a", "b"], "h")], "w array<string>, s string")
    r = df.select(word_windows("w").alias("win"), char_ngrams("s", 2).alias("g2"),
                  char_ngrams("s", 3).alias("g3"), word_spans("w", 3).alias("sp")).collect()
    assert list(r[0].win) == ["a b c", "b c d"]
    assert list(r[1].win) == []                       # fewer than 3 words: none
    assert list(r[0].g2) == ["he", "el", "ll", "lo"]
    assert list(r[1].g3) == []                        # shorter than n: none (no count-down)
    spans = [(x.start, x.n_words, x.span) for x in r[0].sp]
    assert spans[:4] == [(0, 1, "a"), (0, 2, "a b"), (0, 3, "a b c"), (1, 1, "b")]
    assert len(spans) == 3 + 3 + 2 + 1


def test_norm_order_trap(spark):
    """A lone '&' vanishes when normalising first, keeps a slot when splitting first."""
    df = spark.createDataFrame([("x & y z",)], "t string")
    a = df.select(word_windows(split_ws(strip_punct("t")))).first()[0]
    b = df.select(word_windows(split_ws("t"))).first()[0]
    assert list(a) == ["x y z"]
    assert list(b) == ["x & y", "& y z"]
