"""Collocations: against brute force over all phrases, also where fingerprints collide and filters are full."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from namespotter.llm import collocations
from namespotter.llm.collocations import Layout, layouts, powers

SCHEMA = "doc_id long, text string, lang string, rank string, salt int, l int, phrase int"


def pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split(r"[ \t]+", p) if w] for p in re.split(r"[.,;:!?\n-\r]", low)]


def brute(rows, least, top=2000, longest=4):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            total[lang] += len(w)
            for n in range(1, longest + 1):
                for i in range(len(w) - n + 1):
                    f[lang, tuple(w[i:i + n])] += 1
    often = {k: v for k, v in f.items() if v >= least}
    found = {}
    for (lang, w), a in often.items():
        if len(w) < 2:
            continue
        cuts = [(2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        if not any(g == lang and len(v) > len(w) and 100 * b >= 80 * a and any(v[i:i + len(w)] == w for i in range(len(v)))
                   for (g, v), b in often.items()):
            found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, r, p.decode(), -a, lo, hi, total[lang], -s) for lang, all_ in found.items()
                  for r, (s, a, p, lo, hi) in enumerate(sorted(all_)[:top], 1))


@pytest.fixture(scope="module")
def rows(texts):
    rng = random.Random(4)
    made = [(t, lang) for t in texts for lang in ("en", None)]
    words = ["new", "york", "New", "é", "한글", "city", "of", "the", "a", "b c", "d\u0085", "x-y", "\x00z"]
    for _ in range(160):
        text = ""
        for _ in range(rng.randrange(40)):
            text += rng.choice(words[:rng.choice([3, 8, 13])]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\r\n"])
        made.append((text, rng.choice(["en", "en", "de", None, ""])))
    return made + [("hot phrase here. " * 2000, "en"), ("Hot phrase, here", "en")] * 3


def found(spark, rows, **how):
    df = spark.createDataFrame([(k, t, g, "r", 1, 2, 3) for k, (t, g) in enumerate(rows)], SCHEMA).repartition(6)
    got = collocations.collocations(df, **how)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


def test_equals_brute_force(spark, rows):
    want = brute(rows, 5)
    assert len(want) > 100 and found(spark, rows, least=5) == want


def test_top_and_collisions_and_full_filters(spark, rows):
    """Fingerprints of 6 bits: every filter holds everything and most phrases collide."""
    assert found(spark, rows, least=5, top=7, bits=6) == brute(rows, 5, 7)


def test_empty_table(spark):
    assert found(spark, [], least=1) == []
    assert found(spark, [(None, None), ("", "en"), (" .,", "en")], least=1) == []


def test_exact_beyond_64_bits(spark):
    """The score's product passes 64 bits: counts as they would be, through the same expression."""
    from pyspark.sql import functions as F
    a, lo, hi = 9 * 10**17, 10**18 - 1, 10**18 - 7
    score = F.expr("(cast(a as decimal(38, 0)) * 2000000BD) div (cast(l as decimal(38, 0)) + cast(r as decimal(38, 0)))")
    assert spark.createDataFrame([(a, lo, hi)], "a long, l long, r long").select(score).first()[0] == 2000000 * a // (lo + hi)


def test_layout_and_fingerprints():
    rows = [("en", b"A b,c  d\te"), ("de", b"a B"), ("en", b"\n\n"), ("en", b"x")]
    lay = Layout(rows)
    assert [lay.bytes[s:e].tobytes() for s, e in zip(lay.starts, lay.ends, strict=True)] == [b"a", b"b", b"c", b"d", b"e", b"a", b"b", b"x"]
    assert lay.places(2).tolist() == [0, 2, 3, 5] and lay.texts(lay.places(2), 2).to_pylist() == ["a b", "c d", "d e", "a b"]
    p = lay.prints(lay.places(2), 2)
    assert p[0] != p[3]  # another language
    assert Layout([("en", b"zz. a  b")]).prints(np.array([1]), 2)[0] == p[0]  # the place does not matter
    weak = Layout([("en", b"one two one three two")], bits=1)
    ids = weak.word_ids()
    assert ids[0] == ids[2] and ids[1] == ids[4] and len(set(ids.tolist())) == 3


def test_long_texts_are_cut_between_pieces():
    raw = b"aa bb. " * 50 + b"q" * 300 + b", end"
    parts = [t for held in layouts([("en", raw), ("de", b"k")], limit=64) for _, t in held]
    assert b"".join(parts) == raw + b"k" and all(p.endswith((b".", b",", b"end", b"k")) for p in parts)
    assert powers(collocations.BASE, 5).tolist() == [pow(collocations.BASE, k, 1 << 64) for k in range(5)]
