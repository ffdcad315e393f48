"""Exact dedup: against grouping by text, with strong and weak digests."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from namespotter.llm import recipes

SCHEMA = "doc_id long, text string, id string, sha string, recipe string, salt int, n int"


def brute(rows):
    """Sorted (doc_id, keep_id, group_size, kept, sha) by grouping whole texts."""
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for t, ids in groups.items():
        ids.sort(key=lambda i: (i is not None, i if i is not None else 0))
        sha = hashlib.sha256(t.encode()).hexdigest()
        out += [(i, ids[-1], len(ids), k == len(ids) - 1, sha) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


def found(spark, rows, **how):
    df = spark.createDataFrame([(i, t, "x", "y", "z", 1, 2) for i, t in rows], SCHEMA).repartition(5)
    got = recipes.exact_duplicates(df, **how)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.fixture(scope="module")
def rows(texts):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh pqé한\n.") for _ in range(60000))
    made = texts + [long, long + ".", "." + long, long[:30000] + "x" + long[30001:], long[:59999]]
    made += ["".join(rng.choice("ab ") for _ in range(rng.randrange(12))) for _ in range(150)]
    return [(k if k % 9 else None, t) for k, t in enumerate(made * 2)] + [(10**6, "twice"), (10**6, "twice")]


def test_equal_texts(spark, rows):
    assert found(spark, rows) == brute(rows)


def test_clashing_digests_are_told_apart(spark, rows):
    """Digests of 1 and of 3 values, cut into chunks of 4 to 9 bytes; both ways of choosing rows to verify."""
    small = [(i, t if t is None else t[:400]) for i, t in rows]
    for digest in (lambda c: F.length(c) * 0, lambda c: F.length(c) % 3):
        for shared_max in (10**6, 0):
            assert found(spark, small, digest=digest, least=4, most=9, shared_max=shared_max) == brute(small)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_chunks_join_to_the_text_and_follow_its_bytes(spark, rows):
    texts = sorted({t for _, t in rows if t}, key=len)
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    cut = [r[0] for r in df.select(recipes.chunks(F.col("text"))).collect()]
    for t, parts in zip(texts, cut, strict=True):
        assert "".join(parts).encode("latin-1") == t.encode()
        assert all(len(p) <= recipes.MOST for p in parts) and all(len(p) >= recipes.LEAST for p in parts[:-1])
    by_text = dict(zip(texts, cut, strict=True))
    long = max((t for t in texts if not t.startswith(("word", "."))), key=len)[:59999]
    shared = set(by_text[long]) & set(by_text["." + long + long[-1:]] if "." + long + long[-1:] in by_text else
                                      next(c for t, c in by_text.items() if t.startswith("." + long[:50])))
    assert len(shared) > len(by_text[long]) / 2  # a byte put in front moves the first cuts only


def test_no_python_in_the_plan(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plan = recipes.exact_duplicates(df)._jdf.queryExecution().toString()
    assert not re.search(r"Python|Arrow|Pandas", plan)
