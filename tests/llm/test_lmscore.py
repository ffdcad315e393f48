import math
import random
from collections import Counter

import numpy as np

from namespotter.llm import lmscore


def words(t):
    return (t or "").encode().lower().split() + [None]


def corpus(texts):
    r = random.Random(6)
    vocab = [f"W{i}" for i in range(80)]
    made = [" ".join(r.choices(vocab, [1 / (i + 1) for i in range(80)], k=r.randint(1, 120))) for _ in range(150)]
    return [*texts, *made, *made[:40]]


def test_base_score_is_exact(spark, texts, monkeypatch):
    rows = list(enumerate(corpus(texts)))
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' score", "'y' rid")
    train = d.where("doc_id % 3 <> 1")
    counts = Counter(w for i, t in rows if i % 3 != 1 for w in words(t))
    n, v = sum(counts.values()), len(counts)
    for head in (lmscore.HEAD_WORDS, 20, 0):
        got = {r["doc_id"]: r for r in lmscore.lm_scores(d, train, head_words=head, bucket_bytes=20_000).collect()}
        assert len(got) == len(rows)
        for i, t in rows:
            w = words(t)
            base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
            r = got[i]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(counts[x] > 0 for x in w), n)
            assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
            assert r["score"] < 0
    held = [i for i, _ in rows if i % 3 == 1]
    assert sum(got[i]["score"] for i in held) > sum(got[i]["base_score"] for i in held)  # copies are in the training rows
    assert lmscore.lm_scores(d.limit(0), train.limit(0)).count() == 0
    one = lmscore.lm_scores(d.where("doc_id = 5"), train.limit(0)).first()
    assert abs(one["base_score"] - one["n_tokens"] * math.log10(0.5 / 0.5)) < 1e-9 and one["n_known"] == 0


def test_tokens(texts):
    raw = [(t or "").encode() for t in texts]
    for batch in (raw, raw[:1], raw[3:4], []):
        got, sizes = lmscore.Tokens()(batch)
        names = [w for t in batch for w in [*t.lower().split(), None]]
        assert sizes.tolist() == [len(t.split()) + 1 for t in batch] and len(got) == len(names)
        assert len(set(zip(got.tolist(), names, strict=True))) == len(set(names)) == len(set(got.tolist()))


def test_filter_reads_back_levels():
    rng = np.random.default_rng(1)
    keys, counts = rng.integers(0, 1 << 63, 4000).astype(np.uint64), rng.integers(1, 5000, 4000)
    levels = lmscore.level_of(counts)
    for j in range(1, 60):
        low, high = int(lmscore.least_at(j)), int(lmscore.least_at(j + 1))
        assert low < high and set(lmscore.level_of(np.array([low, high - 1]))) == {j}
    width = int(levels.sum()) * lmscore.BITS_PER_EVENT // 64 * 64
    f = lmscore.Filter([lmscore.segment(keys, counts, width)], width)
    got = f.level(keys)
    assert (got >= levels).all() and (got == levels).mean() > 0.95
    absent = f.level(rng.integers(0, 1 << 63, 4000).astype(np.uint64))
    assert (absent > 0).mean() < 0.05


def test_probabilities_sum_to_about_one(spark, texts):
    rows = list(enumerate(corpus([])))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    model, _ = lmscore.fit(d, order=3, bucket_bytes=20_000)
    vocab = sorted({w for _, t in rows for w in words(t) if w})
    hashed = lambda raw: lmscore.Tokens()([raw])[0]
    for context in ("w0 w1", "w3 w0", "w7 w2", "zz yy"):
        c = hashed(context.encode())[:2]
        total = 0.0
        for w in [*vocab, None, b"unknown"]:
            last = hashed(w)[0] if w else lmscore.END
            seq = np.array([*c, last], np.uint64)
            total += 10 ** model.log10(seq, np.arange(3), model.head(seq))[2]
        assert 0.88 < total < 1.14  # quantised counts


def test_a_small_filter_loses_no_n_gram(spark, monkeypatch):
    """Filter bits beyond the bound are read group by group; every score stays."""
    d = spark.createDataFrame(list(enumerate(corpus([]))), "doc_id long, text string")
    want = {r["doc_id"]: r["score"] for r in lmscore.lm_scores(d, d, bucket_bytes=4_000).collect()}
    monkeypatch.setattr(lmscore, "GROUP_BYTES", 1_000)
    model, _ = lmscore.fit(d, open_bytes=4_000, bucket_bytes=4_000)
    assert len(model.filters["n3"].groups) > 2 and not model.filters["n3"].whole and model.chunk == lmscore.ROUND
    got = {r["doc_id"]: r["score"] for r in lmscore.lm_scores(d, d, open_bytes=4_000, bucket_bytes=4_000).collect()}
    assert got == want
    assert {r["doc_id"]: r["score"] for r in lmscore.lm_scores(d, d, open_bytes=0, bucket_bytes=4_000).collect()} == want


def test_text_is_hashed_in_small_parts_and_an_n_gram_probed_once(spark, monkeypatch):
    """Memory of a task goes with HASHED, probes with distinct n-grams; the scores are those of one text at a time."""
    rows = list(enumerate(corpus([]) * 3))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    model, _ = lmscore.fit(d, bucket_bytes=20_000)
    texts, sizes = [t.encode() for _, t in rows], []
    monkeypatch.setattr(lmscore, "HASHED", 5_000)

    class Spy(lmscore.Tokens):
        def __call__(self, part):
            sizes.append(sum(map(len, part)))
            return super().__call__(part)

    (w, lengths), = lmscore.rounds(texts, Spy(), lmscore.CHUNK)
    assert len(sizes) > 10 and max(sizes) <= 5_000
    asked = []
    plain = lmscore.Filter.level_once
    monkeypatch.setattr(lmscore.Filter, "level_once", lambda self, keys, *a: (asked.append(keys), plain(self, keys, *a))[1])
    got = np.add.reduceat(model.log10(w, lmscore.positions(lengths), model.head(w)), np.cumsum(lengths) - lengths)
    assert asked and all(len(np.unique(k)) == len(k) for k in asked)
    for i in range(0, len(texts), 37):
        one, size = lmscore.Tokens()([texts[i]])
        assert abs(model.log10(one, lmscore.positions(size), model.head(one)).sum() - got[i]) < 1e-9
