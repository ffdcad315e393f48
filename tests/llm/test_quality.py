import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from namespotter.llm import quality


def brute_model(texts):
    """Interpolated modified Kneser-Ney by its definition; returns p(word | two words before)."""
    seqs = [["<s>", "<s>", *(t or "").lower().split(), "</s>"] for t in texts]
    c3 = Counter(tuple(s[i - 2:i + 1]) for s in seqs for i in range(2, len(s)))
    c2 = Counter(k[1:] for k in c3)
    c1 = Counter(k[1:] for k in c2)

    def level(c):
        d = quality.discounts([sum(v == i for v in c.values()) for i in range(1, 5)])
        by = defaultdict(list)
        for k, v in c.items():
            by[k[:-1]].append(v)
        off = lambda v: d[min(v, 3) - 1]
        return c, off, {h: sum(v) for h, v in by.items()}, {h: sum(map(off, v)) / sum(v) for h, v in by.items()}

    levels = [level(c) for c in (c1, c2, c3)]

    def p(h, w):
        out = 1 / (len(c1) + 1)
        for n, (c, off, total, weight) in enumerate(levels):
            ctx = tuple(h[2 - n:])
            if ctx in total:
                v = c.get((*ctx, w), 0)
                out = (max(v - off(v), 0) / total[ctx] if v else 0) + weight[ctx] * out
        return out

    return p


def corpus(n=120, seed=8, vocab=60):
    r = random.Random(seed)
    words = [f"v{i}" for i in range(vocab)]
    return [" ".join(r.choices(words, [1 / (i + 1) for i in range(vocab)], k=r.randint(0, 40))) for _ in range(n)]


def test_probabilities_against_the_definition(spark):
    texts = [None, "", *corpus()]
    p = brute_model(texts)
    tables, unknown = quality.kneser_ney(spark.createDataFrame([(t,) for t in texts], "text string"))
    look = quality.Shards(spark, tables, 3).opened()
    hashed = quality.Words()
    for t in ["v0 v1 v0 v2 new v0 v0", "", "v5 v5", *texts[5:15]]:
        w = hashed(t.encode())
        got = quality.log10_probability(look, unknown, w, np.array([len(w)]))
        s = ["<s>", "<s>", *t.split(), "</s>"]
        assert 10 ** got == pytest.approx([p(s[i - 2:i], s[i]) for i in range(2, len(s))], rel=1e-5)
    vocab = {w for t in texts for w in (t or "").split()} | {"</s>", "unseen"}
    assert sum(p(["v0", "v1"], w) for w in vocab) == pytest.approx(1, abs=1e-9)


def test_held_out_accuracy(spark):
    """On labelled rows that the fit has not seen, by language: poor and toxic texts go, trusted ones stay."""
    sf = "/root/testdata/sf0.1"
    docs, labels = quality.table(spark, sf, "documents"), quality.table(spark, sf, "labels")
    got = quality.op9_quality(spark, sf)
    assert got.count() == docs.count()
    seen = quality._sample(docs, labels, "doc_id", "lang", quality.SAMPLE).withColumnRenamed("labelled_id", "doc_id")
    rows = got.join(labels, "doc_id").join(seen, "doc_id", "left_anti").select("quality", "toxic", "rejected", got["lang"]).collect()

    def share(f):
        own = [r["rejected"] for r in rows if f(r)]
        return np.mean(own), len(own)

    for lang in ("en", "de", "fr", "es"):
        trusted, n = share(lambda r: r["quality"] == 1 and r["toxic"] == 0 and r["lang"] == lang)
        assert n > 100 and trusted < 0.015
        poor, n = share(lambda r: r["quality"] == 0 and r["lang"] == lang)
        assert n > 15 and poor > 0.65
        toxic, n = share(lambda r: r["quality"] == 1 and r["toxic"] == 1 and r["lang"] == lang)
        assert n > 8 and toxic > 0.75  # outside English 14 to 40 toxic texts to learn from


def test_words_unknown_to_the_toxic_sample_are_no_evidence(spark):
    """Whatever the sizes of the samples, an unseen word or stem has contrast zero."""
    docs = [t.replace("v", "plain") for t in corpus(200)]
    rows = [(i, t, "en") for i, t in enumerate(docs)] + [(1000 + i, f"v1 v2 vile{i} vilest", "en") for i in range(5)]
    rows += [(2000, "unseenword anotherunseen v1", "en"), (2001, "v1 v2 v3", "en"), (2002, "v1 vilest", "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, int(i >= 1000)) for i, *_ in rows if i < 2000], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.fit(d, labels).scored.collect()}
    assert got[2000]["contrast"] == got[2001]["contrast"] and got[2000]["stem_contrast"] == got[2001]["stem_contrast"]
    assert got[2002]["contrast"] > got[2001]["contrast"] and got[2002]["stem_contrast"] > got[2001]["stem_contrast"]


def test_edges(spark, texts):
    d = spark.createDataFrame([(i, t, None if i % 2 else "en", "x") for i, t in enumerate([*texts, *corpus(30)])] + [(None, None, None, None)],
                              "doc_id long, text string, lang string, rejected string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(12, 40)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    kept = quality.trusted_only(d, labels)
    assert kept.columns == d.columns and 0 < kept.count() <= d.count()
    assert quality.trusted_only(d, labels.limit(0)).count() == d.count()  # nothing to judge by
    assert quality.trusted_only(d.limit(0), labels).count() == 0


def test_thresholds_are_quantiles_of_all_unseen_trusted_rows(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(corpus(400))], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels, sample=20)
    fitted = {r["labelled_id"] for r in quality._sample(docs, labels, "doc_id", "lang", 20).collect()}
    rows = [r for r in model.scored.collect() if r["doc_id"] % 4 and r["doc_id"] not in fitted]
    assert len(fitted) < 100 and len(rows) > 240
    for i, (c, q) in enumerate(quality.JUDGED.items()):
        own = sorted(r[c] for r in rows)
        assert model.thresholds["en"][i] == model.thresholds[None][i] == own[math.ceil(q * len(own)) - 1]


def test_every_labelled_row_serves(spark):
    """Half of the labelled rows fit the models however many there are; the others set the thresholds."""
    docs = spark.createDataFrame([(i, f"v{i % 7} v{i % 5}", "en") for i in range(4000)], "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    taken = quality._sample(docs, labels, "doc_id", "lang", quality.SAMPLE).count()
    assert 1900 < taken < 2100


def test_scores_by_joins_are_those_by_broadcasts(spark, texts, monkeypatch):
    monkeypatch.setattr(quality, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(quality, "SHARD_KEYS", 300)
    rows = [(i, t, "en", {"k": i}) for i, t in enumerate([*texts, *corpus(200), *corpus(5)])] + [(None, None, None, None), (None, "", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, m map<string, int>")
    labels = spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(0, 150)], "doc_id long, quality int, toxic int")
    for keep in (["doc_id", "m"], ["text", "m", "doc_id"]):
        whole, dealt = (quality.fit(docs, labels, keep=[*keep, "lang"], most=n) for n in (quality.BROADCAST_KEYS, 0))
        assert whole.shards is not None and dealt.shards is None and whole.thresholds == dealt.thresholds
        assert whole.scored.schema == dealt.scored.schema
        assert sorted(map(repr, whole.scored.collect())) == sorted(map(repr, dealt.scored.collect()))
