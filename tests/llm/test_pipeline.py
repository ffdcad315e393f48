import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from namespotter.llm import secrets

from .test_decontaminate import brute
from .test_simhash import brute_components, brute_fingerprint


def fixture(texts):
    r = random.Random(12)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu") for b in ("ra", "se", "ti", "vo", "zu")]
    prose = lambda n: " ".join(r.choices(words, [1 / (i + 1) for i in range(20)], k=n))
    docs, labels = [], []
    for i in range(240):
        kind = i % 8
        text = prose(r.randint(40, 90))
        if kind == 6:
            text = " ".join(f"{w.upper()}!!{r.randrange(99)}" for w in text.split())
        if kind == 7:
            text = text.replace("kara", "vileword").replace("lose", "foulword")
        docs.append((i, text, "en", "src", len(text)))
        labels.append((i, int(kind != 6), int(kind == 7)))
    leak = prose(14)
    docs += [(300, docs[0][1], "en", "src", 0), (301, docs[1][1], None, "src", 0), (302, prose(30) + " " + leak + " " + prose(30), "en", "src", 0),
             (303, prose(50) + ' password = "hunter2hunter2" ' + prose(9), "en", "src", 0), (None, prose(60), "en", None, None), (304, None, "en", "src", None)]
    docs += [(400 + i, t, "en", "src", 0) for i, t in enumerate(texts)]
    return docs, labels, [(0, leak), (1, None), (2, "")]


def test_each_stage_and_the_whole(spark, texts, tmp_path):
    docs, labels, items = fixture(texts)
    sf = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    steps = dict(corpus_pipeline.STAGES)
    rows = lambda df: {r["doc_id"]: r for r in df.collect()}

    first = steps["quality"](spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    kept = rows(first)
    assert first.columns == schema.replace(" long", "").replace(" string", "").split(", ")
    gone = [k for k, q, t in labels if k not in kept]
    assert sum(k % 8 < 6 for k in gone) <= 2 and sum(k % 8 == 6 for k in gone) >= 25 and sum(k % 8 == 7 for k in gone) >= 25

    stay = [(r["doc_id"], brute_fingerprint(r["text"])) for r in first.collect()]
    big = 10 ** 9
    ids = [(big if i is None else i, f) for i, f in stay]
    want = {i for (i, _), c in zip(ids, brute_components(ids), strict=True) if i == c}
    second = steps["near_duplicates"](spark, first, sf)
    kept = rows(second)
    assert {big if i is None else i for i in kept} == want and second.columns == first.columns

    third = steps["decontamination"](spark, second, sf)
    want = {i for i, r in kept.items() if not brute(r["text"], items, 10)[4]}
    kept = rows(third)
    assert set(kept) == want and 302 not in kept

    fourth = rows(steps["secrets"](spark, third, sf))
    assert set(fourth) == set(kept)
    for i, r in fourth.items():
        assert r["text"] == (None if kept[i]["text"] is None else secrets.redacted(kept[i]["text"].encode()))
    assert "hunter2" not in fourth[303]["text"] and "[SECRET]" in fourth[303]["text"]

    whole = corpus_pipeline.run(spark, sf).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got, tokens = {}, 0
    for p in sorted(whole, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["sequence_id"] * 2048 + p["offset"] == tokens
        tokens += p["length"]
        got.setdefault(p["doc_id"], []).extend(np.frombuffer(p["piece_ids"], "<u2").tolist())
    assert got == {i: t.encode(r["text"] or "", add_special_tokens=False).ids + [1] for i, r in fourth.items()}
