import hashlib
import random

from namespotter.llm import decontaminate
from namespotter.llm.common import plain_words


def brute(text, items, size):
    w = plain_words((text or "").encode())
    hit, ids = set(), set()
    for item, t in items:
        b = plain_words((t or "").encode())
        n = min(size, len(b))
        for i in range(len(b) - n + 1) if n else ():
            for k in range(len(w) - n + 1):
                if w[k:k + n] == b[i:i + n]:
                    hit |= set(range(k, k + n))
                    ids.add(str(item))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def test_against_brute_force(spark, texts, monkeypatch):
    r = random.Random(1)
    items = [(k, " ".join(r.choice("abcé") for _ in range(r.randint(0, 9)))) for k in range(20)] + [(20, None), (3, "the cat")]
    docs = [(i, t) for i, t in enumerate(texts)] + [(100 + i, "; ".join(r.choice("ABCdé") for _ in range(60))) for i in range(30)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' n_hit")
    b = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontaminate.BLOCK_BYTES, 40):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        got = decontaminate.contaminated_words(d, b, size=4)
        rows = {x["doc_id"]: x for x in got.collect()}
        for i, t in docs:
            x = rows[i]
            assert (x["n_words"], x["n_hit"], x["n_items"], x["items_sha256"], x["contaminated"]) == brute(t, items, 4)
    assert decontaminate.contaminated_words(d, b.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contaminated_words(d.limit(0), b).count() == 0


def test_offsets(spark):
    d = spark.createDataFrame([(1, "été! The, CAT sat—now the cat")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "the cat")], "item_id long, text string")
    x = decontaminate.contaminated_words(d, b).first()
    assert [x["text"][s["start"]:s["end"]] for s in x["hit_spans"]] == ["The, CAT", "the cat"]
