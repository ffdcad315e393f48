import random

import numpy as np
import xxhash

from namespotter.llm import simhash


def brute_fingerprint(text, size=3):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i:i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, radius=2):
    """rows: (id, fp); smallest id reachable."""
    label = list(range(len(rows)))
    for _ in rows:
        for i, (_, a) in enumerate(rows):
            for j, (_, b) in enumerate(rows):
                if bin(a ^ b).count("1") <= radius:
                    label[i] = label[j] = min(label[i], label[j])
    return [min(r[0] for r, m in zip(rows, label, strict=True) if m == x) for x in label]


def test_fingerprint(texts):
    for t in texts:
        assert simhash.fingerprint((t or "").encode()) == brute_fingerprint(t)


def test_links_any_radius():
    r = random.Random(3)
    for radius in (0, 1, 2, 3, 5):
        base = [r.getrandbits(64) for _ in range(9)]
        fps = np.array([b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 6))) for b in base for _ in range(12)], np.uint64)
        planes = simhash._planes(fps)
        for s in (1, 7, 8, 21):
            want = [i for i in range(len(fps) - s) if bin(int(fps[i]) ^ int(fps[i + s])).count("1") <= radius]
            assert simhash.links_at(planes, np.ones(len(fps) - s, bool), s, radius).tolist() == want


def test_components(spark):
    r = random.Random(5)
    rows = []
    for k in range(25):
        fp = r.getrandbits(64)
        for _ in range(r.randint(1, 7)):
            rows.append((r.randrange(10**6), fp))
            fp ^= sum(1 << b for b in r.sample(range(64), r.randint(0, 3)))
    want = sorted(zip([x[0] for x in rows], brute_components(rows), strict=True))
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in rows]
    df = spark.createDataFrame(signed, "doc_id long, fp long")
    found = simhash.near_components(df, 2)
    assert sorted(map(tuple, df.join(found, "fp").select("doc_id", "component_id").collect())) == want
    own = df.select("fp").distinct()
    # hot keys dealt again give the same components
    from namespotter.llm.graph import components
    a = {x["node"]: x["root"] for x in components(simhash.near_links(own, 2)).collect()}
    b = {x["node"]: x["root"] for x in components(simhash.near_links(own, 2, hot_key=2, bucket_rows=5)).collect()}
    assert a == b and a


def test_documents(spark, texts):
    docs = spark.createDataFrame([(i, t, "x", "clash") for i, t in enumerate(texts)] + [(None, "alone with no id here", "x", "y")],
                                 "doc_id long, text string, fingerprint string, fp string")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert got[0]["component_id"] == got[1]["component_id"] == got[2]["component_id"] == 0
    assert got[5]["component_id"] == got[6]["component_id"] == got[10]["component_id"] == 5
    assert got[0]["fingerprint"] == "0" * 16
    kept = simhash.first_of_each_group(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {0, 5, None} <= set(ids) and not {1, 2, 6, 10} & set(ids)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
