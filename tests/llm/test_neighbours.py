import numpy as np

from namespotter.llm import neighbours


def brute(ids, v, queries, k):
    out = {}
    for q in queries:
        s = [((-(v[i] * v[q]).sum()), ids[i]) for i in range(len(ids)) if ids[i] != ids[q]]
        out[ids[q]] = [(i, -x) for x, i in sorted(s)[:k]]
    return out


def test_factor_one_is_exact_and_default_recalls(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(1200, 16)) * rng.uniform(0.2, 3, size=(1200, 1))
    v[300:400] = v[300]  # one very common vector
    v = v.astype(np.float32).astype(float)
    ids = np.arange(1200)
    want = brute(ids, v, range(0, 1200, 20), 20)
    score, row = neighbours.VantageTree(v).search(v[::20], ids[::20], ids, 20, factor=1.0)
    for k, q in enumerate(range(0, 1200, 20)):
        assert list(zip(ids[row[k]], score[k])) == want[q]
    d = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], "vec_id long, embedding array<float>").selectExpr("*", "1 rank", "2 id")
    got = {}
    for r in neighbours.nearest(d, d.where("vec_id % 20 = 0"), shard_rows=300, query_rows=25).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(want)
    share = np.mean([len({x[0] for x in got[q]} & {x[0] for x in want[q]}) / 20 for q in want])
    assert share >= 0.9


def test_unusable_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [inf, 1.0]), (7, []),
            (20, [2.0, 1.0]), (40, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (60, [0.0, 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in neighbours.nearest(d, d.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 2.0), (0, 2, 20, 2.0), (20, 1, 1, 5.0), (20, 2, 0, 2.0)]
    assert neighbours.nearest(d.limit(0), d.limit(0)).count() == 0


def test_two_queries_of_one_id(spark):
    """Permuted vectors under one id are two queries, each with its own list; a row repeated whole is one."""
    rows = [(20, [1.0, 2.0]), (20, [2.0, 1.0]), (40, [0.5, 0.5]), (40, [0.5, 0.5]), (1, [1.0, 0.0]), (2, [0.0, 1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in neighbours.nearest(d, d.where("vec_id % 20 = 0"), k=2).collect())
    of = lambda q, v: sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q))[:2]
    want = [(q, r, i, -s) for q, v in (rows[0], rows[1], rows[2]) for r, (s, i) in enumerate(of(q, v), 1)]
    assert got == sorted(want)
    assert neighbours.hash_of([1, 2]) != neighbours.hash_of([2, 1])
