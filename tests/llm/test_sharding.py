import zlib
from collections import Counter

from namespotter.llm import sharding


def test_placement(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "x"), (3, "again"), (3, "again")] + [(1000 + i, f"t{i}") for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' shard", "'y' cell")
    got = sharding.placement(d).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted(
        (str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 40) and r["law"] == "key"
    assert set(by) == set(range(40)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert len({r["shard"] for r in got if r["doc_id"] == 3}) == 1
    moved = sum(r["grown_shard"] == 40 for r in got)
    assert 40 < moved < 120 and min(len(v) for v in by.values()) > 40
    assert sharding.placement(d.limit(0)).count() == 0


def test_weights_confine_movement(spark):
    rack = lambda name, *shards: sharding.Node(name, tuple(shards))
    s = sharding.Shard

    def tree(w):
        return sharding.Node("root", (sharding.Node("a", (rack("x", s(0), s(1)), rack("y", s(2), s(3, w)))),
                                      sharding.Node("b", (rack("x", s(4), s(5)), rack("y", s(6), s(7))))))

    d = sharding.assign_shards(sharding.assign_shards(spark.range(6000).withColumnRenamed("id", "doc_id"), tree(1.0)), tree(3.0), name="later")
    moves = Counter((r["shard"], r["later"]) for r in d.collect() if r["shard"] != r["later"])
    # no key moves between shards of region b, nor from a to b; within a only into the heavier rack or shard
    assert not any(x >= 4 and y >= 4 or x < 4 <= y for x, y in moves)
    assert not any(x in (2, 3) and y in (0, 1) for x, y in moves)
    later = Counter(r["later"] for r in d.collect())
    assert abs(later[3] / 6000 - 0.3) < 0.04 and abs(later[0] / 6000 - 0.1) < 0.03
