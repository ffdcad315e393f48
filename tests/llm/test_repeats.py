import hashlib
import random
from collections import Counter

import numpy as np

from namespotter.llm import repeats


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i:i + length] = True
        edge = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        out.append((len(r), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~gone])).hexdigest()))
    return out


def made(seed=9):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abcdé \n") for _ in range(n))
    passages = [text(n) for n in (150, 199, 200, 230, 400, 900)]
    out = []
    for _ in range(60):
        t = text(r.randint(0, 500))
        for _ in range(r.randint(0, 2)):
            p = list(r.choice(passages))
            if r.random() < 0.4:
                p[r.randrange(len(p))] = "X"
            t += "".join(p) + text(r.randint(0, 300))
        out.append(t)
    return [*out, *out[:6], "ab" * 700, "x" * 450, text(300) + "y" * 205, passages[4][:250] + "z"]


def test_against_brute_force(spark, texts):
    rows = [*texts[:9], *texts[10:], "word " * 60, *made()]
    want = brute(rows, 200)
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").selectExpr("*", "'x' n_spans", "'y' marks", "'z' context").repartition(3)
    for bounds in ({}, {"hot_contexts": 1}, {"index_bytes": 4000, "filter_bytes": 64}):
        got = {r["doc_id"]: tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in repeats.with_repeats(d, **bounds).collect()}
        assert [got[i] for i in range(len(rows))] == want
    assert repeats.with_repeats(d.limit(0)).count() == 0


def test_matches_of_any_length():
    r = random.Random(2)
    for n in (3, 5, 8, 13):
        contents = ["".join(r.choice("ab") for _ in range(r.randint(n, 30))).encode() for _ in range(12)]
        seen = Counter(c[i:i + n] for c in contents for i in range(len(c) - n + 1))
        got = repeats.matches(contents, n)
        assert [m.tolist() for m in got] == [[seen[c[i:i + n]] > 1 for i in range(len(c) - n + 1)] for c in contents]


def test_runs_are_sampled_sparsely():
    """Near copies share runs: samples grow with the differences, not the bytes."""
    base = bytes(random.Random(1).choices(range(97, 123), k=336))
    copies = [base[:i] + b"!" + base[i + 1:] for i in range(0, 336, 12)]
    assert all(len(m) == 137 for m in repeats.matches(copies))


def test_covered_bytes_equal_brute_force():
    r = random.Random(8)
    for length in (3, 7):
        size, starts, bits, want = 90, [], [], np.zeros(90, bool)
        for _ in range(r.randint(0, 9)):
            n = r.randint(1, 20)
            s, own = r.randint(0, size - n - length + 1), [r.random() < 0.5 for _ in range(n)]
            starts.append(s)
            bits.append(np.packbits(own).tobytes())
            for i in np.flatnonzero(own):
                want[s + i:s + i + length] = True
        assert (repeats._covered(size, starts, bits, length) == want).all()
    assert not repeats._covered(5, [], [], 3).any()


def test_a_context_is_written_once_in_a_batch_and_densely(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 2_000)
    r = random.Random(4)
    text = "".join(r.choice("abcdefgh ") for _ in range(900))
    d = spark.createDataFrame([(text,)] * 30, "text string").coalesce(1)
    shared = spark.sparkContext.broadcast(repeats._repeated_anchors(d, "text", 200, 4, repeats.FILTER_BYTES))
    found = repeats._contexts(d, "text", 200, shared).collect()
    kinds = {bytes(x["context"]) for x in found}
    assert len(found) == 30 * len(kinds) and sum(x["content"] is not None for x in found) == len(kinds)


def test_written_tables_are_dense(spark):
    import pyarrow.parquet as pq

    from namespotter.session import written
    made = written(spark.range(50).coalesce(1), "dense")
    codecs = {pq.ParquetFile(f.removeprefix("file://")).metadata.row_group(0).column(0).compression for f in made.inputFiles()}
    assert codecs == {"ZSTD"} and made.count() == 50
