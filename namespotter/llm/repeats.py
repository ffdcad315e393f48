"""Removal of long repeated byte strings by run-length compressed indexes.

Two places hold the same ``length``-byte window only if they hold the same
anchor: of the window's ``GRAM``-byte substrings, the leftmost one of least hash.
So windows need comparing within one anchor only:

1. Tasks send the anchors' hashes to buckets; anchors that occur twice enter a
   Bloom filter of fixed size (where it fills, more anchors pass, and none is lost).
2. Each run of windows with the same anchor is a context, a string of at most
   ``2 * length`` bytes.  Contexts of anchors in the filter are written with
   their place; equal contexts become one with a count.
3. A bucket's task sorts the suffixes of its contexts, run-length compresses
   their Burrows-Wheeler transform and samples the matches at the ends of its
   runs.  Streaming along the contexts, the match of each position is its sample
   or the last position's less one; windows whose match is ``length`` or more
   occur elsewhere, and so do all windows of a context that occurs twice.
4. The marked spans go back to the texts.

An anchor with more than ``HOT_CONTEXTS`` different contexts would make a large
index in one task; its windows are counted by their 128-bit hashes instead.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .common import per_document, runs, table
from .lmscore import Filter, _merged, _run_rows, _unpack, mix, segment

LENGTH = 200
GRAM = 64
FILTER_BYTES = 64 << 20
BITS_PER_ANCHOR = 12
BUCKET_BYTES = 8 << 20
#: Context bytes of one index.
INDEX_BYTES = 2 << 20
HOT_CONTEXTS = 2048
#: Text that a task looks at together (a longer one goes alone).
CHUNK = 1 << 20

_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOW = np.uint64(0xFFFFFFFF)


# ------------------------------------------------------------ anchors
def _powers(x: int, n: int) -> np.ndarray:
    out = np.full(n, x, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Anchors:
    """Contexts of texts: runs of windows that share their anchor."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram = length, gram
        self.up = self.down = np.empty(0, np.uint64)

    def __call__(self, data: np.ndarray, ends: np.ndarray):
        """(hash of the anchor, first window, last window) of every context in joined texts."""
        n, windows = len(data), len(data) - self.length + 1
        none = np.empty(0, np.int64)
        if windows <= 0:
            return none.view(np.uint64), none, none
        if len(self.up) < n:
            self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * self.down[:n])))
        h = mix((total[self.gram:] - total[:-self.gram]) * self.up[:n - self.gram + 1])
        least = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        width, have = self.length - self.gram + 1, 1
        while have < width:
            step = min(have, width - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        text = np.searchsorted(ends, np.arange(n), side="right")
        at = np.where(text[:windows] == text[self.length - 1:], (least & _LOW).astype(np.int64), -1)
        edge = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.append(edge[1:], windows) - 1
        own = at[edge] >= 0
        return h[at[edge[own]]], edge[own], last[own]


def _joined(texts: list[bytes]):
    """(joined texts, their ends, index of the first) of about CHUNK bytes at a time."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK):
            size += len(texts[j])
            j += 1
        yield np.frombuffer(b"".join(texts[i:j]), np.uint8), np.cumsum([len(t) for t in texts[i:j]]), i
        i = j


def _texts(batch) -> list[bytes]:
    return [x or b"" for x in batch.column(0).cast(pa.binary()).to_pylist()]


def _repeated_anchors(docs: DataFrame, text_col: str, length: int, buckets: int, filter_bytes: int) -> Filter:
    def send(batches):
        find = Anchors(length)
        for b in batches:
            for data, ends, _ in _joined(_texts(b)):
                keys, counts = np.unique(find(data, ends)[0], return_counts=True)
                rows = _run_rows(keys, buckets, np.minimum(counts, 2))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))],
                                                 names=["bucket", "keys", "counts"])

    def twice(pdf: pd.DataFrame) -> pd.DataFrame:
        n = [len(x) // 8 for x in pdf["keys"]]
        keys, counts = _merged(np.frombuffer(b"".join(pdf["keys"]), np.uint64), np.concatenate([_unpack(c, m) for c, m in zip(pdf["counts"], n, strict=True)]))
        keys = keys[counts > 1]
        return pd.DataFrame({"bucket": [int(pdf["bucket"].iloc[0])], "n": [len(keys)], "keys": [keys.tobytes()]})

    sent = docs.select(text_col).mapInArrow(send, "bucket int, keys binary, counts binary")
    found = written(sent.groupBy("bucket").applyInPandas(twice, "bucket int, n long, keys binary"), "anchors")
    n = found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    if not n:
        return Filter([b""] * buckets, 0)
    width = 64 + min(n * BITS_PER_ANCHOR, filter_bytes * 8) // buckets // 64 * 64

    def build(batches):
        for b in batches:
            for k, keys in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keys = np.frombuffer(keys, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([segment(keys, np.ones(len(keys), np.int64), width)], pa.binary())],
                                                 names=["bucket", "bits"])

    made = {r["bucket"]: bytes(r["bits"]) for r in found.select("bucket", "keys").mapInArrow(build, "bucket int, bits binary").toLocalIterator()}
    return Filter([made.get(k, bytes(width // 8)) for k in range(buckets)], width)


def _contexts(docs: DataFrame, text_col: str, length: int, shared) -> DataFrame:
    """text (hash), start, context (hash), anchor and, once in a batch, content of every context to compare."""
    def run(batches):
        find, known = Anchors(length), shared.value
        for b in batches:
            seen = set()
            for data, ends, _ in _joined(_texts(b)):
                key, first, last = find(data, ends)
                keep = np.flatnonzero(known.level(key, 1))
                key, first, last = key[keep], first[keep], last[keep]
                own = np.searchsorted(ends, first, side="right")
                starts = np.concatenate(([0], ends))
                raw, named = data.tobytes(), {}
                text, content, context = [], [], []
                for t, a, z in zip(own.tolist(), first.tolist(), last.tolist(), strict=True):
                    if t not in named:
                        named[t] = xxhash.xxh3_128_digest(raw[starts[t]:ends[t]])
                    c = raw[a:z + length]
                    h = xxhash.xxh3_128_digest(c)
                    text.append(named[t])
                    context.append(h)
                    content.append(None if h in seen else c)
                    seen.add(h)
                yield pa.RecordBatch.from_arrays([pa.array(text, pa.binary()), pa.array(first - starts[own], pa.int64()), pa.array(context, pa.binary()),
                                                  pa.array(key.view(np.int64)), pa.array(content, pa.binary())],
                                                 names=["text", "start", "context", "anchor", "content"])

    return docs.select(text_col).mapInArrow(run, "text binary, start long, context binary, anchor long, content binary")


# ------------------------------------------------------------ index
def _order(data: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Lexicographic ranks of all suffixes of the contexts (equal ones share a rank), by doubling from seven bytes."""
    n, key = len(data), np.zeros(len(data), np.int64)
    for i in range(7):
        byte = np.zeros(n, np.int64)
        byte[:n - i] = data[i:].astype(np.int64) + 1
        key = key << 9 | np.where(left > i, byte, 0)
    rank, have, most = np.unique(key, return_inverse=True)[1], 7, int(left.max(initial=0))
    while have < most:
        after = np.zeros(n, np.int64)
        inside = np.flatnonzero(left > have)
        after[inside] = rank[inside + have] + 1
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1]
        have *= 2
    return rank


def _common(data: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Longest common prefixes of suffixes a and b within their contexts."""
    most, out = np.minimum(left[a], left[b]), np.zeros(len(a), np.int64)
    active = np.arange(len(a))
    while len(active):
        more = out[active] < most[active]
        active = active[more]
        same = data[a[active] + out[active]] == data[b[active] + out[active]]
        active = active[same]
        out[active] += 1
    return out


def matches(contents: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For every window of each content: does it occur elsewhere in the contents?"""
    sizes = np.array([len(c) for c in contents])
    data = np.frombuffer(b"".join(contents), np.uint8)
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(data))
    order = np.argsort(_order(data, left), kind="stable")
    order = order[left[order] >= length]  # shorter suffixes begin no window
    # the transform: the byte before each suffix, of its own for the first of a context
    first = ends - sizes
    before = data[order - 1].astype(np.int64)
    opening = np.isin(order, first)
    before[opening] = 256 + np.arange(opening.sum())
    head = 1 + np.flatnonzero(before[1:] != before[:-1])  # run-length compressed: where runs begin
    above, below = order[head - 1], order[head]  # samples: the last suffix of a run and the first of the next
    sampled = np.zeros(len(data), np.int64)
    common = _common(data, left, above, below)
    np.maximum.at(sampled, above, common)
    np.maximum.at(sampled, below, common)
    place = np.arange(len(data))
    match = np.maximum.accumulate(sampled + place) - place
    return [match[a:a + n - length + 1] >= length for a, n in zip(first, sizes, strict=True)]


def _marked(distinct: DataFrame, length: int, index_bytes: int, hot_contexts: int) -> DataFrame:
    """context, bits: the windows of each context that occur elsewhere (contexts without any are left out)."""
    sizes = distinct.groupBy("anchor").agg(F.count("*").alias("kinds"), F.max("n").alias("most"), F.sum(F.octet_length("content")).alias("bytes"))
    sizes = written(sizes.where("kinds > 1 OR most > 1"), "groups")
    total = sizes.where("kinds > 1").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    buckets = 1 + total // index_bytes
    rows = distinct.join(sizes.select("anchor", "kinds"), "anchor")

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [m | (n > 1) for m, n in zip(matches(pdf["content"].to_list(), length), pdf["n"], strict=True)]
        own = [k for k, m in enumerate(found) if m.any()]
        return pd.DataFrame({"context": pdf["context"].iloc[own], "bits": [np.packbits(found[k]).tobytes() for k in own]})

    def every(batches):
        for b in batches:
            bits = [np.packbits(np.ones(n - length + 1, bool)).tobytes() for n in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits, pa.binary())], names=["context", "bits"])

    alone = rows.where("kinds = 1").select("context", F.octet_length("content").alias("size")).mapInArrow(every, "context binary, bits binary")
    many = rows.where((F.col("kinds") > 1) & (F.col("kinds") <= hot_contexts)).withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
    out = alone.unionByName(many.groupBy("bucket").applyInPandas(index, "context binary, bits binary"))
    hot = rows.where(F.col("kinds") > hot_contexts)
    return out if hot.isEmpty() else out.unionByName(_counted_windows(hot, length))


def _counted_windows(hot: DataFrame, length: int) -> DataFrame:
    """The same for contexts of hot anchors: each window is counted by its 128-bit hash."""
    def windows(batches):
        for b in batches:
            at = {c: i for i, c in enumerate(b.schema.names)}
            for context, content, n in zip(*(b.column(at[c]).to_pylist() for c in ("context", "content", "n")), strict=True):
                m = len(content) - length + 1
                yield pa.RecordBatch.from_arrays([pa.array([context] * m, pa.binary()), pa.array(range(m), pa.int32()), pa.array([m] * m, pa.int32()), pa.array([n] * m, pa.int64()),
                                                  pa.array([xxhash.xxh3_128_digest(content[i:i + length]) for i in range(m)], pa.binary())],
                                                 names=["context", "i", "windows", "n", "hash"])

    rows = written(hot.select("context", "content", "n").mapInArrow(windows, "context binary, i int, windows int, n long, hash binary"), "windows")
    twice = rows.groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1").select("hash")

    def pack(found, m):
        bits = np.zeros(m, bool)
        bits[np.asarray(found)] = True
        return np.packbits(bits).tobytes()

    packed = F.udf(pack, "binary")  # one call per context
    return rows.join(twice, "hash").groupBy("context").agg(F.collect_list("i").alias("found"), F.first("windows").alias("m")).select("context", packed("found", "m").alias("bits"))


# ------------------------------------------------------------ texts
def _covered(size: int, starts: list[int], bits: list[bytes], length: int) -> np.ndarray:
    """Bytes of a text that a marked window covers."""
    change = np.zeros(size + 1, np.int64)
    # a run of windows covers one stretch; the bits of a place end in a zero, so runs of different places stay apart
    rows = [np.frombuffer(b + b"\0", np.uint8) for b in bits]
    first = np.cumsum([0, *(8 * len(r) for r in rows)])[:-1]
    a, z = runs(np.unpackbits(np.concatenate(rows))) if rows else (first, first)
    shift = (np.asarray(starts, np.int64) - first)[np.searchsorted(first, a, side="right") - 1] if len(a) else a
    np.add.at(change, a + shift, 1)
    np.add.at(change, z + shift + length - 1, -1)
    return np.cumsum(change)[:-1] > 0


def with_repeats(docs: DataFrame, length: int = LENGTH, text_col: str = "text", keep: list[str] | None = None, filter_bytes: int = FILTER_BYTES,
                 index_bytes: int = INDEX_BYTES, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """Add ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``spans``
    (``start:end`` in bytes, comma-joined): what is left of each text, as UTF-8
    bytes, without the bytes that a ``length``-byte string covers which starts
    anywhere else too, in the same text or another.

    Null and empty texts and texts shorter than ``length`` lose nothing; a text
    that occurs in several rows repeats in each of them.
    """
    spark = docs.sparkSession
    kept = [c for c in (docs.columns if keep is None else keep) if c not in {"n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"}]
    named = {c: f"c{i}" for i, c in enumerate(kept)}
    docs = docs.select(*[F.col(c).alias(n) for c, n in named.items()], F.col(text_col).alias("own_text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("own_text")), F.lit(0)).alias("n")).first()["n"]
    shared = spark.sparkContext.broadcast(_repeated_anchors(docs, "own_text", length, 4 + size // BUCKET_BYTES, filter_bytes))
    found = written(_contexts(docs, "own_text", length, shared), "contexts")
    distinct = written(found.groupBy("context").agg(F.first("anchor").alias("anchor"), F.max("content").alias("content"), F.count("*").alias("n")), "distinct")
    marked = written(_marked(distinct, length, index_bytes, hot_contexts), "marked")
    places = found.select("text", "start", "context").distinct().join(marked, "context")
    by_text = places.groupBy("text").agg(F.collect_list(F.struct("start", "bits")).alias("marks"))  # one text's own marks

    def spans(pdf_iter):
        for b in pdf_iter:
            at = {c: i for i, c in enumerate(b.schema.names)}
            texts = [x or b"" for x in b.column(at["own_text"]).cast(pa.binary()).to_pylist()]
            out = [[] for _ in range(5)]
            for raw, marks in zip(texts, b.column(at["marks"]).to_pylist(), strict=True):
                gone = _covered(len(raw), [m["start"] for m in marks], [m["bits"] for m in marks], length) if marks else np.zeros(len(raw), bool)
                a, z = runs(gone)
                for o, v in zip(out, (len(raw), int(gone.sum()), len(a), hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest(),
                                      ",".join(f"{x}:{y}" for x, y in zip(a, z, strict=True))), strict=True):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([*(b.column(at[c]) for c in named.values()), *(pa.array(x) for x in out[:3]), *(pa.array(x, pa.string()) for x in out[3:])],
                                             names=[*named.values(), "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    def start():
        return lambda texts: [[xxhash.xxh3_128_digest(t) for t in texts]]

    keyed = per_document(docs, [("text_key", T.BinaryType(), pa.binary())], start, "own_text")
    both = keyed.join(by_text, keyed["text_key"] == by_text["text"], "left").select(*named.values(), "own_text", "marks")
    schema = T.StructType([docs.schema[n] for n in named.values()] + [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
                          + [T.StructField(n, T.StringType()) for n in ("kept_sha256", "spans")])
    return both.mapInArrow(spans, schema).toDF(*kept, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_repeats(docs, keep=["doc_id"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
