"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints that differ in at most ``radius`` bits agree in one of
``radius + 1`` blocks of bits, so each distinct fingerprint is dealt once per
block by that block's bits.  A task lays the fingerprints of its keys out as
bit planes (one packed row per bit) and compares every fingerprint with the
``s``-th next one of its key for all positions at once: a plane XOR its shifted
self is added into carry-save counters, and a shift is abandoned as soon as no
position of it can still be within the radius.  Linked fingerprints leave the
task as a spanning forest, never as all pairs.

A key that more than ``HOT_KEY`` distinct fingerprints share is dealt again by
that key and a block of the remaining bits, so no task gets an unbounded group
and no link is lost.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .common import per_document, spaced_words, table
from .graph import components

HOT_KEY = 8192
#: Keyed fingerprints for one task.
BUCKET_ROWS = 20_000
LEVELS = 3


# ------------------------------------------------------------ fingerprints
def fingerprint(raw: bytes, size: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the ``size``-word shingles, repeats included; zero without words."""
    w = spaced_words(raw)
    if not w:
        return 0
    if len(w) < size:
        return xxhash.xxh64_intdigest(b" ".join(w), seed)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(size)), strict=False))
    n = len(w) - size + 1
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, n).astype(">u8").view(np.uint8).reshape(n, 8)
    ones = sum(np.unpackbits(h[i:i + 65536], axis=1).sum(axis=0, dtype=np.int64) for i in range(0, n, 65536))
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def with_fingerprint(docs: DataFrame, size: int = 3, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``fp`` (the fingerprint as a signed long)."""
    def start():
        return lambda texts: [np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64)]

    return per_document(docs, [("fp", T.LongType(), pa.int64())], start, text_col, keep)


# ------------------------------------------------------------ bit-sliced comparison
def _planes(fps: np.ndarray) -> list[np.ndarray]:
    """Bit planes packed at each of the eight bit offsets, so that any shift is a byte offset of one of them."""
    bits = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).T
    return [np.packbits(np.pad(bits[:, k:], ((0, 0), (0, k))), axis=1) for k in range(8)]


def links_at(planes: list[np.ndarray], same: np.ndarray, shift: int, radius: int) -> np.ndarray:
    """Positions i whose fingerprint is within ``radius`` bits of that at i + shift, where ``same`` allows it."""
    n = len(same)
    width = (n + 7) // 8
    still = np.packbits(same)
    moved = planes[shift % 8][:, shift // 8: shift // 8 + width]
    counters = [np.zeros(width, np.uint8) for _ in range(radius.bit_length())]
    over = np.zeros(width, np.uint8)
    for k in range(64):
        carry = planes[0][k, :width] ^ moved[k]
        for c in counters:
            carry, c[:] = c & carry, c ^ carry
        over |= carry
        if k % 8 == 7:
            more, equal = over.copy(), ~over
            for b in reversed(range(len(counters))):
                if radius >> b & 1:
                    equal &= counters[b]
                else:
                    more |= equal & counters[b]
                    equal &= ~counters[b]
            still &= ~more
            if not still.any():
                return np.empty(0, np.int64)
    return np.flatnonzero(np.unpackbits(still, count=n))


def forest(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links between fingerprints that share a key."""
    _, group, counts = np.unique(keys, return_inverse=True, return_counts=True)
    parent = np.arange(len(fps))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    floor = 1
    while floor < counts.max():  # groups of floor + 1 to 2 * floor members, so that a shift reads no small group
        own = counts[group]
        at = np.flatnonzero((own > floor) & (own <= 2 * floor))
        if len(at):
            at = at[np.argsort(group[at], kind="stable")]
            planes, g = _planes(fps[at]), group[at]
            for s in range(1, min(2 * floor, len(at))):
                same = g[:-s] == g[s:]
                pos = links_at(planes, same, s, radius) if same.any() else at[:0]
                i, j = at[pos], at[pos + s]
                open_ = parent[i] != parent[j]
                for a, b in zip(i[open_].tolist(), j[open_].tolist(), strict=True):
                    a, b = root(a), root(b)
                    parent[max(a, b)] = min(a, b)
                while len(pos) and (parent != parent[parent]).any():
                    parent = parent[parent]
        floor *= 2
    child = np.flatnonzero(parent != np.arange(len(fps)))
    return fps[child], fps[parent[child]]


# ------------------------------------------------------------ keys
def _blocks(bits: list[int], n: int) -> list[list[int]]:
    return [list(map(int, b)) for b in np.array_split(bits, n)]


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def key_masks(radius: int, level: int) -> list[tuple[str, int]]:
    """(name, mask) of every key of a level; the names of its children start with its own."""
    found = [("", [], list(range(64)))]
    for _ in range(level):
        found = [(f"{name}{k}.", [*fixed, *b], [x for x in free if x not in b])
                 for name, fixed, free in found for k, b in enumerate(_blocks(free, radius + 1))]
    return [(name, _mask(fixed)) for name, fixed, _ in found]


def _keyed(fps: DataFrame, radius: int, level: int) -> DataFrame:
    """fp, parent (key of the level above), key."""
    above = dict(key_masks(radius, level - 1))
    entry = [F.struct(F.xxhash64(F.lit(name[:-2]), F.col("fp").bitwiseAND(F.lit(above[name[:-2]]))).alias("parent"),
                      F.xxhash64(F.lit(name), F.col("fp").bitwiseAND(F.lit(mask))).alias("key"))
             for name, mask in key_masks(radius, level)]
    return fps.select("fp", F.inline(F.array(*entry)))


def _linked(keyed: DataFrame, radius: int, buckets: int) -> DataFrame:
    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = forest(pdf["key"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64), radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = keyed.select("fp", "key", F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"))
    return dealt.groupBy("bucket").applyInPandas(link, "a long, b long")


def near_links(fps: DataFrame, radius: int, hot_key: int = HOT_KEY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (a, b) whose components are those of all links within ``radius`` among the distinct ``fp``."""
    n = fps.count()
    links = None
    pool = _keyed(fps, radius, 1)
    for level in range(1, LEVELS + 1):
        sizes = pool.groupBy("key").count()
        hot = sizes.where(F.col("count") > hot_key).select("key")
        last = level == LEVELS or hot.isEmpty()
        now = pool if last else pool.join(hot, "key", "left_anti")
        made = _linked(now, radius, 1 + n * (radius + 1) // bucket_rows)
        links = made if links is None else links.unionByName(made)
        if last:
            return links
        again = pool.join(hot, "key", "left_semi").select("fp", F.col("key").alias("parent"))
        pool = _keyed(again.select("fp").distinct(), radius, level + 1).join(again, ["fp", "parent"], "left_semi")
    return links


def near_components(fps: DataFrame, radius: int = 2, id_col: str = "doc_id") -> DataFrame:
    """``fp, group_fp, component_id`` for every distinct ``fp`` of ``fps(id_col, fp)``.

    ``group_fp`` names the component, ``component_id`` is its smallest id (null
    only if all its ids are null).  An empty table gives an empty one.
    """
    own = written(fps.groupBy("fp").agg(F.min(id_col).alias("id")), "fingerprints")
    roots = components(near_links(own.select("fp"), radius))
    named = own.join(roots, own["fp"] == roots["node"], "left").select(
        "fp", "id", F.coalesce("root", "fp").alias("group_fp"))
    low = named.groupBy("group_fp").agg(F.min("id").alias("component_id"))
    return named.join(low, "group_fp").select("fp", "group_fp", "component_id")


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 2, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    Null and empty texts have the fingerprint zero and link like any other;
    repeated rows are returned as often as they occur.
    """
    fps = written(with_fingerprint(docs.select(id_col, text_col), size, text_col, keep=[id_col]), "simhash")
    found = near_components(fps, radius, id_col)
    return fps.join(found, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, radius=2)


def first_of_each_group(docs: DataFrame, size: int = 3, radius: int = 2, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of each group of near-duplicates, the one with the smallest id, with the columns of ``docs``."""
    columns = docs.columns
    named = [f"c{i}" for i in range(len(columns))]  # so that no input column can clash
    base = docs.toDF(*named).withColumn("rid", F.monotonically_increasing_id())
    text, ident = named[columns.index(text_col)], named[columns.index(id_col)]
    base = written(with_fingerprint(base, size, text), "simhash")
    groups = near_components(base.select(ident, "fp"), radius, ident)
    first = (base.select("rid", ident, "fp").join(groups, "fp").groupBy("group_fp")
             .agg(F.min_by("rid", F.struct(F.col(ident).isNull(), ident, "rid")).alias("rid")))
    return base.join(first, "rid", "left_semi").select(*named).toDF(*columns)
