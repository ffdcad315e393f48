"""Language-model scoring with a log-frequency Bloom filter.

Counts of the training tokens' n-grams are gathered order by order: tasks send
sorted runs of (key, count) to hash buckets, and a bucket's task merges them.
An n-gram of order two or more is counted only where both of its shorter parts
occur twice (no other can), and kept if it occurs ``MIN_COUNT`` times.

A bucket's kept n-grams become one segment of the filter: an n-gram of count c
enters as the events (key, 1) to (key, level of c), levels being logarithmic in
c, and its quantised count is read back by probing level after level until one
is missing.  Each
context h also holds its kept total K(h) and its kept types T(h) in this way.
The filter holds every kept n-gram, so its bits grow with them.  Its segments are
broadcast in groups: those that fit ``OPEN_BYTES`` stay open in a task, the
others are opened one at a time for each ``ROUND`` of text.

The score interpolates (Witten-Bell) from the unigrams up:
``P(w|h) = (c(hw) + B(h) P(w|h')) / (K(h) + B(h))`` with
``B(h) = T(h) + c(h) - K(h)``, down to ``(c + 0.5) / (N + 0.5 (V + 1))``.

The base score needs exact unigram counts.  The most frequent words (at most
``HEAD_WORDS``) are broadcast with them; the rest of the tokens join the count
table by key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .common import long_field, per_document, table

ORDER = 3
MIN_COUNT = 2
#: Filter bits that a task keeps open; the rest is read group by group.
OPEN_BYTES = 16 << 20
#: Segments that are broadcast, and opened, together.
GROUP_BYTES = 8 << 20
HEAD_WORDS = 1 << 20
BITS_PER_EVENT = 12
HASHES = 3
#: Training text for one bucket.
BUCKET_BYTES = 8 << 20
#: Text a task works on at a time (a longer one goes alone).
CHUNK = 2 << 20
#: Text that is hashed at a time: eight bytes for each, several times over.
HASHED = 256 << 10
#: Keys that are probed at a time.
PROBED = 1 << 15
#: The same where some groups of the filter do not stay open.
ROUND = 4 << 20
LEVELS = 100

END = 0x2545F4914F6CDD1D
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_S = [np.uint64(x) for x in range(64)]


# ------------------------------------------------------------ keys
def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _S[30])
    x *= _M2
    x ^= x >> _S[27]
    x *= _M3
    x ^= x >> _S[31]
    return x


_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * _M1)
_BASE = int(_M1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def powers(x: int, n: int) -> np.ndarray:
    """1, x, x^2, ... modulo 2^64."""
    out = np.full(n, x, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


class Tokens:
    """64-bit hashes of the words of texts, many texts at a time: polynomials over
    random letter values, by one running sum over the joined bytes."""

    def __init__(self):
        self.up = self.down = np.empty(0, np.uint64)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts, each with its end, and each text's number of them."""
        data = np.frombuffer(b"\n".join(texts).lower(), np.uint8)
        if len(self.up) <= len(data):
            self.up, self.down = powers(_BASE, len(data) + 1), powers(pow(_BASE, -1, 1 << 64), len(data) + 1)
        edge = np.diff(np.concatenate(([True], _SPACE[data], [True])).astype(np.int8))
        first, past = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTER[data] * self.up[:len(data)])))
        h = mix((total[past] - total[first]) * self.down[first] ^ (past - first).astype(np.uint64) * _M3)
        until = np.searchsorted(first, np.cumsum([len(t) + 1 for t in texts]))
        text = np.repeat(np.arange(len(texts)), np.diff(until, prepend=0))
        out = np.full(len(h) + len(texts), END, np.uint64)
        out[np.arange(len(h)) + text] = h
        return out, np.bincount(text, minlength=len(texts)) + 1


def context_of(key: np.ndarray) -> np.ndarray:
    """The 36 bits by which an n-gram names the context before its last word."""
    return mix(key + _M1) >> _S[28]


def longer(key_before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of the n-grams made of the n-1-gram that ends before a word, and the word."""
    return (context_of(key_before) << _S[28]) | (mix(key_before * _M1 ^ word) >> _S[36])


def _cut(texts: list[bytes], size: int) -> Iterator[list[bytes]]:
    """Consecutive texts of about ``size`` bytes together."""
    held, n = [], 0
    for t in texts:
        if held and n + len(t) > size:
            yield held
            held, n = [], 0
        held.append(t)
        n += len(t)
    if held:
        yield held


def rounds(texts: list[bytes], tokens: Tokens, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(tokens, number of each text) of consecutive texts of about ``size`` bytes together, hashed ``HASHED`` bytes at a time."""
    for held in _cut(texts, size):
        yield tuple(map(np.concatenate, zip(*map(tokens, _cut(held, HASHED)), strict=True)))


def positions(lengths: np.ndarray) -> np.ndarray:
    """The place of every token in its text."""
    starts = np.cumsum(lengths) - lengths
    return np.arange(lengths.sum()) - np.repeat(starts, lengths)


# ------------------------------------------------------------ filter
def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(key ^ _M2) % np.uint64(buckets)).astype(np.int64)


def level_of(count: np.ndarray) -> np.ndarray:
    """1, 2 and 3 for themselves, then two levels for each doubling."""
    c = count.astype(np.int64)
    e = np.frexp(np.maximum(c, 1).astype(np.float64))[1] - 1
    half = (c >> np.maximum(e - 1, 0)) & 1
    return np.where(c < 4, c, 2 * e + half)


def least_at(level: np.ndarray) -> np.ndarray:
    """The least count of a level."""
    level = np.asarray(level, np.int64)
    e = level // 2
    return np.where(level < 4, level, (1 << e) + (level % 2) * (1 << np.maximum(e - 1, 0)))


def count_at(level: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level; zero at level zero."""
    return _MIDDLE[level]


_MIDDLE = (least_at(np.arange(LEVELS + 2)) + least_at(np.arange(1, LEVELS + 3)) - 1) / 2


_MASK = np.array([128 >> k for k in range(8)], np.uint8)


def _bits(key: np.ndarray, level, width: int) -> Iterator[np.ndarray]:
    a, b = _seeds(key, level)
    for j in range(HASHES):
        yield _bit(a, b, j, width)


def _seeds(key: np.ndarray, level) -> tuple[np.ndarray, np.ndarray]:
    a = mix(key + np.asarray(level, np.uint64) * _M1)
    return a, mix(a ^ _M3) | _S[1]


def _bit(a: np.ndarray, b: np.ndarray, j: int, width: int) -> np.ndarray:
    return ((a + _S[j] * b) % np.uint64(width)).view(np.int64)


def segment(keys: np.ndarray, counts: np.ndarray, width: int) -> bytes:
    """The filter bits of a bucket's keys."""
    bits = np.zeros(width, np.uint8)
    levels = level_of(counts)
    for j in range(1, int(levels.max(initial=0)) + 1):
        own = keys[levels >= j]
        for at in _bits(own, j, width):
            bits[at] = 1
    return np.packbits(bits).tobytes()


class Filter:
    """Segments of one kind of key, read by probes.

    ``groups`` are bytes or broadcasts of bytes.  The segment of bucket b is the one at ``place[b]`` of
    group ``group[b]`` (-1: no key).  The first ``kept`` groups stay open, the others are opened for a probe.
    """

    def __init__(self, segments: list[bytes], width: int):
        n = len(segments)
        self.buckets, self.width, self.groups, self.kept = n, width, [b"".join(segments)], 1
        self._deal(np.zeros(n, np.int64), np.arange(n))

    def _deal(self, group: np.ndarray, place: np.ndarray) -> None:
        self.group, self.place = group, place
        # the buckets in the order of their bits; sixteen bits sort by counting
        self.order = np.lexsort((place, group))
        self.rank = np.empty(len(group), np.uint16 if len(group) < 1 << 16 else np.int64)
        self.rank[self.order] = np.arange(len(group))

    @classmethod
    def grouped(cls, width: int, groups: list, kept: int, group: np.ndarray, place: np.ndarray) -> Filter:
        out = cls([], width)
        out.buckets, out.groups, out.kept = len(group), groups, kept
        out._deal(group, place)
        return out

    @property
    def kept_bytes(self) -> int:
        return int(((self.group >= 0) & (self.group < self.kept)).sum()) * (self.width // 8)

    @property
    def whole(self) -> bool:
        return self.kept >= len(self.groups)

    def _opened(self, g: int) -> np.ndarray:
        held = self.groups[g]
        if isinstance(held, Broadcast):
            # the value of a broadcast stays in the worker
            held = held.value if g < self.kept or not held._path else held.load_from_path(held._path)
        return np.frombuffer(held, np.uint8)

    def level(self, keys: np.ndarray, most: int = LEVELS) -> np.ndarray:
        if not self.width:
            return np.zeros(len(keys), np.int64)
        keys, back = np.unique(keys, return_inverse=True)  # frequent keys go deep; once is enough
        return self.level_once(keys, most)[back]

    def level_once(self, keys: np.ndarray, most: int = LEVELS) -> np.ndarray:
        """The same, each key probed for itself."""
        out = np.zeros(len(keys), np.int64)
        if not self.width:
            return out
        # the keys of a bucket are probed together, while its bits are at hand
        rank = self.rank[bucket_of(keys, self.buckets)]
        order = np.argsort(rank, kind="stable")
        bucket = self.order[rank[order]]
        base, edge = self.place[bucket] * self.width, np.searchsorted(self.group[bucket], np.arange(len(self.groups) + 1))
        for g, (a, z) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
            if a < z:
                bits = self._opened(g)
                for lo in range(a, z, PROBED):
                    part = slice(lo, min(lo + PROBED, z))
                    out[order[part]] = self._probed(bits, keys[order[part]], base[part], most)
        return out

    def _probed(self, bits: np.ndarray, keys: np.ndarray, base: np.ndarray, most: int) -> np.ndarray:
        out, active = np.zeros(len(keys), np.int64), np.arange(len(keys))
        for j in range(1, most + 1):
            a, b = _seeds(keys, j)
            for i in range(HASHES):  # a bit that is missing saves the next ones
                at = base + _bit(a, b, i, self.width)
                hit = np.flatnonzero(bits[at >> 3] & _MASK[at & 7])
                if len(hit) < len(at):
                    a, b, keys, base, active = a[hit], b[hit], keys[hit], base[hit], active[hit]
            if not len(active):
                break
            out[active] = j
        return out

    def count(self, keys: np.ndarray) -> np.ndarray:
        return count_at(self.level(keys))

    def count_once(self, keys: np.ndarray) -> np.ndarray:
        return count_at(self.level_once(keys))


def chunk_for(filters: dict[str, Filter]) -> int:
    return CHUNK if all(f.whole for f in filters.values()) else ROUND


class Model:
    """filters: by order, of n-grams (1 to order) and contexts' K and T (2 to order);
    head: sorted keys and counts of the most frequent words; N and V."""

    def __init__(self, order, filters, head_keys, head_counts, tokens, types):
        self.order, self.filters = order, filters
        self.head_keys, self.head_counts = head_keys, head_counts
        self.tokens, self.types = tokens, types

    @property
    def chunk(self) -> int:
        """Bytes of text to score at a time."""
        return chunk_for(self.filters)

    def head(self, w: np.ndarray) -> np.ndarray:
        """Exact counts of frequent words, 0 for the others."""
        if not len(self.head_keys):
            return np.zeros(len(w), np.int64)
        at = np.minimum(np.searchsorted(self.head_keys, w), len(self.head_keys) - 1)
        return np.where(self.head_keys[at] == w, self.head_counts[at], 0)

    def log10(self, w: np.ndarray, place: np.ndarray, head: np.ndarray, words: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """log10 probability of every token; ``words`` are the distinct tokens and the number of each token's among them.

        Each distinct n-gram is probed once, and as a context once: ``own`` are those of an order, ``which``
        numbers the one that ends at each token."""
        own, which = np.unique(w, return_inverse=True) if words is None else words
        counts = np.zeros(len(own))
        counts[which] = head
        rare = np.flatnonzero(counts == 0)
        counts[rare] = self.filters["n1"].count_once(own[rare])
        count = counts[which]
        p = (count + 0.5) / (self.tokens + 0.5 * (self.types + 1))
        for n in range(2, self.order + 1):
            kept, types = np.zeros(len(own)), np.zeros(len(own))
            may = np.flatnonzero(counts > 0)
            kept[may] = self.filters[f"k{n}"].count_once(context_of(own[may]))
            may = np.flatnonzero(kept > 0)
            types[may] = self.filters[f"t{n}"].count_once(context_of(own[may]))
            at = np.flatnonzero(place >= n - 1)
            at = at[(count[at - 1] > 0) & (kept[which[at - 1]] > 0)]
            if not len(at):
                break
            before = which[at - 1]
            kept, back = kept[before], np.maximum(types[before], 1) + np.maximum(counts[before] - kept[before], 0)
            own, number = np.unique(longer(own[before], w[at]), return_inverse=True)
            seen = np.minimum(self.filters[f"n{n}"].count_once(own)[number], kept)
            p[at] = (seen + back * p[at]) / (kept + back)
            counts, count, which = np.zeros(len(own)), np.zeros(len(w)), np.zeros(len(w), np.int64)
            counts[number], count[at], which[at] = seen, seen, number
        return np.log10(np.minimum(p, 1.0))


# ------------------------------------------------------------ counting
_RUN = "bucket int, keys binary, counts binary"


def _merged(keys: np.ndarray, *values: np.ndarray):
    """Distinct keys, sorted, with the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], *(np.add.reduceat(v[order], first) if len(keys) else v for v in values)


def _run_rows(keys: np.ndarray, buckets: int, *values: np.ndarray) -> list[tuple]:
    """One (bucket, keys, values...) per bucket that has keys."""
    b = bucket_of(keys, buckets)
    order = np.argsort(b.astype(np.uint16) if buckets < 1 << 16 else b, kind="stable")
    edge = np.searchsorted(b[order], np.arange(buckets + 1))
    columns = [keys[order]] + [v[order].astype(np.uint32 if v.max(initial=0) < 1 << 32 else np.uint64) for v in values]
    return [(k, *(c[a:z].tobytes() for c in columns)) for k, (a, z) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)) if z > a]


def _unpack(raw, n: int) -> np.ndarray:
    """Counts of n keys, 32 or 64 bits each."""
    return np.frombuffer(raw, np.uint64 if len(raw) == 8 * n else np.uint32).astype(np.int64)


def _counted(train: DataFrame, n: int, buckets: int, filters, text_col: str) -> DataFrame:
    """Runs of the keys of order ``n`` that can occur twice."""
    def run(batches):
        words, known = Tokens(), filters
        for b in batches:
            texts = [x or b"" for x in b.column(0).cast(pa.binary()).to_pylist()]
            for w, lengths in rounds(texts, words, chunk_for(known)):
                key, place = w, positions(lengths)
                open_ = np.ones(len(w), bool)
                for m in range(2, n + 1):
                    # a token's m-gram is counted if both m-1-grams in it occur twice
                    twice = np.zeros(len(w), bool)
                    cand = np.flatnonzero(open_)
                    if m == 2:
                        twice[cand] = known["n1"].level(key[cand], 2) >= 2
                    else:
                        twice[cand] = known[f"n{m - 1}"].level(key[cand], 1) >= 1
                    open_ = np.concatenate(([False], twice[:-1])) & twice & (place >= m - 1)
                    at = np.flatnonzero(open_)
                    made = np.zeros_like(key)
                    made[at] = longer(key[at - 1], w[at])
                    key = made
                keys, counts = np.unique(key[open_], return_counts=True)
                rows = _run_rows(keys, buckets, counts)
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))],
                                                 names=["bucket", "keys", "counts"])

    return train.select(text_col).mapInArrow(run, _RUN)


def _bucket_counts(runs: DataFrame, least: int, contexts: int) -> DataFrame:
    """Per bucket: its keys of count ``least`` or more, the tokens and types before
    that cut, types by level, and partial K and T of contexts, dealt to ``contexts`` buckets."""
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        n = [len(x) // 8 for x in pdf["keys"]]
        keys, counts = _merged(np.frombuffer(b"".join(pdf["keys"]), np.uint64), np.concatenate([_unpack(c, m) for c, m in zip(pdf["counts"], n, strict=True)]))
        total, types = int(counts.sum()), len(keys)
        keep = counts >= least
        keys, counts = keys[keep], counts[keep]
        by_level = np.bincount(level_of(counts), minlength=LEVELS + 1)[:LEVELS + 1]
        c, k, t = _merged(keys >> _S[28], counts, np.ones(len(keys), np.int64)) if contexts else (keys[:0], counts[:0], counts[:0])
        return pd.DataFrame({"bucket": [int(pdf["bucket"].iloc[0])], "keys": [keys.tobytes()], "counts": [counts.tobytes()], "tokens": [total], "types": [types],
                             "by_level": [by_level.tolist()], "ctx": [c.tobytes()], "ctx_kept": [k.tobytes()], "ctx_types": [t.tobytes()]})

    return runs.groupBy("bucket").applyInPandas(merge, "bucket int, keys binary, counts binary, tokens long, types long, by_level array<long>, "
                                                       "ctx binary, ctx_kept binary, ctx_types binary")


def _context_totals(counts: DataFrame, buckets: int) -> DataFrame:
    """bucket, keys, kept, types: K and T of every context that a kept n-gram has."""
    def deal(batches):
        for b in batches:
            at = {c: i for i, c in enumerate(b.schema.names)}
            for c, k, t in zip(*(b.column(at[x]).to_pylist() for x in ("ctx", "ctx_kept", "ctx_types")), strict=True):
                rows = _run_rows(np.frombuffer(c, np.uint64), buckets, np.frombuffer(k, np.int64), np.frombuffer(t, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3))],
                                                 names=["bucket", "keys", "kept", "types"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        n = [len(x) // 8 for x in pdf["keys"]]
        values = [np.concatenate([_unpack(c, m) for c, m in zip(pdf[x], n, strict=True)]) for x in ("kept", "types")]
        keys, kept, types = _merged(np.frombuffer(b"".join(pdf["keys"]), np.uint64), *values)
        levels = [np.bincount(level_of(v), minlength=LEVELS + 1)[:LEVELS + 1].tolist() for v in (kept, types)]
        return pd.DataFrame({"bucket": [int(pdf["bucket"].iloc[0])], "keys": [keys.tobytes()], "kept": [kept.tobytes()], "types": [types.tobytes()],
                             "kept_level": [levels[0]], "types_level": [levels[1]]})

    dealt = counts.select("ctx", "ctx_kept", "ctx_types").mapInArrow(deal, "bucket int, keys binary, kept binary, types binary")
    return dealt.groupBy("bucket").applyInPandas(merge, "bucket int, keys binary, kept binary, types binary, kept_level array<long>, types_level array<long>")


def _levels(df: DataFrame, col: str) -> np.ndarray:
    """Keys by level over all buckets."""
    sums = df.agg(*[F.sum(F.col(col)[i]).alias(f"l{i}") for i in range(LEVELS + 1)]).first()
    return np.array([x or 0 for x in sums], np.int64)


def _events(by_level: np.ndarray) -> int:
    return int((by_level * np.arange(LEVELS + 1)).sum())


def _filter(df: DataFrame, value: str, buckets: int, events: int, room: int) -> Filter:
    """The segments of all buckets, BITS_PER_EVENT bits an event, gathered and broadcast a group at a time;
    groups of up to ``room`` bytes together stay open."""
    if not events:
        return Filter([b""] * buckets, 0)
    sc = df.sparkSession.sparkContext
    width = max(64, -(-events * BITS_PER_EVENT // buckets) // 64 * 64 + 64)

    def build(batches):
        for b in batches:
            at = {c: i for i, c in enumerate(b.schema.names)}
            for k, keys, values in zip(*(b.column(at[x]).to_pylist() for x in ("bucket", "keys", value)), strict=True):
                bits = segment(np.frombuffer(keys, np.uint64), np.frombuffer(values, np.int64), width)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([bits], pa.binary())], names=["bucket", "bits"])

    most = max(1, GROUP_BYTES // (width // 8))  # segments of a group
    groups, held = [], []
    group, place = np.full(buckets, -1, np.int64), np.zeros(buckets, np.int64)
    for r in df.select("bucket", "keys", value).mapInArrow(build, "bucket int, bits binary").toLocalIterator():
        group[r["bucket"]], place[r["bucket"]] = len(groups), len(held)
        held.append(bytes(r["bits"]))
        if len(held) == most:
            groups.append(sc.broadcast(b"".join(held)))
            held = []
    if held:
        groups.append(sc.broadcast(b"".join(held)))
    full = most * (width // 8)
    last = (len(held) or most) * (width // 8)
    kept = len(groups) if (len(groups) - 1) * full + last <= room else min(len(groups) - 1, room // full)
    return Filter.grouped(width, groups, kept, group, place)


def fit(train: DataFrame, order: int = ORDER, text_col: str = "text", open_bytes: int = OPEN_BYTES, head_words: int = HEAD_WORDS,
        bucket_bytes: int = BUCKET_BYTES) -> tuple[Model, DataFrame]:
    """The model, and the exact unigram counts in buckets (keys, counts)."""
    size = train.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("n")).first()["n"]
    buckets = 4 + size // bucket_bytes
    filters: dict[str, Filter] = {}
    room = lambda: open_bytes - sum(f.kept_bytes for f in filters.values())
    unigrams = tokens = types = None
    for n in range(1, order + 1):
        counts = written(_bucket_counts(_counted(train, n, buckets, {f"n{m}": filters[f"n{m}"] for m in range(1, n)}, text_col), 1 if n == 1 else MIN_COUNT, buckets if n > 1 else 0), f"ngrams{n}")
        if n == 1:
            unigrams = counts
            total = counts.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("types"), F.lit(0)).alias("types")).first()
            tokens, types = total["tokens"], total["types"]
        filters[f"n{n}"] = _fitted(counts, "counts", "by_level", buckets, room())
        if n > 1:
            contexts = written(_context_totals(counts, buckets), f"contexts{n}")
            filters[f"k{n}"] = _fitted(contexts, "kept", "kept_level", buckets, room())
            filters[f"t{n}"] = _fitted(contexts, "types", "types_level", buckets, room())
    head_keys, head_counts = _head(unigrams, head_words)
    return Model(order, filters, head_keys, head_counts, tokens, types), unigrams


def _fitted(df: DataFrame, value: str, levels: str, buckets: int, room: int) -> Filter:
    """The filter of all keys."""
    return _filter(df, value, buckets, _events(_levels(df, levels)), room)


def _head(unigrams: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of all words from some count on, at most ``most``."""
    by_level = _levels(unigrams, "by_level")
    level = next(j for j in range(1, LEVELS + 2) if by_level[j:].sum() <= most)
    least_count = int(least_at(level))

    def cut(batches):
        for b in batches:
            keys, counts = [], []
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = np.frombuffer(c, np.int64)
                keep = c >= least_count
                keys.append(np.frombuffer(k, np.uint64)[keep].tobytes())
                counts.append(c[keep].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], names=["keys", "counts"])

    # the driver is sent a partition at a time
    keys, counts, n = np.empty(int(by_level[level:].sum()), np.uint64), np.empty(int(by_level[level:].sum()), np.int64), 0
    for r in unigrams.select("keys", "counts").mapInArrow(cut, "keys binary, counts binary").toLocalIterator():
        own = np.frombuffer(r["keys"], np.uint64)
        keys[n:n + len(own)], counts[n:n + len(own)] = own, np.frombuffer(r["counts"], np.int64)
        n += len(own)
    order = np.argsort(keys)
    return keys[order], counts[order]


# ------------------------------------------------------------ scoring
def _rows_of(unigrams: DataFrame) -> DataFrame:
    """key, c: the count table as rows."""
    def spread(batches):
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(k, np.int64)), pa.array(np.frombuffer(c, np.int64))], names=["key", "c"])

    return unigrams.select("keys", "counts").mapInArrow(spread, "key long, c long")


def lm_scores(docs: DataFrame, train: DataFrame, order: int = ORDER, text_col: str = "text", keep: list[str] | None = None, **bounds) -> DataFrame:
    """Add ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` to ``docs``.

    A null or empty text is its end token alone.  Without training rows N and V
    are zero, and every token has the probability of an unknown one.
    """
    model, unigrams = fit(train, order, text_col, **bounds)
    # in the closure go the handles of the filter's groups
    heads = docs.sparkSession.sparkContext.broadcast((model.head_keys, model.head_counts))
    bare = Model(model.order, model.filters, None, None, model.tokens, model.types)
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    named = {c: f"c{i}" for i, c in enumerate(kept)}
    base = docs.select(*[F.col(c).alias(n) for c, n in named.items()], F.col(text_col).alias("scored_text"))

    def start():
        words, m = Tokens(), Model(bare.order, bare.filters, *heads.value, bare.tokens, bare.types)

        def compute(texts):
            out = [[], [], [], [], []]
            for w, lengths in rounds(texts, words, m.chunk):
                own, which = np.unique(w, return_inverse=True)
                head = m.head(own)[which]
                first = np.cumsum(lengths) - lengths
                logs = np.where(head > 0, np.log10(head + 0.5), 0.0)
                out[0] += lengths.tolist()
                out[1] += np.add.reduceat((head > 0).astype(np.int64), first).tolist()
                out[2] += np.add.reduceat(logs, first).tolist()
                out[3] += np.add.reduceat(m.log10(w, positions(lengths), head, (own, which)), first).tolist()
                rare = np.flatnonzero(head == 0)
                edge = np.searchsorted(rare, np.append(first, len(w)))
                out[4] += [w[rare[a:b]].view(np.int64) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            return out

        return compute

    double = T.DoubleType(), pa.float64()
    fields = [long_field("tokens"), long_field("head_known"), ("head_log", *double), ("score", *double),
              ("rare", T.ArrayType(T.LongType()), pa.list_(pa.int64()))]
    scored = per_document(base, fields, start, "scored_text", keep=list(named.values()))
    scored = written(scored.withColumn("rid", F.monotonically_increasing_id()), "scores")
    rare = scored.select("rid", F.explode("rare").alias("key")).groupBy("rid", "key").count()
    found = rare.join(_rows_of(unigrams), "key", "left").groupBy("rid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("count")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("count") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_log"))
    whole = F.lit(float(np.log10(model.tokens + 0.5 * (model.types + 1))))
    out = scored.drop("rare").join(found, "rid", "left").select(
        *named.values(), F.col("tokens").alias("n_tokens"), (F.col("head_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("head_log") + F.coalesce("rare_log", F.lit(0.0)) - F.col("tokens") * whole).alias("base_score"), "score")
    return out.toDF(*kept, *names)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    docs = docs.withColumn("held_out", held_out)
    scored = lm_scores(docs, docs.where(~F.col("held_out")), keep=["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
