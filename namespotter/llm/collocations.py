"""Phrases whose words occur together, by Rabin-Karp fingerprints.

Orders 1 to 4 are counted one after the other over the whole texts.  A task
lays a few megabytes of text out as one byte array (words one space apart),
takes prefix polynomials modulo 2^64 over it with numpy, and so has the
fingerprint of every phrase as a difference of two of them.  A phrase of n words
is counted only if its two phrases of n - 1 words are frequent, which a Bloom
filter of the frequent fingerprints says (it may say so wrongly, never miss one).
Fingerprints are summed per task before they are shuffled.

The last reading materialises frequent phrases alone.  An occurrence pointer
(the place in the task's byte array) stands for each fingerprint; all
occurrences are compared with the one pointed at, word by word, words having
been compared byte by byte; occurrences of another text are counted apart.  The
counts that leave this reading are per text, so neither a collision of
fingerprints nor a wrong answer of a filter changes a result.

The filter of an order has 16 bits for each frequent phrase up to ``FILTER_BITS``
in all, its size on the driver and in a task.  Should more phrases be frequent,
it excludes less: more fingerprints are shuffled, with the same results.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written
from .common import salted_join, table

LONGEST = 4
#: Bytes of text laid out at once; a longer text is cut between pieces.
LAYOUT_BYTES = 2 << 20
#: Distinct fingerprints a task holds before it hands them on.
HELD = 2_000_000
FILTER_BITS = 1 << 28
BITS_A_KEY = 16
NO_LANGUAGE = "und"

SEPARATORS = b".,;:!?\n\v\f\r"
LOWER = bytes(10 if b in SEPARATORS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, LAYOUT_BYTES + 4096), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread all bits of a fingerprint over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def layouts(rows, limit: int = LAYOUT_BYTES):
    """Lists of (language, text) of about ``limit`` bytes; a longer text is cut at separators, so that pieces stay whole."""
    held, size = [], 0
    for lang, raw in rows:
        at = 0
        while at < len(raw):
            end = len(raw)
            if end - at > limit:
                cuts = [raw.rfind(bytes([c]), at, at + limit) for c in SEPARATORS]
                end = max(cuts) + 1
                if not end:
                    later = [p for p in (raw.find(bytes([c]), at + limit) for c in SEPARATORS) if p >= 0]
                    end = min(later) + 1 if later else len(raw)
            held.append((lang, raw[at:end]))
            size += end - at
            at = end
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held


class Layout:
    """The words of some texts in one array, and the fingerprints of their phrases."""

    def __init__(self, rows: list[tuple[str, bytes]], bits: int = 64):
        self.langs = sorted({lang for lang, _ in rows})
        code = {lang: k for k, lang in enumerate(self.langs)}
        raw = np.frombuffer(b"".join(t + b"\n" for _, t in rows).translate(LOWER), np.uint8)
        apart = (raw == 32) | (raw == 10)
        edge = np.diff(np.concatenate(([1], apart.view(np.int8))))
        starts = np.flatnonzero(edge == -1)
        piece = np.cumsum(raw == 10, dtype=np.int32)[starts]
        after = edge == 1  # the separator that follows a word
        after[0] = False
        self.bytes = np.where(apart, np.uint8(32), raw)[~apart | after]
        self.ends = np.flatnonzero(self.bytes == 32)
        self.starts = np.concatenate(([0], self.ends[:-1] + 1))[:len(self.ends)]
        self.piece = piece
        ends_of_rows = np.cumsum([len(t) + 1 for _, t in rows])
        self.lang = np.array([code[lang] for lang, _ in rows], np.int32)[np.searchsorted(ends_of_rows, starts, "right")]
        self.prefix = np.zeros(len(self.bytes) + 1, np.uint64)
        np.cumsum((self.bytes + np.uint64(1)) * powers(BASE, len(self.bytes)), out=self.prefix[1:])
        seeds = np.array([xxhash.xxh64_intdigest(lang.encode()) for lang in self.langs], np.uint64)
        self.seed = seeds[self.lang] if len(self.lang) else np.zeros(0, np.uint64)
        self.keep = np.uint64((1 << bits) - 1)

    def places(self, n: int) -> np.ndarray:
        """First words of the phrases of n words."""
        last = len(self.piece) - n + 1
        return np.flatnonzero(self.piece[:max(last, 0)] == self.piece[n - 1:]) if last > 0 else np.zeros(0, np.int64)

    def prints(self, at: np.ndarray, n: int) -> np.ndarray:
        """Fingerprints of the phrases of n words that begin at the words ``at``."""
        start, end = self.starts[at], self.ends[at + n - 1]
        h = (self.prefix[end] - self.prefix[start]) * powers(INVERSE, len(self.bytes))[start]
        return mixed(h ^ self.seed[at]) & self.keep

    def word_ids(self) -> np.ndarray:
        """A number per word, equal for words of equal bytes only: the first place of its fingerprint,
        after every word has been compared with the word there."""
        every = np.arange(len(self.starts))
        if not len(every):
            return every
        _, first, inverse = np.unique(self.prints(every, 1), return_index=True, return_inverse=True)
        same = first[inverse]
        size = self.ends - self.starts
        alike = size == size[same]
        at = np.flatnonzero(alike)
        shift = np.repeat(self.starts[same[at]] - self.starts[at], size[at])
        begin = np.cumsum(size[at]) - size[at]
        own = np.arange(len(shift)) + np.repeat(self.starts[at] - begin, size[at])
        alike[at] = np.logical_and.reduceat(self.bytes[own] == self.bytes[own + shift], begin)
        ids = same.copy()
        other: dict[bytes, int] = {}
        for k in np.flatnonzero(~alike).tolist():  # collisions
            ids[k] = other.setdefault(self.bytes[self.starts[k]:self.ends[k]].tobytes(), k)
        return ids

    def texts(self, at: np.ndarray, n: int) -> pa.Array:
        """The phrases of n words that begin at ``at``, gathered in one go."""
        start, end = self.starts[at], self.ends[at + n - 1]
        offsets = np.concatenate(([0], np.cumsum(end - start)))
        places = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], end - start)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int32).tobytes()),
                                           pa.py_buffer(self.bytes[places].tobytes()))


def holds(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Which fingerprints the filter has."""
    mask = np.uint64(len(bits) * 8 - 1)
    found = np.ones(len(prints), bool)
    for p in (prints & mask, (prints >> np.uint64(32)) & mask):
        found &= (bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return found


def _rows(batch):
    langs, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
    return ((NO_LANGUAGE if lang is None else lang, t) for lang, t in zip(langs, texts, strict=True) if t)


def _candidates(layout: Layout, n: int, shorter: np.ndarray | None) -> np.ndarray:
    """First words of the phrases of n words whose two phrases of n - 1 words are among ``shorter``."""
    at = layout.places(n)
    if shorter is None:
        return at
    known = np.zeros(len(layout.piece) + 1, bool)
    known[shorter] = True
    return at[known[at] & known[at + 1]]


def _fingerprints(docs: DataFrame, n: int, below, least: int, bits: int) -> DataFrame:
    """``fp`` of the phrases of n words (and languages) that occur ``least`` times or more."""
    def run(batches):
        filter_bits = None if below is None else np.frombuffer(below.value, np.uint8)
        prints, counts, size = [], [], 0

        def flushed():
            u, inverse = np.unique(np.concatenate(prints), return_inverse=True)
            total = np.bincount(inverse, np.concatenate(counts)).astype(np.int64)
            prints.clear()
            counts.clear()
            return u, total

        def batch(u, total):
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(total)], names=["fp", "n"])

        for b in batches:
            for rows in layouts(_rows(b)):
                layout = Layout(rows, bits)
                shorter = None
                if filter_bits is not None:
                    shorter = layout.places(n - 1)
                    shorter = shorter[holds(filter_bits, layout.prints(shorter, n - 1))]
                u, c = np.unique(layout.prints(_candidates(layout, n, shorter), n), return_counts=True)
                prints.append(u)
                counts.append(c)
                size += len(u)
                if size > HELD:
                    u, c = flushed()
                    size = 0
                    if len(u) > HELD // 2:
                        yield batch(u, c)
                    else:
                        prints.append(u)
                        counts.append(c)
                        size = len(u)
        if prints:
            yield batch(*flushed())

    seen = docs.mapInArrow(run, "fp long, n long").groupBy("fp").agg(F.sum("n").alias("n"))
    return written(seen.where(F.col("n") >= least).select("fp"), f"frequent-{n}")


def _filter(spark: SparkSession, frequent: DataFrame):
    """A broadcast Bloom filter of two bits a fingerprint, put together from bitmaps that Spark aggregates."""
    keys = frequent.count()
    size = 1 << 15
    while size < min(BITS_A_KEY * keys, FILTER_BITS):
        size *= 2
    at = frequent.select(F.explode(F.array(F.col("fp").bitwiseAND(F.lit(size - 1)),
                                           F.shiftrightunsigned("fp", 32).bitwiseAND(F.lit(size - 1)))).alias("p"))
    at = at.select((F.col("p") + 1).alias("p"))  # Spark's bitmaps count from 1
    parts = at.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    whole = np.zeros(size // 8, np.uint8)
    for row in parts.toLocalIterator():
        part = np.frombuffer(row["bits"], np.uint8)
        begin = (row["bucket"] - 1) * len(part)
        whole[begin:begin + len(part)] |= part
    return spark.sparkContext.broadcast(whole.tobytes())


def _materialised(docs: DataFrame, filters: list, least: int, bits: int) -> DataFrame:
    """``lang, phrase, f`` of all phrases with f >= ``least``, and ``lang, '', number of words``."""
    def run(batches):
        known = [np.frombuffer(f.value, np.uint8) for f in filters]
        for b in batches:
            for rows in layouts(_rows(b)):
                layout = Layout(rows, bits)
                ids = layout.word_ids()
                at = None
                for n, has in enumerate(known, 1):
                    at = _candidates(layout, n, at)
                    prints = layout.prints(at, n)
                    hit = holds(has, prints)
                    at, prints = at[hit], prints[hit]
                    if not len(at):
                        break
                    _, first, inverse = np.unique(prints, return_index=True, return_inverse=True)
                    pointed = at[first]
                    there = pointed[inverse]
                    same = layout.lang[at] == layout.lang[there]
                    for k in range(n):
                        same &= ids[at + k] == ids[there + k]
                    counts = np.bincount(inverse[same], minlength=len(first))
                    langs = pa.array(layout.langs, pa.string()).take(pa.array(layout.lang[pointed]))
                    yield pa.RecordBatch.from_arrays([langs, layout.texts(pointed, n), pa.array(counts, pa.int64())], names=names)
                    if not same.all():
                        yield others(layout, at[~same], n)
                words = np.bincount(layout.lang, minlength=len(layout.langs))
                yield pa.RecordBatch.from_arrays([pa.array(layout.langs, pa.string()), pa.array([""] * len(words)),
                                                  pa.array(words, pa.int64())], names=names)

    names = ["lang", "phrase", "f"]

    def others(layout, at, n):
        """Occurrences whose text is not that of their fingerprint's pointer."""
        seen = Counter(zip([layout.langs[k] for k in layout.lang[at]], layout.texts(at, n).to_pylist(), strict=True))
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()),
                                           pa.array(seen.values(), pa.int64())], names=names)

    counted = docs.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return written(counted.where((F.col("f") >= least) | (F.col("phrase") == "")), "phrases")


def frequent_phrases(docs: DataFrame, least: int = 30, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang",
                     bits: int = 64) -> DataFrame:
    """``lang, phrase, f``: every phrase of one to ``longest`` words that
    occurs ``least`` times or more in a language, space-joined, and one row per
    language with an empty phrase and the number of its words.

    Null texts are empty and null languages count as ``und``; languages without
    a word have no row.  Repeated rows count as often as they occur.  ``bits``
    shortens the fingerprints (tests make them collide).
    """
    spark = docs.sparkSession
    own = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    filters = []
    for n in range(1, longest + 1):
        filters.append(_filter(spark, _fingerprints(own, n, filters[-1] if filters else None, least, bits)))
    found = _materialised(own, filters, least, bits)
    for f in filters:
        f.destroy()
    return found


def collocations(docs: DataFrame, least: int = 30, longest: int = LONGEST, top: int = 2000, kept_share: int = 80,
                 text_col: str = "text", lang_col: str = "lang", bits: int = 64) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of two or
    more words of each language.

    A phrase cut after its first k words scores floor(2000000 a / (l + r)) with
    a, l and r the frequencies of the phrase and of both parts; its lowest cut
    counts, the first of equal ones.  A phrase goes if a longer frequent one
    holds its words and has ``kept_share`` per cent of its frequency.  Equal
    scores are ordered by frequency and then by the phrase's bytes.  Arithmetic
    is in decimals.  See ``frequent_phrases`` for nulls and repeated rows; an
    empty table gives an empty one; other columns are not read.
    """
    counted = frequent_phrases(docs, least, longest, text_col, lang_col, bits)
    f = counted.where("phrase <> ''")
    salts = max(16, counted.count() // 100_000)
    phrases = f.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w")).where("size(w) > 1")

    cuts = phrases.select("lang", "phrase", "a", "w", F.explode(F.expr("sequence(1, size(w) - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("first"),
                       F.expr("array_join(slice(w, k + 1, size(w)), ' ')").alias("rest"))
    cuts = salted_join(cuts, f.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"], salts)
    cuts = salted_join(cuts, f.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"], salts)
    score = F.expr("(cast(a as decimal(38, 0)) * 2000000BD) div (cast(l as decimal(38, 0)) + cast(r as decimal(38, 0)))")
    scored = cuts.withColumn("score", score.cast("long")).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    held = phrases.select("lang", "a", "w", F.explode(F.expr("sequence(2, size(w) - 1)")).alias("m")).where("size(w) > 2")
    held = held.select("lang", F.col("a").alias("more"), F.explode(F.expr(
        "transform(sequence(1, size(w) - m + 1), i -> array_join(slice(w, i, m), ' '))")).alias("phrase"))
    held = held.groupBy("lang", "phrase").agg(F.max("more").alias("more"))
    gone = F.expr(f"coalesce(100BD * cast(more as decimal(38, 0)) >= {int(kept_share)}BD * cast(a as decimal(38, 0)), false)")
    left = scored.join(held, ["lang", "phrase"], "left").where(~gone)
    rows = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(*best)
    rows = rows.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    words = counted.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return rows.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
  FROM words, (SELECT unnest([1, 2, 3, 4]) AS m)),
f AS (SELECT lang, m, phrase, count(*)::HUGEINT AS f, string_split(phrase, ' ') AS w FROM grams GROUP BY lang, m, phrase HAVING count(*) >= 30),
total AS (SELECT lang, count(*) AS n FROM grams WHERE m = 1 GROUP BY lang),
cuts AS (
  SELECT p.lang, p.phrase, p.f AS a, k, l.f AS l, r.f AS r, 2000000 * p.f // (l.f + r.f) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1) p
  JOIN f l ON l.lang = p.lang AND l.phrase = array_to_string(p.w[1:k], ' ')
  JOIN f r ON r.lang = p.lang AND r.phrase = array_to_string(p.w[k + 1:], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM lowest c WHERE NOT EXISTS (
    SELECT 1 FROM f o WHERE o.lang = c.lang AND o.m > len(string_split(c.phrase, ' '))
      AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * o.f >= 80 * c.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
