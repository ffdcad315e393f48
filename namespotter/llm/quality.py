"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

Every labelled row serves: a hash of the id sends half of them to the models
and leaves the other half, which the models must not have seen, to the
thresholds.  The model's counts, continuation counts and context totals are rows
sharded by n-gram hash, and discounted probabilities and back-off weights come
from joins of these shards.

The fitted tables grow with the labelled text.  While they have at most
``BROADCAST_KEYS`` keys they are broadcast shard by shard and every text is
scored where it lies.  Beyond that nothing holds them whole: texts are dealt to
chunks, a chunk asks every shard once for its distinct n-grams, the shards
answer, and the chunk is scored with the answers (``_scored_by_joins``).  A task
holds one shard and what is asked of it, or one chunk and its answers.

A text is rejected if its perplexity is above its language's threshold.  Toxic
text whose words are mostly trusted hardly moves a mean.  So the largest
contrast of a word (log10 of its continuation probability in toxic text over
that in trusted text, zero for a word that the toxic sample never shows) has a
threshold of its own.  So has the sum of the ``STEM_WORDS`` largest contrasts of
word stems, which also know words that no sample holds.  All thresholds are
quantiles of trusted text per language, over all labelled rows that the models
have not seen.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.common import bounded_broadcast
from ..session import written
from .common import long_field, per_document, spaced_words, table, table_bytes
from .lmscore import END, longer, positions

#: Texts of each language and label that a model is fitted on at most (None: no bound).
SAMPLE = None
SHARDS = 8
#: Keys of all fitted tables up to which they are broadcast: 12 bytes each.
BROADCAST_KEYS = 4_000_000
#: Beyond that: keys of a shard, and bytes of text of a chunk.
SHARD_KEYS = 500_000
CHUNK_BYTES = 8 << 20
#: Tables by what they are looked up by.
LOOKED_UP = {"one": ("p1", "g2", "toxic_word"), "two": ("a2", "g3"), "three": ("a3",), "stem": ("stem", "toxic_stem")}
#: Bytes of a word that are its stems.
STEMS = (4, 5)
#: Distinct words of a text whose stem contrasts count: one alone may have met a toxic text by chance.
STEM_WORDS = 3
#: Scores that a row is judged by, each with the quantile of trusted text that is its threshold.
JUDGED = {"perplexity": 0.999, "contrast": 0.995, "stem_contrast": 0.995}
#: Of the quantiles: 1 / relative error of the rank.
ACCURACY = 100_000

_START = np.uint64(0x5851F42D4C957F2D)


# ------------------------------------------------------------ n-grams
class Words:
    """64-bit hashes of a text's words and its end."""

    def __call__(self, raw: bytes) -> np.ndarray:
        return np.array([*map(xxhash.xxh64_intdigest, spaced_words(raw)), END], np.uint64)


def grams(w: np.ndarray, lengths: np.ndarray):
    """word, bigram, trigram, bigram's context and trigram's context of every token."""
    place = positions(lengths)
    before = np.where(place > 0, np.roll(w, 1), _START)
    two = longer(before, w)
    first_two = longer(np.full(1, _START), np.full(1, _START))[0]
    two_before = np.where(place > 0, np.roll(two, 1), first_two)
    three = longer(two_before, w)
    return w, two, three, before, two_before


_TOKEN = ["w", "two", "three", "before", "two_before"]


def _tokens(texts: DataFrame, text_col: str) -> DataFrame:
    def run(batches):
        words = Words()
        for b in batches:
            texts = [words(x or b"") for x in b.column(0).cast(pa.binary()).to_pylist()]
            for i in range(0, len(texts), 256):
                w, lengths = np.concatenate(texts[i:i + 256]), np.array([len(x) for x in texts[i:i + 256]])
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in grams(w, lengths)], names=_TOKEN)

    return texts.select(text_col).mapInArrow(run, ", ".join(f"{x} long" for x in _TOKEN))


# ------------------------------------------------------------ fitting
def discounts(n: list[int]) -> list[float]:
    """D1, D2 and D3+ from the numbers of n-grams that occur once to four times."""
    n1, n2, n3, n4 = (max(x, 0) for x in n)
    if not n1 or not n2:
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(x, 0.05), k + 0.95) for k, x in enumerate(d)]


def _discount(c, d):
    return F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])


def _in_context(grams: DataFrame, key: str, context: str) -> DataFrame:
    """Counts ``c`` of the rows with their context's ``total``.

    One row of each context carries it (``context``, else null) and its numbers ``k1``, ``k2``, ``k3`` of n-grams that
    occur once, twice and more often.  One exchange serves the count and the context's figures: hardly any row of so
    long a key repeats, so that counting before the exchange would save nothing.
    """
    counts = grams.repartition(context).groupBy(*grams.columns).agg(F.count("*").alias("c"))
    c, own = F.col("c"), Window.partitionBy(context)
    figures = {"total": F.sum("c"), "k1": F.count_if(c == 1), "k2": F.count_if(c == 2), "k3": F.count_if(c > 2)}
    first = F.row_number().over(own.orderBy(key)) == 1
    out = counts.select("*", first.alias("first"), *[v.over(own).alias(k) for k, v in figures.items()])
    return out.select(*[x for x in grams.columns if x != context], "c", "total", F.when(F.col("first"), F.col(context)).alias("context"),
                      *[F.when(F.col("first"), F.col(k)).alias(k) for k in ("k1", "k2", "k3")])


def _order(counts: DataFrame, key: str) -> list[DataFrame]:
    """(key, value) of the discounted probabilities of the rows of ``_in_context``, and of the contexts' back-off weights."""
    near = counts.agg(*[F.count_if(F.col("c") == i).alias(f"n{i}") for i in range(1, 5)]).first()
    d = discounts(list(near))
    seen = counts.select(F.col(key).alias("key"), ((F.col("c") - _discount(F.col("c"), d)) / F.col("total")).alias("value"))
    freed = F.col("k1") * d[0] + F.col("k2") * d[1] + F.col("k3") * d[2]
    return [seen, counts.where("context IS NOT NULL").select(F.col("context").alias("key"), (freed / F.col("total")).alias("value"))]


def kneser_ney(texts: DataFrame, text_col: str = "text") -> tuple[dict[str, DataFrame], float]:
    """Tables (key, value) ``p1``, ``a2``, ``g2``, ``a3``, ``g3``, and the probability of an unknown word."""
    three = written(_in_context(_tokens(texts, text_col), "three", "two_before"), "trigrams")
    two = written(_in_context(three.select("two", "before", "w"), "two", "before"), "bigrams")  # distinct words before each
    one = written(two.groupBy("w").agg(F.count("*").alias("c")), "words")
    a3, g3 = _order(three, "three")
    a2, g2 = _order(two, "two")
    near = one.agg(*[F.count_if(F.col("c") == i) for i in range(1, 5)]).first()
    d = discounts(list(near))
    c = F.col("c")
    row = one.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"), F.coalesce(F.sum(_discount(c, d)), F.lit(0.0)).alias("freed"), F.count("*").alias("types")).first()
    total = max(row["total"], 1)
    unknown = (row["freed"] / total if row["types"] else 1.0) / (row["types"] + 1)
    p1 = one.select(F.col("w").alias("key"), ((c - _discount(c, d)) / total + unknown).alias("value"))
    return {"p1": p1, "a2": a2, "g2": g2, "a3": a3, "g3": g3}, float(unknown)


def stem_keys(words: list[bytes]) -> np.ndarray:
    """A row per stem length: hash of the stem, zero for words that are no longer than it."""
    out = np.zeros((len(STEMS), len(words)), np.uint64)
    for i, n in enumerate(STEMS):
        out[i] = [xxhash.xxh64_intdigest(w[:n], n) if len(w) > n else 0 for w in words]
    return out


def stem_probabilities(texts: DataFrame, text_col: str = "text") -> tuple[DataFrame, float]:
    """(key, value) of each stem's share of the distinct words, discounted, and the probability of an unknown stem."""
    def run(batches):
        for b in batches:
            words = sorted({w for x in b.column(0).cast(pa.binary()).to_pylist() for w in spaced_words(x or b"")})
            keys = stem_keys(words)
            n = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
            for k in keys:
                own = np.flatnonzero(k)
                yield pa.RecordBatch.from_arrays([pa.array(k[own].view(np.int64)), pa.array(n[own].view(np.int64))], names=["key", "w"])

    c = F.col("c")
    counts = written(texts.select(text_col).mapInArrow(run, "key long, w long").distinct().groupBy("key").agg(F.count("*").alias("c")), "stems")
    d = discounts(list(counts.agg(*[F.count_if(c == i) for i in range(1, 5)]).first()))
    row = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"), F.coalesce(F.sum(_discount(c, d)), F.lit(0.0)).alias("freed"), F.count("*").alias("types")).first()
    total = max(row["total"], 1)
    unknown = (row["freed"] / total if row["types"] else 1.0) / (row["types"] + 1)
    return counts.select("key", ((c - _discount(c, d)) / total + unknown).alias("value")), float(unknown)


def _shards(tables: dict[str, DataFrame], shards: int):
    """kind, shard, sorted keys and their values: one row per shard of each table."""
    kinds = list(tables)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        kind, shard = divmod(int(pdf["own"].iloc[0]), shards)
        return pd.DataFrame({"kind": [kinds[kind]], "shard": [shard], "keys": [pdf["key"].to_numpy().tobytes()],
                             "values": [pdf["value"].to_numpy(np.float32).tobytes()]})

    rows = None
    for i, df in enumerate(tables.values()):
        own = df.select((F.pmod("key", F.lit(shards)) + i * shards).cast("int").alias("own"), "key", F.col("value").cast("float").alias("value"))
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("own").applyInPandas(pack, "kind string, shard int, keys binary, values binary")


class Shards:
    """Values by key, each from the shard that its key falls into."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], shards: int = SHARDS):
        self.shards = shards
        self.held = {(r["kind"], r["shard"]): spark.sparkContext.broadcast((bytes(r["keys"]), bytes(r["values"])))
                     for r in _shards(tables, shards).toLocalIterator()}

    def release(self) -> None:
        """Give the broadcasts back, once all that needs them is written."""
        for b in self.held.values():
            b.destroy()
        self.held = {}

    def opened(self):
        arrays = {k: (np.frombuffer(b.value[0], np.int64), np.frombuffer(b.value[1], np.float32)) for k, b in self.held.items()}

        def look(kind: str, keys: np.ndarray) -> np.ndarray:
            keys, out = keys.view(np.int64), np.full(len(keys), np.nan)
            shard = np.mod(keys, self.shards)
            for s in range(self.shards):
                if (kind, s) in arrays:
                    at = np.flatnonzero(shard == s)
                    out[at] = found(*arrays[kind, s], keys[at])
            return out

        return look


def found(own: np.ndarray, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The values of the keys among the sorted keys ``own``, NaN for others."""
    if not len(own):
        return np.full(len(keys), np.nan)
    place = np.minimum(np.searchsorted(own, keys), len(own) - 1)
    return np.where(own[place] == keys, values[place], np.nan)


def log10_probability(look, unknown: float, w: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 of the interpolated probability of every token."""
    w, two, three, before, two_before = grams(w, lengths)
    return interpolated(unknown, look("p1", w), (look("a2", two), look("g2", before)), (look("a3", three), look("g3", two_before)))


def interpolated(unknown: float, one: np.ndarray, *orders: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 of the probability, from the values of every token: of its word, and of its n-gram and context in each order."""
    p = np.where(np.isnan(one), unknown, one)
    for seen, back in orders:
        p = np.where(np.isnan(back), p, np.nan_to_num(seen) + back * p)
    return np.log10(p)


class Vocabulary:
    """Hash, contrast and stem contrast of every word met, up to a bound."""

    def __init__(self, look, unknown: dict[str, float], most: int = 300_000):
        self.look, self.unknown, self.most = look, unknown, most
        self.place: dict[bytes, int] = {}
        self.hash, self.contrast = np.empty(most, np.uint64), np.empty((2, most))

    def _gain(self, toxic: str, trusted: str, keys: np.ndarray) -> np.ndarray:
        """log10 of the share in toxic over that in trusted text; zero for what toxic text never showed."""
        bad, good = self.look(toxic, keys), self.look(trusted, keys)
        return np.nan_to_num(np.log10(bad / np.where(np.isnan(good), self.unknown[trusted], good)))

    def learn(self, texts: list[list[bytes]]) -> None:
        new = list(set(itertools.chain.from_iterable(texts)).difference(self.place))
        if len(self.place) + len(new) > self.most:
            self.place = {}
            new = list(set(itertools.chain.from_iterable(texts)))
            if len(new) > len(self.hash):  # one text alone may have more words
                self.hash, self.contrast = np.empty(len(new), np.uint64), np.empty((2, len(new)))
        at = slice(len(self.place), len(self.place) + len(new))
        h = np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new))
        self.hash[at] = h
        self.contrast[0, at] = self._gain("toxic_word", "p1", h)
        stems = stem_keys(new)
        self.contrast[1, at] = [0.0] * len(new)
        for keys in stems:
            own = np.flatnonzero(keys)
            gain = self._gain("toxic_stem", "stem", keys[own])
            self.contrast[1, at.start + own] = np.maximum(self.contrast[1, at.start + own], gain)
        self.place.update(zip(new, range(at.start, at.stop), strict=True))

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, float, float]:
        """Hashes with the end, the largest word contrast, and the sum of the ``STEM_WORDS`` largest
        stem contrasts of distinct words (none below zero)."""
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        stems = np.sort(self.contrast[1, np.unique(at)].clip(0))[-STEM_WORDS:].sum()
        return np.append(self.hash[at], np.uint64(END)), self.contrast[0, at].max(initial=0.0), stems


def _scorer(look, unknown: dict[str, float], log10_p=None):
    """From the list of a batch's texts to the lists of their scores.
    ``log10_p``: of all tokens of these texts, if it is known."""
    vocabulary = Vocabulary(look, unknown)

    def compute(texts):
        out, done = [[], [], [], []], 0
        for i in range(0, len(texts), 128):
            words = [spaced_words(t) for t in texts[i:i + 128]]
            vocabulary.learn(words)
            hashes, contrast, stem = zip(*map(vocabulary, words), strict=True)
            lengths = np.array([len(h) for h in hashes])
            p = log10_probability(look, unknown["p1"], np.concatenate(hashes), lengths) if log10_p is None else log10_p[done:done + lengths.sum()]
            done += lengths.sum()
            out[0] += lengths.tolist()
            out[1] += (10 ** -(np.add.reduceat(p, np.cumsum(lengths) - lengths) / lengths)).tolist()
            out[2] += contrast
            out[3] += stem
        return out

    return compute


# ------------------------------------------------------------ scoring by joins
def _hashed(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, and what ``Words`` makes of the texts, one after the other, with the lengths."""
    each = [spaced_words(t) for t in texts]
    words = list(set(itertools.chain.from_iterable(each)))
    place = {x: i for i, x in enumerate(words)}
    place[None] = len(words)
    own = np.array([*map(xxhash.xxh64_intdigest, words), END], np.uint64)
    lengths = np.array([len(x) + 1 for x in each], np.int64)
    ids = map(place.__getitem__, itertools.chain.from_iterable((*x, None) for x in each))
    return words, own[np.fromiter(ids, np.int64, lengths.sum())], lengths


def _contexts(at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of numbered tokens followed by the number of a text's start: the number of what stands before each token."""
    return np.where(positions(lengths) > 0, np.roll(at[:-1], 1), at[-1])


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted: numpy's ``unique`` hashes, which took ten times as long."""
    keys = np.sort(keys)
    return keys[np.concatenate((np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]))]


def asked(words: list[bytes], w: np.ndarray, lengths: np.ndarray, numbered: bool = False):
    """Sorted distinct keys that scoring the texts looks up, by the names of
    ``LOOKED_UP``; if ``numbered``, with each token's places among them (none
    for stems).  A context is a token's n-gram or begins a text."""
    _, two, three, *_ = grams(w, lengths)
    start = np.full(1, _START)
    keys = {"one": np.concatenate([w, start]), "two": np.concatenate([two, longer(start, start)]), "three": three,
            "stem": np.concatenate([k[k != 0] for k in stem_keys(words)])}
    return {k: np.unique(v.view(np.int64), return_inverse=True) if numbered and k != "stem" else _distinct(v.view(np.int64)) for k, v in keys.items()}


def _scored_by_joins(docs: DataFrame, text_col: str, keep: list[str], tables: dict[str, DataFrame],
                     unknown: dict[str, float], fields: list) -> DataFrame:
    """``keep`` and the scores.  The chunk of a row depends on its values alone,
    so that the rows met when the answers arrive are those that asked."""
    n, total = sum(t.count() for t in tables.values()), table_bytes(docs, text_col)
    chunks = max(1, -(-total // CHUNK_BYTES))
    shards = max(SHARDS, -(-n // SHARD_KEYS), -(-chunks // 2))
    names = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)],
                       *([] if text_col in keep else [F.col(text_col).alias("text")]))
    text = names[keep.index(text_col)] if text_col in keep else "text"
    plain = [f.name for f in rows.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64(*plain), F.lit(chunks)))
    kept = T.StructType([T.StructField(n, docs.schema[c].dataType) for c, n in zip(keep, names, strict=True)])

    def read(rows: pa.Table) -> list[bytes]:
        return [x or b"" for x in rows.column(text).cast(pa.binary()).to_pylist()]

    def ask(rows: pa.Table) -> pa.Table:
        chunk, keys = rows.column("chunk")[0].as_py(), asked(*_hashed(read(rows)))
        out = {"shard": np.arange(shards, dtype=np.int32), "chunk": np.full(shards, chunk, np.int64)}
        for k, v in keys.items():
            shard = np.mod(v, shards)
            order = np.argsort(shard, kind="stable")               # sorted within a shard
            out[k] = [x.tobytes() for x in np.split(v[order], np.cumsum(np.bincount(shard, minlength=shards))[:-1])]
        return pa.table(out)

    def answer(tables: pa.Table, asks: pa.Table) -> pa.Table:
        arrays = {r["kind"]: (np.frombuffer(r["keys"], np.int64), np.frombuffer(r["values"], np.float32)) for r in tables.to_pylist()}
        none = np.zeros(0, np.int64), np.zeros(0, np.float32)
        said = []
        for i in range(asks.num_rows):
            own = []
            for k, kinds in LOOKED_UP.items():
                keys = np.frombuffer(asks.column(k)[i].as_py(), np.int64)
                own += [found(*arrays.get(kind, none), keys).astype(np.float32).tobytes() for kind in kinds]
            said.append(b"".join(own))
        return pa.table({"shard": asks.column("shard"), "chunk": asks.column("chunk"), "said": pa.array(said, pa.binary())})

    def score(rows: pa.Table, said: pa.Table) -> pa.Table:
        texts = read(rows)
        words, w, lengths = _hashed(texts)
        places = asked(words, w, lengths, numbered=True)
        at = {k: v[1] for k, v in places.items() if k != "stem"}
        keys = {k: v if k == "stem" else v[0] for k, v in places.items()}
        values = {kind: np.full(len(keys[k]), np.nan, np.float32) for k, kinds in LOOKED_UP.items() for kind in kinds}
        shard_of = {k: np.mod(v, shards) for k, v in keys.items()}
        order = {k: np.argsort(v, kind="stable") for k, v in shard_of.items()}
        edges = {k: np.concatenate(([0], np.cumsum(np.bincount(v, minlength=shards)))) for k, v in shard_of.items()}
        for i in range(said.num_rows):
            s, own, lo = said.column("shard")[i].as_py(), np.frombuffer(said.column("said")[i].as_py(), np.float32), 0
            for k, kinds in LOOKED_UP.items():
                own_at = order[k][edges[k][s]:edges[k][s + 1]]
                for kind in kinds:
                    values[kind][own_at] = own[lo:lo + len(own_at)]
                    lo += len(own_at)
        by = {kind: keys[k] for k, kinds in LOOKED_UP.items() for kind in kinds}
        look = lambda kind, wanted: found(by[kind], values[kind], wanted.view(np.int64)).astype(np.float64)
        wide = {k: v.astype(np.float64) for k, v in values.items()}
        p = interpolated(unknown["p1"], wide["p1"][at["one"][:-1]], (wide["a2"][at["two"][:-1]], wide["g2"][_contexts(at["one"], lengths)]),
                         (wide["a3"][at["three"]], wide["g3"][_contexts(at["two"], lengths)]))
        made = [pa.array(v, type=f[2]) for v, f in zip(_scorer(look, unknown, p)(texts), fields, strict=True)]
        return pa.table([*(rows.column(n) for n in names), *made], names=[*names, *(f[0] for f in fields)])

    asks = rows.groupBy("chunk").applyInArrow(ask, "shard int, chunk long, " + ", ".join(f"{k} binary" for k in LOOKED_UP))
    said = _shards(tables, shards).groupBy("shard").cogroup(asks.groupBy("shard")).applyInArrow(answer, "shard int, chunk long, said binary")
    schema = T.StructType([*kept, *(T.StructField(n, t) for n, t, _ in fields)])
    out = rows.groupBy("chunk").cogroup(said.groupBy("chunk")).applyInArrow(score, schema)
    return out.toDF(*keep, *(f[0] for f in fields))


class Classifier:
    """Fitted shards of the models and, once set, the thresholds by language (None: any other)."""

    def __init__(self, spark: SparkSession, trusted: DataFrame, toxic: DataFrame, text_col: str, most: int = BROADCAST_KEYS):
        tables, unknown = kneser_ney(trusted, text_col)
        words, unknown_toxic = kneser_ney(toxic, text_col)
        (stem, unknown_stem), (toxic_stem, unknown_toxic_stem) = (stem_probabilities(x, text_col) for x in (trusted, toxic))
        tables |= {"toxic_word": words["p1"], "stem": stem, "toxic_stem": toxic_stem}
        self.tables = tables
        self.shards = Shards(spark, tables) if sum(t.count() for t in tables.values()) <= most else None
        self.unknown = {"p1": unknown, "toxic_word": unknown_toxic, "stem": unknown_stem, "toxic_stem": unknown_toxic_stem}
        self.thresholds: dict[str | None, tuple[float, ...]] = {}
        self.scored: DataFrame | None = None  # the rows of the fit with their scores

    def scores(self, docs: DataFrame, text_col: str, keep: list[str] | None = None) -> DataFrame:
        """Add ``n_tokens``, ``perplexity``, ``contrast`` and ``stem_contrast``."""
        shards, unknown, double = self.shards, self.unknown, (T.DoubleType(), pa.float64())
        fields = [long_field("n_tokens"), *((c, *double) for c in JUDGED)]
        if shards is not None:
            return per_document(docs, fields, lambda: _scorer(shards.opened(), unknown), text_col, keep)
        kept = [c for c in (docs.columns if keep is None else keep) if c not in {f[0] for f in fields}]
        return _scored_by_joins(docs, text_col, kept, self.tables, unknown, fields)

    def release(self) -> None:
        """Give the broadcasts back, once all that needs them is written."""
        if self.shards is not None:
            self.shards.release()


def _thresholds(trusted: DataFrame) -> dict[str | None, tuple[float, ...]]:
    """By language, and over all of them at None.  Without trusted rows nothing is above."""
    figures = [F.percentile_approx(c, F.lit(q), F.lit(ACCURACY)).alias(c) for c, q in JUDGED.items()]
    rows = trusted.groupBy("lang").agg(*figures).collect()  # a row per language
    read = lambda r: tuple(float("inf") if r[c] is None else r[c] for c in JUDGED)
    return {None: read(trusted.agg(*figures).first())} | {r["lang"]: read(r) for r in rows if r["lang"] is not None}


def _marked(labels: DataFrame) -> DataFrame:
    """labelled_id, label."""
    label = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "trusted").when(F.col("quality") == 0, "poor").when(F.col("toxic") == 1, "toxic")
    return labels.select(F.col("doc_id").alias("labelled_id"), label.alias("label")).where("labelled_id IS NOT NULL AND label IS NOT NULL")


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, lang_col: str, sample: int | None) -> DataFrame:
    """labelled_id and label of the rows to fit on: half of all, or about
    ``sample`` rows of each language and label where these are fewer."""
    known = docs.select(F.col(id_col).alias("labelled_id"), F.col(lang_col).alias("lang")).join(_marked(labels), "labelled_id")
    draw = F.shiftrightunsigned(F.xxhash64("labelled_id"), 33)  # 31 bits
    taken = known.where(draw % 2 == 0)
    if sample is not None:
        sizes = known.groupBy(F.col("lang").alias("own_lang"), F.col("label").alias("own_label")).agg(F.count("*").alias("rows"))
        drawn = taken.join(F.broadcast(sizes), F.col("lang").eqNullSafe(F.col("own_lang")) & (F.col("label") == F.col("own_label")))
        taken = drawn.where(draw < F.lit(2.0 * sample * 2 ** 31) / F.col("rows"))
    return written(taken.select("labelled_id", "label").dropDuplicates(["labelled_id"]), "sample")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        sample: int | None = SAMPLE, keep: list[str] | None = None, most: int = BROADCAST_KEYS) -> Classifier:
    """Fit on ``labels(doc_id, quality, toxic)``, and score every row on the way
    for the thresholds (``scored``: the columns ``keep``, the id and the
    language by default, and the scores).  Without trusted rows nothing is
    rejected.  An id labelled more than once counts under each of its labels
    for the thresholds, and under one of them for the models."""
    keep = [id_col, lang_col] if keep is None else keep
    taken = _sample(docs, labels, id_col, lang_col, sample)
    texts = docs.select(F.col(id_col).alias("labelled_id"), F.col(text_col).alias("text"))
    small = bounded_broadcast(taken)
    own = written(texts.join(small, "labelled_id"), "labelled")
    made = Classifier(docs.sparkSession, own.where("label = 'trusted'"), own.where("label = 'toxic'"), "text", most)
    # scores are joined with the labels, not texts: these would be shuffled
    made.scored = written(made.scores(docs, text_col, keep), "scores")
    trusted = _marked(labels).where("label = 'trusted'").select("labelled_id").distinct()
    own = made.scored.select(F.col(id_col).alias("labelled_id"), F.col(lang_col).alias("lang"), *JUDGED)
    unseen = own.join(small.select("labelled_id"), "labelled_id", "left_anti")
    made.thresholds = _thresholds(unseen.join(trusted, "labelled_id"))
    return made


def classify(docs: DataFrame, model: Classifier, text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """Add ``n_tokens``, the three scores, their thresholds and ``rejected``.

    A null or empty text is its end token alone and is judged like any other.
    Rows of a null or unseen language get the thresholds over all languages.
    """
    return judge(model.scores(docs, text_col, keep), model, lang_col)


def judge(out: DataFrame, model: Classifier, lang_col: str = "lang") -> DataFrame:
    """Add the thresholds and ``rejected`` to scored rows."""
    over = F.lit(False)
    for i, score in enumerate(JUDGED):
        limit = F.lit(model.thresholds[None][i])
        for lang, v in model.thresholds.items():
            limit = F.when(F.col(lang_col) == lang, v[i]).otherwise(limit) if lang is not None else limit
        out = out.withColumn(f"{score}_threshold", limit)
        over = over | (F.col(score) > F.col(f"{score}_threshold"))
    return out.withColumn("rejected", over)


def trusted_only(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows that are not rejected, with the columns of ``docs``."""
    columns = docs.columns
    named = [f"c{i}" for i in range(len(columns))]
    at = dict(zip(columns, named, strict=True))
    rows = docs.toDF(*named)
    model = fit(rows, labels, at[id_col], at[text_col], at[lang_col], keep=named)
    model.release()
    return judge(model.scored, model, at[lang_col]).where(~F.col("rejected")).select(*named).toDF(*columns)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs, table(spark, sf_dir, "labels"))
    model.release()
    return judge(model.scored, model)  # the fit has scored every row
