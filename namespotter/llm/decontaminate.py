"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's
normalised word windows reads every text once.

A window is ``size`` consecutive words of an item; an item of fewer words (but
not none) is one window.  The automaton runs over the normalised text (words
joined by one space); matches are mapped to words, and words to code points of
the original text.
"""

from __future__ import annotations

import hashlib
import itertools

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import long_field, per_document, plain_words, runs, table, table_bytes, text_field, word_offsets

#: Item text in one automaton.  A larger benchmark is dealt into blocks of
#: about this size; each task holds one block's automaton at a time.
BLOCK_BYTES = 16 << 20

_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_SPANS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def windows(raw: bytes, size: int) -> list[str]:
    w = plain_words(raw)
    return [f" {b' '.join(w[i:i + size]).decode('latin-1')} " for i in range(max(1, len(w) - size + 1))] if w else []


def _item_blocks(items: DataFrame, id_col: str, text_col: str) -> list[list[tuple[str, bytes]]]:
    """The items on the driver, one block of bounded size at a time."""
    rows = items.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("text"))
    n = 1 + table_bytes(rows, "text") // BLOCK_BYTES
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k) if n > 1 else rows
        yield [(r["id"], bytes(r["text"])) for r in part.collect()]


def _automaton(items: list[tuple[str, bytes]], size: int) -> ahocorasick.Automaton:
    by_window: dict[str, set[str]] = {}
    for item, text in items:
        for w in windows(text, size):
            by_window.setdefault(w, set()).add(item)
    a = ahocorasick.Automaton()
    for w, ids in by_window.items():
        a.add_word(w, (len(w), tuple(ids)))
    a.make_automaton()
    return a


def _scan(automaton, joined: str) -> list[tuple[int, int, tuple[str, ...]]]:
    return [(end - n + 1, end, ids) for end, (n, ids) in automaton.iter(joined)] if len(automaton) else []


def contaminated_words(docs: DataFrame, items: DataFrame, size: int = 10, text_col: str = "text",
                       item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``
    and ``hit_spans`` (code points of the original text, end exclusive).

    Null or empty texts have no words and no hits.  Items without an id or a
    word take no part; items that share an id count once.  An empty benchmark
    hits nothing.
    """
    spark = docs.sparkSession
    blocks = [spark.sparkContext.broadcast(b) for b in _item_blocks(items, item_id, item_text)]

    def start():
        only = _automaton(blocks[0].value, size) if len(blocks) == 1 else None

        def compute(texts):
            words = [plain_words(t) for t in texts]
            joined = [f" {b' '.join(w).decode('latin-1')} " if w else "" for w in words]
            found = [[] for _ in texts]
            for block in blocks:
                automaton = only or _automaton(block.value, size)
                for k, j in enumerate(joined):
                    found[k] += _scan(automaton, j)
            out = [_summary(len(w), j, f, t) for w, j, f, t in zip(words, joined, found, texts, strict=True)]
            return list(zip(*out, strict=True)) if out else [[]] * 6

        return compute

    fields = [long_field("n_words"), long_field("n_hit"), long_field("n_items"), text_field("items_sha256"),
              ("contaminated", T.BooleanType(), pa.bool_()), ("hit_spans", _SPANS, _SPANS_ARROW)]
    return per_document(docs, fields, start, text_col, keep)


def _summary(n_words: int, joined: str, found: list, raw: bytes):
    items = sorted(set(itertools.chain.from_iterable(f[2] for f in found)))
    digest = hashlib.sha256(",".join(items).encode()).hexdigest()
    if not found:
        return n_words, 0, 0, digest, False, []
    spaces = np.flatnonzero(np.frombuffer(joined.encode("latin-1"), np.uint8) == 32)
    change = np.zeros(n_words + 1, np.int64)
    np.add.at(change, np.searchsorted(spaces, [f[0] for f in found]), 1)
    np.add.at(change, np.searchsorted(spaces, [f[1] for f in found]), -1)
    hit = np.cumsum(change)[:-1] > 0
    first, past = word_offsets(raw)
    spans = [{"start": int(first[s]), "end": int(past[e - 1])} for s, e in zip(*runs(hit), strict=True)]
    return n_words, int(hit.sum()), len(items), digest, True, spans


def clean_only(docs: DataFrame, items: DataFrame, size: int = 10, text_col: str = "text") -> DataFrame:
    """The rows that hold no window of the benchmark, with the columns of ``docs``."""
    columns = docs.columns
    named = [f"c{i}" for i in range(len(columns))]
    marked = contaminated_words(docs.toDF(*named), items, size, named[columns.index(text_col)])
    return marked.where(~F.col("contaminated")).select(*named).toDF(*columns)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contaminated_words(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"]).drop("hit_spans")


#: The same digest in SQL: windows as text, found by their ten-word keys.
_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark WHERE item_id IS NOT NULL),
pat AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS p
        FROM b, unnest(range(1, greatest(len(w) - 8, 2))) t(i) WHERE len(w) > 0),
occ AS (SELECT d.r, i, s.n, array_to_string(list_slice(w, i, i + s.n - 1), ' ') AS p
        FROM d, (SELECT DISTINCT n FROM pat) s, unnest(range(1, len(w) - s.n + 2)) t(i)),
hit AS (SELECT occ.r, occ.i, occ.n, pat.item_id FROM occ JOIN pat ON occ.p = pat.p AND occ.n = pat.n),
words AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM hit, unnest(range(0, n)) t(k) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s
        FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN ids USING (r)"""
