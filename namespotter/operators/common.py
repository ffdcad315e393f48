"""Shared plan helpers: size-checked broadcast, window tables, dictionary
normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import alnum_lower, split_ws, strip_punct
from ..functions.windows import word_windows

# Largest table (bytes in Spark's row format, estimated) we hand to a broadcast
# hash join.  The bound is checked with an aggregate before the hint is given;
# above it the join stays a shuffle join that AQE may still split for skew.
BROADCAST_MAX_BYTES = 128 << 20


def table_bytes(df: DataFrame) -> int:
    """Estimated bytes of ``df``: eight per column and for the null bits, plus strings and arrays as they are."""
    row = F.lit(8 * (len(df.columns) + 1))
    for f in df.schema:
        kind = f.dataType.simpleString()
        if kind == "string":
            row = row + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif kind.startswith("array"):
            row = row + 32 * F.greatest(F.size(f.name), F.lit(0))
    return df.agg(F.coalesce(F.sum(row.cast("long")), F.lit(0)).alias("n")).first()["n"]


def bounded_broadcast(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast ``df`` only if its measured size is small; otherwise return
    it unchanged so the planner picks a shuffle join."""
    return F.broadcast(df) if table_bytes(df) <= max_bytes else df


def spread_work(df: DataFrame, *by: str) -> DataFrame:
    """Round-robin the rows (or deal them by columns) over the cluster's shuffle-partition count before
    CPU-heavy per-row work.  Adaptive execution sizes partitions by bytes,
    so a few bytes of candidate pairs that each cost a kernel call would
    otherwise be coalesced into a single task; an explicit partition count
    is kept as asked."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *by)


def doc_words(docs: DataFrame, text_col: str = "text", order: str = "norm_then_split") -> Column:
    """Words of a document in one of the two orders the matchers use (T3):
    ``norm_then_split`` strips punctuation first (a lone ``&`` vanishes);
    ``split_then_norm`` splits the raw text (a lone ``&`` keeps its slot)."""
    if order == "norm_then_split":
        return split_ws(strip_punct(text_col))
    if order == "split_then_norm":
        return split_ws(text_col)
    raise ValueError(f"unknown order {order!r}")


def with_words(docs: DataFrame, text_col: str = "text", order: str = "norm_then_split") -> DataFrame:
    """Add the ``words`` array as its own column.  Window expressions refer
    to it many times inside lambdas; a materialised column is split once,
    an inlined expression would be re-split for every window.  (Catalyst
    does not collapse a costly projection into a consumer that reads it
    more than once, so the split stays in its own Project.)"""
    return docs.select("*", doc_words(docs, text_col, order).alias("words"))


def trigram_windows(docs: DataFrame, text_col: str = "text", order: str = "norm_then_split",
                    size: int = 3, keep_position: bool = True) -> DataFrame:
    """W1 as rows: ``doc_id, pos, window`` (pos is 0-based)."""
    words = with_words(docs, text_col, order)
    out = words.select("doc_id", F.posexplode(word_windows("words", size)).alias("pos", "window"))
    return out if keep_position else out.select("window")


def distinct_norm_windows(docs: DataFrame, word_norm=None, text_col: str = "text",
                          order: str = "norm_then_split", size: int = 3, sep: str = " ") -> DataFrame:
    """Distinct normalised windows ``w`` with their occurrence count (scores
    depend on the text only, 4.3.1).  ``word_norm`` normalises each word
    once before windows are cut: for the alphanumeric form the normalised
    window is the concatenation of normalised words (``sep=''``), which
    saves normalising every word three times.  Partial aggregation
    collapses repeats before the shuffle."""
    words = with_words(docs.select(text_col), text_col, order)
    if word_norm is not None:
        words = words.select(F.transform("words", word_norm).alias("words"))
    w = words.select(F.explode(word_windows("words", size, sep)).alias("w"))
    return w.groupBy("w").agg(F.count(F.lit(1)).alias("n_occ"))


def normalised_entities(entities: DataFrame, norm, name_col: str = "name") -> DataFrame:
    """``entity_id, name, nn``: each name normalised once, not once per pair."""
    return entities.select("entity_id", F.col(name_col).alias("name"),
                           norm(F.col(name_col)).alias("nn"))
