"""Exact dedup by content-defined chunk recipes, in DataFrame functions alone.

A text is cut into chunks where its own bytes say so (two neighbouring bytes of
a fixed class, at least ``least`` and at most ``most`` bytes after the last
cut), so equal passages give equal chunks wherever they stand.  A row's recipe
is the list of its chunks' 64-bit digests.  Rows whose recipe nobody shares are
settled without their text ever leaving its task.  Of the other rows the chunks
are deduplicated by digest *and* bytes: a digest that stands for one content
only is that content's identifier; contents that share a digest are numbered.
Rows are equal if their ordered lists of verified identifiers are equal.

Only recipes (about eight bytes for a thousand of text) are compared and joined
over whole rows.  A chunk crosses the network once per task that holds it, in
the verifying aggregate, and only if its row's recipe is shared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written
from .common import table

#: Bytes of a chunk: at least, at most.
LEAST, MOST = 1024, 8192
#: Shared recipes are broadcast up to this many (8 bytes each); beyond it every row's chunks are verified.
SHARED_MAX = 1_000_000
#: Rows of one group for one task of the last join, if they are dealt evenly.
ROWS_PER_SALT = 1_000_000
LEAST_SALTS = 64

Digest = Callable[[Column], Column]


def digest64(content: Column) -> Column:
    return F.xxhash64(content)


def boundary_pattern(least: int = LEAST, most: int = MOST) -> str:
    """Chunks of bytes read as Latin-1: the shortest run of ``least`` to
    ``most`` bytes that ends in two bytes of the class (values divisible by
    eight); without such an end, ``most`` bytes or what is left."""
    kinds = "[" + "".join(f"\\x{b:02X}" for b in range(0, 256, 8)) + "]"
    return f"(?s).{{{least - 2},{most - 2}}}?{kinds}{kinds}|.{{1,{most}}}"


def chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The chunks of a text in order, one Latin-1 character a byte, so that any bytes stay apart; none for null or empty."""
    raw = F.decode(F.coalesce(text, F.lit("")).cast("binary"), "ISO-8859-1")
    return F.regexp_extract_all(raw, F.lit(boundary_pattern(least, most)), F.lit(0))


def _clashes(cut: DataFrame, recipes: DataFrame, digest: Digest, shared_max: int) -> DataFrame | None:
    """``digest, content, version`` of every content, beyond the first, of a
    digest that several contents have in rows of shared recipes; None where
    every digest is verified to stand for one content."""
    shared = recipes.groupBy("recipe_hash").agg(F.count("*").alias("n")).where("n > 1").select("recipe_hash")
    few = shared.count()
    if few == 0:
        return None
    rows = cut
    if few <= shared_max:
        rows = cut.withColumn("recipe_hash", F.xxhash64(F.transform("chunks", digest)))
        rows = rows.join(F.broadcast(shared), "recipe_hash", "left_semi")
    each = rows.select(F.explode("chunks").alias("content")).select(digest(F.col("content")).alias("digest"), "content")
    several = each.distinct().groupBy("digest").agg(F.count("*").alias("contents"), F.min("content").alias("first"))
    several = written(several.where("contents > 1").select("digest", "first"), "chunk-clashes")
    if several.isEmpty():
        return None
    others = each.join(several, "digest").where("content <> first").select("digest", "content").distinct()
    return others.withColumn("version", F.row_number().over(Window.partitionBy("digest").orderBy("content")))


def _versions(cut: DataFrame, clashes: DataFrame, digest: Digest) -> DataFrame:
    """``sha, recipe, versions``: place and version of each numbered content of a text."""
    parts = cut.select("sha", F.transform("chunks", digest).alias("recipe"), F.posexplode("chunks").alias("place", "content"))
    found = parts.withColumn("digest", digest(F.col("content"))).join(clashes, ["digest", "content"])
    return found.groupBy("sha", "recipe").agg(F.array_sort(F.collect_set(F.struct("place", "version"))).alias("versions"))


def exact_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least: int = LEAST, most: int = MOST,
                     digest: Digest = digest64, shared_max: int = SHARED_MAX) -> DataFrame:
    """``id, keep_id, group_size, kept, text_sha256`` for every row (the first
    column under the name ``id_col``); no other column of ``docs`` is read.

    Texts are equal when their bytes are.  Null counts as the empty text.  The
    row with the largest id stays, a null id being smaller than any; among rows
    with that id exactly one stays.  ``keep_id`` is null only if all ids of the
    group are.  Repeated rows are rows of their own.  An empty table gives an
    empty one.  ``digest`` need not be free of collisions, its clashes are
    found by comparing contents.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    cut = docs.select(docs[id_col].alias("id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"),
                      chunks(text, least, most).alias("chunks"))
    listed = cut.select("id", "sha", F.transform("chunks", digest).alias("recipe"))
    recipes = written(listed.select("*", F.xxhash64("recipe").alias("recipe_hash"),
                                    F.monotonically_increasing_id().alias("rid")), "recipes")
    clashes = _clashes(cut, recipes, digest, shared_max)
    rows = recipes
    if clashes is not None:
        rows = rows.join(_versions(cut, clashes, digest), ["sha", "recipe"], "left")
        rows = rows.withColumn("recipe", F.struct("recipe", F.coalesce("versions", F.array()).alias("versions")))
    # Groups: at most `salts` partial rows of a key meet, and each salt of a hot group is joined back on its own.
    salts = max(LEAST_SALTS, recipes.count() // ROWS_PER_SALT)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(salts)))
    part = rows.groupBy("recipe_hash", "recipe", "salt").agg(F.count("*").alias("n"), F.max(F.struct("id", "rid")).alias("last"))
    group = part.groupBy("recipe_hash", "recipe").agg(F.sum("n").alias("group_size"), F.max("last").alias("last"),
                                                      F.collect_list("salt").alias("at"))
    back = group.select("recipe_hash", "recipe", "group_size", "last", F.explode("at").alias("salt"))
    return rows.join(back, ["recipe_hash", "recipe", "salt"]).select(
        F.col("id").alias(id_col), F.col("last.id").alias("keep_id"), "group_size",
        (F.col("rid") == F.col("last.rid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       coalesce(row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1, false) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
