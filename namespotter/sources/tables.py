"""Driver tables and the fixtures derived from them (FIXTURES.md section 3).

Every derived table is a Spark plan over the parquet tables, so its size
grows with them.  Nothing is sampled or capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import split_ws
from ..functions.windows import word_chunks
from ..session import sf_path


#: Entity numbers of a passage: more than a passage of 300,000 words has groups.
GROUPS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(sf_path(sf_dir, name))


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan of few splits over the cores.

    A large corpus arrives in many splits and is left alone, also when they
    fall short of the cores by up to half, for a shuffle of the raw text
    would cost more.  A single big row group puts every document of it into
    one task however many splits its file has, so the splits are held against
    the rows of the fullest (read from the footers)."""
    target = df.sparkSession.sparkContext.defaultParallelism
    if 2 * df.rdd.getNumPartitions() >= target:
        rows = df.groupBy(F.spark_partition_id().alias("split")).count().agg(F.sum("count").alias("all"), F.max("count").alias("most")).first()
        if 2 * (rows["all"] or 0) >= target * (rows["most"] or 0):
            return df
    return df.repartition(target)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus: ``doc_id, text`` (the other columns are pruned at the scan)."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def entities_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary: every group of three whitespace words of every
    ``benchmark`` passage (the last group has what is left), numbered by
    passage and group."""
    b = table(spark, sf_dir, "benchmark").select("item_id", split_ws("text").alias("words"))
    groups = b.select("item_id", F.posexplode(word_chunks("words", 3)).alias("g", "name"))
    return groups.select((F.col("item_id") * GROUPS + F.col("g")).alias("entity_id"), "name")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One response text per conversation turn: assistant turns answer with
    a quoted tuple, user turns with single quotes, all other turns with a
    tuple that lacks its number.  The name is the first word run of the
    turn's text, the certainty the last two digits of its length."""
    c = table(spark, sf_dir, "conversations")
    name = F.regexp_extract("text", r"([\p{L}]+)", 1)
    sure = F.concat(F.lit("0."), F.lpad((F.length("text") % 100).cast("string"), 2, "0"))
    text = (F.when(F.col("role") == "assistant", F.concat(F.lit('[("'), name, F.lit('", '), sure, F.lit('), ("'),
                                                          F.lower(name), F.lit('", 1)]')))
            .when(F.col("role") == "user", F.concat(F.lit("Sure: ('"), name, F.lit("',"), sure, F.lit(")")))
            .otherwise(F.concat(F.lit('("'), name, F.lit('", )'))))
    return c.select("conv_id", "turn", text.alias("text"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
