"""File sources and sinks.

Dictionaries and corpora arrive as CSV or text files; every reader returns
a DataFrame and leaves parsing to Spark's readers (no hand-written parser).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ascii_clean

# Fixed value: the text columns a corpus file may use, in order of preference.
TEXT_COLUMNS = ["Text", "text", "content", "document"]

CORRUPT = "_corrupt_record"


def _with_ids(df: DataFrame, id_col: str) -> DataFrame:
    """Stable row ids for one read of one input (partition id in the high
    bits, position inside the partition in the low bits)."""
    return df.withColumn(id_col, F.monotonically_increasing_id())


def load_dictionary_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless CSV, the name is field 0 (quoted fields may hold
    commas and newlines).  Duplicates and the first row are kept."""
    raw = spark.read.csv(path, header=False, quote='"', escape='"', multiLine=True)
    return _with_ids(raw.select(F.col("_c0").alias("name")), "entity_id").select("entity_id", "name")


def load_dictionary_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every non-blank line is a name, stripped and cleaned with N4
    (non-printable ASCII becomes a space, runs of spaces collapse)."""
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    kept = lines.where(F.length(F.trim("line")) > 0)
    return _with_ids(kept.select(ascii_clean(F.trim("line")).alias("name")), "entity_id").select("entity_id", "name")


def load_text_files(spark: SparkSession, path: str) -> DataFrame:
    """Each file is one document (``wholetext``), ``doc_id`` from the
    path so that it is stable across reads."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"),
                                                       F.input_file_name().alias("path"))
    return raw.select(F.xxhash64("path").alias("doc_id"), "path", "text")


def clean_header(df: DataFrame) -> DataFrame:
    """Strip double quotes from column names."""
    return df.toDF(*[c.strip('"') for c in df.columns])


def resolve_text_column(df: DataFrame, preferred: list[str] | None = None) -> str:
    """The first preferred column present, compared case-sensitively;
    otherwise an error listing both the preferences and the columns."""
    preferred = TEXT_COLUMNS if preferred is None else preferred
    for c in preferred:
        if c in df.columns:
            return c
    raise ValueError(f"no text column: looked for {preferred} among {df.columns}")


def load_documents_csv(spark: SparkSession, path: str, quoting: bool = True) -> tuple[DataFrame, DataFrame]:
    """S5 + S7: header CSV with multi-line quoted fields and doubled quotes.

    Returns ``(good, rejects)``: rows whose field count differs from the
    header, or whose quote never closes, go to ``rejects`` with the raw
    record (PERMISSIVE mode keeps them instead of failing the job).
    ``quoting=False`` is the fallback reader (S6) with quotes disabled.
    A ``doc_id`` is added when the file has none.
    """
    header = (spark.read.option("header", True).option("multiLine", True).option("quote", '"')
              .option("escape", '"').csv(path))
    cols = [c.strip('"') for c in header.columns]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in cols]
                          + [T.StructField(CORRUPT, T.StringType())])
    reader = (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", CORRUPT).option("enforceSchema", False))
    if quoting:
        reader = reader.option("multiLine", True).option("quote", '"').option("escape", '"')
    else:
        reader = reader.option("quote", "\u0000")
    df = reader.csv(path).cache()
    good = df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    rejects = df.where(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("record"),
                                                          F.lit("field count differs from header").alias("error"))
    if "doc_id" not in good.columns:
        good = _with_ids(good, "doc_id")
    return good, rejects


def require_rows(df: DataFrame, what: str = "document") -> DataFrame:
    """Raise when a reader kept no valid row."""
    if df.limit(1).count() == 0:
        raise ValueError(f"No valid {what} rows found.")
    return df


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Results are tables; the sink is parquet."""
    df.write.mode(mode).parquet(path)
