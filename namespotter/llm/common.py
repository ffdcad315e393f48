"""Helpers shared by the training-data operators.

Text rules that hold for every operator here: a null text counts as the empty
text, whole texts are read, and repeated rows are rows of their own.  Where an
input column carries the name of a column the operator returns, the operator's
column replaces it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import sf_path

#: name, Spark type, Arrow type of a computed column
Field = tuple[str, T.DataType, pa.DataType]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(sf_path(sf_dir, name))


def long_field(name: str) -> Field:
    return name, T.LongType(), pa.int64()


def text_field(name: str) -> Field:
    return name, T.StringType(), pa.string()


def per_document(docs: DataFrame, fields: list[Field], start: Callable, text_col: str = "text",
                 keep: list[str] | None = None) -> DataFrame:
    """Append columns computed from each whole text, one Arrow batch at a time.

    ``start()`` runs once per task and returns a function from the list of the
    batch's texts (UTF-8 bytes, null as empty) to the lists of the new columns
    in the order of ``fields``.  ``keep`` names the input columns to return
    (default: all); nothing else is read by the task.
    """
    names = [f[0] for f in fields]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    taken = kept if text_col in kept else [*kept, text_col]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(n, t) for n, t, _ in fields])

    def run(batches):
        compute = start()
        for b in batches:
            at = {c: i for i, c in enumerate(b.schema.names)}
            texts = [x or b"" for x in b.column(at[text_col]).cast(pa.binary()).to_pylist()]
            made = [pa.array(v, type=f[2]) for v, f in zip(compute(texts), fields, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(at[c]) for c in kept] + made, names=kept + names)

    return docs.select(*taken).mapInArrow(run, schema)


# ------------------------------------------------------------------ words
#: Fixed value: bytes that end a word of letters and digits (the rest of ASCII
#: after lower-casing A-Z); bytes of other characters belong to words.
_KEPT = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
WORD_BYTES = bytes(c if c in _KEPT else 32 for c in (b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)))


def plain_words(raw: bytes) -> list[bytes]:
    """Lower-case A-Z, then the runs of ASCII letters, digits and any non-ASCII characters."""
    return raw.translate(WORD_BYTES).split()


def spaced_words(raw: bytes) -> list[bytes]:
    """Lower-case A-Z, then the runs of anything but ASCII white space."""
    return raw.lower().split()


def word_offsets(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word of ``plain_words`` in code points of the original text."""
    b = np.frombuffer(raw.translate(WORD_BYTES), np.uint8)
    inside = np.concatenate(([0], (b != 32).view(np.int8), [0]))
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    point = np.concatenate(([0], np.cumsum(lead)))
    return point[starts], point[ends]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of set elements."""
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def table_bytes(df: DataFrame, col: str) -> int:
    """Total UTF-8 bytes of a column: the figure a broadcast is checked against."""
    return df.agg(F.coalesce(F.sum(F.octet_length(col)), F.lit(0)).alias("n")).first()["n"]


def salted_join(rows: DataFrame, keyed: DataFrame, keys: list[str], salts: int) -> DataFrame:
    """``rows`` joined with ``keyed`` (one row a key), a hot key being dealt to
    up to ``salts`` tasks: its row of ``keyed`` is copied to the salts at which
    the key occurs, other rows once.  Rows of unknown keys go."""
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)))
    at = dealt.select(*keys, "salt").distinct().groupBy(*keys).agg(F.collect_list("salt").alias("at"))
    spread = keyed.join(at, keys).withColumn("salt", F.explode("at")).drop("at")
    return dealt.join(spread, [*keys, "salt"]).drop("salt")
