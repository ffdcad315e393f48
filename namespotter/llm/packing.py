"""Packing by concatenate and cut.

Pass one tokenizes every document, writes the ids with their running start
inside the task's partition, and thereby gives each partition's total.  A prefix
sum over the partition totals turns local starts into global offsets.  Pass two
cuts at every multiple of the sequence length: a document's ids fall into pieces
(sequence, offset), and a sequence that crosses a partition boundary is put
together from its boundary records alone.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .common import per_document, table

END_ID = 1
LENGTH = 2048
#: Largest id that the 16-bit columns hold.
ID_LIMIT = 1 << 16


def byte_alphabet() -> dict[str, int]:
    """The byte for each character of a byte-level vocabulary: printable Latin-1
    characters stand for themselves, the other bytes for the characters from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def file_encoding(path: str, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizer file, run by the faster of the two
    libraries that know it.  Ids are merge ranks in such a file, so both give
    the same ids.  A text is split at the file's added tokens first, which
    stand for their own ids."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    added = held.get("added_tokens", ())
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("added tokens must stand for exactly their own characters")
    special = {t["content"]: t["id"] for t in added}
    to_byte = byte_alphabet()
    ranks = {bytes(to_byte[c] for c in token): i for token, i in held["model"]["vocab"].items() if token not in special}
    if max([*ranks.values(), *special.values()]) >= ID_LIMIT:
        raise ValueError("ids are kept in 16 bits")
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = END_ID, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``part``, ``local_start``, ``doc_tokens`` and ``ids`` (unsigned little-endian 16-bit, with the end id)."""
    def start():
        encoding, at, part = file_encoding(tokenizer), 0, TaskContext.get().partitionId()

        def compute(texts):
            nonlocal at
            ids = [np.append(encoding.encode_to_numpy(t.decode(), allowed_special="all"), end_id).astype("<u2") for t in texts]
            sizes = np.array([len(x) for x in ids], np.int64)
            starts = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            return [np.full(len(ids), part, np.int64), starts, sizes, [x.tobytes() for x in ids]]

        return compute

    fields = [("part", T.LongType(), pa.int64()), ("local_start", T.LongType(), pa.int64()),
              ("doc_tokens", T.LongType(), pa.int64()), ("ids", T.BinaryType(), pa.binary())]
    return per_document(docs, fields, start, text_col, keep)


_PIECE = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "sequence_id", "offset")]
                      + [T.StructField("piece_ids", T.BinaryType())])


def packed_pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, text_col: str = "text",
                  keep: list[str] | None = None) -> DataFrame:
    """One row per piece: the kept columns of the document, ``start``, ``length``,
    ``ids_crc32`` (of the ids as unsigned little-endian 32-bit), ``doc_tokens``,
    ``sequence_id``, ``offset`` and ``piece_ids`` (16-bit ids).

    Every sequence but the last is full.  A null or empty text is the end id
    alone; an empty table has no piece.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in {"doc_tokens", *_PIECE.names}]
    named = {c: f"c{i}" for i, c in enumerate(kept)}
    own = docs.select(*[F.col(c).alias(n) for c, n in named.items()], F.col(text_col).alias("packed_text"))
    own = written(tokenized(own, tokenizer, end_id, "packed_text", keep=list(named.values())), "tokens")
    totals = own.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("part", F.coalesce(before, F.lit(0)).alias("part_start"))  # a row per input split
    rows = own.join(F.broadcast(offsets), "part").withColumn("global_start", F.col("part_start") + F.col("local_start"))
    rows = rows.select(*named.values(), "doc_tokens", "ids", "global_start")
    schema = T.StructType([rows.schema[n] for n in named.values()] + [T.StructField("doc_tokens", T.LongType()), *_PIECE.fields])

    def cut(batches):
        for b in batches:
            at = {c: i for i, c in enumerate(b.schema.names)}
            ids = b.column(at["ids"]).to_pylist()
            begin = b.column(at["global_start"]).to_pylist()
            row, cols = [], [[] for _ in _PIECE.names]
            for k, (g, raw) in enumerate(zip(begin, ids, strict=True)):
                n = len(raw) // 2
                wide = np.frombuffer(raw, "<u2").astype("<u4").tobytes()
                at_piece = 0
                while at_piece < n:
                    offset = (g + at_piece) % length
                    m = min(n - at_piece, length - offset)
                    row.append(k)
                    for c, v in zip(cols, (at_piece, m, zlib.crc32(wide[4 * at_piece:4 * (at_piece + m)]), (g + at_piece) // length, offset,
                                           raw[2 * at_piece:2 * (at_piece + m)]), strict=True):
                        c.append(v)
                    at_piece += m
            take = pa.array(row, pa.int64())
            same = [b.column(at[n]).take(take) for n in [*named.values(), "doc_tokens"]]
            made = [pa.array(c, pa.int64()) for c in cols[:-1]] + [pa.array(cols[-1], pa.binary())]
            yield pa.RecordBatch.from_arrays(same + made, names=schema.names)

    return rows.mapInArrow(cut, schema).toDF(*kept, "doc_tokens", *_PIECE.names)


def _local_windows(length: int):
    """Joins pieces that follow each other in a task into (sequence_id, offset, n_ids, ids)."""
    def run(batches):
        held = None  # sequence_id, offset, n_ids, parts
        for b in batches:
            out = []
            for s, o, n, ids in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if held and held[0] == s and held[1] + held[2] == o:
                    held[2] += n
                    held[3].append(ids)
                else:
                    out += [held] if held else []
                    held = [s, o, n, [ids]]
            yield _windows_batch(out)
        yield _windows_batch([held] if held else [])

    return run


def _windows_batch(rows):
    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array([b"".join(p) for p in columns[3]], pa.binary())],
                                      names=["sequence_id", "offset", "n_ids", "ids"])


def sequences(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """``sequence_id, n_ids, ids`` (16-bit, unpadded) from the pieces.

    Sequences that lie within a task are joined there; only the fragments of
    those that cross a task's boundary are shuffled.
    """
    own = pieces.select("sequence_id", "offset", "length", "piece_ids").mapInArrow(
        _local_windows(length), "sequence_id long, offset long, n_ids long, ids binary")
    own = written(own, "windows")
    full = own.where(F.col("n_ids") == length).select("sequence_id", "n_ids", "ids")
    order = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # disjoint fragments of one sequence: at most ``length``
    joined = F.aggregate(order, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    crossing = own.where(F.col("n_ids") < length).groupBy("sequence_id").agg(F.sum("n_ids").alias("n_ids"), joined.alias("ids"))
    return full.unionByName(crossing)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packed_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
