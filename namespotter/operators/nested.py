"""Nested loops for scores that have no exact equi-join blocking
(Jaro-Winkler, sequence-matcher ratios, dense cosine).

A dictionary of at most one block is broadcast (its rows are counted first)
and the query side streams past it in Arrow batches.  A larger dictionary
stays distributed: both sides are cut into blocks by hash and every (query
block, dictionary block) pair is one group of a cogrouped join, so neither
the driver nor a task ever holds more than a block of each side.  Kernels
see at most ``CELLS`` (query, name) cells at a time.
"""

from __future__ import annotations

from typing import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import written
from .common import spread_work

# Rows of the dictionary side one block may hold.
DICT_BLOCK_ROWS = 4096
# Rows of the query side in one block of the grid.
QUERY_BLOCK_ROWS = 16_384
# (query, name) cells a kernel is given at a time: 32 MB for a double each.
CELLS = 1 << 22


def tiled(batch: pd.DataFrame, names: int, kernel: Callable, prepared, cells: int | None = None):
    """Results of ``kernel`` over slices of ``batch`` within the cell budget."""
    step = max(1, min(4096, (cells or CELLS) // max(names, 1)))
    for lo in range(0, len(batch), step):
        out = kernel(batch.iloc[lo:lo + step].reset_index(drop=True), prepared)
        if len(out):
            yield out


def against_dictionary(queries: DataFrame, dictionary: DataFrame,
                       kernel: Callable[[pd.DataFrame, object], pd.DataFrame],
                       prepare: Callable[[pd.DataFrame], object], schema: str,
                       block_rows: int | None = None, query_rows: int | None = None,
                       arrow: bool = False, cells: int | None = None) -> DataFrame:
    """Apply ``kernel(query_slice, prepared_block)`` to all rows of
    ``queries`` and every dictionary block; ``prepare`` runs once per block
    and task (e.g. to encode the names as arrays).  With ``arrow`` the kernel
    returns a record batch, which saves making an object of every string of a
    pair; one that keeps its own memory bounded may be given more ``cells``."""
    block_rows, query_rows = block_rows or DICT_BLOCK_ROWS, query_rows or QUERY_BLOCK_ROWS
    n = dictionary.count()
    if n <= block_rows:
        names = queries.sparkSession.sparkContext.broadcast(dictionary.toPandas())

        def run(batches):
            prepared = None
            for batch in batches:
                if prepared is None:
                    prepared = prepare(names.value)
                yield from tiled(batch, n, kernel, prepared, cells)

        dealt = spread_work(queries)
        if arrow:
            return dealt.mapInArrow(lambda batches: run(b.to_pandas() for b in batches), schema)
        return dealt.mapInPandas(run, schema)

    queries = written(queries, "nested-queries")
    n_d, n_q = -(-n // block_rows), max(1, -(-queries.count() // query_rows))
    # hashes are taken mod the block counts: a block holds its rows give or take a few standard deviations
    q = queries.withColumn("_qb", F.pmod(F.xxhash64(*queries.columns), F.lit(n_q)).cast("int")) \
        .withColumn("_db", F.explode(F.sequence(F.lit(0), F.lit(n_d - 1))))
    d = dictionary.withColumn("_db", F.pmod(F.xxhash64(*dictionary.columns), F.lit(n_d)).cast("int")) \
        .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    empty = schema_columns(schema)

    def results(left: pd.DataFrame, right: pd.DataFrame) -> list:
        if not len(left) or not len(right):
            return []
        prepared = prepare(right.drop(columns=["_qb", "_db"]).reset_index(drop=True))
        return list(tiled(left.drop(columns=["_qb", "_db"]), len(right), kernel, prepared, cells))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = results(left, right)
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame(columns=empty)

    def arrow_cell(left: pa.Table, right: pa.Table) -> pa.Table:
        found = results(left.to_pandas(), right.to_pandas())
        return pa.Table.from_batches(found) if found else arrow_schema.empty_table()

    cells_of = q.groupBy("_qb", "_db").cogroup(d.groupBy("_qb", "_db"))
    if arrow:
        arrow_schema = to_arrow_schema(T._parse_datatype_string(schema))
        return cells_of.applyInArrow(arrow_cell, schema)
    return cells_of.applyInPandas(cell, schema)


def schema_columns(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(",")]
