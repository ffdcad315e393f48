"""Nearest neighbours by inner product: one vantage-point tree per shard.

A shard's vectors get one more component, ``sqrt(M^2 - |x|^2)`` with M the
largest norm of the shard, and a query gets a zero; then the Euclidean distance
falls as the inner product rises, and triangle-inequality pruning is sound.  A
subtree is passed over if ``factor`` times its distance bound exceeds the
distance of the query's k-th best so far: factor one is exact search, larger
factors prune more.  All queries of a block go down the tree together.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SHARD_ROWS = 8192
QUERY_ROWS = 4096
LEAF = 64
FACTOR = 1.1


def usable(col: str) -> Column:
    """True for vectors that are not null, not zero and hold finite numbers only."""
    v = F.col(col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


class VantageTree:
    """A node is a row array (leaf) or (vantage row, [(least, most distance, node), ...])."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        self.vectors, self.leaf = vectors, leaf
        norms = (vectors * vectors).sum(axis=1)
        self.top = norms.max(initial=0.0)
        self.lifted = np.column_stack([vectors, np.sqrt(np.maximum(self.top - norms, 0))])
        self.root = self._build(np.arange(len(vectors)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        x = self.lifted[rows]
        pick = int(((x - x[0]) ** 2).sum(axis=1).argmax())  # far out, for spread distances
        d = np.sqrt(((x - x[pick]) ** 2).sum(axis=1))
        order = np.argsort(d, kind="stable")
        if d[order[0]] == d[order[-1]]:
            return rows  # nothing to tell them apart by
        half = len(rows) // 2
        return int(rows[pick]), [(d[o[0]], d[o[-1]], self._build(rows[o])) for o in (order[:half], order[half:])]

    def search(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, factor: float = FACTOR):
        """Scores and rows of each query's k best (-inf and -1 where there are fewer)."""
        n = len(queries)
        score, row = np.full((n, k), -np.inf), np.full((n, k), -1)
        square = (queries * queries).sum(axis=1) + self.top
        slack = 1e-9 * (1 + square)  # rounding must not prune

        def offer(rows, at):
            for i in range(0, len(rows), 256):
                part = rows[i:i + 256]
                near = queries[at] @ self.vectors[part].T
                for a in range(0, len(at), 512):
                    some = at[a:a + 512]
                    keep = (near[a:a + 512] >= (score[some, -1] - slack[some])[:, None]).any(axis=1)
                    some = some[keep]
                    if not len(some):
                        continue
                    # one fixed order of addition, so that equal vectors score equally
                    s = np.stack([(self.vectors[part] * queries[q]).sum(axis=1) for q in some])
                    s[own[some][:, None] == ids[part][None, :]] = -np.inf
                    s = np.concatenate([score[some], s], axis=1)
                    r = np.concatenate([row[some], np.broadcast_to(part, (len(some), len(part)))], axis=1)
                    name = np.where(r >= 0, ids[r], np.iinfo(np.int64).max)
                    order = np.lexsort((name, -s), axis=1)[:, :k]
                    score[some], row[some] = np.take_along_axis(s, order, 1), np.take_along_axis(r, order, 1)

        def visit(node, at):
            if not len(at):
                return
            if isinstance(node, np.ndarray):
                offer(node, at)
                return
            vantage, children = node
            d = np.sqrt(np.maximum(square[at] - 2 * (queries[at] @ self.vectors[vantage]), 0))
            bound = np.stack([np.maximum(np.maximum(low - d, d - high), 0) for low, high, _ in children])
            first = np.where(np.abs(bound[0] - bound[1]) > 0, bound.argmin(axis=0), (d > children[0][1]).astype(int))
            for turn in (0, 1):
                for c in (0, 1):
                    mine = first == (c if turn == 0 else 1 - c)
                    far = square[at] - 2 * score[at, -1]  # squared distance of the k-th best
                    open_ = mine & (factor * factor * bound[c] ** 2 <= far + slack[at])
                    visit(children[c][2], at[open_])

        visit(self.root, np.arange(n))
        row[np.isneginf(score)] = -1
        return score, row


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = FACTOR, id_col: str = "vec_id",
            vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` rows of largest inner
    product, nearest first, ties to the smaller id; all if there are fewer.

    A query's own row is any with its id.  Rows without an id and unusable
    vectors take no part on either side; vectors meet those of their length
    only.  Equal query rows count once.
    """
    as_double = F.transform(vector_col, lambda x: x.cast("double")).alias("v")
    take = lambda df: df.where(F.col(id_col).isNotNull() & usable(vector_col)).select(F.col(id_col).cast("long").alias("id"), as_double)
    rows, asked = take(vectors), take(queries).distinct()
    shards = 1 + rows.count() // shard_rows
    blocks = 1 + asked.count() // query_rows
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = rows.select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int").alias("shard"),
                       every(blocks).alias("block"))
    asked = asked.select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("block"),
                         every(shards).alias("shard"))

    def search(own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(ask):
            return pd.DataFrame({"query": [], "vec_id": [], "query_id": [], "score": []})
        ids, q = own["id"].to_numpy(), ask["id"].to_numpy()
        score, row = VantageTree(np.stack(own["v"].to_list())).search(np.stack(ask["v"].to_list()), q, ids, k, factor)
        at, _ = np.nonzero(row >= 0)
        return pd.DataFrame({"query": ask["v"].map(hash_of).to_numpy()[at], "query_id": q[at], "vec_id": ids[row[row >= 0]], "score": score[row >= 0]})

    keys = ["dim", "shard", "block"]
    found = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(search, "query long, query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def hash_of(v) -> int:
    """Tells apart queries that share an id: a digest of the components in their order."""
    return int.from_bytes(hashlib.blake2b(np.asarray(v, np.float64).tobytes(), digest_size=8).digest(), "little", signed=True)


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.where(F.col("vec_id") % 20 == 0), k=20)
