"""Sharding by a hierarchical weighted hash tree.

The tree has regions, racks and shards.  A key descends by one weighted hash
draw per level: among the children of a node the smallest ``-ln(u) / weight``
wins, where ``u`` is a hash of the key and the child.  A change of weights moves
keys only into or out of the subtrees whose weights change.  A new shard opens a
region of its own, so it takes keys only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written
from .common import table


@dataclass(frozen=True)
class Shard:
    shard: int
    weight: float = 1.0


@dataclass(frozen=True)
class Node:
    """A region or a rack; its weight is the sum of its children's."""
    name: str
    children: tuple

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children)


def shard_tree(n: int, racks: int = 2, per_rack: int = 4, base: int | None = None) -> Node:
    """The tree of ``n`` equal shards: full regions of ``racks`` times ``per_rack``
    shards for the first ``base`` (default: as many as fill regions), and a
    region of its own for every further one."""
    size = racks * per_rack
    base = n // size * size if base is None else base
    regions = [Node(f"region{r}", tuple(
        Node(f"rack{k}", tuple(Shard(r * size + k * per_rack + i) for i in range(per_rack))) for k in range(racks))) for r in range(base // size)]
    regions += [Node(f"region-of-{i}", (Node("rack0", (Shard(i),)),)) for i in range(base // size * size, n)]
    return Node("root", tuple(regions))


def grown(tree: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region of its own."""
    n = 1 + max(s.shard for r in tree.children for k in r.children for s in k.children)
    return Node(tree.name, (*tree.children, Node(f"region-of-{n}", (Node("rack0", (Shard(n, weight),)),))))


def _draw(key: Column, path: str, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(path)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(weight)


def _place(key: Column, node, path: str) -> Column:
    """The shard that ``key`` reaches below ``node``."""
    if isinstance(node, Shard):
        return F.lit(node.shard)
    below = [c for c in node.children if c.weight > 0]
    names = [f"{path}/{c.shard if isinstance(c, Shard) else c.name}" for c in below]
    if len(below) == 1:
        return _place(key, below[0], names[0])
    draws = [_draw(key, p, c.weight) for c, p in zip(below, names, strict=True)]
    least = F.array_position(F.array(*draws), F.array_min(F.array(*draws)))
    out = _place(key, below[-1], names[-1])
    for i in reversed(range(len(below) - 1)):
        out = F.when(least == i + 1, _place(key, below[i], names[i])).otherwise(out)
    return out


def assign_shards(docs: DataFrame, tree: Node, id_col: str = "doc_id", name: str = "shard") -> DataFrame:
    """Add the shard of each row's id.  A null id is a key like any other; rows
    that share an id share a shard."""
    return docs.withColumn(name, _place(F.coalesce(F.col(id_col).cast("string"), F.lit("")), tree, tree.name).cast("int"))


def with_slots(rows: DataFrame, order: list[str], shard: str = "shard", cells: int = 64) -> DataFrame:
    """Add ``slot``: 0, 1, ... within each shard.

    The rows of a shard are dealt over ``cells`` cells, each numbered after the
    cells before it, so no task orders a whole shard; equal rows, however many,
    fall into different cells.  The dealing is written once, as counts and
    numbers must see the same one.
    """
    dealt = rows.withColumn("cell", F.pmod(F.xxhash64(*order, F.monotonically_increasing_id()), F.lit(cells)))
    at = written(dealt, "slots")
    before = F.sum("n").over(Window.partitionBy(shard).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    starts = at.groupBy(shard, "cell").agg(F.count("*").alias("n")).select(shard, "cell", F.coalesce(before, F.lit(0)).alias("cell_start"))
    numbered = at.withColumn("rank", F.row_number().over(Window.partitionBy(shard, "cell").orderBy(*order)))
    return numbered.join(starts, [shard, "cell"]).withColumn(
        "slot", F.col("cell_start") + F.col("rank") - 1).drop("cell", "cell_start", "rank")


def placement(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row.

    ``size`` is the text's UTF-8 bytes plus ``overhead``; a null text has no
    bytes.  ``grown_shard`` is the shard in the tree with one more shard.
    """
    tree = shard_tree(shards)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), (F.octet_length(text) + overhead).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    rows = assign_shards(assign_shards(rows, tree, id_col), grown(tree), id_col, "grown_shard")
    out = with_slots(rows, [id_col, "size", "text_crc32"])
    return out.select(id_col, "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, tree: Node, path: str, id_col: str = "doc_id", files: int = 8) -> None:
    """Write one folder per shard, each of about ``files`` files, in one shuffle."""
    out = assign_shards(docs, tree, id_col)
    n = sum(len(k.children) for r in tree.children for k in r.children)
    out.repartition(n * files, "shard", F.pmod(F.xxhash64(id_col), F.lit(files))).write.partitionBy("shard").parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement(table(spark, sf_dir, "documents"), shards=40)
