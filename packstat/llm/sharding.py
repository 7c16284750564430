"""Sharding by a hierarchical weighted hash tree.

A key descends region, rack and shard; at each node every child draws ``-ln(u) / weight`` from a
hash of (child, key) and the least draw wins, so a child gets its share of the weight and a change
of weights moves keys only into or out of the subtrees whose weights changed. A shard that is added
comes as a region of its own: the draws of all others stay, so keys move only into it.

Null ids count as the empty string, null texts as empty. Rows that repeat an id share its shard;
each gets a slot of its own. Empty tables give no rows. Columns beyond doc_id and text are ignored.
Weights are those of shards, one each if none are given; a node weighs what its shards weigh, and what weighs nothing gets nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packstat.llm.common import rank_within
from packstat.session import checkpoint

#: Shards of the base tree: regions x racks x shards.
BASE = (2, 2, 2)


@dataclass
class Node:
    """A subtree: its name, its weight, its children, or the shard if it is a leaf."""

    name: str
    weight: float
    children: list[Node] = field(default_factory=list)
    shard: int = -1


def topology(shards: int, weights: Sequence[float] | None = None, base: tuple[int, int, int] = BASE) -> Node:
    """The first shards fill the base tree; each further one is a region on its own. Shards past the end of ``weights`` weigh one."""
    regions, racks, leaves = base
    given = [*(weights or []), *[1.0] * shards][:shards]
    if min(given, default=0.0) < 0 or not 0 < sum(given) < float("inf"):
        raise ValueError("weights of shards are finite, none below zero, and one at least above")
    made, top = 0, Node("root", 0.0)
    while made < shards:
        region = Node(f"r{len(top.children)}", 0.0)
        for rack in range(racks if len(top.children) < regions else 1):
            node = Node(f"{region.name}k{rack}", 0.0)
            for leaf in range(leaves if len(top.children) < regions else 1):
                if made < shards:
                    node.children.append(Node(f"{node.name}s{leaf}", given[made], shard=made))
                    made += 1
            if node.children:
                node.weight = sum(c.weight for c in node.children)
                region.children.append(node)
        region.weight = sum(c.weight for c in region.children)
        top.children.append(region)
    return top


def draw(key: Column, node: Node) -> Column:
    """The weighted draw of one child; 52 bits of a hash make the uniform number."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{node.name}/"), key)), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(2**52))) / F.lit(node.weight)


def descend(key: Column, node: Node) -> Column:
    """The shard below ``node`` that a key falls into."""
    if node.shard >= 0:
        return F.lit(node.shard)
    open_ = [c for c in node.children if c.weight > 0]
    if len(open_) == 1:
        return descend(key, open_[0])
    drawn = [F.struct(draw(key, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(open_)]
    won = F.least(*drawn)["i"]
    out = F.when(won == 0, descend(key, open_[0]))
    for i, child in enumerate(open_[1:], 1):
        out = out.when(won == i, descend(key, child))
    return out


def shard_documents(docs: DataFrame, shards: int = 8, weights: Sequence[float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (with one shard more, of weight one)."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    bytes_ = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    placed = checkpoint(docs.select(
        "doc_id", (F.octet_length(bytes_) + 1).cast("long").alias("size"), F.crc32(bytes_).alias("text_crc32"), F.lit("key").alias("law"),
        descend(key, topology(shards, weights)).cast("int").alias("shard"),
        descend(key, topology(shards + 1, weights)).cast("int").alias("grown_shard")))
    return rank_within(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 8, weights: Sequence[float] | None = None) -> None:
    """The documents themselves, a folder for each shard."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    docs.withColumn("shard", descend(key, topology(shards, weights))).write.partitionBy("shard").parquet(path)
