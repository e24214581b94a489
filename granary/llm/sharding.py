"""Stable shard placement by a hierarchical weighted hash tree."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import quoted, stored


@dataclass(frozen=True)
class Node:
    """A region, rack or shard. Only shards have a number and no children."""

    name: str
    weight: float = 1.0
    shard: int | None = None
    children: tuple[Node, ...] = field(default=())

    def total(self) -> float:
        return sum(c.total() for c in self.children) if self.children else self.weight


def even_tree(shards: int = 16, racks: int = 4, regions: int = 2) -> Node:
    """``shards`` of weight 1, dealt over ``racks``, and these over ``regions``."""

    def shard(k: int) -> Node:
        return Node(f"shard-{k}", 1.0, k)

    rack_nodes = [
        Node(f"rack-{r}", children=tuple(shard(k) for k in range(shards) if k * racks // shards == r))
        for r in range(racks)
    ]
    region_nodes = [
        Node(f"region-{g}", children=tuple(x for r, x in enumerate(rack_nodes) if r * regions // racks == g and x.children))
        for g in range(regions)
    ]
    return Node("root", children=tuple(g for g in region_nodes if g.children))


def with_region(tree: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard, as a rack in a region of its own.

    No present subtree changes its weight, so rows move into the new shard only.
    (A shard put into a present rack would raise the weight of that rack and its
    region, and rows from elsewhere could then land on their other shards.)
    """
    rack = Node(f"rack-of-{shard}", children=(Node(f"shard-{shard}", weight, shard),))
    return Node(tree.name, children=(*tree.children, Node(f"region-of-{shard}", children=(rack,))))


def _draw(key: Column, child: Node) -> Column:
    """Exponential draw of the child's weight; the least of all siblings wins.

    It depends on the key, the child's name and weight and on nothing else, so a
    change of one weight moves keys only to or from that child.
    """
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(child.name)), 11)
    uniform = (bits + 1).cast("double") / F.lit(float(1 << 53))
    return -F.log(uniform) / F.lit(float(child.total()))


def place(key: Column, node: Node) -> Column:
    """Shard number of ``key`` below ``node``; equal draws go to the earlier child."""
    if node.shard is not None:
        return F.lit(node.shard).cast("int")
    children = [c for c in node.children if c.total() > 0]
    if not children:
        raise ValueError(f"{node.name} has no weight")
    if len(children) == 1:
        return place(key, children[0])
    draws = F.array(*[F.struct(_draw(key, c).alias("draw"), F.lit(k).alias("child")) for k, c in enumerate(children)])
    winner = F.array_min(draws)["child"]
    below = F.when(winner == 0, place(key, children[0]))
    for k, child in enumerate(children[1:-1], 1):
        below = below.when(winner == k, place(key, child))
    return below.otherwise(place(key, children[-1]))


def numbered(df: DataFrame, by: Sequence[str], part: str, row: str, name: str) -> DataFrame:
    """Number the rows of each ``by`` group from 0 without gaps.

    ``part`` is the input partition of a row and ``row`` its order there. Rows
    are numbered inside (group, part) and shifted by the rows of earlier parts,
    so a group of any size is spread over as many tasks as it has input parts,
    and only counts, one per group and part, are summed along a group.
    """
    counts = df.groupBy(*by, part).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*by, part, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*by, part).orderBy(row)) - 1
    return (
        df.withColumn("_inside", inside)
        .join(shifts, [*by, part])
        .withColumn(name, (F.col("_inside") + F.col("_before")).cast("bigint"))
        .drop("_inside", "_before")
    )


def shard_documents(docs: DataFrame, tree: Node | None = None, grown: Node | None = None) -> DataFrame:
    """Shard and slot of every row of ``docs`` by its doc_id.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``: ``size``
    is the text's UTF-8 bytes plus 1, ``law`` is always ``key``, ``slot`` counts
    from 0 without gaps in each shard, ``grown_shard`` is the place in ``grown``
    (by default the tree with one more shard). A null text has size 1 and
    checksum 0. Rows with equal doc_ids, and all rows with a null one, share a
    shard and take a slot each. An empty table gives no rows; other columns are
    ignored. Only texts are read and only numbers are shuffled.
    """
    tree = tree or even_tree()
    grown = grown or with_region(tree, 1 + max(_shards(tree)))
    key = quoted("doc_id").cast("long")
    text = F.coalesce(quoted("text").cast("string"), F.lit(""))
    rows = stored(
        docs.select(
            key.alias("doc_id"),
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            place(key, tree).alias("shard"),
            place(key, grown).alias("grown_shard"),
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "placed",
    )
    return numbered(rows, ["shard"], "part", "row", "slot").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def _shards(node: Node) -> list[int]:
    return [node.shard] if node.shard is not None else [s for c in node.children for s in _shards(c)]
