"""Shards by a weighted hash tree of regions, racks and shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from indicatrix.llm.common import Scratch, doc_texts

Tree = dict[str, dict[str, dict[int, float]]]


def even_tree(regions: int = 2, racks: int = 2, shards: int = 4) -> Tree:
    """Shards 0, 1, 2 ... of weight 1, filled rack by rack."""
    number = iter(range(regions * racks * shards))
    return {f"region{r}": {f"rack{r}.{k}": {next(number): 1.0 for _ in range(shards)} for k in range(racks)} for r in range(regions)}


def with_shard(tree: Tree, region: str, rack: str, shard: int, weight: float = 1.0) -> Tree:
    """The same tree with one more shard in one rack."""
    grown = {r: {k: dict(leaves) for k, leaves in by_rack.items()} for r, by_rack in tree.items()}
    grown.setdefault(region, {}).setdefault(rack, {})[shard] = weight
    return grown


def _draw(key: Column, shard: int, weight: float) -> Column:
    """An exponential variate of rate `weight`, fixed by the key and the shard's name alone."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(f"shard:{shard}")), 12)
    return -F.log((bits.cast("double") + 0.5) / F.lit(float(2**52))) / F.lit(float(weight))


def _smallest(draws: list[Column]) -> Column:
    return F.least(*draws) if len(draws) > 1 else draws[0]


def _leaves(node) -> list[int]:
    return [s for n in node.values() for s in _leaves(n)] if all(isinstance(n, dict) for n in node.values()) else list(node)


def _descend(node, draws: dict[int, Column]) -> Column:
    """The child with the smallest draw, asked again for its own child, down to a shard."""
    children = [(_smallest([draws[s] for s in (_leaves(child) if isinstance(child, dict) else [name])]), _descend(child, draws) if isinstance(child, dict) else F.lit(name))
                for name, child in node.items()]
    found = children[-1][1]
    for k in range(len(children) - 2, -1, -1):
        found = F.when(children[k][0] <= _smallest([draw for draw, _ in children[k + 1:]]), children[k][1]).otherwise(found)
    return found


def add_shard(df: DataFrame, key: str, tree: Tree, name: str) -> DataFrame:
    """Add the shard of a key: descend region, rack and shard, each time to the child with the smallest weighted hash draw.

    The draw of a shard is exponential with its weight as rate; that of a rack or region is the smallest draw below it, which is exponential
    with the weight of the subtree. So each level is chosen in proportion to weight, and a change of one shard's weight changes only the draws
    of the nodes above it: a key moves into that subtree when its weight rises, or out of it when it falls, and nowhere else.
    A null key has one draw for each shard, as any other key.
    """
    weights = {s: w for racks in tree.values() for leaves in racks.values() for s, w in leaves.items()}
    columns = {s: f"__draw_{s}" for s in weights}
    drawn = df.withColumns({columns[s]: _draw(F.col(key), s, w) for s, w in weights.items()})
    return drawn.withColumn(name, _descend(tree, {s: F.col(c) for s, c in columns.items()})).drop(*columns.values())


def shard_documents(docs: DataFrame, tree: Tree, grown: Tree) -> DataFrame:
    """Every row with its size, checksum, shard, slot in the shard and shard in the grown tree.

    Size is the UTF-8 bytes of the text (null: none) plus 1; text_crc32 the checksum of those bytes. Slots are gapless from 0 in each shard.
    Slots are counted per (shard, input partition) first and then offset, so that no task numbers a whole shard; the part of each row is written
    down before it is counted. Repeated rows get a slot each. No row, no slot. Text is read once and never shuffled.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    rows = doc_texts(docs).select("doc_id", (F.octet_length("text").cast("long") + 1).alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.spark_partition_id().alias("part"))
    rows = scratch.keep(add_shard(add_shard(rows, "doc_id", tree, "shard"), "doc_id", grown, "grown_shard"), "rows")
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = W.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32")
    return rows.join(offsets, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("first") + F.row_number().over(within) - 1).cast("long").alias("slot"), "grown_shard")
