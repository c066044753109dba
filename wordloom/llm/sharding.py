"""Sharding by a hierarchical weighted hash tree.

Regions hold racks and racks hold shards; a node weighs what its shards weigh. On each level every child draws a
number from the hash of the key and its own name, scaled by its weight, and the best draw wins (weighted rendezvous).
The draw of a child does not depend on its siblings, so a changed weight only moves keys between the subtrees whose
weights changed and the others. A new shard opens where the tree ends: with full regions it is a region of its own,
and takes rows only into itself.

Defined results: a null or empty text has size 16, a null text no checksum; a null id is a key like any other; rows
with equal ids share a shard; equal rows have slots next to each other; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.expressions import column, let, text_key
from wordloom.llm.numbering import by_place, hashed_order, place_of, running

SHARDS = 40
SHARDS_PER_RACK = 5
RACKS_PER_REGION = 4
EXTRA_BYTES = 16
DRAW_DIGITS = 13


def tree(weights: Sequence[float], shards_per_rack: int = SHARDS_PER_RACK, racks_per_region: int = RACKS_PER_REGION):
    """[(region weight, [(rack weight, [(shard, weight), ...]), ...]), ...] with shards in their order."""
    shards = list(enumerate(weights))
    racks = [shards[i : i + shards_per_rack] for i in range(0, len(shards), shards_per_rack)]
    weighed = [(sum(weight for _, weight in rack), rack) for rack in racks]
    regions = [weighed[i : i + racks_per_region] for i in range(0, len(weighed), racks_per_region)]
    return [(sum(weight for weight, _ in region), region) for region in regions]


def draw(key: Column, name: Column, weight: Column) -> Column:
    """An exponential draw of a child, smaller for heavier ones; the smallest of all children wins."""
    digest = F.md5(F.concat(key, F.lit("/"), name).cast("binary"))
    number = F.conv(F.substring(digest, 1, DRAW_DIGITS), 16, 10).cast("bigint")
    uniform = (number + F.lit(0.5)) / F.lit(float(1 << (4 * DRAW_DIGITS)))
    return -F.ln(uniform) / weight


def winner(key: Column, children: Column) -> Column:
    """The number of the child with the smallest draw; ``children`` are (name, weight, number)."""
    drawn = F.transform(
        children, lambda child: F.struct(draw(key, child["name"], child["weight"]).alias("draw"), child["number"].alias("number"))
    )
    return F.array_min(drawn)["number"]


def _children(named: Sequence[tuple[str, float, int]]) -> Column:
    """Children with some weight; there may be none, then no draw leads here."""
    listed = [
        F.struct(F.lit(name).alias("name"), F.lit(float(weight)).alias("weight"), F.lit(number).alias("number"))
        for name, weight, number in named
        if weight > 0
    ]
    return F.array(*listed) if listed else F.array().cast("array<struct<name:string,weight:double,number:int>>")


def shard_of(key: Column, weights: Sequence[float], shards_per_rack: int = SHARDS_PER_RACK, racks_per_region: int = RACKS_PER_REGION) -> Column:
    """The shard that a key, a string, descends to."""
    if not any(weight > 0 for weight in weights):
        raise ValueError("some shard needs a weight above 0")
    regions = tree(weights, shards_per_rack, racks_per_region)
    top = _children([(f"{r}", weight, r) for r, (weight, _) in enumerate(regions)])
    racks = F.array(*[_children([(f"{r}/{k}", weight, k) for k, (weight, _) in enumerate(inside)]) for r, (_, inside) in enumerate(regions)])
    shards = F.array(
        *[
            F.array(*[_children([(f"{r}/{k}/{number}", weight, number) for number, weight in leaves]) for k, (_, leaves) in enumerate(inside)])
            for r, (_, inside) in enumerate(regions)
        ]
    )

    def in_region(r: Column) -> Column:
        return let(winner(key, F.get(racks, r)), lambda k: winner(key, F.get(F.get(shards, r), k)))

    return let(winner(key, top), in_region)


def shard(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    weights: Sequence[float] = (1.0,) * SHARDS,
    grown: Sequence[float] | None = None,
    keep: Sequence[str] | None = None,
    shards_per_rack: int = SHARDS_PER_RACK,
    racks_per_region: int = RACKS_PER_REGION,
    in_order: bool = False,
) -> DataFrame:
    """(row, size, text_crc32, shard, slot, grown_shard), one row per document.

    ``row`` holds the columns to keep, all unless ``keep`` names some. ``slot`` counts from 0 in each shard without
    gaps, in hashed order, or with ``in_order`` in the order of the rows in their files; ``documents`` are then a table
    that Spark has written. ``grown`` are the weights of a changed tree, by default with one more shard of weight 1.
    A shard added to full regions, like the 41st to forty, takes rows only into itself; one added to a region that is
    not full changes the weight of that region and rack, and rows move inside it and into it.
    """
    kept = list(documents.columns if keep is None else keep)
    key = F.coalesce(F.col("id").cast("string"), F.lit("-"))
    grown = [*weights, 1.0] if grown is None else grown
    shape = (shards_per_rack, racks_per_region)
    rows = documents.select(
        F.struct(*[column(name) for name in kept]).alias("row"),
        F.col(doc_id).alias("id"),
        text_key(F.col(text)).alias("key"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + EXTRA_BYTES).cast("bigint").alias("size"),
        F.crc32(F.col(text).cast("binary")).alias("text_crc32"),
        *([part.alias(name) for part, name in zip(place_of(documents), ("file", "line"))] if in_order else []),
    )
    placed = rows.withColumns({"shard": shard_of(key, weights, *shape), "grown_shard": shard_of(key, grown, *shape)})
    if in_order:
        numbered = by_place(placed, "shard", "file", "line", "slot")
        return numbered.select("row", "size", "text_crc32", "shard", "slot", "grown_shard")
    placed = placed.withColumn("order", hashed_order(F.col("id"), F.col("text_crc32")))
    numbered = running(placed, ["shard"], "order", ["id", "size", "key"], {"slot": F.lit(1)}, documents.count())
    return numbered.select("row", "size", "text_crc32", "shard", F.col("slot").cast("bigint").alias("slot"), "grown_shard")
