"""Connected components of links between numbered things, as distributed union-find.

Each task joins the links it holds into a forest of its own; the parents a node got in different tasks meet by
node, the smallest stays and the others become new links. Every round is a table in the shared folder. No task
sees more than its share of links, and of a node with very many links each task sends one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.expressions import written

#: Links a task holds at a time; then its forest is sent on and it begins another.
FOREST_LINKS = 500_000


def forest(links: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, root) of each node that is not its own root; the root is the smallest node reachable."""
    parent: dict[int, int] = {}

    def root(node: int) -> int:
        path = []
        while (above := parent.get(node, node)) != node:
            path.append(node)
            node = above
        for below in path:
            parent[below] = node
        return node

    for left, right in links:
        left, right = root(left), root(right)
        if left != right:
            low, high = (left, right) if left < right else (right, left)
            parent[high] = low
    return [(node, root(node)) for node in list(parent)]


def _forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    rows = 0

    def settle() -> pd.DataFrame:
        links = pd.concat(held)
        return pd.DataFrame(forest(zip(links.high.tolist(), links.low.tolist())), columns=["high", "low"], dtype="int64")

    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= FOREST_LINKS:
            yield settle()
            held, rows = [], 0
    if rows:
        yield settle()


def components(links: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """(node, root): for each node with a link to another, the smallest node it is connected with.

    Links are pairs of bigints. Roots have no row of their own; loops and nulls are ignored.
    """
    links = links.select(F.greatest(left, right).alias("high"), F.least(left, right).alias("low")).where("high > low")
    while True:
        grown = links.mapInPandas(_forests, "high bigint, low bigint").groupBy("high").agg(F.collect_set("low").alias("lows"))
        lowest = F.array_min("lows")
        others = F.transform(
            F.array_remove("lows", lowest),
            lambda other: F.struct(other.alias("high"), lowest.alias("low"), F.lit(True).alias("new")),
        )
        own = F.struct("high", lowest.alias("low"), F.lit(False).alias("new"))
        links = written(grown.select(F.explode(F.concat(F.array(own), others)).alias("link")).select("link.*"))
        if not links.where("new").head(1):
            break
    parents = links.select(F.col("high").alias("node"), F.col("low").alias("root"))
    while True:  # each round doubles the length of the paths that are settled
        above = parents.select("root").distinct().join(parents.select(F.col("node").alias("root"), F.col("root").alias("higher")), "root")
        above = written(above)
        if not above.head(1):
            return parents
        parents = written(
            parents.join(above, "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
        )
