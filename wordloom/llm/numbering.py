"""Consecutive numbers and running sums inside groups of any size.

A group is cut into pieces by the leading digits of a hashed order; pieces are summed first, then each piece is
numbered on its own from the sum of the pieces before it. The number of pieces follows the number of rows, so no
task orders more than a few pieces, however many rows a group has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE_ROWS = 4096
#: Rows of a file that ``by_place`` numbers together.
BLOCK_ROWS = 1 << 16
#: A group has this many pieces at least, so that a group of a third of all rows is spread in small tables too.
LEAST_PIECES = 128
MOST_PIECES = 1 << 24
ORDER_DIGITS = 13


def hashed_order(*parts: Column) -> Column:
    """A number below 2^52 that orders rows at random but the same way in each run."""
    joined = F.concat_ws(":", *[F.coalesce(part.cast("string"), F.lit("-")) for part in parts])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, ORDER_DIGITS), 16, 10).cast("bigint")


def pieces_for(rows: int) -> int:
    """A power of two, so that a larger number of pieces only cuts pieces further."""
    pieces = LEAST_PIECES
    while pieces * PIECE_ROWS < rows and pieces < MOST_PIECES:
        pieces *= 2
    return pieces


def running(
    frame: DataFrame, group: Sequence[str], order: str, ties: Sequence[str], amounts: dict[str, Column], rows: int
) -> DataFrame:
    """Adds, for each entry of ``amounts``, the sum of that amount over the rows before in the row's group.

    ``order`` is a column from ``hashed_order``; rows that are equal in ``ties`` too must be equal in their amounts.
    """
    span = (1 << (4 * ORDER_DIGITS)) // pieces_for(rows)
    cut = frame.withColumn("_piece", F.floor(F.col(order) / F.lit(span)).cast("bigint"))
    sums = cut.groupBy(*group, "_piece").agg(*[F.sum(value).alias(f"_sum_{name}") for name, value in amounts.items()])
    before = Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *[F.col(g).alias(f"_of_{g}") for g in group],
        F.col("_piece").alias("_of_piece"),
        *[F.coalesce(F.sum(f"_sum_{name}").over(before), F.lit(0)).alias(f"_start_{name}") for name in amounts],
    )
    match = F.col("_piece") == F.col("_of_piece")
    for g in group:
        match = match & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    inside = Window.partitionBy(*group, "_piece").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    numbered = cut.select("*", *[F.coalesce(F.sum(value).over(inside), F.lit(0)).alias(f"_own_{name}") for name, value in amounts.items()])
    return numbered.join(starts, match).select(
        *frame.columns, *[(F.col(f"_start_{name}") + F.col(f"_own_{name}")).alias(name) for name in amounts]
    )


def place_of(stored: DataFrame) -> tuple[Column, Column]:
    """(file, line) of the rows of a table that Spark has written: the number of the part, and the place in it."""
    place = stored.metadataColumn("_metadata")
    return F.regexp_extract(place["file_name"], r"^part-(\d+)", 1).cast("int"), place["row_index"]


def by_place(frame: DataFrame, group: str, file: str, line: str, name: str) -> DataFrame:
    """Consecutive numbers from 0 in each group, in the order of ``file`` and ``line`` from ``place_of``.

    Rows are counted in blocks of a file first, so a group of any size is numbered by many tasks.
    """
    cut = frame.withColumn("_block", F.floor(F.col(line) / F.lit(BLOCK_ROWS)))
    before = Window.partitionBy(group).orderBy(file, "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut.groupBy(group, file, "_block").agg(F.count(F.lit(1)).alias("_rows"))
    blocks = blocks.select(group, file, "_block", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(group, file, "_block").orderBy(line)) - 1
    numbered = cut.withColumn("_inside", inside).join(blocks, [group, file, "_block"])
    return numbered.select(*frame.columns, (F.col("_before") + F.col("_inside")).cast("bigint").alias(name))
