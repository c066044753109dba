"""Reading a corpus and giving its texts consecutive ids."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.session import shared_folder

# Rows of a file that are numbered together, and sorted keys in a file.
PIECE_ROWS = 1 << 17
KEYS_PER_RANGE = 1_000_000


def read_corpus(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """A Parquet corpus. A few unsplittable files are spread over the cores by ``key``.

    A corpus that already arrives in enough pieces is not shuffled; the rows are the same either way.
    """
    corpus = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if key is None or corpus.rdd.getNumPartitions() >= cores:
        return corpus
    return corpus.repartition(cores, key)


def _by_place(rows: DataFrame, name: str, start: int, first: int | None, last: int | None, piece_rows: int) -> DataFrame:
    """Consecutive numbers in the order of ``_file`` and ``_row``, the place of each row in its file.

    Rows are counted in pieces of files, and each piece is numbered on its own from the count of the pieces before it.
    Pieces without a number from ``first`` to ``last`` are left out before that.
    """
    cut = rows.withColumn("_piece", F.floor(F.col("_row") / F.lit(piece_rows)))
    before = Window.orderBy("_file", "_piece").rowsBetween(Window.unboundedPreceding, -1)
    # One row per piece meets in one task.
    pieces = cut.groupBy("_file", "_piece").agg(F.count(F.lit(1)).alias("_rows")).select(
        "_file", "_piece", "_rows", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) + F.lit(start - 1)).alias("_before")
    )
    if last is not None:
        pieces = pieces.where(F.col("_before") < last)
    if first is not None:
        pieces = pieces.where(F.col("_before") + F.col("_rows") >= first)
    inside = F.row_number().over(Window.partitionBy("_file", "_piece").orderBy("_row"))
    numbered = cut.join(pieces, ["_file", "_piece"]).withColumn(name, (F.col("_before") + inside).cast("bigint"))
    if first is not None:
        numbered = numbered.where(F.col(name) >= first)
    if last is not None:
        numbered = numbered.where(F.col(name) <= last)
    return numbered


def _numbered_keys(corpus: DataFrame, key: str, ranges: int | None) -> DataFrame:
    """The keys of a corpus, sorted in ranges, as a stored table with the place of each key."""
    spark = corpus.sparkSession
    ranges = ranges or max(1, math.ceil(corpus.count() / KEYS_PER_RANGE))
    path = shared_folder(spark)
    keys = corpus.select(key)
    keys.repartitionByRange(ranges, key).sortWithinPartitions(key).write.parquet(path)
    stored = spark.read.schema(keys.schema).parquet(path)
    if stored.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull()).head(1):
        raise ValueError(f"{key} is null or the same in several rows; leave the key out to number rows by their place")
    # The parts of a written table are numbered in the order of the ranges.
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")
    return stored.select(key, part.alias("_file"), F.col("_metadata.row_index").alias("_row"))


def number_rows(
    corpus: DataFrame,
    key: str | None = None,
    name: str = "row_no",
    start: int = 1,
    first: int | None = None,
    last: int | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Consecutive numbers for the rows of a corpus; only ``first``..``last`` are kept if given.

    Without a key numbers follow the files and the places of rows in them; the corpus must come from files, but may
    be filtered. With a key of any type that has an order, unique and not null, they follow the key: the keys alone
    are sorted and numbered, compared as what they are, and joined with the corpus. A slice reads only its keys.
    """
    if key is None:
        try:
            placed = corpus.select(
                "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")
            )
        except AnalysisException as error:
            raise ValueError("a corpus without a key must be read from files") from error
        numbered = _by_place(placed, name, start, first, last, PIECE_ROWS)
        return numbered.select(*[c for c in corpus.columns if c != name], name)
    keys = _by_place(_numbered_keys(corpus, key, ranges), name, start, first, last, PIECE_ROWS).select(key, name)
    if first is not None or last is not None:
        low, high = keys.agg(F.min(key), F.max(key)).first()
        if low is None:
            return corpus.where(F.lit(False)).withColumn(name, F.lit(0).cast("bigint"))
        corpus = corpus.where(F.col(key).between(F.lit(low), F.lit(high)))
    return corpus.drop(name).join(keys, key).select(*[c for c in corpus.columns if c != name], name)


def batch_slice(corpus: DataFrame, key: str | None, batch_rows: int, first: int, last: int) -> DataFrame:
    """The rows of batches ``first``..``last`` (from 1, inclusive) with their ``batch_no``.

    Batches count all rows, before any filter.
    """
    rows = number_rows(corpus, key, first=(first - 1) * batch_rows + 1, last=last * batch_rows)
    batch = F.floor((F.col("row_no") - 1) / F.lit(batch_rows)) + 1
    return rows.withColumn("batch_no", batch.cast("bigint")).drop("row_no")


def prepare(
    corpus: DataFrame,
    key: str | None,
    languages: Sequence[str],
    columns: dict[str, str],
    language: str = "lang",
    start: int = 1,
    keep_ids: bool = False,
) -> DataFrame:
    """Rows of the chosen languages as (text_id, metadata, text).

    ``columns`` maps column names of the corpus to new names and must yield ``text``. Ids follow
    ``key``, or without one the places of rows in their files, from ``start`` on and are given to kept rows only;
    ``keep_ids`` uses ``key`` itself.
    """
    kept = corpus.where(F.col(language).isin(list(languages)))
    if keep_ids:
        numbered = kept.withColumn("text_id", F.col(key).cast("bigint"))
    else:
        numbered = number_rows(kept, key, "text_id", start)
    metadata = [F.col(old).alias(new) for old, new in columns.items() if new != "text"]
    text = [F.col(old).alias(new) for old, new in columns.items() if new == "text"]
    return numbered.select("text_id", *metadata, *text)


def batch_counts(
    batches: DataFrame,
    languages: Sequence[str],
    language: str = "lang",
    previous: int = 0,
    block: int = 1000,
) -> DataFrame:
    """(batch_no, texts, run_total, combined_total) of a batched corpus.

    Totals run over blocks of batches first and then inside each block, so only one row per block meets
    in a single task.
    """
    kept = F.count_if(F.col(language).isin(list(languages)))
    per_batch = batches.groupBy("batch_no").agg(kept.alias("texts"))
    blocked = per_batch.withColumn("_block", F.floor(F.col("batch_no") / F.lit(block)))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        blocked.groupBy("_block")
        .agg(F.sum("texts").alias("_texts"))
        .select("_block", F.coalesce(F.sum("_texts").over(before), F.lit(0)).alias("_before"))
    )
    inside = F.sum("texts").over(Window.partitionBy("_block").orderBy("batch_no"))
    return blocked.join(blocks, "_block").select(
        "batch_no",
        "texts",
        (F.col("_before") + inside).alias("run_total"),
        (F.col("_before") + inside + F.lit(previous)).alias("combined_total"),
    )
