"""The text table, stored apart from the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW_GROUP_BYTES = 8 << 20
#: Of all tables of a library: two thirds of the room that the default takes, in the same time.
CODEC = "zstd"


def text_rows(texts: DataFrame, buckets: int) -> DataFrame:
    """text_id, metadata, text, text_bucket: the order in which texts are stored."""
    metadata = [name for name in texts.columns if name not in ("text_id", "text", "text_bucket", "batch_id")]
    bucket = F.pmod("text_id", F.lit(buckets)).cast("int")
    return texts.select("text_id", *metadata, "text", bucket.alias("text_bucket"))


def write_arrived(texts: DataFrame, path: str) -> None:
    """Store texts as they come: no shuffle, no buckets, few files."""
    texts.write.mode("overwrite").option("compression", CODEC).option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)


def write_texts(texts: DataFrame, path: str) -> None:
    """Deal texts into their buckets.

    The rebalance hint lets the planner split large buckets and join small ones. Row groups are small and sorted by
    id, so that a lookup of few ids reads little.
    """
    (
        texts.hint("rebalance", "text_bucket")
        .sortWithinPartitions("text_bucket", "text_id")
        .write.mode("overwrite")
        .option("compression", CODEC)
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .partitionBy("text_bucket")
        .parquet(path)
    )
