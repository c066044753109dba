"""Indexing from a stream of texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from wordloom.operators.postings import Stopwords
from wordloom.plans.indexing import append_batch, format_index, now, stored_count
from wordloom.plans.layout import Layout
from wordloom.sources.state import BEGINNING, read_state, write_state


def read_text_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def index_stream(
    stream: DataFrame,
    layout: Layout,
    checkpoint: str,
    stopwords: Stopwords = None,
    prepare: Callable[[DataFrame, str], DataFrame] | None = None,
    name: str = "stream",
    normalize_stopwords: bool = False,
    digest: str = "sha256",
) -> int:
    """Index all that the stream holds now; returns the number of micro-batches of this run.

    Every micro-batch is written under its own id, and a repeated one replaces itself, so a restart
    adds nothing twice. ``prepare`` turns a micro-batch into (text_id, metadata, text); it gets the
    batch id, from which ids can be derived with ``stored_texts``.
    """
    spark = stream.sparkSession
    _, since = read_state(spark, layout.state, BEGINNING)
    done: list[int] = []

    def append(batch: DataFrame, number: int) -> None:
        batch_id = f"{name}-{number}"
        texts = batch if prepare is None else prepare(batch, batch_id)
        append_batch(layout, texts, batch_id, stopwords, normalize_stopwords, digest)
        done.append(number)

    query = (
        stream.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    # Also after a run that was interrupted between its last batch and this point. The stamp is older than the log
    # that is read, so that nothing logged meanwhile is passed over.
    stamp = now()
    if format_index(spark, layout, since):
        write_state(spark, layout.state, stored_count(spark, layout), stamp)
    return len(done)
