"""Run state: one row per run, the latest counts."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.schemas import STATE

# A run that finds no state takes everything staged as new, also what an interrupted first run left.
BEGINNING = datetime(1970, 1, 1, tzinfo=timezone.utc)


def latest_state(states: DataFrame) -> DataFrame:
    """The row with the latest time stamp; no row gives nulls."""
    newest = F.max_by(F.struct("texts_total", "generation_timestamp"), "generation_timestamp")
    return states.agg(newest.alias("_state")).select("_state.*")


def read_state(spark: SparkSession, path: str, missing: datetime | None = None) -> tuple[int, datetime]:
    """(texts_total, generation_timestamp); without a state 0 and ``missing``, by default the present time."""
    now = missing or datetime.now(timezone.utc)
    try:
        row = latest_state(spark.read.schema(STATE).parquet(path)).select(
            "texts_total", F.unix_micros("generation_timestamp").alias("micros")
        ).first()
    except AnalysisException:
        return 0, now
    total = row.texts_total if row.texts_total is not None else 0
    # Whole microseconds, so that the time stamp read equals the one written.
    stamp = now if row.micros is None else datetime.fromtimestamp(row.micros // 10**6, timezone.utc).replace(
        microsecond=row.micros % 10**6
    )
    return total, stamp


def write_state(spark: SparkSession, path: str, texts_total: int, generation_timestamp: datetime) -> None:
    """Append the state of a finished run."""
    row = spark.createDataFrame([(texts_total, generation_timestamp)], STATE)
    row.coalesce(1).write.mode("append").parquet(path)
