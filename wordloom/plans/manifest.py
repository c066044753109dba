"""Which files of a library count: the manifest of live generations and the register of appended batches.

A generation is a folder that is written once and never changed. The manifest is a small table that names the live
generations of the index, its vocabulary and the text store, and the generations in which each batch lies. A format
writes new generations first and then one new version of the manifest; that file is the only switch. Readers take the
latest version, so they see all of a format or nothing, and a format that was killed leaves nothing but folders that
nobody names. Versions go round ``SLOTS`` folders: one is replaced when it is ``SLOTS`` versions old, and what only that
version named is emptied then, so readers have that many formats to finish.

An append under version v belongs to epoch v. Its postings and texts count once its row is in the register of that
epoch. A format takes the rows of its own epoch and of the one before that no format has taken, so an append may end
while a format runs; one that outlasts two formats registers again. Library writers: any number of appends, one format.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wordloom.plans.layout import Layout
from wordloom.schemas import MANIFEST, REGISTERED

SLOTS = 8
#: Kinds of manifest rows that readers need; the others are for writers.
_FOR_READERS = ("head", "index", "texts", "epoch")


@dataclass(frozen=True)
class Batch:
    """One append of a batch. ``fields`` is the schema of its texts as JSON, none if only postings were appended."""

    batch_id: str
    write: int
    epoch: int
    stamp: int
    fields: str | None = None


@dataclass
class Version:
    """One version of the manifest. Stamps are microseconds."""

    number: int = 0
    log_since: int = 0
    fields: str | None = None
    index: dict[int, int] = field(default_factory=dict)  # generation: rows
    texts: dict[int, int] = field(default_factory=dict)
    epochs: dict[int, int] = field(default_factory=dict)  # epoch whose appends are still stored: newest stamp
    batches: dict[str, tuple[int, int | None, int | None]] = field(default_factory=dict)  # write, generations
    taken: set[int] = field(default_factory=set)  # writes that the format of this version took

    def rows(self) -> list[tuple]:
        """(version, kind, batch_id, write, generation, text_generation, amount, fields)"""
        found = [(self.number, "head", None, None, None, None, self.log_since, self.fields)]
        for kind, held in (("index", self.index), ("texts", self.texts), ("epoch", self.epochs)):
            found += [(self.number, kind, None, None, key, None, amount, None) for key, amount in held.items()]
        found += [(self.number, "batch", batch_id, *places, None, None) for batch_id, places in self.batches.items()]
        return found + [(self.number, "taken", None, write, None, None, None, None) for write in self.taken]


def micros(moment: datetime) -> int:
    since = moment.astimezone(timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (since.days * 86_400 + since.seconds) * 10**6 + since.microseconds


def read_all(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """A table, or none if it was never written. Files that are replaced meanwhile are passed over."""
    try:
        return spark.read.schema(schema).option("ignoreMissingFiles", True).parquet(path)
    except AnalysisException:
        return None


def _versions(spark: SparkSession, layout: Layout, condition: str) -> dict[int, Version]:
    table = read_all(spark, layout.manifest, MANIFEST)
    found: dict[int, Version] = {}
    for row in [] if table is None else table.where(condition).collect():
        version = found.setdefault(row.version, Version(row.version))
        if row.kind == "head":
            version.log_since, version.fields = row.amount, row.fields
        elif row.kind == "batch":
            version.batches[row.batch_id] = (row.write, row.generation, row.text_generation)
        elif row.kind == "taken":
            version.taken.add(row.write)
        else:
            {"index": version.index, "texts": version.texts, "epoch": version.epochs}[row.kind][row.generation] = row.amount
    return found


def read_versions(spark: SparkSession, layout: Layout) -> dict[int, Version]:
    """The kept versions as readers need them."""
    return _versions(spark, layout, f"kind IN {_FOR_READERS}")


def current(spark: SparkSession, layout: Layout) -> Version:
    """The latest version as readers need it; version 0 of a library that was never formatted."""
    kept = read_versions(spark, layout)
    return kept[max(kept)] if kept else Version()


def with_batches(spark: SparkSession, layout: Layout, version: Version) -> Version:
    """A version with its batches: the writer's side, one row per live batch."""
    read = _versions(spark, layout, f"version = {version.number} AND kind IN ('batch', 'taken')")
    if version.number in read:
        version.batches, version.taken = read[version.number].batches, read[version.number].taken
    return version


def commit(spark: SparkSession, layout: Layout, version: Version) -> None:
    """Make a version the latest one, and empty what only the version that it replaces has named."""
    kept = read_versions(spark, layout)
    slot = f"{layout.manifest}/_slot={version.number % SLOTS}"
    spark.createDataFrame(version.rows(), MANIFEST).coalesce(1).write.mode("overwrite").parquet(slot)
    oldest = kept.pop(version.number - SLOTS, Version())
    kept[version.number] = version
    for generation in set(oldest.index).difference(*(v.index for v in kept.values())):
        for table in (layout.index, layout.vocabulary):
            _empty(spark, f"{table}/_generation={generation}")
    for generation in set(oldest.texts).difference(*(v.texts for v in kept.values())):
        _empty(spark, f"{layout.texts}/_generation={generation}")
    for epoch in set(oldest.epochs).difference(*(v.epochs for v in kept.values())):
        for table in (layout.staging, layout.arrived, layout.batches):
            _empty(spark, f"{table}/_epoch={epoch}")


def _empty(spark: SparkSession, folder: str) -> None:
    spark.createDataFrame([], "none int").coalesce(1).write.mode("overwrite").parquet(folder)


# --- appended batches -------------------------------------------------------------------------


def new_write() -> int:
    """A number for an append, larger than those before."""
    return time.time_ns()


def register(spark: SparkSession, layout: Layout, batch: Batch) -> None:
    """Let an append count: its files are complete."""
    row = (batch.batch_id, batch.write, batch.epoch, batch.stamp, batch.fields)
    epoch = batch.epoch
    while True:
        spark.createDataFrame([row], REGISTERED).coalesce(1).write.mode("append").parquet(f"{layout.batches}/_epoch={epoch}")
        latest = current(spark, layout).number
        if latest - epoch < 2:
            return  # the next format still reads this epoch
        if any(batch.write in version.taken for version in _versions(spark, layout, "kind = 'taken'").values()):
            return
        epoch = latest


def registered(spark: SparkSession, layout: Layout, epochs: list[int]) -> list[Batch]:
    """The appends that were registered in some epochs."""
    found: dict[int, Batch] = {}
    for epoch in epochs:
        table = read_all(spark, f"{layout.batches}/_epoch={epoch}", REGISTERED)
        for row in [] if table is None else table.where("write IS NOT NULL").collect():
            found[row.write] = Batch(row.batch_id, row.write, row.data_epoch, row.stamp, row.fields)
    return list(found.values())


def pending(spark: SparkSession, layout: Layout, version: Version) -> list[Batch]:
    """The appends that no format has taken, oldest first; ``version`` needs its batches."""
    rows = registered(spark, layout, [epoch for epoch in (version.number - 1, version.number) if epoch >= 0])
    return sorted((row for row in rows if row.write not in version.taken), key=lambda row: row.write)


def latest_of(appends: list[Batch]) -> dict[str, Batch]:
    """The append of each batch that counts."""
    return {row.batch_id: row for row in sorted(appends, key=lambda row: row.write)}
