"""Index maintenance: append batches, then format what was appended into generations of the index and the text store.

An append writes texts and postings as they come, without a shuffle, and registers itself. A format turns what was
appended since the last one into a new generation: a folder sorted by bin, hash and text id that is never changed. While
a generation is not much larger than the new one it is merged into it, so a batch costs in proportion to its own size,
a library of n batches has some log(n) generations, and each posting is rewritten some log(n) times. A batch that was
appended again takes its old rows out of the generations that hold them, which are rewritten. The manifest then names
the new generations of index, vocabulary and texts all at once.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from wordloom.operators.blocks import pack, unpack
from wordloom.operators.postings import Stopwords, posting_blocks, touched_hashes, vocabulary
from wordloom.plans import manifest
from wordloom.plans.layout import Layout
from wordloom.plans.manifest import Batch, Version
from wordloom.schemas import APPENDED_BLOCK, POSTING, STAGED_POSTING, TOUCHED_HASH, VOCABULARY
from wordloom.sources.state import BEGINNING, read_state, write_state
from wordloom.sources.texts import CODEC, text_rows, write_arrived, write_texts

#: A generation is merged with others once there are this many of its size, counted in powers of the same number.
FAN_IN = 4
#: Text generations with this many texts a bucket have files of full size and are left alone.
FULL_BUCKET_TEXTS = 200_000

#: Words that the bloom filter of a row group is made for at most.
MAX_BLOOM_WORDS = 200_000
#: Folders of a generation that a task keeps open; a task with more of them sorts the rest by folder.
OPEN_FOLDERS = 64
_TEXT_BUCKET = StructField("text_bucket", IntegerType())
_BATCH_ID = StructField("batch_id", StringType())


def now() -> datetime:
    return datetime.now(timezone.utc)


# --- appending --------------------------------------------------------------------------------


def write_postings(postings: DataFrame, path: str) -> None:
    """Add postings to a folder as they come, sorted inside each task."""
    postings.sortWithinPartitions("bin", "hash", "text_id").write.mode("append").option("compression", CODEC).parquet(path)


def _stage(layout: Layout, new_postings: DataFrame, batch: Batch) -> None:
    """Add the postings of a batch to its epoch."""
    _stage_blocks(layout, pack(_as_bytes(new_postings.withColumn("batch_id", F.lit(batch.batch_id)))), batch)


def _stage_blocks(layout: Layout, blocks: DataFrame, batch: Batch) -> None:
    """Add blocks of postings to the epoch of a batch: one folder for all batches, as they come, neither shuffled nor sorted."""
    stamp = F.timestamp_micros(F.lit(batch.stamp))
    marked = blocks.withColumns({"batch_id": F.lit(batch.batch_id), "write": F.lit(batch.write), "generation_timestamp": stamp})
    path = f"{layout.staging}/_epoch={batch.epoch}"
    marked.select(APPENDED_BLOCK.fieldNames()).write.mode("append").option("compression", CODEC).parquet(path)


def append_postings(layout: Layout, new_postings: DataFrame, batch_id: str, generation_timestamp: datetime | None = None) -> None:
    """Stage the postings of a batch. Appending a batch again replaces it.

    What was staged is the log of touched words too, until the state of a run has passed it.
    """
    spark = new_postings.sparkSession
    stamp = manifest.micros(generation_timestamp or now())
    batch = Batch(batch_id, manifest.new_write(), manifest.current(spark, layout).number, stamp)
    _stage(layout, new_postings, batch)
    manifest.register(spark, layout, batch)


def append_batch(
    layout: Layout,
    texts: DataFrame,
    batch_id: str,
    stopwords: Stopwords = None,
    normalize_stopwords: bool = False,
    digest: str = "sha256",
    generation_timestamp: datetime | None = None,
) -> None:
    """Store a batch of texts and stage its postings.

    Words are taken from the stored texts: what the batch needed to be prepared (numbering, filters) runs
    once, and both tables rest on the same ids whatever happens to the tasks. The batch counts once both are complete.
    """
    spark = texts.sparkSession
    version = manifest.current(spark, layout)
    stamp = manifest.micros(generation_timestamp or now())
    stored = text_rows(texts, layout.text_buckets).drop("text_bucket")
    _merged_fields([version.fields, stored.schema.json()])
    batch = Batch(batch_id, manifest.new_write(), version.number, stamp, stored.schema.json())
    write_arrived(stored, _arrival(layout, batch))
    written = spark.read.schema(stored.schema).parquet(_arrival(layout, batch))
    _stage_blocks(layout, posting_blocks(written, layout.bins, stopwords, normalize_stopwords, digest), batch)
    manifest.register(spark, layout, batch)


def _arrival(layout: Layout, batch: Batch) -> str:
    return f"{layout.arrived}/_epoch={batch.epoch}/_write={batch.write}"


def _merged_fields(schemas: Iterable[str | None]) -> StructType:
    """The columns of all batches, in order of their first appearance, the text last."""
    fields: dict[str, StructField] = {}
    for schema in schemas:
        for f in StructType.fromJson(json.loads(schema)) if schema else ():
            known = fields.setdefault(f.name, StructField(f.name, f.dataType))
            if known.dataType != f.dataType:
                raise ValueError(f"column {f.name} is {known.dataType.simpleString()} in the store, not {f.dataType.simpleString()}")
    return StructType([f for name, f in fields.items() if name != "text"] + [f for name, f in fields.items() if name == "text"])


# --- opening ----------------------------------------------------------------------------------


def _generations(spark: SparkSession, path: str, generations: Iterable[int], schema: StructType) -> DataFrame:
    """Some generations of a table as one scan; others are not even listed."""
    paths = [f"{path}/_generation={generation}" for generation in sorted(generations)]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*paths).select(schema.fieldNames())


def _epochs(spark: SparkSession, layout: Layout, appends: Iterable[Batch]) -> DataFrame:
    """The staged postings of some appends, in blocks."""
    writes: dict[int, list[int]] = {}
    for batch in appends:
        writes.setdefault(batch.epoch, []).append(batch.write)
    staged = spark.createDataFrame([], APPENDED_BLOCK)
    if writes:
        paths = [f"{layout.staging}/_epoch={epoch}" for epoch in sorted(writes)]
        staged = spark.read.schema(APPENDED_BLOCK).parquet(*paths)
    return staged.where(F.col("write").isin(sorted(write for held in writes.values() for write in held)))


def _latest(spark: SparkSession, layout: Layout) -> tuple[Version, dict[str, Batch]]:
    """The latest version and, for each batch, the append that waits for a format."""
    version = manifest.with_batches(spark, layout, manifest.current(spark, layout))
    waiting = manifest.latest_of(manifest.pending(spark, layout, version))
    return version, {name: batch for name, batch in waiting.items() if batch.write > version.batches.get(name, (0,))[0]}


def open_index(spark: SparkSession, layout: Layout) -> DataFrame:
    """The final postings, partitioned by bin and sorted by hash: one row per word and text, of the latest format."""
    return _generations(spark, layout.index, manifest.current(spark, layout).index, POSTING)


def open_vocabulary(spark: SparkSession, layout: Layout) -> DataFrame:
    """Counts per word of the latest format; filters on bin and hash reach the files."""
    generations = manifest.current(spark, layout).index
    counted = _generations(spark, layout.vocabulary, generations, VOCABULARY)
    if len(generations) < 2:
        return counted
    sums = counted.groupBy("bin", "hash").agg(F.sum("texts").alias("texts"), F.sum("occurrences").alias("occurrences"))
    return sums.select(VOCABULARY.fieldNames())


def open_staging(spark: SparkSession, layout: Layout) -> DataFrame:
    """Every posting with its batch, formatted or not; of a batch that was appended again the new ones."""
    version, waiting = _latest(spark, layout)
    names = STAGED_POSTING.fieldNames()
    formatted = _generations(spark, layout.index, version.index, STAGED_POSTING)
    if not waiting:
        return formatted
    staged = _as_digits(unpack(_epochs(spark, layout, waiting.values()))).select(names)
    return formatted.where(~F.col("batch_id").isin(sorted(waiting))).unionByName(staged) if version.index else staged


def open_touched(spark: SparkSession, layout: Layout) -> DataFrame:
    """The words that batches have touched since the state that the last format knew: one row per batch and word."""
    version = manifest.current(spark, layout)
    epochs = [epoch for epoch, stamp in version.epochs.items() if stamp > version.log_since]
    recent = [epoch for epoch in (version.number - 1, version.number) if epoch >= 0]
    logged = manifest.registered(spark, layout, sorted({*epochs, *recent}))
    staged = _epochs(spark, layout, [batch for batch in logged if batch.stamp > version.log_since])
    return touched_hashes(_as_digits(staged), "batch_id", "generation_timestamp").select(TOUCHED_HASH.fieldNames())


def open_texts(spark: SparkSession, layout: Layout) -> DataFrame:
    """The stored texts with ``batch_id`` and ``text_bucket``, also those that wait for a format."""
    version, waiting = _latest(spark, layout)
    arrived = [batch for batch in waiting.values() if batch.fields]
    fields = _merged_fields([version.fields, *(batch.fields for batch in arrived)])
    stored = _generations(spark, layout.texts, version.texts, StructType([*fields, _BATCH_ID, _TEXT_BUCKET]))
    if waiting:
        stored = stored.where(~F.col("batch_id").isin(sorted(waiting)))
    if not arrived:
        return stored
    new = _arrived(spark, layout, arrived, fields)
    return stored.unionByName(new) if version.texts else new


def _arrived(spark: SparkSession, layout: Layout, appends: list[Batch], fields: StructType) -> DataFrame:
    """Texts as they were appended; one scan for all batches, told apart by their folder."""
    paths = [_arrival(layout, batch) for batch in appends]
    epochs = spark.read.schema(StructType([*fields, StructField("_write", StringType())])).option("basePath", layout.arrived).parquet(*paths)
    names = spark.createDataFrame([(str(batch.write), batch.batch_id) for batch in appends], "_write string, batch_id string")
    texts = epochs.join(F.broadcast(names), "_write").select(*fields.fieldNames(), "batch_id")
    return texts.withColumn("text_bucket", F.pmod("text_id", F.lit(layout.text_buckets)).cast("int"))


def touched_since(touched: DataFrame, since: datetime) -> DataFrame:
    """(bin, hash) logged after a time."""
    return touched.where(F.col("generation_timestamp") > F.lit(since).cast("timestamp")).select("bin", "hash").distinct()


# --- formatting -------------------------------------------------------------------------------


def _stretches(spark: SparkSession, rows: int, rows_per_file: int) -> int:
    """How many tasks to cut rows into: full files for much data, all cores for little."""
    for_cores = min(spark.sparkContext.defaultParallelism, math.ceil(rows / 50_000))
    return max(math.ceil(rows / rows_per_file), for_cores, 1)


def to_merge(sizes: dict[int, int], new: int, forced: Iterable[int] = (), full: int | None = None) -> set[int]:
    """The generations to merge into a new one of ``new`` rows.

    Sizes fall into tiers, powers of ``FAN_IN``. As long as the merged one finds ``FAN_IN`` - 1 others of its tier or
    below, it takes them in. Generations of ``full`` rows are left alone; those in ``forced`` are always taken.
    """

    def tier(rows: int) -> int:
        return int(math.log(max(rows, 1), FAN_IN) + 1e-9)

    merged = set(forced)
    total = new + sum(sizes[generation] for generation in merged)
    while True:
        peers = {
            generation
            for generation, rows in sizes.items()
            if generation not in merged and tier(rows) <= tier(total) and (full is None or rows < full)
        }
        if len(peers) < FAN_IN - 1:
            return merged
        merged |= peers
        total += sum(sizes[generation] for generation in peers)


def format_index(spark: SparkSession, layout: Layout, since: datetime, rows_per_file: int = 5_000_000) -> list[int]:
    """Bring all that was appended into the index, its vocabulary and the text store; returns the bins it touched.

    ``since`` is the time stamp of the last run's state: the log of touched words behind it is given up.

    Rows are cut by (bin, hash, text_id): a frequent word is spread over many files, a file holds one stretch of
    hashes, and row groups outside a request are skipped by their bounds and bloom filters. The number of stretches
    follows the number of rows.
    """
    old = manifest.with_batches(spark, layout, manifest.current(spark, layout))
    appends = manifest.pending(spark, layout, old)
    if not appends:
        return []
    waiting = {name: batch for name, batch in manifest.latest_of(appends).items() if batch.write > old.batches.get(name, (0,))[0]}
    replaced = {name: old.batches[name] for name in waiting if name in old.batches}
    generation = old.number + 1
    new = Version(
        number=generation,
        log_since=manifest.micros(since),
        fields=_merged_fields([old.fields, *(batch.fields for batch in waiting.values())]).json(),
        index=dict(old.index),
        texts=dict(old.texts),
        batches=dict(old.batches),
        taken={batch.write for batch in appends},
    )
    for name, batch in waiting.items():
        new.batches[name] = (batch.write, generation, generation if batch.fields else None)

    bins, merged = _format_postings(spark, layout, new, waiting, replaced, rows_per_file)
    texts_merged = _format_texts(spark, layout, new, waiting, replaced)

    def place(held: int | None, gone: set[int], live: dict[int, int]) -> int | None:
        """Where the rows of a batch lie now; nowhere if it has none."""
        held = generation if held in gone else held
        return held if held in live else None

    for name, (write, index, texts) in new.batches.items():
        new.batches[name] = (write, place(index, merged, new.index), place(texts, texts_merged, new.texts))

    epochs = dict(old.epochs)
    for batch in appends:
        epochs[batch.epoch] = max(epochs.get(batch.epoch, 0), batch.stamp)
    kept = generation - manifest.SLOTS
    new.epochs = {epoch: stamp for epoch, stamp in epochs.items() if epoch > kept or stamp > new.log_since}
    manifest.commit(spark, layout, new)
    return bins


def _bloom(rows: int, files: int) -> dict[str, str]:
    """Writer options for a bloom filter on the hash that suits the words of a file."""
    words = min(max(rows // max(files, 1), 64), MAX_BLOOM_WORDS)
    return {"parquet.bloom.filter.enabled#hash": "true", "parquet.bloom.filter.expected.ndv#hash": str(words), "compression": CODEC}


def _as_bytes(rows: DataFrame) -> DataFrame:
    """Rows whose hash is half as long on the way: digits in order are bytes in order."""
    return rows.withColumn("hash", F.unhex("hash"))


def _as_digits(rows: DataFrame) -> DataFrame:
    return rows.withColumn("hash", F.lower(F.hex("hash")))


@contextmanager
def _files_side_by_side(spark: SparkSession) -> Iterator[None]:
    """Tasks keep the files of some folders open: rows that come in order are not sorted by folder once more."""
    setting = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(OPEN_FOLDERS))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def _write_generation(rows: DataFrame, stretches: int, bloom: dict[str, str], path: str) -> None:
    """Blocks of postings, or postings that are made into blocks, are shuffled and sorted, and opened where they are written."""
    blocks = rows if "packed" in rows.columns else pack(_as_bytes(rows))
    ranged = blocks.repartitionByRange(stretches, "bin", "hash", "text_id").sortWithinPartitions("bin", "hash", "text_id")
    opened = _as_digits(unpack(ranged, is_sorted=True)).select(STAGED_POSTING.fieldNames())
    with _files_side_by_side(rows.sparkSession):
        opened.write.mode("overwrite").options(**bloom).partitionBy("bin").parquet(path)


def _format_postings(
    spark: SparkSession, layout: Layout, new: Version, waiting: dict[str, Batch], replaced: dict, rows_per_file: int
) -> tuple[list[int], set[int]]:
    """Write the new generation of index and vocabulary; returns the bins touched and the generations merged into it."""
    names = [name for name in APPENDED_BLOCK.fieldNames() if name not in ("write", "generation_timestamp")]
    staged = _epochs(spark, layout, waiting.values()).select(names)
    per_bin = dict(staged.groupBy("bin").agg(F.sum("held")).collect())  # one number per bin
    holding = {index for _, index, _ in replaced.values() if index is not None}
    merged = to_merge(new.index, sum(per_bin.values()), holding)
    rows, bins = staged, set(per_bin)
    if merged:
        before = _generations(spark, layout.index, merged, STAGED_POSTING)
        if holding:
            gone = before.where(F.col("batch_id").isin(sorted(replaced)))
            bins |= {row.bin for row in gone.select("bin").distinct().collect()}
            before = before.where(~F.col("batch_id").isin(sorted(replaced)))
        rows = rows.unionByName(pack(_as_bytes(before)))
    total = sum(per_bin.values()) + sum(new.index[generation] for generation in merged)
    for generation in merged:
        del new.index[generation]
    if not total:
        return sorted(bins), merged
    stretches = _stretches(spark, total, rows_per_file)
    bloom = _bloom(total, max(stretches, layout.bins if merged else len(per_bin)))
    _write_generation(rows, stretches, bloom, f"{layout.index}/_generation={new.number}")
    written = _generations(spark, layout.index, [new.number], STAGED_POSTING)
    new.index[new.number] = written.count()  # from the footers
    counted = vocabulary(_as_bytes(written)).hint("rebalance", "bin").sortWithinPartitions("bin", "hash")
    (
        _as_digits(counted)
        .write.mode("overwrite")
        .options(**bloom)
        .partitionBy("bin")
        .parquet(f"{layout.vocabulary}/_generation={new.number}")
    )
    return sorted(bins), merged


def _format_texts(spark: SparkSession, layout: Layout, new: Version, waiting: dict[str, Batch], replaced: dict) -> set[int]:
    """Deal the texts that arrived into buckets, as a new generation; returns the generations merged into it."""
    arrived = [batch for batch in waiting.values() if batch.fields]
    holding = {texts for _, _, texts in replaced.values() if texts is not None}
    if not arrived and not holding:
        return set()
    fields = _merged_fields([new.fields])
    parts = [_arrived(spark, layout, arrived, fields)] if arrived else []
    count = spark.read.schema(fields).parquet(*[_arrival(layout, batch) for batch in arrived]).count() if arrived else 0
    merged = to_merge(new.texts, count, holding, FULL_BUCKET_TEXTS * layout.text_buckets)
    if merged:
        before = _generations(spark, layout.texts, merged, StructType([*fields, _BATCH_ID, _TEXT_BUCKET]))
        parts.append(before.where(~F.col("batch_id").isin(sorted(replaced))) if replaced else before)
    for generation in merged:
        del new.texts[generation]
    path = f"{layout.texts}/_generation={new.number}"
    write_texts(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), path)
    new.texts[new.number] = spark.read.schema(fields).parquet(path).count()
    return merged


# --- runs -------------------------------------------------------------------------------------


def stored_count(spark: SparkSession, layout: Layout) -> int:
    """How many texts are stored; 0 for an empty store."""
    version, waiting = _latest(spark, layout)
    if not waiting:
        return sum(version.texts.values())
    return open_texts(spark, layout).count()


def stored_texts(spark: SparkSession, layout: Layout, without_batch: str | None = None) -> int:
    """The highest stored text id, without one batch; 0 for an empty store."""
    texts = open_texts(spark, layout)
    if "text_id" not in texts.columns:
        return 0
    if without_batch is not None:
        texts = texts.where(F.col("batch_id") != without_batch)
    return texts.agg(F.coalesce(F.max("text_id"), F.lit(0))).first()[0]


def index_corpus(
    spark: SparkSession,
    layout: Layout,
    batches: dict[str, DataFrame],
    stopwords: Stopwords = None,
    normalize_stopwords: bool = False,
    digest: str = "sha256",
) -> tuple[int, datetime]:
    """One indexing run: append every batch in order, format once, then record the state.

    ``batches`` maps batch ids to prepared texts. Returns the new state.
    """
    _, since = read_state(spark, layout.state, BEGINNING)
    for batch_id, texts in batches.items():
        append_batch(layout, texts, batch_id, stopwords, normalize_stopwords, digest)
    # Taken before the log is read: what another run logs meanwhile is newer and left for the next format.
    stamp = now()
    format_index(spark, layout, since)
    total = stored_count(spark, layout)
    write_state(spark, layout.state, total, stamp)
    return total, stamp
