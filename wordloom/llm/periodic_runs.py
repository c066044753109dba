"""Periodic runs of words: tiles per octave of periods, boundary Z-functions, and fragments stitched by document and period.

A run is a stretch of words whose smallest period is q, at least ``REPEATS`` periods and ``LEAST`` words long, that no
neighbouring word extends.

1. Words become numbers inside their document. Periods fall into octaves (1-7, 8-15, 16-31, ...). A run of period q
   holds equal grams of 16 words or of its octave's upper bound q words apart, so positions without an equal gram that
   near take part in no run. A document is cut into tiles per octave: two windows long, one window apart, so that every
   stretch of three periods lies whole in some tile. Tiles without such a position are left out, and larger octaves
   than the last with one are not looked at; no run is lost by that.
2. Tiles are dealt over all tasks and solved on their own. At boundaries one largest period apart (less than what a run
   must exceed) two Z-functions tell how far the words from the boundary on equal those q words later, and how far they
   do so backwards; together that is the fragment of a run of period q inside the tile. Fragments that have a smaller
   period are dropped.
3. Fragments are shuffled by document and period and stitched where they overlap by a period or more.
4. Documents with tiles meet their runs again; all others were done in the first step, and their texts are not shuffled.

Defined results: a null or empty text has no words and no runs; equal rows are documents of their own; the id may be
null; other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.expressions import column, written

REPEATS = 3
LEAST = 24
FIRST_GRAM = 16
#: Pairs of places that are compared at a time in a tile.
PAIRS = 1 << 14
ROWS_PER_BATCH = 256
#: Words of tiles that are solved in one go, and tiles of a task.
TOGETHER = 1 << 15
TASK_TILES = 5_000

_FACTORS = [np.uint64(0x9E3779B97F4A7C15 + 2 * 0x6A09E667F3BCC908 * (i + 1) & (1 << 64) - 1 | 1) for i in range(40)]


def octaves(words: int) -> Iterator[tuple[int, int, int, int]]:
    """(least period, largest period, gram, window) for a document of that many words."""
    low, high, gram = 1, 7, FIRST_GRAM
    while low * REPEATS <= words and words >= LEAST:
        yield low, high, gram, max(LEAST, REPEATS * high)
        low, high = high + 1, 2 * high + 1
        gram = max(FIRST_GRAM, high + 1)


def _grams(ids: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of all grams of 1, 2, 4, ... numbers; equal grams have equal hashes."""
    hashes = (ids.astype(np.uint64) + np.uint64(1)) * _FACTORS[-1]
    hashes ^= hashes >> np.uint64(29)
    size, i = 1, 0
    while True:
        yield hashes
        if len(hashes) <= size:
            return
        hashes = hashes[:-size] * _FACTORS[i] + hashes[size:]
        hashes ^= hashes >> np.uint64(31)
        size, i = 2 * size, i + 1


def tiles(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(least period, first word, words) of the tiles that may hold a fragment."""
    found, gram, grams = [], 1, _grams(ids)
    hashes = next(grams)
    for low, high, size, window in octaves(len(ids)):
        while gram < size:
            hashes = next(grams, None)
            if hashes is None:
                return found
            gram *= 2
        order = np.argsort(hashes, kind="stable")
        sorted_hashes = hashes[order]
        same = sorted_hashes[1:] == sorted_hashes[:-1]
        if not same.any():
            return found
        places = order[:-1][same & (order[1:] - order[:-1] <= high)]
        last = max(0, -(-(len(ids) - 2 * window) // window))
        numbers = np.concatenate([places // window, places // window - 1])
        for number in np.unique(np.clip(numbers, 0, last)).tolist():
            found.append((low, number * window, min(2 * window, len(ids) - number * window)))
    return found


def _reach(ids: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """For each pair of places, how many words from the first on equal those from the second on (first < second)."""
    end = len(ids)
    padded = np.append(ids, -1)  # behind the last word nothing is equal
    reach = np.zeros(len(first), np.int64)
    alive, step = np.arange(len(first)), 1
    while len(alive):
        ahead = reach[alive, None] + np.arange(step)
        left = padded[np.minimum(first[alive, None] + ahead, end)]
        right = padded[np.minimum(second[alive, None] + ahead, end)]
        equal = (left == right) & (right >= 0)
        whole = equal.all(axis=1)
        reach[alive] += np.where(whole, step, equal.argmin(axis=1))
        alive = alive[whole]
        step = min(max(8, 2 * step), max(8, PAIRS // max(1, len(alive))))
    return reach


def _has_smaller_period(stretch: np.ndarray, period: int) -> bool:
    """A stretch of three periods has a smaller one only if that divides the period."""
    rest, prime = period, 2
    while rest > 1:
        if rest % prime == 0:
            smaller = period // prime
            if np.array_equal(stretch[smaller:], stretch[:-smaller]):
                return True
            while rest % prime == 0:
                rest //= prime
        prime = prime + 1 if prime * prime <= rest else max(rest, prime + 1)
    return False


def fragments(tiles: list[np.ndarray], low: int) -> set[tuple[int, int, int, int]]:
    """(tile, period, begin, end) of the fragments in some tiles, with periods of the octave that begins at ``low``.

    Tiles lie one after the other with a number between them that nothing equals, so that no comparison leaves its tile.
    """
    high = 7 if low == 1 else 2 * low - 1
    step = FIRST_GRAM if low == 1 else 2 * low
    found: set[tuple[int, int, int, int]] = set()
    sizes = np.array([len(tile) for tile in tiles])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    ids = np.concatenate([part for i, tile in enumerate(tiles) for part in (tile, [-2 - i])]).astype(np.int64)
    backwards = ids[::-1]
    periods = np.arange(low, high + 1)
    number = np.repeat(np.arange(len(tiles)), -(-sizes // step))
    first = np.cumsum(-(-sizes // step)) - -(-sizes // step)
    boundaries = starts[number] + (np.arange(len(number)) - first[number]) * step
    together = max(1, PAIRS // len(periods))
    for i in range(0, len(boundaries), together):
        begin, period = (part.ravel() for part in np.meshgrid(boundaries[i : i + together], periods, indexing="ij"))
        tile = np.repeat(number[i : i + together], len(periods))
        inside = begin + period <= starts[tile] + sizes[tile]
        begin, period, tile = begin[inside], period[inside], tile[inside]
        ahead = _reach(ids, begin, begin + period)
        # Backwards the later place comes first.
        behind = _reach(backwards, len(ids) - begin - period, len(ids) - begin)
        enough = np.flatnonzero(behind + period + ahead >= np.maximum(LEAST, REPEATS * period))
        ends = begin[enough] + period[enough] + ahead[enough]
        for t, q, b, e in zip(tile[enough].tolist(), period[enough].tolist(), (begin - behind)[enough].tolist(), ends.tolist()):
            entry = (t, q, b - int(starts[t]), e - int(starts[t]))
            if entry not in found and not _has_smaller_period(ids[b:e], q):
                found.add(entry)
    return found


# --- documents --------------------------------------------------------------------------------


def _numbers(words: list[bytes]) -> np.ndarray:
    return pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int32)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of words, and either the text's hash or its words and tiles."""
    tile_type = pa.list_(pa.struct([("low", pa.int32()), ("first", pa.int32()), ("words", pa.int32())]))
    for batch in batches:
        for begin in range(0, len(batch), ROWS_PER_BATCH):
            part = batch.slice(begin, ROWS_PER_BATCH)
            sizes, hashes, texts, numbers, cuts = [], [], [], [], []
            for text in part.column("text").to_pylist():
                words = text.encode("utf-8", "surrogatepass").split()
                ids = _numbers(words) if len(words) >= LEAST else np.zeros(0, np.int32)
                found = tiles(ids)
                joined = b" ".join(words)
                sizes.append(len(words))
                hashes.append(None if found else hashlib.sha256(joined).hexdigest())
                texts.append(joined.decode("utf-8", "surrogatepass") if found else None)
                numbers.append(ids if found else None)
                cuts.append([{"low": low, "first": first, "words": size} for low, first, size in found] or None)
            yield pa.RecordBatch.from_pydict(
                {
                    "place": part.column("place"),
                    "doc_id": part.column("doc_id"),
                    "n_words": pa.array(sizes, pa.int64()),
                    "plain_sha256": pa.array(hashes, pa.string()),
                    "words": pa.array(texts, pa.string()),
                    "ids": pa.array(numbers, pa.list_(pa.int32())),
                    "tiles": pa.array(cuts, tile_type),
                }
            )


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("place", pa.int64()), ("period", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])
    for batch in batches:
        rows: list[tuple[int, int, int, int]] = []
        held: dict[int, list[tuple[int, int, np.ndarray]]] = {}  # tiles of an octave that are solved together
        words: dict[int, int] = {}

        def settle(low: int) -> None:
            tiles = held.pop(low)
            words.pop(low)
            for t, q, b, e in fragments([ids for _, _, ids in tiles], low):
                place, first, _ = tiles[t]
                rows.append((place, q, first + b, first + e))

        ids, ends = batch.column("ids").flatten().to_numpy(), np.cumsum(pc.list_value_length(batch.column("ids")).to_numpy())
        for i, (place, low, first) in enumerate(zip(*(batch.column(name).to_pylist() for name in ("place", "low", "first")))):
            tile = ids[ends[i - 1] if i else 0 : ends[i]]
            held.setdefault(low, []).append((place, first, tile))
            words[low] = words.get(low, 0) + len(tile)
            if words[low] >= TOGETHER:
                settle(low)
        for low in list(held):
            settle(low)
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64()) for values in columns], schema=schema)


def stitched(pieces: DataFrame) -> DataFrame:
    """(place, period, begin, end): fragments of one document and period that overlap by a period or more as one run."""
    by_run = Window.partitionBy("place", "period").orderBy("begin", "end")
    reached = F.max("end").over(by_run.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reached.isNull() | (F.col("begin") > reached - F.col("period")), 1).otherwise(0)
    marked = pieces.withColumn("opens", opens)
    numbered = marked.withColumn("run", F.sum("opens").over(by_run.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy("place", "period", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    return runs.select("place", "period", "begin", "end")


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text without the words that only repeat a run's first period."""
    for batch in batches:
        texts = []
        for words, runs in zip(batch.column("words").to_pylist(), batch.column("runs").to_pylist()):
            split = words.split(" ")
            kept = np.ones(len(split), bool)
            for run in runs or ():
                kept[run["start"] + run["period"] : run["start"] + run["length"]] = False
            texts.append(" ".join(split[i] for i in np.flatnonzero(kept).tolist()))
        names = [name for name in batch.schema.names if name != "words"]
        yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in names), pa.array(texts, pa.string())], [*names, "collapsed"])


_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def periodic_runs(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed, collapsed_sha256), one row per document.

    ``runs`` are (start, length, period) by start, then period. ``collapsed`` is the text without the words that only
    repeat, joined by blanks; it is null for a document that has no repeated gram and thus loses nothing but its blanks.
    """
    narrow = documents.select(
        F.monotonically_increasing_id().alias("place"), column(doc_id).alias("doc_id"), F.coalesce(column(text), F.lit("")).alias("text")
    )
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    schema = (
        f"place bigint, doc_id {id_type}, n_words bigint, plain_sha256 string, words string, ids array<int>, "
        "tiles array<struct<low:int,first:int,words:int>>"
    )
    # Written once: the places must not change between the uses.
    cut = written(narrow.mapInArrow(_cut, schema))
    opened = cut.where("tiles IS NOT NULL").select("place", "ids", F.explode("tiles").alias("tile"))
    tile = opened.select("place", "tile.low", "tile.first", F.slice("ids", F.col("tile.first") + 1, F.col("tile.words")).alias("ids"))
    # Tiles are small to move and take time to solve, so their number tells the tasks, not their bytes.
    number = cut.agg(F.coalesce(F.sum(F.greatest(F.size("tiles"), F.lit(0))), F.lit(0))).first()[0]
    tasks = max(number // TASK_TILES, documents.sparkSession.sparkContext.defaultParallelism)
    pieces = tile.repartition(int(tasks), "place", "low", "first").mapInArrow(_solve, "place bigint, period bigint, begin bigint, end bigint")
    run = F.struct(F.col("begin").alias("start"), (F.col("end") - F.col("begin")).alias("length"), "period")
    order = F.sort_array(F.collect_list(F.struct(F.col("begin").alias("start"), "period", run.alias("run"))))
    runs = stitched(pieces).groupBy("place").agg(F.transform(order, lambda entry: entry["run"]).alias("runs"))
    suspects = cut.where("tiles IS NOT NULL").select("place", "doc_id", "n_words", "words").join(written(runs), "place", "left")
    collapsed = suspects.select("doc_id", "n_words", "runs", "words").mapInArrow(
        _collapse, f"doc_id {id_type}, n_words bigint, runs {_RUNS}, collapsed string"
    )
    found = collapsed.select("doc_id", "n_words", "runs", "collapsed", F.sha2("collapsed", 256).alias("collapsed_sha256"))
    none = cut.where("tiles IS NULL").select(
        "doc_id", "n_words", F.lit(None).cast(_RUNS).alias("runs"), F.lit(None).cast("string").alias("collapsed"),
        F.col("plain_sha256").alias("collapsed_sha256"),
    )
    every = found.unionByName(none)
    return every.withColumn("runs", F.coalesce("runs", F.array().cast(_RUNS)))
