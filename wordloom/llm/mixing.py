"""Mixing sources to target weights along a curriculum that changes with time.

Targets: every source asks for its weight's share of the words of the mix, up to a number of repeats; what goes
beyond is shared again by weight. Positions: a source's schedule gives its weight at each time of the training from
0 to 1, piece by piece linear. Its integral, scaled to the target, is the number of words asked for up to that time.
Each document stands at a place in its source's order of hashed ids; the time at which the demand reaches that
place, the inverse of the integral, is the position of the document's first word, and of each repeat's. The mix is
the documents in the order of their positions, by range.

Defined results: null and empty texts have size 0 and are never taken; sources of size 0 have target 0; the null
source is a source of its own, the last; equal rows are ordered next to each other, alike but for what is taken of
the last one; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.expressions import column, let, text_key, total, words_of, written
from wordloom.llm.numbering import hashed_order, running

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MAX_REPEATS = 2
#: The table of sources is broadcast up to this many rows, counted first.
MAX_BROADCAST_SOURCES = 100_000
#: For each weight the schedule as (time, weight) knots: heavy sources early, light ones late.
SCHEDULES = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.25), (0.5, 1.0), (1.0, 1.75)),
)
Knots = Sequence[tuple[float, float]]


def filled(sources: DataFrame, share_percent: int, max_repeats: int) -> DataFrame:
    """Adds ``target`` to (source, weight, source_size, ...), one row per source.

    Let a source's level be its bound over its weight. With sources in order of their levels, the first so many are
    full; the rest share what is left by weight. Sums over sources of lower level tell how many: a source is full if
    the share at its own level, all lower ones full, is no less than its bound.
    """
    bound = F.col("source_size") * max_repeats
    budget = F.sum("source_size").over(Window.partitionBy()) * F.lit(share_percent / 100)
    levels = sources.select("*", bound.alias("_bound"), (bound / F.col("weight")).alias("_level"), budget.alias("_budget"))
    lower = Window.partitionBy().orderBy("_level", F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    sums = levels.select(
        "*",
        F.coalesce(F.sum("_bound").over(lower), F.lit(0)).alias("_full_before"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(lower), F.lit(0))).alias("_weight_left"),
    )
    full = F.col("_weight_left") * F.col("_bound") <= (F.col("_budget") - F.col("_full_before")) * F.col("weight")
    marked = sums.select("*", full.alias("_full"))
    rest = marked.select(
        "*",
        (F.col("_budget") - F.sum(F.when(F.col("_full"), F.col("_bound")).otherwise(0)).over(everything)).alias("_rest"),
        F.sum(F.when(F.col("_full"), 0).otherwise(F.col("weight"))).over(everything).alias("_rest_weight"),
    )
    shared = F.try_divide(F.col("_rest").cast("double") * F.col("weight"), F.col("_rest_weight").cast("double"))
    target = F.when(F.col("_full"), F.col("_bound").cast("double")).otherwise(shared)
    return rest.select(*sources.columns, target.alias("target"))


def source_targets(
    sizes: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share_percent: int = SHARE_PERCENT,
    max_repeats: int = MAX_REPEATS,
) -> DataFrame:
    """(source, source_size, n_rows, turn, weight, target) of (source, size); sources by code point take the weights in turn.

    There is one row per source from here on; those few rows, and no documents, meet in one task.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    named = sources.select("source", "source_size", "n_rows", turn.alias("turn"))
    weighted = named.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), F.col("turn")))
    return filled(weighted, share_percent, max_repeats)


def pieces(knots: Knots) -> list[tuple[float, float, float, float, float]]:
    """(share before, share after, begin, length, weights at begin and end relative to the piece) per piece.

    Shares are the integral of the schedule up to the piece over the whole integral.
    """
    if len(knots) < 2 or knots[0][0] != 0.0 or knots[-1][0] != 1.0 or any(w < 0 for _, w in knots):
        raise ValueError("a schedule runs from time 0 to 1 with weights of 0 or more")
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
    whole, so_far, out = sum(areas), 0.0, []
    if whole <= 0:
        raise ValueError("a schedule needs some weight")
    for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas):
        if area > 0:
            out.append((so_far / whole, (so_far + area) / whole, t0, t1 - t0, w0 / (w0 + w1)))
        so_far += area
    return out


def time_of(share: Column, knots: Knots) -> Column:
    """The time up to which a schedule has asked for a share of its whole demand."""
    time = None
    for before, after, begin, length, first in pieces(knots):
        # Inside a piece the demand is 2 * first * x + (1 - 2 * first) * x^2 for x from 0 to 1; this form of its
        # inverse has no difference of like numbers.
        inner = F.least(F.greatest((share - before) / (after - before), F.lit(0.0)), F.lit(1.0))
        root = F.sqrt(F.lit(first * first) + inner * (1 - 2 * first))
        x = F.when(inner <= 0, F.lit(0.0)).otherwise(inner / (root + first))
        at = F.lit(begin) + x * length
        time = F.when(share <= after, at) if time is None else time.when(share <= after, at)
    return time.otherwise(F.lit(1.0))


def schedule_time(share: Column, turn: Column, schedules: Sequence[Knots]) -> Column:
    times = None
    for i, knots in enumerate(schedules):
        times = F.when(turn == i, time_of(share, knots)) if times is None else times.when(turn == i, time_of(share, knots))
    return times


def mix(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share_percent: int = SHARE_PERCENT,
    max_repeats: int = MAX_REPEATS,
    schedules: Sequence[Knots] = SCHEDULES,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """(row, source, size, source_size, target, repeats, taken), one row per document.

    ``row`` holds the columns to keep, all unless ``keep`` names some; ``repeats`` has (position, words) of each time
    the document is read, ``taken`` is the sum of those words. Only the last document of a source is taken in part.
    """
    if len(schedules) != len(weights):
        raise ValueError("each weight needs a schedule")
    kept = list(documents.columns if keep is None else keep)
    rows = documents.select(
        F.struct(*[column(name) for name in kept]).alias("row"),
        F.col(doc_id).alias("id"),
        text_key(F.col(text)).alias("key"),
        hashed_order(F.col(doc_id), F.md5(F.col(text).cast("binary"))).alias("order"),
        F.col(source).alias("source"),
        let(words_of(F.col(text)), F.size).cast("bigint").alias("size"),
    )
    if text not in kept:
        rows = written(rows)  # else the words of each text are counted three times, which is cheaper than a copy
    targets = written(source_targets(rows, weights, share_percent, max_repeats))
    n_sources, n_rows = targets.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_rows"), F.lit(0))).first()
    other = targets.select(F.col("source").alias("of_source"), "source_size", "turn", "target")
    if n_sources <= MAX_BROADCAST_SOURCES:
        other = F.broadcast(other)
    ordered = rows.withColumn("rest", F.xxhash64(*[f"row.`{name}`" for name in _hashable(documents, kept)]))
    placed = running(ordered, ["source"], "order", ["id", "key", "rest"], {"before": F.col("size")}, n_rows)
    aimed = placed.join(other, F.col("source").eqNullSafe(F.col("of_source")))

    def read(time_no: Column) -> Column:
        """The document in a pass over its source; passes count from 0."""
        begin = time_no * F.col("source_size") + F.col("before")
        words = F.least(F.greatest(F.floor("target") - begin, F.lit(0)), F.col("size"))
        position = schedule_time(F.try_divide(begin.cast("double"), F.col("target")), F.col("turn"), schedules)
        return F.struct(position.alias("position"), words.cast("bigint").alias("words"))

    passes = F.array(*[read(F.lit(i).cast("bigint")) for i in range(max_repeats)])
    repeats = F.filter(passes, lambda one: one["words"] > 0)
    results = aimed.select("row", "source", "size", "source_size", "target", repeats.alias("repeats"))
    return results.withColumn("taken", total(F.transform("repeats", lambda one: one["words"])))


def _hashable(documents: DataFrame, names: Sequence[str]) -> list[str]:
    return [name.replace("`", "``") for name in names if "map<" not in documents.schema[name].dataType.simpleString()]


def in_training_order(mixed: DataFrame) -> DataFrame:
    """The kept columns once for each time a document is read, sorted by position in ranges.

    Documents are whole here: a reading in part counts from half of the document on.
    """
    read = mixed.select("row", "size", F.explode("repeats").alias("one")).where(F.col("one.words") * 2 >= F.col("size"))
    placed = read.select("row", F.col("one.position").alias("position"))
    return placed.repartitionByRange("position").sortWithinPartitions("position").select("row.*")
