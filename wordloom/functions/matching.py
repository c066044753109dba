"""Counting word sequences inside one text. All arrays here are bounded by that text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def places(held: Column, asked: Column) -> Column:
    """Sorted positions per distinct word of the request, in alias order.

    ``held`` is an array of (word, positions) of the text, ``asked`` the words of the request. A text indexed twice
    has its positions merged.
    """

    def of_word(wanted: Column) -> Column:
        lists = F.transform(F.filter(held, lambda entry: entry["word"] == wanted), lambda entry: entry["positions"])
        return F.sort_array(F.array_distinct(F.flatten(lists)))

    return F.transform(F.array_distinct(asked), of_word)


def aliases(hashes: Column) -> Column:
    """The request as (alias, ord) pairs; alias = number of the distinct word in order of first use."""
    return F.transform(
        hashes,
        lambda wanted, ord: F.struct(
            (F.array_position(F.array_distinct(hashes), wanted) - 1).cast("int").alias("alias"),
            ord.alias("ord"),
        ),
    )


def exact_hits(places: Column, sequence: Column) -> Column:
    """Starts at which every word of the sequence stands in its place."""
    shifted = F.transform(
        sequence,
        lambda step: F.transform(F.get(places, step["alias"]), lambda position: position - step["ord"]),
    )
    return F.size(F.aggregate(shifted, F.get(shifted, F.lit(0)), lambda left, right: F.array_intersect(left, right)))


def run_hits(frame: DataFrame, places: str, sequence: str, hits: str) -> DataFrame:
    """Runs of adjacent request words that begin or end with the sequence; each run counts once."""
    marks = F.sort_array(
        F.flatten(
            F.transform(
                F.col(places),
                lambda positions, alias: F.transform(
                    positions, lambda position: F.struct(position.alias("position"), alias.alias("alias"))
                ),
            )
        )
    )

    def opens_run(i: Column) -> Column:
        gap = F.get("_marks", i)["position"] - F.get("_marks", i - 1)["position"]
        return (i == 0) | (gap > 1)

    def reads_from(start: Column) -> Column:
        return F.forall(F.col(sequence), lambda step: F.get("_marks", start + step["ord"])["alias"] == step["alias"])

    def matches(run: Column) -> Column:
        length = F.size(sequence)
        return (run["end"] - run["start"] >= length) & (reads_from(run["start"]) | reads_from(run["end"] - length))

    count = F.size("_marks")
    runs = F.transform(
        F.col("_opens"),
        lambda start, i: F.struct(start.alias("start"), F.coalesce(F.get("_opens", i + 1), count).alias("end")),
    )
    return (
        frame.withColumn("_marks", marks)
        .withColumn("_opens", F.filter(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), opens_run))
        .withColumn(hits, F.size(F.filter(runs, matches)))
        .drop("_marks", "_opens")
    )


def settle(frame: DataFrame, **columns: Column) -> DataFrame:
    """Add columns whose value is computed once: later filters stay above, so nothing is computed twice."""
    packed = F.struct(*[value.alias(name) for name, value in columns.items()])
    settled = frame.select("*", F.explode_outer(F.array(packed)).alias("_settled"))
    return settled.select(*frame.columns, *[F.col(f"_settled.{name}").alias(name) for name in columns])


def frequency(matching_words: Column, total_words: Column) -> Column:
    """Share of matching words, five digits; scaled first so that exact ties round as in IEEE arithmetic."""
    return F.round(matching_words / total_words * F.lit(100000.0)) / F.lit(100000.0)
