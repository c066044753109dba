"""Quotation linking: quoted passages of messages are found in the messages they come from.

Lines that begin with ``>`` marks are quotes of that many levels; lines of one level in a row are a passage. A passage
is normalised and hashed as a whole, by paragraph (cut at empty quoted lines) and line by line, and joined with the
hashes of whole messages, paragraphs and lines. The whole counts before its paragraphs, these before its lines, longer
ones before shorter ones; the first message of the same conversation
that holds it counts before the first of all. A message only quotes earlier ones, by conversation and turn, so replies
form trees: a message answers the source of its least nested quote. Roots and depths come from joins that double the
distance in each round, each written to the shared folder.

For each hash only the first message of a conversation and of all takes part, so a line that very many messages share
yields one row per quote.

Defined results: null and empty texts hold nothing and quote nothing; a message without a linked quote is a root; equal
rows are one message given twice and have equal results; rows of one conversation and turn with other texts are told
apart by their text; null conversations and turns come first in the order; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.matching import settle
from wordloom.llm.expressions import let, places, text_key, unused, with_results, written

MARKS = r"^[ \t]*(?:>[ \t]*)+"


def quote_lines(text: Column) -> Column:
    """Lines as (level, content)."""

    def told(line: Column) -> Column:
        marks = F.regexp_extract(line, MARKS, 0)
        level = F.char_length(F.regexp_replace(marks, "[^>]", ""))
        return F.struct(level.alias("level"), F.substring(line, F.char_length(marks) + 1, F.char_length(line)).alias("content"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n", -1), lambda line: let(line, told))


def passages(lines: Column) -> Column:
    """Runs of lines of one level above 0, as (level, contents)."""

    def begins(i: Column) -> Column:
        own = F.get(lines, i)["level"]
        return (own > 0) & ((i == 0) | (own != F.get(lines, F.greatest(i - 1, F.lit(0)))["level"]))

    def ends(i: Column) -> Column:
        own = F.get(lines, i)["level"]
        return (own > 0) & F.coalesce(own != F.get(lines, i + 1)["level"], F.lit(True))

    def cut(starts: Column) -> Column:
        def run(bounds: Column) -> Column:
            inside = F.slice(lines, bounds["begin"] + 1, bounds["end"] - bounds["begin"] + 1)
            return F.struct(
                F.get(lines, bounds["begin"])["level"].alias("level"), F.transform(inside, lambda line: line["content"]).alias("contents")
            )

        return F.transform(F.arrays_zip(starts["begin"], starts["end"]), run)

    every = places(F.size(lines))
    return let(F.struct(F.filter(every, begins).alias("begin"), F.filter(every, ends).alias("end")), cut)


def unquoted(lines: Column) -> Column:
    """The text without quotes and without blank ends."""
    own = F.transform(F.filter(lines, lambda line: line["level"] == 0), lambda line: line["content"])
    return F.regexp_replace(F.array_join(own, "\n"), r"^\s+|\s+$", "")


def normal(passage: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(passage), r"\s+", " "))


def _hashes(units: Column) -> Column:
    """Hashes of the units that hold something, in order, each once."""
    full = F.filter(F.transform(units, normal), lambda unit: unit != "")
    return F.array_distinct(F.transform(full, lambda unit: F.md5(unit.cast("binary"))))


def _message(conversation: Column, turn: Column, key: Column) -> Column:
    return F.xxhash64(conversation, turn, key, conversation.isNull(), turn.isNull())


def parsed(messages: DataFrame, conversation: str, turn: str, text: str) -> DataFrame:
    """(conv, turn, key, message, lines) of each message."""
    rows = messages.select(
        F.col(conversation).alias("conv"), F.col(turn).alias("turn"), text_key(F.col(text)).alias("key"), F.col(text).alias("text")
    )
    rows = settle(rows, lines=quote_lines(F.col("text")))
    return rows.select("conv", "turn", "key", _message(F.col("conv"), F.col("turn"), F.col("key")).alias("message"), "lines")


def quote_links(rows: DataFrame) -> DataFrame:
    """(message, passage_no, level, source) of each passage of parsed messages; an unknown ``source`` is null.

    ``source`` is (conv, turn, key) of the message that the passage comes from.
    """
    body = settle(rows, body=unquoted(F.col("lines")))
    units = F.concat(F.array("body"), F.split("body", r"\n[ \t]*\n", -1), F.split("body", r"\n", -1))
    held = body.select("conv", "turn", "key", F.explode(_hashes(units)).alias("hash"))
    own = F.struct("turn", "key")
    in_conversation = held.groupBy("hash", "conv").agg(F.min(own).alias("near"))
    anywhere = held.groupBy("hash").agg(F.min(F.struct("conv", "turn", "key")).alias("far"))

    quoted = rows.where(F.exists("lines", lambda line: line["level"] > 0))
    opened = quoted.select("conv", "turn", "key", "message", F.posexplode(passages(F.col("lines"))).alias("passage_no", "passage"))

    def by_length(units: Column) -> Column:
        return F.array_sort(units, lambda a, b: (F.char_length(b) - F.char_length(a)).cast("int"))

    whole = F.array_join("passage.contents", "\n")
    # A quote that a mail client wrapped anew has paragraphs of the original, but none of its lines.
    wanted = _hashes(F.concat(F.array(whole), by_length(F.split(whole, r"\n[ \t]*\n", -1)), by_length(F.col("passage.contents"))))
    sought = opened.select(
        "conv", "turn", "key", "message", "passage_no", F.col("passage.level").alias("level"),
        F.posexplode_outer(wanted).alias("rank", "hash"),
    )
    near = in_conversation.select(F.col("hash").alias("near_hash"), F.col("conv").alias("near_conv"), "near")
    far = anywhere.select(F.col("hash").alias("far_hash"), "far")
    found = sought.join(near, (F.col("hash") == F.col("near_hash")) & F.col("conv").eqNullSafe(F.col("near_conv")), "left")
    found = found.join(far, F.col("hash") == F.col("far_hash"), "left")
    before = F.struct("conv", F.col("near.turn").alias("turn"), F.col("near.key").alias("key"))
    # The order of structs is that of their fields, nulls first; equal turns are no earlier ones.
    earlier_near = F.struct(F.col("near.turn")) < F.struct("turn")
    earlier_far = F.struct(F.col("far.conv"), F.col("far.turn")) < F.struct("conv", "turn")
    source = F.when(F.col("near").isNotNull() & earlier_near, before).when(F.col("far").isNotNull() & earlier_far, F.col("far"))
    return (
        found.withColumn("source", source)
        .groupBy("message", "passage_no")
        .agg(F.first("level").alias("level"), F.min_by("source", F.when(F.col("source").isNotNull(), F.col("rank"))).alias("source"))
    )


def trees(replies: DataFrame) -> DataFrame:
    """(message, root, depth) of (message, source): the root of each reply's tree as (conv, turn, key), and its depth."""
    paths = written(replies.select("message", F.col("source").alias("root"), F.lit(1).alias("depth")))
    while True:
        steps = paths.select(F.col("message").alias("at"), F.col("root").alias("higher"), F.col("depth").alias("more"))
        reached = _message(F.col("root.conv"), F.col("root.turn"), F.col("root.key"))
        # Only sources that are replies themselves lead on; they are few rows, each once.
        onward = paths.select(reached.alias("at")).distinct().join(steps, "at")
        onward = written(onward)
        if not onward.head(1):
            return paths
        joined = paths.join(onward, reached == F.col("at"), "left")
        paths = written(
            joined.select("message", F.coalesce("higher", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        )


RESULTS = ("text", "n_quotes", "n_linked", "reply_conv", "reply_turn", "root_conv", "root_turn", "depth")


def linked_conversations(
    messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text"
) -> DataFrame:
    """The messages in reply order, with their text without quotes, and

    ``n_quotes`` and ``n_linked`` passages, ``reply_conv`` and ``reply_turn`` of the message answered (null for roots),
    ``root_conv``, ``root_turn`` and ``depth``. The order is by root, then depth, then own place, sorted in ranges.
    """
    rows = parsed(messages, conversation, turn, text)
    links = written(quote_links(rows))
    nearest = F.min(F.when(F.col("source").isNotNull(), F.struct("level", "passage_no", "source")))
    # A message given twice has its passages once in the links.
    per_message = links.groupBy("message").agg(
        F.count(F.lit(1)).alias("n_quotes"), F.count("source").alias("n_linked"), nearest.alias("nearest")
    )
    per_message = written(per_message.select("message", "n_quotes", "n_linked", F.col("nearest.source").alias("source")))
    roots = trees(per_message.where(F.col("source").isNotNull()).select("message", "source"))
    told = per_message.join(roots, "message", "left").withColumnRenamed("message", "of_message")
    name = unused(messages, "_told")
    told = told.select("of_message", F.struct("n_quotes", "n_linked", "source", "root", "depth").alias(name))
    own, key = unused(messages, "_message"), unused(messages, "of_message")
    told = told.withColumnRenamed("of_message", key)
    keyed = messages.withColumn(own, _message(F.col(conversation), F.col(turn), text_key(F.col(text))))
    joined = keyed.join(told, F.col(own) == F.col(key), "left")
    info = F.col(name)
    is_root = info["root"].isNull()
    results = with_results(
        joined,
        **{
            text: unquoted(quote_lines(F.col(text))),
            "n_quotes": F.coalesce(info["n_quotes"], F.lit(0)),
            "n_linked": F.coalesce(info["n_linked"], F.lit(0)),
            "reply_conv": info["source"]["conv"],
            "reply_turn": info["source"]["turn"],
            "root_conv": F.when(is_root, F.col(conversation)).otherwise(info["root"]["conv"]),
            "root_turn": F.when(is_root, F.col(turn)).otherwise(info["root"]["turn"]),
            "depth": F.coalesce(info["depth"], F.lit(0)),
        },
    ).drop(name, own, key)
    order = ["root_conv", "root_turn", "depth", conversation, turn]
    return results.repartitionByRange(*order).sortWithinPartitions(*order)
