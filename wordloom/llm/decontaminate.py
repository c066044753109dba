"""Benchmark decontamination: windows of words of the documents are looked up among those of the benchmark.

The windows of the benchmark form a hash table that is broadcast if its measured size allows it; otherwise
the same join is left to the planner. A hit is verified word by word, then windows are gathered per document.

Defined results: a null or empty text has no words and no hits; an item without words has no window; an item
shorter than a window is one window; equal rows of documents have equal results and stay as many rows; rows
with the same id and other texts are told apart by their text; null ids stay null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.matching import settle
from wordloom.llm.expressions import PLAIN_WORD, column, let, lower_ascii, places, text_key, unused, words_of

WINDOW = 10
#: A table of windows is broadcast below this many bytes of text.
MAX_BROADCAST_BYTES = 64 << 20


def normal_words(text: Column) -> Column:
    return lower_ascii(words_of(text, PLAIN_WORD))


def window_hashes(words: Column, length: int) -> Column:
    """A 64-bit hash of every window of so many words."""
    return F.transform(
        places(F.size(words) - (length - 1)), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(length)])
    )


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(length, window, item_id): the distinct windows of each item."""
    split = settle(benchmark.select(F.col(item).alias("item_id"), F.col(text).alias("text")), words=normal_words(F.col("text")))
    length = F.least(F.size("words"), F.lit(window))
    cut = F.transform(places(F.size("words") - length + 1), lambda i: F.array_join(F.slice("words", i + 1, length), " "))
    return (
        split.where(F.size("words") > 0)
        .select("item_id", length.alias("length"), F.explode_outer(cut).alias("window"))
        .where(F.col("window").isNotNull())
        .distinct()
    )


def _is_small(frame: DataFrame, size: Column, max_bytes: int) -> bool:
    return frame.agg(F.coalesce(F.sum(size + 64), F.lit(0))).first()[0] <= max_bytes


def hits(documents: DataFrame, windows: DataFrame, text: str, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """(id, key, n_words, at, length, window): each row of (id, text) once with nulls, and a row for each hit.
    """
    lengths = sorted(row.length for row in windows.select("length").distinct().collect())  # at most WINDOW values
    hashes = [F.when(F.col("length") == n, F.get(window_hashes(F.split("window", " "), n), F.lit(0))) for n in lengths]
    known = windows.select("window", F.coalesce(F.lit(None).cast("bigint"), *hashes).alias("hash"), "length").distinct()
    split = settle(
        documents.select("id", text_key(F.col(text)).alias("key"), F.col(text).alias("text")),
        words=normal_words(F.col("text")),
    ).select("id", "key", "words", F.size("words").alias("n_words"))

    # One list of hashes per document: a null for the document itself, then the windows of each length in turn.
    own = F.array(F.lit(None).cast("bigint"))
    hashed = settle(split, hashes=F.concat(own, *[window_hashes(F.col("words"), n) for n in lengths]))
    flat = hashed.select("id", "key", "n_words", "words", F.posexplode_outer("hashes").alias("place", "hash"))
    starts = [F.when(F.col("length") == n, start) for n, start in _last_first(lengths)]
    at = F.col("place") - F.coalesce(F.lit(None).cast("int"), *starts)

    def own_window(at: Column, length: Column) -> Column:
        return F.array_join(F.slice("words", F.greatest(at, F.lit(0)) + 1, length), " ")

    document = F.col("place") == 0
    if _is_small(known, F.octet_length("window"), max_bytes):
        # No shuffle: the words stay at hand, and only windows whose hash is known are put together.
        met = flat.join(F.broadcast(known), "hash", "left")
        met = met.where(document | (F.col("window").isNotNull() & (own_window(at, F.col("length")) == F.col("window"))))
    else:
        # The words of a window travel with it instead of those of the whole text.
        each = [F.when(F.col("place") >= start, own_window(F.col("place") - start, F.lit(n))) for n, start in _last_first(lengths)]
        cut = flat.where(~document).withColumn("own_window", F.coalesce(F.lit(None).cast("string"), *each)).drop("words")
        met = cut.join(known, "hash").where(F.col("own_window") == F.col("window")).drop("own_window")
        # The rows of the documents themselves have no hash and would all meet in one task of the join.
        alone = split.select("id", "key", "n_words", F.lit(0).alias("place"), F.lit(None).cast("bigint").alias("hash"))
        met = met.unionByName(alone, allowMissingColumns=True)
    return met.select("id", "key", "n_words", F.when(~document, at).alias("at"), "length", "window")


def _last_first(lengths: list[int]) -> list[tuple[int, Column]]:
    """Each length and the place its windows begin at, the last first."""
    out, before = [], F.lit(1)
    for n in lengths:
        out.append((n, before))
        before = before + F.greatest(F.col("n_words") - (n - 1), F.lit(0))
    return out[::-1]


def _covered(spans: Column) -> Column:
    """Words inside any of the sorted spans (at, length)."""
    none = F.struct(F.lit(0).cast("bigint").alias("words"), F.lit(0).alias("reach"))

    def add(so_far: Column, span: Column) -> Column:
        end = span["at"] + span["length"]
        fresh = F.greatest(end - F.greatest(span["at"], so_far["reach"]), F.lit(0))
        return F.struct((so_far["words"] + fresh).alias("words"), F.greatest(so_far["reach"], end).alias("reach"))

    return F.aggregate(spans, none, add)["words"]


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    max_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """(doc_id, key, n_words, spans, n_hit, items, contaminated), one row for each document.

    ``key`` tells texts of one id apart, ``spans`` are the hit windows as (at, length) in words, ``items`` the
    ids of the benchmark found, as sorted strings.
    """
    windows = benchmark_windows(benchmark, item, item_text, window)
    rows = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    found = hits(rows, windows, "text", max_bytes)
    span = F.when(F.col("window").isNotNull(), F.struct("at", "length"))
    per_text = found.groupBy("id", "key").agg(
        F.count_if(F.col("at").isNull()).alias("copies"),
        F.max("n_words").cast("bigint").alias("n_words"),
        F.sort_array(F.collect_set(span)).alias("spans"),
        F.collect_set("window").alias("windows"),
    )
    items_of = windows.select("window", "item_id")
    if _is_small(items_of, F.octet_length("window"), max_bytes):
        items_of = F.broadcast(items_of)
    opened = per_text.select("id", "key", "copies", "n_words", "spans", F.explode_outer("windows").alias("window"))
    named = opened.join(items_of, "window", "left").groupBy("id", "key").agg(
        F.first("copies").alias("copies"),
        F.first("n_words").alias("n_words"),
        F.first("spans").alias("spans"),
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )
    return named.select(
        F.col("id").alias("doc_id"),
        "key",
        "n_words",
        "spans",
        _covered(F.col("spans")).alias("n_hit"),
        "items",
        (F.size("spans") > 0).alias("contaminated"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")


def _without(text: Column, spans: Column) -> Column:
    """The text without the words of the spans and what parts them from the next word."""
    def kept(parts: Column) -> Column:
        def piece(i: Column) -> Column:
            hit = F.exists(spans, lambda span: (i >= span["at"]) & (i < span["at"] + span["length"]))
            return F.when(hit, F.lit("")).otherwise(F.concat(F.get(parts["words"], i), F.get(parts["gaps"], i + 1)))

        body = F.array_join(F.transform(places(F.size(parts["words"])), piece), "")
        return F.concat(F.get(parts["gaps"], F.lit(0)), body)

    return let(F.struct(words_of(text, PLAIN_WORD).alias("words"), F.split(text, PLAIN_WORD, -1).alias("gaps")), kept)


def remove(
    documents: DataFrame,
    benchmark: DataFrame,
    mode: str = "documents",
    doc_id: str = "doc_id",
    text: str = "text",
    **options,
) -> DataFrame:
    """The documents without what the benchmark holds: whole documents, or in mode ``spans`` the words hit."""
    if mode not in ("documents", "spans"):
        raise ValueError("mode must be documents or spans")
    found = contamination(documents, benchmark, doc_id, text, **options).where("contaminated")
    hit_id, hit_key, spans = (unused(documents, name) for name in ("_hit_id", "_hit_key", "_spans"))
    hit = found.select(F.col("doc_id").alias(hit_id), F.col("key").alias(hit_key), F.col("spans").alias(spans)).distinct()
    match = column(doc_id).eqNullSafe(F.col(hit_id)) & (text_key(column(text)) == F.col(hit_key))
    if mode == "documents":
        return documents.join(hit, match, "left_anti")
    joined = documents.join(hit, match, "left")
    cut = F.when(F.col(spans).isNull(), column(text)).otherwise(_without(column(text), F.col(spans)))
    return joined.select(*[cut.alias(c) if c == text else column(c) for c in documents.columns])
