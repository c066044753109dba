"""SimHash near-duplicates by covering locality-sensitive hashing.

For a radius r every bit position gets a vector of r + 1 bits, and each of the 2^(r+1) - 1 non-zero vectors v is a
table whose mask keeps the positions with an odd product with v. Up to r positions leave some v with even products
at all of them, so fingerprints that differ there collide in the table of v: no pair within the radius is missed.

Copies meet once, as one fingerprint. A bucket's fingerprints are linked to the smallest of each group, not pair
by pair; a bucket above ``MAX_BUCKET`` is cut into blocks, and every two blocks meet in a task of their own.

Defined results: null and empty texts have fingerprint zero, linked like any other; equal rows stay as many rows;
a component whose ids are all null has a null ``component_id``; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.components import components
from wordloom.llm.expressions import let, lower_ascii, places, text_key, unused, words_of, written

BITS = 64
SHINGLE = 4
RADIUS = 4
MAX_BUCKET = 4096
COUNTED_AT_ONCE = 1 << 15


def shingle_hashes(text: Column, length: int = SHINGLE) -> Column:
    """XXH64 (seed 42) of every shingle of words; a text of fewer words is one shingle."""

    def hashed(words: Column) -> Column:
        n = F.size(words)
        many = F.transform(
            places(n - (length - 1)), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(words, i + j) for j in range(length)]))
        )
        one = F.array(F.xxhash64(F.array_join(words, " ")))
        return F.when(n >= length, many).when(n > 0, one).otherwise(F.array().cast("array<bigint>"))

    return let(lower_ascii(words_of(text)), hashed)


def majority(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint per list: the bits set in over half of the list's hashes."""
    sizes = np.diff(offsets)
    ones = np.zeros((len(sizes), BITS), dtype=np.int64)
    for begin in range(int(offsets[0]), int(offsets[-1]), COUNTED_AT_ONCE):
        end = min(begin + COUNTED_AT_ONCE, int(offsets[-1]))
        first = int(np.searchsorted(offsets, begin, side="right")) - 1
        last = int(np.searchsorted(offsets, end, side="left"))
        rows = first + np.flatnonzero(sizes[first:last])
        bits = np.unpackbits(hashes[begin:end].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.maximum(offsets[rows], begin) - begin
        ones[rows] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    set_bits = (ones * 2 > sizes[:, None]).astype(np.uint8)
    return np.packbits(set_bits, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("hashes"))
        hashes = np.asarray(lists.values).view(np.uint64)
        prints = majority(hashes, np.asarray(lists.offsets).astype(np.int64))
        columns = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(prints.view(np.int64))], ["id", "key", "fingerprint"])


def fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, key, fingerprint) of every document; ``key`` tells texts of one id apart."""
    hashed = documents.select(
        F.col(doc_id).alias("id"), text_key(F.col(text)).alias("key"), shingle_hashes(F.col(text), shingle).alias("hashes")
    )
    kind = hashed.schema["id"].dataType.simpleString()
    return hashed.mapInArrow(_fingerprints, f"id {kind}, key bigint, fingerprint bigint")


@lru_cache
def covering_masks(radius: int = RADIUS, bits: int = BITS, seed: int = 1) -> tuple[int, ...]:
    """The masks as signed 64-bit numbers, one for each non-zero vector.

    Positions take the non-zero vectors in turn and in shuffled order, so that every mask keeps about half of the bits.
    """
    vectors = 1 << (radius + 1)
    draw = np.random.default_rng(seed)
    given = np.concatenate([draw.permutation(np.arange(1, vectors)) for _ in range(-(-bits // (vectors - 1)))])[:bits]
    masks = []
    for v in range(1, vectors):
        mask = sum(1 << i for i in range(bits) if bin(int(given[i]) & v).count("1") % 2)
        masks.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    return tuple(masks)


def linked(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(members, roots): each fingerprint of a bucket that is connected to a smaller one, and the smallest such."""
    rest = np.sort(prints)
    members, roots = [], []
    while len(rest):
        root, front, rest = rest[0], [rest[0]], rest[1:]
        while front and len(rest):
            near = np.bitwise_count((rest ^ front.pop()).view(np.uint64)) <= radius
            if near.any():
                found = rest[near]
                members.append(found)
                roots.append(np.full(len(found), root))
                front.extend(found)
                rest = rest[~near]
    if not members:
        return prints[:0], prints[:0]
    return np.concatenate(members), np.concatenate(roots)


def _bucket_links(masks: tuple[int, ...], radius: int):
    masked = np.array(masks, dtype=np.int64)

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def of(frame: pd.DataFrame, ends: bool) -> tuple[pd.DataFrame, pd.DataFrame | None]:
            table, prints = frame["table"].to_numpy(), frame["fingerprint"].to_numpy()
            block = frame["block"].to_numpy()
            key = prints & masked[table]
            new = np.flatnonzero((np.diff(table) != 0) | (np.diff(key) != 0) | (np.diff(block) != 0)) + 1
            bounds = np.concatenate([[0], new, [len(frame)]])
            kept = None
            if not ends:  # the last bucket may go on in the next batch
                kept, bounds = frame.iloc[bounds[-2] :], bounds[:-1]
            sizes = np.diff(bounds)
            pairs = bounds[:-1][sizes == 2]
            left, right = prints[pairs], prints[pairs + 1]
            near = np.bitwise_count((left ^ right).view(np.uint64)) <= radius
            found = [(np.maximum(left, right)[near], np.minimum(left, right)[near])]
            found += [linked(prints[bounds[i] : bounds[i + 1]], radius) for i in np.flatnonzero(sizes > 2)]
            return pd.DataFrame({"left": np.concatenate([f[0] for f in found]), "right": np.concatenate([f[1] for f in found])}), kept

        for batch in batches:
            whole = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if len(whole):
                out, held = of(whole, ends=False)
                yield out
        if held is not None and len(held):
            yield of(held.reset_index(drop=True), ends=True)[0]

    return links


def links(prints: DataFrame, radius: int = RADIUS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(left, right): enough links between the distinct fingerprints to connect all within the radius."""
    masks = covering_masks(radius)
    table_masks = F.array(*[F.lit(mask).cast("bigint") for mask in masks])
    tables = F.sequence(F.lit(0), F.lit(len(masks) - 1))
    keys = prints.select("fingerprint", F.explode(tables).alias("table"))
    masked = F.col("fingerprint").bitwiseAND(F.get(table_masks, F.col("table")))
    keys = keys.withColumn("masked", masked)
    crowded = keys.groupBy("table", "masked").count().where(F.col("count") > max_bucket)
    crowded = crowded.select("table", "masked", F.ceil(F.col("count") / max_bucket).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int")
    low, high = F.least("own", "other"), F.greatest("own", "other")
    spread = (
        keys.join(crowded, ["table", "masked"], "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("table", "masked", "fingerprint", (low * F.col("blocks") + high).alias("block"))
    )
    by = ["table", "masked", "block"]
    dealt = spread.repartition(*by).sortWithinPartitions(*by).select("table", "fingerprint", "block")
    return dealt.mapInPandas(_bucket_links(masks, radius), "left bigint, right bigint")


def near_duplicates(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    max_bucket: int = MAX_BUCKET,
) -> DataFrame:
    """(doc_id, key, fingerprint, component_id, root): one row per document.

    ``component_id`` is the smallest id that can be reached over fingerprints at most ``radius`` bits apart,
    ``root`` the component's smallest fingerprint.
    """
    rows = written(fingerprints(documents, doc_id, text, shingle))
    prints = written(rows.groupBy("fingerprint").agg(F.min("id").alias("first_id")))
    joined = components(links(prints, radius, max_bucket))
    ids = prints.join(joined.select(F.col("node").alias("fingerprint"), "root"), "fingerprint", "left")
    ids = written(ids.select("fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root")))
    smallest = ids.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_print = ids.join(smallest, "root").select("fingerprint", "component_id", "root")
    return rows.join(of_print, "fingerprint").select(
        F.col("id").alias("doc_id"), "key", "fingerprint", "component_id", "root"
    )


def keep_one(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each component, the one with its smallest id; of equal ids the smallest key, of equal rows one."""

    def row_keys(id: Column, key: Column) -> list[Column]:
        return [F.xxhash64(id, key).alias(names[0]), F.xxhash64(key, F.lit(1), id).alias(names[1])]

    names = [unused(documents, "_row_1"), unused(documents, "_row_2")]
    found = near_duplicates(documents, doc_id, text, **options)
    # A component's row without an id is chosen only if none has one.
    chosen = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("chosen"))
    chosen = chosen.select(*row_keys(F.col("chosen.doc_id"), F.col("chosen.key")))
    keyed = documents.select("*", *row_keys(F.col(doc_id), text_key(F.col(text))))
    # Both steps go by the same keys, so the documents move once.
    return keyed.join(chosen, names, "left_semi").dropDuplicates(names).drop(*names)
