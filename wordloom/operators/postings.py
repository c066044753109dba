"""Words and positional postings of a text table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions.hashing import check_bins, check_digest, hex_digests
from wordloom.functions.text import word_arrays
from wordloom.operators.blocks import PACKED, block_columns

Stopwords = DataFrame | Iterable[str] | None

POSTINGS = "bin int, hash string, text_id bigint, positions array<int>, total_words int"
# Words of neighbouring texts that are grouped at a time, and postings in a batch that goes back. Every stretch states
# the hashes of its words, so a long one makes few blocks; it takes some 60 bytes a word.
STRETCH_WORDS = 1 << 22
OUTPUT_ROWS = 1 << 16
# Postings that are put into blocks at a time.
PACKED_ROWS = 1 << 18


def tokenize(texts: DataFrame, stopwords: Stopwords = None, normalize_stopwords: bool = False) -> DataFrame:
    """(text_id, position, word): one row per kept word, positions from 0 over the kept words."""
    # The outer form keeps the optimizer from testing the word array before it builds it.
    return (
        word_arrays(texts, "text_id", "text", stopwords, normalize_stopwords)
        .select("text_id", F.posexplode_outer("_words").alias("position", "word"))
        .where(F.col("word").isNotNull())
    )


def _grouped(bins: int, digest: str, packed: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (text_id, _words) as postings, or as blocks of them: a word of a stretch is a number and hashed once."""

    def stretches(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
        """Neighbouring texts with ``STRETCH_WORDS`` words or so; a longer text stands alone."""
        ends, start = np.cumsum(lengths), 0
        while start < len(lengths):
            before = ends[start - 1] if start else 0
            stop = max(int(np.searchsorted(ends, before + STRETCH_WORDS, "right")), start + 1)
            yield start, stop
            start = stop

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A null text has no words.
            all_lengths = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for start, stop in stretches(all_lengths):
                lengths, ids = all_lengths[start:stop], batch.column(0).slice(start, stop - start)
                coded = batch.column(1).slice(start, stop - start).flatten().dictionary_encode()
                if not len(coded):
                    continue
                codes = coded.indices.to_numpy(zero_copy_only=False)
                text = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
                position = (np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
                hashes = hex_digests(coded.dictionary.cast(pa.binary()).to_pylist(), digest)
                places = np.array([int(value, 16) % bins + 1 for value in hashes], np.int32)
                # In the order of the index: what comes sorted is soon sorted when it is appended.
                rank = np.empty(len(hashes), np.int64)
                rank[sorted(range(len(hashes)), key=lambda i: (places[i], hashes[i]))] = np.arange(len(hashes))
                turn = np.empty(len(lengths), np.int64)
                turn[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(lengths))
                key = rank[codes] * len(lengths) + turn[text]
                order = np.argsort(key, kind="stable")
                firsts = np.flatnonzero(np.diff(key[order], prepend=-1))
                word, held = codes[order[firsts]], text[order[firsts]]
                if packed:
                    raw = pa.array([bytes.fromhex(value) for value in hashes], pa.binary())
                    ends = np.append(firsts, len(codes))
                    position = position[order]
                    for row in range(0, len(word), PACKED_ROWS):
                        some, texts = word[row : row + PACKED_ROWS], held[row : row + PACKED_ROWS]
                        bounds = ends[row : row + PACKED_ROWS + 1]
                        spots = position[bounds[0] : bounds[-1]]
                        new = np.diff(some, prepend=-1) != 0
                        starts, columns = block_columns(ids.take(pa.array(texts)), lengths[texts], np.diff(bounds), spots, new)
                        columns = [pa.array(places[some[starts]]), raw.take(pa.array(some[starts])), *columns]
                        yield pa.RecordBatch.from_arrays(columns, [field.split()[0] for field in PACKED.split(", ")])
                    continue
                positions = pa.ListArray.from_arrays(
                    pa.array(np.append(firsts, len(codes)), pa.int32()), pa.array(position[order], pa.int32())
                )
                columns = [
                    pa.array(places[word]),
                    pa.array(hashes, pa.string()).take(pa.array(word)),
                    ids.take(pa.array(held)),
                    positions,
                    pa.array(lengths[held], pa.int32()),
                ]
                grouped = pa.RecordBatch.from_arrays(columns, ["bin", "hash", "text_id", "positions", "total_words"])
                for row in range(0, grouped.num_rows, OUTPUT_ROWS):
                    yield grouped.slice(row, OUTPUT_ROWS)

    return group


def postings(
    texts: DataFrame,
    bins: int,
    stopwords: Stopwords = None,
    normalize_stopwords: bool = False,
    digest: str = "sha256",
) -> DataFrame:
    """(bin, hash, text_id, positions, total_words): one row per text and word.

    Texts are split in the JVM. Their words are grouped where the text lies, so nothing is shuffled, and go through Arrow
    as numbers: a distinct word of some ``STRETCH_WORDS`` neighbours is hashed and given its bin once, whatever the digest.
    """
    return _split(texts, stopwords, normalize_stopwords).mapInArrow(_checked(bins, digest), POSTINGS)


def posting_blocks(
    texts: DataFrame,
    bins: int,
    stopwords: Stopwords = None,
    normalize_stopwords: bool = False,
    digest: str = "sha256",
) -> DataFrame:
    """``postings`` in blocks, as they are staged: see ``wordloom.operators.blocks``."""
    return _split(texts, stopwords, normalize_stopwords).mapInArrow(_checked(bins, digest, True), PACKED)


def _split(texts: DataFrame, stopwords: Stopwords, normalize_stopwords: bool) -> DataFrame:
    keyed = texts.select(F.col("text_id").cast("bigint").alias("text_id"), "text")
    return word_arrays(keyed, "text_id", "text", stopwords, normalize_stopwords)


def _checked(bins: int, digest: str, packed: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    check_digest(digest)
    check_bins(bins)
    return _grouped(bins, digest, packed)


def vocabulary(postings: DataFrame) -> DataFrame:
    """(bin, hash, texts, occurrences): distinct words with their counts."""
    return postings.groupBy("bin", "hash").agg(
        F.count(F.lit(1)).alias("texts"),
        F.sum(F.size("positions").cast("bigint")).alias("occurrences"),
    )


def touched_hashes(postings: DataFrame, *of: str) -> DataFrame:
    """(bin, hash, of...): the words that batches have touched, once per value of the columns ``of``."""
    return postings.select("bin", "hash", *of).distinct()
