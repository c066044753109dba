"""Postings in blocks, as they are staged and shuffled: some postings of one word in one row.

A posting as a row of its own repeats its hash and pays for the row, which is several times what it says. A block holds
up to ``BLOCK_POSTINGS`` postings of one word and batch by ascending text id: the gaps between the ids, the total words,
the numbers of positions and the gaps between these, each as an integer of as many bytes as it needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Postings of a block at most. A block is not divided between files, so it is short beside them.
BLOCK_POSTINGS = 64
#: Postings in a batch that goes back.
OUTPUT_ROWS = 1 << 16

#: ``text_id`` is the first one; null ids stand in blocks of their own.
PACKED = "bin int, hash binary, text_id bigint, held int, packed binary"
UNPACKED = "bin int, hash binary, text_id bigint, positions array<int>, total_words int, batch_id string"
_FIRST = np.iinfo(np.int64).min


def _write_numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned numbers as bytes, seven bits each, the last byte below 128; and where each ends."""
    size = np.ones(len(values), np.int64)
    for bits in range(7, 64, 7):
        longer = values >= np.uint64(1 << bits)
        if not longer.any():
            break
        size += longer
    ends = np.cumsum(size)
    data = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    at, to, left, size = np.arange(len(values)), ends - size, values, size
    while len(at):
        more = size > 1
        data[to] = (left & np.uint64(127)).astype(np.uint8) | (more.astype(np.uint8) << 7)
        at, to, left, size = at[more], to[more] + 1, left[more] >> np.uint64(7), size[more] - 1
    return data, ends


def _read_numbers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of ``_write_numbers``, and where each ends."""
    ends = np.flatnonzero(data < 128) + 1
    starts = np.append(0, ends[:-1])
    values = np.zeros(len(ends), np.uint64)
    at, shift = np.arange(len(ends)), 0
    while len(at):
        values[at] |= (data[starts[at] + shift // 7] & np.uint8(127)).astype(np.uint64) << np.uint64(shift)
        shift += 7
        at = at[ends[at] - starts[at] > shift // 7]
    return values, ends


def _within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... within each group of the given lengths."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _gaps(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Differences to the value before, the first of each group as it is; all modulo 2**64."""
    values = values.astype(np.int64).view(np.uint64)
    gaps = np.diff(values, prepend=np.uint64(0))
    gaps[firsts] = values[firsts]
    return gaps


def _sums(gaps: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The values of ``_gaps``, for groups of the given lengths, none of them empty."""
    sums = np.cumsum(gaps, dtype=np.uint64)
    before = np.append(np.uint64(0), sums)[np.cumsum(lengths) - lengths]
    return (sums - np.repeat(before, lengths)).view(np.int64)


def block_columns(
    ids: pa.Array, total_words: np.ndarray, counts: np.ndarray, positions: np.ndarray, new: np.ndarray
) -> tuple[np.ndarray, list[pa.Array]]:
    """The first posting of each block, and ``text_id``, ``held`` and ``packed`` of the blocks.

    ``new`` marks postings of another word or batch than the one before; ``positions`` stand together, ``counts`` of them
    for each posting.
    """
    missing = ids.is_null().to_numpy(zero_copy_only=False)
    values = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    new = new.copy()
    new[:1] = True
    new[1:] |= (missing[1:] != missing[:-1]) | (values[1:] < values[:-1])
    runs = np.flatnonzero(new)
    new |= _within(np.diff(np.append(runs, len(new)))) % BLOCK_POSTINGS == 0
    firsts = np.flatnonzero(new)
    held = np.diff(np.append(firsts, len(new)))
    gaps = _gaps(values, firsts)
    gaps[firsts] = 0  # stands beside the block
    ends = np.cumsum(counts)
    spots = np.add.reduceat(counts, firsts) if len(firsts) else counts
    lengths = 3 * held + spots
    starts = np.cumsum(lengths) - lengths
    numbers = np.empty(lengths.sum(), np.uint64)
    place = np.repeat(starts, held) + _within(held)
    step = np.repeat(held, held)
    numbers[place], numbers[place + step], numbers[place + 2 * step] = gaps, _unsigned(total_words), _unsigned(counts)
    numbers[np.repeat(starts + 3 * held, spots) + _within(spots)] = _gaps(positions, (ends - counts)[counts > 0])
    data, number_ends = _write_numbers(numbers)
    offsets = np.append(0, number_ends[starts + lengths - 1]).astype(np.int32)
    packed = pa.BinaryArray.from_buffers(pa.binary(), len(firsts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
    return firsts, [ids.take(pa.array(firsts)), pa.array(held, pa.int32()), packed]


def _unsigned(values: np.ndarray) -> np.ndarray:
    return values.astype(np.int64).view(np.uint64)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        place, hashes, batch_id, ids, total, positions = (batch.column(i) for i in range(6))

        def differs(column: pa.Array) -> np.ndarray:
            codes = pc.fill_null(column.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
            return np.diff(codes, prepend=codes[0]) != 0

        counts = pc.list_value_length(positions).to_numpy(zero_copy_only=False).astype(np.int64)
        spots = positions.flatten().to_numpy(zero_copy_only=False)
        new = differs(place) | differs(hashes) | differs(batch_id)
        firsts, columns = block_columns(ids, total.to_numpy(zero_copy_only=False), counts, spots, new)
        of_block = [column.take(pa.array(firsts)) for column in (place, hashes, batch_id)]
        yield pa.RecordBatch.from_arrays([*of_block[:2], *columns, of_block[2]], [*(f.split()[0] for f in PACKED.split(", ")), "batch_id"])


def pack(postings: DataFrame) -> DataFrame:
    """Postings with ``batch_id`` as blocks; what comes sorted gives few. The hash is binary."""
    narrow = postings.select("bin", "hash", "batch_id", "text_id", "total_words", "positions")
    return narrow.mapInArrow(_pack, PACKED + ", batch_id string")


def _opened(blocks: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
    """The postings of some blocks and the block of each."""
    place, hashes, ids, held, packed, batch_id = (blocks.column(i) for i in range(6))
    held = held.to_numpy(zero_copy_only=False).astype(np.int64)
    numbers, ends = _read_numbers(np.frombuffer(b"".join(packed.to_pylist()), np.uint8))
    stops = np.searchsorted(ends, np.cumsum(pc.binary_length(packed).to_numpy(zero_copy_only=False)), "right")
    starts = np.append(0, stops[:-1])
    block, step = np.repeat(np.arange(len(held)), held), np.repeat(held, held)
    place_of = np.repeat(starts, held) + _within(held)
    counts = numbers[place_of + 2 * step].view(np.int64)
    spots = stops - starts - 3 * held
    gaps = numbers[np.repeat(starts + 3 * held, spots) + _within(spots)]
    some = counts[counts > 0]
    first = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    text_ids = first[block] + _sums(numbers[place_of], held)
    missing = ids.is_null().to_numpy(zero_copy_only=False)[block]
    of_block = pa.array(block)
    columns = [
        place.take(of_block),
        hashes.take(of_block),
        pa.array(text_ids, pa.int64(), mask=missing),
        pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(_sums(gaps, some).astype(np.int32))),
        pa.array(numbers[place_of + step].view(np.int64).astype(np.int32)),
        batch_id.take(of_block),
    ]
    return pa.RecordBatch.from_arrays(columns, ["bin", "hash", "text_id", "positions", "total_words", "batch_id"]), block


def _slices(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for row in range(0, rows.num_rows, OUTPUT_ROWS):
        yield rows.slice(row, OUTPUT_ROWS)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield from _slices(_opened(batch)[0])


def _unpack_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings by bin, hash and text id, from blocks in that order.

    Blocks of a word may overlap: postings from the first id of the last block on are kept until the next blocks are there.
    """

    def keys(ids: pa.Array) -> np.ndarray:
        return pc.fill_null(ids, _FIRST).to_numpy(zero_copy_only=False)

    kept = None
    for batch in batches:
        if not batch.num_rows:
            continue
        hashes = batch.column(1)
        changes = np.flatnonzero(pc.not_equal(hashes[1:], hashes[:-1]).to_numpy(zero_copy_only=False)) + 1
        rows, block = _opened(batch)
        word = np.searchsorted(changes, block, "right")
        if kept is not None and kept.num_rows and kept.column(1)[0] != hashes[0]:
            yield from _slices(kept)
            kept = None
        if kept is not None:
            rows = pa.Table.from_batches([kept, rows]).combine_chunks().to_batches()[0]
            word = np.append(np.zeros(kept.num_rows, word.dtype), word)
        ids = keys(rows.column(2))
        order = np.lexsort((ids, word))
        open_from = keys(batch.column(2)[-1:])[0]
        done = np.count_nonzero((word < len(changes)) | (ids < open_from))
        yield from _slices(rows.take(pa.array(order[:done])))
        kept = rows.take(pa.array(order[done:]))
    if kept is not None:
        yield from _slices(kept)


def unpack(blocks: DataFrame, is_sorted: bool = False) -> DataFrame:
    """The postings of blocks, with binary hashes; sorted if the blocks of each task are, by bin, hash and text id."""
    columns = [field.split()[0] for field in PACKED.split(", ")]
    return blocks.select(*columns, "batch_id").mapInArrow(_unpack_sorted if is_sorted else _unpack, UNPACKED)
