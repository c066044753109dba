"""Best-fit packing: bin completion over piece lengths, and every piece's place in its sequence.

Documents are tokenised where they lie; a document longer than ``capacity`` is cut into pieces. Packing knows pieces by
length only: their counts are a table of at most ``capacity`` rows, whatever the size of the corpus, and the driver
solves that. Bin completion takes the longest piece left, enumerates the fillings of its sequence that no other filling
dominates (no piece left out can take the place of some of the filling's pieces and still fit), uses each as often as
the counts allow or less, and drops branches whose waste or lower bound cannot beat the incumbent. The incumbent is a
best-fit-decreasing packing of all pieces, and each branch is completed by best fit too. The search ends at the lower
bound or after ``nodes`` branches; then the incumbent stands, which is best fit or better.

The answer is a list of fillings with the number of sequences of each. Pieces of one length are numbered by their place
in the written table, counted in blocks first, and numbers are looked up among the fillings; nothing meets by length
in one task, also if a third of all pieces have one length.

Tokens: a tokenizer that drops white space, lowers capitals and parts letters from punctuation reads a text word by word
(``words=True``), so each task encodes a distinct word once. ``words=False`` encodes whole texts, for all other
tokenizers. Texts that name a special token are always encoded whole.

Defined results: a null text is an empty one, an empty text is its end token; equal rows are pieces of their own; other
columns are left out; names of the documents' columns may be any; an empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wordloom.llm.expressions import column, written

CAPACITY = 4096
END = 1
#: Branches of the search, fillings tried in each, and steps spent on finding them.
NODES = 60
FILLINGS = 8
FILLING_STEPS = 300
#: Rows of a file that are numbered together.
BLOCK_ROWS = 1 << 16
#: Distinct words whose ids a task remembers.
REMEMBERED = 1_000_000
BATCH_BYTES = 1 << 22

Filling = tuple[tuple[int, int], ...]  # (length, copies), longest first


# --- tokens -----------------------------------------------------------------------------------

# ASCII punctuation but the apostrophe, which begins tokens like 's.
_PUNCTUATION = r"!-&(-/:-@\[-`{-~"


class _Words:
    """A tokenizer and the ids of the words it has met, all in one array."""

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks of an executor keep its cores busy
        self.tokenizer = Tokenizer.from_str(model)
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.begins, self.flat = [0], array("I")

    def numbers(self, words: list[str]) -> np.ndarray:
        """The number of each word; new ones are encoded."""
        new = [word for word in words if word not in self.number]
        if len(self.number) + len(new) > REMEMBERED:
            self.clear()
            new = words
        for word, encoded in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            self.number[word] = len(self.number)
            self.flat.extend(encoded.ids)
            self.begins.append(len(self.flat))
        return np.fromiter((self.number[word] for word in words), np.int64, len(words))


_loaded: dict[int, _Words] = {}


def _load(model: str) -> _Words:
    """The words of this Python worker."""
    key = zlib.crc32(model.encode())
    if key not in _loaded:
        _loaded[key] = _Words(model)
    return _loaded[key]


def _ids_by_word(texts: pa.Array, known: _Words) -> list[np.ndarray]:
    """Token ids of each text, from the ids of its distinct words.

    ASCII capitals are lowered and ASCII letters cut off from punctuation first, as the tokenizer does itself, so that
    there are fewer distinct words.
    """
    lowered = pc.ascii_lower(texts)
    cut = pc.replace_substring_regex(lowered, f"([a-z])([{_PUNCTUATION}])", r"\1 \2")
    cut = pc.replace_substring_regex(cut, f"([{_PUNCTUATION}])([a-z])", r"\1 \2")
    split = pc.ascii_split_whitespace(cut)
    encoded = split.flatten().dictionary_encode()
    numbers = known.numbers(encoded.dictionary.to_pylist())
    places = numbers[encoded.indices.to_numpy()] if len(encoded) else np.zeros(0, np.int64)
    begins, flat = np.array(known.begins, np.int64), np.array(known.flat, np.uint32)
    sizes = begins[places + 1] - begins[places]
    ends = np.cumsum(sizes)
    tokens = flat[np.repeat(begins[places] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
    cuts = np.concatenate([[0], ends])[np.cumsum(pc.list_value_length(split).to_numpy())]
    return np.split(tokens, cuts[:-1])


def token_ids(texts: pa.Array, model: str, words: bool = True) -> list[np.ndarray]:
    """Token ids of each text without special tokens of the tokenizer's own."""
    known = _load(model)
    if not len(texts):
        return []
    whole = np.ones(len(texts), bool)
    found: list = [None] * len(texts)
    if words:
        whole[:] = False
        for name in known.special:
            whole |= pc.match_substring(texts, name).to_numpy(zero_copy_only=False)
        found = _ids_by_word(pc.if_else(pa.array(whole), "", texts), known)
    for i in np.flatnonzero(whole).tolist():
        found[i] = np.array(known.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
    return found


def _groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches of texts with about ``BATCH_BYTES`` bytes."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy())
    begin = 0
    while begin < len(texts):
        stop = int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + BATCH_BYTES)) + 1
        yield begin, min(stop, len(texts))
        begin = stop


def tokenized(
    documents: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end: int = END,
    words: bool = True,
    keep_ids: bool = False,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the pieces of each document.

    ``tokenizer`` is the path of a tokenizer file, read by the driver. ``keep_ids`` adds the token ids, which
    ``sequences`` needs.
    """
    model = Tokenizer.from_file(tokenizer).to_str()
    narrow = documents.select(column(doc_id).alias("doc_id"), F.coalesce(column(text), F.lit("")).alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for begin, stop in _groups(texts):
                rows, pieces, starts, lengths, checks, kept = [], [], [], [], [], []
                for i, ids in enumerate(token_ids(texts.slice(begin, stop - begin), model, words), begin):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    for start in range(0, len(ids), capacity):
                        piece = ids[start : start + capacity]
                        rows.append(i)
                        pieces.append(start // capacity)
                        starts.append(start)
                        lengths.append(len(piece))
                        checks.append(zlib.crc32(piece.tobytes()))
                        if keep_ids:
                            kept.append(piece.astype(np.int32))
                columns = {
                    "doc_id": batch.column("doc_id").take(pa.array(rows, pa.int64())),
                    "piece": pa.array(pieces, pa.int32()),
                    "start": pa.array(starts, pa.int64()),
                    "length": pa.array(lengths, pa.int64()),
                    "ids_crc32": pa.array(checks, pa.int64()),
                }
                if keep_ids:
                    columns["ids"] = pa.array(kept, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    return narrow.mapInArrow(cut, schema)


# --- bin completion ---------------------------------------------------------------------------


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences: by the sum, and by the pieces that cannot share one."""
    if not counts:
        return 0
    lengths = np.array(sorted(counts), np.int64)
    number = np.array([counts[length] for length in lengths.tolist()], np.int64)
    numbers = np.concatenate([[0], np.cumsum(number)])
    sums = np.concatenate([[0], np.cumsum(lengths * number)])
    best = -(-int(sums[-1]) // capacity)
    half = int(np.searchsorted(lengths, capacity // 2, "right"))
    for low in range(half + 1):  # pieces below lengths[low] are left out
        least = int(lengths[low]) if low < half else capacity // 2 + 1
        alone = int(np.searchsorted(lengths, capacity - least, "right"))  # with these no such piece fits
        alone = max(alone, half)
        large = int(numbers[-1] - numbers[half])
        room = int(numbers[alone] - numbers[half]) * capacity - int(sums[alone] - sums[half])
        best = max(best, large + max(0, -(-(int(sums[half] - sums[min(low, half)]) - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, Filling]]:
    """Best fit decreasing of counted lengths: (sequences, filling). Sequences filled alike go on together."""
    done: list[tuple[int, Filling]] = []
    rooms: list[int] = []
    held: dict[int, list[tuple[int, Filling]]] = {}

    def keep(times: int, filling: Filling, room: int) -> None:
        if not room:
            done.append((times, filling))
            return
        if room not in held:
            held[room] = []
            insort(rooms, room)
        held[room].append((times, filling))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                times, filling = held[room].pop()
                if not held[room]:
                    del held[room]
                    rooms.pop(at)
            else:
                room, times, filling = capacity, left, ()
            copies = room // length
            full = min(times, left // copies)
            if full:
                keep(full, (*filling, (length, copies)), room - copies * length)
                left -= full * copies
                times -= full
            if times and left and left < copies:
                keep(1, (*filling, (length, left)), room - left * length)
                times -= 1
                left = 0
            if times and filling:
                keep(times, filling, room)
    return done + [entry for entries in held.values() for entry in entries]


def _spread(bits: int, most: int) -> int:
    """Every set bit also at the next ``most`` places."""
    have = 0
    while have < most:
        step = min(have + 1, most - have)
        bits |= bits << step
        have += step
    return bits


def is_dominated(filling: Filling, slack: int, counts: dict[int, int], present: int) -> bool:
    """Whether a piece left out can take the place of some pieces of the filling (or of none) and still fit.

    ``present`` has a bit for every length with pieces.
    """
    out = present
    for length, copies in filling:
        if counts[length] == copies:
            out &= ~(1 << length)
    if out & (_spread(1, slack) & ~1):
        return True
    single = some = several = 0
    for length, copies in filling:
        single |= 1 << length
        for _ in range(copies):
            several |= (several << length) | (some << length)
            some |= (some << length) | (1 << length)
    larger = _spread(single << 1, slack - 1) if slack else 0
    return bool(out & larger or out & _spread(several, slack))


def fillings(counts: dict[int, int], room: int, steps: int = FILLING_STEPS) -> Iterator[tuple[int, Filling]]:
    """(waste, filling): undominated fillings of a room, long pieces first; ends after ``steps`` steps."""
    lengths = sorted((length for length, number in counts.items() if number and length <= room), reverse=True)
    present = sum(1 << length for length in lengths)
    taken: list[tuple[int, int]] = []
    spent = 0

    def extend(at: int, left: int) -> Iterator[tuple[int, Filling]]:
        nonlocal spent
        spent += 1
        if not is_dominated(tuple(taken), left, counts, present):
            yield left, tuple(taken)
        for i in range(at, len(lengths)):
            if lengths[i] > left:
                continue
            for copies in range(min(counts[lengths[i]], left // lengths[i]), 0, -1):
                if spent >= steps:
                    return
                taken.append((lengths[i], copies))
                yield from extend(i + 1, left - copies * lengths[i])
                taken.pop()

    yield from extend(0, room)


def complete(
    counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES, most: int = FILLINGS, steps: int = FILLING_STEPS
) -> list[tuple[int, Filling]]:
    """Bin completion: (sequences, filling) with as few sequences as the search finds."""
    counts = {length: number for length, number in counts.items() if number}
    best = best_fit(counts, capacity)
    size, bound = sum(times for times, _ in best), lower_bound(counts, capacity)
    tokens = sum(length * number for length, number in counts.items())
    visited = 0

    def branch(left: dict[int, int], used: list[tuple[int, Filling]], number: int, waste: int) -> None:
        nonlocal best, size, visited
        if size <= bound or visited >= nodes:
            return
        visited += 1
        rest = best_fit(left, capacity)
        if number + sum(times for times, _ in rest) < size:
            best, size = used + rest, number + sum(times for times, _ in rest)
        if not left or number + lower_bound(left, capacity) >= size:
            return
        longest = max(left)
        others = dict(left)
        others[longest] -= 1
        found = islice(fillings(others, capacity - longest, steps), most)
        for lost, filling in sorted(found):
            whole: dict[int, int] = {longest: 1}
            for length, copies in filling:
                whole[length] = whole.get(length, 0) + copies
            times = min(left[length] // copies for length, copies in whole.items())
            while times:
                if size <= bound or visited >= nodes:
                    return
                allowed = (size - 1) * capacity - tokens
                if waste + lost * times <= allowed:
                    after = {length: n - times * whole.get(length, 0) for length, n in left.items()}
                    entry = (times, tuple(sorted(whole.items(), reverse=True)))
                    branch({length: n for length, n in after.items() if n}, used + [entry], number + times, waste + lost * times)
                times //= 2

    if size > bound:
        branch(counts, [], 0, 0)
    return best


# --- places -----------------------------------------------------------------------------------


def _lookup(solution: list[tuple[int, Filling]]) -> tuple[np.ndarray, ...]:
    """Stretches of (length, number) in order: key, first number, copies in a sequence, first sequence, offset."""
    entries, given, sequence = [], {}, 0
    for times, filling in solution:
        offset = 0
        for length, copies in filling:
            first = given.get(length, 0)
            entries.append((length, first, copies, sequence, offset))
            given[length] = first + times * copies
            offset += length * copies
        sequence += times
    entries.sort()
    return tuple(np.array([entry[i] for entry in entries], np.int64) for i in range(5))


def pack(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``; ``pieces`` are written first, as their places number them.

    Sequences are numbered from 0 without gaps; offsets in a sequence leave no gaps.
    """
    stored = written(pieces)
    counted = stored.groupBy("length").count().collect()  # at most ``capacity`` rows
    solution = complete({row["length"]: row["count"] for row in counted}, capacity, nodes)
    lengths, firsts, copies, sequences, offsets = _lookup(solution)
    placed = stored.select(
        "*",
        F.col("_metadata.file_name").alias("_file"),
        F.col("_metadata.row_index").alias("_row"),
        F.floor(F.col("_metadata.row_index") / F.lit(BLOCK_ROWS)).alias("_block"),
    )
    before = Window.partitionBy("length").orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = placed.groupBy("length", "_file", "_block").count()
    blocks = blocks.select("length", "_file", "_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("length", "_file", "_block").orderBy("_row"))
    numbered = (
        placed.withColumn("_inside", inside)
        .join(blocks, ["length", "_file", "_block"])
        .select(*stored.columns, (F.col("_before") + F.col("_inside") - 1).alias("_number"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = lengths << np.int64(40)
        keys = starts + firsts
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            number = batch.column("_number").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, (length << np.int64(40)) + number, "right") - 1
            nth = number - firsts[at]
            names = [name for name in batch.schema.names if name != "_number"]
            columns = {name: batch.column(name) for name in names}
            columns["sequence_id"] = pa.array(sequences[at] + nth // copies[at])
            columns["offset"] = pa.array(offsets[at] + nth % copies[at] * length)
            yield pa.RecordBatch.from_pydict(columns)

    fields = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in stored.schema)
    return numbered.mapInArrow(place, f"{fields}, sequence_id bigint, offset bigint")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token ids of each sequence, of pieces with ``ids``."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(inside, lambda piece: piece["ids"])).alias("ids"))
