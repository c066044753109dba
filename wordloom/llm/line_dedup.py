"""Fuzzy line dedup: MinHash signatures of lines, banding, exact Jaccard checks and distributed union-find.

Equal lines meet once, as one hashed line. Each line's character shingles give ``SKETCH_BITS`` minima; lines with equal
minima in one of ``BANDS`` bands of ``ROWS`` share a bucket. The lowest bits of all minima are a sketch that travels
along: a bucket falls into groups that are connected by sketches at most ``MAX_SKETCH_BITS`` bits apart, and lines alone
go no further. Equal groups of several bands are one. Only lines that went on fetch their text, once for the small
groups that share their smallest line: these meet in one task. Many groups are compared at a time: the lines of a group
until they are connected, maps of shingles first, which rule out most pairs, then the shingles of the others, so a
group sends at most one link per line. The rows of a bucket above ``MAX_BUCKET`` pass through its task
without being held; they are counted, cut into blocks by a join, and every two blocks meet in a group of their own. Components come from ``components``, and of each the first line stays, by document
id, text and line number.

With 12 bands of 4 rows, two lines with a Jaccard similarity of 0.8 share a bucket with a chance of 0.998; they differ
in 6 of the 60 sketch bits that are not equal anyway, give or take 2.3, so 17 bits lose about one pair in a million.

Defined results: lines without any word are left as they are and take no part; null and empty texts have no lines;
lines shorter than a shingle are one shingle; equal rows are one document given twice and lose the same lines; null ids
come first in the order of documents; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.components import components
from wordloom.llm.expressions import SPACED_WORD, column, text_key, unused, written

SHINGLE = 5
BANDS = 12
ROWS = 4
SKETCH_BITS = 64
MAX_SKETCH_BITS = 17
SIMILARITY = 0.8
MAX_BUCKET = 1000
#: Exact comparisons for each line that are made one by one.
ONE_BY_ONE = 5
#: Bits of a line's map of shingles.
MAP_BITS = 1 << 12
#: Characters of the lines that are compared at a time, and those that a short line counts as, for its map.
TOGETHER_CHARACTERS = 1 << 17
LEAST_CHARACTERS = 64
#: Characters that are hashed together, and lines whose hashes a task remembers to skip repeats.
CHARACTERS = 1 << 18
REMEMBERED = 1 << 20


def lines_of(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, key, line_no, line, line_id) of the lines with a word; ``line`` is trimmed and in lower case."""
    opened = documents.select(
        F.col(doc_id).alias("id"),
        text_key(F.col(text)).alias("key"),
        F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("line_no", "raw"),
    )
    line = F.lower(F.trim("raw"))
    return opened.where(F.col("raw").rlike(SPACED_WORD)).select(
        "id", "key", "line_no", line.alias("line"), F.xxhash64(line).alias("line_id")
    )


def shingles(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def band_keys(lines: list[str], bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit key for each line and band, and a sketch of 64 bits for each line."""
    draw = np.random.default_rng(1)
    minima = max(bands * rows, SKETCH_BITS)
    factors = draw.integers(1 << 20, 1 << 32, minima, dtype=np.uint32) | np.uint32(1)
    terms = draw.integers(0, 1 << 32, minima, dtype=np.uint32)
    keys = np.empty((len(lines), bands), dtype=np.int64)
    sketches = np.zeros(len(lines), dtype=np.uint64)
    begin = 0
    while begin < len(lines):
        end, size = begin, 0
        while end < len(lines) and (size == 0 or size + len(lines[end]) <= CHARACTERS):
            size += max(len(lines[end]), SHINGLE)
            end += 1
        some = [line if len(line) >= SHINGLE else line.ljust(SHINGLE, "\0") for line in lines[begin:end]]
        codes = np.frombuffer("".join(some).encode("utf-32-le", "replace"), dtype=np.uint32)
        hashed = codes[: len(codes) - SHINGLE + 1].copy()
        for i in range(1, SHINGLE):
            hashed = hashed * np.uint32(0x01000193) + codes[i : len(codes) - SHINGLE + 1 + i]
        hashed ^= hashed >> np.uint32(16)
        hashed *= np.uint32(0x85EBCA6B)
        hashed ^= hashed >> np.uint32(13)
        sizes = np.array([len(line) for line in some])
        inside = np.ones(len(hashed) + SHINGLE - 1, dtype=bool)  # no shingle crosses the end of a line
        ends = np.cumsum(sizes)
        for i in range(1, SHINGLE):
            inside[ends - i] = False
        hashed = hashed[inside[: len(hashed)]]
        starts = np.concatenate([[0], np.cumsum(sizes - (SHINGLE - 1))[:-1]])
        key = None
        for row in range(minima):
            least = np.minimum.reduceat(hashed * factors[row] + terms[row], starts)
            if row < SKETCH_BITS:
                bit = (least * np.uint32(0x9E3779B1)) >> np.uint32(31)
                sketches[begin:end] |= bit.astype(np.uint64) << np.uint64(row)
            band, place = divmod(row, rows)
            if band < bands:
                if place == 0:
                    key = np.full(len(some), 0x9E3779B97F4A7C15 * (band + 1) & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
                key = (key ^ least) * np.uint64(0xFF51AFD7ED558CCD)
                key ^= key >> np.uint64(32)
                if place == rows - 1:
                    keys[begin:end, band] = key.view(np.int64)
        begin = end
    return keys, sketches.view(np.int64)


def _signatures(bands: int, rows: int):
    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            _, first = np.unique(ids, return_index=True)
            new = [i for i in first.tolist() if int(ids[i]) not in known]
            if len(known) > REMEMBERED:
                known.clear()
            known.update(ids[new].tolist())
            keys, sketches = band_keys(batch.column(1).take(pa.array(new, pa.int64())).to_pylist(), bands, rows)
            flat = pa.array(keys.ravel())
            offsets = pa.array(np.arange(0, len(new) * bands + 1, bands, dtype=np.int32))
            columns = [pa.array(ids[new]), pa.array(sketches), pa.ListArray.from_arrays(offsets, flat)]
            yield pa.RecordBatch.from_arrays(columns, ["line_id", "sketch", "keys"])

    return signatures


def _mixed(ids: np.ndarray) -> np.ndarray:
    mixed = ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    return mixed * np.uint64(0xBF58476D1CE4E5B9)


def _sketch_groups(starts: np.ndarray, sizes: np.ndarray, sketches: np.ndarray) -> np.ndarray:
    """The number of each line's group in its bucket, -1 for lines alone. Groups are connected by like sketches."""
    group = np.full(len(sketches), -1)
    pairs = starts[sizes == 2]
    alike = pairs[np.bitwise_count((sketches[pairs] ^ sketches[pairs + 1]).view(np.uint64)) <= MAX_SKETCH_BITS]
    group[alike] = group[alike + 1] = 0
    for at in np.flatnonzero(sizes > 2):
        own = sketches[starts[at] : starts[at] + sizes[at]]
        close = np.bitwise_count((own[:, None] ^ own[None, :]).view(np.uint64)) <= MAX_SKETCH_BITS
        free, number = close.sum(axis=1) > 1, 0
        while free.any():
            front = np.zeros(len(own), dtype=bool)
            front[np.argmax(free)] = True
            inside = front
            while front.any():
                front = close[front].any(axis=0) & free & ~inside
                inside = inside | front
            group[starts[at] : starts[at] + sizes[at]][inside] = number
            free, number = free & ~inside, number + 1
    return group


def _bounds(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and size of each run of equal keys."""
    if not len(keys):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
    return starts, np.diff(np.append(starts, len(keys)))


#: The block of lines whose bucket is yet to be cut into blocks.
CROWDED = -1


def _shared(max_bucket: int, bands: int = BANDS):
    def shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(bucket, block, line_id, home) of (band_key, line_id, sketch) rows by band key; a group of a bucket is named by what it holds.

        ``home`` is the smallest line of a small group, so that a home has no more lines than a bucket, and the name of
        a larger one. Lines of a bucket above ``max_bucket`` come as ``CROWDED``; no more than such a bucket and a batch is held.
        """

        def passed(keys: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"bucket": keys, "block": np.full(len(ids), CROWDED), "line_id": ids, "home": ids})

        def of(keys: np.ndarray, ids: np.ndarray, sketches: np.ndarray) -> pd.DataFrame:
            # Most rows are alone in their bucket; the others are sorted, and repeats of a line in a bucket go.
            equal = keys[1:] == keys[:-1]
            beside = np.zeros(len(keys), dtype=bool)
            beside[1:] = equal
            beside[:-1] |= equal
            keys, ids, sketches = keys[beside], ids[beside], sketches[beside]
            order = np.lexsort((ids, keys))
            keys, ids, sketches = keys[order], ids[order], sketches[order]
            fresh = np.ones(len(keys), dtype=bool)
            fresh[1:] = (np.diff(keys) != 0) | (np.diff(ids) != 0)
            keys, ids, sketches = keys[fresh], ids[fresh], sketches[fresh]
            sizes = _bounds(keys)[1]
            small = np.repeat(sizes, sizes) <= max_bucket
            crowded = passed(keys[~small], ids[~small])
            keys, ids, sketches = keys[small], ids[small], sketches[small]
            group = _sketch_groups(*_bounds(keys), sketches)
            order = np.lexsort((ids, group, keys))
            order = order[group[order] >= 0]
            keys, group, ids = keys[order], group[order], ids[order]
            new = np.ones(len(keys), dtype=bool)
            new[1:] = (np.diff(keys) != 0) | (np.diff(group) != 0)
            starts, sizes = _bounds(np.cumsum(new))
            mixed = _mixed(ids)
            names = np.repeat(np.add.reduceat(mixed, starts) if len(starts) else mixed, sizes).view(np.int64)
            home = np.where(np.repeat(sizes, sizes) <= max_bucket // bands, np.repeat(ids[starts], sizes), names)
            found = {"bucket": names, "block": np.zeros(len(ids), dtype=np.int64), "line_id": ids, "home": home}
            return pd.concat([crowded, pd.DataFrame(found)])

        held = [np.zeros(0, dtype=np.int64)] * 3
        passing = None
        for batch in batches:
            new = [batch[name].to_numpy() for name in ("band_key", "line_id", "sketch")]
            if passing is not None:
                goes_on = int(np.searchsorted(new[0], passing, side="right"))
                yield passed(new[0][:goes_on], new[1][:goes_on])
                new = [column[goes_on:] for column in new]
                passing = passing if not len(new[0]) else None
            held = [np.concatenate(pair) for pair in zip(held, new)]
            if len(held[0]):  # the last bucket may go on in the next batch
                last = np.searchsorted(held[0], held[0][-1])
                if len(held[0]) - last > max_bucket:  # a line that many tasks have signed counts once
                    once = last + np.unique(held[1][last:], return_index=True)[1]
                    held = [np.append(column[:last], column[once]) for column in held]
                if len(held[0]) - last > max_bucket:
                    passing, last = held[0][-1], len(held[0])
                yield of(*(column[:last] for column in held))
                held = [column[last:] for column in held]
        yield of(*held)

    return shared


def bucket_members(keyed: DataFrame, max_bucket: int, bands: int = BANDS) -> DataFrame:
    """(bucket, block, line_id, home) of (band_key, line_id, sketch): small buckets by like sketches, larger ones in blocks.

    Small groups have their smallest line as home; larger ones, and every two blocks, have one of their own.
    """
    dealt = keyed.repartition("band_key").sortWithinPartitions("band_key")
    members = written(dealt.mapInPandas(_shared(max_bucket, bands), "bucket bigint, block bigint, line_id bigint, home bigint").distinct())
    crowded = members.where(F.col("block") == CROWDED)
    if not crowded.head(1):
        return members
    # Buckets of the same lines in several bands get one name. Others may get it too: then they are compared together.
    hashes = [F.xxhash64("line_id"), F.xxhash64("line_id", F.lit(1))]
    ends = [end(one) for one in hashes for end in (F.min, F.max)]
    counted = crowded.groupBy(F.col("bucket").alias("of_bucket")).agg(
        F.ceil(F.count(F.lit(1)) / max_bucket).cast("bigint").alias("blocks"), F.xxhash64(*ends).alias("name")
    )
    own = F.pmod(F.xxhash64("line_id"), F.col("blocks"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    inside = crowded.join(written(counted), F.col("bucket") == F.col("of_bucket")).select("name", "blocks", "line_id").distinct()
    cut = (
        inside.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        .select(F.col("name").alias("bucket"), (low * F.col("blocks") + high).alias("block"), "line_id")
        .withColumn("home", F.xxhash64("bucket", "block"))
    )
    return members.where(F.col("block") != CROWDED).unionByName(cut)


def _codes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The size of each line, ``SHINGLE`` at least, and the characters of all lines as numbers; 0 stands for no character."""
    sizes = np.array([max(len(line), SHINGLE) for line in lines])
    joined = "".join(line if len(line) >= SHINGLE else line.ljust(SHINGLE, "\0") for line in lines)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    if sizes.min() == SHINGLE:
        for line, end in zip(lines, np.cumsum(sizes).tolist()):
            if len(line) < SHINGLE:
                codes[end - SHINGLE + len(line) : end] = 0
    return sizes, codes


def _values(codes: np.ndarray) -> np.ndarray:
    """A number for each ``SHINGLE`` characters in a row; equal ones, and no others, have equal numbers.

    Five characters are one number of 60 bits, those above U+0FFE numbered first. Where the different characters are too
    many for that, stretches of three and of two characters are numbered and the two numbers are put together.
    """

    def packed(first: int, last: int, bits: int) -> np.ndarray:
        value = codes[first : len(codes) - SHINGLE + 1 + first]
        for i in range(first + 1, last):
            value = (value << np.uint64(bits)) | codes[i : len(codes) - SHINGLE + 1 + i]
        return value

    if codes.max() >= 1 << 12:
        used = np.zeros(int(codes.max()) + 1, dtype=bool)
        used[codes] = True
        if np.count_nonzero(used) > 1 << 12:
            three = np.unique(packed(0, 3, 21), return_inverse=True)[1].astype(np.uint64)
            return (three << np.uint64(32)) | np.unique(packed(3, SHINGLE, 21), return_inverse=True)[1].astype(np.uint64)
        codes = (np.cumsum(used) - 1).astype(np.uint64)[codes]
    return packed(0, SHINGLE, 12)


def _different(values: np.ndarray) -> np.ndarray:
    found = np.sort(values)
    new = np.ones(len(found), dtype=bool)
    np.not_equal(found[1:], found[:-1], out=new[1:])
    return found[new]


def shingle_values(lines: list[str]) -> list[np.ndarray]:
    """The shingles of each line as sorted different numbers; equal shingles, and no others, have equal numbers."""
    sizes, codes = _codes(lines)
    values, ends = _values(codes), np.cumsum(sizes)
    return [_different(values[begin : end - SHINGLE + 1]) for begin, end in zip((ends - sizes).tolist(), ends.tolist())]


def similar(own: np.ndarray, other: np.ndarray, similarity: float) -> bool:
    """Exact Jaccard similarity of two sets of ``shingle_values``."""
    low, high = sorted((len(own), len(other)))
    if low < similarity * high:
        return False
    together = np.sort(np.concatenate([own, other]), kind="stable")  # two sorted runs are merged
    both = int(np.count_nonzero(together[1:] == together[:-1]))
    return both >= similarity * (low + high - both)


def _likes(values: np.ndarray, counts: np.ndarray, similarity: float) -> Callable[[int, np.ndarray, np.ndarray], np.ndarray]:
    """A function of a line and others that tells which of the others are similar to it, by exact Jaccard similarity.

    ``values`` are the numbers of the shingles of all lines, repeats included, ``counts`` how many each line has; the function
    also gets how many different shingles at least are in only one line of each pair. Lines are compared one by one at
    first. Where comparisons go on, shingles are numbered once and a line meets others in one go.
    """
    begins = np.cumsum(counts) - counts
    sets: list[np.ndarray | None] = [None] * len(counts)
    numbers = held = starts = sizes = None
    compared = 0

    def different(line: int) -> np.ndarray:
        if sets[line] is None:
            sets[line] = _different(values[begins[line] : begins[line] + counts[line]])
        return sets[line]

    def one(own: int, other: int, unlike: int) -> bool:
        both = len(different(own)) + len(different(other))
        return both - unlike >= similarity * (both + unlike) and similar(sets[own], sets[other], similarity)

    def likes(own: int, others: np.ndarray, unlike: np.ndarray) -> np.ndarray:
        nonlocal numbers, held, starts, sizes, compared
        compared += len(others)
        if compared <= ONE_BY_ONE * len(sets):
            return np.array([one(own, *pair) for pair in zip(others.tolist(), unlike.tolist())], bool)
        if numbers is None:
            found = [different(line) for line in range(len(sets))]
            sizes = np.array([len(some) for some in found])
            starts = np.cumsum(sizes) - sizes
            numbers = np.unique(np.concatenate(found), return_inverse=True)[1]
            held = np.zeros(numbers.max() + 1, np.int32)
        inside = numbers[starts[own] : starts[own] + sizes[own]]
        held[inside] = 1
        firsts = np.cumsum(sizes[others]) - sizes[others]
        places = np.repeat(starts[others] - firsts, sizes[others]) + np.arange(sizes[others].sum())
        both = np.add.reduceat(held[numbers[places]], firsts)
        held[inside] = 0
        low, high = np.minimum(sizes[own], sizes[others]), np.maximum(sizes[own], sizes[others])
        return (low >= similarity * high) & (both >= similarity * (low + high - both))

    return likes


def linked(lines: dict[int, str], similarity: float) -> list[tuple[int, int]]:
    """(line, root) of each line of a bucket that is connected to a smaller one, by exact Jaccard similarity."""
    if len(lines) < 2:
        return []
    ids = sorted(lines)
    found = linked_groups(np.zeros(len(ids), np.int64), np.array(ids), [lines[line_id] for line_id in ids], similarity)
    return list(zip(*(side.tolist() for side in found)))


def linked_groups(
    group: np.ndarray, ids: np.ndarray, lines: list[str], similarity: float, at: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(line, root) of each line that is connected to one before it; lines that share a group are compared until they are.

    ``group`` holds group numbers in order and ``at`` the places of their lines, in order in each group; without ``at`` each
    line is in one group. Shingles of a line set bits of its map. Each bit that two maps differ in is a shingle that one line
    has and the other has not, so pairs with too many of them are not similar; only the others are compared exactly.
    """
    at = np.arange(len(ids)) if at is None else at
    lengths, codes = _codes(lines)
    inside = np.ones(len(codes), dtype=bool)  # no shingle crosses the end of a line
    ends = np.cumsum(lengths)
    for i in range(1, SHINGLE):
        inside[ends - i] = False
    values, counts = _values(codes)[inside[: len(codes) - SHINGLE + 1]], lengths - (SHINGLE - 1)
    maps = np.zeros(len(lines) * MAP_BITS, dtype=bool)
    bit = (values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    maps[np.repeat(np.arange(len(lines)) * MAP_BITS, counts) + (bit % np.uint64(MAP_BITS)).astype(np.int64)] = True
    maps = np.packbits(maps.reshape(-1, MAP_BITS), axis=1).view(np.uint64)
    likes = _likes(values, counts, similarity)
    root = np.arange(len(lines))
    firsts, sizes = _bounds(group)
    place = 0
    while True:
        # In each group the line at this place meets those after it that are not connected with it.
        left = sizes > place + 1
        firsts, sizes = firsts[left], sizes[left]
        if not len(firsts):
            break
        many = sizes - place - 1
        begins = np.cumsum(many) - many
        own = np.repeat(at[firsts + place], many)
        others = at[np.repeat(firsts + place + 1 - begins, many) + np.arange(len(own))]
        apart = root[own] != root[others]
        left = np.logical_or.reduceat(apart, begins)  # else all lines of the group are connected
        firsts, sizes = firsts[left], sizes[left]
        own, others = own[apart], others[apart]
        both = counts[own] + counts[others]
        unlike = np.bitwise_count(maps[own] ^ maps[others]).sum(axis=1, dtype=np.int64)
        # Jaccard similarity is (sum - difference) / (sum + difference) of the sizes of two sets; a larger sum raises it.
        close = both - unlike >= similarity * (both + unlike)
        pairs, some = np.unique(own[close] * len(lines) + others[close], return_index=True)
        own, others = np.divmod(pairs, len(lines))
        unlike = unlike[close][some]
        for start, size in zip(*(bounds.tolist() for bounds in _bounds(own))):
            with_own = others[start : start + size]
            for other in with_own[likes(int(own[start]), with_own, unlike[start : start + size])].tolist():
                low, high = int(own[start]), other
                while root[low] != low:
                    low = int(root[low])
                while root[high] != high:
                    high = int(root[high])
                root[max(low, high)] = min(low, high)
        while not np.array_equal(root, root[root]):
            root = root[root]
        place += 1
    found = np.flatnonzero(root != np.arange(len(root)))
    return ids[found], ids[root[found]]


def _verified(similarity: float, by: Sequence[str] = ("bucket", "block")):
    """Links of the lines of each run of rows that are equal in ``by``.

    A column ``groups`` names the groups of each line; lines of a run that share one are compared. Without it a run is a group.
    """

    def links(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        """The links of whole runs, which begin at the given rows."""
        run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rows))))
        ids, lines = rows["line_id"].to_numpy(), rows["line"].to_numpy()
        order = np.lexsort((ids, run))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (np.diff(run[order]) != 0) | (np.diff(ids[order]) != 0)
        order = order[new]
        run, ids, lines = run[order], ids[order], lines[order]
        at, group = np.arange(len(ids)), run
        if "groups" in rows:
            names = rows["groups"].to_numpy()[order]
            at, names = np.repeat(at, [len(some) for some in names]), np.concatenate(names)
            sort = np.lexsort((at, names, run[at]))
            at, names = at[sort], names[sort]
            new = np.ones(len(at), dtype=bool)
            new[1:] = (np.diff(run[at]) != 0) | (np.diff(names) != 0)
            group = np.cumsum(new)
        run_of = run[at]
        # Some runs at a time, cut at the begin of a run.
        long = np.cumsum([max(len(line), LEAST_CHARACTERS) for line in lines])
        firsts = _bounds(run)[0]
        cuts = [0, *firsts[np.flatnonzero(np.diff((long[firsts] - 1) // TOGETHER_CHARACTERS)) + 1].tolist(), len(ids)]
        sides = []
        for begin, end in zip(cuts, cuts[1:]):
            some = slice(*np.searchsorted(run_of, [run[begin], run[end - 1] + 1]))
            sides.append(linked_groups(group[some], ids[begin:end], lines[begin:end].tolist(), similarity, at[some] - begin))
        return pd.DataFrame({name: np.concatenate(side) for name, side in zip(("left", "right"), zip(*sides))})

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(rows):
                continue
            new = np.ones(len(rows), dtype=bool)
            new[1:] = np.logical_or.reduce([np.diff(rows[name]) != 0 for name in by])
            starts = np.flatnonzero(new)
            if len(starts) > 1:  # the last run may go on in the next batch
                yield links(rows[: starts[-1]], starts[:-1])
            held = rows[starts[-1] :]
        if held is not None:
            yield links(held, np.zeros(1, dtype=np.int64))

    return verified


def line_links(
    lines: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, max_bucket: int = MAX_BUCKET
) -> DataFrame:
    """(left, right): enough links between different lines to connect all that are similar.

    Bands and sketches are made for a similarity of ``SIMILARITY`` or more; a lower one is refused.
    """
    if similarity < SIMILARITY:
        raise ValueError(f"similarity must be at least {SIMILARITY}")
    signed = lines.select("line_id", "line").mapInArrow(_signatures(bands, rows), "line_id bigint, sketch bigint, keys array<bigint>")
    keyed = signed.select(F.explode("keys").alias("band_key"), "line_id", "sketch")
    members = bucket_members(keyed, max_bucket, bands)
    wanted = members.select(F.col("line_id").alias("wanted")).distinct().hint("shuffle_hash")
    # Only ids are held, so texts are not sorted for it. One text per line: repeats of a line go before they are moved.
    texts = lines.select("line_id", "line").join(wanted, F.col("line_id") == F.col("wanted"), "left_semi")
    texts = texts.dropDuplicates(["line_id"])
    # The groups of a home come together, so a text is moved and read once for them.
    homes = members.groupBy("home", "line_id").agg(F.collect_set("bucket").alias("groups"))
    told = homes.join(texts, "line_id").select("home", "line_id", "groups", "line")
    told = told.repartition("home").sortWithinPartitions("home")
    return told.mapInPandas(_verified(similarity, ["home"]), "left bigint, right bigint")


def repeated_lines(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, key, n_lines, removed), one row per document: its number of lines with a word and those to remove.

    Line numbers count from 0. ``key`` tells texts of one id apart. Options are those of ``line_links``.
    """
    # Texts are split once; lines are read three times.
    lines = written(lines_of(documents, doc_id, text), compression="zstd")
    places = lines.select("id", "key", "line_no", "line_id")
    roots = components(line_links(lines, **options)).withColumnRenamed("node", "line_id")
    grouped = places.join(roots, "line_id", "left").select(
        "id", "key", "line_no", F.coalesce("root", "line_id").alias("component")
    )
    place = F.struct("id", "key", "line_no")
    first = grouped.groupBy("component").agg(F.min(place).alias("first"))
    marked = grouped.join(first, "component").select("id", "key", "line_no", (~place.eqNullSafe(F.col("first"))).alias("removed"))
    found = marked.groupBy(F.col("id").alias("of_id"), F.col("key").alias("of_key")).agg(
        F.size(F.collect_set("line_no")).cast("bigint").alias("n_lines"),
        F.sort_array(F.collect_set(F.when(F.col("removed"), F.col("line_no")))).alias("removed"),
    )
    rows = documents.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("key"))
    match = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("key") == F.col("of_key"))
    return rows.join(found, match, "left").select(
        "doc_id",
        "key",
        F.coalesce("n_lines", F.lit(0).cast("bigint")).alias("n_lines"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
    )


def dedup_lines(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without repeated lines; a document that loses nothing keeps its text."""
    lost = repeated_lines(documents, doc_id, text, **options).where(F.size("removed") > 0)
    # A document given twice loses its lines once.
    lost_id, lost_key, gone = (unused(documents, name) for name in ("_lost_id", "_lost_key", "_lost_lines"))
    lost = lost.select(F.col("doc_id").alias(lost_id), F.col("key").alias(lost_key), F.col("removed").alias(gone))
    lost = lost.dropDuplicates([lost_id, lost_key])
    own = column(text)
    match = column(doc_id).eqNullSafe(F.col(lost_id)) & (text_key(own) == F.col(lost_key))
    kept = F.filter(F.split(own, "\n", -1), lambda line, i: ~F.array_contains(F.col(gone), i))
    clean = F.when(F.col(gone).isNull(), own).otherwise(F.array_join(kept, "\n"))
    joined = documents.join(lost, match, "left")
    return joined.select(*[clean.alias(c) if c == text else column(c) for c in documents.columns])
