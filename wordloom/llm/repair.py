"""Conversation structure repair: the cheapest edits that make a conversation alternate, found in linear space.

A repaired conversation is empty or an optional system turn and then pairs of user and assistant turns. A reader of
roles has four states: nothing read, system read, user read, assistant read. Rows are kept, given the other role,
deleted, or turns are inserted between them, each at a cost; from a state and an edit's letter the next state follows.

Hirschberg's division: a forward and a backward vector of four costs meet in the middle of a conversation; states where
they add up to the least cost are the crossings. The left half is solved first with those crossings as its ends, which
yields the audit that is least in ASCII order and with it the crossing, then the right half from there. No table of
costs is held, only vectors and the audit.

A conversation of any size: rows are range-sorted by conversation and turn into tasks of bounded bytes. Conversations
of at most ``SEGMENT_ROWS`` rows inside one task are solved there. Others, also those at the ends of a task, become
segments. Repeated turns are found across segments by a hash of role and text; each segment tells its 4 x 4 least costs;
a scan of these per conversation gives the cost vectors at every seam; each segment solves itself from each state, and a
second scan picks the states. So a conversation with a third of all rows is solved in parallel, and only its costs meet.

Defined results: null roles and texts are one space; rows of one turn are ordered by role and a hash of the text; null
turns come first; a conversation id may be null and is one conversation; other columns are left out; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from wordloom.llm.expressions import column, written

#: Rows and bytes of a task, and rows and characters of a segment.
TASK_ROWS = 100_000
TASK_BYTES = 64 << 20
SEGMENT_ROWS = 2_000
SEGMENT_CHARACTERS = 4 << 20
#: Rows whose cost vectors are held at a time.
HELD_ROWS = 16

REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
NONE = 1 << 60
#: Cost of ending in each state: the turns that are missing are inserted.
ENDS = (0, 2 * INSERT, INSERT, 0)
#: The state after a turn that is inserted or given the role that fits.
FITS = (USER, USER, ASSISTANT, USER)
FIT_ROLE = ("user", "user", "assistant", "user")
INITIALS = {"s": 1, "u": 2, "a": 3}
#: The state after a kept turn by its initial (other, s, u, a), or None.
KEPT = ((None,) * 4, (SYSTEM, None, None, None), (USER, USER, None, USER), (None, None, ASSISTANT, None))
LEGAL = ("su", "ua", "au")

Costs = tuple[int, int, int, int]


# --- one conversation -------------------------------------------------------------------------


def code_of(role: str, blank: bool, repeated: bool, cut: bool) -> int:
    """A row as a number: 0 must be deleted, else 1 + 2 * initial + cut."""
    return 0 if blank or repeated else 1 + 2 * INITIALS.get(role[:1], 0) + cut


def _edits(code: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of a row, in ASCII order."""
    found = [("D", DELETE, state)]
    if code:
        initial, cut = divmod(code - 1, 2)
        if KEPT[initial][state] is not None:
            found.append(("K", CUT * cut, KEPT[initial][state]))
        found.append(("R", REROLE + CUT * cut, FITS[state]))
    return found


EDITS = [[_edits(code, state) for state in range(4)] for code in range(9)]


def back(code: int, after: Costs) -> Costs:
    """Least cost to the end from each state before a row, turns inserted before it included."""
    row = [min(cost + after[to] for _, cost, to in EDITS[code][state]) for state in range(4)]
    user = min(row[USER], INSERT + row[ASSISTANT])
    assistant = min(row[ASSISTANT], INSERT + row[USER])
    return (min(row[START], INSERT + user), min(row[SYSTEM], INSERT + user), user, assistant)


def fore(code: int, before: Costs) -> Costs:
    """Least cost from the begin to each state after a row."""
    user = min(before[USER], INSERT + min(before[START], before[SYSTEM], before[ASSISTANT]))
    assistant = min(before[ASSISTANT], INSERT + user)
    found = [NONE] * 4
    for state, so_far in enumerate((before[START], before[SYSTEM], user, assistant)):
        if so_far < NONE:
            for _, cost, to in EDITS[code][state]:
                found[to] = min(found[to], so_far + cost)
    return tuple(found)


def at(state: int) -> Costs:
    return tuple(0 if i == state else NONE for i in range(4))


def reconstruct(codes: bytes, begin: int, end: int, state: int, ends: Costs) -> tuple[str, int]:
    """The least audit of cheapest edits of rows ``begin`` to ``end`` from a state, and the state it reaches.

    ``ends`` is the cost that follows in each state.
    """
    if end - begin > HELD_ROWS:
        middle = (begin + end) // 2
        behind, ahead = at(state), ends
        for i in range(begin, middle):
            behind = fore(codes[i], behind)
        for i in range(end - 1, middle - 1, -1):
            ahead = back(codes[i], ahead)
        least = min(a + b for a, b in zip(behind, ahead))
        crossings = tuple(b if a + b == least else NONE for a, b in zip(behind, ahead))
        left, crossing = reconstruct(codes, begin, middle, state, crossings)
        right, last = reconstruct(codes, middle, end, crossing, ends)
        return left + right, last
    vectors = [ends]
    for i in range(end - 1, begin - 1, -1):
        vectors.append(back(codes[i], vectors[-1]))
    letters = []
    for i in range(begin, end):
        here, after = vectors[end - i], vectors[end - i - 1]
        while True:
            cost = here[state]
            (_, deleted, _), *others = EDITS[codes[i]][state]
            if deleted + after[state] == cost:
                letters.append("D")
                break
            if INSERT + here[FITS[state]] == cost:
                letters.append("I")
                state = FITS[state]
                continue
            letter, _, state = next(edit for edit in others if edit[1] + after[edit[2]] == cost)
            letters.append(letter)
            break
    return "".join(letters), state


def closing(state: int) -> str:
    """The turns inserted after the last row."""
    return "I" * (ENDS[state] // INSERT)


def replay(audit: str, state: int, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Roles and texts of the repaired turns."""
    kept_roles, kept_texts, i = [], [], 0
    for letter in audit:
        if letter == "I":
            kept_roles.append(FIT_ROLE[state])
            kept_texts.append("")
            state = FITS[state]
            continue
        if letter == "K":
            kept_roles.append(roles[i])
            state = KEPT[INITIALS.get(roles[i][:1], 0)][state]
        elif letter == "R":
            kept_roles.append(FIT_ROLE[state])
            state = FITS[state]
        if letter != "D":
            kept_texts.append(texts[i])
        i += 1
    return kept_roles, kept_texts


def audit_cost(audit: str, codes: bytes) -> int:
    rows = iter(codes)
    cost = 0
    for letter in audit:
        code = 0 if letter == "I" else next(rows)
        cost += {"I": INSERT, "D": DELETE, "K": 0, "R": REROLE}[letter]
        cost += CUT if letter in "KR" and (code - 1) % 2 else 0
    return cost


# --- rows in order ----------------------------------------------------------------------------


@dataclass
class Repaired:
    """``summary``: one row per conversation: conv_id, rows, gaps, blank, duplicate, truncated, illegal, cost, audit.

    ``pieces``: the repaired turns, as (conv_id, whole, task, place, roles, texts); a conversation that is not whole
    has several pieces, in order of task and place. ``key`` tells conversations apart in both.
    """

    summary: DataFrame
    pieces: DataFrame


_COUNTS = "rows bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _in_order(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(key, conv_id, turn, role, text, mark, blank, cut) in tasks of bounded size, sorted."""

    def filled(name: str) -> Column:
        return F.coalesce(column(name).cast("string"), F.lit(" "))

    rows = conversations.select(
        F.coalesce(F.concat(F.lit("="), column(conv).cast("string")), F.lit("")).alias("key"),
        column(conv).alias("conv_id"),
        column(turn).cast("bigint").alias("turn"),
        filled(role).alias("role"),
        filled(text).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    # The length of the role tells where it ends.
    mark = F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    rows = rows.withColumn("mark", mark).withColumn("last", last)
    rows = rows.select(
        "key", "conv_id", "turn", "role", "text", "mark", "row",
        (F.col("last") == "").alias("blank"), (~F.col("last").isin("", ".", "!", "?")).alias("cut"),
    )
    number, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    tasks = max(number // TASK_ROWS, size // TASK_BYTES, rows.sparkSession.sparkContext.defaultParallelism) + 1
    order = ["key", "turn", "role", "mark", "row"]
    return rows.repartitionByRange(int(tasks), *order).sortWithinPartitions(*order).drop("row")


class _Piece:
    """Rows of one conversation that lie together, or a stretch of them."""

    def __init__(self, key, conv_id):
        self.key, self.conv_id, self.characters = key, conv_id, 0
        self.turns, self.roles, self.texts, self.marks, self.blank, self.cut = [], [], [], [], [], []

    def add(self, turn, role, text, mark, blank, cut) -> None:
        self.characters += len(text)
        for held, value in zip((self.turns, self.roles, self.texts, self.marks, self.blank, self.cut), (turn, role, text, mark, blank, cut)):
            held.append(value)

    def full(self) -> bool:
        return len(self.turns) >= SEGMENT_ROWS or self.characters >= SEGMENT_CHARACTERS


def _judged(roles, marks, blank, cut, seen: set[str]) -> tuple[bytes, int, int, int]:
    """(codes, blank, duplicate, truncated) of rows after those in ``seen``."""
    codes, counts = bytearray(), [0, 0, 0]
    for role, mark, is_blank, is_cut in zip(roles, marks, blank, cut):
        repeated = mark in seen
        seen.add(mark)
        codes.append(code_of(role, is_blank, repeated, is_cut))
        if is_blank or repeated or is_cut:
            counts[0 if is_blank else 1 if repeated else 2] += 1
    return bytes(codes), *counts


def _turn_facts(turns) -> tuple[int | None, int | None, int]:
    """(first, last, number of different turns) of sorted turns without nulls."""
    known = [turn for turn in turns if turn is not None]
    return (known[0], known[-1], len(set(known))) if known else (None, None, 0)


def _illegal(roles) -> int:
    initials = [role[:1] for role in roles]
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def _solved(piece: _Piece) -> dict:
    codes, blank, repeated, cut = _judged(piece.roles, piece.marks, piece.blank, piece.cut, set())
    first, last, different = _turn_facts(piece.turns)
    audit, state = reconstruct(codes, 0, len(codes), START, ENDS)
    audit += closing(state)
    roles, texts = replay(audit, START, piece.roles, piece.texts)
    return {
        "key": piece.key, "conv_id": piece.conv_id, "whole": True, "task": 0, "place": 0,
        "rows": len(codes), "gaps": last - first + 1 - different if different else 0,
        "blank": blank, "duplicate": repeated, "truncated": cut, "illegal": _illegal(piece.roles),
        "cost": audit_cost(audit, codes), "audit": audit, "roles": roles, "texts": texts,
    }


def _segment(piece: _Piece, place: int) -> dict:
    return {
        "key": piece.key, "conv_id": piece.conv_id, "whole": False, "task": TaskContext.get().partitionId(), "place": place,
        "turns": piece.turns, "roles": piece.roles, "texts": piece.texts, "marks": piece.marks, "empty": piece.blank, "cut": piece.cut,
    }


def _first_pass(ordered: DataFrame) -> DataFrame:
    """Whole conversations solved; the rows of others as segments."""
    conv_type = ordered.schema["conv_id"].dataType.simpleString()
    schema = (
        f"key string, conv_id {conv_type}, whole boolean, task int, place int, {_COUNTS}, roles array<string>, texts array<string>, "
        "turns array<bigint>, marks array<string>, empty array<boolean>, cut array<boolean>"
    )
    target = ordered.sparkSession.createDataFrame([], schema)
    arrow = to_arrow_schema(target.schema)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        held = 0
        piece: _Piece | None = None
        first_key, place = None, 0
        names = ("key", "conv_id", "turn", "role", "text", "mark", "blank", "cut")
        for batch in batches:
            for key, conv_id, *row in zip(*(batch.column(name).to_pylist() for name in names)):
                if first_key is None:
                    first_key = key
                if piece is None or piece.key != key:
                    if piece is not None:
                        # The first conversation may have begun in the task before; a long one already has segments.
                        out.append(_segment(piece, place) if place or piece.key == first_key else _solved(piece))
                        held += piece.characters
                    piece, place = _Piece(key, conv_id), 0
                elif piece.full():
                    out.append(_segment(piece, place))
                    held += piece.characters
                    piece, place = _Piece(key, conv_id), place + 1
                piece.add(*row)
                if len(out) >= SEGMENT_ROWS or held >= SEGMENT_CHARACTERS:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out, held = [], 0
        if piece is not None:
            out.append(_segment(piece, place))
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return ordered.mapInArrow(settle, schema)


# --- conversations in several segments --------------------------------------------------------


def _costs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Codes, counts and 4 x 4 least costs of each segment."""
    for frame in frames:
        rows = []
        for r in frame.itertuples():
            seen = set() if r.seen is None else set(r.seen)
            codes, blank, repeated, cut = _judged(r.roles, r.marks, r.empty, r.cut, seen)
            matrix = []
            for state in range(4):
                vector = at(state)
                for code in codes:
                    vector = fore(code, vector)
                matrix += vector
            known = [int(turn) for turn in r.turns if turn is not None and turn == turn]
            first, last, different = _turn_facts(known)
            rows.append(
                (r.key, r.task, r.place, codes, matrix, len(codes), blank, repeated, cut, _illegal(r.roles),
                 r.roles[0][:1], r.roles[-1][:1], first, last, different)
            )
        table = pd.DataFrame(rows, columns=[part.split()[0] for part in _SEGMENT.split(", ")])
        table[["first", "last"]] = table[["first", "last"]].astype("Int64")
        yield table


_SEGMENT = (
    "key string, task int, place int, codes binary, matrix array<bigint>, rows bigint, blank bigint, duplicate bigint, "
    "truncated bigint, illegal bigint, initial string, final string, first bigint, last bigint, different bigint"
)


def _seams(group: pd.DataFrame) -> pd.DataFrame:
    """The cost vector that follows each segment of a conversation."""
    group = group.sort_values(["task", "place"])
    vectors, after = [], ENDS
    for matrix in group["matrix"][::-1]:
        vectors.append(list(after))
        after = tuple(min(int(matrix[4 * state + to]) + after[to] for to in range(4)) for state in range(4))
    return pd.DataFrame({"key": group["key"], "task": group["task"], "place": group["place"], "ends": vectors[::-1]})


def _from_each_state(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Audit and last state of each segment from each state."""
    for frame in frames:
        rows = []
        for r in frame.itertuples():
            ends = tuple(int(cost) for cost in r.ends)
            found = [reconstruct(bytes(r.codes), 0, len(r.codes), state, ends) for state in range(4)]
            rows.append((r.key, r.task, r.place, [audit for audit, _ in found], [state for _, state in found]))
        yield pd.DataFrame(rows, columns=["key", "task", "place", "audits", "states"])


def _chosen(group: pd.DataFrame) -> pd.DataFrame:
    """The state in which each segment begins, and what follows the last one."""
    group = group.sort_values(["task", "place"])
    state, begins = START, []
    for states in group["states"]:
        begins.append(state)
        state = int(states[state])
    tails = [""] * len(begins)
    tails[-1] = closing(state)
    return pd.DataFrame({"key": group["key"], "task": group["task"], "place": group["place"], "begin": begins, "tail": tails})


def _segment_costs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        costs = [audit_cost(audit, bytes(codes)) for audit, codes in zip(frame["audit"], frame["codes"])]
        yield pd.DataFrame({"key": frame["key"], "cost": costs})


def _totals(group: pd.DataFrame) -> pd.DataFrame:
    """Counts of a conversation from those of its segments."""
    group = group.sort_values(["task", "place"])
    known = group[group["different"] > 0]
    gaps = 0
    if len(known):
        shared = int((known["first"].to_numpy()[1:] == known["last"].to_numpy()[:-1]).sum())
        gaps = int(known["last"].iloc[-1]) - int(known["first"].iloc[0]) + 1 - (int(known["different"].sum()) - shared)
    seams = [a + b not in LEGAL for a, b in zip(group["final"], group["initial"][1:])]
    sums = {name: [int(group[name].sum())] for name in ("rows", "blank", "duplicate", "truncated")}
    return pd.DataFrame({"key": [group["key"].iloc[0]], "gaps": [gaps], "illegal": [int(group["illegal"].sum()) + sum(seams)], **sums})


_PLACE = ["key", "task", "place"]


def _segments_solved(stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary, pieces) of the conversations in segments."""
    slim = stored.where("NOT whole").select("key", "task", "place", "turns", "roles", "marks", "empty", "cut")
    said = slim.select(*_PLACE, F.explode(F.array_distinct("marks")).alias("mark"))
    order = F.struct("task", "place")
    first = said.groupBy("key", "mark").agg(F.min(order).alias("first"))
    again = said.join(first, ["key", "mark"]).where(order > F.col("first"))
    seen = again.groupBy(*_PLACE).agg(F.collect_list("mark").alias("seen"))
    costed = written(slim.join(seen, _PLACE, "left").mapInPandas(_costs, _SEGMENT))
    narrow = costed.select(*_PLACE, "matrix")
    seams = narrow.groupBy("key").applyInPandas(_seams, "key string, task int, place int, ends array<bigint>")
    solved = costed.select(*_PLACE, "codes").join(seams, _PLACE)
    solved = written(solved.mapInPandas(_from_each_state, "key string, task int, place int, audits array<string>, states array<int>"))
    begins = solved.select(*_PLACE, "states").groupBy("key").applyInPandas(_chosen, "key string, task int, place int, begin int, tail string")
    audit = F.concat(F.get("audits", "begin"), "tail")
    chosen = written(solved.join(begins, _PLACE).select(*_PLACE, "begin", audit.alias("audit")))
    totals = costed.drop("codes").groupBy("key").applyInPandas(
        _totals, "key string, gaps bigint, illegal bigint, rows bigint, blank bigint, duplicate bigint, truncated bigint"
    )
    # One audit is one string, so a conversation may have some 2 billion edits.
    audits = chosen.groupBy("key").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("task", "place", "audit"))), lambda s: s["audit"]), "").alias("audit")
    )
    costs = (
        costed.select(*_PLACE, "codes").join(chosen, _PLACE).mapInPandas(_segment_costs, "key string, cost bigint").groupBy("key").agg(F.sum("cost").alias("cost"))
    )
    ids = stored.where("NOT whole").groupBy("key").agg(F.first("conv_id").alias("conv_id"))
    summary = ids.join(totals, "key").join(costs, "key").join(audits, "key")
    rows = stored.where("NOT whole").select(*_PLACE, "conv_id", "roles", "texts").join(chosen, _PLACE)
    conv_type = stored.schema["conv_id"].dataType.simpleString()
    pieces = rows.mapInPandas(_replayed, f"key string, conv_id {conv_type}, task int, place int, roles array<string>, texts array<string>")
    return summary, pieces


def _replayed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        turns = [replay(r.audit, r.begin, list(r.roles), list(r.texts)) for r in frame.itertuples()]
        frame = frame[["key", "conv_id", "task", "place"]].copy()
        frame["roles"], frame["texts"] = [roles for roles, _ in turns], [texts for _, texts in turns]
        yield frame


def repair(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repaired:
    """Judge and repair every conversation of a table of turns."""
    stored = written(_first_pass(_in_order(conversations, conv, turn, role, text)))
    columns = ["key", "conv_id", "rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    whole = stored.where("whole")
    summary, pieces = _segments_solved(stored)
    kept = ["key", "conv_id", "whole", "task", "place", "roles", "texts"]
    return Repaired(
        whole.select(columns).unionByName(summary.select(columns)),
        whole.select(kept).unionByName(pieces.withColumn("whole", F.lit(False)).select(kept)),
    )


# --- digests ----------------------------------------------------------------------------------


def _stream_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each conversation's turns, piece by piece."""
    key, digest, empty = None, None, True
    names = pa.schema([("key", pa.string()), ("sha256", pa.string())])
    for batch in batches:
        done = []
        for of, roles, texts in zip(*(batch.column(name).to_pylist() for name in ("key", "roles", "texts"))):
            if of != key:
                if key is not None:
                    done.append({"key": key, "sha256": digest.hexdigest()})
                key, digest, empty = of, hashlib.sha256(), True
            if roles:
                joined = "\n".join(f"{role}:{text}" for role, text in zip(roles, texts))
                digest.update(("" if empty else "\n").encode() + joined.encode())
                empty = False
        yield pa.RecordBatch.from_pylist(done, names)
    if key is not None:
        yield pa.RecordBatch.from_pylist([{"key": key, "sha256": digest.hexdigest()}], names)


def digests(pieces: DataFrame) -> DataFrame:
    """(key, sha256) of the repaired turns as ``role:text``, joined by line ends.

    A digest takes its bytes in order, so the pieces of one conversation pass through one task, one at a time.
    """
    lines = F.transform(F.arrays_zip("roles", "texts"), lambda t: F.concat(t["roles"], F.lit(":"), t["texts"]))
    whole = pieces.where("whole").select("key", F.sha2(F.array_join(lines, "\n"), 256).alias("sha256"))
    parts = pieces.where("NOT whole").select(*_PLACE, "roles", "texts")
    parts = parts.repartition("key").sortWithinPartitions(*_PLACE)
    return whole.unionByName(parts.mapInArrow(_stream_hash, "key string, sha256 string"))
