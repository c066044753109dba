import hashlib
import itertools
import random
import re
import zlib

import pytest

from wordloom.llm import repair
from wordloom.llm.queries import damaged, op12_conversation_repair

SF_DIR = "/root/testdata/sf0.001"


def facts(rows):
    """(gaps, blank, duplicate, truncated, illegal, faults) of (turn, role, text) rows in order."""
    turns = [turn for turn, _, _ in rows if turn is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, faults = set(), []
    for _, role, text in rows:
        letters = re.findall(r"[^\x20\x09-\x0D]", text)
        if not letters:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("truncated" if letters[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, *[faults.count(name) for name in ("blank", "duplicate", "truncated")], illegal, faults


def every_way(rows, faults):
    """(cost, audit, repaired) of the cheapest edits, the audit least in ASCII order, by trying all."""
    fills = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    best = None
    for inserts in itertools.product(fills, repeat=len(rows) + 1):
        for edits in itertools.product("KUAD", repeat=len(rows)):
            cost, audit, turns = 0, "", []
            for i in range(len(rows) + 1):
                for role in inserts[i]:
                    cost, audit = cost + 5, audit + "I"
                    turns.append((role, ""))
                if i == len(rows):
                    break
                if edits[i] == "D":
                    cost, audit = cost + 2, audit + "D"
                    continue
                if faults[i] in ("blank", "duplicate"):
                    cost = 1 << 40
                cost += 5 * (faults[i] == "truncated") + (edits[i] != "K")
                audit += "K" if edits[i] == "K" else "R"
                turns.append(({"K": rows[i][1], "U": "user", "A": "assistant"}[edits[i]], rows[i][2]))
            if cost < 1 << 40 and re.fullmatch("(s?(ua)+)?", "".join(role[:1] or "-" for role, _ in turns)):
                if best is None or (cost, audit) < best[:2]:
                    best = (cost, audit, "\n".join(f"{role}:{text}" for role, text in turns))
    return best


def by_table(rows, faults):
    """The same by a whole table of costs, for conversations too long to try all."""
    codes = [repair.code_of(role, fault == "blank", fault == "duplicate", fault == "truncated") for (_, role, _), fault in zip(rows, faults)]
    table = [repair.ENDS]
    for code in reversed(codes):
        table.append(repair.back(code, table[-1]))
    table.reverse()
    i, state, audit = 0, 0, ""
    while i < len(codes) or state in (1, 2):
        moves = [("I", 5, repair.FITS[state], 0)]
        if i < len(codes):
            moves += [(letter, cost, to, 1) for letter, cost, to in repair.EDITS[codes[i]][state]]
        letter, _, state, step = min(m for m in moves if m[1] + table[i + m[3]][m[2]] == table[i][state])
        audit, i = audit + letter, i + step
    return table[0][0], audit


def damage(rows):
    """The stated damage on (conv_id, turn, role, text), rows in order per conversation."""
    found = {}
    for conv_id, turn, role, text in rows:
        shown = lambda value: " " if value is None else str(value)
        role, text = shown(role), shown(text)
        harm = zlib.crc32(f"{shown(conv_id)}:{shown(turn)}".encode()) % 20
        held = found.setdefault(conv_id, [])
        if harm == 1:
            text = ""
        if harm == 2:
            text = re.sub("[.!?]", "", text)
        if harm == 4:
            role = "user"
        held += [(turn, role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    for held in found.values():
        held.sort(key=lambda row: (row[0] is not None, row[0] or 0, row[1], hashlib.md5(f"{len(row[1])}:{row[1]}{row[2]}".encode()).hexdigest()))
    return found


def random_rows(draw, size):
    roles = ["user", "assistant", "system", "tool", " ", "", "umpire"]
    texts = ["Yes.", "no", "", "Well!", " \t", "Ends? ", "x.\n"]
    return [(i, draw.choice(roles[:3] if draw.random() < 0.8 else roles), draw.choice(texts) + draw.choice(["", str(i) + "."])) for i in range(size)]


@pytest.mark.parametrize("seed", range(60))
def test_small_conversations_equal_every_way(seed):
    draw = random.Random(seed)
    rows = random_rows(draw, draw.randint(0, 3))
    *_, faults = facts(rows)
    codes = bytes(repair.code_of(role, fault == "blank", fault == "duplicate", fault == "truncated") for (_, role, _), fault in zip(rows, faults))
    audit, state = repair.reconstruct(codes, 0, len(codes), repair.START, repair.ENDS)
    audit += repair.closing(state)
    turns = "\n".join(f"{role}:{text}" for role, text in zip(*repair.replay(audit, 0, [r[1] for r in rows], [r[2] for r in rows])))
    assert (repair.audit_cost(audit, codes), audit, turns) == every_way(rows, faults)


@pytest.mark.parametrize("held", [1, 2, 5])
def test_division_equals_the_whole_table(monkeypatch, held):
    monkeypatch.setattr(repair, "HELD_ROWS", held)
    draw = random.Random(held)
    for size in (1, 2, 7, 30, 200):
        for _ in range(20):
            rows = random_rows(draw, size)
            *_, faults = facts(rows)
            codes = bytes(repair.code_of(r[1], f == "blank", f == "duplicate", f == "truncated") for r, f in zip(rows, faults))
            audit, state = repair.reconstruct(codes, 0, len(codes), 0, repair.ENDS)
            cost, want = by_table(rows, faults)
            assert (repair.audit_cost(audit + repair.closing(state), codes), audit + repair.closing(state)) == (cost, want)


def expected(rows):
    found = {}
    for conv_id, held in damage(rows).items():
        gaps, blank, duplicate, truncated, illegal, faults = facts(held)
        cost, audit = by_table(held, faults)
        roles, texts = repair.replay(audit, 0, [row[1] for row in held], [row[2] for row in held])
        digest = hashlib.sha256("\n".join(f"{role}:{text}" for role, text in zip(roles, texts)).encode()).hexdigest()
        found[conv_id] = (gaps, blank, duplicate, truncated, illegal, cost, audit, digest)
    return found


def answered(spark, monkeypatch, table):
    monkeypatch.setattr("wordloom.llm.queries._table", lambda *_: table)
    rows = op12_conversation_repair(spark, "").collect()
    assert len({row.conv_id for row in rows}) == len(rows)
    return {row[0]: tuple(row[1:]) for row in rows}


def test_query_equals_brute_force(spark):
    rows = [tuple(row) for row in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {row[0]: tuple(row[1:]) for row in op12_conversation_repair(spark, SF_DIR).collect()}
    assert got == expected(rows)


SCHEMA = "conv_id long, turn long, role string, text string, key string, task int, mark string"


@pytest.mark.parametrize("segment", [3, 2000])
def test_long_null_empty_and_repeated_rows(spark, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT_ROWS", segment)
    draw = random.Random(7)
    rows = []
    for conv_id, size in [(None, 5), (1, 1), (2, 400), (3, 2), (4, 40), (5, 0), (6, 9)]:
        rows += [(conv_id, turn, role, text) for turn, role, text in random_rows(draw, size)]
    rows += [(7, None, None, None), (7, None, "user", "Hi."), (7, 3, "assistant", "x" * 50_000 + "."), (7, 3, "assistant", "x" * 50_000 + ".")]
    rows += [(8, 5, "user", "Same."), (8, 9, "assistant", "Good.")] * 60
    shuffled = random.Random(1).sample(rows, len(rows))
    table = spark.createDataFrame([(*row, "k", 1, "m") for row in shuffled], SCHEMA).repartition(5)
    want = expected(rows)
    assert answered(spark, monkeypatch, table) == want
    assert sum(len(list(group)) for _, group in itertools.groupby(rows)) == len(rows)


def test_real_output_holds_the_turns(spark):
    table = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "What?"), (1, 2, "assistant", "Well.")], "conv_id long, turn long, role string, text string")
    found = repair.repair(table)
    pieces = [(r.task, r.place, r.roles, r.texts) for r in found.pieces.collect()]
    turns = [turn for _, _, roles, texts in sorted(pieces) for turn in zip(roles, texts)]
    assert found.summary.first().audit == "DKK" and turns == [("user", "What?"), ("assistant", "Well.")]


def test_empty_table_and_conversation_without_rows(spark, monkeypatch):
    none = spark.createDataFrame([], SCHEMA)
    assert answered(spark, monkeypatch, none) == {}
    turn = next(i for i in range(1000) if zlib.crc32(f"1:{i}".encode()) % 20 == 0)
    gone = spark.createDataFrame([(1, turn, "user", "Hi.", "k", 1, "m")], SCHEMA)
    assert damaged(gone).count() == 0
    assert answered(spark, monkeypatch, gone) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
