import hashlib
import random
import zlib
from math import floor

import numpy as np
import pytest

from wordloom.llm import periodic_runs
from wordloom.llm.queries import op13_periodic_runs, with_planted_runs

SF_DIR = "/root/testdata/sf0.001"


def runs_of(words):
    """(start, length, period) by comparing the text with itself at every distance."""
    found = []
    for q in range(1, len(words) // 3 + 1):
        equal = [words[i] == words[i + q] for i in range(len(words) - q)] + [False]
        begin = None
        for i, same in enumerate(equal):
            if same and begin is None:
                begin = i
            if not same and begin is not None:
                length = i - begin + q
                if length >= max(24, 3 * q):
                    part = words[begin : begin + length]
                    if not any(all(part[j] == part[j + p] for j in range(length - p)) for p in range(1, q)):
                        found.append((begin, length, q))
                begin = None
    return sorted(found, key=lambda run: (run[0], run[2]))


def answer(doc_id, text):
    words = (text or "").encode().split()
    words = [word.decode() for word in words]
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + floor((n - a) / (3 + g % 8))
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = runs_of(words)
    kept = [True] * n
    for start, length, q in runs:
        kept[start + q : start + length] = [False] * (length - q)
    best = (None,) * 4
    if runs:
        # Exact fractions: length / period compared by cross products.
        top = runs[0]
        for run in runs[1:]:
            if run[1] * top[2] > top[1] * run[2]:
                top = run
        best = (*top, 1000 * top[1] // top[2])
    said = "".join(f"{start},{length},{q}\n" for start, length, q in runs)
    digest = lambda value: hashlib.sha256(value.encode()).hexdigest()
    return (len(runs), *best, digest(said), digest(" ".join(w for w, k in zip(words, kept) if k)))


def periodic(draw, letters, size):
    words = []
    while len(words) < size:
        block = [draw.choice(letters) for _ in range(draw.randint(1, 40))]
        words += block * draw.choice([1, 1, 2, 3, 4, 9])
        words += block[: draw.randint(0, len(block))]
    return words[:size]


@pytest.mark.parametrize("seed", range(30))
def test_tiles_and_fragments_equal_brute_force(seed):
    draw = random.Random(seed)
    words = periodic(draw, "abc" if seed % 2 else "abcdefghijklmnop", draw.choice([0, 23, 24, 60, 300, 700]))
    ids = np.array([ord(word) for word in words], np.int32)
    pieces = set()
    cut = periodic_runs.tiles(ids)
    for low in {low for low, _, _ in cut}:
        held = [(first, size) for octave, first, size in cut if octave == low]
        together = periodic_runs.fragments([ids[first : first + size] for first, size in held], low)
        pieces |= {(q, held[t][0] + b, held[t][0] + e) for t, q, b, e in together}
    merged = []
    for q, b, e in sorted(pieces):
        if merged and merged[-1][0] == q and b <= merged[-1][2] - q:
            merged[-1][2] = max(e, merged[-1][2])
        else:
            merged.append([q, b, e])
    assert sorted((b, e - b, q) for q, b, e in merged) == sorted(runs_of(words))


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    got = {row[0]: tuple(row[1:]) for row in op13_periodic_runs(spark, SF_DIR).collect()}
    assert len(got) == len(rows)
    for row in rows:
        if len(row.text) < 8000 or zlib.crc32(str(row.doc_id).encode()) % 10 == 0 and len(row.text) < 20000:
            assert got[row.doc_id] == answer(row.doc_id, row.text), row.doc_id


def test_null_empty_long_repeated_and_clashing(spark, monkeypatch):
    draw = random.Random(3)
    texts = [None, "", " \t\n", "one", "a " * 24, "a " * 23, " ".join(periodic(draw, "ab", 900)), "x y\x0bz " * 30, "w v é " * 50]
    texts += [" ".join(periodic(draw, "abcdefgh", 400)) for _ in range(6)]
    long = [draw.choice("abcdefghij") for _ in range(30_000)]
    long[5000:9000] = (long[5000:6000] * 4)[:4000]
    rows = [(i, text) for i, text in enumerate(texts)] + [(None, "q r " * 40)] * 2 + [(7, texts[6])] * 30
    frame = spark.createDataFrame([(i, text, "p", 1, 2) for i, text in rows], "doc_id long, text string, place string, period int, n_words int").repartition(4)
    monkeypatch.setattr("wordloom.llm.queries._table", lambda *_: frame)
    got = sorted(map(str, (tuple(row) for row in op13_periodic_runs(spark, "").collect())))
    assert got == sorted(str((i, *answer(i, text))) for i, text in rows)
    planted = spark.createDataFrame([(1, " ".join(long))], "doc_id long, text string")
    runs = [tuple(run) for run in periodic_runs.periodic_runs(planted).first().runs]
    assert any(q == 1000 and begin <= 5000 and begin + length >= 9000 for begin, length, q in runs)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs.periodic_runs(none).count() == 0 and with_planted_runs(none).count() == 0
