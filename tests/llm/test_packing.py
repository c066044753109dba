import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wordloom.llm import packing
from wordloom.llm.queries import queries

SF_DIR = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = ["It's (O'Neil's) x.'s 'll--'ve a,́b A,B;c.d İ K Å \x85z-\x1cy\x0b\x0cw", "", "a <|endoftext|> b", "É é İstanbul ΣΑΣ  x y it's 'S 12 ½ 日本", " \x0b\x1c\x85 q", "́a é ́", "a b"]


def fewest(items, capacity):
    """The least number of sequences, by trying everything."""
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= items[i] and rooms[j] not in rooms[:j]:
                place(i + 1, rooms[:j] + [rooms[j] - items[i]] + rooms[j + 1 :])
        place(i + 1, rooms + [capacity - items[i]])

    place(0, [])
    return best[0]


def size(solution):
    return sum(times for times, _ in solution)


def contents(solution):
    found = Counter()
    for times, filling in solution:
        for length, copies in filling:
            found[length] += times * copies
    return found


@pytest.mark.parametrize("seed", range(40))
def test_bin_completion_equals_brute_force(seed):
    draw = random.Random(seed)
    capacity = draw.choice([10, 20, 30, 60])
    items = [draw.randint(1, capacity) if draw.random() < 0.3 else draw.randint(capacity // 6 + 1, capacity // 2) for _ in range(draw.randint(1, 10))]
    found = packing.complete(Counter(items), capacity, nodes=10**4, most=10**6, steps=10**6)
    assert size(found) == fewest(items, capacity) >= packing.lower_bound(Counter(items), capacity)
    assert contents(found) == Counter(items)
    assert all(sum(length * copies for length, copies in filling) <= capacity for _, filling in found)


def test_search_beats_best_fit():
    items = {3: 3, 6: 1, 5: 1, 2: 2}
    assert size(packing.best_fit(items, 12)) == size(packing.complete(items, 12)) + 1


def test_dominated_fillings_are_left_out():
    counts = {5: 1, 3: 1, 2: 2}
    found = {filling for _, filling in packing.fillings(counts, 5)}
    assert found == {((5, 1),)}  # 3 + 2 and 2 + 2 can be replaced by the piece of 5
    assert {filling for _, filling in packing.fillings({3: 1, 2: 2}, 5)} == {((3, 1), (2, 1))}


def test_large_counts_meet_the_lower_bound():
    draw = random.Random(5)
    counts = Counter(min(4096, int(draw.lognormvariate(6, 1)) + 1) for _ in range(20_000))
    found = packing.complete({length: number * 1000 for length, number in counts.items()})
    assert size(found) <= packing.lower_bound({length: number * 1000 for length, number in counts.items()}, 4096) * 1.001


def test_tokens_by_word_equal_tokens_of_whole_texts(spark):
    model = Tokenizer.from_file(WORDS)
    draw = random.Random(2)
    noise = ["".join(draw.choices("aZ'.,-s1 \u0301éİ\u00a0tS", k=30)) for _ in range(2000)]
    texts = [row.text for row in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("text").collect()] + ODD + noise
    want = [encoded.ids for encoded in model.encode_batch(texts, add_special_tokens=False)]
    for words in (True, False):
        assert [ids.tolist() for ids in packing.token_ids(pa.array(texts), model.to_str(), words)] == want


def check(rows, texts, capacity):
    """``rows`` are whole: every document's pieces, and sequences without gaps or overlaps."""
    model = Tokenizer.from_file(WORDS)
    want = Counter()
    for doc_id, text in texts:
        ids = np.array(model.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want[doc_id, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = {}
    for row in rows:
        held.setdefault(row.sequence_id, []).append((row.offset, row.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_query_packs_every_document(spark):
    rows = queries()["op11_best_fit_packing"](spark, SF_DIR).collect()
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    number = check(rows, texts, 4096)
    assert number == packing.lower_bound(Counter(r.length for r in rows), 4096)


def test_nulls_empty_long_repeated_and_clashing(spark):
    texts = [(None, None), (1, ""), (1, ""), (2, "word " * 500), (3, None), (None, "a b")] + [(9, "the same text")] * 300 + list(enumerate(ODD, 20))
    table = spark.createDataFrame(
        [(i, text, 1, 2, 3, 4) for i, text in texts], "doc_id long, text string, length int, _number int, _block int, sequence_id int"
    ).repartition(5)
    packed = packing.pack(packing.tokenized(table, WORDS, capacity=16, keep_ids=True), 16)
    rows = packed.collect()
    check(rows, texts, 16)
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for row in rows:
        assert whole[row.sequence_id][row.offset : row.offset + row.length] == row.ids
    assert sum(map(len, whole.values())) == sum(r.length for r in rows)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id string, text string")
    packed = packing.pack(packing.tokenized(none, WORDS))
    assert packed.count() == 0 and dict(packed.dtypes)["doc_id"] == "string"


def test_one_length_is_spread(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ROWS", 16)
    table = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("one length").alias("text")).repartition(3)
    rows = packing.pack(packing.tokenized(table, WORDS, capacity=16), 16).collect()
    assert check(rows, [(i, "one length") for i in range(500)], 16) == 100
