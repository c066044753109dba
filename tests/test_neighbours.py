import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from brute import answers, ranked
from pyspark.sql import functions as F

from wordloom.operators import marks, neighbours
from wordloom.operators import search as find
from wordloom.operators.postings import postings
from wordloom.operators.requests import request_sequences

BINS = 5


def random_texts(seed):
    chooser = random.Random(seed)
    letters = [f"q{chr(97 + i)}" for i in range(9)]
    texts = {i: " ".join(chooser.choices(letters, k=chooser.randint(0, 30))) for i in range(80)}
    requests = {i: " ".join(chooser.choices(letters, k=chooser.randint(1, 4))) for i in range(120)}
    return texts, requests


@pytest.mark.parametrize("most", [1 << 29, 1 << 15])
def test_a_bitmap_keeps_every_key(spark, monkeypatch, most):
    monkeypatch.setattr(marks, "MAX_BITS", most)
    key = F.xxhash64("id")
    keys, table = spark.range(0, 3000, 3), spark.range(3000).union(spark.createDataFrame([(None,)], "id long"))
    kept = {row.id for row in marks.thinned(table, key, keys, key, 1000).collect()}
    assert kept >= set(range(0, 3000, 3)) and None not in kept
    assert len(kept) < (1100 if most > 1 << 20 else 1300)
    hashed = table.where("id IS NOT NULL").select("id", key.alias("key")).toPandas()
    found = marks.is_marked(marks.marks(keys, key, 1000), hashed.key.to_numpy())
    assert set(hashed.id[found]) == kept


def test_packed_postings_come_back():
    chooser = np.random.default_rng(3)
    words = np.repeat(chooser.integers(-(2**63), 2**63 - 1, 40), chooser.integers(1, 9, 40))
    ids = chooser.integers(-(2**40), 2**62, len(words))
    totals, counts = chooser.integers(1, 2**31 - 1, len(words)), chooser.integers(0, 4, len(words))
    spots = chooser.integers(0, 2**31 - 1, counts.sum())
    back = neighbours._unpack(*neighbours._pack(words, ids, totals, counts, spots))
    for got, want in zip(back, (words, ids, totals, counts, spots), strict=True):
        assert got.tolist() == want.tolist()


def test_pairs_equal_brute_force_with_null_and_repeated_ids(spark):
    rows = [(1, "a b a b c"), (1, "b b c"), (2, "a b"), (2, "a b"), (None, "a b a"), (None, "c"), (-7, "b a b"), (4, None), (5, "")]
    table = spark.createDataFrame(rows, "text_id long, text string")
    words = postings(table, BINS).select(find._word(F.col("hash")).alias("word"), "text_id", "total_words", "positions")
    held = {}
    for text_id, text in rows:
        for position, word in enumerate((text or "").split()):
            held.setdefault(text_id, {}).setdefault(position, set()).add(word)
    want = sorted(
        (str(text_id), word, behind, position)
        for text_id, places in held.items()
        for position, at in places.items()
        for word in at
        for behind in places.get(position + 1, ())
    )
    names = spark.createDataFrame([(x,) for x in "abc"], "name string").select(find._word(F.sha2("name", 256)).alias("word"), "name")
    pairs = names.select("word").crossJoin(names.select(F.col("word").alias("next")))
    a, b = (find._word(F.sha2(F.lit(name), 256)) for name in "ab")
    pairs = pairs.withColumn("n", F.when((F.col("word") == a) & (F.col("next") == b), 3).otherwise(2))
    found = neighbours.adjacent_words(words, 100, pairs)
    named = found.join(names, "word").join(names.select(F.col("word").alias("next"), F.col("name").alias("behind")), "next").collect()
    assert sorted((str(row.text_id), row.name, row.behind, row.position) for row in named) == want
    counts = Counter((text_id, word, behind) for text_id, word, behind, _ in want)
    assert all(row.hits == counts[str(row.text_id), row.name, row.behind] for row in named)
    assert Counter((str(row.text_id), row.name, row.behind) for row in named if row.is_first) == Counter(set(counts))
    assert all(row.is_longer == (row.name + row.behind == "ab") for row in named)
    assert {(row.text_id, row.total_words) for row in named} == {(1, 5), (2, 2), (None, 3), (-7, 3)}


def test_a_task_deals_its_postings_in_pieces(monkeypatch):
    monkeypatch.setattr(neighbours, "DEALT_POSTINGS", 4)
    names = ["_group", "word", "text_id", "total_words", "positions"]
    columns = [[0, 1, 0], [8, 8, 9], [5, None, 7], [3, 4, 5], [[0, 2], [1], None]]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32())]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
    dealt = list(neighbours._deal(iter([batch, batch.slice(0, 0), batch, batch])))
    assert [piece.column(0).to_pylist() for piece in dealt] == [[-2, 0], [-2, 0]]
    rows = [neighbours._unpack(row["_size"], row["_packed"]) for row in dealt[0].to_pylist()]
    assert [[column.tolist() for column in row] for row in rows] == [
        [[8, 8], [0, 0], [4, 4], [1, 1], [1, 1]],
        [[8, 9, 8, 9], [5, 7, 5, 7], [3, 5, 3, 5], [2, 0, 2, 0], [0, 2, 0, 2]],
    ]


@pytest.mark.parametrize("mode", ["run", "exact"])
def test_requests_beyond_every_bound_do_not_shuffle_the_index(spark, monkeypatch, mode):
    """the index was shuffled once for each use, and its words once more, where requests are too many to be sent."""
    texts, requests = random_texts(5)
    table = spark.createDataFrame(list(texts.items()), "text_id long, text string")
    sequences = request_sequences(spark.createDataFrame(list(requests.items()), "query_id long, request string"))
    index = postings(table, BINS).persist()
    for name in ("MAX_PINNED", "MAX_BROADCAST_ROWS", "MAX_BROADCAST_WORDS"):
        monkeypatch.setattr(find, name, 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        chosen = find.RequestSet(sequences, BINS)
        assert not chosen.small and not chosen.few
        held = chosen(index)
        plan = held._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert held.count() == index.join(chosen.wanted, "hash", "left_semi").count()
        starts = find._phrase_starts(index, chosen.part(False))._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in starts and "LeftSemi" not in starts
        best = find._phrase_starts(index, chosen.part(False), 3)
        plan = best._jdf.queryExecution().executedPlan().toString()
        assert plan.index("WindowGroupLimit") < plan.rindex("WindowGroupLimit")  # also before the shuffle
        want = answers(texts, requests, "exact")
        firsts = {words: query_id for query_id, words in sorted(requests.items(), reverse=True) if len(words.split()) == 2}
        longer = {tuple(words.split()[:2]) for words in requests.values() if len(words.split()) > 2}
        for words, query_id in firsts.items():
            held = sorted(row.text_id for row in best.where(f"seq_id = {query_id}").collect()) if query_id < 30 else None
            top = ranked(want, 10**6 if tuple(words.split()) in longer else 3).get(query_id, [])
            assert held is None or held == sorted(top)
        top = find.search_hits(index, sequences, BINS, 3, mode).orderBy("query_id", "rank").collect()
        of_query = {}
        for row in top:
            of_query.setdefault(row.query_id, []).append(row.text_id)
        assert of_query == ranked(answers(texts, requests, mode), 3)
        found = {}
        for row in find.search_hits(index, sequences, BINS, 10**6, mode).collect():
            found.setdefault(row.query_id, {})[row.text_id] = (row.hits, row.matching_words, row.total_words, row.matching_words_frequency)
        assert found == answers(texts, requests, mode)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        index.unpersist()


def test_a_request_that_comes_twice_is_matched_once(spark, monkeypatch):
    table = spark.createDataFrame([(1, "a b a b c"), (2, "a b")], "text_id long, text string")
    asked = spark.createDataFrame([(1, "a b"), (2, "a b c"), (1, "a b"), (2, "a b c")], "query_id long, request string")
    monkeypatch.setattr(find, "MAX_PINNED", 0)
    chosen = find.RequestSet(request_sequences(asked), BINS)
    hits = find._hits_of_many(postings(table, BINS), chosen, 10, "exact").collect()
    assert sorted((row.seq_id, row.text_id, row.hits) for row in hits) == [(1, 1, 2), (1, 2, 1), (2, 1, 1)]
