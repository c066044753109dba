import random

import pytest
from brute import answers, ranked
from pyspark.sql import functions as F

from wordloom.operators import search as find
from wordloom.operators.postings import postings, vocabulary
from wordloom.operators.requests import request_sequences, request_words

BINS = 5

# text, request, hits in run mode, hits in exact mode, total words
PHRASE_CASES = [
    ("x a b y", "a b", 1, 1, 4),
    ("a b a b", "a b", 1, 2, 4),
    ("b a b a", "a b", 0, 1, 4),
    ("b a b", "a b", 1, 1, 3),
    ("a a b", "a b", 1, 1, 3),
    ("a x b", "a b", 0, 0, 3),
    ("a b x a b", "a b", 2, 2, 5),
    ("a the b", "a b", 1, 1, 2),
    ("a a a", "a a", 1, 2, 3),
    ("a b", "a zzz", 0, 0, 2),
    ("a b", "the", 0, 0, 2),
    ("a x a", "a", 2, 2, 3),
]


def frames(spark, texts, requests, stopwords=()):
    text_table = spark.createDataFrame(list(texts.items()), "text_id long, text string")
    request_table = spark.createDataFrame(list(requests.items()), "query_id long, request string")
    index = postings(text_table, BINS, stopwords).persist()
    return text_table, index, request_table


def hits_of(frame):
    found = {}
    for row in frame.collect():
        score = (row.hits, row.matching_words, row.total_words, row.matching_words_frequency)
        found.setdefault(row.query_id, {})[row.text_id] = score
    return found


@pytest.mark.parametrize("mode", ["run", "exact"])
def test_phrase_cases(spark, mode):
    for number, (text, request, run, exact, total) in enumerate(PHRASE_CASES):
        want = run if mode == "run" else exact
        got = answers({number: text}, {0: request}, mode, ["the"])
        assert got.get(0, {}).get(number, (0,))[0] == want
    texts = {number: case[0] for number, case in enumerate(PHRASE_CASES)}
    requests = {number: case[1] for number, case in enumerate(PHRASE_CASES)}
    _, index, asked = frames(spark, texts, requests, ["the"])
    got = hits_of(find.search_hits(index, request_sequences(asked, ["the"]), BINS, 1000, mode))
    for number, (_, request, run, exact, total) in enumerate(PHRASE_CASES):
        want = run if mode == "run" else exact
        score = got.get(number, {}).get(number)
        assert (score[0] if score else 0) == want
        assert score is None or score[2] == total
    assert got == answers(texts, requests, mode, ["the"])


def random_corpus(seed):
    chooser = random.Random(seed)
    alphabet = [f"w{chr(97 + i)}" for i in range(14)]
    weights = [30] + [6] * 5 + [1] * 8
    texts = {
        100 + i: " ".join(chooser.choices(alphabet, weights, k=chooser.randint(0, 60))) for i in range(120)
    }
    requests = {
        i: " ".join(chooser.choices(alphabet, weights, k=chooser.choice([1, 1, 2, 2, 3, 4, 12]))) for i in range(60)
    }
    requests[60] = requests[61] = requests[3]
    requests[62], requests[63], requests[64] = "", "wa absent", "the"
    return texts, requests


@pytest.mark.parametrize("mode", ["run", "exact"])
@pytest.mark.parametrize("limits", ["usual", "joined", "wide", "unbounded"])
def test_equals_brute_force_on_every_path(spark, monkeypatch, mode, limits):
    if limits == "joined":
        monkeypatch.setattr(find, "MAX_LITERALS", 0)
    if limits == "unbounded":
        for name in ("MAX_LITERALS", "MAX_PINNED", "MAX_BROADCAST_ROWS", "MAX_CANDIDATES"):
            monkeypatch.setattr(find, name, 0)
    if limits == "wide":
        for name in ("MAX_PINNED_WORDS", "MAX_BROADCAST_WORDS"):
            monkeypatch.setattr(find, name, 10)
    texts, requests = random_corpus(7)
    _, index, asked = frames(spark, texts, requests, ["the"])
    sequences = request_sequences(asked, ["the"])
    want = answers(texts, requests, mode, ["the"])
    known = vocabulary(index) if limits != "joined" else None
    assert hits_of(find.search_hits(index, sequences, BINS, 10**6, mode, known)) == want
    top = find.search_hits(index, sequences, BINS, 5, mode, known).orderBy("query_id", "rank").collect()
    got = {}
    for row in top:
        got.setdefault(row.query_id, []).append(row.text_id)
        assert row.rank == len(got[row.query_id])
    assert got == ranked(want, 5)


@pytest.mark.parametrize("most", [find.MAX_CANDIDATES, 0])
def test_candidates_beyond_the_bound_are_not_broadcast(spark, monkeypatch, most):
    monkeypatch.setattr(find, "MAX_CANDIDATES", most)
    texts = {i: "common word here" for i in range(50)} | {1000: "common rare word"}
    requests = {1: "common rare"}
    _, index, asked = frames(spark, texts, requests)
    got = find.search_hits(index, request_sequences(asked), BINS, 10, "run", vocabulary(index))
    assert hits_of(got) == answers(texts, requests, "run")


def test_words_are_settled_without_positions_and_single_words_without_a_shuffle_of_texts(spark, tmp_path):
    texts, requests = random_corpus(5)
    _, index, asked = frames(spark, texts, requests)
    index.write.partitionBy("bin").parquet(str(tmp_path / "index"))
    stored = spark.read.schema(index.schema).parquet(str(tmp_path / "index"))
    sequences = request_sequences(asked)
    plan = lambda frame: frame._jdf.queryExecution().executedPlan().toString()
    assert "positions" not in plan(find.all_words_filter(stored, sequences, BINS))
    single = find.single_word_search(stored, sequences, BINS)
    assert "hashpartitioning(text_id" not in plan(single)
    assert set(hits_of(single)) == {i for i, words in requests.items() if len(words.split()) == 1 and i in answers(texts, requests, "run")}


def test_rare_words_thin_out_common_ones(spark):
    texts = {i: "common word here" for i in range(300)} | {1000: "common rare word", 1001: "rare common"}
    requests = {1: "common rare", 2: "rare common"}
    _, index, asked = frames(spark, texts, requests)
    got = find.search_hits(index, request_sequences(asked), BINS, 10, "run", vocabulary(index))
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()
    assert hits_of(got) == answers(texts, requests, "run")


def test_single_and_multi_split_requests_by_length(spark):
    texts, requests = {1: "a b a", 2: "b"}, {1: "a", 2: "a b", 3: "b b"}
    _, index, asked = frames(spark, texts, requests)
    sequences = request_sequences(asked)
    assert set(hits_of(find.single_word_search(index, sequences, BINS))) == {1}
    assert set(hits_of(find.multi_word_search(index, sequences, BINS))) == {2}
    assert set(hits_of(find.phrase_search(index, sequences, BINS))) == {1, 2}


def test_lookup_needs_every_word(spark):
    texts, requests = {1: "a b a", 2: "b c"}, {1: "a c", 2: "a zzz", 3: "b a b"}
    _, index, asked = frames(spark, texts, requests)
    sequences = request_sequences(asked)
    rows = find.posting_lookup(index, sequences, BINS).collect()
    assert sorted((r.query_id, r.alias, r.text_id, tuple(r.positions)) for r in rows) == [
        (1, 0, 1, (0, 2)),
        (1, 1, 2, (1,)),
        (3, 0, 1, (1,)),
        (3, 0, 2, (0,)),
        (3, 1, 1, (0, 2)),
    ]
    held = find.all_words_filter(index, sequences, BINS).collect()
    assert sorted(tuple(row) for row in held) == [(3, 1, 3)]
    words = request_words(sequences).where("query_id = 3").orderBy("ord").collect()
    assert [(row.ord, row.alias, row.n, row.k) for row in words] == [(0, 0, 3, 2), (1, 1, 3, 2), (2, 0, 3, 2)]


def test_result_does_not_depend_on_bins_or_digest(spark):
    texts, requests = random_corpus(3)
    table = spark.createDataFrame(list(texts.items()), "text_id long, text string")
    asked = spark.createDataFrame(list(requests.items()), "query_id long, request string")
    want = answers(texts, requests, "run")
    for bins, digest in ((1, "sha256"), (64, "blake2b")):
        index = postings(table.repartition(3), bins, digest=digest)
        sequences = request_sequences(asked, digest=digest)
        assert hits_of(find.search_hits(index, sequences, bins, 10**6)) == want


@pytest.mark.parametrize("most", [find.MAX_RESULTS, 0])
def test_texts_are_joined_in_order_with_all_or_nothing(spark, monkeypatch, most):
    monkeypatch.setattr(find, "MAX_RESULTS", most)
    texts, requests = {1: "a b", 2: "a b c", 3: "c"}, {1: "a b", 2: "c"}
    table, index, asked = frames(spark, texts, requests)
    stored = table.withColumn("title", F.lit("t")).select("text_id", "title", "text").where("text_id <> 2")
    found = find.search(index, stored, asked, BINS)
    assert found.columns == ["query_id", "rank", *find.HIT_COLUMNS, "text_id", "title", "text"]
    assert sorted((row.query_id, row.text_id, row.text) for row in found.collect()) == [(1, 1, "a b"), (2, 3, "c")]
    assert find.search(index, stored, asked, BINS, require_all=True).count() == 0
    hits = find.search_hits(index, request_sequences(asked), BINS)
    assert sorted(tuple(row) for row in find.missing_texts(hits, stored).collect()) == [(1, 2), (2, 2)]


def test_summary_names_requests_without_match(spark):
    texts, requests = {1: "a b"}, {1: "a", 2: "zzz", 3: "the"}
    _, index, asked = frames(spark, texts, requests, ["the"])
    hits = find.search_hits(index, request_sequences(asked, ["the"]), BINS)
    rows = {row.query_id: (row.results, row.matched, row.message) for row in find.search_summary(asked, hits).collect()}
    nothing = (0, False, "No matching texts were found.")
    assert rows == {1: (1, True, None), 2: nothing, 3: nothing}


def stored_texts_of(spark, texts, buckets, path):
    table = spark.createDataFrame([(i, "t", text, i % buckets) for i, text in texts.items()], "text_id long, title string, text string, text_bucket int")
    table.write.partitionBy("text_bucket").parquet(path)
    return spark.read.schema("text_id long, title string, text string, text_bucket int").parquet(path)


@pytest.mark.parametrize("stretch", [40, 1])
def test_many_results_are_ranked_once_and_texts_stay(spark, monkeypatch, tmp_path, stretch):
    texts, requests = random_corpus(11)
    _, index, asked = frames(spark, texts, requests)
    stored = stored_texts_of(spark, texts, 6, str(tmp_path / "texts"))
    want = sorted(map(str, find.search(index, stored, asked, BINS, text_buckets=6).collect()))
    monkeypatch.setattr(find, "MAX_RESULTS", 100)
    monkeypatch.setattr(find, "MAX_BROADCAST_RESULTS", stretch)
    for require_all in (False, True):
        found = find.search(index, stored, asked, BINS, text_buckets=6, require_all=require_all)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan  # the stored ranking is read
        if stretch > 1 and not require_all:  # completeness is settled by ids, which are shuffled
            assert "SortMergeJoin" not in plan and "hashpartitioning(text_id" not in plan and "hashpartitioning(_id" not in plan
        assert sorted(map(str, found.collect())) == want
    assert len(want) > 100
    fewer = stored.where("text_id % 10 <> 3")
    hits = find.search_hits(index, request_sequences(asked), BINS, 10)
    ranked_hits = [(row.query_id, row.text_id) for row in hits.collect()]
    gone = sorted(hit for hit in ranked_hits if hit[1] % 10 == 3)
    assert gone and sorted(tuple(row) for row in find.missing_texts(hits, fewer, 6).collect()) == gone
    whole = find.read_texts(hits, fewer, 6, require_all=True)
    lacking = {query_id for query_id, _ in gone}
    assert sorted((row.query_id, row.text_id) for row in whole.collect()) == sorted(hit for hit in ranked_hits if hit[0] not in lacking)


@pytest.mark.parametrize("sent", [10**6, 0])
def test_hot_rarest_word_is_cut_into_blocks(spark, monkeypatch, sent):
    chooser = random.Random(4)
    letters = [f"q{chr(97 + i)}" for i in range(12)]
    # The one word of all requests is in every third text; all others are in more.
    texts = {i: " ".join(chooser.sample(letters, 10) + ["hot"] * (i % 3 == 0)) for i in range(90)}
    requests = {i: " ".join(["hot", *chooser.sample(letters, chooser.randint(1, 4))]) for i in range(200)}
    _, index, asked = frames(spark, texts, requests)
    want = answers(texts, requests, "exact")
    monkeypatch.setattr(find, "MAX_PINNED", 0)
    monkeypatch.setattr(find, "MAX_BROADCAST_WORDS", 0)
    monkeypatch.setattr(find, "MAX_BROADCAST_ROWS", sent)
    monkeypatch.setattr(find, "BLOCK_PAIRS", 64)
    found = find.search_hits(index, request_sequences(asked), BINS, 10**6, "exact", vocabulary(index))
    assert hits_of(found) == want
    held = find.all_words_filter(index, request_sequences(asked), BINS).collect()
    assert {(row.query_id, row.text_id) for row in held} == {
        (query_id, text_id) for query_id, words in requests.items() for text_id, text in texts.items() if set(words.split()) <= set(text.split())
    }


def test_requests_that_share_a_rarest_word_are_spread(spark, monkeypatch):
    monkeypatch.setattr(find, "BLOCK_PAIRS", 1 << 18)
    word = find._word(F.lit("hot"))
    held = spark.range(20).select(F.col("id").alias("text_id"), word.alias("driver"))
    requests = spark.range(300_000).select(word.alias("driver"), F.col("id").alias("seq_id"))
    drivers = spark.range(300_000).select(F.lit("hot").alias("driver"), F.lit(20).cast("bigint").alias("driver_texts"))
    pairs = find._pairs_in_blocks(held, requests, drivers)
    loads = [row["count"] for row in pairs.groupBy("_text_blocks_at", "_request_blocks_at").count().collect()]
    assert sum(loads) == 300_000 * 20 and len(loads) >= 20 and max(loads) < 1.5 * sum(loads) / len(loads)


def test_many_requests_meet_texts_by_neighbouring_words(spark, monkeypatch):
    """every text holds the words of every request, few hold them side by side."""
    chooser = random.Random(8)
    letters = [f"q{chr(97 + i)}" for i in range(9)]
    texts = {i: " ".join(chooser.sample(letters, 9) + chooser.choices(letters, k=4)) for i in range(60)}
    requests = {i: " ".join(chooser.choices(letters, k=chooser.randint(1, 4))) for i in range(150)}
    _, index, asked = frames(spark, texts, requests)
    monkeypatch.setattr(find, "MAX_PINNED", 0)
    sequences = request_sequences(asked)
    chosen = find.RequestSet(sequences, BINS).part(False)
    starts = find._phrase_starts(index, chosen).count()
    side_by_side = sum(
        words[:2] == words_of_text[i : i + 2]
        for words in {tuple(request.split()) for request in requests.values()}
        if len(words) > 1
        for words_of_text in (tuple(text.split()) for text in texts.values())
        for i in range(len(words_of_text))
    )
    assert starts == side_by_side
    for mode in ("run", "exact"):
        found = find.search_hits(index, sequences, BINS, 10**6, mode)
        assert "array_except" not in found._jdf.queryExecution().executedPlan().toString()
        assert hits_of(found) == answers(texts, requests, mode)


@pytest.mark.parametrize("mode", ["run", "exact"])
def test_many_requests_on_a_text_indexed_twice(spark, monkeypatch, mode):
    """Two texts of one id and one text that comes twice, as the pinned path answers them."""
    rows = [(1, "a b a b c"), (1, "b b c"), (2, "a b"), (2, "a b"), (3, "a"), (4, None)]
    table = spark.createDataFrame(rows, "text_id long, text string")
    asked = spark.createDataFrame([(1, "a b"), (2, "b b"), (3, "a b a"), (4, "b c"), (5, "c"), (6, "a b")], "query_id long, request string")
    index = postings(table, BINS)
    # A word that stands alone is a posting of its own, so only requests of several words are one row a text.
    sequences = request_sequences(asked.where("query_id <> 5"))
    want = hits_of(find.search_hits(index, sequences, BINS, 10**6, mode))
    monkeypatch.setattr(find, "MAX_PINNED", 0)
    assert want and hits_of(find.search_hits(index, sequences, BINS, 10**6, mode)) == want
