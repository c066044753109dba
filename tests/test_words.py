import hashlib
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wordloom.functions import text as text_functions
from wordloom.functions.hashing import bin_of, word_hash, word_hashes
from wordloom.functions.matching import frequency
from wordloom.functions.text import kept_words, stopword_list, words
from wordloom.operators import postings as posting_tables
from wordloom.operators.postings import tokenize

CASES = {
    "abc123 foo_bar don't 3.14": "abc 123 foo bar don t 3 14",
    "€5 $5 a+b a€b": "€ 5 5 a b a € b",
    "x² ½ Ⅷ ① Ⓐ": "x ² ½ ⅷ ① ⓐ",
    "Който най йод София": "които наи иод софия",
    "İstanbul ΣΑΣ Straße ﬁ": "istanbul σασ straße ﬁ",
    "नमस्ते हिन्दी": "नमसत हनद",
    "日本語テスト 中文": "日本語テスト 中文",
    "😀😀a": "😀😀 a",
    "": "",
    "  \n ": "",
    "Éa É é A‍b": "ea e e a‍b",
}


def test_word_definition(spark):
    frame = spark.createDataFrame([(text,) for text in CASES], "text string")
    got = {row.text: " ".join(row.words) for row in frame.select("text", words(F.col("text")).alias("words")).collect()}
    assert got == CASES


def test_words_equal_public_tokenizer(spark):
    tokenizers = pytest.importorskip("tokenizers")
    normalizer = tokenizers.normalizers.Sequence(
        [tokenizers.normalizers.NFD(), tokenizers.normalizers.StripAccents(), tokenizers.normalizers.Lowercase()]
    )
    splitter = tokenizers.pre_tokenizers.Sequence(
        [
            tokenizers.pre_tokenizers.Whitespace(),
            tokenizers.pre_tokenizers.Punctuation(behavior="removed"),
            tokenizers.pre_tokenizers.Digits(individual_digits=False),
        ]
    )
    base = "/root/testdata/sf0.001"
    texts = spark.read.parquet(f"{base}/documents.parquet").select("text").union(
        spark.read.parquet(f"{base}/conversations.parquet").select("text")
    )
    for row in texts.select("text", words(F.col("text")).alias("words")).collect():
        expected = [word for word, _ in splitter.pre_tokenize_str(normalizer.normalize_str(row.text))]
        assert row.words == expected


def test_composed_and_decomposed_hangul_are_equal(spark):
    composed = ["한국", "각 가 힣", "a한b 국!", "漢字 한글 été"]
    frame = spark.createDataFrame([(c, unicodedata.normalize("NFD", c)) for c in composed], "c string, d string")
    for row in frame.select("c", words(F.col("c")).alias("of_c"), words(F.col("d")).alias("of_d")).collect():
        assert row.of_c == row.of_d
        assert "".join(row.of_c) == "".join(x for x in unicodedata.normalize("NFD", row.c) if x.isalpha()).lower()


@pytest.mark.parametrize("as_table", [True, False])
def test_stopword_lists_of_any_length(spark, monkeypatch, as_table):
    texts = spark.createDataFrame([(1, "A the b THE c наи"), (2, "the"), (3, "")], "text_id long, text string")
    listed = ["the", "най"] + [f"x{i}" for i in range(300)]
    stopwords = spark.createDataFrame([(word,) for word in listed + listed], "word string") if as_table else listed
    for normal in (False, True):
        monkeypatch.undo()
        short = sorted(map(tuple, tokenize(texts, stopwords, normal).collect()))
        assert len(short) == (3 if normal else 4)
        monkeypatch.setattr(text_functions, "MAX_STOPWORDS", 10)
        assert stopword_list(stopwords) is None
        assert sorted(map(tuple, tokenize(texts, stopwords, normal).collect())) == short


def test_stopwords_are_dropped_before_numbering(spark):
    texts = spark.createDataFrame([(1, "A the b THE c")], "text_id long, text string")
    got = [(row.position, row.word) for row in tokenize(texts, ["the"]).orderBy("position").collect()]
    assert got == [(0, "a"), (1, "b"), (2, "c")]


def test_stopwords_match_as_they_are_unless_normalised(spark):
    frame = spark.createDataFrame([("най вода",)], "text string")

    def kept(listed):
        return frame.select(kept_words(F.col("text"), listed).alias("w")).first().w

    assert kept(stopword_list(["най"])) == ["наи", "вода"]
    assert kept(stopword_list(["най"], normalize_stopwords=True)) == ["вода"]
    table = spark.createDataFrame([("bg", "вода"), ("en", "вода")], "lang string, word string")
    assert stopword_list(table) == ["вода"]


@pytest.mark.parametrize("bins", [1, 16, 499, 500, 2**30])
def test_bins_take_the_whole_hash(spark, bins):
    frame = spark.range(200).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    frame = frame.union(spark.createDataFrame([("f" * 64,), ("0" * 64,)], "hash string"))
    for row in frame.select("hash", bin_of(F.col("hash"), bins).alias("bin")).collect():
        assert row.bin == int(row.hash, 16) % bins + 1


def test_hashes(spark):
    frame = spark.createDataFrame([("a",), ("наи",), ("a",)], "word string")
    sha = frame.select("word", word_hash(F.col("word")).alias("hash")).collect()
    blake = frame.select("word", word_hash(F.col("word"), "blake2b").alias("hash")).collect()
    assert all(row.hash == hashlib.sha256(row.word.encode()).hexdigest() for row in sha)
    assert all(row.hash == hashlib.blake2b(row.word.encode(), digest_size=32).hexdigest() for row in blake)
    listed = frame.select(word_hashes(F.array("word", F.lit("b")), "blake2b").alias("hashes")).first().hashes
    assert listed == [hashlib.blake2b(word, digest_size=32).hexdigest() for word in (b"a", b"b")]
    with pytest.raises(ValueError):
        word_hash(F.col("word"), "md5")


def test_frequency_rounds_exact_ties(spark):
    assert spark.range(1).select(frequency(F.lit(23), F.lit(320)).alias("f")).first().f == 0.07187


@pytest.mark.parametrize("stretch", [1, 7, 1 << 20])
@pytest.mark.parametrize("digest", ["sha256", "blake2b"])
def test_postings_hash_a_word_of_a_stretch_once(spark, monkeypatch, digest, stretch):
    """F1, F6 to F8: no digest and no bin per posting in the plan; the same postings however texts are cut."""
    monkeypatch.setattr(posting_tables, "STRETCH_WORDS", stretch)
    monkeypatch.setattr(posting_tables, "OUTPUT_ROWS", 2)
    texts = {1: "b a b", 2: "", 3: None, 4: "für a", None: "a", 5: "c b a c b"}
    table = spark.createDataFrame(list(texts.items()), "text_id long, text string").coalesce(1)
    split = [{"text_id": i, "_words": None if text is None else text.replace("ü", "u").split()} for i, text in texts.items()]
    schema = pa.schema({"text_id": pa.int64(), "_words": pa.list_(pa.string())})
    batches = posting_tables._grouped(7, digest)(iter([pa.RecordBatch.from_pylist(split, schema)]))
    found = [tuple(row.values()) for batch in batches for row in batch.to_pylist()]
    want = []
    for text_id, text in texts.items():
        held = (text or "").replace("ü", "u").split()
        for word in set(held):
            value = (hashlib.sha256(word.encode()) if digest == "sha256" else hashlib.blake2b(word.encode(), digest_size=32)).hexdigest()
            want.append((int(value, 16) % 7 + 1, value, text_id, [i for i, one in enumerate(held) if one == word], len(held)))
    assert sorted(found, key=str) == sorted(want, key=str)
    frame = posting_tables.postings(table, 7, digest=digest)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "sha2(" not in plan and "conv(" not in plan and "ArrowEvalPython" not in plan
    assert sorted((tuple(row) for row in frame.collect()), key=str) == sorted(want, key=str)
