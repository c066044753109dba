import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from wordloom.sources import corpus as corpora
from wordloom.sources.corpus import batch_counts, batch_slice, number_rows, prepare, read_corpus
from wordloom.sources.state import BEGINNING, read_state, write_state
from wordloom.sources.stopwords import read_stopwords


def corpus(spark):
    """Keys in clumps, so that equal spans of keys hold very different numbers of rows."""
    keys = F.when(F.col("id") < 900, F.col("id")).otherwise(F.col("id") * 1_000_003)
    languages = F.element_at(F.array(*[F.lit(x) for x in ("en", "bg", "fr")]), (F.col("id") % 3 + 1).cast("int"))
    return spark.range(0, 1000, 1, 5).select(keys.alias("key"), languages.alias("lang"), F.lit("x").alias("body"))


def test_numbers_are_consecutive_in_key_order(spark):
    for ranges in (1, 2, 7, 50):
        rows = number_rows(corpus(spark).repartition(3), "key", ranges=ranges).orderBy("key").collect()
        assert [row.row_no for row in rows] == list(range(1, 1001))


def test_slice_counts_all_languages(spark):
    rows = batch_slice(corpus(spark), "key", 150, 2, 6).orderBy("key").collect()
    assert len(rows) == 750 and rows[0].key == 150
    assert [row.batch_no for row in rows] == [2 + i // 150 for i in range(750)]
    assert batch_slice(corpus(spark), "key", 150, 7, 9).count() == 100
    assert batch_slice(corpus(spark), "key", 150, 8, 9).count() == 0


def test_slice_leaves_other_ranges_out_of_the_scan(spark, tmp_path):
    corpus(spark).write.parquet(str(tmp_path / "c"))
    sliced = batch_slice(spark.read.parquet(str(tmp_path / "c")), "key", 150, 2, 3)
    plan = sliced._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(key" in plan and "GreaterThanOrEqual(key" in plan


@pytest.mark.parametrize("key", ["id + 9007199254740992", "id * 4503599627370497 + 7", "concat('k', lpad(id, 6, '0'))", "cast(id as decimal(30, 2))"])
def test_keys_of_any_size_and_type_lose_no_row(spark, tmp_path, key):
    spark.range(0, 2000, 1, 7).selectExpr(f"{key} AS key", "id").write.parquet(str(tmp_path / "c"))
    stored = spark.read.parquet(str(tmp_path / "c"))
    parts = [batch_slice(stored, "key", 100, first, first + 4) for first in range(1, 21, 5)]
    rows = [row for part in parts for row in part.collect()]
    assert sorted((row.id, row.batch_no) for row in rows) == [(i, i // 100 + 1) for i in range(2000)]


def test_rows_without_a_key_are_numbered_by_their_place(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpora, "PIECE_ROWS", 64)
    spark.range(0, 1000, 1, 5).selectExpr("id", "if(id % 3 = 0, 'bg', 'en') AS lang", "'x' AS body").write.parquet(str(tmp_path / "c"))
    stored = read_corpus(spark, str(tmp_path / "c"))
    rows = number_rows(stored).collect()
    assert sorted(row.row_no for row in rows) == list(range(1, 1001))
    by_number = [row.id for row in sorted(rows, key=lambda row: row.row_no)]
    assert sum(b != a + 1 for a, b in zip(by_number, by_number[1:])) <= 4  # in order inside each file
    sliced = batch_slice(stored, None, 150, 2, 3).collect()
    assert sorted(row.id for row in sliced) == sorted(by_number[150:450]) and {row.batch_no for row in sliced} == {2, 3}
    texts = prepare(stored, None, ("bg",), {"body": "text", "id": "id"}, start=5)
    assert sorted(row.text_id for row in texts.collect()) == list(range(5, 5 + 334))
    with pytest.raises(ValueError):
        number_rows(spark.range(5))


def test_keys_must_be_unique(spark):
    for frame in (spark.sql("SELECT 1 AS key UNION ALL SELECT 1"), spark.sql("SELECT 1 AS key UNION ALL SELECT NULL")):
        with pytest.raises(ValueError):
            number_rows(frame, "key")


def test_prepare_numbers_kept_rows_only(spark):
    texts = prepare(corpus(spark), "key", ("bg", "en"), {"key": "title", "body": "text"}, start=11)
    rows = texts.orderBy("text_id").collect()
    assert texts.columns == ["text_id", "title", "text"]
    assert [row.text_id for row in rows] == list(range(11, 11 + len(rows))) and len(rows) == 667
    assert [row.title for row in rows] == sorted(row.title for row in rows)
    kept = prepare(corpus(spark), "key", ("bg",), {"body": "text"}, keep_ids=True)
    assert kept.agg(F.min("text_id")).first()[0] == 1


def test_counts(spark):
    batches = batch_slice(corpus(spark), "key", 300, 1, 4)
    for block in (1, 2, 1000):
        rows = batch_counts(batches, ("bg", "en"), previous=5, block=block).orderBy("batch_no").collect()
        assert [tuple(row) for row in rows] == [(1, 200, 200, 205), (2, 200, 400, 405), (3, 200, 600, 605), (4, 67, 667, 672)]


def test_corpus_of_few_files_is_spread(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    assert read_corpus(spark, path).rdd.getNumPartitions() == 1
    assert read_corpus(spark, path, key="doc_id").rdd.getNumPartitions() == 4


def test_stopwords_of_chosen_languages(spark, tmp_path):
    path = tmp_path / "stopwords.json"
    path.write_text(json.dumps({"bg": ["и", "на"], "en": ["the", "the"], "fr": ["le"]}, indent=2))
    rows = {tuple(row) for row in read_stopwords(spark, str(path), ["bg", "en"]).collect()}
    assert rows == {("bg", "и"), ("bg", "на"), ("en", "the")}


def test_state(spark, tmp_path):
    path = str(tmp_path / "state")
    before = datetime.now(timezone.utc)
    total, stamp = read_state(spark, path)
    assert total == 0 and before <= stamp <= datetime.now(timezone.utc)
    assert read_state(spark, path, BEGINNING) == (0, BEGINNING)
    first = datetime(2026, 1, 2, 3, 4, 5, 678901, tzinfo=timezone.utc)
    write_state(spark, path, 10, first)
    write_state(spark, path, 7, first - timedelta(days=1))
    assert read_state(spark, path) == (10, first)
