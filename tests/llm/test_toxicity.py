import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import queries, toxicity

SF_DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    scored = queries.op1_toxicity(spark, SF_DIR)
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50
    assert sum(row.predicted == row.toxic for row in rows) / len(rows) >= 0.9
    assert scored.count() == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()


def test_edges(spark):
    insults = ["you absolute fool", "what a fool he is", "fool! fool!", "nobody likes a fool like you"]
    calm = ["a quiet day in the garden", "the report is due on monday", "she reads a book by the sea", "we met at the station"]
    rows = [(i, text, 7) for i, text in enumerate((insults + calm) * 5)] + [(None, None, 7), (900, "", 7), (901, "Fool " * 300_000, 7), (902, " \n", 7)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, score int")
    labels = [(i, int(i % 8 < 4)) for i in range(40)] + [(None, 1), (3, None), (3, 0), (5000, 1)]
    model = toxicity.learn(documents, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    got = toxicity.toxicity(documents, model).collect()
    assert len(got) == len(rows) and all(0 <= row.score <= 1 for row in got)
    by_text = {}
    for row in got:
        assert by_text.setdefault(row.text, row.score) == row.score
    assert all(by_text[text] > 0.5 for text in insults) and all(by_text[text] < 0.5 for text in calm)
    assert by_text[None] == by_text[""] and by_text["Fool " * 300_000] > 0.5
    assert toxicity.toxicity(documents.limit(0), model).count() == 0


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(1, 1)]])
def test_labels_of_one_class_or_none(spark, labels):
    documents = spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id bigint, text string")
    model = toxicity.learn(documents, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    scores = {row.score for row in toxicity.toxicity(documents, model).collect()}
    assert len(scores) == 1


def test_learning_never_sees_what_is_held_out(spark):
    ids = spark.range(2000)
    out = {row.id for row in ids.where(toxicity.held_out(F.col("id"))).collect()}
    documents = ids.select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    flipped = [ids.select(F.col("id").alias("doc_id"), F.when(toxicity.held_out(F.col("id")), flag).otherwise(F.col("id") % 2).cast("int").alias("toxic")) for flag in (0, 1)]
    models = [toxicity.learn(documents, labels) for labels in flipped]
    assert 300 < len(out) < 500
    assert models[0].bias == models[1].bias and np.array_equal(models[0].weights, models[1].weights)


def test_pieces_of_long_texts_lose_no_ngram(monkeypatch):
    text = "The quick brown fox jumps over the lazy dog, again and again." * 5
    whole = toxicity.present(text, np.ones(1 << toxicity.HASH_BITS, dtype=bool))
    monkeypatch.setattr(toxicity, "PIECE", 17)
    assert np.array_equal(whole, toxicity.present(text, np.ones(1 << toxicity.HASH_BITS, dtype=bool)))
