"""Search requests as word hashes. Requests are a table (query_id, request); query_id is unique."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions.hashing import word_hashes
from wordloom.functions.text import word_arrays
from wordloom.operators.postings import Stopwords


def request_sequences(
    requests: DataFrame,
    stopwords: Stopwords = None,
    normalize_stopwords: bool = False,
    digest: str = "sha256",
) -> DataFrame:
    """(query_id, hashes): the words of each request as one array, order and duplicates kept."""
    split = word_arrays(requests, "query_id", "request", stopwords, normalize_stopwords)
    return split.select("query_id", word_hashes(F.col("_words"), digest).alias("hashes"))


def request_words(sequences: DataFrame) -> DataFrame:
    """(query_id, ord, hash, alias, n, k): one row per request word.

    alias numbers the distinct words by first use, n counts all words, k the distinct ones.
    """
    known = sequences.select(
        "query_id",
        F.array_distinct("hashes").alias("_distinct"),
        F.size("hashes").alias("n"),
        "hashes",
    )
    return (
        known.select("query_id", "_distinct", "n", F.posexplode_outer("hashes").alias("ord", "hash"))
        .where(F.col("hash").isNotNull())
        .select(
            "query_id",
            "ord",
            "hash",
            (F.array_position("_distinct", F.col("hash")) - 1).cast("int").alias("alias"),
            "n",
            F.size("_distinct").alias("k"),
        )
    )
