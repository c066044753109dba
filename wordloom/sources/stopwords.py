"""Stopword lists: one JSON object {language: [word, ...]}."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType


def read_stopwords(spark: SparkSession, path: str, languages: Sequence[str]) -> DataFrame:
    """(lang, word) of the chosen languages."""
    schema = StructType([StructField(name, ArrayType(StringType())) for name in languages])
    lists = spark.read.schema(schema).json(path, multiLine=True)
    pairs = F.array(*[F.struct(F.lit(name).alias("lang"), F.col(f"`{name}`").alias("words")) for name in languages])
    return (
        lists.select(F.inline(pairs))
        .select("lang", F.explode("words").alias("word"))
        .distinct()
    )
