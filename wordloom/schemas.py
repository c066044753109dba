"""Schemas of the tables the library reads and writes."""

from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

STAGED_POSTING = StructType(
    [
        StructField("hash", StringType()),
        StructField("text_id", LongType()),
        StructField("positions", ArrayType(IntegerType())),
        StructField("total_words", IntegerType()),
        StructField("batch_id", StringType()),
        StructField("bin", IntegerType()),
    ]
)

POSTING = StructType([field for field in STAGED_POSTING if field.name != "batch_id"])

# Blocks of postings as they are appended: all batches of an epoch in one folder.
APPENDED_BLOCK = StructType(
    [
        StructField("bin", IntegerType()),
        StructField("hash", BinaryType()),
        StructField("text_id", LongType()),
        StructField("held", IntegerType()),
        StructField("packed", BinaryType()),
        StructField("batch_id", StringType()),
        StructField("write", LongType()),
        StructField("generation_timestamp", TimestampType()),
    ]
)

TOUCHED_HASH = StructType(
    [
        StructField("hash", StringType()),
        StructField("generation_timestamp", TimestampType()),
        StructField("batch_id", StringType()),
        StructField("bin", IntegerType()),
    ]
)

VOCABULARY = StructType(
    [
        StructField("hash", StringType()),
        StructField("texts", LongType()),
        StructField("occurrences", LongType()),
        StructField("bin", IntegerType()),
    ]
)

MANIFEST = StructType(
    [
        StructField("version", LongType()),
        StructField("kind", StringType()),
        StructField("batch_id", StringType()),
        StructField("write", LongType()),
        StructField("generation", LongType()),
        StructField("text_generation", LongType()),
        StructField("amount", LongType()),
        StructField("fields", StringType()),
    ]
)

REGISTERED = StructType(
    [
        StructField("batch_id", StringType()),
        StructField("write", LongType()),
        StructField("data_epoch", LongType()),
        StructField("stamp", LongType()),
        StructField("fields", StringType()),
    ]
)

STATE = StructType(
    [
        StructField("texts_total", LongType()),
        StructField("generation_timestamp", TimestampType()),
    ]
)

REQUEST = StructType(
    [
        StructField("query_id", LongType()),
        StructField("request", StringType()),
    ]
)
