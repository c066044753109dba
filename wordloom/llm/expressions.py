"""Column expressions and small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.session import shared_folder

WHITE_SPACE = " \t\n\x0b\x0c\r"
SPACED_WORD = r"[^\x20\x09-\x0D]+"
#: Words of letters, digits and everything beyond ASCII.
PLAIN_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column, pattern: str = SPACED_WORD) -> Column:
    """The words of a text in order; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def lower_ascii(words: Column) -> Column:
    """A-Z of each word in lower case, all else as it is; for a word of ASCII only that is what ``lower`` does."""

    def lowered(word: Column) -> Column:
        is_ascii = F.octet_length(word) == F.char_length(word)
        return F.when(is_ascii, F.lower(word)).otherwise(F.translate(word, UPPER, UPPER.lower()))

    return F.transform(words, lowered)


def places(count: Column) -> Column:
    """0 .. count-1, nothing for a count below 1."""
    whole = count.cast("int")
    return F.when(whole > 0, F.sequence(F.lit(0), whole - 1)).otherwise(F.array().cast("array<int>"))


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda so_far, x: so_far + x)


def column(name: str) -> Column:
    """A column by its very name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def with_results(frame: DataFrame, **results: Column) -> DataFrame:
    """All columns of the input, then the results; an input column of a result's name gives way."""
    kept = [column(name) for name in frame.columns if name.lower() not in {key.lower() for key in results}]
    return frame.select(*kept, *[value.alias(name) for name, value in results.items()])


def unused(frame: DataFrame, name: str) -> str:
    """A column name that the input does not have."""
    taken = {column_name.lower() for column_name in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_key(text: Column) -> Column:
    """Tells rows with the same id but other texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def written(frame: DataFrame, **options: str) -> DataFrame:
    """The same rows read from a table in the shared folder, so that nothing before it runs twice."""
    path = shared_folder(frame.sparkSession)
    frame.write.options(**options).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
