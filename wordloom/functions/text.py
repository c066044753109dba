"""From text to words: normalising, splitting, stopwords.

A word is a maximal run of one class of characters (letters, digits and letter-like numbers, other
numbers, other symbols); white space and punctuation separate words.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The four classes of word characters, disjoint, so their order does not matter.
# ``a-z`` and ``0-9`` are named first only because that test is cheap.
LETTERS = r"[a-z[\p{IsAlphabetic}&&[^\p{Nl}]]\x{200c}\x{200d}]+"
DIGITS = r"[0-9\p{Nd}\p{Nl}]+"
OTHER_NUMBERS = r"\p{No}+"
OTHER_SYMBOLS = r"[^\p{IsAlphabetic}\p{N}\x{200c}\x{200d}\p{P}\p{M}\p{IsWhite_Space}!-/:-@\[-`{-~]+"
WORD = "|".join([LETTERS, DIGITS, OTHER_NUMBERS, OTHER_SYMBOLS])

HANGUL_SYLLABLES = range(0xAC00, 0xD7A4)
SURROGATES = range(0xD800, 0xE000)

# Up to this many stopwords are placed into the plan as values; a longer list is a table that is joined.
MAX_STOPWORDS = 20_000

# The letters that Hangul syllables are made of, in the order of their numbers.
LEADS = "".join(map(chr, range(0x1100, 0x1113)))
VOWELS = "".join(map(chr, range(0x1161, 0x1176)))
TAILS = "".join(map(chr, range(0x11A8, 0x11C3)))


def _is_mark(char: str) -> bool:
    return unicodedata.category(char).startswith("M")


def _bare(text: str) -> str:
    return "".join(char for char in unicodedata.normalize("NFD", text) if not _is_mark(char))


@lru_cache(maxsize=1)
def folding() -> tuple[str, str]:
    """Characters whose canonical decomposition without marks is one other character, and that character."""
    plain, folded = [], []
    for code in range(0x80, sys.maxunicode + 1):
        if code in HANGUL_SYLLABLES or code in SURROGATES:
            continue
        char = chr(code)
        bare = _bare(char)
        if len(bare) == 1 and bare != char:
            plain.append(char)
            folded.append(bare)
    # Lower case must not depend on the place in the word: no final sigma.
    plain.append("Σ")
    folded.append("σ")
    return "".join(plain), "".join(folded)


def _letters_of_syllable(char: Column) -> Column:
    """A Hangul syllable as its two or three letters; any other character as it is."""
    number = F.ascii(char) - HANGUL_SYLLABLES.start
    lead = F.substring(F.lit(LEADS), F.floor(number / 588).cast("int") + 1, F.lit(1))
    vowel = F.substring(F.lit(VOWELS), F.floor(number % 588 / 28).cast("int") + 1, F.lit(1))
    tail = F.when(number % 28 > 0, F.substring(F.lit(TAILS), number % 28, F.lit(1))).otherwise(F.lit(""))
    return F.when(number.between(0, len(HANGUL_SYLLABLES) - 1), F.concat(lead, vowel, tail)).otherwise(char)


def decompose_hangul(text: Column) -> Column:
    """Composed Hangul as decomposed, so that both give equal words. Texts without any stay as they are."""
    has_hangul = text.rlike(f"[{chr(HANGUL_SYLLABLES.start)}-{chr(HANGUL_SYLLABLES.stop - 1)}]")
    letters = F.array_join(F.transform(F.split(text, ""), _letters_of_syllable), "")
    return F.when(has_hangul, letters).otherwise(text)


def normalize(text: Column) -> Column:
    """Accents removed, Hangul decomposed, lower case. Texts of ASCII only take the short way."""
    plain, folded = folding()
    is_ascii = F.octet_length(text) == F.char_length(text)
    unaccented = F.translate(F.regexp_replace(decompose_hangul(text), r"\p{M}+", ""), plain, folded)
    return F.when(is_ascii, F.lower(text)).otherwise(F.lower(unaccented))


def words(text: Column) -> Column:
    """The words of a text in order, as an array."""
    return F.regexp_extract_all(normalize(text), F.lit(WORD), F.lit(0))


def stopword_list(stopwords: DataFrame | Iterable[str] | None, normalize_stopwords: bool = False) -> list[str] | None:
    """Stopwords as a sorted list, from a list or from a table with a column ``word``; None beyond ``MAX_STOPWORDS``.

    Words are compared with normalised words as they are, so an entry with accents never matches
    unless ``normalize_stopwords`` is set.
    """
    if stopwords is None:
        return []
    if isinstance(stopwords, DataFrame):
        rows = stopwords.select("word").distinct().limit(MAX_STOPWORDS + 1).collect()
        stopwords = [row.word for row in rows]
    entries = {word for word in stopwords if word is not None}
    if len(entries) > MAX_STOPWORDS:
        return None
    if normalize_stopwords:
        entries = {_bare(word).replace("Σ", "σ").lower() for word in entries}
    return sorted(entries)


def stopword_table(spark: SparkSession, stopwords: DataFrame | Iterable[str], normalize_stopwords: bool = False) -> DataFrame:
    """The distinct stopwords as a table (word), for lists of any length."""
    if not isinstance(stopwords, DataFrame):
        stopwords = spark.createDataFrame([(word,) for word in stopwords], "word string")
    word = normalize(F.col("word")) if normalize_stopwords else F.col("word")
    return stopwords.where(F.col("word").isNotNull()).select(word.alias("word")).distinct()


def kept_words(text: Column, stopwords: list[str]) -> Column:
    """The words of a text in order, without stopwords."""
    found = words(text)
    if not stopwords:
        return found
    return F.filter(found, lambda word: ~word.isin(stopwords))


def word_arrays(
    texts: DataFrame,
    key: str,
    text: str,
    stopwords: DataFrame | Iterable[str] | None = None,
    normalize_stopwords: bool = False,
) -> DataFrame:
    """(key, _words): the words of each text in order, without stopwords; ``key`` is unique.

    A short list is tested inside the row. A long one is joined with the words, which are then put together again.
    """
    if not isinstance(stopwords, DataFrame) and stopwords is not None:
        stopwords = list(stopwords)
    listed = stopword_list(stopwords, normalize_stopwords)
    if listed is not None:
        return texts.select(key, kept_words(F.col(text), listed).alias("_words"))
    table = stopword_table(texts.sparkSession, stopwords, normalize_stopwords)
    split = texts.select(key, words(F.col(text)).alias("_all"))
    # The outer form keeps a row for a text without words; its null word matches no stopword.
    opened = split.select(key, F.posexplode_outer("_all").alias("position", "word"))
    kept = opened.join(table, "word", "left_anti").groupBy(key)
    placed = kept.agg(F.sort_array(F.collect_list(F.struct("position", "word"))).alias("_placed"))
    some = F.filter("_placed", lambda one: one["word"].isNotNull())
    # A text of stopwords only has no row left, and no postings either.
    return placed.select(key, F.transform(some, lambda one: one["word"]).alias("_words"))
