"""Word hashes and the bins they belong to."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

DIGESTS = ("sha256", "blake2b")

HEX_DIGITS = 64
LIMB_DIGITS = 15
MAX_BINS = 2**30


def _blake2b(word: str) -> str:
    return hashlib.blake2b(word.encode(), digest_size=32).hexdigest()


@F.pandas_udf(StringType())
def _blake2b_word(column: pd.Series) -> pd.Series:
    # Each word of an Arrow batch is hashed once.
    digests = {word: _blake2b(word) for word in column.dropna().unique()}
    return column.map(digests)


@F.pandas_udf(ArrayType(StringType()))
def _blake2b_list(column: pd.Series) -> pd.Series:
    return column.map(lambda entries: None if entries is None else [_blake2b(word) for word in entries])


def check_digest(digest: str) -> None:
    if digest not in DIGESTS:
        raise ValueError(f"digest must be one of {DIGESTS}")


def check_bins(bins: int) -> None:
    if not 1 <= bins <= MAX_BINS:
        raise ValueError(f"bins must lie in 1..{MAX_BINS}")


def hex_digests(words: list[bytes], digest: str) -> list[str]:
    """64 hex digits per word, inside a task."""
    if digest == "sha256":
        return [hashlib.sha256(word).hexdigest() for word in words]
    return [hashlib.blake2b(word, digest_size=32).hexdigest() for word in words]


def word_hash(word: Column, digest: str = "sha256") -> Column:
    """64 hex digits per word. The default stays in the JVM."""
    check_digest(digest)
    return F.sha2(word, 256) if digest == "sha256" else _blake2b_word(word)


def word_hashes(words: Column, digest: str = "sha256") -> Column:
    """Hashes of an array of words, in order, duplicates kept."""
    check_digest(digest)
    return F.transform(words, lambda word: F.sha2(word, 256)) if digest == "sha256" else _blake2b_list(words)


def bin_of(hash_hex: Column, bins: int) -> Column:
    """``1 + hash mod bins`` over all 256 bits of the hash.

    Sums the remainders of pieces of 60 bits, each times the remainder of its place value; with at most
    2**30 bins no term leaves the range of a bigint.
    """
    check_bins(bins)
    modulus = F.lit(bins).cast("bigint")
    total = F.lit(0).cast("bigint")
    for end in range(HEX_DIGITS, 0, -LIMB_DIGITS):
        start = max(end - LIMB_DIGITS, 0)
        piece = F.conv(F.substring(hash_hex, start + 1, end - start), 16, 10).cast("bigint")
        place = F.lit(pow(16, HEX_DIGITS - end, bins)).cast("bigint")
        total = total + piece % modulus * place
    return (total % modulus + 1).cast("int")
