"""Toxicity: a linear classifier on character n-grams, each scaled by its naive Bayes log-count ratio.

Learning takes two passes over the labelled documents. The first counts in how many documents of each class an
n-gram (hashed) occurs, which gives its log-count ratio; the features with the most certain ratios stay. The second
lists the features of each document, and logistic regression is fitted on presence times ratio. Both passes run in
tasks; what the fit itself holds is bounded by ``max_rows`` x ``n_features``.

The fit uses at most ``max_rows`` labelled documents, chosen by hashed id; all else covers all rows.

Defined results: null and empty texts have no n-grams and get the score of the bias alone; a document labelled both
ways is toxic; labels that are null or of unknown documents are not used; without labels of both classes every score
is the smoothed share of toxic ones, 0.25 without any label; equal texts have equal scores; other columns, and those
named like a result, are carried along or give way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.expressions import with_results, written

LENGTHS = (3, 4, 5)
HASH_BITS = 20
MAX_ROWS = 20_000
N_FEATURES = 2048
SMOOTHING = 0.5
PENALTY = 1e-4
STEPS = 150
#: Characters of a text that are looked at together; a longer text is read in overlapping pieces.
PIECE = 1 << 20
#: Tasks that count features; each sends at most 2^HASH_BITS counts.
COUNTING_TASKS = 8


@dataclass(frozen=True)
class Model:
    features: np.ndarray
    weights: np.ndarray
    bias: float


def ngrams(text: str | None) -> Iterator[np.ndarray]:
    """Hashed n-grams of a text in lower case, as numbers below 2^HASH_BITS, in arrays of bounded length."""
    if not text:
        return
    padded = f" {text.lower()} "
    for begin in range(0, len(padded), PIECE):
        codes = np.frombuffer(padded[begin : begin + PIECE + max(LENGTHS) - 1].encode("utf-32-le", "replace"), dtype=np.uint32)
        mixed = codes.copy()
        for length in range(2, max(LENGTHS) + 1):
            if len(codes) < length:
                break
            mixed = mixed[: len(codes) - length + 1] * np.uint32(0x01000193) + codes[length - 1 :]
            if length in LENGTHS:
                spread = (mixed ^ np.uint32(length)) * np.uint32(0x9E3779B1)
                yield (spread ^ (spread >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(32 - HASH_BITS)


def present(text: str | None, marked: np.ndarray) -> np.ndarray:
    """The distinct marked n-grams of a text."""
    found = [grams[marked[grams]] for grams in ngrams(text)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint32)


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    everything = np.ones(1 << HASH_BITS, dtype=bool)
    toxic = np.zeros(1 << HASH_BITS, dtype=np.int64)
    clean = np.zeros(1 << HASH_BITS, dtype=np.int64)
    for batch in batches:
        for text, label in zip(batch["text"], batch["toxic"]):
            (toxic if label else clean)[present(text, everything)] += 1
    seen = np.flatnonzero(toxic + clean)
    yield pd.DataFrame({"feature": seen, "toxic": toxic[seen], "clean": clean[seen]})


def _feature_lists(features: np.ndarray):
    def lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marked = np.zeros(1 << HASH_BITS, dtype=bool)
        marked[features] = True
        for batch in batches:
            places = [np.searchsorted(features, present(text, marked)).astype(np.int32) for text in batch["text"]]
            yield pd.DataFrame({"row": batch["row"], "toxic": batch["toxic"], "places": places})

    return lists


def _fit(lists: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps; returns weights of plain presence and the bias."""
    sizes = np.array([len(one) for one in lists])
    columns = np.concatenate(lists).astype(np.int64)
    rows = np.repeat(np.arange(len(lists)), sizes)
    values = ratios[columns]
    # A bound of the curvature: the largest squared length of a row, the bias included.
    step = 4.0 / (1.0 + np.bincount(rows, values * values, minlength=len(lists)).max() + PENALTY)
    weights, bias = np.zeros(len(ratios)), 0.0
    ahead, ahead_bias, momentum = weights, bias, 1.0
    for _ in range(STEPS):
        margin = ahead_bias + np.bincount(rows, values * ahead[columns], minlength=len(lists))
        error = (1.0 / (1.0 + np.exp(-np.clip(margin, -50, 50))) - labels) / len(lists)
        slope = np.bincount(columns, values * error[rows], minlength=len(ratios)) + PENALTY * ahead
        new, new_bias = ahead - step * slope, ahead_bias - step * error.sum()
        grown = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        pull = (momentum - 1) / grown
        ahead, ahead_bias = new + pull * (new - weights), new_bias + pull * (new_bias - bias)
        weights, bias, momentum = new, new_bias, grown
    return weights * ratios, float(bias)


def held_out(doc_id: Column) -> Column:
    """The fifth of the ids that learning never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(
    documents: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    max_rows: int = MAX_ROWS,
    n_features: int = N_FEATURES,
) -> Model:
    """A model from the labelled documents that are not held out, of which at most ``max_rows`` are used."""
    usable = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    chosen = (
        usable.groupBy(F.col(doc_id).alias("id"))
        .agg(F.max((F.col(label) > 0).cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_rows)
    )
    # At most max_rows short rows, so they fit every task.
    texts = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    rows = written(texts.join(F.broadcast(chosen), "id").select(F.xxhash64("id").alias("row"), "text", "toxic").repartition(COUNTING_TASKS))
    toxic, clean = rows.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    none = np.zeros(0, dtype=np.int64)
    if not toxic or not clean:
        share = (toxic + 0.5) / (toxic + clean + 2.0)
        return Model(none, none.astype(float), float(np.log(share / (1 - share))))
    counts = rows.mapInPandas(_counts, "feature bigint, toxic bigint, clean bigint").groupBy("feature")
    counts = counts.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    in_toxic, in_clean = F.col("toxic") + SMOOTHING, F.col("clean") + SMOOTHING
    ratio = F.ln(in_toxic / (toxic + 2 * SMOOTHING)) - F.ln(in_clean / (clean + 2 * SMOOTHING))
    certain = F.abs(ratio) / F.sqrt(1 / in_toxic + 1 / in_clean)
    best = counts.select("feature", ratio.alias("ratio"), certain.alias("certain"))
    best = best.orderBy(F.desc("certain"), "feature").limit(n_features).toPandas().sort_values("feature")
    features = best["feature"].to_numpy()
    held = rows.mapInPandas(_feature_lists(features), "row bigint, toxic int, places array<int>").toPandas()
    held = held.sort_values("row")  # sums in the same order give the same weights in each run
    weights, bias = _fit(list(held["places"]), held["toxic"].to_numpy(dtype=float), best["ratio"].to_numpy())
    return Model(features, weights, bias)


def _scorer(model: Model):
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        marked = np.zeros(1 << HASH_BITS, dtype=bool)
        marked[model.features] = True
        weights = np.zeros(1 << HASH_BITS)
        weights[model.features] = model.weights
        for batch in batches:
            margins = np.array([weights[present(text, marked)].sum() for text in batch]) + model.bias
            yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(margins, -50, 50))))

    return score


def toxicity(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents with ``score`` (0 to 1) and ``predicted`` (1 from a score of 0.5 on)."""
    scored = with_results(documents, score=_scorer(model)(F.col(text)))
    return with_results(scored, predicted=(F.col("score") >= 0.5).cast("int"))
