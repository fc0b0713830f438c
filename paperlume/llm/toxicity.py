"""Toxicity scores by FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Method: a text's features are the distinct hashes of its words, of its pairs of adjacent words
and of its pairs of words with one word between, in 2**BITS buckets; letters A-Z count as a-z
and ASCII punctuation separates words. Training visits the labelled texts one by one with a
learning rate per coordinate and L1 shrinkage, which leaves most weights at zero. The non-zero
weights travel to the tasks; scoring is one pass over whole texts.

Scale: the fit reads a sample of at most ``MAX_TRAIN_ROWS`` labelled documents and
``MAX_TRAIN_BYTES`` of text in one task; scoring is a narrow pass over all rows without a shuffle.

Edge cases: a null or empty text has no features and gets the bias alone; null labels are not
used; without any labelled rows, or with one class only, the fit still gives a score (0.5, or
near that class); ids may be null or repeat; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import releasing, small_batches, text_or_empty
from ._training import fit_in_one_task, fold_of, labelled_sample
from .words import Words, mix, row_chunks, words_in

BITS = 20
MAX_TRAIN_ROWS = 24_576
MAX_TRAIN_BYTES = 80_000_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 1.0


@dataclass
class SparseWeights:
    """Sorted feature indices with their weights, and the bias."""

    index: np.ndarray
    weight: np.ndarray
    bias: float


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every word, bigram and skip-gram (with repeats)."""
    row, hashed = words.row(), words.hash
    rows, buckets = [row], [mix(hashed ^ np.uint64(1))]
    for gap, salt in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
        if len(hashed) > gap:
            same = row[gap:] == row[:-gap]
            pair = hashed[:-gap] * np.uint64(salt) + hashed[gap:]
            rows.append(row[gap:][same])
            buckets.append(mix(pair[same]))
    return np.concatenate(rows), (np.concatenate(buckets) >> np.uint64(64 - BITS)).astype(np.int64)


def _per_row(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """First row and row count of a chunk of rows, with the chunk's features."""
    for first, data, offsets in row_chunks(column):
        row, bucket = features(words_in(data, offsets, split_punctuation=True))
        yield np.array([first, len(offsets) - 1]), row, bucket


def fit_ftrl(texts: pa.Array, labels: np.ndarray) -> SparseWeights:
    """Weights after ``EPOCHS`` passes over the texts and their labels."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias, bias_n = 0.0, 0.0
    examples: list[np.ndarray] = []
    for (_, count), row, bucket in _per_row(texts):
        order = np.argsort(row, kind="stable")
        cut = np.searchsorted(row[order], np.arange(count + 1))
        bucket = bucket[order].astype(np.int32)
        examples += [np.unique(bucket[a:b]) for a, b in zip(cut[:-1], cut[1:])]
    labels = labels.astype(np.float64)
    shuffled = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for k in shuffled.permutation(len(examples)):
            at = examples[k]
            zs, ns = z[at], n[at]
            w = np.where(np.abs(zs) > L1, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2), 0.0)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - labels[k]
            grown = np.sqrt(ns + g * g)
            z[at] = zs + g - (grown - np.sqrt(ns)) / ALPHA * w
            n[at] = ns + g * g
            bias_n += g * g
            bias -= ALPHA / (BETA + np.sqrt(bias_n)) * g
    at = np.flatnonzero(np.abs(z) > L1)
    return SparseWeights(at, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2), bias)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", folds: int = 5, held_fold: int = 0, id_col: str = "doc_id") -> SparseWeights:
    """Weights learned from labelled rows outside the held-out fold."""
    sample = labelled_sample(docs, labels, label_col, fold_of("id", folds) != held_fold, MAX_TRAIN_ROWS, MAX_TRAIN_BYTES, id_col)
    return fit_in_one_task(sample, fit_ftrl)


def dense_weights(model: SparseWeights) -> np.ndarray:
    dense = np.zeros(1 << BITS)
    dense[model.index] = model.weight
    return dense


def score_texts(column: pa.Array, model: SparseWeights, dense: np.ndarray | None = None) -> np.ndarray:
    """Probability of label 1 for every row; ``dense`` are the weights of all buckets."""
    dense = dense_weights(model) if dense is None else dense
    out = np.zeros(len(column))
    for (first, count), row, bucket in _per_row(column):
        live = dense[bucket] != 0
        own = np.unique(row[live] << BITS | bucket[live])
        out[first : first + count] = np.bincount(own >> BITS, dense[own & (1 << BITS) - 1], minlength=count)
    return 1 / (1 + np.exp(-np.clip(out + model.bias, -35, 35)))


def score(docs: DataFrame, model: SparseWeights, folds: int = 5, held_fold: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, held_out, score and predicted (1 where the score is 0.5 or more)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = dense_weights(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_texts(batch.column(1), shared.value, dense))], names=["id", "score"])

    small_batches(docs.sparkSession)
    scored = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(releasing(run), "id long, score double")
    return scored.select(
        F.col("id").alias(id_col),
        F.coalesce(fold_of("id", folds) == held_fold, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
