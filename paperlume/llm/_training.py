"""Bounded samples of labelled documents, and models fitted on them in one task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import releasing, text_or_empty, written


def fold_of(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, keep: Column, max_rows: int, max_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most ``max_rows`` labelled documents (id, text, label) of at most ``max_bytes`` in all.

    Labelled ids are taken in the order of a hash, so the sample is the same at every run and
    spread over the corpus. An id with several labels has the larger one, an id with several
    texts the smaller one. A text that does not fit in what is left of the bytes is passed over, and
    those after it are still taken. Only ids are broadcast, no text is shuffled before the join, and
    the driver sees the lengths of at most ``max_rows`` texts.
    """
    ids = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("id").isNotNull() & F.col("label").isNotNull())
    ids = ids.where(keep).groupBy("id").agg(F.max("label").alias("label"))
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    found = written(texts.join(F.broadcast(ids), "id").groupBy("id", "label").agg(F.min("text").alias("text")))
    chosen, left = [], max_bytes
    for row in found.select("id", F.octet_length("text").alias("n")).orderBy(F.xxhash64("id"), "id").collect():  # max_rows at most
        if row["n"] <= left:
            chosen.append((row["id"],))
            left -= row["n"]
    wanted = docs.sparkSession.createDataFrame(chosen, found.select("id").schema)
    return found.join(F.broadcast(wanted), "id", "left_semi").select("id", "text", "label")


def fit_in_one_task(sample: DataFrame, fit: Callable[[pa.Array, np.ndarray], Any]) -> Any:
    """``fit`` of the texts and labels of the whole bounded sample in order of its ids, run on an executor; its result returns pickled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if parts:
            rows = pa.Table.from_batches(parts).sort_by("id").combine_chunks()
            model = fit(rows["text"].cast(pa.large_string()).combine_chunks(), rows["label"].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    fitted = sample.coalesce(1).mapInArrow(releasing(run), "model binary").collect()
    return pickle.loads(fitted[0]["model"]) if fitted else fit(pa.array([], pa.large_string()), np.zeros(0))
