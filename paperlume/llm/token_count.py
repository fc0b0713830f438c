"""Token counts with a public tokenizer, encoded in batches inside Arrow functions.

Method: each Arrow batch of texts is dealt into sub-batches balanced by bytes; every text is
split at safe boundaries (see ``pieces``), the distinct pieces of a sub-batch go through the
library's batch encoder, and only lengths come back to Spark.

Scale: one narrow pass without a shuffle. A worker holds one Arrow batch, and at most
``CACHE_CHARS`` characters of known pieces, whatever the input.

Edge cases: null text counts as empty (0 bytes, 0 tokens); ids may be null or repeat, each row is
counted by itself; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import text_or_empty
from .pieces import PieceCache, byte_balanced, split_safely

#: UTF-8 bytes of the texts, and of the distinct pieces, that are handled at once.
BATCH_BYTES = 4_000_000
CACHE_CHARS = 8_000_000


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def _tokenizer_json(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(name))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@cache
def _sentencepiece(name: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))


def _lengths(name: str, texts: list[str]) -> Iterator[int]:
    for batch in byte_balanced(texts, BATCH_BYTES):
        if name.endswith(".model"):
            yield from map(len, _sentencepiece(name).encode(batch, num_threads=1))
        else:
            yield from map(len, _tokenizer_json(name).encode_batch_fast(batch, add_special_tokens=False))


@cache
def _known(name: str) -> PieceCache:
    return PieceCache(lambda pieces: _lengths(name, pieces), CACHE_CHARS)


def count_texts(name: str, texts: list[str]) -> list[int]:
    """Tokens of each text. Only the byte-level tokenizers are split into pieces."""
    if not name.startswith("byte_bpe"):
        return list(_lengths(name, texts))
    known, counts = _known(name), []
    for batch in byte_balanced(texts, BATCH_BYTES):
        pieces = [split_safely(text) for text in batch]
        distinct = {piece for parts in pieces for piece in parts}
        known.learn(distinct)
        counts += [sum(map(known.__getitem__, parts)) for parts in pieces]
        known.trim(distinct)
    return counts


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its id, n_bytes, n_tokens and over_limit (more tokens than ``limit``)."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = pa.array(count_texts(tokenizer, batch.column(2).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counted], names=["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.octet_length(text_or_empty(text_col)).cast("long").alias("n_bytes"), text_or_empty(text_col).alias("text"))
    counted = rows.mapInArrow(lengths, "id long, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
