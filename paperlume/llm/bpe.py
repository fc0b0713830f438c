"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

Method: texts are split at safe boundaries into pieces (see ``pieces``), distinct pieces into
pre-tokens, and distinct pre-tokens are merged together. The symbols of all those words lie in
one flat array with the word of each symbol. In every round each adjacent pair of symbols is
looked up by binary search in the sorted array of mergeable pair keys, the lowest rank of each
word (of each part of a very long word) is found, and every occurrence of it merges, left to right.
Words without a mergeable pair leave the array. Decoding maps each id to its bytes and joins them.

Scale: a narrow pass, no shuffle, no state beyond a bounded cache of pieces in each worker. The
vocabulary is a file of fixed size that each worker reads at its own path.

Edge cases: null text is the empty text (no ids, empty decoded text); special strings inside a
text become their special id, as the tokenizers library does; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import release_memory, small_batches, text_or_empty
from .pieces import PieceCache, byte_balanced, split_safely
from .token_count import tokenizer_path

BATCH_BYTES = 500_000
#: Words of more bytes are merged in several parts at once.
LONG = 512
CACHE_CHARS = 4_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class ByteBpe:
    """A byte-level BPE vocabulary with its merges as sorted arrays."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        symbols = byte_symbols()
        byte_of = {symbol: b for b, symbol in enumerate(symbols)}
        self.byte_ids = np.array([vocab[s] for s in symbols], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items() if token not in self.special}
        self.bytes_of |= {i: content.encode() for content, i in self.special.items()}
        self.words = regex.compile(public_tokenizers.PATTERN).findall
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = PieceCache(self._encode_pieces, CACHE_CHARS)

    def _reach(self, words: list[bytes]) -> int:
        """Bytes of the longest token that some of these words may hold."""
        present = set().union(*words)
        return max((len(t) for t in self.bytes_of.values() if present.issuperset(t)), default=1)

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each word, all words merged together.

        A round merges the pairs that are the lowest of their part of a word. Words of up to ``LONG`` bytes
        are one part. Longer ones have parts of as many bytes as the longest token that may occur; a
        pair must be the lowest of the parts that any token holding one of its symbols can lie in, so
        no merge elsewhere can come before it, and distant parts of a word go on side by side.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        long = lengths > LONG
        step = self._reach([w for w, far in zip(words, long.tolist()) if far]) if long.any() else 0
        # Part numbers rise along a word; those between words stay empty.
        parts = np.where(long, -(-lengths // step) + 3, 4) if step else np.full(len(words), 4)
        base = np.cumsum(parts) - parts + 1
        part = base[word]
        if step:
            part = part + np.where(long[word], (np.arange(len(ids)) - (np.cumsum(lengths) - lengths)[word]) // step, 0)
        done_ids, done_word = [], []
        no_rank = len(self.ranks)
        while len(ids):
            pair = ids[:-1] << 32 | ids[1:]
            at = np.searchsorted(self.keys, pair)
            at[at == no_rank] = 0
            known = (self.keys[at] == pair) & (word[:-1] == word[1:])
            rank = np.full(len(ids), no_rank, np.int64)
            rank[:-1][known] = self.ranks[at[known]]
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[first, len(ids)])
            best = np.minimum.reduceat(rank, first)
            over = np.repeat(best == no_rank, size)
            if over.any():
                done_ids.append(ids[over])
                done_word.append(word[over])
            if step:
                own = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                lowest = np.full(int(parts.sum()) + 4, no_rank, np.int64)
                lowest[part[own]] = np.minimum.reduceat(rank, own)
                lowest[1:-2] = np.minimum.reduce([lowest[:-3], lowest[1:-2], lowest[2:-1], lowest[3:]])
                hit = (rank == lowest[part]) & (rank < no_rank)
            else:
                hit = (rank == np.repeat(best, size)) & ~over
            # In a run of overlapping hits (aaa with pair aa) every other one merges, from the left.
            where = np.flatnonzero(hit)
            run = np.flatnonzero(np.r_[True, np.diff(where) != 1][: len(where)])
            length = np.diff(np.r_[run, len(where)])
            within = np.arange(len(where)) - np.repeat(run, length)
            take = within % 2 == 0
            if step:
                # A run whose left part has to wait waits with it.
                begin = where[run]
                waits = (begin > 0) & (rank[begin - 1] == rank[begin]) & (word[begin - 1] == word[begin])
                take &= np.repeat(~waits, length)
            where = where[take]
            ids[where] = self.made[at[where]]
            keep = ~over
            keep[where + 1] = False
            ids, word, part = ids[keep], word[keep], part[keep]
        if not done_ids:
            return [b""] * len(words)
        word = np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        flat = np.concatenate(done_ids)[order].astype("<u4").tobytes()
        ends = 4 * np.cumsum(np.bincount(word, minlength=len(words)))
        starts = [0, *ends[:-1].tolist()]
        return [flat[a:b] for a, b in zip(starts, ends.tolist())]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece; the distinct pre-tokens of all pieces merge in one go."""
        parts: list[list[str | int]] = []
        for piece in pieces:
            if piece.isalpha() or piece[0] == " " and piece[1:].isalpha():
                parts.append([piece])  # letters only: one pre-token
            elif self.specials and self.specials.search(piece):
                own: list[str | int] = []
                for part in self.specials.split(piece):
                    own += [self.special[part]] if part in self.special else self.words(part)
                parts.append(own)
            else:
                parts.append(self.words(piece))
        distinct = list({w for own in parts for w in own if isinstance(w, str)})
        ids: dict[str | int, bytes] = dict(zip(distinct, self.merge_words([w.encode("utf-8") for w in distinct])))
        ids |= {i: i.to_bytes(4, "little") for i in self.special.values()}
        return [b"".join(map(ids.__getitem__, own)) for own in parts]

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        for batch in byte_balanced(texts, BATCH_BYTES):
            split = [split_safely(text) for text in batch]
            distinct = {piece for parts in split for piece in parts}
            self.pieces.learn(distinct)
            for parts in split:
                yield b"".join(map(self.pieces.__getitem__, parts))
            self.pieces.trim(distinct)

    def decode(self, ids: bytes) -> str:
        found = np.frombuffer(ids, "<u4").tolist()
        return b"".join(map(self.bytes_of.__getitem__, found)).decode("utf-8", "replace")


@cache
def load(name: str) -> ByteBpe:
    return ByteBpe(tokenizer_path(name))


@contextmanager
def loaded(name: str) -> Iterator[ByteBpe]:
    """The vocabulary for one task; a worker keeps it for later tasks, but not the pieces of this one."""
    bpe = load(name)
    try:
        yield bpe
    finally:
        bpe.pieces.forget()
        release_memory()


def encode(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", text_col: str = "text", out: str = "ids_le") -> DataFrame:
    """``docs`` with a column ``out``: the text's ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("binary")
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with loaded(tokenizer) as bpe:
            for texts in batches:
                yield pa.array(bpe.encode_batch(texts.to_pylist()), pa.binary())

    small_batches(docs.sparkSession)
    return docs.withColumn(out, apply(text_or_empty(text_col)))


def decode(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", ids_col: str = "ids_le", out: str = "decoded") -> DataFrame:
    """``docs`` with a column ``out``: the text that the ids in ``ids_col`` stand for; empty for null."""

    @F.arrow_udf("string")
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with loaded(tokenizer) as bpe:
            for ids in batches:
                yield pa.array([bpe.decode(x or b"") for x in ids.to_pylist()], pa.string())

    small_batches(docs.sparkSession)
    return docs.withColumn(out, apply(F.col(ids_col)))


def encode_checked(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", text_col: str = "text", out: str = "encoded") -> DataFrame:
    """``docs`` with a column ``out``: a struct of ids_le as by ``encode`` and lossless, whether they decode to the text.

    Encoding and decoding share a task's worker, so decoded texts never leave it.
    """

    @F.arrow_udf("struct<ids_le: binary, lossless: boolean>")
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with loaded(tokenizer) as bpe:
            for batch in batches:
                texts = batch.to_pylist()
                ids = list(bpe.encode_batch(texts))
                same = [bpe.decode(x) == text for x, text in zip(ids, texts)]
                yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(same, pa.bool_())], names=["ids_le", "lossless"])

    small_batches(docs.sparkSession)
    return docs.withColumn(out, apply(text_or_empty(text_col)))


def round_trip(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, n_tokens, ids_sha256, decoded_sha256 and whether decoding gave the text back.

    Encodes and then decodes the ids in one Arrow pass, so ids never leave the worker.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with loaded(tokenizer) as bpe:
            for batch in batches:
                texts = batch.column(1).to_pylist()
                sizes, id_hashes, text_hashes, same = [], [], [], []
                for text, ids in zip(texts, bpe.encode_batch(texts)):
                    decoded = bpe.decode(ids)
                    sizes.append(len(ids) // 4)
                    id_hashes.append(hashlib.sha256(ids).hexdigest())
                    text_hashes.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                    same.append(decoded == text)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(text_hashes, pa.string()), pa.array(same, pa.bool_())],
                    names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "lossless"],
                )

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    out = rows.mapInArrow(digests, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean")
    return out.withColumnRenamed("id", id_col)
