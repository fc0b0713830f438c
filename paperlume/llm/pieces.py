"""Splitting texts where the byte-level pre-tokenizer always splits.

The pre-tokenizer attaches a single space to the run of characters that follows it, and no
special token holds a space. So a space with a non-space on both sides always begins a new
pre-token, and the pieces between such spaces can be encoded apart: their ids, put together,
are the ids of the whole text. Most pieces are words, which repeat, so a batch encodes only
its distinct pieces.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

_BOUNDARY = re.compile(r"(?<=\S) (?=\S)")
_LOOSE_SPACE = re.compile(r"\s[ ]|[ ]\s")


def split_safely(text: str) -> list[str]:
    """Pieces whose concatenation is ``text`` and that encode independently of each other."""
    if not text:
        return []
    if text[0] == " " or text[-1] == " " or _LOOSE_SPACE.search(text):
        parts = _BOUNDARY.split(text)
    else:
        parts = text.split(" ")
    return [parts[0], *map(" ".__add__, parts[1:])]


class PieceCache(dict):
    """Values of pieces, kept between the batches of a worker and cut back when they grow large."""

    def __init__(self, encode: Callable[[list[str]], Iterable[Any]], max_chars: int = 8_000_000):
        super().__init__()
        self.encode, self.max_chars, self.chars = encode, max_chars, 0

    def learn(self, pieces: Iterable[str]) -> None:
        """Encode the pieces not known yet."""
        new = [piece for piece in pieces if piece not in self]
        if new:
            self.chars += sum(map(len, new))
            self.update(zip(new, self.encode(new)))

    def forget(self) -> None:
        """Keep nothing, as at the end of a task: workers stay for other tasks."""
        self.clear()
        self.chars = 0

    def trim(self, recent: set[str]) -> None:
        """Once too large, keep only the pieces of the latest batch, which are mostly frequent."""
        if self.chars > self.max_chars:
            kept = {piece: self[piece] for piece in recent}
            self.clear()
            self.update(kept)
            self.chars = sum(map(len, kept))


def byte_balanced(texts: Iterable[str], max_bytes: int) -> Iterator[list[str]]:
    """Batches of at most ``max_bytes`` UTF-8 bytes; a longer text makes a batch of its own."""
    batch: list[str] = []
    size = 0
    for text in texts:
        length = len(text.encode("utf-8", "surrogatepass"))
        if batch and size + length > max_bytes:
            yield batch
            batch, size = [], 0
        batch.append(text)
        size += length
    if batch:
        yield batch
