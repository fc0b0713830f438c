"""Documents to sections and chunks, and how much of the documents the chunks cover.

Line scans and folds that depend on what came before run in Arrow over rows in order; what they hold
is one unit, its carried tail, or for coverage one document.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import BLANK
from ..functions.text import normalise_whitespace
from ..plans.registry import query
from ..session import small_batches
from ..sources.tables import table

CHARS_PER_TOKEN = 3.6


@dataclass(frozen=True)
class Sizes:
    """Tokens of a chunk: what it aims at, the most and the least, and what it repeats of the one before. Fixed values."""

    target: int = 320
    most: int = 600
    least: int = 40
    overlap: int = 48


#: Sizes by kind of document; all other kinds have the first. Fixed values.
SIZES = {"": Sizes(), "SLIDES": Sizes(220, 450, 12, 0), "SPREADSHEET": Sizes(420, 800, 20, 0), "IMAGE": Sizes(320, 600, 8, 0)}
_MARKED = re.compile(r"#{1,6}\s+\S")
_NUMBERED = re.compile(r"[0-9]+(?:\.[0-9]+)*\.?\s+(\S)[^.!?]{2,100}$")


def _capital(char: str) -> bool:
    return unicodedata.category(char) == "Lu"


def is_heading(line: str) -> bool:
    """A marked line, a number with a capitalised title, or capitals alone; at most 120 characters and no end mark."""
    line = line.strip()
    if not line or len(line) > 120:
        return False
    numbered = _NUMBERED.match(line)
    if _MARKED.match(line) or numbered and _capital(numbered[1]):
        return True
    return 4 <= len(line) <= 81 and _capital(line[0]) and all(_capital(c) or c.isspace() or c in "0123456789&'/-" for c in line)


def _tokens(text: str) -> int:
    return math.ceil(len(text) / CHARS_PER_TOKEN)


def sections_of(text: str, most: int = 1400) -> Iterator[tuple[str | None, str]]:
    """(title, text) of the runs between headings, which are titles alone; a long run goes on under the same title."""
    title, lines, held, found = None, [], -1, False
    for line in [*text.split("\n"), None]:
        heading = line is not None and is_heading(line)
        if line is not None and not heading:
            lines.append(line)
            held += len(line) + 1
        if line is None or heading or math.ceil(held / CHARS_PER_TOKEN) > most:
            body = "\n".join(lines).strip()
            if body:
                found = True
                yield title, body
            lines, held = [], -1
        if heading:
            title = re.sub(r"[:.\s]+$", "", re.sub(r"^#+\s*", "", line)).strip()[:300] or None
    if not found and text:
        yield None, text


def _sentence_pieces(paragraph: str, sizes: Sizes) -> Iterator[str]:
    """A paragraph above the most, in runs of sentences near the target; a sentence above the most is cut hard."""
    hard, held = int(sizes.most * CHARS_PER_TOKEN), ""
    for sentence in re.findall(r"[^.!?]+[.!?]+\s*|[^.!?]+\Z", paragraph) or [paragraph]:
        if held and _tokens(held + sentence) > sizes.target:
            yield held.strip()
            held = ""
        held += sentence
        while _tokens(held) > sizes.most:
            yield held[:hard].strip()
            held = held[hard:]
    if held.strip():
        yield held.strip()


def _tail(before: str, sizes: Sizes) -> str:
    """What the next chunk repeats of the one before: its end, from a sentence on where one begins there."""
    end = before[-int(sizes.overlap * CHARS_PER_TOKEN) :] if sizes.overlap else ""
    begin = re.search(r"[.!?]\s", end)
    return (end[begin.end() :] if begin else end).strip()


def pieces_of(text: str, sizes: Sizes = SIZES[""]) -> list[str]:
    """A unit's text in pieces: whole if it fits, else runs of paragraphs near the target, each with a tail of the piece before."""
    if _tokens(text) <= sizes.most:
        return [text]
    out: list[str] = []
    held: list[str] = []
    for paragraph in (p for p in re.split(r"\n{2,}", text) if p.strip()):
        long = _tokens(paragraph) > sizes.most
        if held and (long or _tokens("\n\n".join([*held, paragraph])) > sizes.target):
            out.append("\n\n".join(held).strip())
            held = [t for t in [_tail(out[-1], sizes)] if t] if not long else []
        if long:
            out += _sentence_pieces(paragraph, sizes)
        else:
            held.append(paragraph)
    if "".join(held).strip():
        out.append("\n\n".join(held).strip())
    return out or [text]


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


_SECTION = pa.schema([("id", pa.int64()), ("section", pa.int32()), ("title", pa.string()), ("text", pa.string())])


def split_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, section, title, text) of every document; null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            yield _arrow([(i, k, title, body) for i, text in rows if text for k, (title, body) in enumerate(s for s in sections_of(text) if s[1])], _SECTION)

    small_batches(docs.sparkSession)
    clean = docs.select(F.col(id_col).cast("long").alias("id"), normalise_whitespace(F.col(text_col)).alias("text"))
    return clean.mapInArrow(run, "id long, section int, title string, text string").withColumnRenamed("id", id_col)


_CHUNK = pa.schema([("id", pa.int64()), ("chunk", pa.int32()), ("unit", pa.int32()), ("tokens", pa.int32()), ("digest", pa.string()), ("text", pa.string())])
CHUNKS = "id long, chunk int, unit int, tokens int, digest string, text string"


def _fold(units: Iterator[tuple[int, int, str | None, str | None, str]], kinds: dict[str, Sizes]) -> Iterator[tuple]:
    """Chunks of (id, unit, kind, title, text) in order of id and unit, one unit looked ahead.

    A last piece under the least is carried to the document's next unit; what the last unit leaves stands alone.
    """
    at, owner, carried = 0, object(), None

    def made(unit: int, title: str | None, text: str) -> tuple:
        nonlocal at
        shown = f"{title}\n{text}" if title and not text.startswith(title) else text
        at += 1
        return owner, at - 1, unit, _tokens(shown), hashlib.sha256(shown.encode()).hexdigest(), shown

    ahead = next(units, None)
    while ahead is not None:
        (i, unit, kind, title, text), ahead = ahead, next(units, None)
        if i != owner:
            at, owner, carried = 0, i, None
        last, sizes = ahead is None or ahead[0] != i, kinds.get(kind or "", kinds[""])
        pieces = pieces_of(text, sizes) if text else []
        for k, piece in enumerate(pieces):
            if carried:
                piece, carried = f"{carried[2]}\n\n{piece}", None
            if k + 1 == len(pieces) and not last and _tokens(piece) < sizes.least:
                carried = unit, title, piece
            else:
                yield made(unit, title, piece)
        if last and carried:
            yield made(*carried)


def chunk_units(units: DataFrame, in_order: bool = False) -> DataFrame:
    """(id, chunk, unit, tokens, digest, text): the chunks of every document, from its units (id, unit, kind, title, text).

    ``in_order`` units lie side by side in order already; others are shuffled by document and
    sorted. A task streams them and holds a unit and a carried tail, so a document of very
    many units costs time and no memory. The digest is what vectors are kept by.
    """
    small_batches(units.sparkSession)
    rows = units.select(F.col("id").cast("long").alias("id"), F.col("unit").cast("int").alias("unit"), "kind", "title", normalise_whitespace(F.coalesce("text", F.lit(""))).alias("text"))
    if not in_order:
        rows = rows.repartition("id").sortWithinPartitions("id", "unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _fold((row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))), SIZES)
        held, size = [], 0
        for chunk in chunks:
            held.append(chunk)
            size += len(chunk[-1])
            if size > 1_000_000:
                yield _arrow(held, _CHUNK)
                held, size = [], 0
        yield _arrow(held, _CHUNK)

    return rows.mapInArrow(run, CHUNKS)


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The chunks of every document, its sections as units; they come in order from one task, so nothing is shuffled."""
    sections = split_sections(docs, id_col, text_col)
    units = sections.select(F.col(id_col).alias("id"), F.col("section").alias("unit"), F.lit(None).cast("string").alias("kind"), "title", "text")
    return chunk_units(units, in_order=True).withColumnRenamed("id", id_col)


#: Least characters of a gap that is reported, most gaps of a document, and characters shown of one. Fixed values.
LEAST_GAP, MOST_GAPS, SHOWN = 120, 20, 160
#: Characters of a probe that are looked up by hash; of shorter probes, all.
WINDOW = 24
#: Characters behind the last probe found in which the next is looked for, and of texts that are scanned whole.
NEAR, SCANNED = 400, 20_000
_PROBE = re.compile(r"[^.!?\n]+[.!?\n]*")
_BASE = np.uint64(0x9E3779B97F4A7C15)


class TextIndex:
    """Where probes stand in a text: behind the one before, or by rolling hashes of all windows of a length, made when first asked for."""

    def __init__(self, text: str):
        self.text, self.at = text, 0
        self.chars: np.ndarray | None = None
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @staticmethod
    def _rolled(chars: np.ndarray, width: int) -> np.ndarray:
        # A hash of twice as many characters from two hashes of half as many; the last step overlaps.
        held, hashes = 1, (chars + np.uint64(1)) * _BASE
        while held < width:
            step = min(held, width - held)
            hashes = (hashes[:-step] * _BASE + (hashes[step:] ^ (hashes[step:] >> np.uint64(29)))) if len(hashes) > step else hashes[:0]
            held += step
        return hashes

    def has(self, probe: str) -> bool:
        """Whether the probe stands in the text; every window of an equal hash is compared in full.

        Probes mostly follow each other as they do in the text, so it is looked for behind the last one first;
        a short text is scanned. Hashes are made when neither tells.
        """
        found = self.text.find(probe, self.at, self.at + len(probe) + NEAR)
        if found < 0 and len(self.text) <= SCANNED:
            found = self.text.find(probe)
        if found >= 0:
            self.at = found + len(probe)
            return True
        return len(self.text) > SCANNED and self._hashed(probe)

    def _hashed(self, probe: str) -> bool:
        if self.chars is None:
            self.chars = np.frombuffer(self.text.encode("utf-32-le"), "<u4").astype(np.uint64)
        width = min(len(probe), WINDOW)
        if width not in self.tables:
            hashes = self._rolled(self.chars, width)
            order = np.argsort(hashes, kind="stable")
            self.tables[width] = hashes[order], order
        hashes, places = self.tables[width]
        own = self._rolled(np.frombuffer(probe[:width].encode("utf-32-le"), "<u4").astype(np.uint64), width)[0]
        first, last = np.searchsorted(hashes, own), np.searchsorted(hashes, own, "right")
        if last - first > 64:
            return probe in self.text  # a frequent beginning: one scan is cheaper than its places
        return any(self.text.startswith(probe, int(at)) for at in places[first:last])


def coverage_of(units: list[tuple[int, str]], chunks: list[str]) -> tuple[int, int, list[tuple[int, int, int, str]]]:
    """Characters of a document's units, how many a chunk holds, and the longest stretches that none holds: unit, start, length, text."""
    held = TextIndex("\n".join(chunks))
    total, covered, gaps = 0, 0, []
    for unit, text in units:
        total += len(text)
        spans = [m.span() for m in _PROBE.finditer(text)] or [(0, len(text))] * bool(text)
        open_gap = None
        for begin, end in [*spans, (len(text), len(text))]:
            probe = text[begin:end].strip()
            if probe and not held.has(probe):
                open_gap = [open_gap[0], open_gap[1] + end - begin] if open_gap else [begin, end - begin]
                continue
            covered += end - begin
            if open_gap and (probe or begin == len(text)):
                if open_gap[1] >= LEAST_GAP:
                    gaps.append((unit, *open_gap, text[open_gap[0] : open_gap[0] + min(open_gap[1], SHOWN)]))
                open_gap = None
    return total, min(covered, total), sorted(gaps, key=lambda g: -g[2])[:MOST_GAPS]


_GAP = pa.struct([("unit", pa.int32()), ("start", pa.int32()), ("length", pa.int32()), ("excerpt", pa.string())])
_COVERED = pa.schema([("id", pa.int64()), ("eligible", pa.int64()), ("covered", pa.int64()), ("coverage", pa.float64()), ("gaps", pa.list_(_GAP))])


def coverage(units: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, eligible, covered, coverage, gaps) of every document of (id, unit, text), by its chunks (id, chunk, text).

    Sentences of the units are probes; one that stands in a chunk of the document, white space aside, is
    covered, and stretches of others are gaps. Units and chunks are shuffled once by document, the
    chunks first; a task streams them and holds one document with the index of its chunks. Probes are found by hash,
    so a long document is not scanned once for each of its sentences.
    """
    small_batches(units.sparkSession)
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"{BLANK}+", " "))
    rows = chunks.select(F.col("id").cast("long").alias("id"), F.lit(0).alias("kind"), F.col("chunk").cast("int").alias("place"), flat(F.col("text")).alias("text"))
    rows = rows.unionByName(units.select(F.col("id").cast("long").alias("id"), F.lit(1).alias("kind"), F.col("unit").cast("int").alias("place"), flat(F.col("text")).alias("text")))
    rows = rows.repartition("id").sortWithinPartitions("id", "kind", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(i, held) -> list[tuple]:
            units = [(p, t) for k, p, t in held if k]
            if not units:
                return []
            total, covered, gaps = coverage_of([u for u in units if u[1]], [t for k, _, t in held if not k])
            return [(i, total, covered, covered / total if total else 1.0, [dict(zip(("unit", "start", "length", "excerpt"), g)) for g in gaps])]

        owner, held = None, []
        for batch in batches:
            out = []
            for i, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and i != owner:
                    out += found(owner, held)
                    held = []
                owner = i
                held.append(row)
            yield _arrow(out, _COVERED)
        yield _arrow(found(owner, held) if held else [], _COVERED)

    return rows.mapInArrow(run, "id long, eligible long, covered long, coverage double, gaps array<struct<unit: int, start: int, length: int, excerpt: string>>")


@query("split_sections")
def _sections(spark, sf_dir):
    return split_sections(table(spark, sf_dir, "documents"))


@query("chunk_units")
def _chunks(spark, sf_dir):
    return chunk_documents(table(spark, sf_dir, "documents"))


def _covered(spark, sf_dir, chunks: DataFrame) -> DataFrame:
    units = split_sections(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), F.col("section").alias("unit"), "text")
    return coverage(units, chunks.withColumnRenamed("doc_id", "id")).withColumnRenamed("id", "doc_id").withColumn("coverage", F.round("coverage", 6))


@query("coverage")
def _coverage(spark, sf_dir):
    """How much of each document stands in its chunks."""
    return _covered(spark, sf_dir, chunk_documents(table(spark, sf_dir, "documents")))


@query("coverage_of_distinct_chunks")
def _coverage_once(spark, sf_dir):
    """How much of each document is left in the index if a chunk of equal content is kept for one document only."""
    chunks = chunk_documents(table(spark, sf_dir, "documents"))
    kept = chunks.groupBy("digest").agg(F.min(F.struct("doc_id", "chunk")).alias("kept"))
    return _covered(spark, sf_dir, chunks.join(kept.select("kept.doc_id", "kept.chunk"), ["doc_id", "chunk"], "left_semi"))
