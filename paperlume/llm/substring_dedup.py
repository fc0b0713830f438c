"""Removal of passages that repeat across documents: lines by MinHash banding, then running text by exact windows.

Lines: paragraphs are the lines of a text that have at least ``MIN_WORDS`` words. A paragraph's
set holds its distinct five-word runs. MinHash signatures of BANDS x ROWS values make BANDS keys;
a pair at similarity 0.8 shares one with probability 1 - (1 - 0.8**4)**16 > 0.9998. Paragraphs
that share a key are joined and verified by exact Jaccard similarity (0.8 or more), and the links'
components are the groups of repeats. Of each group the paragraph of the smallest (id, place)
stays and the others are removed from their texts.

Running text: the words that stay are one sequence, whatever lines they stand on. Every window of
``MIN_WORDS`` words that has occurred before, in order of (id, place), is a repeat; windows that
follow each other are joined to the full shared run. No window is missed: of the runs of half as
many words, the least hash of each window is an anchor (winnowing), so equal windows have an equal
anchor, and all windows around an anchor that occurs twice are compared by 64-bit hash. Each word
removed equals one of an earlier place, so one copy of a passage always stays. Within a text a
window that overlaps its own first place is no repeat.

Scale: equal sets are one node, so copies never form pairs; see ``linking`` for lists of many
similar paragraphs. One narrow pass writes a row of 16 keys for each paragraph and one writes an
anchor for about every eleventh word; texts are picked by id for the paragraphs and for the windows
that have candidates, and to rewrite them. A window is a narrow row of its place, its bytes and its
hash. Firsts are minima, so a passage of very many texts is combined before it is shuffled. What the
running text is joined with grows with the texts, so those joins are merged at every size and none
is broadcast. Tables of steps are deleted once they have been read.

Edge cases: null, empty and blank texts have no paragraphs; rows with a null id are not compared
and stay as they are; rows that repeat an id and its text share all decisions, and of one id's
different texts each is a text of its own; what is shorter than ``MIN_WORDS`` is never removed; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import columns_named, join_ids, releasing, scratch, text_or_empty, unused, written
from .linking import SET, connect, linkable, list_column, set_rows, shared_lists
from .ngram_join import node_of
from .words import Words, _powers_to, mix, row_chunks, words_in

MIN_WORDS = 40
SIZE, PERCENT = 5, 80
BANDS, ROWS = 16, 4
_U64 = np.uint64
#: Odd multipliers of the hash functions, from a fixed seed.
_FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=_U64) * _U64(0x9E3779B97F4A7C15)) | _U64(1)


def paragraphs(data: np.ndarray, offsets: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, Words]:
    """Row and line of every paragraph in a chunk of texts, and its words."""
    words = words_in(data, offsets)
    breaks = np.flatnonzero(data == 10)
    row = words.row()
    line = np.searchsorted(breaks, words.start) - np.searchsorted(breaks, offsets[row])
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (line[1:] != line[:-1])][: len(row)])
    size = np.diff(np.r_[first, len(row)])
    first, size = first[size >= min_words], size[size >= min_words]
    bounds = np.r_[0, np.cumsum(size)]
    at = np.repeat(first - bounds[:-1], size) + np.arange(bounds[-1])
    return row[first], line[first], Words(words.hash[at], words.start[at], words.end[at], bounds, data)


def minhash_keys(runs: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One key per band for each set runs[bounds[k]:bounds[k + 1]]; no set is empty."""
    keys = np.zeros((len(bounds) - 1, BANDS), _U64)
    for k, factor in enumerate(_FACTORS):
        least = np.minimum.reduceat(runs * factor, bounds[:-1])
        keys[:, k // ROWS] = mix(keys[:, k // ROWS] + mix(least) + _U64(k))
    return keys


def paragraph_rows(rows: DataFrame, min_words: int, size: int) -> DataFrame:
    """Per paragraph of (id, version, text): id, version, line, n_words, node and keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data, offsets in row_chunks(batch.column(2)):
                row, line, words = paragraphs(data, offsets, min_words)
                if not len(row):
                    continue
                own = [batch.column(k).take(pa.array(base + row)) for k in (0, 1)]
                runs, bounds = words.shingles(size)
                nodes = [node_of(np.unique(runs[a:b])) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                keys = list_column(list(minhash_keys(runs, bounds).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*own, pa.array(line, pa.int32()), pa.array(words.counts, pa.int64()), pa.array(nodes, pa.int64()), keys], names=["id", "version", "line", "n_words", "node", "keys"])

    return rows.select("id", "version", "text").mapInArrow(releasing(run), "id long, version long, line int, n_words long, node long, keys array<long>")


def _sets(picked: DataFrame, min_words: int, size: int) -> DataFrame:
    """The sets of the named lines of (id, text, lines), in the columns of ``SET``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data, offsets in row_chunks(batch.column(0)):
                row, line, words = paragraphs(data, offsets, min_words)
                runs, bounds = words.shingles(size)
                wanted = [set(lines) for lines in batch.column(1).slice(base, len(offsets) - 1).to_pylist()]
                sets = [np.unique(runs[bounds[k] : bounds[k + 1]]) for k, (r, at) in enumerate(zip(row.tolist(), line.tolist())) if at in wanted[r]]
                yield set_rows(sets, list(map(node_of, sets)))

    return picked.select("text", "lines").mapInArrow(releasing(run), SET)


def repeated_lines(rows: DataFrame, min_words: int, size: int, percent: int) -> DataFrame:
    """Per paragraph of (id, version, text) that repeats: id, version, line, n_words, kept_id, kept_line and removed."""
    place = F.struct("id", "line", "version")
    with scratch(rows.sparkSession):
        found = written(paragraph_rows(rows, min_words, size))
        nodes = written(found.groupBy("node").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")))
        lists = shared_lists(found.select(F.explode("keys").alias("key"), "node"))
        linked = _linked(rows, lists, nodes, min_words, size, percent)
        named = written(nodes.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node")))
        groups = named.groupBy("component").agg(F.min("first").alias("kept"), F.sum("copies").alias("members")).where("members > 1")
        by_node = named.select("node", "component").join(groups, "component").select("node", "kept")
        out = found.join(by_node, "node").select("id", "version", "line", "n_words", F.col("kept.id").alias("kept_id"), F.col("kept.line").alias("kept_line"), (place != F.col("kept")).alias("removed"))
        return written(out, keep=True)


def _linked(rows: DataFrame, lists: DataFrame, nodes: DataFrame, min_words: int, size: int, percent: int) -> DataFrame:
    """(node, component) of the paragraphs in ``lists`` that are similar to another."""
    with scratch(rows.sparkSession):
        wanted = lists.select("node").distinct().join(nodes, "node").groupBy(F.col("first.id").alias("id")).agg(F.collect_set("first.line").alias("lines"))
        picked = join_ids(rows, written(wanted), "id", "inner", F.size("lines"))
        sets = written(_sets(picked, min_words, size).dropDuplicates(["node"]))
        return written(connect(join_ids(lists, linkable(sets, percent), "node", "left_semi"), sets, percent), keep=True)


def _staying(data: np.ndarray, offsets: np.ndarray, gone: list[list[int] | None]) -> tuple[Words, np.ndarray]:
    """The words of a chunk of texts without those of the lines ``gone``, and the line of each."""
    words = words_in(data, offsets)
    breaks = np.flatnonzero(data == 10)
    row = words.row()
    line = np.searchsorted(breaks, words.start) - np.searchsorted(breaks, offsets[row])
    places = np.array([r << 32 | at for r, lines in enumerate(gone) for at in lines or ()], np.int64)
    stay = ~np.isin(row << 32 | line, places)
    bounds = np.r_[0, np.cumsum(stay)][words.bounds]
    return Words(words.hash[stay], words.start[stay], words.end[stay], bounds, data), line[stay]


def _windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each ``size`` words in sequence, and whether they lie in one row."""
    n = len(words.hash)
    if n < size:
        return np.zeros(0, _U64), np.zeros(0, bool)
    power, inverse = _powers_to(n)
    sums = np.zeros(n + 1, _U64)
    np.cumsum(mix(words.hash) * power[:n], out=sums[1:])
    row = words.row()
    return mix((sums[size:] - sums[:-size]) * inverse[: n - size + 1]), row[size - 1 :] == row[: n - size + 1]


def _sliding(values: np.ndarray, width: int, least: np.ufunc) -> np.ndarray:
    """``least`` (a minimum or maximum) of each ``width`` values in sequence."""
    held = 1
    while 2 * held <= width:
        values = least(values[:-held], values[held:])
        held *= 2
    return least(values[: len(values) - (width - held)], values[width - held :])


def anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the runs of ``window // 2`` words that are the least of a window of words in one row."""
    width = window - window // 2 + 1
    runs, _ = _windows(words, window // 2)
    _, whole = _windows(words, window)
    if not whole.any():
        return np.zeros(0, np.int64), np.zeros(0, _U64)
    least = np.where(whole, _sliding(runs, width, np.minimum), _U64(0))
    edge = np.zeros(width - 1, _U64)
    at = np.flatnonzero(_sliding(np.r_[edge, least, edge], width, np.maximum) == runs)
    return at, runs[at]


def _anchor_rows(rows: DataFrame, window: int) -> DataFrame:
    """Per anchor of (id, version, text, gone): id, version, at (its place among the words that stay) and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data, offsets in row_chunks(batch.column(2)):
                words, _ = _staying(data, offsets, batch.column(3).slice(base, len(offsets) - 1).to_pylist())
                at, keys = anchors(words, window)
                row = np.searchsorted(words.bounds, at, side="right") - 1
                own = pa.array(base + row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(at - words.bounds[row], pa.int32()), pa.array(keys.view(np.int64))], names=["id", "version", "at", "key"])

    return rows.select("id", "version", "text", "gone").mapInArrow(releasing(run), "id long, version long, at int, key long")


def _window_rows(rows: DataFrame, window: int) -> DataFrame:
    """Per window around the anchors of (id, version, text, gone, held): id, version, at (its first word's place), line, its bytes and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data, offsets in row_chunks(batch.column(2)):
                words, line = _staying(data, offsets, batch.column(3).slice(base, len(offsets) - 1).to_pylist())
                keys, whole = _windows(words, window)
                held = batch.column(4).slice(base, len(offsets) - 1)
                at = words.bounds[:-1].repeat(pc.list_value_length(held).to_numpy(zero_copy_only=False)) + held.flatten().to_numpy()
                near = np.zeros(len(keys) + 1, np.int64)
                np.add.at(near, np.clip(at - (window - window // 2), 0, len(keys)), 1)
                np.add.at(near, np.clip(at + 1, 0, len(keys)), -1)
                first = np.flatnonzero((np.cumsum(near[:-1]) > 0) & whole)
                row = np.searchsorted(words.bounds, first, side="right") - 1
                own, origin = pa.array(base + row), offsets[row] - offsets[0]
                places = (first - words.bounds[row], line[first], words.start[first] - origin, words.end[first + window - 1] - origin)
                columns = [batch.column(0).take(own), batch.column(1).take(own), *(pa.array(x.astype(np.int32)) for x in places), pa.array(keys[first].view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "version", "at", "line", "start", "end", "key"])

    return rows.select("id", "version", "text", "gone", "held").mapInArrow(releasing(run), "id long, version long, at int, line int, start int, end int, key long")


def repeated_passages(rows: DataFrame, gone: DataFrame, window: int) -> DataFrame:
    """Per run of words that repeats, outside the lines of (id, version, gone): id, version, line, n_words, kept_id, kept_line, removed, and its bytes.

    The version is a hash of the text that the bytes belong to.
    """
    rows = rows.join(gone.hint("merge"), ["id", "version"], "left")
    with scratch(rows.sparkSession):
        found = _shared_windows(rows, window)
        place, text = F.struct("id", "version", "at", "line"), F.xxhash64("id", "version")
        firsts = found.groupBy("key").agg(F.min(place).alias("first"), F.min(text).alias("one"), F.max(text).alias("other"), F.max("at").alias("last"))
        # In one text only, a window repeats where it does not overlap its first place.
        firsts = firsts.where(F.expr(f"one <> other OR last >= first.at + {window}"))
        firsts = written(firsts.select("key", *(F.col(f"first.{c}").alias(f"kept_{c}") for c in ("id", "version", "at", "line"))))
        other = (F.col("id") != F.col("kept_id")) | (F.col("version") != F.col("kept_version"))
        placed = found.join(firsts.hint("merge"), "key").withColumn("removed", other | (F.col("at") >= F.col("kept_at") + window))
        placed = placed.where(F.col("removed") | (F.col("at") == F.col("kept_at"))).drop("key", "kept_at")
        run = ["id", "version", "kept_id", "kept_version", "removed"]
        placed = placed.withColumn("run", F.col("at") - F.dense_rank().over(Window.partitionBy(*run).orderBy("at")))
        # Lines and bytes grow with the place, so those of a run are the least and the greatest of its windows.
        n_words = (F.max("at") - F.min("at") + window).cast("long").alias("n_words")
        joined = placed.groupBy(*run, "run").agg(n_words, *(F.min(c).alias(c) for c in ("line", "kept_line", "start")), F.max("end").alias("end"))
        return written(joined.select("id", "version", "line", "n_words", "kept_id", "kept_line", "removed", "start", "end"), keep=True)


def _shared_windows(rows: DataFrame, window: int) -> DataFrame:
    """The windows of (id, version, text, gone) around anchors that occur twice, as ``_window_rows`` gives them."""
    with scratch(rows.sparkSession):
        seen = written(_anchor_rows(rows, window))
        place = F.xxhash64("id", "version", "at")
        several = written(seen.groupBy("key").agg(F.min(place).alias("least"), F.max(place).alias("most")).where("least < most").select("key"))
        held = seen.join(several.hint("merge"), "key", "left_semi").groupBy("id", "version").agg(F.collect_set("at").alias("held"))
        held = written(held.select("id", F.col("version").alias("of"), "held"))
        picked = rows.join(held.hint("merge"), "id").where("version = of")
        return written(_window_rows(picked, window), keep=True)


def _units(docs: DataFrame, min_words: int, size: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Repeated lines, removed lines by id and version, and repeated passages; a version is a hash of the text."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).where("id IS NOT NULL").withColumn("version", F.xxhash64("text"))
    lines = repeated_lines(rows, min_words, size, percent)
    gone = written(lines.where("removed").groupBy("id", "version").agg(F.collect_set("line").alias("gone")))
    return lines, gone, repeated_passages(rows, gone, min_words)


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, size: int = SIZE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per unit that repeats: its id, (first) line and n_words, the id and line that it is kept at, and removed.

    A unit is a paragraph, or a run of words with its bytes, from start to before end, in the text.
    """
    lines, _, passages = _units(docs, min_words, size, percent, id_col, text_col)
    return lines.drop("version").unionByName(passages.drop("version"), allowMissingColumns=True).withColumnRenamed("id", id_col)


def _without(text: bytes, lines: set[int], cuts: list[tuple[int, int]]) -> bytes:
    """``text`` without these lines and without the bytes of these ranges."""
    stay = np.ones(len(text) + 1, bool)
    for start, end in cuts:
        stay[start:end] = False
    data, out, at = np.frombuffer(text, np.uint8), [], 0
    for k, line in enumerate(text.split(b"\n")):
        if k not in lines:
            # The line with the line feed before it, which the first line that stays has not.
            begin = at - 1 if out else at
            out.append(data[begin : at + len(line)][stay[begin : at + len(line)]].tobytes())
        at += len(line) + 1
    return b"".join(out)


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines and passages that repeat an earlier one; no row is dropped."""
    names = docs.columns
    gone_col, cuts_col, version_col, key = (unused([*names, "id"], c) for c in ("gone", "cuts", "version", "edited_id"))
    with scratch(docs.sparkSession):
        _, gone, passages = _units(docs, min_words, SIZE, PERCENT, id_col, text_col)
        cuts = passages.where("removed").groupBy("id").agg(F.collect_list(F.struct("version", "start", "end")).alias(cuts_col))
        edits = gone.groupBy("id").agg(F.collect_list(F.struct("version", "gone")).alias(gone_col)).join(cuts, "id", "full_outer").withColumnRenamed("id", key)
        edits = written(edits, keep=True)
    size = F.greatest(F.size(gone_col), F.lit(0)) + F.greatest(F.size(cuts_col), F.lit(0))
    marked = docs.withColumn(key, F.col(id_col).cast("long")).withColumn(version_col, F.xxhash64(text_or_empty(text_col)))
    marked = join_ids(marked, edits, key, "left", size)
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, cuts, version = (batch.column(len(batch.schema) - k) for k in (3, 2, 1))
            texts = batch.column(at).to_pylist()
            for k in np.flatnonzero(pc.or_(lines.is_valid(), cuts.is_valid()).to_numpy(zero_copy_only=False)).tolist():
                own = [(c["start"], c["end"]) for c in cuts[k].as_py() or () if c["version"] == version[k].as_py()]
                gone = {line for g in lines[k].as_py() or () if g["version"] == version[k].as_py() for line in g["gone"]}
                if texts[k] is not None:
                    texts[k] = _without(texts[k].encode(), gone, own).decode()
            columns = [pa.array(texts, batch.column(at).type) if k == at else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    # Arrow functions take columns by name, and not those with dots, so they get names by place.
    given = marked.select(*columns_named(names), gone_col, cuts_col, version_col).toDF(*(f"c{k}" for k in range(len(names) + 3)))
    return given.mapInArrow(releasing(run), docs.schema)
