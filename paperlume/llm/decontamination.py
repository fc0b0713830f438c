"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks.

Method: words are runs of ASCII letters and digits and of bytes beyond ASCII, A-Z as a-z. In
every text, windows as long as a benchmark item slide word by word; a window's SimHash adds up
its five-word shingles, each weighted by how rare it is among the items. Fingerprints of 64 bits
are cut into 8 blocks: two that differ in at most RADIUS = 23 bits agree in some block up to 2
bits, so a table of near block values finds every item of the window's length within the
radius. Candidates are then verified by the exact weighted Jaccard similarity of their distinct
shingles. A window that shares no shingle with any item has similarity zero, so only windows
that hold a shared shingle are fingerprinted; none that could be verified is passed over.

Items of fewer than five words are one shingle, their whole sequence, and match where it occurs.
A text shorter than an item is one window.

Scale: one narrow pass over the documents for each block of about ``ITEM_BYTES`` of items (one block,
for a usual benchmark); the driver and each task hold one block's index at a time. Weights are those of
all items at any number of blocks, so matches and similarities do not depend on it: of the items'
shingles only those that several items have weigh less than an unknown one, and these, 16 bytes each, go with
every block's index. With several blocks, what each pass finds is written by a hash of the text and
joined to the rows in the end.

Edge cases: null or empty texts and items without words match nothing; ids of documents and items
may be null or repeat (items with the same text all count), each row is judged by itself; an empty benchmark leaves every row clean; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import join_ids, release_memory, scratch, small_batches, text_or_empty, unused, written
from .words import Words, row_chunks, words_in, words_of

SHINGLE = 5
SIMILARITY = 0.8
RADIUS, BLOCKS = 23, 8
ITEM_BYTES = 8_000_000
_FILTER_BITS = 20


@dataclass
class Shared:
    """The number of all items that have words, and the shingles that several of them have, sorted, with how many."""

    items: int
    runs: np.ndarray
    df: np.ndarray


class ItemIndex:
    """Fingerprints, shingles and weights of benchmark items.

    ``shared`` has what the weights come from, over all items where these are only some of them.
    """

    def __init__(self, ids: list[int], texts: list[str], shared: Shared | None = None):
        words = words_of(pa.array(texts, pa.large_string()), split_punctuation=True)
        runs, bounds = words.shingles(SHINGLE)
        counts = words.counts
        self.ids = [i for i, n in zip(ids, counts) if n]
        self.words = counts[counts > 0]
        self.runs = [runs[bounds[k] : bounds[k + 1]] for k in np.flatnonzero(counts)]
        self.sets = [np.unique(r) for r in self.runs]
        self.known, df = np.unique(np.concatenate([*self.sets, np.zeros(0, np.uint64)]), return_counts=True)
        several = df > 1
        self.common = shared or Shared(len(self.ids), self.known[several], df[several])
        self.rare = float(np.log1p(self.common.items))
        self.idf = np.log1p(self.common.items / self.common.df)
        self.total = [self.weights(x).sum() for x in self.sets]
        # The items that hold each known shingle.
        holder = np.repeat(np.arange(len(self.sets)), list(map(len, self.sets)))
        flat = np.searchsorted(self.known, np.concatenate([*self.sets, np.zeros(0, np.uint64)]))
        self.posting = holder[np.argsort(flat, kind="stable")]
        self.posted = np.r_[0, np.cumsum(df)].astype(np.int64)
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[self.known >> np.uint64(64 - _FILTER_BITS)] = True
        # Items of fewer words by their number of words and their whole sequence; several may say the same.
        self.short: dict[int, dict[int, list[int]]] = {}
        for k in np.flatnonzero(self.words < SHINGLE).tolist():
            self.short.setdefault(int(self.words[k]), {}).setdefault(int(self.runs[k][0]), []).append(k)
        long = np.flatnonzero(self.words >= SHINGLE)
        self.sizes, group = np.unique(self.words[long] - SHINGLE + 1, return_inverse=True)
        prints = np.array([self.fingerprints(self.runs[k], np.array([0]), np.array([len(self.runs[k])]))[0] for k in long], np.uint64)
        self.prints = dict(zip(long.tolist(), prints))
        near = np.flatnonzero(np.bitwise_count(np.arange(256, dtype=np.uint16)) <= RADIUS // BLOCKS)
        # For each block: the items of a window size whose block value is within two bits of a value.
        self.tables = []
        for b in range(BLOCKS):
            value = (prints >> np.uint64(8 * b) & np.uint64(255)).astype(np.int64)
            key = (group[:, None] * 256 + (value[:, None] ^ near)).ravel()
            order = np.argsort(key, kind="stable")
            self.tables.append((np.searchsorted(key[order], np.arange(len(self.sizes) * 256 + 1)), np.repeat(long, len(near))[order]))
        self.all_prints = np.zeros(len(self.ids), np.uint64)
        self.all_prints[long] = prints

    def weights(self, runs: np.ndarray) -> np.ndarray:
        """A shingle that one item has weighs as much as one that none has, so only those of several are looked up."""
        held = self.common.runs
        if not len(held):
            return np.full(len(runs), self.rare)
        at = np.minimum(np.searchsorted(held, runs), len(held) - 1)
        return np.where(held[at] == runs, self.idf[at], self.rare)

    def fingerprints(self, runs: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """SimHash of runs[first:first + size] for each pair."""
        bits = np.unpackbits(runs.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
        sums = np.zeros((len(runs) + 1, 64))
        np.cumsum((2 * bits - 1) * self.weights(runs)[:, None], axis=0, out=sums[1:])
        positive = sums[first + size] - sums[first] > 1e-9
        return np.packbits(positive, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)

    def similarity(self, window: np.ndarray, item: int) -> float:
        own, other = np.unique(window), self.sets[item]
        common = self.weights(np.intersect1d(own, other, assume_unique=True)).sum()
        union = self.weights(own).sum() + self.weights(other).sum() - common
        return float(common / union) if union else 0.0

    def candidates(self, runs: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First run, number of runs and item of windows within the radius that hold a hit."""
        firsts, groups = [], []
        for g, size in enumerate(self.sizes.tolist()):
            last = max(0, len(runs) - size)
            begin, stop = np.clip(hits - size + 1, 0, last), np.clip(hits, 0, last)
            opens = np.zeros(last + 2, np.int64)
            np.add.at(opens, begin, 1)
            np.add.at(opens, stop + 1, -1)
            first = np.flatnonzero(np.cumsum(opens[:-1]) > 0)
            firsts.append(first)
            groups.append(np.full(len(first), g))
        first, group = np.concatenate(firsts), np.concatenate(groups)
        size = np.minimum(self.sizes[group], len(runs) - first)
        prints = self.fingerprints(runs, first, size)
        found = []
        for b, (bounds, items) in enumerate(self.tables):
            key = group * 256 + (prints >> np.uint64(8 * b) & np.uint64(255)).astype(np.int64)
            count = bounds[key + 1] - bounds[key]
            window = np.repeat(np.arange(len(key)), count)
            at = np.repeat(bounds[key] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
            item = items[at]
            close = np.bitwise_count(prints[window] ^ self.all_prints[item]) <= RADIUS
            found.append(window[close] * len(self.ids) + item[close])
        pair = np.unique(np.concatenate(found))
        window, item = pair // len(self.ids), pair % len(self.ids)
        distance = np.bitwise_count(prints[window] ^ self.all_prints[item])
        order = np.lexsort((window, distance))
        return first[window[order]], size[window[order]], item[order]

    def matches(self, runs: np.ndarray, hits: np.ndarray) -> dict[int, tuple[float, int]]:
        """Best similarity, and the window's first word, of each item that a text contains."""
        best: dict[int, tuple[float, int]] = {}
        if not len(self.sizes):
            return best
        first, size, item = self.candidates(runs, hits)
        place = np.searchsorted(self.known, runs[hits])
        sharing = np.unique(np.concatenate([self.posting[a:b] for a, b in zip(self.posted[place], self.posted[place + 1])]))
        weight = self.weights(runs)
        for k in np.intersect1d(sharing, item).tolist():
            # The windows' shared weight, repeats included, bounds the similarity from above.
            shared = np.r_[0, np.cumsum(np.where(np.isin(runs, self.sets[k]), weight, 0))]
            own = np.flatnonzero(item == k)
            own = own[shared[first[own] + size[own]] - shared[first[own]] >= SIMILARITY * self.total[k] - 1e-9]
            for at, width in zip(first[own].tolist(), size[own].tolist()):
                found = self.similarity(runs[at : at + width], k)
                if found >= SIMILARITY - 1e-12 and found > best.get(k, (0.0, 0))[0]:
                    best[k] = (min(found, 1.0), at)
                    if found >= 1.0:
                        break
        return best

    def rows(self, words: Words) -> list[list[tuple[int, float, int, int]]]:
        """For each row of ``words``: item id, similarity, first word and number of words of each match."""
        runs, bounds = words.shingles(SHINGLE)
        out: list[dict[int, tuple[float, int]]] = [{} for _ in words.counts]
        hit = np.flatnonzero(self.maybe[runs >> np.uint64(64 - _FILTER_BITS)])
        if len(self.known):
            hit = hit[self.known[np.minimum(np.searchsorted(self.known, runs[hit]), len(self.known) - 1)] == runs[hit]]
        row = np.searchsorted(bounds, hit, side="right") - 1
        for r in np.unique(row).tolist():
            if words.counts[r] >= SHINGLE:
                out[r] |= self.matches(runs[bounds[r] : bounds[r + 1]], hit[row == r] - bounds[r])
        for size, items in self.short.items():
            runs, bounds = words.shingles(size)
            for at in np.flatnonzero(np.isin(runs, np.array(list(items), np.uint64))).tolist():
                r = int(np.searchsorted(bounds, at, side="right")) - 1
                for k in items[int(runs[at])]:
                    out[r].setdefault(k, (1.0, at - int(bounds[r])))
        return [[(self.ids[k], s, first, int(self.words[k])) for k, (s, first) in sorted(found.items())] for found in out]


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(item_col).cast("long").alias("item"), text_or_empty(text_col).alias("text"))


def _index(items: DataFrame, shared: Shared | None = None) -> ItemIndex:
    """The index of some items, ``ITEM_BYTES`` or about that at most."""
    rows = sorted(items.collect(), key=lambda r: (r["item"] is None, r["item"] or 0, r["text"]))
    return ItemIndex([r["item"] for r in rows], [r["text"] for r in rows], shared)


def _shared(items: DataFrame) -> Shared:
    """Counts over all items: those with words, and each shingle's that several have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = words_of(batch.column(0), split_punctuation=True)
            runs, bounds = words.shingles(SHINGLE)
            held = [np.unique(runs[a:b]).view(np.int64) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.int64()))], names=["runs"])

    sets = written(items.select("text").mapInArrow(run, "runs array<long>"))
    counted = sets.select(F.explode("runs").alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("df")).where("df > 1").toArrow()
    runs = counted["run"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(runs)
    return Shared(sets.where(F.size("runs") > 0).count(), runs[order], counted["df"].to_numpy()[order])


MATCH = "array<struct<item_id: long, similarity: double, first_word: long, n_words: long>>"
MATCH_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())]))


def find_matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", out: str = "matches", item_col: str = "item_id", item_text_col: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``docs`` with an array column ``out`` of the benchmark items that each text contains."""
    small_batches(docs.sparkSession)
    items = _items(benchmark, item_col, item_text_col)
    count = -(-(items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) // item_bytes) or 1
    if count == 1:
        return docs.withColumn(out, _matcher(docs, _index(items))(text_or_empty(text_col)))
    # One block of items after another; what its pass finds is written before the next index is made.
    text, parts = F.sha2(text_or_empty(text_col), 256), []
    key = unused(docs.columns, "text_key")
    with scratch(docs.sparkSession):
        shared = _shared(items)
        for k in range(count):
            index = _index(items.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k), shared)
            found = docs.select(text.alias(key), _matcher(docs, index)(text_or_empty(text_col)).alias("found"))
            parts.append(written(found.where(F.size("found") > 0).dropDuplicates([key])))
        found = reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.flatten(F.collect_list("found")).alias(out))
        found = written(found, keep=True)
    joined = join_ids(docs.withColumn(key, text), found, key, "left", F.size(out))
    return joined.withColumn(out, F.coalesce(out, F.array().cast(MATCH))).select(*(F.col(f"`{c}`") for c in docs.columns), out)


def _matcher(docs: DataFrame, index: ItemIndex):
    shared = docs.sparkSession.sparkContext.broadcast(index)

    @F.arrow_udf(MATCH)
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [[dict(zip(("item_id", "similarity", "first_word", "n_words"), m)) for m in own] for _, data, offsets in row_chunks(texts) for own in shared.value.rows(words_in(data, offsets, split_punctuation=True))]
            yield pa.array(rows, MATCH_TYPE)
        release_memory()

    return apply


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, the items it contains in order, their number, the best similarity and contaminated."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = find_matches(rows, benchmark)
    return found.select(
        F.col("id").alias(id_col),
        (F.size("matches") > 0).alias("contaminated"),
        F.size("matches").cast("long").alias("n_items"),
        F.array_sort(F.array_distinct(F.col("matches.item_id"))).alias("item_ids"),
        F.array_max(F.col("matches.similarity")).alias("best_similarity"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose texts contain no benchmark item."""
    columns, out = docs.columns, unused(docs.columns, "matches")
    marked = find_matches(docs, benchmark, text_col, out=out)
    return marked.where(F.size(out) == 0).select(*(F.col(f"`{c}`") for c in columns))
