"""Near-duplicate texts by one-permutation MinHash, and one kept document of each group.

Method: a text's set holds the hashes of its distinct runs of ``size`` words. One permutation (the
hashes themselves) deals a set's elements to BANDS * ROWS bins, and a bin's value is its least element.
Optimal densification: an empty bin copies the bin that a hash of its own number and of the attempt
names, the first of them that is not empty, so equal sets fill their bins alike and every bin agrees
with a probability equal to the Jaccard similarity. Each band of ROWS bins is a bucket key. A pair at similarity 0.85
misses all buckets with a probability of (1 - 0.85**6)**32 < 3e-7.

In a bucket the candidate edges are a star: each member with the bucket's lead. Edges are confirmed
on the full sets; members that are connected then count as one, and the next star has another
lead. What buckets of several components are left after two stars is compared in tiles of two
blocks, bounded by bitmaps (see ``linking``), so no pair of a bucket is left out and no bucket has a cap.

Scale: one pass over the texts makes narrow rows of keys. Texts with equal sets are one node before
buckets are made, so a group of copies is one member. Buckets are joined by key only with those of two members at
least; the texts of their nodes alone are read again for the full sets.

Edge cases: null, empty and blank texts have an empty set and are linked with nothing; a row with a
null id is linked like any other and never names a component, which is null where no row of it has
an id; such a row is kept only then; repeated ids are separate rows; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import join_ids, releasing, scratch, text_or_empty, written
from .linking import SET, connect, list_column, set_rows, shared_lists
from .ngram_join import node_of, token_sets
from .words import mix

SIZE, PERCENT = 3, 85
BANDS, ROWS = 32, 6
_U64 = np.uint64


class OnePermutation:
    """Band keys of sets of 64-bit hashes."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        self.tries = np.zeros((self.bins, 0), np.int64)

    def _donors(self, attempt: int) -> np.ndarray:
        """The bin that each bin names at this attempt."""
        while self.tries.shape[1] <= attempt:
            named = np.arange(self.bins, dtype=_U64) + _U64(self.bins * (self.tries.shape[1] + 1))
            self.tries = np.c_[self.tries, (mix(named * _U64(0x9E3779B97F4A7C15)) % _U64(self.bins)).astype(np.int64)]
        return self.tries[:, attempt]

    def values(self, tokens: np.ndarray) -> np.ndarray:
        """The value of every bin of a set that is not empty."""
        spread = mix(tokens ^ _U64(0xA3B195354A39B70D))
        bins = ((spread >> _U64(32)) * _U64(self.bins) >> _U64(32)).astype(np.int64)
        out = np.full(self.bins, np.iinfo(_U64).max, _U64)
        np.minimum.at(out, bins, spread)
        full = np.zeros(self.bins, bool)
        full[bins] = True
        empty, attempt, made = np.flatnonzero(~full), 0, out.copy()
        while len(empty):
            donor = self._donors(attempt)[empty]
            found = full[donor]
            made[empty[found]] = out[donor[found]]
            empty, attempt = empty[~found], attempt + 1
        return made

    def keys(self, tokens: np.ndarray) -> np.ndarray:
        """One key a band."""
        total = mix(np.arange(self.bands, dtype=_U64) + _U64(0x2545F4914F6CDD1D))
        for column in self.values(tokens).reshape(self.bands, self.rows).T:
            total = mix(total * _U64(0x9E3779B97F4A7C15) + column)
        return total


def signatures(rows: DataFrame, size: int) -> DataFrame:
    """Per row of (id, text): its id, the size and the name of its set, and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = OnePermutation()
        none = np.zeros(0, np.int64)
        for batch in batches:
            sizes, nodes, keys = [], [], []
            for tokens in chain.from_iterable(token_sets(batch.column(1), size)):
                sizes.append(len(tokens))
                nodes.append(node_of(tokens))
                keys.append(hashing.keys(tokens).view(np.int64) if len(tokens) else none)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), list_column(keys)], names=["id", "n", "node", "keys"])

    return rows.mapInArrow(releasing(run), "id long, n long, node long, keys array<long>")


def _full_sets(texts: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sets in token_sets(batch.column(0), size):
                yield set_rows(sets, list(map(node_of, sets)))

    return texts.mapInArrow(releasing(run), SET)


def _linked(rows: DataFrame, seen: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, component) of the sets that a confirmed link joins to another."""
    with scratch(rows.sparkSession):
        # Equal sets have equal keys: those of the row that names a node are taken, found by both, so copies are not one key.
        keyed = seen.where("n > 0").select("id", "node", "keys")
        first = nodes.select("node", F.col("first_id").alias("id"))
        keyed = keyed.where("id IS NOT NULL").join(first, ["node", "id"]).unionByName(keyed.where("id IS NULL").join(first.where("id IS NULL").select("node"), "node"))
        lists = shared_lists(keyed.select(F.explode("keys").alias("key"), "node"))
        members = written(lists.select("node").distinct())
        heads = written(nodes.join(members, "node", "left_semi").select("node", F.col("first_id").alias("id")))
        texts = join_ids(rows, heads.select("id").where("id IS NOT NULL").distinct(), "id", "left_semi").select("text")
        if heads.where("id IS NULL").take(1):
            texts = texts.unionByName(rows.where("id IS NULL").select("text").dropDuplicates())
        sets = written(join_ids(_full_sets(texts, size), members, "node", "left_semi").dropDuplicates(["node"]))
        return written(connect(lists, sets, percent), keep=True)


def dedup(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, n_shingles, component_id (smallest id reachable by links), whether it is kept, and n_copies (rows with an equal set)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    with scratch(docs.sparkSession):
        seen = written(signatures(rows, size))
        nodes = written(seen.where("n > 0").groupBy("node").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies")))
        found = _linked(rows, seen, nodes, size, percent)
        named = written(nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")))
        heads = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
        by_node = written(named.join(heads, "component").select("node", "component_id", "copies"))
        component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
        out = join_ids(seen.select("id", "n", "node"), by_node, "node", "left").select(
            F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), F.coalesce("copies", F.lit(1)).alias("n_copies")
        )
        return written(out, keep=True)
