"""From lists of sets that may be similar to groups of sets that are, without all pairs of a list.

A list holds the nodes that share a key. In each of a few rounds one node of a list, its lead, is
compared with those nodes of the list that are not yet connected with it; in a list of copies of
one text that ties nearly all of them together. Lists whose nodes are all connected are done.
After that all pairs of a list across components are compared, in tiles of blocks of nodes. So
each candidate pair is compared, or its nodes are known to be connected: components are those of
all candidate pairs, while a list of n copies costs n comparisons.

A comparison first bounds the overlap from above by the parities of hashed bits: each differing
bit of two such bitmaps needs an element that only one set has. A short bitmap of fixed length rules
out most pairs, one of two to four bits an element nearly all others. Only what passes both is
verified by the exact intersection of the two sorted arrays, so few pairs ever carry an array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import join_ids, releasing, scratch, written
from .components import components

BITS = 512
#: Rounds with leads, and the pairs per row up to which they are left out.
ROUNDS, FEW = 2, 6
#: Nodes of a block of a list; a task compares two blocks at a time.
TILE, LOW = 512, 16


def parity_bits(tokens: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The parity of the number of tokens that fall on each of ``bits`` bits, as 64-bit words."""
    counts = np.bincount((tokens >> np.uint64(36)).astype(np.int64) % bits, minlength=bits)
    return np.packbits(counts & 1, bitorder="little").view(np.int64)


def wide_bits(tokens: np.ndarray) -> np.ndarray:
    """``parity_bits`` of a power of two of bits, twice as many as tokens at least; half of it folds onto the other half."""
    return parity_bits(tokens, max(BITS, 1 << (2 * len(tokens) - 1).bit_length()))


SET = "node long, n long, bits array<long>, wide array<long>, tokens array<long>"


def set_rows(sets: list[np.ndarray], nodes: list[int]) -> pa.RecordBatch:
    """Rows of ``SET``: a set's name, its size, its bitmaps and its sorted elements."""
    columns = [list(map(parity_bits, sets)), list(map(wide_bits, sets)), [x.view(np.int64) for x in sets]]
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(map(len, sets), pa.int64()), *map(list_column, columns)], names=["node", "n", "bits", "wide", "tokens"])


def list_column(values: list[np.ndarray]) -> pa.Array:
    """An Arrow list column of 64-bit integers."""
    offsets = np.r_[0, np.cumsum(np.fromiter(map(len, values), np.int64, len(values)))]
    flat = np.concatenate([*values, np.zeros(0, np.int64)]).astype(np.int64, copy=False)
    return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(flat)).cast(pa.list_(pa.int64()))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _may_reach(percent: int) -> Column:
    """Whether 100 * overlap >= percent * union is possible, from sizes and bitmaps."""
    differing = F.aggregate(F.zip_with("a_bits", "b_bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    both = F.col("a_n") + F.col("b_n")
    return (both - differing) * (100 + percent) >= 2 * percent * both


def _rows_of(column: pa.Array, rows: np.ndarray, width: int) -> np.ndarray:
    """The lists of ``width`` values at these rows of a list column, as a matrix."""
    starts = column.offsets.to_numpy()[rows]
    return column.values.to_numpy(zero_copy_only=False).view(np.uint64)[starts[:, None] + np.arange(width)]


def within_bound(a: pa.Array, b: pa.Array, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which rows' wide bitmaps allow 100 * overlap >= percent * union; ``sizes`` are those of both sets together."""
    widths = np.stack([np.diff(x.offsets.to_numpy()) for x in (a, b)], 1)
    differing = np.zeros(len(sizes), np.int64)
    for left, right in np.unique(widths, axis=0).tolist():
        rows = np.flatnonzero((widths == (left, right)).all(1))
        least = min(left, right)
        for at in range(0, len(rows), step := max(1, (1 << 20) // max(left, right))):
            own = rows[at : at + step]
            folded = [np.bitwise_xor.reduce(_rows_of(x, own, w).reshape(len(own), -1, least), axis=1) for x, w in ((a, left), (b, right))]
            differing[own] = np.bitwise_count(folded[0] ^ folded[1]).sum(1, dtype=np.int64)
    return (sizes - differing) * (100 + percent) >= 2 * percent * sizes


def similar_pairs(pairs: DataFrame, sets: DataFrame, percent: int, bounded: bool = False) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have 100 * intersection >= percent * union.

    ``sets`` has the columns of ``SET``, one row a node. ``bounded`` pairs have passed the short bitmap already.
    """
    if not bounded:
        for side in ("a", "b"):
            pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("n").alias(f"{side}_n"), F.col("bits").alias(f"{side}_bits")), side)
        pairs = pairs.where(_may_reach(percent)).select("a", "b")
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("n").alias(f"{side}_n"), F.col("wide").alias(f"{side}_wide")), side)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            keep = within_bound(batch.column(4), batch.column(5), sizes, percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # Written, so that the joins with the arrays are planned by the number of pairs that are left.
    pairs = written(pairs.select("a", "b", "a_n", "b_n", "a_wide", "b_wide").mapInArrow(releasing(bound), "a long, b long"))
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("tokens").alias(f"{side}_tokens")), side)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            left, right = (batch.column(k) for k in (2, 3))
            for k in range(len(batch)):
                x, y = (side[k].values.to_numpy(zero_copy_only=False) for side in (left, right))
                shared = overlap(x, y)
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "a_tokens", "b_tokens").mapInArrow(releasing(verify), "a long, b long")


def linkable(sets: DataFrame, percent: int) -> DataFrame:
    """The nodes that may have a similar set: at most (1 - t) of their elements occur in no other set."""
    alone = sets.select(F.explode("tokens").alias("token"), "node").groupBy("token").agg(F.min("node").alias("node"), F.max("node").alias("last")).where("node = last")
    counted = sets.select("node", "n").join(alone.groupBy("node").agg(F.count(F.lit(1)).alias("alone")), "node", "left")
    return written(counted.where(100 * F.coalesce("alone", F.lit(0)) <= (100 - percent) * F.col("n")).select("node"))


def shared_lists(postings: DataFrame) -> DataFrame:
    """(key, node) of the lists that hold at least two nodes; repeated rows count once."""
    with scratch(postings.sparkSession):
        several = postings.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
        return written(join_ids(postings, written(several.select("key")), "key", "left_semi").select("key", "node").distinct(), keep=True)


def connect(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the nodes that have a similar node in one of their lists."""
    spark = lists.sparkSession
    known, placed = None, lists.withColumn("c", F.col("node"))
    with scratch(spark):
        for turn in range(ROUNDS + 1):
            placed, known, done = _round(turn, placed, known, sets, percent)
            if done:
                break
        return written(known, keep=True) if known is not None else spark.createDataFrame([], "node long, component long")


def _round(turn: int, placed: DataFrame, known: DataFrame | None, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame | None, bool]:
    """The lists (key, node, c) that still hold several components, what is connected after this round, and whether it was the last."""
    with scratch(placed.sparkSession):
        if known is not None:
            placed = placed.drop("c").join(known, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"))
        mixed = placed.groupBy("key").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least < most")
        placed = written(placed.join(mixed.select("key"), "key", "left_semi"), keep=True)
        rows, square = placed.groupBy("key").agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.sum("n"), F.sum(F.col("n") * F.col("n"))).first()
        if not rows:
            return placed, known, True
        last = turn == ROUNDS or square <= FEW * rows
        pairs = _across(placed, sets, percent) if last else _with_leads(placed, turn)
        edges = similar_pairs(pairs, sets, percent, bounded=last)
        if known is not None:
            # Components found so far stand for their nodes.
            edges = edges.unionByName(known.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")))
        return placed, written(components(edges), keep=True), last


def _with_leads(placed: DataFrame, turn: int) -> DataFrame:
    """The lead of each list with the list's nodes of other components.

    The order that makes a lead is one for all lists, so the many lists of one group agree on few.
    """
    leads = placed.groupBy("key").agg(F.min_by(F.struct("node", "c"), F.xxhash64(F.lit(turn), "node")).alias("lead"))
    pairs = placed.join(leads, "key").where(F.col("c") != F.col("lead.c"))
    return pairs.select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct()


def _across(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of a list in different components whose bitmaps do not rule them out.

    Lists are cut into blocks by a hash of the node and pairs of blocks are tiles, so a task holds
    two blocks at a time; only pairs that pass the bound become rows.
    """
    blocks = placed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("blocks"))
    # Of the lists that a pair shares, the one with the least key reports it, as far as LOW keys show.
    low = placed.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("key")), 1, LOW).alias("low"))
    low = low.withColumn("low", F.concat("low", F.array_repeat(F.lit((1 << 63) - 1), F.lit(LOW) - F.size("low"))))
    described = sets.select("node", F.col("n").alias("size"), "bits").join(low, "node")
    rows = placed.join(described, "node").join(blocks, "key")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "c", "size", "bits", "low")
    dealt = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[np.ndarray] = []
        for batch in batches:
            own = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(7)]
            own.append(batch.column(7).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, BITS // 64))
            own.append(batch.column(8).flatten().to_numpy(zero_copy_only=False).reshape(-1, LOW))
            own = [np.concatenate(x) for x in zip(left, own)] if left else own
            starts = np.flatnonzero(np.r_[True, (np.diff(own[0]) != 0) | (np.diff(own[1]) != 0) | (np.diff(own[2]) != 0)])
            yield _pairs_of([own[k][: starts[-1]] for k in range(9)], starts, percent)
            left = [x[starts[-1] :] for x in own]
        if left:
            yield _pairs_of(left, np.array([0, len(left[0])]), percent)

    return dealt.mapInArrow(releasing(compare), "a long, b long").distinct()


def _pairs_of(columns: list[np.ndarray], starts: np.ndarray, percent: int) -> pa.RecordBatch:
    """The pairs of the tiles that begin at all but the last of ``starts``."""
    key, lo, hi, block, node, c, size, bits, low = columns
    first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for start, stop in zip(starts[:-1].tolist(), starts[1:].tolist()):
        x = y = np.arange(start, stop)
        if lo[start] != hi[start]:
            x, y = x[block[x] == lo[start]], y[block[y] == hi[start]]
        both = size[x][:, None] + size[y][None]
        differing = np.bitwise_count(bits[x][:, None] ^ bits[y][None]).sum(2, dtype=np.int64)
        near = ((both - differing) * (100 + percent) >= 2 * percent * both) & (c[x][:, None] != c[y][None]) & ((lo[start] != hi[start]) | (x[:, None] < y[None]))
        i, j = np.nonzero(near)
        for at in range(0, len(i), 16_384):
            own, other = low[x[i[at : at + 16_384]]], low[y[j[at : at + 16_384]]]
            earlier = ((own[:, :, None] == other[:, None]) & (own < key[start])[:, :, None]).any((1, 2))
            near[i[at : at + 16_384], j[at : at + 16_384]] = ~earlier
        i, j = np.nonzero(near)
        first.append(node[x[i]])
        second.append(node[y[j]])
    a, b = np.concatenate(first), np.concatenate(second)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
