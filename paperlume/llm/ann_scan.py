"""Nearest neighbours by inner product: probed lists and an adaptive scan of rotated dimensions.

Method: a k-means of a bounded sample gives the lists; every vector is put into the list of its
nearest centroid. A query probes the lists whose centroids have the largest inner products with
it. Vectors are rotated onto the principal axes of the sample, so that the first columns tell most,
and laid out in blocks of columns. After each block a hypothesis test compares the distance seen so
far with the distance of the query's bar, its k-th best score until now: no more than ``MISS`` of
the sampled true neighbours had a larger part of their distance in those columns, so a (query,
candidate) pair that has more is abandoned. Blocks are multiplied as matrices while many pairs live
and pair by pair after that. What reaches the end is scored exactly on the original vectors.

A query first searches its nearest lists, until they hold ``NEAR`` times k rows; the k-th best there
is its bar for all other lists, and it rises with each list of a tile.

The number of probed lists is the smallest that finds ``COVERAGE`` of the true neighbours of
sampled queries in the sample. Data without clusters need many lists; that is measured, not assumed.

Scale: lists are dealt into cells and cells into tiles of about ``TILE`` rows by a hash of the id,
so one very common vector fills many tiles, not one. Queries are dealt into blocks too and go only
to cells they probe; a task compares one block with one tile. All pairs of a block and a tile that
it probes have to meet, so vectors are copied once for each ``QUERY_BLOCK`` queries. Each tile returns at most
k rows a query, few beyond the nearest lists; ranks come from a window over those.

Edge cases: vectors that are null, all zero, of another length than most of the sample, or hold a
null or non-finite component take no part, nor do null ids; rows with the query's own id are not
its candidates; ties go to the smaller id; with fewer than k candidates all are returned; equal rows
count once; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import scratch, written

K, QUERY_EVERY = 20, 20
#: Vectors that the index is fitted on.
SAMPLE = 8192
MAX_LISTS, TILE, QUERY_BLOCK = 1024, 8192, 16_384
COVERAGE, NEAR = 0.98, 10
#: Columns of a block, the share of true neighbours that a test may miss, and the share of live pairs up to which they are taken one by one.
BLOCK, MISS, FEW = 8, 0.005, 0.4


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): the vectors that take part, in double precision."""
    v = F.col("v")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL").where(fine)


@dataclass
class Index:
    """Centroids, rotation, number of probed lists and, for each block of columns, the largest part of a neighbour's distance in it and those before it."""

    centroids: np.ndarray
    rotation: np.ndarray
    probes: int
    parts: np.ndarray

    def lists_of(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(x @ self.centroids.T - 0.5 * (self.centroids**2).sum(1), axis=1)

    def probed(self, queries: np.ndarray, held: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest lists of each query, those that hold ``least`` rows together, and the other lists it probes."""
        order = np.argsort(-(queries @ self.centroids.T), axis=1, kind="stable")
        before = np.cumsum(held[order], axis=1) - held[order]
        out = []
        for wanted in (before < least, (np.arange(order.shape[1]) < self.probes) & (before >= least)):
            out.append(np.zeros(order.shape, bool))
            np.put_along_axis(out[-1], order, wanted, axis=1)
        return out[0], out[1]


def _fit(x: np.ndarray, lists: int, k: int) -> Index:
    r = np.random.default_rng(17)
    centroids = x[r.choice(len(x), min(lists, len(x)), replace=False)].copy()
    for _ in range(12):
        own = np.argmax(x @ centroids.T - 0.5 * (centroids**2).sum(1), axis=1)
        count = np.bincount(own, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        centroids[count > 0] = sums[count > 0] / count[count > 0, None]
    rotation = np.linalg.eigh(np.cov(x.T) if len(x) > 1 else np.eye(x.shape[1]))[1].reshape(x.shape[1], -1)[:, ::-1] if x.shape[1] > 1 else np.eye(1)
    own = np.argmax(x @ centroids.T - 0.5 * (centroids**2).sum(1), axis=1)
    asked = r.choice(len(x), min(512, len(x)), replace=False)
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-scores, axis=1)[:, :k]
    order = np.argsort(-(x[asked] @ centroids.T), axis=1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(len(centroids))[None], axis=1)
    reached = np.sort(np.take_along_axis(rank, own[best], axis=1).ravel())
    probes = int(reached[min(len(reached) - 1, int(COVERAGE * len(reached)))]) + 1
    apart = ((x[asked][:, None] - x[best]) @ rotation).reshape(-1, x.shape[1]) ** 2
    until = np.cumsum(apart, axis=1)[:, BLOCK - 1 :: BLOCK]
    whole = apart.sum(1)
    parts = np.quantile((until / np.maximum(whole, 1e-300)[:, None])[whole > 0], 1 - MISS, axis=0) if (whole > 0).any() else np.ones(until.shape[1])
    return Index(centroids, rotation, probes, np.minimum(parts * (1 + 1e-6), 1 + 1e-9))


def fit_index(vectors: DataFrame, rows: int, k: int = K) -> Index | None:
    """An index fitted, in one task, on at most ``SAMPLE`` of the usable vectors (id, v)."""
    lists = max(1, min(MAX_LISTS, int(rows**0.5)))
    sample = vectors.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [p for p in batches if len(p)]
        if parts:
            found = pd.concat(parts, ignore_index=True)
            width = found["v"].map(len).mode()[0]
            found = found[found["v"].map(len) == width]
            yield pd.DataFrame({"index": [pickle.dumps(_fit(np.stack(found["v"]), lists, k))]})

    fitted = sample.coalesce(1).mapInPandas(run, "index binary").collect()
    return pickle.loads(fitted[0]["index"]) if fitted else None


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _pairs(index: Index, rq: np.ndarray, rv: np.ndarray, most: np.ndarray, done: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of ``rq`` and of ``rv`` are left as pairs once all blocks are seen; ``most`` is the distance each pair may have.

    ``done`` collects how many columns of pairs were computed, and how many there are.
    """
    width = rq.shape[1]
    done[1] += most.size * width
    seen = np.zeros(most.shape)
    row = column = None
    for b, d in enumerate(range(0, width, BLOCK)):
        stop = min(width, d + BLOCK)
        part = index.parts[b] if b < len(index.parts) else 1 + 1e-9
        x, y = rq[:, d:stop], rv[:, d:stop]
        if row is None:
            seen += (x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * (x @ y.T)
            done[0] += most.size * (stop - d)
            live = seen <= most * part + 1e-9
            if stop == width or np.count_nonzero(live) <= FEW * live.size:
                row, column = np.nonzero(live)
                seen, most = seen[row, column], most[row, column]
        else:
            seen = seen + ((x[row] - y[column]) ** 2).sum(1)
            done[0] += len(row) * (stop - d)
            live = seen <= most * part + 1e-9
            row, column, seen, most = row[live], column[live], seen[live], most[live]
    return row, column


def scan(index: Index, q_ids: np.ndarray, q: np.ndarray, bar: np.ndarray, v_ids: np.ndarray, v: np.ndarray, v_list: np.ndarray, probed: np.ndarray, k: int, done: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, vector ids and scores of the best k of the tile for each query, as far as they reach its bar."""
    bar = bar.copy()
    rq, rv = q @ index.rotation, v @ index.rotation
    q2, v2 = (q**2).sum(1), (v**2).sum(1)
    row, column, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for own in np.unique(v_list):
        cand = np.flatnonzero(v_list == own)
        asking = np.flatnonzero(probed[:, own])
        for at in range(0, len(asking), step := max(1, 1_000_000 // len(cand))):
            ask = asking[at : at + step]
            with np.errstate(invalid="ignore"):
                most = q2[ask][:, None] + v2[cand][None] - 2 * (bar[ask][:, None] - 1e-9)
            i, j = _pairs(index, rq[ask], rv[cand], most, done)
            i, j = ask[i], cand[j]
            other = q_ids[i] != v_ids[j]
            i, j = i[other], j[other]
            row, column, score = np.r_[row, i], np.r_[column, j], np.r_[score, np.einsum("ij,ij->i", q[i], v[j])]
        # The best k of each query, and bars that rise with them.
        order = np.lexsort((v_ids[column], -score, row))
        row, column, score = row[order], column[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        last = place == k - 1
        bar[row[last]] = np.maximum(bar[row[last]], score[last])
        row, column, score = row[place < k], column[place < k], score[place < k]
    return q_ids[row], v_ids[column], score


def _distinct(ids: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Rows of different ids or vectors; equal ones count once."""
    order = np.lexsort((v.sum(1), ids))
    again = np.r_[False, (ids[order][1:] == ids[order][:-1]) & (v[order][1:] == v[order][:-1]).all(1)]
    return np.sort(order[~again])


def search(vectors: DataFrame, k: int = K, query_every: int = QUERY_EVERY, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row whose id is a multiple of ``query_every``."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    total = rows.count()
    index = fit_index(rows, total, k)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = _Search(spark, index, total, k, query_every)
    with scratch(spark):
        listed = written(rows.where(F.size("v") == index.centroids.shape[1]).mapInArrow(found.assign, "id long, v array<double>, list int"))
        asking = listed.where(F.col("id") % query_every == 0).select("id", "v")
        first = written(_best(found.compared(listed, asking.withColumn("bar", F.lit(float("-inf"))), near=True), k))
        bars = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("bar"))
        barred = asking.join(bars.withColumnRenamed("query_id", "id"), "id", "left").withColumn("bar", F.coalesce("bar", F.lit(float("-inf"))))
        rest = found.compared(listed, barred, near=False)
        ranked = _best(first.select("query_id", "vec_id", "score").unionByName(rest), k)
        return written(ranked.select("query_id", "rank", "vec_id", "score"), keep=True)


def _best(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


class _Search:
    """Routes queries and vectors to tiles and compares them."""

    def __init__(self, spark: SparkSession, index: Index, total: int, k: int, query_every: int):
        self.shared, self.k, self.least = spark.sparkContext.broadcast(index), k, NEAR * k
        self.width, self.lists = index.centroids.shape[1], len(index.centroids)
        self.cells = max(1, min(self.lists, -(-total // TILE)))
        self.blocks = max(1, -(-total // query_every // QUERY_BLOCK))
        self.held: np.ndarray | None = None

    def assign(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                own = pa.array(self.shared.value.lists_of(_matrix(batch.column(1), self.width)), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), own], names=["id", "v", "list"])

    def compared(self, listed: DataFrame, asking: DataFrame, near: bool) -> DataFrame:
        """(query_id, vec_id, score) of the queries (id, v, bar) in their nearest lists, or in the others that they probe."""
        shared, width, lists, cells, blocks, k, least = self.shared, self.width, self.lists, self.cells, self.blocks, self.k, self.least
        if self.held is None:
            self.held = np.zeros(lists, np.int64)
            for row in listed.groupBy("list").count().collect():  # one row for each list, ``MAX_LISTS`` at most
                self.held[row["list"]] = row["count"]
        held = self.held
        tiles = [max(1, -(-int(held[c::cells].sum()) // (2 * TILE))) for c in range(cells)]
        in_cell = F.array(*map(F.lit, tiles))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    probed = shared.value.probed(_matrix(batch.column(1), width), held, least)[0 if near else 1]
                    padded = np.zeros((len(batch), -(-lists // cells) * cells), bool)
                    padded[:, :lists] = probed
                    asked = padded.reshape(len(batch), -1, cells).any(1)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([np.flatnonzero(a).astype(np.int32) for a in asked], pa.list_(pa.int32()))], names=["id", "v", "bar", "cells"])

        def compare(queries: pa.Table, found: pa.Table) -> pa.Table:
            out: tuple = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            if queries.num_rows and found.num_rows:
                q, v, ids, own = _matrix(queries["v"], width), _matrix(found["v"], width), found["id"].to_numpy(), found["list"].to_numpy()
                rows = _distinct(ids, v)
                probed = shared.value.probed(q, held, least)[0 if near else 1]
                out = scan(shared.value, queries["id"].to_numpy(), q, queries["bar"].to_numpy(), ids[rows], v[rows], own[rows], probed, k, [0, 0])
            return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, out))))

        routed = asking.mapInArrow(route, "id long, v array<double>, bar double, cells array<int>")
        routed = routed.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).select("id", "v", "bar", "block", F.explode("cells").alias("cell"))
        routed = routed.select("*", F.explode(F.sequence(F.lit(0), F.get(in_cell, F.col("cell")) - 1)).alias("tile"))
        placed = listed.withColumn("cell", F.col("list") % cells)
        placed = placed.withColumn("tile", F.pmod(F.xxhash64("id"), F.get(in_cell, F.col("cell")).cast("long")).cast("int"))
        placed = placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")).alias("block"))
        keys = ["cell", "tile", "block"]
        return routed.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInArrow(compare, "query_id long, vec_id long, score double")
