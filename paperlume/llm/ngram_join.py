"""N-gram Jaccard self-join of whole texts, and the components of its links.

Method: a text's set holds the hashes of its distinct runs of ``size`` words. Sets are banded by
size so that two linked sets lie in one band or in neighbouring ones. Within the tiles of a band
pair, the hash space is cut into more parts than two linked sets can have differing elements, so
they agree in at least one part; equal parts are the keys of candidate lists. Candidates pass a
bound on their overlap from bit counts of hashed bitmaps before the exact intersection of sorted
arrays (see ``linking``). Nothing is approximate: every link is found.

Before that, texts that cannot be linked are set aside: a set of n elements of which more than
(1 - t) * n occur in no other set has no partner. For this only the elements with the smallest
hashes are counted, a fixed share of all; what the share shows is a lower bound, so it is safe.

Scale: equal sets are one node. One narrow pass over all texts, one pre-aggregated shuffle of the
counted share of elements, and one shuffle of texts to pick the candidates' texts. Lists are never
gathered in one task.

Edge cases: null, empty and blank texts have an empty set and are linked with nothing; a row with a
null id is linked like any other and never names a component (which is null if no row of it has an
id); repeated ids are separate rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import columns_named, join_ids, releasing, scratch, text_or_empty, written
from .linking import SET, connect, linkable, list_column, set_rows, shared_lists
from .words import mix, row_chunks, words_in

SIZE, PERCENT = 4, 85
#: Share of all elements that is counted, in units of the share that a linked set may have alone.
COUNTED = 1.6
_U64 = np.uint64


def token_sets(column: pa.Array, size: int) -> Iterator[list[np.ndarray]]:
    """The sorted distinct shingle hashes of each row, for some rows at a time."""
    for _, data, offsets in row_chunks(column):
        runs, bounds = words_in(data, offsets).shingles(size)
        yield [np.unique(runs[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def node_of(tokens: np.ndarray) -> int:
    """A 64-bit name of a set."""
    with np.errstate(over="ignore"):
        total = mix(tokens).sum(dtype=_U64) + _U64(len(tokens)) * _U64(0x9E3779B97F4A7C15)
    return int(mix(np.array([total], _U64)).view(np.int64)[0])


def summaries(docs: DataFrame, size: int, share: float) -> DataFrame:
    """Per row of (id, text): id, n, node and those of its tokens that are counted."""
    limit = _U64(int(share * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, counted = [], [], []
            for tokens in chain.from_iterable(token_sets(batch.column(1), size)):
                sizes.append(len(tokens))
                nodes.append(node_of(tokens))
                counted.append(tokens[: np.searchsorted(tokens, limit)].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), list_column(counted)], names=["id", "n", "node", "counted"])

    return docs.mapInArrow(releasing(run), "id long, n long, node long, counted array<long>")


class SizeBands:
    """Size bands and the number of parts in each, for links at ``percent`` hundredths."""

    def __init__(self, percent: int):
        self.percent, self.starts = percent, [1]

    def _grow(self, n: int) -> None:
        while self.starts[-1] <= n:
            last = self.starts[-1]
            self.starts.append(max(last + 1, (last - 1) * 100 // self.percent + 1))

    def band(self, n: int) -> int:
        self._grow(n)
        return int(np.searchsorted(self.starts, n, side="right")) - 1

    def most_differing(self, band: int) -> int:
        """Elements that only one of two linked sets has, the smaller of them in ``band``."""
        while len(self.starts) < band + 3:
            self._grow(self.starts[-1])
        a, b = self.starts[band + 1] - 1, self.starts[band + 2] - 1
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def keys(self, tokens: np.ndarray) -> np.ndarray:
        """Keys of the tiles' lists that a set belongs to."""
        own, out = self.band(len(tokens)), []
        mixed = mix(tokens ^ _U64(0x5BF03635D1B2C4E7))
        for band in (own, own - 1) if own else (own,):
            most = self.most_differing(band)
            parts = most + 3 + most // 8
            part = ((mixed >> _U64(32)) * _U64(parts) >> _U64(32)).astype(np.int64)
            count = np.bincount(part, minlength=parts)
            order = np.argsort(part, kind="stable")
            ends = np.cumsum(count)
            with np.errstate(over="ignore"):
                sums = np.zeros(len(tokens) + 1, _U64)
                np.cumsum(mix(mixed[order]), out=sums[1:])
                content = sums[ends] - sums[ends - count]
                key = mix(content + mix(np.arange(parts, dtype=_U64) * _U64(0xD1B54A32D192ED03) + _U64(band + 1)) + count.astype(_U64))
            # Parts of one element or none say little; they are needed only where fuller ones are too few.
            full = count >= 2
            out.append(key[full] if full.sum() > most else key)
        return np.concatenate(out)


def _full_sets(texts: DataFrame, size: int) -> DataFrame:
    """The set of each text, in the columns of ``SET``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sets in token_sets(batch.column(0), size):
                yield set_rows(sets, list(map(node_of, sets)))

    return texts.mapInArrow(releasing(run), SET)


def tile_keys(sets: DataFrame, percent: int) -> DataFrame:
    """(key, node): the lists of the tiles that each set belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = SizeBands(percent)
        for batch in batches:
            keys = [bands.keys(tokens.values.to_numpy(zero_copy_only=False).view(_U64)).view(np.int64) for tokens in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), list_column(keys)], names=["node", "keys"])

    return sets.select("node", "tokens").mapInArrow(releasing(run), "node long, keys array<long>").select(F.explode("keys").alias("key"), "node")


def join_groups(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, n_shingles, component_id (smallest id reachable by links) and n_copies (rows with an equal set)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    with scratch(docs.sparkSession):
        seen, nodes, open_nodes = _open_nodes(rows, size, percent)
        found = _linked(rows, open_nodes, size, percent)
        named = written(nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")))
        heads = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
        by_node = named.join(heads, "component").select("node", "component_id", "copies")
        out = seen.join(by_node, "node", "left").select(
            F.col("id").alias(id_col),
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
            F.coalesce("copies", F.lit(1)).alias("n_copies"),
        )
        return written(out, keep=True)


def _open_nodes(rows: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of (id, text): (id, n, node) of every row, (node, first_id, copies) of every set, and (node, first_id) of those that may be linked."""
    spare = 100 - percent
    with scratch(rows.sparkSession):
        seen = written(summaries(rows, size, COUNTED * spare / 100))
        nodes = seen.where("n > 0").groupBy("node").agg(F.min("id").alias("first_id"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"))
        nodes = written(nodes, keep=True)
        # Elements that one node alone has, counted by node.
        alone = seen.select(F.explode("counted").alias("token"), "node").groupBy("token").agg(F.min("node").alias("node"), F.max("node").alias("last")).where("node = last")
        alone = alone.groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
        open_nodes = nodes.join(alone, "node", "left").where((spare * F.col("n") >= percent) & (100 * F.coalesce("alone", F.lit(0)) <= spare * F.col("n")))
        open_nodes = written(open_nodes.select("node", "first_id"), keep=True)
        return written(seen.select("id", "n", "node"), keep=True), nodes.select("node", "first_id", "copies"), open_nodes


def _linked(rows: DataFrame, open_nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, component) of the sets among ``open_nodes`` that are linked with another."""
    with scratch(rows.sparkSession):
        # A set that has an id is taken from that row; one that only rows without an id hold, from all of those.
        wanted = written(open_nodes.select(F.col("first_id").alias("id")).where("id IS NOT NULL").distinct())
        texts = join_ids(rows, wanted, "id", "left_semi").select("text")
        if open_nodes.where("first_id IS NULL").take(1):
            texts = texts.unionByName(rows.where("id IS NULL").select("text").dropDuplicates())
        sets = join_ids(_full_sets(texts, size), open_nodes.select("node"), "node", "left_semi")
        sets = written(sets.dropDuplicates(["node"]))
        # Among the candidates all elements are counted.
        sets = join_ids(sets, linkable(sets, percent), "node", "left_semi")
        lists = shared_lists(tile_keys(sets, percent))
        return written(connect(lists, sets, percent), keep=True)


def keep_one_per_group(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that name their group; rows without an id stay."""
    with scratch(docs.sparkSession):
        groups = join_groups(docs, size, percent, id_col, text_col)
        removed = written(groups.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct(), keep=True)
    return join_ids(docs, removed, id_col, "left_anti").select(*columns_named(docs.columns))


def oracle(size: int, percent: int, more: str = "") -> str:
    """DuckDB SQL for the groups of ``documents``: all pairs that share a shingle, and what links reach, one set for each text of copies."""
    return rf"""
WITH RECURSIVE cut AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {size - 2}), lambda i: array_to_string(w[i : i + {size - 1}], ' ')) END)) AS s FROM cut),
classes AS (SELECT min(doc_id) AS class, s, len(s) AS n, count(*) AS copies FROM sets WHERE len(s) > 0 GROUP BY s),
flat AS (SELECT class, unnest(s) AS x FROM classes),
pairs AS (SELECT a.class AS a, b.class AS b, count(*) AS common FROM flat a JOIN flat b ON a.x = b.x AND a.class < b.class GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN classes p ON p.class = a JOIN classes q ON q.class = b WHERE 100 * common >= {percent} * (p.n + q.n - common)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(class, other) AS (SELECT class, class FROM classes UNION SELECT class, b FROM reach JOIN ways ON other = a),
tops AS (SELECT class, min(other) AS top FROM reach GROUP BY class)
SELECT doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(top, doc_id) AS component_id, {more}coalesce(copies, 1) AS n_copies FROM sets s LEFT JOIN classes USING (s) LEFT JOIN tops USING (class)
"""
