"""What each order of five text filters removes, and what each filter removes on average over all orders.

A document fails filter A with under 100 words, B where distinct words are under 80 % of its words,
C where letters A-Z are over 10 % of its code points, D where it holds any of ``#$%&*|``, and E
where a smaller id of the whole table has the same text. Words are maximal runs of bytes other than
space and 0x09-0x0D, compared with their case.

Method: long-form window evaluation. Every document is a mask of the filters that it fails, and
equal masks of a part are one cell, counted before anything is shuffled. A cell's mask is unpivoted to one
row a filter, which meets the steps of the 120 orders that apply this filter. A running bit-or over
a cell's earlier steps of an order tells whether an earlier filter has removed it. Conditional sums
of cells are the counts of a step, and a window total of a filter's removals its shapley value.

Scale: texts are read once, in chunks, by Arrow functions; what leaves them is a narrow row of id, part,
digest and mask. Whether a text has a smaller id is a join on (digest, id), after minima combined
before the shuffle, so a text with very many copies is never one key. A part has at most 32 cells
and 600 rows of results, whatever its documents; the only broadcast is the table of 600 steps.

Edge cases: a null text is empty; a null part is the empty string; a row with a null id fails E
never, is the first of no text, and has no label; repeated rows are documents of their own, and rows
of the same id and text do not fail E by each other; of repeated labels any that is 1 counts; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import releasing, scratch, text_or_empty, written
from .words import row_chunks, words_in

FILTERS = "ABCDE"
BITS = {name: 1 << k for k, name in enumerate(FILTERS)}
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10

_CAPITAL, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_CAPITAL[ord("A") : ord("Z") + 1] = True
_MARK[list(b"#$%&*|")] = True
_BEGINS = (np.arange(256) & 0xC0) != 0x80


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each row."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[offsets])


def own_failures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of the filters A to D that each row fails; they look at nothing but its text."""
    words = words_in(data, offsets, fold_case=False)
    row, counts = words.row(), words.counts
    order = np.lexsort((words.hash, row))
    first = np.ones(len(order), bool)
    first[1:] = (np.diff(row[order]) != 0) | (words.hash[order][1:] != words.hash[order][:-1])
    distinct = np.bincount(row[order][first], minlength=len(counts))
    fails = {
        "A": counts < LEAST_WORDS,
        "B": 100 * distinct < LEAST_DISTINCT * counts,
        "C": 100 * _per_row(_CAPITAL[data], offsets) > MOST_CAPITALS * _per_row(_BEGINS[data], offsets),
        "D": _per_row(_MARK[data], offsets) > 0,
    }
    return sum(BITS[name] * failed.astype(np.int32) for name, failed in fails.items())


def _described(docs: DataFrame, id_col: str, part_col: str, text_col: str) -> DataFrame:
    """Per row: (id, part, digest of its text, mask of A to D)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, digests = [np.zeros(0, np.int32)], []
            for _, data, offsets in row_chunks(batch.column(2)):
                masks.append(own_failures(data, offsets))
                view = memoryview(np.ascontiguousarray(data))
                digests += [hashlib.sha256(view[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(np.concatenate(masks))], names=["id", "part", "digest", "mask"])

    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), part.alias("part"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(releasing(run), "id long, part string, digest binary, mask int")


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", part_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters that they fail."""
    with scratch(docs.sparkSession):
        rows = written(_described(docs, id_col, part_col, text_col))
        firsts = rows.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
        marked = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"))
        marked = marked.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
        again = F.col("id").isNotNull() & F.col("first").isNull()
        named = rows.where("id IS NOT NULL").join(firsts, ["digest", "id"], "left").join(marked, "id", "left")
        named = named.select("part", F.col("mask").bitwiseOR(F.when(again, BITS["E"]).otherwise(0)).alias("mask"), "good", "toxic")
        nameless = rows.where("id IS NULL").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
        counted = named.unionByName(nameless).groupBy("part", "mask")
        return written(counted.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic"))), keep=True)


def steps(spark: SparkSession) -> DataFrame:
    """(filter_order, step, filter) of all orders of the filters: 600 rows."""
    rows = [("".join(order), k, name) for order in permutations(FILTERS) for k, name in enumerate(order, 1)]
    return spark.createDataFrame(rows, "filter_order string, step int, filter string")


def audit(counted: DataFrame) -> DataFrame:
    """Per part, order and step: what is kept and removed, and how far the step's filter depends on the others.

    ``counted`` has the columns of ``cells``.
    """
    wide = counted.select("*", *(F.col("mask").bitwiseAND(bit).alias(name) for name, bit in BITS.items()))
    long = wide.unpivot(["part", "mask", "n", "good", "toxic"], list(FILTERS), "filter", "bit")
    placed = long.join(F.broadcast(steps(counted.sparkSession)), "filter")
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("earlier", F.coalesce(F.bit_or("bit").over(before), F.lit(0)))
    fails, gone = F.col("bit") > 0, F.col("earlier") > 0

    def total(condition: Column, what: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(what)).otherwise(0))

    counts = placed.groupBy("part", "filter_order", "step", "filter").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(fails & (F.col("mask") == F.col("bit"))).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"),
        total(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    return counts.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


ORACLE = r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), marked AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
failing AS (
  SELECT part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM words LEFT JOIN marked USING (doc_id)
), cells AS (
  SELECT part, list_concat(if(a, ['A'], []), if(b, ['B'], []), if(c, ['C'], []), if(d, ['D'], []), if(e, ['E'], [])) AS fails,
    count(*) AS n, sum(good::int) AS good, sum(toxic::int) AS toxic
  FROM failing GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT [p.x, q.x, r.x, s.x, t.x] AS o FROM letters p, letters q, letters r, letters s, letters t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), steps AS (SELECT o, array_to_string(o, '') AS filter_order, step::int AS step, o[step] AS own, o[: step - 1] AS earlier FROM orders, range(1, 6) r(step)),
counted AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (NOT list_has_any(fails, o[:step])), 0) AS kept,
    coalesce(sum(n) FILTER (list_contains(fails, own) AND NOT list_has_any(fails, earlier)), 0) AS removed,
    coalesce(sum(n) FILTER (list_contains(fails, own) AND list_has_any(fails, earlier)), 0) AS redundant,
    coalesce(sum(n) FILTER (fails = [own]), 0) AS unique_fails,
    coalesce(sum(good) FILTER (list_contains(fails, own) AND NOT list_has_any(fails, earlier)), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (list_contains(fails, own) AND NOT list_has_any(fails, earlier)), 0) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept::bigint AS kept, removed::bigint AS removed, redundant::bigint AS redundant, unique_fails::bigint AS unique_fails,
  good_lost::bigint AS good_lost, toxic_lost::bigint AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::bigint AS shapley
FROM counted
"""
