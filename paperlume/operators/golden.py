"""Golden cases: which expected passage a retrieved one is, how well a release finds them, and what got worse.

An expectation names a file and may name a page, a sheet and a quote. A result is the first
expectation that it satisfies; what is not named is not asked for. A release is compared case by case with the one before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import BLANK
from ..plans.registry import query
from ..sources.tables import table

K = 5
CASE = ["release", "case"]


def _flat(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, f"{BLANK}+", " ")))


def _key(page: Column, sheet: Column) -> Column:
    return F.xxhash64("case", "file", page, page.isNull(), sheet, sheet.isNull())


def satisfied(results: DataFrame, evidence: DataFrame) -> DataFrame:
    """``results`` (release, case, rank, file, page, sheet, text) that satisfy one of the ``evidence`` (case, expectation, file, page, sheet, quote), and its number.

    An expectation has one key of what it names. A result has the keys of all that it could satisfy: with
    and without its page, with and without its sheet. So any of many is found by one equal join, and no result
    meets expectations of other places; named places are compared again after the hash, then quotes.
    """
    none = F.lit(None)
    kinds = [(F.col("page"), F.col("sheet")), (none, F.col("sheet")), (F.col("page"), none), (none, none)]
    held = results.withColumn("key", F.explode(F.array_distinct(F.array(*(_key(p, s) for p, s in kinds)))))
    wanted = evidence.select(_key(F.col("page"), F.col("sheet")).alias("key"), *(F.col(c).alias(f"want_{c}") for c in ("case", "file", "page", "sheet", "quote")), "expectation")
    same = (F.col("case") == F.col("want_case")) & (F.col("file") == F.col("want_file"))
    for c in ("page", "sheet"):
        same = same & (F.col(f"want_{c}").isNull() | F.coalesce(F.col(c) == F.col(f"want_{c}"), F.lit(False)))
    quoted = F.col("want_quote").isNull() | (F.col("want_quote") == "") | F.coalesce(F.contains(_flat(F.col("text")), _flat(F.col("want_quote"))), F.lit(False))
    met = held.join(wanted, "key").where(same & quoted)
    return met.groupBy(*CASE, "rank").agg(F.min("expectation").alias("expectation"))


def case_outcomes(cases: DataFrame, found: DataFrame, k: int = K) -> DataFrame:
    """Per release and case of ``cases`` (release, case, wanted): rank of the first result that was expected, hits, precision, reciprocal rank and nDCG.

    ``found`` comes from ``satisfied``; a case without any such result has rank null.
    """
    near = F.col("rank") <= k
    hits = found.groupBy(*CASE).agg(F.min("rank").alias("first_rank"), F.count_if(near).alias("relevant"), F.countDistinct(F.when(near, F.col("expectation"))).alias("met"), F.sum(F.when(near, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("gain"))
    rows = cases.join(hits, CASE, "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("wanted", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select(
        *CASE, "wanted", "first_rank", F.coalesce(F.col("first_rank") <= 1, F.lit(False)).alias("hit_at_1"),
        F.coalesce(F.col("first_rank") <= k, F.lit(False)).alias("hit_at_5"), F.round(zero(F.col("met")) / F.col("wanted"), 6).alias("recall"), F.round(zero(F.col("relevant")) / k, 6).alias("precision"),
        F.round(zero(1 / F.col("first_rank")), 6).alias("reciprocal_rank"), F.round(zero(F.col("gain")) / ideal, 6).alias("ndcg"),
    )


def against_previous(outcomes: DataFrame, order: str = "release") -> DataFrame:
    """``outcomes`` with the outcome of the same case in the last release before that has it, and whether the case got worse.

    As-of by a window over a case's releases in ``order``: releases that left a case out do not stand between.
    """
    earlier = Window.partitionBy("case").orderBy(order)
    before = {"previous_release": "release", "previous_hit": "hit_at_5", "previous_rank": "first_rank"}
    rows = outcomes.withColumns({name: F.lag(c).over(earlier) for name, c in before.items()})
    return rows.withColumn("regressed", F.coalesce(F.col("previous_hit") & ~F.col("hit_at_5"), F.lit(False)))


def headline(compared: DataFrame) -> DataFrame:
    """Per release: its cases, mean measures, misses, and how much of the hits of the release before was lost over the cases both have."""
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    both = F.col("previous_hit").isNotNull()
    lost = F.avg(F.when(both, F.col("previous_hit").cast("int"))) - F.avg(F.when(both, F.col("hit_at_5").cast("int")))
    return compared.groupBy("release").agg(
        F.count(F.lit(1)).alias("cases"), share(F.col("hit_at_1")).alias("hit_at_1"), share(F.col("hit_at_5")).alias("hit_at_5"), share(F.col("precision")).alias("precision"), share(F.col("reciprocal_rank")).alias("mrr"), share(F.col("ndcg")).alias("ndcg"),
        F.count_if(~F.col("hit_at_5")).alias("misses"), F.count_if(F.col("regressed")).alias("regressed"), F.round(F.greatest(F.coalesce(lost, F.lit(0.0)), F.lit(0.0)), 6).alias("loss"),
    )


def golden_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Results and expectations of the star tables: a supplier is a case, a year a release, its dearest lines the results.

    Parts are the expectations of the supplier that their key falls to.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("release"), "l_partkey", "l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    order = Window.partitionBy("release", "l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey")
    best = lines.withColumn("rank", F.row_number().over(order)).where("rank <= 8")
    parts = table(spark, sf_dir, "part")
    shown = parts.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("file"), F.concat_ws("  ", "p_name", "p_type").alias("text"))
    results = best.join(shown, "l_partkey").select("release", F.col("l_suppkey").alias("case"), "rank", "file", F.col("l_linenumber").alias("page"), F.col("l_returnflag").alias("sheet"), "text")
    cases = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("cases"))
    named = parts.crossJoin(F.broadcast(cases)).withColumn("case", F.col("p_partkey") % F.col("cases"))
    place = F.row_number().over(Window.partitionBy("case").orderBy("p_partkey"))
    evidence = named.select(
        "case", place.alias("expectation"), F.col("p_brand").alias("file"), F.when(F.col("p_size") % 2 == 0, F.col("p_size") % 7 + 1).alias("page"),
        F.when(F.col("p_size") % 3 == 0, F.lit("N")).alias("sheet"), F.when(F.col("p_size") % 5 == 0, F.upper("p_name")).alias("quote"),
    )
    return results, evidence


_GOLDEN = """best AS (SELECT * FROM (SELECT *, year(l_shipdate) AS release, row_number() OVER (PARTITION BY year(l_shipdate), l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem) WHERE rank <= 8),
results AS (SELECT release, l_suppkey AS c, rank, p_brand AS file, l_linenumber AS page, l_returnflag AS sheet, lower(regexp_replace(p_name || '  ' || p_type, ' +', ' ', 'g')) AS text FROM best JOIN part ON p_partkey = l_partkey),
evidence AS (SELECT p_partkey % (SELECT count(*) FROM supplier) AS c, row_number() OVER (PARTITION BY p_partkey % (SELECT count(*) FROM supplier) ORDER BY p_partkey) AS e, p_brand AS file, CASE WHEN p_size % 2 = 0 THEN p_size % 7 + 1 END AS page,
  CASE WHEN p_size % 3 = 0 THEN 'N' END AS sheet, CASE WHEN p_size % 5 = 0 THEN lower(p_name) END AS quote FROM part),
met AS (SELECT release, r.c, rank, min(e) AS e FROM results r JOIN evidence v ON r.c = v.c AND r.file = v.file AND (v.page IS NULL OR v.page = r.page) AND (v.sheet IS NULL OR v.sheet = r.sheet) AND (v.quote IS NULL OR contains(r.text, v.quote)) GROUP BY ALL),
cases AS (SELECT DISTINCT release, c, wanted FROM results JOIN (SELECT c, count(*) AS wanted FROM evidence GROUP BY c) USING (c)),
h AS (SELECT release, c, min(rank) AS first_rank, count(*) FILTER (rank <= 5) AS relevant, count(DISTINCT e) FILTER (rank <= 5) AS met, sum(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END) AS gain FROM met GROUP BY ALL),
outcomes AS (SELECT release, c AS "case", wanted, CAST(first_rank AS INTEGER) AS first_rank, coalesce(first_rank <= 1, false) AS hit_at_1, coalesce(first_rank <= 5, false) AS hit_at_5, round(coalesce(met, 0) / wanted, 6) AS recall, round(coalesce(relevant, 0) / 5, 6) AS precision,
  round(coalesce(1 / first_rank, 0), 6) AS reciprocal_rank, round(coalesce(gain, 0) / list_sum(list_transform(range(1, least(wanted, 5) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM cases LEFT JOIN h USING (release, c)),
compared AS (SELECT *, lag(release) OVER w AS previous_release, lag(hit_at_5) OVER w AS previous_hit, lag(first_rank) OVER w AS previous_rank, coalesce(lag(hit_at_5) OVER w AND NOT hit_at_5, false) AS regressed FROM outcomes WINDOW w AS (PARTITION BY "case" ORDER BY release))"""


def _compared(spark, sf_dir) -> DataFrame:
    results, evidence = golden_tables(spark, sf_dir)
    wanted = evidence.groupBy("case").agg(F.count(F.lit(1)).alias("wanted"))
    outcomes = case_outcomes(results.select(*CASE).distinct().join(wanted, "case"), satisfied(results, evidence))
    return against_previous(outcomes)


@query("golden_run", f"WITH {_GOLDEN} SELECT * FROM compared")
def golden_run(spark, sf_dir):
    """The outcome of every case in every release, beside the release before."""
    return _compared(spark, sf_dir)


@query("golden_headline", f"""WITH {_GOLDEN} SELECT release, count(*) AS cases, round(avg(hit_at_1::INT), 6) AS hit_at_1, round(avg(hit_at_5::INT), 6) AS hit_at_5, round(avg(precision), 6) AS precision, round(avg(reciprocal_rank), 6) AS mrr, round(avg(ndcg), 6) AS ndcg,
count(*) FILTER (NOT hit_at_5) AS misses, count(*) FILTER (regressed) AS regressed, round(greatest(coalesce(avg(previous_hit::INT) - avg(hit_at_5::INT) FILTER (previous_hit IS NOT NULL), 0), 0), 6) AS loss FROM compared GROUP BY release""")
def golden_headline(spark, sf_dir):
    """Measures of each release, and what it lost against the one before."""
    return headline(_compared(spark, sf_dir))
