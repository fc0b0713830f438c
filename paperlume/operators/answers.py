"""Answers and what they rest on: citations, quotes, numbers and histories; see claims.py for what they state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import number_rows
from ..plans.registry import query
from ..sources.tables import table

#: Quoted characters an answer and a session may have, by mode. Fixed values are those of the mode's callers.
ANSWER_CHARS, SESSION_CHARS = 280, 1200


def sanitise_citations(citations: DataFrame, sources: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Of citations (answer, place, source, relevance and others) those of known sources, the most relevant of each source; first ones win ties.

    Sources are known to all answers, or by ``keys`` to theirs.
    """
    keys = keys or ["source"]
    known = citations.join(sources.select(*keys).distinct(), keys, "left_semi")
    weight = F.coalesce("relevance", F.lit(0.0))
    best = F.row_number().over(Window.partitionBy("answer", "source").orderBy(F.desc(weight), "place"))
    kept = known.withColumn("r", best).where("r = 1")
    rank = F.row_number().over(Window.partitionBy("answer").orderBy(F.desc(weight), "place", "source")).cast("long")
    return kept.withColumn("rank", rank).drop("place", "r")


_CITED = "SELECT l_orderkey AS answer, l_linenumber AS place, l_partkey % 40 AS source, CASE WHEN l_linenumber % 5 > 0 THEN l_discount END AS relevance FROM lineitem"


@query("sanitise_citations", f"""SELECT answer, source, relevance, row_number() OVER (PARTITION BY answer ORDER BY coalesce(relevance, 0) DESC, place, source) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY answer, source ORDER BY coalesce(relevance, 0) DESC, place) AS r
FROM ({_CITED}) WHERE source IN (SELECT p_partkey FROM part WHERE p_partkey % 3 > 0)) WHERE r = 1""")
def sanitise_citations_query(spark, sf_dir):
    relevance = F.when(F.col("l_linenumber") % 5 > 0, F.col("l_discount"))
    cited = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("answer"), F.col("l_linenumber").alias("place"), (F.col("l_partkey") % 40).alias("source"), relevance.alias("relevance"))
    return sanitise_citations(cited, table(spark, sf_dir, "part").where("p_partkey % 3 > 0").select(F.col("p_partkey").alias("source")))


def is_grounded(answered: Column, answer: Column, citations: Column) -> Column:
    """An answer that cites something, or is too short to need it."""
    return answered & ((citations > 0) | (F.length(answer) < 240))


@query("is_grounded", "SELECT conv_id, turn, turn % 4 > 0 AND (turn % 3 = 0 OR length(coalesce(text, '')) < 240) AS grounded FROM conversations WHERE role = 'assistant'")
def is_grounded_query(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return rows.select("conv_id", "turn", is_grounded(F.col("turn") % 4 > 0, F.coalesce("text", F.lit("")), F.when(F.col("turn") % 3 == 0, 1).otherwise(0)).alias("grounded"))


def limit_quote(quote: Column, used_in_session: Column, used_in_answer: Column, answer_chars: int = ANSWER_CHARS, session_chars: int = SESSION_CHARS) -> Column:
    """(quote, truncated): null without room; else cut at the last blank in the last two fifths, the ellipsis counted."""
    budget = F.least(F.lit(session_chars) - used_in_session, F.lit(answer_chars) - used_in_answer)
    room = budget - 1
    part = F.substring(quote, F.lit(1), room)
    blank = F.length(part) - F.instr(F.reverse(part), " ")
    cut = F.when((F.instr(part, " ") > 0) & (blank > room * 0.6), F.substring(part, F.lit(1), blank)).otherwise(part)
    short = F.length(quote) <= budget
    shown = F.when((budget <= 0) | (~short & (room <= 0)), F.lit(None).cast("string")).when(short, quote).otherwise(F.concat(F.regexp_replace(cut, r"\s+$", ""), F.lit("…")))
    return F.struct(shown.alias("quote"), ((budget <= 0) | ~short).alias("truncated"))


@query("quote_limit", """SELECT doc_id, CASE WHEN budget <= 0 OR (length(text) > budget AND budget <= 1) THEN NULL WHEN length(text) <= budget THEN text ELSE regexp_replace(CASE WHEN instr(part, ' ') > 0 AND length(part) - instr(reverse(part), ' ') > (budget - 1) * 0.6 THEN substr(part, 1, length(part) - instr(reverse(part), ' ')) ELSE part END, '\\s+$', '') || '…' END AS quote,
budget <= 0 OR length(text) > budget AS truncated FROM (SELECT doc_id, text, budget, substr(text, 1, CAST(greatest(budget - 1, 0) AS INTEGER)) AS part FROM (SELECT doc_id, coalesce(text, '') AS text, least(1200 - (doc_id % 13) * 100, 280 - (doc_id % 5) * 60) AS budget FROM documents))""")
def quote_limit_query(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", limit_quote(F.coalesce("text", F.lit("")), (F.col("doc_id") % 13 * 100).cast("int"), (F.col("doc_id") % 5 * 60).cast("int")).alias("q"))
    return rows.select("doc_id", "q.quote", "q.truncated")


@query("parse_numbers")
def parse_numbers(spark, sf_dir):
    """The numbers of each document, one row each."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return number_rows(rows).select("doc_id", F.col("place").cast("int").alias("place"), "raw", "value", "currency", "percentage")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit fingerprints."""
    return F.bit_count(a.bitwiseXOR(b))


@query("hamming", "SELECT p_partkey AS id, CAST(bit_count(xor(p_partkey * 2654435761, p_size * 40503)) AS INTEGER) AS distance FROM part")
def hamming_query(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), hamming(F.col("p_partkey") * 2654435761, F.col("p_size").cast("long") * 40503).alias("distance"))


@query("ir_summary", """SELECT category, count(*) AS questions, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0 END), 6) AS hit_at_1, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0 END), 6) AS hit_at_5, round(avg(CASE WHEN r IS NULL THEN 0 ELSE 1.0 / r END), 6) AS mrr, count(*) FILTER (WHERE r IS NULL) AS misses
FROM (SELECT l_orderkey, min(o_orderpriority) AS category, min(CASE WHEN l_partkey % 7 = 0 THEN l_linenumber END) AS r FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P' GROUP BY l_orderkey) GROUP BY category""")
def ir_summary(spark, sf_dir):
    """Hit rates, mean reciprocal rank and misses of the answerable questions by category."""
    asked = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("category"))
    found = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_partkey") % 7 == 0, F.col("l_linenumber")).alias("r"))
    ranked = found.join(asked, "l_orderkey").groupBy("l_orderkey", "category").agg(F.min("r").alias("r"))
    hit = lambda k: F.round(F.avg(F.when(F.col("r") <= k, 1.0).otherwise(0.0)), 6)
    return ranked.groupBy("category").agg(
        F.count(F.lit(1)).alias("questions"), hit(1).alias("hit_at_1"), hit(5).alias("hit_at_5"), F.round(F.avg(F.coalesce(1.0 / F.col("r"), F.lit(0.0))), 6).alias("mrr"), F.count_if(F.col("r").isNull()).alias("misses")
    )


@query("recent_history", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS r FROM conversations) WHERE r <= 6")
def recent_history(spark, sf_dir, turns: int = 6):
    """The last turns of each conversation."""
    newest = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text"))
    return table(spark, sf_dir, "conversations").withColumn("r", newest).where(F.col("r") <= turns).select("conv_id", "turn", "role")
