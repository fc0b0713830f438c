"""What may be quoted: citations of an answer resolved against their sources within the budgets of answer and session.

How much of a quote is shown depends on what the answer's earlier citations and the session's earlier answers have
used. Quotes are checked against their sources by joins and expressions; what is left is a fold over the
citations of a session in order, which streams through a task and holds two counters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.tables import table
from .answers import sanitise_citations
from .claims import verify_quote


@dataclass(frozen=True)
class Budget:
    """Quoted characters that an answer and a session may have; None for no limit."""

    answer: int | None
    session: int | None


#: Budgets by mode. Fixed values.
BUDGETS = {"OFF": Budget(None, None), "STANDARD": Budget(1_200, 20_000), "STRICT": Budget(500, 6_000)}
#: Units that a session remembers at most: the last ones. Fixed value.
KEPT_UNITS = 500


def cut_quote(quote: str, room: int | None) -> str | None:
    """The quote within ``room`` characters: whole, or to its last blank if that is near the end, the ellipsis counted; None without room."""
    if room is None or 0 < room >= len(quote):
        return quote
    if room < 2:
        return None
    part = quote[: room - 1]
    blank = part.rfind(" ")
    return (part[:blank] if blank > (room - 1) * 0.6 else part).rstrip() + "…"


_RESOLVED = "session long, seq long, answer string, source long, rank long, relevance double, unit string, verdict string, quote string, truncated boolean, session_used long"


def resolve_citations(citations: DataFrame, sources: DataFrame, mode: str) -> DataFrame:
    """The citations that answers keep, their quotes within the budgets, and what their session had used by then.

    ``citations`` has session, seq (the answer's place in the session), answer, place, source, quote
    and relevance; ``sources`` answer, source, text and unit, what the answer was given. Citations of other
    sources are dropped, and of several of one source the most relevant stays. A quote that does
    not stand in its source is dropped. Rows are shuffled once by session and sorted; a session
    of very many citations streams like any other.
    """
    budget = BUDGETS[mode]
    kept = sanitise_citations(citations, sources, ["answer", "source"]).join(sources, ["answer", "source"])
    own = F.trim("quote")
    kept = kept.withColumn("verdict", verify_quote(F.col("quote"), F.col("text"))).withColumn("quote", F.when(F.col("verdict") == "verified", own))
    rows = kept.select(F.col("session").cast("long"), F.col("seq").cast("long"), F.col("answer").cast("string"), F.col("source").cast("long"), "rank", "relevance", F.col("unit").cast("string"), "verdict", "quote")
    rows = rows.repartition("session").sortWithinPartitions("session", "seq", "answer", "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session = answer = object()
        used, before = 0, 0
        for batch in batches:
            shown, cut, known = [], [], []
            for s, n, a, quote in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 8))):
                if s != session:
                    session, answer, used = s, object(), 0
                if (n, a) != answer:
                    # The session's budget counts answers that are complete; within one it stays as it was.
                    answer, before = (n, a), used
                rooms = [most - gone for most, gone in ((budget.session, before), (budget.answer, used - before)) if most is not None]
                text = None if quote is None else cut_quote(quote, min(rooms) if rooms else None)
                cut.append(quote is not None and text != quote)
                shown.append(text)
                known.append(before)
                used += len(text or "")
            yield pa.RecordBatch.from_arrays([*batch.columns[:8], pa.array(shown, pa.string()), pa.array(cut, pa.bool_()), pa.array(known, pa.int64())], names=[c.split()[0] for c in _RESOLVED.split(", ")])

    return rows.mapInArrow(run, _RESOLVED)


def extraction_state(resolved: DataFrame, attempts: DataFrame) -> DataFrame:
    """Per session: attempts to extract, characters quoted, distinct units quoted (the last ``KEPT_UNITS``) and answers delivered.

    ``attempts`` has session, attempt and delivered, one row an answer. Units are counted by groupings before
    sessions are, so a session with very many quotes is not gathered.
    """
    asked = attempts.groupBy("session").agg(F.count_if(F.coalesce("attempt", F.lit(False))).alias("attempts"), F.count_if(F.coalesce("delivered", F.lit(False))).alias("answers"))
    units = resolved.where("unit IS NOT NULL").select("session", "unit").distinct().groupBy("session").agg(F.least(F.count(F.lit(1)), F.lit(KEPT_UNITS)).alias("units"))
    quoted = resolved.groupBy("session").agg(F.sum(F.length(F.coalesce("quote", F.lit("")))).alias("quoted_chars"))
    return asked.join(quoted, "session", "left").join(units, "session", "left").na.fill(0, ["quoted_chars", "units"]).select("session", "attempts", "quoted_chars", "units", "answers")


#: Conversations of one session in the queries.
CONVERSATIONS = 4


def session_citations(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Citations of the assistant turns of ``CONVERSATIONS`` conversations at a time, and the turns they may cite.

    A turn cites the two turns before it in full, the turn before that and itself under the name of the first.
    """
    turns = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    turns = turns.groupBy("conv_id", F.col("turn").cast("long").alias("turn")).agg(F.min(F.struct("role", F.coalesce("text", F.lit("")).alias("text"))).alias("t")).select("conv_id", "turn", "t.role", "t.text")
    order = Window.partitionBy("session").orderBy("conv_id", "turn")
    said = turns.where("role = 'assistant'").withColumn("session", F.floor(F.col("conv_id") / CONVERSATIONS)).withColumn("seq", F.row_number().over(order))
    said = said.withColumn("answer", F.concat_ws(":", "conv_id", "turn"))
    asked = said.select("answer", "conv_id", F.col("turn").alias("of"), F.explode(F.array(F.lit(1), F.lit(2))).alias("source")).withColumn("turn", F.col("of") - F.col("source"))
    sources = asked.join(turns.select("conv_id", "turn", "text"), ["conv_id", "turn"]).select("answer", "source", "text", F.concat_ws(":", "conv_id", "turn").alias("unit"))
    quoted = said.select("session", "seq", "answer", "text").join(sources.select("answer", "source", F.col("text").alias("shown")), "answer", "left")
    offers = [(0, F.col("source"), F.col("shown"), 0.4), (1, F.lit(1), F.substring("text", 1, 60), 0.1), (2, F.lit(3), F.lit(None).cast("string"), 0.9)]
    made = F.array(*(F.struct(F.lit(at).alias("at"), source.cast("long").alias("source"), q.alias("quote"), F.lit(w).alias("weight")) for at, source, q, w in offers))
    cited = quoted.select("session", "seq", "answer", F.coalesce("source", F.lit(1)).alias("of"), F.explode(made).alias("c"))
    return cited.select("session", "seq", "answer", (F.col("of") * 10 + F.col("c.at")).alias("place"), "c.source", "c.quote", F.round(F.col("c.weight") / F.col("of"), 6).alias("relevance")), sources


@query("resolve_citations")
def resolve_citations_query(spark, sf_dir):
    """What each answer of a session may quote of the turns before it, in strict mode."""
    cited, sources = session_citations(spark, sf_dir)
    return resolve_citations(cited, sources, "STRICT")


@query("extraction_state")
def extraction_state_query(spark, sf_dir):
    """What sessions have quoted in strict mode, and how often they cited a source that does not exist."""
    cited, sources = session_citations(spark, sf_dir)
    asked = cited.where("source IS NOT NULL").groupBy("session", "answer").agg((F.max("source") > 2).alias("attempt"), F.lit(True).alias("delivered"))
    return extraction_state(resolve_citations(cited, sources, "STRICT"), asked)
