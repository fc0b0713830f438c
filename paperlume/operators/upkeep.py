"""Upkeep of the service: work lists of due rows, snapshots after repairs, and how whole the files are.

A work list is limited to the rows of one pass, which is its feature; the next pass takes the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.tables import events, oracle, table
from .console import PAGE, at, optional_filters, page_of

AS_OF = "1998-01-01"
#: Rows of one pass. Fixed values.
RECLAIM_PASS, DRAFT_PASS = 500, 100


@query("reclaim", f"SELECT o_orderkey AS id, o_orderdate AS due_at FROM orders WHERE o_orderdate <= TIMESTAMP '{AS_OF}' AND o_orderstatus <> 'F' ORDER BY o_orderdate, o_orderkey LIMIT {RECLAIM_PASS}")
def reclaim(spark, sf_dir):
    """Files due for deletion that are not deleted, the longest due first."""
    rows = table(spark, sf_dir, "orders").where((F.col("o_orderdate") <= at(AS_OF)) & (F.col("o_orderstatus") != "F"))
    return rows.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("due_at")).orderBy("due_at", "id").limit(RECLAIM_PASS)


@query("purge_drafts", f"SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P' AND o_orderdate + INTERVAL 30 DAY < TIMESTAMP '{AS_OF}' ORDER BY o_orderdate, o_orderkey LIMIT {DRAFT_PASS}")
def purge_drafts(spark, sf_dir):
    """Drafts that nobody claimed and that have expired."""
    expired = F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS") < at(AS_OF)
    return table(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "P") & expired).orderBy("o_orderdate", "o_orderkey").limit(DRAFT_PASS).select(F.col("o_orderkey").alias("id"))


@query("room_list", f"""SELECT o_orderkey AS id, o_orderpriority AS title, o_orderdate AS created_at, (SELECT count(*) FROM orders WHERE o_custkey % 20 = 3 AND o_orderstatus = 'O' AND o_orderpriority ILIKE '%h%') AS total
FROM orders WHERE o_custkey % 20 = 3 AND o_orderstatus = 'O' AND o_orderpriority ILIKE '%h%' ORDER BY o_orderdate DESC, o_orderkey LIMIT {PAGE}""")
def room_list(spark, sf_dir, tenant: int = 3, status: str | None = "O", term: str | None = "h"):
    """The bundles of a tenant by whichever filters are given, newest first, with the number of all."""
    wanted = optional_filters(F.col("o_custkey") % 20 == tenant, None if status is None else F.col("o_orderstatus") == status, None if term is None else F.col("o_orderpriority").ilike(f"%{term}%"))
    rows = table(spark, sf_dir, "orders").where(wanted).select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("created_at"))
    return page_of(rows, F.desc("created_at"), "id")


@query("record_repair", oracle("""SELECT event_id, tenant, CASE WHEN event_id = max(event_id) OVER (PARTITION BY tenant) THEN 'repaired' END AS outcome
FROM (SELECT event_id, tenant FROM ev WHERE kind = 'unanswered' AND (page % 2 = 0) IS NOT FALSE)"""))
def record_repair(spark, sf_dir):
    """Failures not repaired yet, the latest of each tenant now with its outcome.

    The latest is an aggregate combined before the shuffle, joined back, so no tenant's failures meet in one task.
    """
    failed = events(spark, sf_dir).where((F.col("kind") == "unanswered") & F.coalesce(F.col("page") % 2 == 0, F.lit(True))).select("event_id", "tenant")
    latest = failed.groupBy("tenant").agg(F.max("event_id").alias("event_id")).withColumn("outcome", F.lit("repaired"))
    return failed.join(latest, ["tenant", "event_id"], "left").select("event_id", "tenant", "outcome")


@query("topic_upsert", oracle("""SELECT coalesce(s.topic, n.topic) AS topic, coalesce(s.questions, 0) + coalesce(n.questions, 0) AS questions FROM (SELECT CAST(p_size AS BIGINT) AS topic, count(*) AS questions FROM part WHERE p_size <= 10 GROUP BY p_size) s
FULL JOIN (SELECT page % 12 AS topic, count(*) AS questions FROM ev WHERE kind IN ('asked', 'unanswered') AND page IS NOT NULL GROUP BY 1) n ON s.topic = n.topic"""))
def topic_upsert(spark, sf_dir):
    """Stored counts of themes after the questions of the log: known themes grow, others are new."""
    stored = table(spark, sf_dir, "part").where("p_size <= 10").groupBy(F.col("p_size").cast("long").alias("topic")).agg(F.count(F.lit(1)).alias("questions"))
    asked = events(spark, sf_dir).where(F.col("kind").isin("asked", "unanswered") & F.col("page").isNotNull())
    new = asked.groupBy((F.col("page") % 12).alias("topic")).agg(F.count(F.lit(1)).alias("questions"))
    return stored.unionByName(new).groupBy("topic").agg(F.sum("questions").alias("questions"))


@query("counter_repair", oracle("""SELECT s.tenant, count(e.event_id) AS counter, count(e.event_id) <> s.n AS repaired FROM (SELECT CAST(c_custkey AS BIGINT) % 20 AS tenant, count(*) AS n FROM customer GROUP BY 1) s
LEFT JOIN ev e ON e.tenant = s.tenant AND e.kind IN ('asked', 'unanswered') GROUP BY s.tenant, s.n"""))
def counter_repair(spark, sf_dir):
    """The counters after a repair, each the count of its events, and whether it was off."""
    stored = table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 20).cast("long").alias("tenant")).agg(F.count(F.lit(1)).alias("stored"))
    counted = events(spark, sf_dir).where(F.col("kind").isin("asked", "unanswered")).groupBy("tenant").agg(F.count(F.lit(1)).alias("n"))
    counter = F.coalesce("n", F.lit(0))
    return stored.join(counted, "tenant", "left").select("tenant", counter.alias("counter"), (counter != F.col("stored")).alias("repaired"))


def fidelity(parsed: Column, blank: Column, declared: Column) -> Column:
    """Share of the declared parts that were parsed or are blank, at most 1; null without declared ones."""
    return F.when(declared > 0, F.least((parsed + blank) / declared, F.lit(1.0)))


def parity(previewed: Column, parsed: Column) -> Column:
    """Share of the parsed parts that can be previewed, at most 1; null without parsed ones."""
    return F.when(parsed > 0, F.least(previewed / parsed, F.lit(1.0)))


_PARTS = "(SELECT l_orderkey AS id, count(*) FILTER (WHERE l_returnflag <> 'A') AS parsed, count(*) FILTER (WHERE l_returnflag = 'A' AND l_linenumber % 2 = 0) AS blank, count(*) FILTER (WHERE l_linestatus = 'O') AS previewed, max(l_linenumber) AS declared FROM lineitem GROUP BY l_orderkey)"


def _parts(spark, sf_dir) -> DataFrame:
    gone = F.col("l_returnflag") == "A"
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.count_if(~gone).alias("parsed"), F.count_if(gone & (F.col("l_linenumber") % 2 == 0)).alias("blank"), F.count_if(F.col("l_linestatus") == "O").alias("previewed"), F.max("l_linenumber").alias("declared")
    )


@query("struct_fidelity", f"SELECT id, CASE WHEN declared > 0 THEN round(least((parsed + blank) / declared, 1), 6) END AS fidelity FROM {_PARTS}")
def struct_fidelity(spark, sf_dir):
    return _parts(spark, sf_dir).select("id", F.round(fidelity(F.col("parsed"), F.col("blank"), F.col("declared")), 6).alias("fidelity"))


@query("preview_parity", f"SELECT id, CASE WHEN parsed > 0 THEN round(least(previewed / parsed, 1), 6) END AS parity FROM {_PARTS}")
def preview_parity(spark, sf_dir):
    return _parts(spark, sf_dir).select("id", F.round(parity(F.col("previewed"), F.col("parsed")), 6).alias("parity"))


@query("finalize_counts", """SELECT source, count(*) AS files, CAST(sum(ceil(length(text) / 1000)) AS BIGINT) AS chunks, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes,
CASE WHEN count(*) FILTER (WHERE lang IS NOT NULL) > 0 AND count(*) FILTER (WHERE lang IS NOT NULL AND length(text) >= 40) = 0 THEN 'FAILED' ELSE 'READY' END AS status FROM (SELECT source, lang, coalesce(text, '') AS text FROM documents) GROUP BY source""")
def finalize_counts(spark, sf_dir, least_chars: int = 40):
    """Files, chunks and bytes of each bundle; it failed if it has files to show and none of them became readable."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("source", F.col("lang").isNotNull().alias("shown"), F.length(text).alias("chars"), F.octet_length(text).alias("n"))
    status = F.when((F.count_if("shown") > 0) & (F.count_if(F.col("shown") & (F.col("chars") >= least_chars)) == 0), "FAILED").otherwise("READY")
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum(F.ceil(F.col("chars") / 1000)).alias("chunks"), F.sum("n").alias("bytes"), status.alias("status"))


@query("source_exposure", oracle("""SELECT doc_id, coalesce(q, 0) AS quoted, CASE WHEN n > 0 THEN round(coalesce(q, 0) / n, 6) END AS exposure FROM (SELECT doc_id, length(text) AS n FROM documents)
LEFT JOIN (SELECT file_id, CAST(sum(duration_ms % 280) AS BIGINT) AS q FROM ev WHERE kind = 'asked' GROUP BY file_id) ON file_id = doc_id"""))
def source_exposure(spark, sf_dir):
    """Quoted characters of each document over its characters; null for one without any."""
    quoted = events(spark, sf_dir).where("kind = 'asked'").groupBy(F.col("file_id").alias("doc_id")).agg(F.sum(F.col("duration_ms") % 280).alias("q"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n")).join(quoted, "doc_id", "left")
    shown = F.coalesce("q", F.lit(0))
    return rows.select("doc_id", shown.alias("quoted"), F.when(F.col("n") > 0, F.round(shown / F.col("n"), 6)).alias("exposure"))


def leaks(answer: Column, forbidden: list[str]) -> Column:
    """Whether an answer holds one of the strings that it must not, case aside."""
    text = F.lower(F.coalesce(answer, F.lit("")))
    return F.exists(F.array(*map(F.lit, forbidden)), lambda s: F.contains(text, F.lower(s)))


@query("injection_leaks", "SELECT conv_id, turn, contains(lower(coalesce(text, '')), '<|im_') OR contains(lower(coalesce(text, '')), 'answer') AS leaked FROM conversations WHERE role = 'assistant'")
def injection_leaks(spark, sf_dir):
    """Answers that give away what an injected instruction asked for."""
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return rows.select("conv_id", "turn", leaks(F.col("text"), ["<|IM_", "answer"]).alias("leaked"))


@query("prev_recall", oracle("""SELECT release, recall, lag(recall) OVER (ORDER BY release) AS previous, coalesce(recall < lag(recall) OVER (ORDER BY release), false) AS regressed
FROM (SELECT date_trunc('week', occurred_at) AS release, round(count(*) FILTER (WHERE kind = 'asked') / count(*) FILTER (WHERE kind IN ('asked', 'unanswered')), 6) AS recall FROM ev GROUP BY 1)"""))
def prev_recall(spark, sf_dir):
    """The recall of each release beside that of the one before; the window runs over one row a release."""
    hit, asked = F.count_if(F.col("kind") == "asked"), F.count_if(F.col("kind").isin("asked", "unanswered"))
    runs = events(spark, sf_dir).groupBy(F.date_trunc("week", "occurred_at").cast("timestamp_ntz").alias("release")).agg(F.round(F.try_divide(hit, asked), 6).alias("recall"))
    before = F.lag("recall").over(Window.orderBy("release"))
    return runs.select("release", "recall", before.alias("previous"), F.coalesce(F.col("recall") < before, F.lit(False)).alias("regressed"))
