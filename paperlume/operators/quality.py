"""Quality engine: measurements against a declared specification, gates, and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import percentile
from ..plans.declared import metrics
from ..plans.registry import query
from ..sources.tables import events, oracle, table

SPEC = "metric_id string, comparison string, target double, warning double, failure double, severity string, least int"
#: A metric per event kind, for the registered queries.
DEMO_SPEC = [
    ("opened", "lte", 50.0, 120.0, 150.0, "WARNING", 20), ("asked", "gte", 120.0, 115.0, 110.0, "HARD_FAIL", 20), ("unanswered", "lt", 100.0, 110.0, 118.0, "CRITICAL", 20),
    ("downloaded", "gt", 10.0, 5.0, 1.0, "INFO", 20), ("page_viewed", "lte", 10.0, None, 10.0, "CRITICAL", 10_000_000), ("never_measured", "eq", 0.0, None, 0.0, "CRITICAL", 1),
]


def holds(comparison: Column, value: Column, bound: Column) -> Column:
    """Whether ``value`` compares with ``bound`` as named: gte, lte, gt, lt or eq."""
    return F.when(comparison == "gte", value >= bound).when(comparison == "lte", value <= bound).when(comparison == "gt", value > bound).when(comparison == "lt", value < bound).otherwise(value == bound)


def evaluate(measured: DataFrame, spec: DataFrame) -> DataFrame:
    """State of each measurement (metric_id, value, samples): pass, warn or fail; too few samples pass as skipped."""
    both = measured.join(spec, "metric_id")
    few = F.col("samples") < F.col("least")
    breaks = lambda bound: F.coalesce(~holds(F.col("comparison"), F.col("value"), F.col(bound)), F.lit(False))
    state = F.when(few, "pass").when(breaks("failure"), "fail").when(breaks("warning"), "warn").otherwise("pass")
    return both.select(*measured.columns, "severity", few.alias("skipped"), state.alias("state"))


def gates(evaluated: DataFrame) -> DataFrame:
    """A release passes if nothing of weight fails; states are never averaged."""
    hard = F.col("severity").isin("CRITICAL", "HARD_FAIL")
    out = evaluated.agg(F.count_if((F.col("state") == "fail") & hard).alias("blocking"), F.count_if((F.col("state") == "warn") | ((F.col("state") == "fail") & ~hard)).alias("warnings"), F.count(F.lit(1)).alias("measured"))
    return out.withColumn("passed", F.col("blocking") == 0)


def _measured(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).groupBy(F.col("kind").alias("metric_id")).agg(F.round(F.avg("duration_ms") / 1000, 6).alias("value"), F.count(F.lit(1)).alias("samples"))


_SPEC_SQL = """spec(metric_id, comparison, target, warning, failure, severity, least) AS (VALUES ('opened', 'lte', 50.0::DOUBLE, 120.0::DOUBLE, 150.0::DOUBLE, 'WARNING', 20), ('asked', 'gte', 120.0, 115.0, 110.0, 'HARD_FAIL', 20), ('unanswered', 'lt', 100.0, 110.0, 118.0, 'CRITICAL', 20),
('downloaded', 'gt', 10.0, 5.0, 1.0, 'INFO', 20), ('page_viewed', 'lte', 10.0, NULL, 10.0, 'CRITICAL', 10000000), ('never_measured', 'eq', 0.0, NULL, 0.0, 'CRITICAL', 1)),
mea AS (SELECT kind AS metric_id, round(avg(duration_ms) / 1000, 6) AS value, count(*) AS samples FROM ev GROUP BY kind),
eva AS (SELECT metric_id, value, samples, severity, samples < least AS skipped, CASE WHEN samples < least THEN 'pass'
  WHEN NOT CASE comparison WHEN 'gte' THEN value >= failure WHEN 'lte' THEN value <= failure WHEN 'gt' THEN value > failure WHEN 'lt' THEN value < failure ELSE value = failure END THEN 'fail'
  WHEN NOT CASE comparison WHEN 'gte' THEN value >= warning WHEN 'lte' THEN value <= warning WHEN 'gt' THEN value > warning WHEN 'lt' THEN value < warning ELSE value = warning END THEN 'warn' ELSE 'pass' END AS state FROM mea JOIN spec USING (metric_id))"""


def _sql(body: str) -> str:
    return oracle("").rstrip() + f", {_SPEC_SQL}\n{body}"


@query("evaluate", _sql("SELECT * FROM eva"))
def _evaluate(spark, sf_dir):
    return evaluate(_measured(spark, sf_dir), spark.createDataFrame(DEMO_SPEC, SPEC))


@query("gates", _sql("SELECT *, blocking = 0 AS passed FROM (SELECT count(*) FILTER (WHERE state = 'fail' AND severity IN ('CRITICAL', 'HARD_FAIL')) AS blocking, count(*) FILTER (WHERE state = 'warn' OR state = 'fail' AND severity NOT IN ('CRITICAL', 'HARD_FAIL')) AS warnings, count(*) AS measured FROM eva)"))
def _gates(spark, sf_dir):
    return gates(_evaluate(spark, sf_dir))


DECLARED = "metric_id string, comparison string, target double, warning double, failure double, severity string, least int, repair string"
#: Hours that an overview looks back.
WINDOW_HOURS = 168


def declared(spark) -> DataFrame:
    """The declared metrics, one row each."""
    return spark.createDataFrame(metrics(), DECLARED)


def overview(log: DataFrame, spec: DataFrame, now: Column, hours: int = WINDOW_HOURS) -> DataFrame:
    """Every declared metric with its latest evaluation in the window, its failures and their last evidence, and its repairs.

    ``log`` has metric_id, value, state, samples, evidence, measured_at, repair_at and repaired. One grouping of
    the window, with maxima by time in place of sorted rows, so a metric that is measured very often
    is combined before it is shuffled; a metric without a row is unmeasured.
    """
    recent = log.where(F.col("measured_at") >= now - F.expr(f"INTERVAL {hours} HOURS"))
    failed = F.col("state") == "fail"
    latest = F.max(F.struct("measured_at", "value", "state", "samples", "evidence")).alias("latest")
    last = F.max(F.when(failed, F.struct("measured_at", "evidence"))).alias("last")
    sums = recent.groupBy("metric_id").agg(latest, last, F.count(F.lit(1)).alias("measurements"), F.count_if(failed).alias("failures"), F.count("repair_at").alias("repairs"), F.count_if("repaired").alias("repaired"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return spec.join(F.broadcast(sums), "metric_id", "left").select(
        "metric_id", F.split_part("metric_id", F.lit("."), F.lit(1)).alias("domain"), "severity", F.coalesce("latest.state", F.lit("unmeasured")).alias("state"), F.col("latest.value").alias("value"), F.col("latest.samples").alias("samples"),
        F.col("latest.measured_at").alias("measured_at"), zero("measurements"), zero("failures"), F.col("last.evidence").alias("last_failure"), zero("repairs"), zero("repaired"),
    )


def evaluations(events: DataFrame) -> DataFrame:
    """Events as evaluations: an event measures the metric of its number among the declared, and others that none has.

    Its value lies between the metric's target and beyond its failure threshold, by the event's own.
    """
    spark = events.sparkSession
    spec = declared(spark)
    names = spark.createDataFrame(list(enumerate(m[0] for m in metrics())), "n long, metric_id string")
    rows = events.where("ts IS NOT NULL AND value IS NOT NULL").withColumn("n", F.col("event_id") * 7 % 75)
    measured = rows.join(F.broadcast(names), "n").join(F.broadcast(spec.select("metric_id", "target", F.col("failure").alias("bound"))), "metric_id")
    off = F.round(F.col("target") + (F.col("bound") - F.col("target")) * F.col("value") / 25 + F.when((F.col("event_type") == "error") & (F.col("target") == F.col("bound")), 1).otherwise(0), 6)
    made = measured.select("metric_id", off.alias("value"), (F.col("user_id") % 60).cast("int").alias("samples"), F.col("ts").alias("measured_at"), F.concat_ws(":", "user_id", "event_id").alias("evidence"),
                           F.when(F.col("event_type").isin("click", "purchase"), F.col("ts")).alias("repair_at"), (F.col("event_type") == "purchase").alias("repaired"))
    return evaluate(made, spec)


def _number(value: float | None) -> str:
    return "NULL" if value is None else f"{value!r}::DOUBLE"


DECLARED_SQL = f"""declared(n, metric_id, comparison, target, warning, failure, severity, least, repair) AS (VALUES {", ".join(f"({k}, '{m[0]}', '{m[1]}', {_number(m[2])}, {_number(m[3])}, {_number(m[4])}, '{m[5]}', {m[6]}, '{m[7]}')" for k, m in enumerate(metrics()))}),
made AS (SELECT metric_id, round(target + (failure - target) * value / 25 + CASE WHEN event_type = 'error' AND target = failure THEN 1 ELSE 0 END, 6) AS value, CAST(user_id % 60 AS INTEGER) AS samples, ts AS measured_at, user_id || ':' || event_id AS evidence,
  CASE WHEN event_type IN ('click', 'purchase') THEN ts END AS repair_at, event_type = 'purchase' AS repaired, comparison, warning, failure, severity, least FROM events JOIN declared ON event_id * 7 % 75 = n WHERE ts IS NOT NULL AND value IS NOT NULL),
log AS (SELECT *, CASE WHEN samples < least THEN 'pass' WHEN NOT CASE comparison WHEN 'gte' THEN value >= failure WHEN 'lte' THEN value <= failure ELSE value = failure END THEN 'fail'
  WHEN warning IS NOT NULL AND NOT CASE comparison WHEN 'gte' THEN value >= warning WHEN 'lte' THEN value <= warning ELSE value = warning END THEN 'warn' ELSE 'pass' END AS state FROM made),
looked AS (SELECT metric_id, max({{'measured_at': measured_at, 'value': value, 'state': state, 'samples': samples, 'evidence': evidence}}) AS latest, arg_max(evidence, measured_at) FILTER (state = 'fail') AS last_failure, count(*) AS measurements, count(*) FILTER (state = 'fail') AS failures, count(repair_at) AS repairs, count(*) FILTER (repaired) AS repaired FROM log WHERE measured_at >= (SELECT max(ts) FROM events) - INTERVAL {WINDOW_HOURS} HOUR GROUP BY metric_id),
over AS (SELECT d.metric_id, split_part(d.metric_id, '.', 1) AS domain, d.severity, coalesce(latest.state, 'unmeasured') AS state, latest.value AS value, latest.samples AS samples, latest.measured_at AS measured_at, coalesce(measurements, 0) AS measurements, coalesce(failures, 0) AS failures, last_failure, coalesce(repairs, 0) AS repairs, coalesce(repaired, 0) AS repaired FROM declared d LEFT JOIN looked USING (metric_id))"""


def _overview(spark, sf_dir) -> DataFrame:
    now = table(spark, sf_dir, "events").agg(F.max("ts").alias("now"))
    log = evaluations(table(spark, sf_dir, "events")).crossJoin(F.broadcast(now))
    return overview(log, declared(spark), F.col("now"))


@query("quality_overview", f"WITH {DECLARED_SQL} SELECT * FROM over")
def quality_overview(spark, sf_dir):
    """Every declared metric as it stands after the last week."""
    return _overview(spark, sf_dir)


@query("quality_counts", f"WITH {DECLARED_SQL} SELECT domain, count(*) FILTER (state = 'pass') AS pass, count(*) FILTER (state = 'warn') AS warn, count(*) FILTER (state = 'fail') AS fail, count(*) FILTER (state = 'unmeasured') AS unmeasured, count(*) FILTER (state = 'fail' AND severity IN ('CRITICAL', 'HARD_FAIL')) AS blocking, count(*) FILTER (state = 'warn' OR state = 'fail' AND severity = 'WARNING') AS warnings FROM over GROUP BY domain")
def quality_counts(spark, sf_dir):
    """States of the declared metrics by domain, with what blocks a release; nothing is averaged."""
    n = lambda condition: F.count_if(condition)
    state, hard = F.col("state"), F.col("severity").isin("CRITICAL", "HARD_FAIL")
    states = [n(state == s).alias(s) for s in ("pass", "warn", "fail", "unmeasured")]
    return _overview(spark, sf_dir).groupBy("domain").agg(*states, n((state == "fail") & hard).alias("blocking"), n((state == "warn") | ((state == "fail") & (F.col("severity") == "WARNING"))).alias("warnings"))


def retrieval_metrics(ranked: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """Per question: first relevant rank, hit, recall, precision, reciprocal rank and nDCG at ``k``, binary relevance."""
    found = ranked.join(expected.select("question_id", "item", F.lit(1).alias("relevant")), ["question_id", "item"], "left").where(F.col("relevant") == 1)
    at_k = F.col("rank") <= k
    hits = found.groupBy("question_id").agg(F.min("rank").alias("first_rank"), F.count_if(at_k).alias("hits"), F.sum(F.when(at_k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"))
    wanted = expected.groupBy("question_id").agg(F.count(F.lit(1)).alias("wanted"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("wanted", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    both = wanted.join(hits, "question_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return both.select(
        "question_id", "first_rank", (F.col("hits") > 0).alias("hit"), F.round(F.col("hits") / F.col("wanted"), 6).alias("recall"), F.round(F.col("hits") / k, 6).alias("precision"),
        F.round(F.coalesce(1 / F.col("first_rank"), F.lit(0.0)), 6).alias("reciprocal_rank"), F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 6).alias("ndcg"),
    )


@query("ir_metrics", """WITH ranked AS (SELECT user_id AS question_id, event_type AS item, row_number() OVER (PARTITION BY user_id ORDER BY sum(value) DESC, event_type) AS rank FROM events GROUP BY user_id, event_type),
expected AS (SELECT DISTINCT user_id AS question_id, event_type AS item FROM events WHERE value > 250), w AS (SELECT question_id, count(*) AS wanted FROM expected GROUP BY 1),
h AS (SELECT question_id, min(rank) AS first_rank, count(*) FILTER (WHERE rank <= 5) AS hits, sum(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM ranked JOIN expected USING (question_id, item) GROUP BY 1)
SELECT question_id, CAST(first_rank AS INTEGER) AS first_rank, coalesce(hits, 0) > 0 AS hit, round(coalesce(hits, 0) / wanted, 6) AS recall, round(coalesce(hits, 0) / 5, 6) AS precision, round(coalesce(1 / first_rank, 0), 6) AS reciprocal_rank,
round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(wanted, 5) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM w LEFT JOIN h USING (question_id)""")
def _ir(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("question_id"), F.col("event_type").alias("item"), "value")
    order = Window.partitionBy("question_id").orderBy(F.desc("v"), "item")
    ranked = rows.groupBy("question_id", "item").agg(F.sum("value").alias("v")).select("question_id", "item", F.row_number().over(order).alias("rank"))
    return retrieval_metrics(ranked, rows.where("value > 250").select("question_id", "item").distinct())


@query("calibration", """SELECT round(count(*) FILTER (WHERE NOT able AND NOT refused) / count(*) FILTER (WHERE NOT able), 6) AS false_answer_rate, round(count(*) FILTER (WHERE able AND (refused OR NOT expected)) / count(*) FILTER (WHERE able), 6) AS false_refusal_rate
FROM (SELECT quality = 1 AS able, toxic = 1 AS refused, coalesce(contains(text, '. '), false) AS expected FROM labels LEFT JOIN documents USING (doc_id))""")
def calibration(spark, sf_dir):
    """Answers given where none was possible, and refusals, or answers without what was expected, where one was.

    A labelled document is an answer: answerable by its quality, refused by its toxicity, expected to have a whole sentence.
    """
    texts = table(spark, sf_dir, "documents").select("doc_id", F.contains("text", F.lit(". ")).alias("expected"))
    able, refused, expected = F.col("quality") == 1, F.col("toxic") == 1, F.coalesce("expected", F.lit(False))
    share = lambda top, of: F.round(F.try_divide(F.count_if(top & of), F.count_if(of)), 6)
    return table(spark, sf_dir, "labels").join(texts, "doc_id", "left").agg(share(~refused, ~able).alias("false_answer_rate"), share(refused | ~expected, able).alias("false_refusal_rate"))


@query("chunk_stats", "SELECT count(*) AS chunks, CAST(sum(n_chars) AS BIGINT) AS total, round(avg(n_chars), 6) AS mean, quantile_disc(n_chars, 0.5) AS median, quantile_disc(n_chars, 0.95) AS p95, min(n_chars) AS least, max(n_chars) AS most FROM documents")
def chunk_stats(spark, sf_dir):
    """Sizes of all texts; the percentiles are exact and no task holds all sizes."""
    rows = table(spark, sf_dir, "documents")
    sums = rows.agg(F.count(F.lit(1)).alias("chunks"), F.sum("n_chars").alias("total"), F.round(F.avg("n_chars"), 6).alias("mean"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))
    of = lambda share, name: percentile(rows, [], "n_chars", share).agg(F.max("value").cast("long").alias(name))
    return sums.crossJoin(F.broadcast(of(0.5, "median"))).crossJoin(F.broadcast(of(0.95, "p95"))).select("chunks", "total", "mean", "median", "p95", "least", "most")


@query("release_summary", f"""WITH {DECLARED_SQL} SELECT release, count(*) AS measurements, count(*) FILTER (state = 'fail') AS failures, count(*) FILTER (state = 'fail' AND severity IN ('CRITICAL', 'HARD_FAIL')) AS blocking, min(measured_at) AS first_seen, max(measured_at) AS last_seen
FROM (SELECT *, 'r' || day(measured_at) // 3 AS release FROM log) GROUP BY release ORDER BY last_seen DESC LIMIT 8""")
def release_summary(spark, sf_dir):
    """Evaluations by release, newest first; every three days of a month are a release here."""
    hard = (F.col("state") == "fail") & F.col("severity").isin("CRITICAL", "HARD_FAIL")
    log = evaluations(table(spark, sf_dir, "events")).groupBy(F.concat(F.lit("r"), F.expr("day(measured_at) DIV 3")).alias("release"))
    sums = log.agg(F.count(F.lit(1)).alias("measurements"), F.count_if(F.col("state") == "fail").alias("failures"), F.count_if(hard).alias("blocking"), F.min("measured_at").alias("first_seen"), F.max("measured_at").alias("last_seen"))
    return sums.orderBy(F.desc("last_seen")).limit(8)

