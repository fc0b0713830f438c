"""Engagement analytics over the event log. Every operator takes rows and returns rows; none reads a clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import percentile
from ..plans.registry import query
from ..sources.tables import events, jobs, oracle, table

TENANT, AS_OF = 3, "2024-01-31 00:00:00"


def ratio(top: Column, bottom: Column, otherwise: float | None = 0.0) -> Column:
    """``top / bottom``, or ``otherwise`` where the bottom is not positive."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(otherwise))


def overview(log: DataFrame) -> DataFrame:
    """Totals of one tenant's log: questions include unanswered ones."""
    is_kind = lambda *k: F.col("kind").isin(*k)
    sums = log.agg(
        F.count_if(is_kind("opened")).alias("views"), F.count_distinct("session_id").alias("visitors"), F.count_if(is_kind("asked", "unanswered")).alias("questions"),
        F.count_if(is_kind("unanswered")).alias("unanswered"), F.count_if(is_kind("downloaded")).alias("downloads"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("dwell_ms"),
    )
    return sums.select("*", F.round(ratio(F.col("questions"), F.col("visitors")), 1).alias("questions_per_visitor"), F.round(ratio(F.col("dwell_ms") / 1000, F.col("visitors"))).cast("long").alias("avg_seconds"))


@query("overview", oracle(f"""SELECT *, round(CASE WHEN visitors > 0 THEN questions / visitors ELSE 0 END, 1) AS questions_per_visitor, CAST(round(CASE WHEN visitors > 0 THEN dwell_ms / 1000 / visitors ELSE 0 END) AS BIGINT) AS avg_seconds
FROM (SELECT count(*) FILTER (WHERE kind = 'opened') AS views, count(DISTINCT session_id) AS visitors, count(*) FILTER (WHERE kind IN ('asked', 'unanswered')) AS questions, count(*) FILTER (WHERE kind = 'unanswered') AS unanswered,
count(*) FILTER (WHERE kind = 'downloaded') AS downloads, CAST(coalesce(sum(duration_ms), 0) AS BIGINT) AS dwell_ms FROM ev WHERE tenant = {TENANT})"""))
def _overview(spark, sf_dir):
    return overview(events(spark, sf_dir).where(F.col("tenant") == TENANT))


def files_engagement(log: DataFrame, files: DataFrame, top: int = 6) -> DataFrame:
    """Opens, dwell and sessions of each live file, files without events included; most events first."""
    sums = log.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "opened").alias("o"), F.sum("duration_ms").alias("d"), F.count_distinct("session_id").alias("s"))
    zero = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    return files.join(sums, "file_id", "left").select("file_id", zero("n", "n_events"), zero("o", "opens"), zero("d", "dwell_ms"), zero("s", "sessions")).orderBy(F.desc("n_events"), "file_id").limit(top)


@query("files_engagement", oracle(f"""SELECT f.file_id, count(e.event_id) AS n_events, count(*) FILTER (WHERE e.kind = 'opened') AS opens, CAST(coalesce(sum(e.duration_ms), 0) AS BIGINT) AS dwell_ms, count(DISTINCT e.session_id) AS sessions
FROM (SELECT doc_id AS file_id FROM documents) f LEFT JOIN (SELECT * FROM ev WHERE tenant = {TENANT}) e USING (file_id) GROUP BY f.file_id ORDER BY n_events DESC, f.file_id LIMIT 6"""))
def _files(spark, sf_dir):
    live = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"))
    return files_engagement(events(spark, sf_dir).where(F.col("tenant") == TENANT), live)


def pages_engagement(log: DataFrame, top: int = 8) -> DataFrame:
    """Views and mean seconds of each page that was viewed."""
    sums = log.where((F.col("kind") == "page_viewed") & F.col("page").isNotNull()).groupBy("file_id", "page").agg(F.count(F.lit(1)).alias("views"), F.sum("duration_ms").alias("d"))
    return sums.select("file_id", "page", "views", F.round(F.col("d") / 1000 / F.col("views"), 6).alias("avg_seconds")).orderBy(F.desc("views"), "file_id", "page").limit(top)


@query("pages_engagement", oracle("""SELECT file_id, page, count(*) AS views, round(sum(duration_ms) / 1000 / count(*), 6) AS avg_seconds FROM ev WHERE kind = 'page_viewed' AND page IS NOT NULL
GROUP BY ALL ORDER BY views DESC, file_id, page LIMIT 8"""))
def _pages(spark, sf_dir):
    return pages_engagement(events(spark, sf_dir))


def day_spine(spark, until: str, days: int) -> DataFrame:
    """``days`` + 1 days, the last being that of ``until``."""
    day = F.to_date(F.lit(until).cast("timestamp_ntz"))
    return spark.range(1).select(F.explode(F.sequence(F.date_sub(day, days), day)).alias("day"))


def daily_series(log: DataFrame, until: str, days: int = 30) -> DataFrame:
    """Per day, zeros included: views and questions. Days are joined by equality, not by range."""
    sums = log.groupBy(F.to_date("occurred_at").alias("day")).agg(F.count_if(F.col("kind") == "opened").alias("v"), F.count_if(F.col("kind").isin("asked", "unanswered")).alias("q"))
    found = day_spine(log.sparkSession, until, days).join(sums, "day", "left")
    return found.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("v", F.lit(0)).alias("views"), F.coalesce("q", F.lit(0)).alias("questions"))


@query("daily_series", oracle("""SELECT strftime(d, '%Y-%m-%d') AS day, count(*) FILTER (WHERE kind = 'opened') AS views, count(*) FILTER (WHERE kind IN ('asked', 'unanswered')) AS questions
FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY) g(d) LEFT JOIN ev ON occurred_at >= d AND occurred_at < d + INTERVAL 1 DAY GROUP BY d"""))
def _daily(spark, sf_dir):
    return daily_series(events(spark, sf_dir), AS_OF)


@query("recent_activity", oracle(f"SELECT event_id, kind, file_id, source AS file_name, occurred_at FROM (SELECT * FROM ev WHERE tenant = {TENANT} ORDER BY occurred_at DESC, event_id DESC LIMIT 12) LEFT JOIN (SELECT doc_id, min(source) AS source FROM documents GROUP BY doc_id) ON doc_id = file_id"))
def recent_activity(spark, sf_dir):
    """The newest events with the names of their files; the names are joined to the twelve rows alone."""
    newest = events(spark, sf_dir).where(F.col("tenant") == TENANT).select("event_id", "kind", "file_id", "occurred_at").orderBy(F.desc("occurred_at"), F.desc("event_id")).limit(12)
    files = table(spark, sf_dir, "documents").join(F.broadcast(newest.select(F.col("file_id").alias("doc_id")).distinct()), "doc_id", "left_semi").groupBy(F.col("doc_id").alias("file_id")).agg(F.min("source").alias("file_name"))
    return newest.join(files, "file_id", "left")


@query("identified_visitors", oracle("""SELECT c_custkey AS identity, c_name AS name, visits, last_seen, coalesce(n, 0) AS sessions FROM (SELECT user_id, count(*) AS visits, max(ts) AS last_seen FROM events WHERE event_type = 'view' GROUP BY user_id)
JOIN customer ON c_custkey = user_id AND c_acctbal > 0 LEFT JOIN (SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS n FROM events GROUP BY user_id) s USING (user_id) ORDER BY last_seen DESC, identity LIMIT 50"""))
def identified_visitors(spark, sf_dir):
    """The newest verified identities with their visits and sessions; a customer in credit is a verified identity, a day of its events a session."""
    log = table(spark, sf_dir, "events")
    seen = log.groupBy(F.col("user_id").alias("identity")).agg(F.count_if(F.col("event_type") == "view").alias("visits"), F.max(F.when(F.col("event_type") == "view", F.col("ts"))).alias("last_seen"), F.count_distinct(F.to_date("ts")).alias("sessions")).where("visits > 0")
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("identity"), F.col("c_name").alias("name"))
    return seen.join(known, "identity").select("identity", "name", "visits", "last_seen", "sessions").orderBy(F.desc("last_seen"), "identity").limit(50)


@query("workspace_summary", oracle("""SELECT c.tenant, active, total, coalesce(month_views, 0) AS month_views, coalesce(month_questions, 0) AS month_questions FROM (SELECT o_custkey % 20 AS tenant, count(*) FILTER (o_orderstatus = 'O') AS active, count(*) AS total FROM orders WHERE o_orderpriority NOT LIKE '5%' GROUP BY 1) c
LEFT JOIN (SELECT tenant, count(*) FILTER (WHERE kind = 'opened') AS month_views, count(*) FILTER (WHERE kind = 'asked') AS month_questions FROM ev WHERE occurred_at >= TIMESTAMP '2024-01-01' AND occurred_at < TIMESTAMP '2024-02-01' GROUP BY tenant) e USING (tenant)"""))
def workspace_summary(spark, sf_dir):
    """Per tenant: bundles that are active and all that are not deleted, and the month's views and questions, unanswered ones left out. An order is a bundle."""
    held = table(spark, sf_dir, "orders").where("o_orderpriority NOT LIKE '5%'").groupBy((F.col("o_custkey") % 20).alias("tenant")).agg(F.count_if(F.col("o_orderstatus") == "O").alias("active"), F.count(F.lit(1)).alias("total"))
    log = events(spark, sf_dir).where("occurred_at >= TIMESTAMP_NTZ '2024-01-01' AND occurred_at < TIMESTAMP_NTZ '2024-02-01'")
    month = log.groupBy("tenant").agg(F.count_if(F.col("kind") == "opened").alias("month_views"), F.count_if(F.col("kind") == "asked").alias("month_questions"))
    return held.join(month, "tenant", "left").na.fill(0, ["month_views", "month_questions"])


@query("counter_drift", oracle("""SELECT s.tenant, CAST(s.n AS BIGINT) AS stored, count(e.event_id) AS counted FROM (SELECT CAST(c_custkey AS BIGINT) % 20 AS tenant, count(*) AS n FROM customer GROUP BY 1) s
LEFT JOIN ev e ON e.tenant = s.tenant AND e.kind IN ('asked', 'unanswered') GROUP BY s.tenant, s.n HAVING count(e.event_id) <> s.n"""))
def counter_drift(spark, sf_dir):
    """Stored counters that differ from the count of events (pre-aggregated left join, not a lateral one)."""
    stored = table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 20).alias("tenant")).agg(F.count(F.lit(1)).alias("stored"))
    counted = events(spark, sf_dir).where(F.col("kind").isin("asked", "unanswered")).groupBy("tenant").agg(F.count(F.lit(1)).alias("n"))
    found = stored.join(counted, "tenant", "left").select("tenant", "stored", F.coalesce("n", F.lit(0)).alias("counted"))
    return found.where(F.col("stored") != F.col("counted"))


@query("tenant_contamination", oracle("SELECT count(*) AS contaminated FROM ev JOIN customer ON c_custkey = session_id WHERE (c_nationkey % 20) IS DISTINCT FROM tenant"))
def tenant_contamination(spark, sf_dir):
    """Events whose tenant is not that of their owner."""
    owners = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"), (F.col("c_nationkey") % 20).cast("long").alias("owner"))
    found = events(spark, sf_dir).join(owners, "session_id").where(~F.col("owner").eqNullSafe(F.col("tenant")))
    return found.agg(F.count(F.lit(1)).alias("contaminated"))


@query("vitals_p75", oracle("SELECT kind, count(*) AS samples, round(quantile_cont(duration_ms, 0.75), 6) AS p75 FROM ev WHERE occurred_at >= (SELECT max(occurred_at) FROM ev) - INTERVAL 28 DAY GROUP BY kind HAVING count(*) >= 20"))
def vitals_p75(spark, sf_dir):
    """Interpolated 75th percentile per metric of the last 28 days that has at least 20 samples; a row without a value is a sample too, and has no place in the ranks."""
    log = events(spark, sf_dir)
    last = log.agg(F.max("occurred_at").alias("last"))
    recent = log.crossJoin(F.broadcast(last)).where(F.col("occurred_at") >= F.col("last") - F.expr("INTERVAL 28 DAYS"))
    sums = recent.groupBy("kind").agg(F.count(F.lit(1)).alias("samples")).where("samples >= 20")
    found = percentile(recent, ["kind"], "duration_ms", 0.75, interpolated=True).select(F.col("kind").alias("_kind"), F.round("value", 6).alias("p75"))
    return sums.join(F.broadcast(found), F.col("kind").eqNullSafe(F.col("_kind")), "left").select("kind", "samples", "p75")


@query("stuck_jobs", oracle("SELECT count(*) AS stuck, list_sort(list(DISTINCT kind)) AS kinds FROM job WHERE status = 'RUNNING' AND started_at < TIMESTAMP '1998-01-01'"))
def stuck_jobs(spark, sf_dir):
    """Running jobs that began too long ago, with their kinds."""
    old = jobs(spark, sf_dir).where("status = 'RUNNING' AND started_at < TIMESTAMP_NTZ '1998-01-01'")
    return old.agg(F.count(F.lit(1)).alias("stuck"), F.array_sort(F.collect_set("kind")).alias("kinds"))


@query("latest_migration", oracle("SELECT job_id, started_at, count(*) OVER () AS total FROM job ORDER BY started_at DESC, job_id DESC LIMIT 1"))
def latest_migration(spark, sf_dir):
    """The newest row with the count of all rows; the count is an aggregate, not a window over one partition."""
    rows = jobs(spark, sf_dir).select("job_id", "started_at")
    newest = rows.orderBy(F.desc("started_at"), F.desc("job_id")).limit(1)
    return newest.crossJoin(rows.agg(F.count(F.lit(1)).alias("total")))


@query("latest_per_key", oracle("SELECT kind, event_id, occurred_at FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY occurred_at DESC, event_id DESC) AS r FROM ev) WHERE r = 1"))
def latest_per_key(spark, sf_dir):
    """The newest event of each kind, by an aggregate that is combined before the shuffle."""
    newest = events(spark, sf_dir).groupBy("kind").agg(F.max(F.struct("occurred_at", "event_id")).alias("m"))
    return newest.select("kind", "m.event_id", "m.occurred_at")


@query("per_file_rank", oracle("SELECT file_id, event_id, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY duration_ms DESC, event_id) AS r FROM ev) WHERE r <= 3"))
def per_file_rank(spark, sf_dir):
    """The three longest events of each file."""
    order = Window.partitionBy("file_id").orderBy(F.desc("duration_ms"), "event_id")
    return events(spark, sf_dir).withColumn("rank", F.row_number().over(order)).where("rank <= 3").select("file_id", "event_id", "rank")
