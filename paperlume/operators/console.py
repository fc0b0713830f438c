"""What operators of the service look at: platform totals, alerts, paged lists, reconciliations and sweeps.

Every list is ordered with a unique last key, so a page is the same at every run; only its size is
limited. Nothing reads a clock: the instant that windows end at is a parameter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import percentile
from ..plans.registry import query
from ..sources.tables import cost_usd, events, jobs, ledger, oracle, subscriptions, table

NOW, LOG_NOW = "2001-09-01 00:00:00", "2024-01-30 12:00:00"
PAGE = 25
#: Alert thresholds: dollars a question, factor, input tokens, factor, error rate, least questions, dollars a tenant. Fixed values but for the last.
TARGET_COST, COST_FACTOR, TARGET_INPUT, INPUT_FACTOR, ERROR_RATE, LEAST, TENANT_COST = 0.00162, 2.5, 6000, 1.8, 0.1, 20, 0.02


def at(instant: str) -> Column:
    return F.lit(instant).cast("timestamp_ntz")


def since(column: str, days: float, now: str = NOW) -> Column:
    """Whether an instant lies in the days before ``now``, its beginning included and ``now`` not."""
    return (F.col(column) >= at(now) - F.expr(f"INTERVAL {int(days * 24)} HOURS")) & (F.col(column) < at(now))


def _since(column: str, days: float, now: str = NOW) -> str:
    return f"{column} >= TIMESTAMP '{now}' - INTERVAL {int(days * 24)} HOUR AND {column} < TIMESTAMP '{now}'"


def usd(column: Column, places: int = 6) -> Column:
    return F.round(F.coalesce(column, F.lit(0.0)), places)


def page_of(rows: DataFrame, *order: Column | str, page: int = 1, size: int = PAGE) -> DataFrame:
    """A page of ordered rows with the number of all rows."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).offset((page - 1) * size).limit(size).crossJoin(F.broadcast(total))


@query("usage_totals", oracle(f"SELECT count(*) FILTER (WHERE billable) AS questions, round(coalesce(sum(cost_usd), 0), 6) AS cost FROM led WHERE {_since('occurred_at', 30)}"))
def usage_totals(spark, sf_dir):
    return ledger(spark, sf_dir).where(since("occurred_at", 30)).agg(F.count_if("billable").alias("questions"), usd(F.sum("cost_usd")).alias("cost"))


@query("spend_month", oracle("SELECT round(coalesce(sum(cost_usd), 0), 6) AS spend FROM led WHERE date_trunc('month', occurred_at) = TIMESTAMP '2001-08-01'"))
def spend_month(spark, sf_dir, month: str = "2001-08-01"):
    """What a calendar month cost."""
    inside = (F.col("occurred_at") >= at(month)) & (F.col("occurred_at") < at(month) + F.expr("INTERVAL 1 MONTH"))
    return ledger(spark, sf_dir).where(inside).agg(usd(F.sum("cost_usd")).alias("spend"))


@query("cost_per_question", oracle(f"SELECT count(*) AS questions, round(CASE WHEN count(*) > 0 THEN sum(cost_usd) / count(*) ELSE 0 END, 8) AS cost FROM led WHERE billable AND {_since('occurred_at', 7)}"))
def cost_per_question(spark, sf_dir):
    asked = ledger(spark, sf_dir).where(F.col("billable") & since("occurred_at", 7))
    return asked.agg(F.count(F.lit(1)).alias("questions"), F.round(F.coalesce(F.try_divide(F.sum("cost_usd"), F.count(F.lit(1))), F.lit(0.0)), 8).alias("cost"))


@query("provider_stats", oracle("""SELECT kind, count(*) AS requests, count(*) FILTER (WHERE NOT succeeded) AS errors, round(count(*) FILTER (WHERE NOT succeeded) / count(*), 6) AS error_rate,
round(avg(latency_ms) FILTER (WHERE kind = 'answer'), 4) AS latency_ms, round(sum(cost_usd), 4) AS spend, round(sum(cached_tokens) / sum(input_tokens), 6) AS cached_share FROM led GROUP BY kind"""))
def provider_stats(spark, sf_dir):
    """Requests, errors, latency of answers, spend and share of cached input by kind of call."""
    failed = F.count_if(~F.col("succeeded"))
    return ledger(spark, sf_dir).groupBy("kind").agg(
        F.count(F.lit(1)).alias("requests"), failed.alias("errors"), F.round(failed / F.count(F.lit(1)), 6).alias("error_rate"), F.round(F.avg(F.when(F.col("kind") == "answer", F.col("latency_ms"))), 4).alias("latency_ms"),
        usd(F.sum("cost_usd"), 4).alias("spend"), F.round(F.try_divide(F.sum("cached_tokens"), F.sum("input_tokens")), 6).alias("cached_share"),
    )


@query("collected", oracle("SELECT CAST(coalesce(sum(amount_cents), 0) AS BIGINT) AS cents, count(*) AS payments FROM sub WHERE status = 'active'"))
def collected(spark, sf_dir):
    """What was paid."""
    return subscriptions(spark, sf_dir).where("status = 'active'").agg(F.coalesce(F.sum("amount_cents"), F.lit(0)).alias("cents"), F.count(F.lit(1)).alias("payments"))


@query("cost_alerts", oracle(f"""SELECT * FROM (SELECT 'cost_per_question' AS rule, -1 AS tenant, round(sum(cost_usd) / count(*), 6) AS value FROM led WHERE billable AND {_since('occurred_at', 1)} HAVING count(*) >= {LEAST} AND sum(cost_usd) / count(*) > {COST_FACTOR} * {TARGET_COST}
UNION ALL SELECT 'input_tokens', -1, round(avg(input_tokens), 6) FROM led WHERE billable AND {_since('occurred_at', 1)} HAVING count(*) >= {LEAST} AND avg(input_tokens) > {INPUT_FACTOR} * {TARGET_INPUT}
UNION ALL SELECT 'error_rate', -1, round(count(*) FILTER (WHERE NOT succeeded) / count(*), 6) FROM led WHERE {_since('occurred_at', 1)} HAVING count(*) >= {LEAST} AND count(*) FILTER (WHERE NOT succeeded) / count(*) > {ERROR_RATE}
UNION ALL SELECT 'tenant_cost', tenant, value FROM (SELECT tenant, round(sum(cost_usd), 6) AS value FROM led WHERE {_since('occurred_at', 30)} GROUP BY tenant ORDER BY value DESC, tenant LIMIT 5) WHERE value >= {TENANT_COST})"""))
def cost_alerts(spark, sf_dir):
    """Costs, input and errors of the last day against their limits, and the five costliest tenants of the month above theirs."""
    rows = ledger(spark, sf_dir)
    day, asked = rows.where(since("occurred_at", 1)), rows.where(since("occurred_at", 1) & F.col("billable"))
    wrong = F.count_if(~F.col("succeeded")) / F.count(F.lit(1))
    rules = [("cost_per_question", asked, F.sum("cost_usd") / F.count(F.lit(1)), COST_FACTOR * TARGET_COST), ("input_tokens", asked, F.avg("input_tokens"), INPUT_FACTOR * TARGET_INPUT), ("error_rate", day, wrong, ERROR_RATE)]
    found = [r.agg(F.count(F.lit(1)).alias("n"), value.alias("value")).where((F.col("n") >= LEAST) & (F.col("value") > limit)).select(F.lit(name).alias("rule"), F.lit(-1).cast("long").alias("tenant"), F.round("value", 6).alias("value")) for name, r, value, limit in rules]
    tenants = rows.where(since("occurred_at", 30)).groupBy("tenant").agg(usd(F.sum("cost_usd")).alias("value")).orderBy(F.desc("value"), "tenant").limit(5).where(F.col("value") >= TENANT_COST)
    return reduce(DataFrame.unionByName, [*found, tenants.select(F.lit("tenant_cost").alias("rule"), "tenant", "value")])


@query("platform_overview", oracle(f"""SELECT (SELECT count(*) FROM customer) AS tenants, (SELECT count(*) FROM documents) AS files, (SELECT count(DISTINCT conv_id) FROM conversations) AS sessions, (SELECT count(*) FROM sub WHERE status = 'active') AS active_subscriptions,
(SELECT count(*) FROM led WHERE billable AND {_since('occurred_at', 30)}) AS questions, (SELECT round(count(*) FILTER (WHERE status = 'FAILED') / count(*) FILTER (WHERE status <> 'RUNNING'), 6) FROM job) AS job_failure_rate,
(SELECT count(*) FROM sub WHERE status = 'canceled') AS failed_payments, (SELECT round(1 - c / (r / 100.0), 6) FROM (SELECT sum(cost_usd) AS c FROM led), (SELECT sum(amount_cents) AS r FROM sub WHERE status = 'active')) AS gross_margin"""))
def platform_overview(spark, sf_dir):
    """Totals of the platform in one row; each is an aggregate of its own, of one row."""
    n = F.count(F.lit(1))
    sub, job = subscriptions(spark, sf_dir), jobs(spark, sf_dir)
    parts = [
        table(spark, sf_dir, "customer").agg(n.alias("tenants")), table(spark, sf_dir, "documents").agg(n.alias("files")), table(spark, sf_dir, "conversations").agg(F.count_distinct("conv_id").alias("sessions")),
        sub.agg(F.count_if(F.col("status") == "active").alias("active_subscriptions"), F.count_if(F.col("status") == "canceled").alias("failed_payments"), F.sum(F.when(F.col("status") == "active", F.col("amount_cents"))).alias("revenue")),
        ledger(spark, sf_dir).agg(F.count_if(F.col("billable") & since("occurred_at", 30)).alias("questions"), F.sum("cost_usd").alias("cost")),
        job.agg(F.round(F.try_divide(F.count_if(F.col("status") == "FAILED"), F.count_if(F.col("status") != "RUNNING")), 6).alias("job_failure_rate")),
    ]
    joined = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)
    return joined.withColumn("gross_margin", F.round(1 - F.col("cost") / (F.col("revenue") / 100), 6)).drop("cost", "revenue")


@query("workspace_list", oracle(f"""SELECT c_custkey AS tenant, c_name AS name, coalesce(f.n, 0) AS subscriptions, coalesce(q.n, 0) AS questions, coalesce(q.cost, 0) AS cost, (SELECT count(*) FROM customer) AS total FROM customer
LEFT JOIN (SELECT tenant, count(*) AS n FROM sub GROUP BY tenant) f ON f.tenant = c_custkey LEFT JOIN (SELECT tenant, count(*) FILTER (WHERE billable) AS n, round(sum(cost_usd), 6) AS cost FROM led GROUP BY tenant) q ON q.tenant = c_custkey ORDER BY c_name, c_custkey LIMIT {PAGE}"""))
def workspace_list(spark, sf_dir):
    """Tenants with their subscriptions, questions and costs, by name; the counts are aggregated before they are joined."""
    owned = subscriptions(spark, sf_dir).groupBy("tenant").agg(F.count(F.lit(1)).alias("subscriptions"))
    used = ledger(spark, sf_dir).groupBy("tenant").agg(F.count_if("billable").alias("questions"), usd(F.sum("cost_usd")).alias("cost"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tenant"), F.col("c_name").alias("name")).join(owned, "tenant", "left").join(used, "tenant", "left")
    return page_of(rows.fillna(0, ["subscriptions", "questions", "cost"]), "name", "tenant")


@query("workspace_detail", oracle("""SELECT c_custkey AS tenant, c_name AS name, c_mktsegment AS plan, (SELECT count(*) FROM sub WHERE tenant = 7) AS subscriptions, (SELECT max(created_at) FROM sub WHERE tenant = 7) AS latest,
(SELECT round(coalesce(sum(cost_usd), 0), 6) FROM led WHERE tenant = 7) AS cost FROM customer WHERE c_custkey = 7"""))
def workspace_detail(spark, sf_dir, tenant: int = 7):
    """One tenant with what it owns and costs."""
    own = table(spark, sf_dir, "customer").where(F.col("c_custkey") == tenant).select(F.col("c_custkey").alias("tenant"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("plan"))
    subs = subscriptions(spark, sf_dir).where(F.col("tenant") == tenant).agg(F.count(F.lit(1)).alias("subscriptions"), F.max("created_at").alias("latest"))
    cost = ledger(spark, sf_dir).where(F.col("tenant") == tenant).agg(usd(F.sum("cost_usd")).alias("cost"))
    return own.crossJoin(F.broadcast(subs)).crossJoin(F.broadcast(cost))


@query("storage_totals", """SELECT * FROM (SELECT 'all' AS part, 'all' AS name, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, count(*) AS files FROM documents UNION ALL SELECT 'lang', lang, CAST(sum(octet_length(encode(text))) AS BIGINT), count(*) FROM documents GROUP BY lang
UNION ALL SELECT * FROM (SELECT 'source', source, CAST(sum(octet_length(encode(text))) AS BIGINT) AS b, count(*) FROM documents GROUP BY source ORDER BY b DESC, source LIMIT 15))""")
def storage_totals(spark, sf_dir, top: int = 15):
    """Bytes and files in all, by language, and of the largest sources; one pass by grouping sets."""
    docs = table(spark, sf_dir, "documents").select("lang", "source", F.octet_length("text").alias("n"))
    sums = lambda rows, part, name: rows.agg(F.sum("n").alias("bytes"), F.count(F.lit(1)).alias("files")).select(F.lit(part).alias("part"), name.alias("name"), "bytes", "files")
    largest = sums(docs.groupBy("source"), "source", F.col("source")).orderBy(F.desc("bytes"), "name").limit(top)
    return sums(docs.groupBy(), "all", F.lit("all")).unionByName(sums(docs.groupBy("lang"), "lang", F.col("lang"))).unionByName(largest)


@query("worker_liveness", oracle(f"SELECT CAST(session_id % 4 AS BIGINT) AS worker, max(occurred_at) AS last_seen, max(occurred_at) >= TIMESTAMP '{LOG_NOW}' - INTERVAL 120 MINUTE AS alive FROM ev WHERE occurred_at < TIMESTAMP '{LOG_NOW}' GROUP BY 1"))
def worker_liveness(spark, sf_dir, minutes: int = 120):
    """The last sign of each worker, and whether it is recent."""
    last = F.max("occurred_at")
    seen = events(spark, sf_dir).where(F.col("occurred_at") < at(LOG_NOW)).groupBy((F.col("session_id") % 4).alias("worker"))
    return seen.agg(last.alias("last_seen"), (last >= at(LOG_NOW) - F.expr(f"INTERVAL {minutes} MINUTES")).alias("alive"))


@query("unkeyed_events", oracle(f"SELECT count(*) AS events, count(*) FILTER (WHERE page IS NULL OR page % 10 = 0) AS unkeyed FROM ev WHERE {_since('occurred_at', 1, LOG_NOW)}"))
def unkeyed_events(spark, sf_dir):
    """Events of the last day without an idempotency key; here a page of a round number stands for a missing key."""
    rows = events(spark, sf_dir).where(since("occurred_at", 1, LOG_NOW))
    return rows.agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("page").isNull() | (F.col("page") % 10 == 0)).alias("unkeyed"))


@query("dedup_events", oracle("SELECT tenant, count(*) AS n_events FROM (SELECT tenant, event_id FROM (SELECT tenant, event_id FROM ev UNION ALL SELECT tenant, event_id FROM ev WHERE event_id % 7 = 0) GROUP BY ALL) GROUP BY tenant"))
def dedup_events(spark, sf_dir):
    """Events that arrive again, some here, count once by their idempotency key; real repeats have keys of their own."""
    log = events(spark, sf_dir).select("tenant", "event_id")
    return log.unionByName(log.where("event_id % 7 = 0")).dropDuplicates(["tenant", "event_id"]).groupBy("tenant").agg(F.count(F.lit(1)).alias("n_events"))


@query("daily_rollup", oracle("""SELECT strftime(occurred_at, '%Y-%m-%d') AS day, tenant, count(*) FILTER (WHERE billable) AS questions, count(*) FILTER (WHERE kind = 'answer' AND succeeded) AS answers, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(cached_tokens) AS BIGINT) AS cached_tokens,
CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(coalesce(sum(cost_usd) FILTER (WHERE kind = 'answer'), 0), 6) AS answer_cost, round(coalesce(sum(cost_usd) FILTER (WHERE kind = 'embedding'), 0), 6) AS embedding_cost, round(sum(cost_usd), 6) AS total_cost
FROM led WHERE occurred_at >= TIMESTAMP '2001-08-29' AND tenant IS NOT NULL GROUP BY ALL"""))
def daily_rollup(spark, sf_dir):
    """The usage ledger by day and tenant for the last three days and on, ready for a partition overwrite by day."""
    rows = ledger(spark, sf_dir).where((F.col("occurred_at") >= at(NOW) - F.expr("INTERVAL 3 DAYS")) & F.col("tenant").isNotNull())
    of = lambda kind: usd(F.sum(F.when(F.col("kind") == kind, F.col("cost_usd"))))
    return rows.groupBy(F.date_format("occurred_at", "yyyy-MM-dd").alias("day"), "tenant").agg(
        F.count_if("billable").alias("questions"), F.count_if((F.col("kind") == "answer") & F.col("succeeded")).alias("answers"), F.sum("input_tokens").alias("input_tokens"), F.sum("cached_tokens").alias("cached_tokens"),
        F.sum("output_tokens").alias("output_tokens"), of("answer").alias("answer_cost"), of("embedding").alias("embedding_cost"), usd(F.sum("cost_usd")).alias("total_cost"),
    )


@query("job_reliability", oracle("""SELECT count(*) AS total, count(*) FILTER (WHERE s IN ('COMPLETED', 'SKIPPED')) AS succeeded, count(*) FILTER (WHERE s = 'FAILED') AS failed, round(count(*) FILTER (WHERE s IN ('COMPLETED', 'SKIPPED')) / count(*) FILTER (WHERE s IN ('COMPLETED', 'SKIPPED', 'FAILED')), 6) AS rate,
coalesce(quantile_disc(duration_ms, 0.95), 0) AS p95 FROM (SELECT *, CASE WHEN status = 'RUNNING' AND job_id % 2 = 0 THEN 'SKIPPED' ELSE status END AS s FROM job WHERE started_at >= TIMESTAMP '2001-07-01')"""))
def job_reliability(spark, sf_dir):
    """Success over finished jobs of a window, skipped ones included, and the nearest-rank 95th percentile over all its jobs.

    No task holds all durations (see ``functions.ranks``).
    """
    rows = jobs(spark, sf_dir).where(F.col("started_at") >= at("2001-07-01")).withColumn("s", F.when((F.col("status") == "RUNNING") & (F.col("job_id") % 2 == 0), "SKIPPED").otherwise(F.col("status")))
    good, bad = F.count_if(F.col("s").isin("COMPLETED", "SKIPPED")), F.count_if(F.col("s") == "FAILED")
    sums = rows.agg(F.count(F.lit(1)).alias("total"), good.alias("succeeded"), bad.alias("failed"), F.round(F.try_divide(good, good + bad), 6).alias("rate"))
    return sums.crossJoin(F.broadcast(nearest_rank(rows, "duration_ms", 0.95).select(F.coalesce("value", F.lit(0.0)).alias("p95"))))


def nearest_rank(rows: DataFrame, column: str, share: float) -> DataFrame:
    """One row with the value of rank ceil(share * n), null without rows."""
    found = percentile(rows, [], column, share).select("value")
    return found.agg(F.max("value").alias("value"))


#: Decimals of the column that costs are stored in.
STORED = 4


@query("cost_recon", oracle(f"""SELECT count(*) AS rows_checked, count(*) FILTER (WHERE off >= 1e-6) AS rows_off, round(sum(CASE WHEN off < 1e-6 THEN 0 ELSE off END), 6) AS error_usd, round(max(off), 6) AS largest
FROM (SELECT abs(round(cost_usd, {STORED}) - cost_usd) AS off FROM led WHERE kind = 'answer' AND occurred_at >= TIMESTAMP '2001-01-01')"""))
def cost_recon(spark, sf_dir):
    """Costs as they were stored, in ``STORED`` decimals, against those computed again for the rows of the current prices; differences under 1e-6 count as none."""
    rows = ledger(spark, sf_dir).where("kind = 'answer' AND occurred_at >= TIMESTAMP_NTZ '2001-01-01'")
    stored = rows.withColumn("stored", F.round("cost_usd", STORED))
    off = F.abs(F.col("stored") - cost_usd(F.col("kind"), F.col("input_tokens"), F.col("cached_tokens"), F.col("output_tokens")))
    return stored.agg(F.count(F.lit(1)).alias("rows_checked"), F.count_if(off >= 1e-6).alias("rows_off"), F.round(F.sum(F.when(off < 1e-6, 0.0).otherwise(off)), 6).alias("error_usd"), F.round(F.max(off), 6).alias("largest"))


@query("subscription_recon", oracle(f"""SELECT count(*) FILTER (WHERE c_custkey IS NULL) AS unlinked, count(*) FILTER (WHERE status = 'active' AND created_at + INTERVAL 365 DAY < TIMESTAMP '{NOW}' - INTERVAL 2 DAY) AS stale,
count(*) FILTER (WHERE status = 'active' AND amount_cents < 100000) AS unpaid FROM sub LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON tenant = c_custkey"""))
def subscription_recon(spark, sf_dir):
    """Subscriptions without a tenant in good standing, long past the end of their period, or below their price."""
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("tenant"), F.lit(True).alias("known"))
    active = F.col("status") == "active"
    ended = F.col("created_at") + F.expr("INTERVAL 365 DAYS") < at(NOW) - F.expr("INTERVAL 2 DAYS")
    return subscriptions(spark, sf_dir).join(known, "tenant", "left").agg(F.count_if(F.col("known").isNull()).alias("unlinked"), F.count_if(active & ended).alias("stale"), F.count_if(active & (F.col("amount_cents") < 100000)).alias("unpaid"))


@query("webhook_recon", oracle("SELECT kind, count(*) FILTER (WHERE page < 95) AS processed, count(*) FILTER (WHERE page >= 95) AS errored FROM ev GROUP BY kind"))
def webhook_recon(spark, sf_dir):
    return events(spark, sf_dir).groupBy("kind").agg(F.count_if(F.col("page") < 95).alias("processed"), F.count_if(F.col("page") >= 95).alias("errored"))


@query("embed_complete", "SELECT source, count(*) AS chunks, count(vec_id) AS embedded, round(count(vec_id) / count(*), 6) AS share FROM documents LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings WHERE embedding IS NOT NULL) ON vec_id = doc_id GROUP BY source")
def embed_complete(spark, sf_dir):
    """Share of the chunks of each source that have a vector."""
    made = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("made")).distinct()
    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(made, "doc_id", "left")
    return joined.groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.count("made").alias("embedded"), F.round(F.count("made") / F.count(F.lit(1)), 6).alias("share"))


@query("ingest_success", "SELECT count(*) AS files, count(*) FILTER (WHERE n_chars > 0 AND text IS NOT NULL) AS ready, round(count(*) FILTER (WHERE n_chars > 0 AND text IS NOT NULL) / count(*), 6) AS rate FROM documents WHERE lang IS NOT NULL")
def ingest_success(spark, sf_dir):
    """Files that became readable, of the live ones."""
    ready = F.count_if((F.col("n_chars") > 0) & F.col("text").isNotNull())
    return table(spark, sf_dir, "documents").where("lang IS NOT NULL").agg(F.count(F.lit(1)).alias("files"), ready.alias("ready"), F.round(ready / F.count(F.lit(1)), 6).alias("rate"))


def optional_filters(*conditions: Column | None) -> Column:
    """All conditions that were given; true without any."""
    return reduce(lambda a, b: a & b, (c for c in conditions if c is not None), F.lit(True))


@query("job_list", oracle(f"SELECT job_id, kind, status, started_at, (SELECT count(*) FROM job WHERE status = 'FAILED' AND kind LIKE '1%') AS total FROM job WHERE status = 'FAILED' AND kind LIKE '1%' ORDER BY started_at DESC, job_id LIMIT {PAGE}"))
def job_list(spark, sf_dir, status: str | None = "FAILED", kind: str | None = "1"):
    """Jobs, newest first, by whichever filters are given."""
    wanted = optional_filters(None if status is None else F.col("status") == status, None if kind is None else F.col("kind").startswith(kind))
    return page_of(jobs(spark, sf_dir).where(wanted).select("job_id", "kind", "status", "started_at"), F.desc("started_at"), "job_id")


@query("subscription_list", oracle(f"SELECT sub_id, c_name AS tenant_name, status, amount_cents, (SELECT count(*) FROM sub WHERE status <> 'canceled') AS total FROM sub JOIN customer ON c_custkey = tenant WHERE status <> 'canceled' ORDER BY created_at DESC, sub_id LIMIT {PAGE}"))
def subscription_list(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tenant"), F.col("c_name").alias("tenant_name"))
    rows = subscriptions(spark, sf_dir).where("status <> 'canceled'").join(names, "tenant").select("sub_id", "tenant_name", "status", "amount_cents", "created_at")
    return page_of(rows, F.desc("created_at"), "sub_id").drop("created_at")


@query("payment_list", oracle(f"SELECT sub_id, tenant, amount_cents, CASE WHEN status = 'active' THEN 'paid' ELSE 'failed' END AS state FROM sub WHERE {_since('created_at', 60)} ORDER BY amount_cents DESC, sub_id LIMIT {PAGE}"))
def payment_list(spark, sf_dir):
    rows = subscriptions(spark, sf_dir).where(since("created_at", 60)).select("sub_id", "tenant", "amount_cents", F.when(F.col("status") == "active", "paid").otherwise("failed").alias("state"))
    return rows.orderBy(F.desc("amount_cents"), "sub_id").limit(PAGE)


@query("user_list", f"SELECT c_custkey AS user_id, c_name AS name, n_name AS country, (SELECT count(*) FROM customer WHERE c_name ILIKE '%1%') AS total FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_name ILIKE '%1%' ORDER BY c_name, c_custkey LIMIT {PAGE}")
def user_list(spark, sf_dir, term: str = "1"):
    countries = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country"))
    rows = table(spark, sf_dir, "customer").where(F.col("c_name").ilike(f"%{term}%")).join(F.broadcast(countries), "c_nationkey").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), "country")
    return page_of(rows, "name", "user_id")


@query("audit_list", oracle(f"SELECT event_id, kind AS action, session_id AS actor, occurred_at FROM ev WHERE kind IN ('downloaded', 'unanswered') AND {_since('occurred_at', 7, LOG_NOW)} ORDER BY occurred_at DESC, event_id DESC LIMIT 100"))
def audit_list(spark, sf_dir):
    rows = events(spark, sf_dir).where(F.col("kind").isin("downloaded", "unanswered") & since("occurred_at", 7, LOG_NOW))
    return rows.select("event_id", F.col("kind").alias("action"), F.col("session_id").alias("actor"), "occurred_at").orderBy(F.desc("occurred_at"), F.desc("event_id")).limit(100)


SORTS = {"newest": ("o_orderdate", False), "oldest": ("o_orderdate", True), "largest": ("o_totalprice", False)}


@query("sort_choice", " UNION ALL ".join(f"SELECT * FROM (SELECT '{name}' AS sort, o_orderkey AS id, row_number() OVER (ORDER BY {c} {d}, o_orderkey) AS place FROM orders ORDER BY place LIMIT 10)" for name, c, d in (("newest", "o_orderdate", "DESC"), ("oldest", "o_orderdate", "ASC"), ("largest", "o_totalprice", "DESC"))))
def sort_choice(spark, sf_dir, top: int = 10):
    """The first rows under each order that a list may be asked for."""
    orders, parts = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), []
    for name, (column, rising) in SORTS.items():
        first = orders.orderBy(F.asc(column) if rising else F.desc(column), "o_orderkey").limit(top)
        place = F.row_number().over(Window.orderBy(F.asc(column) if rising else F.desc(column), "o_orderkey")).cast("long")
        parts.append(first.select(F.lit(name).alias("sort"), F.col("o_orderkey").alias("id"), place.alias("place")))
    return reduce(DataFrame.unionByName, parts)


@query("default_file", "SELECT source, min(doc_id) AS file_id FROM documents WHERE n_chars = (SELECT max(n_chars) FROM documents d WHERE d.source = documents.source) GROUP BY source")
def default_file(spark, sf_dir):
    """The longest file of each source, the smaller id of equal ones."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.max(F.struct("n_chars", (-F.col("doc_id")).alias("k"))).alias("m")).select("source", (-F.col("m.k")).alias("file_id"))


@query("list_versions", "SELECT o_custkey AS file_id, o_orderkey AS version, o_orderdate AS created_at, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS age, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1 AS is_current FROM orders")
def list_versions(spark, sf_dir):
    newest = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderkey"))).cast("long")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", newest.alias("age"))
    return rows.select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("created_at"), "age", (F.col("age") == 1).alias("is_current"))


@query("recent_questions", oracle("SELECT tenant, event_id, occurred_at FROM (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY occurred_at DESC, event_id DESC) AS r FROM ev WHERE kind IN ('asked', 'unanswered')) WHERE r <= 10"))
def recent_questions(spark, sf_dir, top: int = 10):
    """The newest questions of each tenant."""
    newest = F.row_number().over(Window.partitionBy("tenant").orderBy(F.desc("occurred_at"), F.desc("event_id")))
    rows = events(spark, sf_dir).where(F.col("kind").isin("asked", "unanswered")).select("tenant", "event_id", "occurred_at", newest.alias("r"))
    return rows.where(F.col("r") <= top).drop("r")


def insight(questions: Column, unanswered: Column) -> Column:
    """Null below two unanswered questions or a share of 0.3; from 0.7 on the theme is not covered, else not clear."""
    share = unanswered / F.greatest(questions, F.lit(1))
    return F.when((unanswered < 2) | (share < 0.3), F.lit(None).cast("string")).when(share >= 0.7, "not covered").otherwise("not clear")


@query("unanswered", oracle("SELECT e.event_id, e.tenant, e.occurred_at, c_name AS name FROM ev e LEFT JOIN customer ON c_custkey = session_id WHERE kind = 'unanswered' ORDER BY e.occurred_at DESC, e.event_id DESC LIMIT 20"))
def unanswered(spark, sf_dir, top: int = 20):
    """The newest questions without an answer, with who asked where that is known."""
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"), F.col("c_name").alias("name"))
    newest = events(spark, sf_dir).where("kind = 'unanswered'").orderBy(F.desc("occurred_at"), F.desc("event_id")).limit(top)
    return newest.join(names, "session_id", "left").select("event_id", "tenant", "occurred_at", "name")


@query("soft_delete", "SELECT source, count(*) AS live FROM documents WHERE CASE WHEN doc_id % 9 = 0 THEN doc_id END IS NULL GROUP BY source")
def soft_delete(spark, sf_dir):
    """Rows whose mark of deletion is null."""
    deleted = F.when(F.col("doc_id") % 9 == 0, F.col("doc_id"))
    return table(spark, sf_dir, "documents").where(deleted.isNull()).groupBy("source").agg(F.count(F.lit(1)).alias("live"))


def _lifecycle(status: Column, wish: Column) -> Column:
    """The status after a wish, or null where it is not allowed; what is deleted stays so."""
    return (
        F.when(status == "DELETED", None).when(wish == "pause", F.when(status == "ACTIVE", "PAUSED")).when(wish == "resume", F.when(status == "PAUSED", "ACTIVE"))
        .when(wish == "revoke", F.when(status.isin("ACTIVE", "PAUSED", "EXPIRED"), "REVOKED")).when(wish == "delete", "DELETED")
    )


@query("lifecycle", """SELECT o_orderkey AS id, CASE WHEN s = 'DELETED' THEN NULL WHEN w = 'pause' THEN CASE WHEN s = 'ACTIVE' THEN 'PAUSED' END WHEN w = 'resume' THEN CASE WHEN s = 'PAUSED' THEN 'ACTIVE' END WHEN w = 'revoke' THEN CASE WHEN s IN ('ACTIVE', 'PAUSED', 'EXPIRED') THEN 'REVOKED' END WHEN w = 'delete' THEN 'DELETED' END AS status
FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'ACTIVE' WHEN 'F' THEN 'EXPIRED' WHEN 'P' THEN 'PAUSED' END AS s, CASE o_orderkey % 4 WHEN 0 THEN 'pause' WHEN 1 THEN 'resume' WHEN 2 THEN 'revoke' ELSE 'delete' END AS w FROM orders)""")
def lifecycle(spark, sf_dir):
    """A snapshot after each row's wish."""
    status = F.when(F.col("o_orderstatus") == "O", "ACTIVE").when(F.col("o_orderstatus") == "F", "EXPIRED").when(F.col("o_orderstatus") == "P", "PAUSED")
    k = F.col("o_orderkey") % 4
    wish = F.when(k == 0, "pause").when(k == 1, "resume").when(k == 2, "revoke").otherwise("delete")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), _lifecycle(status, wish).alias("status"))


@query("purge_sessions", oracle(f"SELECT session_id, max(occurred_at) AS last_seen FROM ev GROUP BY session_id HAVING max(occurred_at) < TIMESTAMP '{LOG_NOW}' - INTERVAL 3 HOUR"))
def purge_sessions(spark, sf_dir):
    """Sessions that were last seen before the time they are kept."""
    seen = events(spark, sf_dir).groupBy("session_id").agg(F.max("occurred_at").alias("last_seen"))
    return seen.where(F.col("last_seen") < at(LOG_NOW) - F.expr("INTERVAL 3 HOURS"))


@query("purge_room", oracle("SELECT count(*) AS events_left FROM ev WHERE file_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 5 = 0)"))
def purge_room(spark, sf_dir):
    """The log without the events of files that are gone, as a new snapshot; here counted."""
    gone = table(spark, sf_dir, "documents").where("doc_id % 5 = 0").select(F.col("doc_id").alias("file_id"))
    return events(spark, sf_dir).join(gone, "file_id", "left_anti").where("file_id IS NOT NULL").agg(F.count(F.lit(1)).alias("events_left"))
