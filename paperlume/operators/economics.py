"""Unit economics, billing and quotas over the usage ledger and subscriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import percentile
from ..plans.registry import query
from ..sources.tables import ledger, oracle, subscriptions, table
from .engagement import ratio

#: US dollars per unit of the billing currency. Fixed value.
FX = 1.08


def money(column) -> F.Column:
    return F.round(column, 4)


def cost_breakdown(rows: DataFrame) -> DataFrame:
    """Totals by kind of request; mean cost is answer cost per billable row."""
    answer = F.when(F.col("kind") == "answer", F.col("cost_usd")).otherwise(0.0)
    out = rows.agg(
        F.sum("cost_usd").alias("t"), F.sum(answer).alias("a"), F.count_if("billable").alias("billable"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("cached_tokens").alias("cached_tokens"), F.sum("output_tokens").alias("output_tokens"),
    )
    return out.select(money("t").alias("total_cost"), money("a").alias("answer_cost"), money(F.col("t") - F.col("a")).alias("embedding_cost"), "billable", "input_tokens", "cached_tokens", "output_tokens", F.round(ratio(F.col("a"), F.col("billable")), 6).alias("avg_cost"), F.round(ratio(F.col("cached_tokens"), F.col("input_tokens")), 6).alias("cached_ratio"))


@query("cost_breakdown", oracle("""SELECT round(sum(cost_usd), 4) AS total_cost, round(sum(cost_usd) FILTER (WHERE kind = 'answer'), 4) AS answer_cost, round(sum(cost_usd) FILTER (WHERE kind <> 'answer'), 4) AS embedding_cost, count(*) FILTER (WHERE billable) AS billable,
CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(cached_tokens) AS BIGINT) AS cached_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(cost_usd) FILTER (WHERE kind = 'answer') / count(*) FILTER (WHERE billable), 6) AS avg_cost, round(sum(cached_tokens) / sum(input_tokens), 6) AS cached_ratio FROM led"""))
def _breakdown(spark, sf_dir):
    return cost_breakdown(ledger(spark, sf_dir))


@query("daily_costs", oracle("""SELECT strftime(d, '%Y-%m-%d') AS day, count(*) FILTER (WHERE billable) AS billable, round(coalesce(sum(cost_usd), 0), 4) AS cost
FROM generate_series(TIMESTAMP '2001-10-06', TIMESTAMP '2001-11-05', INTERVAL 1 DAY) g(d) LEFT JOIN led ON occurred_at >= d AND occurred_at < d + INTERVAL 1 DAY GROUP BY d"""))
def daily_costs(spark, sf_dir):
    from .engagement import day_spine

    sums = ledger(spark, sf_dir).groupBy(F.to_date("occurred_at").alias("day")).agg(F.count_if("billable").alias("b"), F.sum("cost_usd").alias("c"))
    found = day_spine(spark, "2001-11-05 00:00:00", 30).join(sums, "day", "left")
    return found.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("b", F.lit(0)).alias("billable"), money(F.coalesce("c", F.lit(0.0))).alias("cost"))


def workspace_economics(rows: DataFrame, subs: DataFrame) -> DataFrame:
    """Per tenant: questions, cost, monthly revenue of the latest live subscription, margin (null share without revenue)."""
    spent = rows.groupBy("tenant").agg(F.count_if("billable").alias("questions"), F.sum("cost_usd").alias("c"))
    live = subs.where(F.col("status").isin("active", "trialing", "past_due"))
    monthly = F.when(F.col("latest.annual"), F.col("latest.amount_cents") / 12.0).otherwise(F.col("latest.amount_cents"))
    paid = live.groupBy("tenant").agg(F.max(F.struct("created_at", "sub_id", "annual", "amount_cents")).alias("latest")).select("tenant", (monthly / 100 * FX).alias("r"))
    both = spent.join(paid, "tenant", "left").withColumn("r", F.coalesce("r", F.lit(0.0)))
    return both.select("tenant", "questions", money("c").alias("cost"), money("r").alias("revenue"), money(money("r") - money("c")).alias("margin"), F.when(F.col("r") > 0, F.round((F.col("r") - F.col("c")) / F.col("r"), 6)).alias("margin_share"))


_ECONOMICS = """spent AS (SELECT tenant, count(*) FILTER (WHERE billable) AS questions, sum(cost_usd) AS c FROM led GROUP BY tenant),
paid AS (SELECT tenant, CASE WHEN annual THEN amount_cents / 12.0::DOUBLE ELSE amount_cents END / 100 * 1.08::DOUBLE AS r FROM (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY created_at DESC, sub_id DESC) AS k FROM sub WHERE status IN ('active', 'trialing', 'past_due')) WHERE k = 1),
eco AS (SELECT tenant, questions, round(c, 4) AS cost, round(coalesce(r, 0), 4) AS revenue, round(round(coalesce(r, 0), 4) - round(c, 4), 4) AS margin, CASE WHEN r > 0 THEN round((r - c) / r, 6) END AS margin_share FROM spent LEFT JOIN paid USING (tenant))"""


def _with_economics(body: str) -> str:
    head, rest = oracle(""), f", {_ECONOMICS}\n{body}"
    return head.rstrip() + rest


@query("workspace_economics", _with_economics("SELECT * FROM eco"))
def _economics(spark, sf_dir):
    return workspace_economics(ledger(spark, sf_dir), subscriptions(spark, sf_dir))


def costliest_losses(economics: DataFrame, most: int = 200) -> DataFrame:
    """Of the ``most`` costliest tenants, those that cost more than they bring, the greatest losses first."""
    return economics.orderBy(F.desc("cost"), "tenant").limit(most).where("cost > 0 AND margin < 0").orderBy("margin", "tenant")


@query("unprofitable", _with_economics("SELECT * FROM (SELECT * FROM eco ORDER BY cost DESC, tenant LIMIT 200) WHERE cost > 0 AND margin < 0 ORDER BY margin, tenant"))
def unprofitable(spark, sf_dir):
    """The costliest tenants that cost more than they bring."""
    return costliest_losses(_economics(spark, sf_dir))


@query("room_costs", oracle("SELECT room, count(*) FILTER (WHERE billable) AS questions, round(sum(cost_usd), 4) AS cost FROM led WHERE occurred_at >= TIMESTAMP '2001-10-01' GROUP BY room ORDER BY cost DESC, room LIMIT 20"))
def room_costs(spark, sf_dir):
    sums = ledger(spark, sf_dir).where("occurred_at >= TIMESTAMP_NTZ '2001-10-01'").groupBy("room").agg(F.count_if("billable").alias("questions"), money(F.sum("cost_usd")).alias("cost"))
    return sums.orderBy(F.desc("cost"), "room").limit(20)


@query("usage_summary", oracle("""SELECT tenant, count(*) FILTER (billable) AS questions, count(*) FILTER (kind = 'answer' AND succeeded) AS answers, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(cached_tokens) AS BIGINT) AS cached_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
round(coalesce(sum(cost_usd) FILTER (kind = 'answer'), 0), 6) AS answer_cost, round(coalesce(sum(cost_usd) FILTER (kind = 'embedding'), 0), 6) AS embedding_cost, round(sum(cost_usd), 6) AS total_cost, coalesce(CAST(round(sum(cost_usd) * 1000000) AS BIGINT) // nullif(count(*) FILTER (billable), 0), 0) AS question_micros,
round(coalesce(avg(latency_ms) FILTER (kind = 'answer'), 0), 6) AS avg_latency FROM led GROUP BY tenant"""))
def usage_summary(spark, sf_dir):
    """Questions, answers, tokens and spend of each tenant; the cost of a question (in millionths, cut) is that of all its requests, the latency that of answers."""
    total, asked = F.round(F.sum("cost_usd"), 6), F.count_if("billable")
    of = lambda kind: F.round(F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("cost_usd"))), F.lit(0.0)), 6)
    return ledger(spark, sf_dir).groupBy("tenant").agg(
        asked.alias("questions"), F.count_if((F.col("kind") == "answer") & F.col("succeeded")).alias("answers"), *(F.sum(c).alias(c) for c in ("input_tokens", "cached_tokens", "output_tokens")),
        of("answer").alias("answer_cost"), of("embedding").alias("embedding_cost"), total.alias("total_cost"), F.coalesce(F.floor(F.try_divide(F.round(F.sum("cost_usd") * 1_000_000), asked)).cast("long"), F.lit(0)).alias("question_micros"),
        F.round(F.coalesce(F.avg(F.when(F.col("kind") == "answer", F.col("latency_ms"))), F.lit(0.0)), 6).alias("avg_latency"),
    )


@query("latency_pctl", oracle("SELECT kind, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95 FROM led WHERE succeeded GROUP BY kind"))
def latency_pctl(spark, sf_dir):
    """Nearest-rank latencies by kind of request, answers and the embeddings that retrieval waits for."""
    rows = ledger(spark, sf_dir).where("succeeded")
    of = lambda share, name: percentile(rows, ["kind"], "latency_ms", share).select("kind", F.col("value").cast("long").alias(name))
    return of(0.5, "p50").join(of(0.95, "p95"), "kind")


@query("mrr", oracle("SELECT CAST(round(sum(CASE WHEN annual THEN amount_cents / 12.0::DOUBLE ELSE amount_cents END)) AS BIGINT) AS mrr_cents FROM sub WHERE status IN ('active', 'trialing') AND NOT cancels"))
def mrr(spark, sf_dir):
    """Monthly recurring revenue; subscriptions that end with their period do not count."""
    live = subscriptions(spark, sf_dir).where(F.col("status").isin("active", "trialing") & ~F.col("cancels"))
    return live.agg(F.round(F.sum(F.when(F.col("annual"), F.col("amount_cents") / 12.0).otherwise(F.col("amount_cents")))).cast("long").alias("mrr_cents"))


@query("mrr_by_plan", oracle("""SELECT c_mktsegment AS plan, count(*) AS subscriptions, CAST(round(sum(CASE WHEN annual THEN amount_cents / 12.0::DOUBLE ELSE amount_cents END)) AS BIGINT) AS mrr_cents
FROM sub JOIN customer ON c_custkey = tenant WHERE status IN ('active', 'trialing') GROUP BY plan"""))
def mrr_by_plan(spark, sf_dir):
    """By plan, subscriptions that end with their period included."""
    plans = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("tenant"), F.col("c_mktsegment").alias("plan"))
    live = subscriptions(spark, sf_dir).where(F.col("status").isin("active", "trialing")).join(plans, "tenant")
    return live.groupBy("plan").agg(F.count(F.lit(1)).alias("subscriptions"), F.round(F.sum(F.when(F.col("annual"), F.col("amount_cents") / 12.0).otherwise(F.col("amount_cents")))).cast("long").alias("mrr_cents"))


@query("quota_state", oracle("""SELECT tenant, allowance, consumed, greatest(allowance - consumed, 0) AS remaining, CASE WHEN allowance = 0 THEN 1.0::DOUBLE ELSE round(least(consumed / allowance, 1), 6) END AS utilisation
FROM (SELECT CAST(c_custkey AS BIGINT) AS tenant, CAST(greatest(CASE c_mktsegment WHEN 'BUILDING' THEN 20 WHEN 'MACHINERY' THEN 0 ELSE 10 END + c_nationkey - 5, 0) AS BIGINT) AS allowance FROM customer)
LEFT JOIN (SELECT tenant, count(*) AS n FROM led WHERE billable GROUP BY tenant) USING (tenant), LATERAL (SELECT coalesce(n, 0) AS consumed)"""))
def quota_state(spark, sf_dir):
    """Allowance (plan, purchases, adjustments; never negative), consumption, what remains, and the share used."""
    plan = F.when(F.col("c_mktsegment") == "BUILDING", 20).when(F.col("c_mktsegment") == "MACHINERY", 0).otherwise(10)
    granted = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("tenant"), F.greatest(plan + F.col("c_nationkey") - 5, F.lit(0)).cast("long").alias("allowance"))
    used = ledger(spark, sf_dir).where("billable").groupBy("tenant").agg(F.count(F.lit(1)).alias("n"))
    both = granted.join(used, "tenant", "left").withColumn("consumed", F.coalesce("n", F.lit(0)))
    share = F.when(F.col("allowance") == 0, 1.0).otherwise(F.round(F.least(F.try_divide("consumed", "allowance"), F.lit(1.0)), 6))
    return both.select("tenant", "allowance", "consumed", F.greatest(F.col("allowance") - F.col("consumed"), F.lit(0)).alias("remaining"), share.alias("utilisation"))


@query("quota_recon", oracle("""SELECT count(*) FILTER (WHERE o.o_orderkey IS NULL) AS orphaned, count(*) AS billable, count(*) FILTER (WHERE l_returnflag = 'A' OR l_linenumber > 6) AS mispriced
FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') o ON l_orderkey = o.o_orderkey WHERE l_linestatus = 'O' AND l_shipdate >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 35 DAY"""))
def quota_recon(spark, sf_dir):
    """Billable rows of the last 35 days: whose question is missing, and that did not succeed or are no answers (line 7 is an embedding)."""
    known = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(True).alias("known"))
    lines = table(spark, sf_dir, "lineitem")
    last = lines.agg(F.max("l_shipdate").alias("last"))
    rows = lines.where("l_linestatus = 'O'").crossJoin(F.broadcast(last)).where(F.col("l_shipdate") >= F.col("last") - F.expr("INTERVAL 35 DAYS"))
    found = rows.select("l_orderkey", "l_returnflag", "l_linenumber").join(known, "l_orderkey", "left")
    return found.agg(F.count_if(F.col("known").isNull()).alias("orphaned"), F.count(F.lit(1)).alias("billable"), F.count_if((F.col("l_returnflag") == "A") | (F.col("l_linenumber") > 6)).alias("mispriced"))


@query("orphan_rows", oracle("SELECT count(*) AS orphans FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"))
def orphan_rows(spark, sf_dir):
    """Rows without their counterpart, by an anti join."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"))
    return rows.join(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("k")), "k", "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
