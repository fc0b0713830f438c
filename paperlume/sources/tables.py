"""Views of the star-schema tables as the logs and ledgers that the operators work on.

Each view is a projection (one join for the ledger), so filters and column pruning reach the
Parquet scan. ``ORACLE`` has the same views as SQL common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_KINDS = {"view": "opened", "click": "asked", "error": "unanswered", "purchase": "downloaded", "signup": "page_viewed"}
#: US dollars per million tokens: input, cached input, output. Fixed values.
PRICES = {"answer": (0.2, 0.02, 1.2), "embedding": (0.02, 0.02, 0.0)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mapped(column: Column, values: dict[str, str]) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for key, value in values.items():
        out = out.when(column == key, F.lit(value))
    return out


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engagement log: event_id, tenant, session_id, kind, page, file_id, duration_ms, occurred_at."""
    page = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        "event_id", (F.col("user_id") % 20).alias("tenant"), F.col("user_id").alias("session_id"), _mapped(F.col("event_type"), EVENT_KINDS).alias("kind"),
        page.alias("page"), (page % 50).alias("file_id"), F.round(F.col("value") * 1000).cast("long").alias("duration_ms"), F.col("ts").alias("occurred_at"),
    )


def cost_usd(kind: Column, input_tokens: Column, cached_tokens: Column, output_tokens: Column) -> Column:
    """Price of one call: cached tokens never exceed input; unknown kinds cost nothing; rounded to 1e-6."""
    cached = F.least(cached_tokens, input_tokens)
    out = F.when(F.lit(False), F.lit(0.0))
    for name, (fresh, reused, made) in PRICES.items():
        price = ((input_tokens - cached) * fresh + cached * reused + output_tokens * made) / 1_000_000
        out = out.when(kind == name, F.round(price, 6))
    return out.otherwise(0.0)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage ledger: one row per model call, with its cost computed as it is written."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("tenant"))
    lines = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_linestatus") == "O", "answer").otherwise("embedding")
    rows = lines.select(
        "l_orderkey", (F.col("l_partkey") % 200).alias("room"), F.col("l_shipdate").alias("occurred_at"), kind.alias("kind"), (F.col("l_returnflag") != "A").alias("succeeded"),
        ((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O")).alias("billable"), (F.col("l_quantity") * 200).cast("long").alias("input_tokens"),
        F.floor(F.col("l_quantity") * 200 * F.col("l_discount")).cast("long").alias("cached_tokens"), (F.col("l_linenumber") * 50).cast("long").alias("output_tokens"), (F.col("l_partkey") % 5000).alias("latency_ms"),
    )
    priced = rows.withColumn("cost_usd", cost_usd(F.col("kind"), F.col("input_tokens"), F.col("cached_tokens"), F.col("output_tokens")))
    return priced.join(orders, "l_orderkey")


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscriptions: sub_id, tenant, status, annual, amount_cents, cancels, created_at."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("sub_id"), F.col("o_custkey").alias("tenant"), _mapped(F.col("o_orderstatus"), {"O": "active", "F": "canceled", "P": "trialing"}).alias("status"),
        F.col("o_orderpriority").rlike("^[12]").alias("annual"), F.round("o_totalprice").cast("long").alias("amount_cents"), F.col("o_orderpriority").startswith("5").alias("cancels"), F.col("o_orderdate").alias("created_at"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processing jobs: job_id, kind, status, duration_ms, started_at."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("kind"), _mapped(F.col("o_orderstatus"), {"O": "COMPLETED", "F": "FAILED", "P": "RUNNING"}).alias("status"),
        F.col("o_totalprice").alias("duration_ms"), F.col("o_orderdate").alias("started_at"),
    )


ORACLE = """ev AS (SELECT event_id, user_id % 20 AS tenant, user_id AS session_id,
  CASE event_type WHEN 'view' THEN 'opened' WHEN 'click' THEN 'asked' WHEN 'error' THEN 'unanswered' WHEN 'purchase' THEN 'downloaded' WHEN 'signup' THEN 'page_viewed' END AS kind,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS page, CAST(json_extract_string(props, '$.k') AS BIGINT) % 50 AS file_id, CAST(round(value * 1000) AS BIGINT) AS duration_ms, ts AS occurred_at FROM events),
led0 AS (SELECT o_custkey AS tenant, l_partkey % 200 AS room, l_shipdate AS occurred_at, CASE WHEN l_linestatus = 'O' THEN 'answer' ELSE 'embedding' END AS kind, l_returnflag <> 'A' AS succeeded,
  l_returnflag = 'N' AND l_linestatus = 'O' AS billable, CAST(l_quantity * 200 AS BIGINT) AS input_tokens, CAST(floor(l_quantity * 200 * l_discount) AS BIGINT) AS cached_tokens, CAST(l_linenumber * 50 AS BIGINT) AS output_tokens, l_partkey % 5000 AS latency_ms
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
led AS (SELECT *, round(CASE kind WHEN 'answer' THEN ((input_tokens - least(cached_tokens, input_tokens)) * 0.2::DOUBLE + least(cached_tokens, input_tokens) * 0.02::DOUBLE + output_tokens * 1.2::DOUBLE) / 1000000
  ELSE ((input_tokens - least(cached_tokens, input_tokens)) * 0.02::DOUBLE + least(cached_tokens, input_tokens) * 0.02::DOUBLE) / 1000000 END, 6) AS cost_usd FROM led0),
sub AS (SELECT o_orderkey AS sub_id, o_custkey AS tenant, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'canceled' WHEN 'P' THEN 'trialing' END AS status, regexp_matches(o_orderpriority, '^[12]') AS annual,
  CAST(round(o_totalprice) AS BIGINT) AS amount_cents, starts_with(o_orderpriority, '5') AS cancels, o_orderdate AS created_at FROM orders),
job AS (SELECT o_orderkey AS job_id, o_orderpriority AS kind, CASE o_orderstatus WHEN 'O' THEN 'COMPLETED' WHEN 'F' THEN 'FAILED' WHEN 'P' THEN 'RUNNING' END AS status, o_totalprice AS duration_ms, o_orderdate AS started_at FROM orders)"""


def oracle(body: str) -> str:
    """A query over the views above, for the oracle."""
    return f"WITH {ORACLE}\n{body}"
