"""Call log and run list queries over events and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from mercalith.plans import call_log
from workload.registry import query
from workload.target_view import table

_CALLS = """
SELECT CASE WHEN user_id % 10 <> 0 THEN 'job-' || CAST(user_id % 60 AS STRING) END AS job_id,
       event_id AS call_id, 'structured_query' AS method,
       CASE WHEN event_type <> 'error' THEN event_type END AS label,
       'model-' || CAST(event_id % 3 AS STRING) AS model,
       CAST(floor(value * 10) AS BIGINT) AS input_tokens, CAST(floor(value) AS BIGINT) AS output_tokens,
       user_id * 3 + 1 AS duration_ms, floor(event_id / 3) AS timestamp,
       CASE WHEN event_id % 20 = 0 THEN 'timeout' END AS error
FROM events"""
_PRICES = """
SELECT 'model-0' AS model, CAST(3 AS DOUBLE) AS input_price, CAST(15 AS DOUBLE) AS output_price
UNION ALL SELECT 'model-1', CAST(0.5 AS DOUBLE), CAST(2 AS DOUBLE)"""
_COSTED = f"""c AS (SELECT x.*, (CAST(input_tokens AS DECIMAL(18,0)) * CAST(coalesce(input_price, 3) AS DECIMAL(12,6))
  + CAST(output_tokens AS DECIMAL(18,0)) * CAST(coalesce(output_price, 15) AS DECIMAL(12,6))) AS micro_usd FROM ({_CALLS}) x LEFT JOIN ({_PRICES}) p USING (model))"""
_SUMS = (
    "count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, "
    "sum(output_tokens)::BIGINT AS output_tokens, CAST(round(CAST(sum(micro_usd) AS DECIMAL(32,6)), 0) AS DOUBLE) / 1000000 AS cost_usd"
)


def _calls(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return spark.sql(_CALLS)


def _costed(spark, sf_dir):
    return call_log.with_cost(_calls(spark, sf_dir), spark.sql(_PRICES))


@query("call_cost", f"WITH {_COSTED} SELECT call_id, model, CAST(micro_usd AS DOUBLE) / 1000000 AS cost_usd FROM c")
def call_cost(spark, sf_dir):
    return _costed(spark, sf_dir).selectExpr("call_id", "model", "CAST(cost_usd AS DOUBLE) AS cost_usd")


@query(
    "call_summary",
    f"WITH {_COSTED} SELECT {_SUMS}, sum(input_tokens + output_tokens)::BIGINT AS total_tokens, "
    "sum(duration_ms)::BIGINT AS duration_ms FROM c",
)
def call_summary(spark, sf_dir):
    return call_log.summary(_costed(spark, sf_dir))


@query(
    "calls_by_job",
    f"WITH {_COSTED} SELECT job_id, {_SUMS}, sum(duration_ms)::BIGINT AS duration_ms FROM c "
    "WHERE job_id IS NOT NULL GROUP BY job_id",
)
def calls_by_job(spark, sf_dir):
    return call_log.by_job(_costed(spark, sf_dir))


@query(
    "calls_by_label",
    f"WITH {_COSTED} SELECT coalesce(label, method) AS label, {_SUMS}, count(error) AS errors FROM c GROUP BY 1",
)
def calls_by_label(spark, sf_dir):
    return call_log.by_label(_costed(spark, sf_dir))


@query(
    "recent_calls",
    f"SELECT call_id, job_id, model, input_tokens FROM ({_CALLS}) "
    "ORDER BY timestamp DESC, call_id DESC LIMIT 20",
)
def recent_calls(spark, sf_dir):
    return call_log.recent(_calls(spark, sf_dir)).select("call_id", "job_id", "model", "input_tokens")


_LIVE = """
SELECT 'run-' || CAST(user_id AS STRING) AS job_id, 'validation' AS step,
       max(event_id) AS created_at, count(*) AS total_rows
FROM events WHERE user_id % 3 = 0 GROUP BY user_id"""
_KEPT = """
SELECT 'run-' || CAST(user_id AS STRING) AS job_id, 'complete' AS step,
       min(event_id) AS created_at, count(*) AS total_rows
FROM events WHERE user_id % 2 = 0 GROUP BY user_id"""


@query(
    "list_runs",
    f"WITH live AS ({_LIVE}), kept AS ({_KEPT}) SELECT *, true AS is_live FROM live "
    "UNION ALL SELECT *, false FROM kept WHERE job_id NOT IN (SELECT job_id FROM live)",
)
def list_runs(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return call_log.list_runs(spark.sql(_LIVE), spark.sql(_KEPT))


@query(
    "recent_messages",
    "SELECT user_id AS job_id, event_id AS position, event_type AS message FROM events "
    "QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 20",
)
def recent_messages(spark, sf_dir):
    messages = table(spark, sf_dir, "events").selectExpr(
        "user_id AS job_id", "event_id AS position", "event_type AS message"
    )
    return call_log.recent_messages(messages)
