"""Summaries of the call log and of the list of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Price per million tokens where the price table has no entry for the model.
DEFAULT_INPUT_PRICE, DEFAULT_OUTPUT_PRICE = 3, 15
RECENT_CALLS = 20
RECENT_MESSAGES = 20

_COUNTS = {
    "calls": "count(*)",
    "input_tokens": "sum(input_tokens)",
    "output_tokens": "sum(output_tokens)",
}


def with_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """`calls` plus `cost_usd`, an exact decimal so that sums do not depend on their order.

    `prices` (model, input_price, output_price) is one row per model; a model without a price
    takes the default.
    """

    def part(tokens: str, price: str, default: int) -> str:
        return (
            f"CAST({tokens} AS DECIMAL(18,0)) "
            f"* CAST(coalesce({price}, {default}) AS DECIMAL(12,6)) * 0.000001BD"
        )

    cost = (
        part("input_tokens", "input_price", DEFAULT_INPUT_PRICE)
        + " + "
        + part("output_tokens", "output_price", DEFAULT_OUTPUT_PRICE)
    )
    return calls.join(prices, "model", "left").selectExpr(
        *[f"`{c}`" for c in calls.columns], f"CAST({cost} AS DECIMAL(38,12)) AS cost_usd"
    )


def _totals(*more: str) -> list:
    exprs = [f"{e} AS {n}" for n, e in _COUNTS.items()]
    return [F.expr(e) for e in [*exprs, "CAST(round(sum(cost_usd), 6) AS DOUBLE) AS cost_usd", *more]]


def summary(costed: DataFrame) -> DataFrame:
    """One row over all calls."""
    return costed.agg(
        *_totals(
            "sum(input_tokens + output_tokens) AS total_tokens",
            "sum(duration_ms) AS duration_ms",
        )
    )


def by_job(costed: DataFrame) -> DataFrame:
    """One row per job with calls."""
    return costed.where("job_id IS NOT NULL").groupBy("job_id").agg(
        *_totals("sum(duration_ms) AS duration_ms")
    )


def by_label(costed: DataFrame) -> DataFrame:
    """One row per label, the method standing in for a missing one; dearest first."""
    labelled = costed.withColumn(
        "label", F.expr("coalesce(nullif(label, ''), nullif(method, ''), 'unknown')")
    )
    return (
        labelled.groupBy("label")
        .agg(*_totals("count_if(coalesce(error, '') <> '') AS errors"))
        .orderBy(F.desc("cost_usd"), "label")
    )


def recent(calls: DataFrame, n: int = RECENT_CALLS) -> DataFrame:
    """The newest calls; ties by call id, latest first."""
    return calls.orderBy(F.desc("timestamp"), F.desc("call_id")).limit(n)


def list_runs(live: DataFrame, persisted: DataFrame) -> DataFrame:
    """All runs by id, the live record replacing a persisted one, newest first."""
    fields = [c for c in live.columns if c != "job_id"]
    both = live.withColumn("is_live", F.lit(True)).unionByName(
        persisted.withColumn("is_live", F.lit(False))
    )
    record = F.struct("is_live", *fields)
    return (
        both.groupBy("job_id")
        .agg(F.max_by(record, F.struct("is_live", "created_at")).alias("r"))
        .select("job_id", "r.*")
        .orderBy(F.desc("created_at"), "job_id")
    )


def recent_messages(messages: DataFrame, n: int = RECENT_MESSAGES) -> DataFrame:
    """The last `n` messages of every run.

    The limit is applied inside each task before the shuffle, so a run holding most of the
    messages still sends `n` rows per task only.
    """
    rank = "row_number() OVER (PARTITION BY job_id ORDER BY position DESC)"
    return messages.selectExpr("*", f"{rank} AS _newest").where(f"_newest <= {n}").drop("_newest")
