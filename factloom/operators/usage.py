"""Model-call logs: cost, rollups, turns."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.columns import fresh_input, provider_of, stop_reason
from factloom.operators.grouped import running_total
from factloom.session import small_table

TOKENS = ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")

# --- fixed values: $ per million tokens (input, output, cache write, cache read) ---------------
PRICES = {
    "claude-sonnet-4-5-20250929": (3.00, 15.00, 3.75, 0.30),
    "claude-haiku-4-5-20251001": (1.00, 5.00, 1.25, 0.10),
    "gpt-4o-mini": (0.15, 0.60, 0.15, 0.075),
    "gpt-4.1-mini": (0.40, 1.60, 0.40, 0.10),
    "gpt-4o": (2.50, 10.00, 2.50, 1.25),
    "gpt-5": (0.625, 5.00, 0.625, 0.125),
    "gpt-5-mini": (0.25, 2.00, 0.25, 0.025),
    "gpt-5-nano": (0.05, 0.40, 0.05, 0.005),
}
# --- end of fixed values ----------------------------------------------------------------------


def price_table(spark: SparkSession) -> DataFrame:
    return small_table(
        spark,
        [(model, *rates) for model, rates in PRICES.items()],
        "model string, input double, output double, cache_write double, cache_read double",
    )


def priced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls with their cost in dollars; null where the model has no price."""
    rates = ("input", "output", "cache_write", "cache_read")
    dollars = sum(
        (F.col(tokens) * F.col(rate) for tokens, rate in zip(TOKENS, rates, strict=True)),
        F.lit(0.0),
    )
    joined = calls.join(prices, "model", "left")
    return joined.select(*calls.columns, (dollars / F.lit(1_000_000)).alias("cost"))


def usage_filter(
    calls: DataFrame,
    record_ids: Sequence[str] | None = None,
    run_ids: Sequence[str] | None = None,
    session_ids: Sequence[str] | None = None,
    runtime_ids: Sequence[str] | None = None,
    consumer: str | None = None,
    model: str | None = None,
    since: datetime | str | None = None,
    until: datetime | str | None = None,
) -> DataFrame:
    """Calls under at least one condition; `since` is inclusive and `until` is not."""
    conditions: list[Column] = []
    for column, wanted in (
        ("record_id", record_ids),
        ("run_id", run_ids),
        ("session_id", session_ids),
        ("runtime_id", runtime_ids),
    ):
        if wanted:
            conditions.append(F.col(column).isin(list(wanted)))
    if consumer:
        conditions.append(F.col("consumer") == consumer)
    if model:
        conditions.append(F.col("model") == model)
    if since:
        conditions.append(F.col("created_at") >= F.lit(since).cast("timestamp"))
    if until:
        conditions.append(F.col("created_at") < F.lit(until).cast("timestamp"))
    if not conditions:
        raise ValueError("give at least one condition")
    for condition in conditions:
        calls = calls.filter(condition)
    return calls


def latest_runtime(calls: DataFrame, consumer: str = "extraction") -> DataFrame:
    of_consumer = calls.filter(F.col("consumer") == consumer)
    newest = F.max(F.struct("created_at", "runtime_id"))
    return of_consumer.agg(newest["runtime_id"].alias("runtime_id")).filter(
        F.col("runtime_id").isNotNull()
    )


def _sums() -> list[Column]:
    return [F.sum(t).alias(t) for t in TOKENS]


def usage_summary(calls_with_cost: DataFrame) -> DataFrame:
    """Totals per model and overall (model null, level `total`); unpriced calls add no cost."""
    rolled = calls_with_cost.rollup("model").agg(
        F.grouping("model").alias("g"),
        F.count(F.lit(1)).alias("calls"),
        *_sums(),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"),
        F.count_if(F.col("cost").isNull()).alias("unpriced_calls"),
    )
    return rolled.select(
        F.when(F.col("g") == 1, "total").otherwise("model").alias("level"),
        "model",
        "calls",
        *TOKENS,
        "cost",
        "unpriced_calls",
        (F.col("unpriced_calls") == 0).alias("priced"),
    )


def unpriced_models(calls_with_cost: DataFrame) -> DataFrame:
    return calls_with_cost.filter(F.col("cost").isNull()).select("model").distinct()


def usage_by_record(calls_with_cost: DataFrame) -> DataFrame:
    """Per record, else session: turns, sums, cost, and whether all of its calls have a price."""
    by_record = F.coalesce("record_id", F.lit("")) != ""
    keyed = calls_with_cost.withColumns(
        {
            "key": F.when(by_record, F.col("record_id")).otherwise(F.col("session_id")),
            "kind": F.when(by_record, "record_id").otherwise("session_id"),
        }
    ).filter(F.col("key").isNotNull())
    return keyed.groupBy("key").agg(
        F.max("kind").alias("kind"),
        F.count(F.lit(1)).alias("turns"),
        *_sums(),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"),
        F.bool_and(F.col("cost").isNotNull()).alias("cost_known"),
        F.count_distinct("model").alias("n_models"),
        F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"),
    )


def token_totals(calls: DataFrame) -> DataFrame:
    """Tokens per record and overall (record null)."""
    rolled = calls.filter(F.col("record_id").isNotNull()).rollup("record_id")
    return rolled.agg(
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
    )


def prompt_dedup(calls: DataFrame) -> DataFrame:
    """Distinct prompts by hash with their first use."""
    hashed = calls.select(F.sha2("prompt", 256).alias("prompt_hash"), "prompt", "created_at")
    return hashed.groupBy("prompt_hash").agg(
        F.min("created_at").alias("first_seen"),
        F.min("prompt").alias("prompt"),
        F.count(F.lit(1)).alias("uses"),
    )


def mark_turn_ceiling(calls: DataFrame, capped_runs: DataFrame) -> DataFrame:
    """The last turn of each capped run gets the stop reason `turn_ceiling`."""
    capped = calls.join(capped_runs.select("run_id").distinct(), "run_id", "left_semi")
    last = capped.groupBy("run_id").agg(F.max_by("call_id", "turn_index").alias("call_id"))
    marks = last.select("call_id", F.lit("turn_ceiling").alias("_mark"))
    return (
        calls.join(marks, "call_id", "left")
        .withColumn("stop_reason", F.coalesce("_mark", "stop_reason"))
        .select(*calls.columns)
    )


def turns_per_run(calls: DataFrame) -> DataFrame:
    """Calls in run order with the tokens used so far in the run."""
    return running_total(calls, ["run_id"], "turn_index", ["input_tokens", "output_tokens"])


def normalised_calls(
    raw: DataFrame, prompt_tokens: str = "input_tokens", cached: str = "cache_read_tokens"
) -> DataFrame:
    """Provider, stop reason and fresh input tokens in one vocabulary for all providers."""
    return raw.withColumns(
        {
            "provider": provider_of("model"),
            "stop_reason": stop_reason("finish_reason"),
            "fresh_tokens": F.when(
                provider_of("model") == "openai", fresh_input(prompt_tokens, cached)
            ).otherwise(F.col(prompt_tokens)),
        }
    )
