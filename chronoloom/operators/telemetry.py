"""Token cost, ingestion checkpoints and error logs as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Dollars for a million input and output tokens, by lower-case model name.
PRICES = {
    "gpt-4o": (2.50, 10.00),
    "gpt-4o-mini": (0.15, 0.60),
    "gpt-4-turbo": (10.00, 30.00),
    "gpt-3.5-turbo": (0.50, 1.50),
    "o1-preview": (15.00, 60.00),
    "o1-mini": (3.00, 12.00),
    "claude-3-5-sonnet": (3.00, 15.00),
    "claude-3-opus": (15.00, 75.00),
    "claude-3-sonnet": (3.00, 15.00),
    "claude-3-haiku": (0.25, 1.25),
    "gpt-4": (2.50, 10.00),
    "unknown": (0.0, 0.0),
    "meta-llama/llama-3.3-70b-instruct-turbo": (0.88, 0.88),
    "meta-llama/llama-3.2-3b-instruct-turbo": (0.06, 0.06),
    "meta-llama/llama-3.2-11b-vision-instruct-turbo": (0.18, 0.18),
    "meta-llama/llama-3.2-90b-vision-instruct-turbo": (1.20, 1.20),
    "meta-llama/meta-llama-3.1-8b-instruct-turbo": (0.18, 0.18),
    "meta-llama/meta-llama-3.1-70b-instruct-turbo": (0.88, 0.88),
    "meta-llama/meta-llama-3.1-405b-instruct-turbo": (5.00, 15.00),
    "qwen/qwen2.5-7b-instruct-turbo": (0.30, 0.30),
    "qwen/qwen2.5-72b-instruct-turbo": (1.20, 1.20),
    "qwen/qwen2.5-coder-32b-instruct": (0.80, 0.80),
    "mistralai/mixtral-8x7b-instruct-v0.1": (0.60, 0.60),
    "mistralai/mixtral-8x22b-instruct-v0.1": (1.20, 1.20),
    "deepseek-ai/deepseek-v3": (1.25, 1.25),
}
# Price of an unlisted model by the beginning of its name, the first that fits.
PREFIXES = (("gpt-4", "gpt-4o"), ("gpt-3.5", "gpt-3.5-turbo"), ("claude-3-opus", "claude-3-opus"), ("claude-3-sonnet", "claude-3-sonnet"), ("claude-3-haiku", "claude-3-haiku"))

# Ingestion steps in order.
STEPS = ("initial", "prepared", "got_previous_episodes", "created_chunks", "extracted_entities", "deduplicated_entities", "extracted_edges", "resolved_edges", "extracted_attributes", "built_episodic_edges", "performed_graph_update", "updated_communities", "completed")


def price(model: Column, which: int) -> Column:
    """Dollars for a million tokens in (0) or out (1); 0 for a model neither listed nor of a known family."""
    low = F.lower(model)
    table = F.create_map(*[F.lit(x) for name, p in PRICES.items() for x in (name, p[which])])
    family = reduce(lambda rest, p: F.when(low.startswith(p[0]), F.lit(PRICES[p[1]][which])).otherwise(rest), reversed(PREFIXES), F.lit(0.0))
    return F.coalesce(table[low], family)


def cost_usd(model: Column, prompt: Column, completion: Column) -> Column:
    return prompt / 1e6 * price(model, 0) + completion / 1e6 * price(model, 1)


def usage_report(usage: DataFrame, *by: str) -> DataFrame:
    """Calls, tokens and cost by any call dimensions."""
    cost = cost_usd(F.col("model"), F.col("prompt_tokens"), F.col("completion_tokens"))
    return usage.groupBy(*by).agg(F.count("*").alias("calls"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), F.sum(cost).alias("cost_usd"))


def step_index() -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STEPS]), F.col("step")) - 1


def progress() -> Column:
    """'42% (step)', or 'Unknown step'."""
    at = step_index()
    return F.when(at >= 0, F.concat(F.round(at / (len(STEPS) - 1) * 100).cast("int"), F.lit("% ("), "step", F.lit(")"))).otherwise("Unknown step")


def can_retry(now: Column, attempts: int, age_hours: int) -> Column:
    return (F.col("attempt_count") < attempts) & (now <= F.col("created_at") + F.expr(f"interval {age_hours} hours"))


def stalled(points: DataFrame, now: Column, minutes: int) -> DataFrame:
    return points.filter((F.col("step") != "completed") & (F.col("last_updated_at") < now - F.expr(f"interval {minutes} minutes")))


def failed(points: DataFrame, attempts: int) -> DataFrame:
    return points.filter((F.col("step") != "completed") & (F.col("attempt_count") >= attempts))


def checkpoint_statistics(points: DataFrame, now: Column, attempts: int = 3, minutes: int = 30) -> DataFrame:
    """(status, step, n) with the steps' sums: completed, failed, stalled or in progress, in this order of test."""
    status = F.when(F.col("step") == "completed", "completed").when(F.col("attempt_count") >= attempts, "failed").when(F.col("last_updated_at") < now - F.expr(f"interval {minutes} minutes"), "stalled").otherwise("in progress")
    return points.select(status.alias("status"), "step").groupBy("status", "step").agg(F.count("*").alias("n"))


def save_checkpoints(old: DataFrame, new: DataFrame) -> DataFrame:
    """The last state of every episode by ``last_updated_at``."""
    both = old.unionByName(new)
    cols = [c for c in both.columns if c != "episode_id"]
    return both.groupBy("episode_id").agg(F.max_by(F.struct(*cols), F.struct("last_updated_at", "attempt_count")).alias("x")).select("episode_id", *[f"x.{c}" for c in cols])


#: Severity of log levels (fixed).
LEVELS = {"DEBUG": -4, "INFO": 0, "WARN": 4, "ERROR": 8}


def error_log(records: DataFrame, least: str = "ERROR") -> DataFrame:
    """Log records (timestamp, level, message, context map, attributes map, ...) of a level or above as rows of the error table.

    ``ERROR+2`` and the like count by their offset. User, session and request source come from the
    context, blank where it has none; attributes become JSON. Works on streams as on tables.
    """
    base = F.element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), F.regexp_extract("level", "^[A-Z]+", 0))
    offset = F.coalesce(F.regexp_extract("level", "([+-][0-9]+)$", 1).try_cast("int"), F.lit(0))
    of = lambda k: F.coalesce(F.element_at("context", F.lit(k)), F.lit("")).alias(k)
    kept = records.filter(F.coalesce(base + offset >= LEVELS[least], F.lit(False)))
    return kept.select("id", "timestamp", "level", "message", of("user_id"), of("session_id"), of("request_source"), "source_file", "line_number", F.to_json("attributes").alias("attributes"))


def write_errors(records: DataFrame, path: str) -> None:
    """Append errors to the error table, by day."""
    error_log(records).withColumn("day", F.to_date("timestamp")).write.mode("append").partitionBy("day").parquet(path)
