"""Request telemetry: the fact table and its per-request metrics, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATUSES = ("successful", "errored", "incomplete")


def derive_requests(events: DataFrame) -> DataFrame:
    """Request telemetry from the event table; times are whole microseconds."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    k = F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.lit(0))
    e = events.select(
        F.col("event_id").alias("request_id"),
        F.col("user_id").alias("conversation_id"),
        (F.col("user_id") % 5).alias("run_index"),
        F.when(F.col("event_type") == "error", "errored").when(F.col("event_type") == "signup", "incomplete").otherwise("successful").alias("status"),
        us.alias("start_us"),
        F.round(F.col("value") * 10000000).cast("bigint").alias("latency_us"),
        k.alias("k"),
    )
    return e.withColumns({
        "end_us": F.col("start_us") + F.col("latency_us"),
        "first_token_us": F.col("start_us") + F.expr("latency_us div 4"),
        "last_token_us": F.col("start_us") + F.col("latency_us") - F.expr("latency_us div 20"),
        "prompt_tokens": 16 + F.col("k"),
        "output_tokens": 1 + F.col("k") % 64,
        "token_iterations": 1 + F.col("k") % 8,
    })


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_requests(spark.read.parquet(f"{sf_dir}/events.parquet"))


def ms(us: Column) -> Column:
    return us / 1000.0


def request_start(start="start_us", resolve="resolve_start_us") -> Column:
    """Request start, else when resolving began."""
    return F.coalesce(F.col(start), F.col(resolve))


def request_end(end="end_us", resolve="resolve_end_us") -> Column:
    """Request end, else the resolve end, which every request must have."""
    return F.when(F.col(resolve).isNull(), F.raise_error(F.lit("a request without a resolve end"))).otherwise(F.coalesce(F.col(end), F.col(resolve)))


def output_tokens(usage="output_tokens", iterations="token_iterations") -> Column:
    """Reported tokens, else iterations; none rather than zero."""
    return F.coalesce(F.col(usage), F.nullif(F.col(iterations), F.lit(0)))


def total_tokens(a="prompt_tokens", b="output_tokens") -> Column:
    """Null only where both are."""
    return F.when(F.col(a).isNull() & F.col(b).isNull(), None).otherwise(F.coalesce(F.col(a), F.lit(0)) + F.coalesce(F.col(b), F.lit(0)))


def time_to_first_token_ms() -> Column:
    return ms(F.col("first_token_us") - F.col("start_us"))


def time_per_output_token_ms() -> Column:
    return ms(F.coalesce("last_token_us", "end_us") - F.col("start_us")) / F.nullif(F.col("output_tokens"), F.lit(0))


def inter_token_latency_ms() -> Column:
    return F.when(F.col("output_tokens") > 1, ms(F.col("last_token_us") - F.col("first_token_us")) / (F.col("output_tokens") - 1))


def tokens_per_second(tokens: str) -> Column:
    return F.col(tokens) / (F.nullif(F.col("latency_us"), F.lit(0)) / 1e6)


def tokens_per_iteration() -> Column:
    return F.when(F.col("token_iterations") >= 1, F.col("output_tokens") / F.col("token_iterations"))


def iteration_tokens() -> Column:
    """Tokens of each iteration after the first; null where tokens or iterations are one or fewer."""
    return F.when((F.col("output_tokens") > 1) & (F.col("token_iterations") > 1), (F.col("output_tokens") - 1) / (F.col("token_iterations") - 1))


def with_metrics(r: DataFrame) -> DataFrame:
    return r.withColumn("total_tokens", total_tokens()).withColumns({
        "request_latency_s": F.col("latency_us") / 1e6,
        "ttft_ms": time_to_first_token_ms(),
        "tpot_ms": time_per_output_token_ms(),
        "itl_ms": inter_token_latency_ms(),
        "tokens_per_second": tokens_per_second("total_tokens"),
        "output_tokens_per_second": tokens_per_second("output_tokens"),
        "output_tokens_per_iteration": tokens_per_iteration(),
        "iter_tokens_per_iteration": iteration_tokens(),
    })


def prompt_points() -> Column:
    """One point, at the first token or else the end, weighing the prompt's tokens."""
    return F.array(F.struct(F.coalesce("first_token_us", "end_us").alias("t"), F.coalesce(F.col("prompt_tokens"), F.lit(0)).cast("double").alias("w")))


def iteration_points() -> Column:
    """Points spread evenly from first to last token, without the first."""
    n = F.col("token_iterations") - 1
    at = lambda i: F.col("first_token_us") + F.floor((F.col("last_token_us") - F.col("first_token_us")) * i / n)
    points = F.transform(F.sequence(F.lit(1).cast("bigint"), n), lambda i: F.struct(at(i).cast("bigint").alias("t"), iteration_tokens().alias("w")))
    return F.when(iteration_tokens().isNotNull(), points).otherwise(F.array().cast("array<struct<t:bigint,w:double>>"))


def output_points() -> Column:
    """One point where there is one iteration, else the first token and the iterations' points."""
    one = F.array(F.struct(F.coalesce("last_token_us", "end_us").alias("t"), F.coalesce(F.col("output_tokens"), F.lit(0)).cast("double").alias("w")))
    first = F.array(F.struct(F.col("first_token_us").alias("t"), F.when(F.col("output_tokens") > 0, 1.0).otherwise(0.0).alias("w")))
    return F.when(F.coalesce(F.col("token_iterations"), F.lit(0)) <= 1, one).otherwise(F.concat(first, iteration_points()))


def in_window(start: Column | None, end: Column | None, lo: int | Column | None, hi: int | Column | None) -> Column:
    """Overlap with the measured window, not containment; a request without a start counts by its end."""
    keep = F.lit(True)
    if lo is not None:
        keep = keep & (end >= lo)
    if hi is not None:
        keep = keep & F.coalesce(start <= hi, end <= hi)
    return keep


def with_total(df: DataFrame) -> DataFrame:
    """Every row also under the status 'total'."""
    return df.withColumn("status", F.explode(F.array("status", F.lit("total"))))
