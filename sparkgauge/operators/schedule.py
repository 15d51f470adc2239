"""Arrival schedules: when each request of a load would start."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ordered import running_sum


def indices(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n + 1).withColumnRenamed("id", "i")


def constant(spark: SparkSession, n: int, rate: float, ramp: float = 0.0) -> DataFrame:
    """(i, offset_s) at a constant rate, after a linear ramp-up of `ramp` seconds."""
    i, part = F.col("i"), rate * ramp / 2
    at = i / rate
    if ramp:
        at = F.when(i == 1, 0.0).when(i <= part, F.sqrt(2 * i * ramp / rate)).otherwise(ramp + (i - part) / rate)
    return indices(spark, n).withColumn("offset_s", at)


def throughput(spark: SparkSession, n: int, ramp: float = 0.0, cap: int | None = None) -> DataFrame:
    """All at once, or over the ramp up to the cap."""
    at = ramp * F.least(F.lit(1.0), F.col("i") / cap) if ramp and cap else F.lit(0.0)
    return indices(spark, n).withColumn("offset_s", at)


def concurrent(spark: SparkSession, streams: int, ramp: float = 0.0) -> DataFrame:
    """First request of each stream; what follows starts as its predecessor ends (see synchronous, keyed by stream)."""
    return indices(spark, streams).withColumn("offset_s", F.when(F.col("i") < streams, ramp * F.col("i") / streams).otherwise(F.lit(ramp)) if ramp else F.lit(0.0))


def poisson(spark: SparkSession, n: int, rate: float, seed: int = 0) -> DataFrame:
    """Exponential gaps; the draw of a request depends on seed and index alone."""
    u = (F.pmod(F.xxhash64("i", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    x = indices(spark, n).withColumn("gap", -F.log(1 - u) / rate)
    return running_sum(x.withColumn("_k", F.lit(0)), ["_k"], "i", {"offset_s": "gap"}).select("i", "offset_s")


def synchronous(r: DataFrame, keys: list[str]) -> DataFrame:
    """Each request starts when the one before it in its key has ended."""
    x = running_sum(r, keys, "start_us", {"_sum": "latency_us"}, ties=("request_id",))
    return x.withColumn("offset_s", (F.col("_sum") - F.col("latency_us")) / 1e6).drop("_sum")


def relative(trace: DataFrame, t: str, keys: list[str]) -> DataFrame:
    """Seconds since the first row of the conversation."""
    if keys:
        return trace.withColumn("rel_s", (F.col(t) - F.min(t).over(Window.partitionBy(*keys))) / 1e6)
    return trace.crossJoin(F.broadcast(trace.agg(F.min(t).alias("_t0")))).withColumn("rel_s", (F.col(t) - F.col("_t0")) / 1e6).drop("_t0")


def replay(trace: DataFrame, start: float = 0.0, scale: float = 1.0) -> DataFrame:
    return trace.withColumn("target_s", start + F.coalesce(scale * F.col("rel_s"), F.lit(0.0)))


def sweep(spark: SparkSession, slowest: float, fastest: float, size: int) -> DataFrame:
    """(k, rate): the synchronous and the throughput run first, then even steps between them."""
    k = F.col("k")
    step = (fastest - slowest) / max(1, size - 2)
    return spark.range(size).withColumnRenamed("id", "k").withColumn("rate", F.when(k == 0, slowest).when(k == 1, fastest).otherwise(slowest + step * (k - 1)))


def profile(spark: SparkSession, kind: str, rates: list[float] | None = None) -> DataFrame:
    """(k, strategy, rate): a strategy for each rate or number of streams; kinds that run once have one without a rate.

    Lists go with constant, poisson and concurrent; synchronous, throughput and replay run once.
    """
    once = ("synchronous", "throughput", "replay")
    if kind in once:
        if rates and len(rates) > 1:
            raise ValueError(f"{kind} takes one rate at most")
        return spark.createDataFrame([(0, kind, float(rates[0]) if rates else None)], "k long, strategy string, rate double")
    if kind not in ("constant", "poisson", "concurrent"):
        raise ValueError(f"no profile is known as {kind!r}")
    if not rates or min(rates) <= 0:
        raise ValueError("rates above zero are needed")
    return spark.createDataFrame([(k, kind, float(x)) for k, x in enumerate(rates)], "k long, strategy string, rate double")


def escalated(runs: DataFrame, order: str, stopped: str) -> DataFrame:
    """The runs up to the first that a constraint for all rates has stopped."""
    last = runs.where(stopped).agg(F.min(order).alias("_last"))
    return runs.crossJoin(F.broadcast(last)).where(F.col("_last").isNull() | (F.col(order) <= F.col("_last"))).drop("_last")


def streams(r: DataFrame, n: int, keys: list[str], ramp: float = 0.0) -> DataFrame:
    """r with stream and offset_s of a closed loop: requests are dealt to n streams in turn, each begins as the one before it in its stream ends.

    The first of each stream begin one after the other over `ramp` seconds.
    """
    x = running_sum(r.withColumn("_one", F.lit(1)), keys, "start_us", {"_place": "_one"}, ties=("request_id",))
    x = x.withColumn("stream", ((F.col("_place") - 1) % n).cast("int"))
    x = running_sum(x, [*keys, "stream"], "start_us", {"_sum": "latency_us"}, ties=("request_id",))
    return x.withColumn("offset_s", ramp * F.col("stream") / n + (F.col("_sum") - F.col("latency_us")) / 1e6).drop("_one", "_place", "_sum")
