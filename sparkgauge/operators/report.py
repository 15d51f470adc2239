"""Report tables: points of runs, wide statistics, service-level checks, monotone interpolation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import requests as rq
from . import distribution as ds

STATS = ("mean", "median", "std")


def points(r: DataFrame) -> DataFrame:
    """One row a run: rates and concurrency over all requests, latency over successful ones."""
    span = (F.max("end_us") - F.min("start_us")) / 1e6
    all_ = r.groupBy("run_index").agg((F.count(F.lit(1)) / span).alias("rps"), (F.sum("latency_us") / 1e6 / span).alias("conc"), (F.sum("output_tokens") / span).alias("tps"))
    ok = ds.value_summary(r.where("status = 'successful'").select("run_index", F.col("latency_us").alias("value")), ["run_index"])
    return all_.join(ok, "run_index").select(
        "run_index", F.round("rps", 6).alias("requests_per_second"), F.round("conc", 6).alias("concurrency"), F.round("tps", 6).alias("tokens_per_second"),
        F.round(F.col("p50") / 1e6, 6).alias("latency_p50_s"), F.round(F.col("p95") / 1e6, 6).alias("latency_p95_s"), F.round(F.col("tps") / F.col("conc"), 6).alias("efficiency"),
    )


def peak(p: DataFrame, column: str) -> DataFrame:
    return p.orderBy(F.desc(column), "run_index").limit(1)


def log_scale(p: DataFrame, *columns: str) -> DataFrame:
    """Drops points that a logarithmic axis can't show."""
    for c in columns:
        p = p.where(F.col(c) > 0)
    return p


def slo(p: DataFrame, limits: dict[str, tuple[str, str, float]]) -> DataFrame:
    return p.withColumns({n: (F.col(c) <= v) if op == "<=" else (F.col(c) >= v) for n, (c, op, v) in limits.items()})


def distinct_percentiles(s: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, p, v): of each run of equal percentiles the highest."""
    long = s.unpivot(keys, names, "p", "v")
    nxt = F.lead("v").over(Window.partitionBy(*keys).orderBy("p"))
    return long.withColumn("_n", nxt).where(F.col("_n").isNull() | (F.col("_n") != F.col("v"))).drop("_n")


def wide(r: DataFrame) -> DataFrame:
    """One row a run, with a column for each status and statistic of latency, in a fixed order."""
    s = ds.value_summary(r.select("run_index", "status", F.col("latency_us").alias("value")), ["run_index", "status"])
    s = s.select("run_index", "status", F.round(F.col("mean") / 1e6, 6).alias("mean"), F.round(F.col("p50") / 1e6, 6).alias("median"), F.round(F.sqrt("variance") / 1e6, 4).alias("std"))
    return s.groupBy("run_index").pivot("status", list(rq.STATUSES)).agg(*(F.first(c).alias(c) for c in STATS))


def spline(knots: DataFrame, keys: list[str], at: list[float]) -> DataFrame:
    """(keys, x, y) on a monotone cubic through knots (keys, x, y), at values inside their range.

    Tangents are harmonic means of the neighbouring slopes, zero where these change sign; equal x are an error.
    """
    w = Window.partitionBy(*keys).orderBy("x")
    k = knots.withColumns({"x1": F.lead("x").over(w), "y1": F.lead("y").over(w), "x_": F.lag("x").over(w), "y_": F.lag("y").over(w)})
    k = k.withColumn("x1", F.when(F.col("x1") == F.col("x"), F.raise_error(F.lit("knots with equal x")).cast("double")).otherwise(F.col("x1")))
    k = k.withColumns({"h": F.col("x1") - F.col("x"), "s": (F.col("y1") - F.col("y")) / (F.col("x1") - F.col("x")), "s_": (F.col("y") - F.col("y_")) / (F.col("x") - F.col("x_")), "h_": F.col("x") - F.col("x_")})
    common = F.col("h_") + F.col("h")
    inner = F.when(F.col("s_") * F.col("s") <= 0, 0.0).otherwise(3 * common / ((common + F.col("h")) / F.col("s_") + (common + F.col("h_")) / F.col("s")))
    k = k.withColumn("m", F.when(F.col("s_").isNull(), F.col("s")).when(F.col("s").isNull(), F.col("s_")).otherwise(inner)).withColumn("m1", F.lead("m").over(w))
    x = k.withColumn("at", F.explode(F.array(*map(F.lit, at)))).where((F.col("at") >= F.col("x")) & ((F.col("at") < F.col("x1")) | F.col("x1").isNull() & (F.col("at") == F.col("x"))))
    t = F.coalesce((F.col("at") - F.col("x")) / F.col("h"), F.lit(0.0))
    y = (2 * t**3 - 3 * t**2 + 1) * F.col("y") + (t**3 - 2 * t**2 + t) * F.coalesce("h", F.lit(0.0)) * F.col("m") + (3 * t**2 - 2 * t**3) * F.coalesce("y1", F.lit(0.0)) + (t**3 - t**2) * F.coalesce(F.col("h") * F.col("m1"), F.lit(0.0))
    return x.select(*keys, F.col("at").alias("x"), F.round(y, 6).alias("y"))
