"""Weighted distributions of values, event rates and concurrency.

Inputs are long frames: keys, and value + weight, or time, or start + end. Everything is grouped first,
so what is ordered afterwards is one row for each distinct value or time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .clusters import clusters
from .ordered import in_order, running_sum, with_running

#: Names and ranks of the percentiles.
PERCENTILES = {"p001": 0.001, "p01": 0.01, "p05": 0.05, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}
TINY = 1e-6


def pdf(df: DataFrame, keys: list[str], value: str = "value", weight: str | None = None) -> DataFrame:
    """(keys, value, weight): equal values merged, weights that aren't positive dropped."""
    w = F.sum(weight) if weight else F.count(F.lit(1))
    return df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(w.alias("weight")).where("weight > 0")


def with_totals(sums: DataFrame, key: str, *values: str, name: str = "total") -> DataFrame:
    """Aggregated rows with those of all of `key` together, from the aggregate."""
    others = [c for c in sums.columns if c != key and c not in values]
    return sums.unionByName(sums.groupBy(*others).agg(*(F.sum(v).alias(v) for v in values)).withColumn(key, F.lit(name)))


def under_total(df: DataFrame, *keys: str, name: str = "total") -> DataFrame:
    """Each row also under the total of each of the keys; nothing is summed up, and no row moves."""
    for k in keys:
        df = df.withColumn(k, F.explode(F.array(k, F.lit(name))))
    return df


def pdf_sample(df: DataFrame, keys: list[str], points: int) -> DataFrame:
    """`points` rows of a pdf at evenly spaced ranks, first and last included."""
    x = running_sum(df.withColumn("_one", F.lit(1).cast("bigint")), keys, "value", {"_i": "_one"})
    x = x.join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys).withColumn("_i", F.col("_i") - 1)
    chosen = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / max(1, points - 1)))
    return x.where((F.col("_n") <= points) | F.array_contains(chosen, F.col("_i").cast("bigint"))).drop("_i", "_n", "_one")


def summarise(merged: DataFrame, keys: list[str], whole: int | None = None) -> DataFrame:
    """Summary of a pdf: count, mean, population variance, mode, min, max, total and percentiles (no interpolation).

    whole: values are multiples of 1 / whole and weights whole numbers; their sum is then exact and the mean one division,
    so it doesn't depend on the order of the rows.

    count: rounded half to even; mode: of ties the least; the percentile q is the first value at which the
    running weight reaches q x all. Where all weights together are below 1e-6 every value weighs the same.
    """
    merged = in_order(merged, keys, "value")
    total = F.sum(F.col("value") * F.col("weight")) if whole is None else F.sum(F.round(F.col("value") * whole).cast("decimal(20,0)") * F.col("weight").cast("decimal(18,0)")).cast("double")
    total = merged.groupBy(*keys).agg(F.sum("weight").alias("_w"), F.count(F.lit(1)).alias("_c"), total.alias("_v"), F.avg("value").alias("_m"))
    tiny = F.col("_w") <= TINY
    stats = total.select(*keys, F.col("_w").alias("_raw"), tiny.alias("_tiny"), F.when(tiny, F.col("_c")).otherwise(F.col("_w")).alias("_tot"), F.when(tiny, F.col("_m")).otherwise(F.col("_v") / (F.col("_w") * (whole or 1))).alias("mean"))
    x = with_running(merged.withColumn("_even", F.lit(1.0)), keys, "value", {"_cw": "weight", "_ce": "_even"}).join(stats, keys)
    x = x.withColumns({"weight": F.when(F.col("_tiny"), F.lit(1.0)).otherwise(F.col("weight")), "cum": F.when(F.col("_tiny"), F.col("_ce")).otherwise(F.col("_cw"))})
    at = [F.min(F.when(F.col("cum") >= q * F.col("_tot"), F.col("value"))).alias(n) for n, q in PERCENTILES.items()]
    d = F.col("value") - F.col("mean")
    return x.groupBy(*keys).agg(
        F.bround(F.first("_raw")).cast("bigint").alias("count"), F.first("mean").alias("mean"), (F.sum(d * d * F.col("weight")) / F.first("_tot")).alias("variance"),
        F.max_by("value", F.struct("weight", -F.col("value"))).alias("mode"), F.min("value").alias("min"), F.max("value").alias("max"), *at,
    ).withColumn("total_sum", F.col("mean") * F.col("count"))


def value_summary(df: DataFrame, keys: list[str], value: str = "value", weight: str | None = None) -> DataFrame:
    return summarise(pdf(df, keys, value, weight), keys)


def with_empty(summary: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """A row of zeros for each key of grid without a summary."""
    return grid.join(summary, keys, "left").fillna(0)


def merge_times(points: DataFrame, keys: list[str], threshold: int = 100) -> DataFrame:
    """(keys, t, w): each time joins the first time of its cluster, which takes all within threshold after it."""
    return clusters(points, keys, threshold).select(*keys, "t", "w")


def event_points(points: DataFrame, keys: list[str], start: int | str | None = None, end: int | str | None = None, weights: tuple[str, ...] = ("w",)) -> DataFrame:
    """Points (keys, t, weights) within a window, with one of no weight at each end of it for every key.

    The ends are numbers, or names of columns of points that have one value for each key.
    """
    lo, hi = (F.col(x) if isinstance(x, str) else F.lit(x).cast("bigint") for x in (start, end))
    p = points.select(*keys, "t", *(F.col(w).cast("double").alias(w) for w in weights), lo.alias("_lo"), hi.alias("_hi"))
    inside = p.where(F.coalesce(F.col("t") >= F.col("_lo"), F.lit(True)) & F.coalesce(F.col("t") <= F.col("_hi"), F.lit(True))).drop("_lo", "_hi")
    if start is None and end is None:
        return inside
    ends = p.groupBy(*keys).agg(F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    return inside.unionByName(ends.select(*keys, F.explode(F.array("_lo", "_hi")).alias("t"), *(F.lit(0.0).alias(w) for w in weights)).where("t is not null"))


def rate_points(points: DataFrame, keys: list[str], threshold: int = 100, start: int | str | None = None, end: int | str | None = None, weights: tuple[str, ...] = ("w",), grouped: bool = False) -> DataFrame:
    """(keys, t, weights, duration): events at merged times and the seconds each stands for, half-way to its neighbours."""
    return rates_of(clusters(event_points(points, keys, start, end, weights), keys, threshold, weights, grouped)).select(*keys, "t", *weights, "duration")


def rates_of(x: DataFrame) -> DataFrame:
    """Clusters with the seconds that each stands for; the only one of a key stands for none."""
    half = (F.coalesce("next_t", "t") - F.coalesce("prev_t", "t")) / 2e6
    alone = F.col("next_t").isNull() & F.col("prev_t").isNull()
    return x.where(~alone).withColumn("duration", F.when(F.col("next_t").isNull(), F.greatest(half, F.lit(TINY))).otherwise(half)).drop("next_t", "prev_t")


def rate_summary(points: DataFrame, keys: list[str], **options) -> DataFrame:
    """Events a second, weighted by time; count is the number of events."""
    p = rate_points(points, keys, **options)
    events = p.groupBy(*keys).agg(F.bround(F.sum("w")).cast("bigint").alias("_events"))
    s = value_summary(p.withColumn("value", F.col("w") / F.col("duration")), keys, "value", "duration")
    return s.join(events, keys).withColumn("count", F.col("_events")).drop("_events")


def span_points(spans: DataFrame, keys: list[str], start: int | str | None = None, end: int | str | None = None, weights: tuple[str, ...] = ()) -> DataFrame:
    """(keys, t, weights): what begins and, negative, what ends at each time, of spans that overlap a window; its ends as in event_points.

    Without weights each span counts as one, as w.
    """
    lo, hi = (F.col(x) if isinstance(x, str) else F.lit(x).cast("bigint") for x in (start, end))
    names = weights or ("w",)
    s = spans.select(*keys, "start_us", "end_us", *((F.col(n) if weights else F.lit(1)).cast("double").alias(f"_v_{n}") for n in names), lo.alias("_lo"), hi.alias("_hi"))
    s = s.where(F.coalesce(F.col("end_us") >= F.col("_lo"), F.lit(True)) & F.coalesce(F.col("start_us") <= F.col("_hi"), F.lit(True)))
    point = lambda t, w: F.struct(t.alias("t"), *(w(F.col(f"_v_{n}")).alias(n) for n in names))
    deltas = [point(F.greatest("start_us", "_lo"), lambda v: v), point(F.col("end_us"), lambda v: -v)]
    if end is not None:
        deltas.append(point(F.col("_hi"), lambda v: F.lit(0.0)))
    p = s.select(*keys, "_hi", F.explode(F.array(*deltas)).alias("d")).where(F.col("d.t").isNotNull() & F.coalesce(F.col("d.t") <= F.col("_hi"), F.lit(True)))
    return p.groupBy(*keys, F.col("d.t").alias("t")).agg(*(F.sum(f"d.{n}").alias(n) for n in names))


def levels_of(x: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t, level, duration_us) of clusters: the level holds from each time to the next."""
    return x.where("next_t is not null").select(*keys, "t", F.greatest(F.lit(0.0), F.col("level")).alias("level"), (F.col("next_t") - F.col("t")).alias("duration_us"))


def concurrency_levels(spans: DataFrame, keys: list[str], threshold: int = 100, start: int | str | None = None, end: int | str | None = None) -> DataFrame:
    """(keys, t, level, duration_us): how many intervals are open from each time to the next."""
    return levels_of(clusters(span_points(spans, keys, start, end), keys, threshold), keys).withColumn("level", F.col("level").cast("bigint"))


def concurrency_summary(spans: DataFrame, keys: list[str], **options) -> DataFrame:
    lo, hi = options.get("start"), options.get("end")
    kept = spans if lo is None else spans.where(F.col("end_us") >= lo)
    kept = kept if hi is None else kept.where(F.col("start_us") <= hi)
    n = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    s = value_summary(concurrency_levels(spans, keys, **options), keys, "level", "duration_us")
    return s.join(n, keys).withColumn("count", F.col("_n")).drop("_n")


def histogram(df: DataFrame, value: str, width: float | None = None, bins: int = 10) -> DataFrame:
    """(bucket_start, n) of the buckets that hold something; the range is 1 + max - min."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    w = F.lit(width) if width else (1 + F.col("_hi") - F.col("_lo")) / bins
    n = bins if not width else F.ceil((1 + F.col("_hi") - F.col("_lo")) / width)
    x = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).withColumn("_w", w)
    at = F.least(F.floor((F.col(value) - F.col("_lo")) / F.col("_w")), F.lit(n) - 1 if not width else n - 1)
    return x.groupBy((F.col("_lo") + at * F.col("_w")).alias("bucket_start")).agg(F.count(F.lit(1)).alias("n"))


def reservoir(df: DataFrame, keys: list[str], size: int, seed: int = 0, payload: tuple[str, ...] = ()) -> DataFrame:
    """Marks `size` rows of each key as sampled, by a seeded hash of request_id; clears the payload of all others."""
    h = F.md5(F.concat(F.col("request_id").cast("string"), F.lit(f":{seed}")).cast("binary"))
    top = df.select(*keys, "request_id", h.alias("_h")).withColumn("_b", F.substring("_h", 1, 2))
    first = top.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_h"))).where(F.col("_k") <= size)
    chosen = first.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))).where(F.col("_k") <= size)
    out = df.join(chosen.select("request_id", *keys, F.lit(True).alias("sampled")), ["request_id", *keys], "left").withColumn("sampled", F.coalesce("sampled", F.lit(False)))
    return out.withColumns({c: F.when(F.col("sampled"), F.col(c)) for c in payload})


def mean_or(x: str, other: float = -1.0):
    """Mean, or `other` where it is null or zero."""
    return F.coalesce(F.nullif(F.avg(x), F.lit(0.0)), F.lit(other))
