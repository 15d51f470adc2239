"""Summaries of usage counters: inputs, outputs and both, as values, rates and concurrency, by status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.requests import in_window
from . import distribution as ds
from .clusters import clusters, levels
from .ordered import settle

#: The counters of each kind of content.
MODALITIES = {
    "text": ("text_tokens", "text_words", "text_characters"), "image": ("image_tokens", "image_count", "image_pixels", "image_bytes"),
    "video": ("video_tokens", "video_frames", "video_seconds", "video_bytes"), "audio": ("audio_tokens", "audio_samples", "audio_seconds", "audio_bytes"),
    "tool_call": ("tool_call_count", "tool_call_tokens", "mixed_content_tool_tokens"),
}


def within_windows(r: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Requests that overlap the measured window of their run, with its ends; a request without a start counts by its end.

    Windows are a row a run, settled once and looked up by broadcast: requests stay where they are, however few the runs.
    """
    x = r.join(F.broadcast(settle(windows.select(*keys, "measure_start", "measure_end"))), keys)
    return x.where(in_window(F.col("start_us"), F.col("end_us"), F.col("measure_start"), F.col("measure_end")))


def run_distributions(r: DataFrame, keys: list[str], values: Column, tokens: Column) -> DataFrame:
    """(keys, status, metric, n, mean and percentiles): every distribution of runs' requests, statuses together as `total`.

    r: requests with the ends of their run's window (`within_windows`). values: of each request an array of
    (metric, value, weight), values to six places. tokens: an array of (metric, t, w), what is worked off at which time. The
    rates of requests and the concurrency are those within the window.

    Times of all rates and of the concurrency are merged on one ordered frame, and all summaries are made on another.
    """
    by = [*keys, "status", "metric"]
    long = ds.pdf(r.select(*keys, "status", F.explode(values).alias("p")).select(*keys, "status", "p.*"), by, weight="weight")
    window = r.groupBy(*keys, "status").agg(F.count(F.lit(1)).alias("n"), F.min("measure_start").alias("lo"), F.max("measure_end").alias("hi"))
    rate = ds.event_points(r.select(*keys, "status", F.lit(RATE).alias("metric"), F.col("end_us").alias("t"), F.lit(1.0).alias("w"), "measure_start", "measure_end"), by, "measure_start", "measure_end")
    spent = r.select(*keys, "status", F.explode(tokens).alias("p")).select(*keys, "status", "p.*")
    open_ = ds.span_points(r.withColumn("metric", F.lit(OPEN)), by, "measure_start", "measure_end")
    points = rate.unionByName(spent).unionByName(open_).groupBy(*by, "t").agg(F.sum("w").alias("w"))
    x = settle(clusters(ds.under_total(points, "status"), by, grouped=True))
    timed = ds.rates_of(x.where(F.col("metric") != OPEN))
    # Whole half-microseconds weigh a rate.
    rates = timed.select(*by, F.round(F.col("w") / F.col("duration"), 6).alias("value"), F.round(F.col("duration") * 2e6).cast("bigint").alias("weight"))
    levels = ds.levels_of(x.where(F.col("metric") == OPEN), by).select(*by, F.col("level").alias("value"), F.col("duration_us").alias("weight"))
    parts = ds.with_totals(long, "status", "weight").unionByName(ds.pdf(rates, by, weight="weight")).unionByName(ds.pdf(levels, by, weight="weight"))
    s = ds.summarise(parts, by, whole=1_000_000)
    events = timed.groupBy(*by).agg(F.bround(F.sum("w")).cast("bigint").alias("_events"))
    asked = ds.with_totals(window.select(*keys, "status", "n"), "status", "n").select(*keys, "status", F.lit(OPEN).alias("metric"), F.col("n").alias("_events"))
    return s.join(events.unionByName(asked), by, "left").withColumn("count", F.coalesce("_events", "count")).drop("_events")


#: Names of the two distributions that depend on the window's ends.
RATE, OPEN = "requests_per_second", "request_concurrency"


def some_sides(r: DataFrame, properties: dict[str, tuple[str | None, str | None]]) -> list[tuple[str, str, tuple[str, ...]]]:
    """(metric, side, columns) of the sides that have some value: for each property a column of inputs and one of outputs.

    `total` stands for the samples of both sides, where both have some. One pass over the columns; a row comes to the driver.
    """
    sides = [(m, s, c) for m, pair in properties.items() for s, c in zip(("input", "output"), pair, strict=True) if c]
    names = sorted({c for _, _, c in sides})
    found = r.agg(F.lit(0), *(F.max(F.col(c).isNotNull()) for c in names)).first()
    some = dict(zip(names, found[1:], strict=True))
    own = [(m, s, (c,)) for m, s, c in sides if some[c]]
    both = {m: tuple(c for n, _, (c,) in own if n == m) for m, _, _ in own}
    return own + [(m, "total", columns) for m, columns in both.items() if len(columns) > 1]


def listed(rows: list[Column], kind: str) -> Column:
    return F.array(*rows) if rows else F.array().cast(f"array<{kind}>")


def sided(r: DataFrame, properties: dict[str, tuple[str | None, str | None]]) -> DataFrame:
    """(metric, side, status, value) of requests, a row for each sample of each of `some_sides`."""
    sides = some_sides(r, properties)
    parts = [F.struct(F.lit(m).alias("metric"), F.lit(s).alias("side"), F.col(c).cast("double").alias("value")) for m, s, columns in sides for c in columns]
    return r.select("status", F.explode(listed(parts, "struct<metric:string,side:string,value:double>")).alias("p")).select("p.metric", "p.side", "status", "p.value")


KEYS = ["metric", "side", "status"]


def values(r: DataFrame, properties: dict[str, tuple[str | None, str | None]]) -> DataFrame:
    """Summaries of the values that are there."""
    return ds.summarise(ds.with_totals(ds.pdf(sided(r, properties), KEYS), "status", "weight"), KEYS)


def weighed(r: DataFrame, sides: list) -> tuple[DataFrame, dict[str, str]]:
    """(status, start_us, end_us) of requests with each used column as a weight, a missing value as zero; and the weights' names by column."""
    names = {c: f"w{i}" for i, c in enumerate(sorted({c for _, _, columns in sides for c in columns}))}
    return r.select("status", "start_us", "end_us", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n) for c, n in names.items())), names


def by_side(x: DataFrame, sides: list, columns: list[str], value: str, of) -> DataFrame:
    """(keys, columns, value) of a frame with a weight for each used column: a row for each side, `of` of its columns."""
    rows = [F.struct(F.lit(m).alias("metric"), F.lit(s).alias("side"), of(used).alias(value)) for m, s, used in sides]
    x = x.select("status", *columns, F.explode(listed(rows, f"struct<metric:string,side:string,{value}:double>")).alias("p"))
    return x.select("p.metric", "p.side", "status", *columns, f"p.{value}")


def rates(r: DataFrame, properties: dict[str, tuple[str | None, str | None]], **options) -> DataFrame:
    """(keys, t, duration, w): what ends at each time; a missing value counts as zero.

    All sides are at the same times, so these are merged once for a status, with a weight for each column.
    """
    sides = some_sides(r, properties)
    x, names = weighed(r if sides else r.where("false"), sides)
    weights = tuple(names.values()) or ("w",)
    p = (x if names else x.withColumn("w", F.lit(0.0))).groupBy("status", F.col("end_us").alias("t")).agg(*(F.sum(w).alias(w) for w in weights))
    x = ds.rate_points(ds.under_total(p, "status"), ["status"], weights=weights, grouped=True, **options)
    return by_side(x, sides, ["t", "duration"], "w", lambda used: sum((F.col(names[c]) for c in used[1:]), F.col(names[used[0]])))


def concurrency(r: DataFrame, properties: dict[str, tuple[str | None, str | None]], threshold: int = 100, **window) -> DataFrame:
    """(keys, t, duration_us, level): how much of the values is being worked on; a missing value counts as zero.

    All sides are at the same times, so these are merged once for a status, with a level for each column.
    """
    sides = some_sides(r, properties)
    x, names = weighed(r if sides else r.where("false"), sides)
    weights = tuple(names.values()) or ("w",)
    p = ds.under_total(ds.span_points(x, ["status"], weights=tuple(names.values()), **window), "status")
    x = clusters(p, ["status"], threshold, weights, True).where("next_t is not null").withColumn("duration_us", F.col("next_t") - F.col("t"))
    name = dict(zip(names, levels(weights), strict=True)) if names else {}
    level = lambda used: F.greatest(F.lit(0.0), sum((F.col(name[c]) for c in used[1:]), F.col(name[used[0]])))
    return by_side(x, sides, ["t", "duration_us"], "level", level)
