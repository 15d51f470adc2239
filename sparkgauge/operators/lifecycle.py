"""A request's life and a run's phases: statuses, effective times, joins by id, limits, measured window, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import in_order, running_max, running_sum, with_neighbours, with_running

#: The timings of which the latest is the last one reported.
REPORTED = ("queued", "dequeued", "scheduled_at", "resolve_start", "request_start", "request_end", "resolve_end")
#: The scheduler's delays, each the time between two timings.
DELAYS = {
    "queued_time": ("queued", "dequeued"), "resolve_start_delay": ("scheduled_at", "resolve_start"), "resolve_targeted_start_delay": ("targeted_start", "resolve_start"),
    "request_start_delay": ("resolve_start", "request_start"), "request_targeted_start_delay": ("targeted_start", "request_start"), "request_time": ("request_start", "request_end"),
    "resolve_end_delay": ("request_end", "resolve_end"), "resolve_time": ("resolve_start", "resolve_end"), "finalized_delay": ("resolve_end", "finalized"), "processed_delay": ("finalized", "processed"),
}


def terminal_status(status: str = "status", resolve_start: str = "resolve_start") -> Column:
    """The status a request is reported under; null (to be left out) for one that never began or hasn't ended."""
    s = F.col(status)
    return F.when(s == "completed", "successful").when(s == "errored", "errored").when((s == "cancelled") & F.col(resolve_start).isNotNull(), "incomplete")


def set_or(a: str, b: str) -> Column:
    """a unless it is null or zero, else b."""
    return F.coalesce(F.nullif(F.col(a), F.lit(0)), F.col(b))


def started_at() -> Column:
    return set_or("request_start", "resolve_start")


def completed_at() -> Column:
    return set_or("request_end", "resolve_end")


def last_reported() -> Column:
    return F.greatest(*REPORTED)


def time_to_first_output_token_ms(first: str = "first_output_token", start: str = "request_start") -> Column:
    """Milliseconds to the first token of content, which is the first token where there is no reasoning."""
    return 1000 * (F.col(first) - F.col(start))


def delay_means(r: DataFrame, keys: list[str]) -> DataFrame:
    """The mean of each delay over the rows that have both timings; -1 where there is none, or where it is zero."""
    return r.groupBy(*keys).agg(*(F.coalesce(F.nullif(F.avg(F.col(b) - F.col(a)), F.lit(0.0)), F.lit(-1.0)).alias(n) for n, (a, b) in DELAYS.items()))


def join_by_id(requests: DataFrame, responses: DataFrame, infos: DataFrame, key: str = "request_id") -> DataFrame:
    """Requests with response and info; an id that one of them lacks ends the query with an error."""
    seen = [t.select(key, F.lit(True).alias(f"_{k}")) for k, t in enumerate((requests, responses, infos))]
    all_ = seen[0].join(seen[1], key, "full").join(seen[2], key, "full")
    bad = all_.where(F.coalesce(F.col("_0") & F.col("_1") & F.col("_2"), F.lit(False)) == F.lit(False)).limit(1)
    if bad.head(1):
        raise ValueError(f"ids don't match: {bad.head(1)[0][0]}")
    return requests.join(responses, key).join(infos, key)


def status_times(events: DataFrame, statuses: tuple[str, ...], key: str = "request_id") -> DataFrame:
    """One row a request: when each status was first reported (null if never) and the status reported last."""
    order = F.struct("t", F.array_position(F.array(*map(F.lit, statuses)), F.col("status")))
    return events.groupBy(key).agg(*(F.min(F.when(F.col("status") == s, F.col("t"))).alias(s) for s in statuses), F.max_by("status", order).alias("status"))


#: For each mode of a phase whether it goes by seconds, by requests, and which of the two it keeps if it has both.
PHASE_MODES = {"duration": ("seconds",), "requests": ("requests",), "both": ("seconds", "requests"), "prefer_duration": ("seconds", "requests"), "prefer_requests": ("seconds", "requests")}
PREFERRED = {"prefer_duration": "seconds", "prefer_requests": "requests"}


def phase_limits(percent: float | None, value: float | None, mode: str, most_requests: float | None, most_seconds: float | None, one: bool = True) -> tuple[float | None, int | None]:
    """(seconds, requests) that a warm-up or cool-down takes.

    A percentage wins over a value and needs the run's limit of that kind, as a value does; mode is one of
    PHASE_MODES, and a preferred kind, where there is one and `one` is asked for, stands alone.
    """
    most = {k: m for k, m in {"seconds": most_seconds, "requests": most_requests}.items() if k in PHASE_MODES[mode] and m is not None}
    sizes = {k: (percent * m if percent is not None else value) for k, m in most.items() if (percent, value) != (None, None)}
    if one and PREFERRED.get(mode) in sizes:
        sizes = {PREFERRED[mode]: sizes[PREFERRED[mode]]}
    return tuple(kind(sizes[k]) if k in sizes else None for k, kind in (("seconds", float), ("requests", int)))


def phase_config(value: float | None) -> dict[str, float | None]:
    """A size below one is a percentage, from one on a number of seconds or requests."""
    return {"percent": value if value is not None and value < 1 else None, "value": value if value is not None and value >= 1 else None}


def measured_window(r: DataFrame, keys: list[str], warmup: tuple[float | None, int | None] = (None, None), cooldown: tuple[float | None, int | None] = (None, None), total: int | None = None, seconds: float | None = None) -> DataFrame:
    """(keys, request_start, measure_start, measure_end, request_end) in microseconds; rows have start_us and end_us.

    Warm-up ends after its seconds and when request n + 1 of the ended ones began, whichever is later;
    cool-down begins before the run's seconds are over by its own, and at the end of the request with n + 1
    left, whichever is earlier. Without the one the measured window begins with the first request, without the
    other it ends with the last.
    """
    x = r.select(*keys, "request_id", "start_us", "end_us")  # no other column moves
    if warmup[1] is not None or cooldown[1] is not None and total is not None:
        x = running_sum(x.withColumn("_one", F.lit(1)), keys, "end_us", {"_done": "_one"}, ties=("request_id",))
    start = F.min("start_us")
    nth = lambda n, c: F.max(F.when(F.col("_done") == n, F.col(c)))
    begins, finishes = [], []
    if warmup[0] is not None:
        begins.append(start + int(warmup[0] * 1e6))
    if warmup[1] is not None:
        begins.append(nth(warmup[1] + 1, "start_us"))
    if cooldown[0] is not None and seconds is not None:
        finishes.append(start + int((seconds - cooldown[0]) * 1e6))
    if cooldown[1] is not None and total is not None:
        finishes.append(nth(total - cooldown[1] - 1, "end_us"))
    end = F.max("end_us")

    def reached(times: list[Column], pick, other: Column) -> Column:
        """Of all times that are set for a phase the latest (earliest), once all are known."""
        if not times:
            return other
        known = times[0].isNotNull() if len(times) == 1 else times[0].isNotNull() & times[1].isNotNull()
        return F.coalesce(F.when(known, times[0] if len(times) == 1 else pick(*times)), other)

    return x.groupBy(*keys).agg(
        start.alias("request_start"), reached(begins, F.greatest, start).alias("measure_start"), reached(finishes, F.least, end).alias("measure_end"), end.alias("request_end")
    )


def durations(w: DataFrame) -> DataFrame:
    """The window's seconds: measured, before it and after it."""
    s = lambda a, b: (F.col(b) - F.col(a)) / 1e6
    return w.withColumns({"duration_s": s("measure_start", "measure_end"), "warmup_s": s("request_start", "measure_start"), "cooldown_s": s("measure_end", "request_end")})


def requests_exhausted(states: DataFrame, total: int) -> DataFrame:
    """States (created, processed) with what a run of `total` requests does: stop queuing, stop processing, requests left."""
    left = F.greatest(F.lit(0), total - F.col("processed"))
    return states.withColumns({"stop_queuing": F.col("created") >= total, "stop_processing": F.col("processed") >= total, "remaining": left.cast("bigint")})


def progress(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, remaining, total, stop_us): of several constraints the least share of requests left, and the earliest stop."""
    share = F.when(F.col("total") > 0, F.col("remaining") / F.col("total"))
    known = parts.withColumn("_s", share)
    best = F.min_by(F.struct("remaining", "total"), F.when(F.col("_s").isNotNull(), F.struct("_s", "name")))
    return known.groupBy(*keys).agg(best.alias("b"), F.min("stop_us").alias("stop_us")).select(*keys, "b.remaining", "b.total", "stop_us")


#: Statuses that end a request.
ENDED = ("completed", "errored", "cancelled")
#: The state of a run after an event: its phase, requests in flight and ended, their sums, and the constraint that has stopped it.
PROGRESS = "run_index long, request_id long, status string, t_us long, phase string, in_flight long, n_successful long, n_errored long, n_incomplete long, area long, latency_us long, output_tokens long, stopped_by string"


def status_events(r: DataFrame) -> DataFrame:
    """(run_index, request_id, t_us, status, started, latency_us, output_tokens): the start and the end of each request."""
    end = F.when(F.col("status") == "successful", "completed").when(F.col("status") == "errored", "errored").otherwise("cancelled")
    both = F.array(F.struct(F.col("start_us").alias("t_us"), F.lit("in_progress").alias("status")), F.struct(F.col("end_us").alias("t_us"), end.alias("status")))
    return r.select("run_index", "request_id", F.explode(both).alias("e"), F.lit(True).alias("started"), "latency_us", "output_tokens").select("run_index", "request_id", "e.*", "started", "latency_us", "output_tokens")


def progress_rows(events: DataFrame, warmup_us: int = 0, active_us: int | None = None, max_errors: int | None = None) -> DataFrame:
    """A row (PROGRESS) for every status event, as streaming.accumulator gives them live; area is requests in flight x microseconds so far."""
    keys, ties = ["run_index"], ("_start", "request_id")
    is_start = F.col("status") == "in_progress"
    ended = F.col("status").isin(*ENDED)
    counts = ended & ((F.col("status") != "cancelled") | F.col("started"))
    one = {"_start": is_start, "_gone": ended & F.col("started"), **{f"_{s}": counts & (F.col("status") == s) for s in ENDED}}
    x = events.withColumns({n: F.when(c, 1).otherwise(0).cast("bigint") for n, c in one.items()} | {"_lat": F.when(counts, F.col("latency_us")).otherwise(0), "_out": F.when(counts, F.col("output_tokens")).otherwise(0)})
    sums = {"created": "_start", "gone": "_gone", "n_successful": "_completed", "n_errored": "_errored", "n_incomplete": "_cancelled", "latency_sum": "_lat", "output_sum": "_out"}
    x = with_running(in_order(x, keys, "t_us", ties), keys, "t_us", sums, ties).withColumn("in_flight", F.col("created") - F.col("gone"))
    x = with_neighbours(x, keys, "t_us", ties, ("in_flight",)).withColumn("_area", F.coalesce(F.col("prev_in_flight") * (F.col("t_us") - F.col("prev_t_us")), F.lit(0)))
    x = with_running(x, keys, "t_us", {"area": "_area"}, ties)
    x = x.join(events.where(is_start).groupBy(*keys).agg(F.min("t_us").alias("_begin")), keys, "left")
    since = F.col("t_us") - F.col("_begin")
    phase = F.when(F.coalesce(since < 0, F.lit(True)), "pending").when(since < warmup_us, "warmup").when(since >= F.lit(active_us), "cooldown").otherwise("active")
    stopped = F.when(F.col("n_errored") >= max_errors, "max_errors") if max_errors is not None else F.lit(None).cast("string")
    x = x.drop("latency_us", "output_tokens").withColumns({"phase": phase, "latency_us": F.col("latency_sum"), "output_tokens": F.col("output_sum"), "stopped_by": stopped})
    return x.select(*(f.split()[0] for f in PROGRESS.split(", ")))


def latest_so_far(r: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """r with `latest`: the largest value up to and including the row."""
    return running_max(r, keys, order, {"latest": value}, ties=("request_id",))
