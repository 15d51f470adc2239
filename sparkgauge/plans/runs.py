"""Run queries: request life cycles, measured windows, progress, all distributions, usage summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import requests as rq
from ..operators import constraints, distribution as ds, lifecycle as lc, saturation as sat, summary as sm
from .telemetry import BOUNDS, METRICS, REQUESTS, TOTAL, merged_sql, query_into, r6, rate_columns, rate_sql, summary_sql, t_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = query_into(QUERIES, SQL)

#: Timings around a request's start and end, some of them missing, as column and as SQL expressions.
TIMINGS = {
    "queued": "start_us - 5000", "dequeued": "start_us - 4000 + k % 7", "scheduled_at": "start_us - 3000", "targeted_start": "CASE WHEN k % 3 <> 0 THEN start_us - 2000 END",
    "resolve_start": "CASE WHEN k % 13 <> 0 THEN start_us - 1000 END", "request_start": "CASE WHEN k % 5 <> 0 THEN start_us END", "request_end": "CASE WHEN k % 6 <> 0 THEN end_us END",
    "resolve_end": "end_us + 200", "finalized": "end_us + 900", "processed": "end_us + 1500", "first_output_token": "CASE WHEN k % 9 <> 0 THEN first_token_us + 10 * (k % 4) END",
    "scheduled_status": "CASE status WHEN 'successful' THEN 'completed' WHEN 'errored' THEN 'errored' ELSE 'cancelled' END",
}
LIFE = f"{REQUESTS}, life AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in TIMINGS.items())} FROM requests)"


def life(spark: SparkSession, d: str) -> DataFrame:
    return rq.requests(spark, d).withColumns({n: F.expr(e) for n, e in TIMINGS.items()})


@query(f"WITH {LIFE} SELECT request_id, CASE WHEN scheduled_status = 'completed' THEN 'successful' WHEN scheduled_status = 'errored' THEN 'errored' ELSE 'incomplete' END AS reported FROM life WHERE scheduled_status IN ('completed', 'errored') OR resolve_start IS NOT NULL")
def terminal_statuses(spark: SparkSession, d: str) -> DataFrame:
    return life(spark, d).select("request_id", lc.terminal_status("scheduled_status").alias("reported")).where("reported is not null")


@query(f"""WITH {LIFE} SELECT request_id, coalesce(request_start, resolve_start) AS started_at, coalesce(request_end, resolve_end) AS completed_at,
  greatest(queued, dequeued, scheduled_at, coalesce(resolve_start, 0), coalesce(request_start, 0), coalesce(request_end, 0), resolve_end) AS last_reported, round((first_output_token - request_start) / 1000.0, 6) AS ttfo_ms FROM life""")
def request_times(spark: SparkSession, d: str) -> DataFrame:
    r = life(spark, d)
    return r.select("request_id", lc.started_at().alias("started_at"), lc.completed_at().alias("completed_at"), lc.last_reported().alias("last_reported"), F.round(lc.time_to_first_output_token_ms() / 1e6, 6).alias("ttfo_ms"))


@query(f"WITH {LIFE} SELECT run_index, " + ", ".join(f"round(coalesce(nullif(avg({b} - {a}), 0), -1), 4) AS {n}" for n, (a, b) in lc.DELAYS.items()) + " FROM life GROUP BY run_index")
def scheduler_delays(spark: SparkSession, d: str) -> DataFrame:
    x = lc.delay_means(life(spark, d), ["run_index"])
    return x.select("run_index", *(F.round(n, 4).alias(n) for n in lc.DELAYS))


@query(f"WITH {LIFE} SELECT request_id, prompt_tokens, output_tokens, scheduled_status FROM life")
def joined_by_id(spark: SparkSession, d: str) -> DataFrame:
    r = life(spark, d)
    return lc.join_by_id(r.select("request_id", "prompt_tokens"), r.select("request_id", "output_tokens"), r.select("request_id", "scheduled_status"))


@query(f"""WITH {LIFE} SELECT request_id, queued, dequeued AS pending, request_start AS in_progress, resolve_end AS done, CASE WHEN resolve_end IS NOT NULL THEN 'done' END AS status FROM life""")
def status_times(spark: SparkSession, d: str) -> DataFrame:
    """Reported again later, a status keeps its first time; the last status is that of the latest event."""
    times = {"queued": "queued", "pending": "dequeued", "in_progress": "request_start", "done": "resolve_end"}
    e = life(spark, d).select("request_id", F.explode(F.array(*(F.struct(F.lit(s).alias("status"), F.col(c).alias("t")) for s, c in times.items()))).alias("e")).select("request_id", "e.*")
    again = e.where("status = 'queued'").withColumn("t", F.col("t") + 1)
    return lc.status_times(e.where("t is not null").unionByName(again), tuple(times))


@query(f"""WITH {REQUESTS}, o AS (SELECT *, row_number() OVER (PARTITION BY run_index ORDER BY end_us, request_id) AS done, count(*) OVER (PARTITION BY run_index) AS c FROM requests),
w AS (SELECT run_index, min(start_us) AS request_start, coalesce(greatest(min(start_us) + 3600000000, max(CASE WHEN done = 6 THEN start_us END)), min(start_us)) AS measure_start,
  coalesce(max(CASE WHEN done = 12 THEN end_us END), max(end_us)) AS measure_end, max(end_us) AS request_end, bool_or(done = 6) AS warm FROM o GROUP BY 1)
SELECT run_index, request_start, CASE WHEN warm THEN measure_start ELSE request_start END AS measure_start, measure_end, request_end,
  round((measure_end - CASE WHEN warm THEN measure_start ELSE request_start END) / 1e6, 6) AS duration_s, round((CASE WHEN warm THEN measure_start ELSE request_start END - request_start) / 1e6, 6) AS warmup_s, round((request_end - measure_end) / 1e6, 6) AS cooldown_s FROM w""")
def measured_window(spark: SparkSession, d: str) -> DataFrame:
    """Warm-up of an hour and five requests, whichever takes longer; cool-down over the last two of fifteen."""
    w = lc.measured_window(rq.requests(spark, d), ["run_index"], warmup=(3600.0, 5), cooldown=(None, 2), total=15)
    return r6(lc.durations(w), "duration_s", "warmup_s", "cooldown_s")


@query(f"""WITH {REQUESTS}, o AS (SELECT run_index, request_id, row_number() OVER (PARTITION BY run_index ORDER BY end_us, request_id) AS processed FROM requests)
SELECT request_id, processed >= 30 AS stop_processing, processed + 3 >= 30 AS stop_queuing, greatest(0, 30 - processed) AS remaining FROM o""")
def exhausted_requests(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.ordered import running_sum

    s = running_sum(rq.requests(spark, d).withColumn("_one", F.lit(1)), ["run_index"], "end_us", {"processed": "_one"}, ties=("request_id",)).withColumn("created", F.col("processed") + 3)
    return lc.requests_exhausted(s, 30).select("request_id", "stop_processing", "stop_queuing", "remaining")


PARTS_SQL = """parts AS (SELECT run_index, 'a' AS name, greatest(0, 40 - count(*)) AS remaining, 40 AS total, max(end_us) AS stop_us FROM requests GROUP BY 1
  UNION ALL SELECT run_index, 'b', greatest(0, 30 - count(*) FILTER (status = 'successful')), 30, min(end_us) + 86400000000 FROM requests GROUP BY 1 UNION ALL SELECT run_index, 'c', NULL, NULL, NULL FROM requests GROUP BY 1)"""


@query(f"WITH {REQUESTS}, {PARTS_SQL}, best AS (SELECT run_index, arg_min(struct_pack(r := remaining, t := total), (remaining / total, name)) FILTER (remaining IS NOT NULL) AS b, min(stop_us) AS stop_us FROM parts GROUP BY 1) SELECT run_index, b.r AS remaining, b.t AS total, stop_us FROM best")
def combined_progress(spark: SparkSession, d: str) -> DataFrame:
    r = rq.requests(spark, d).groupBy("run_index").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("status") == "successful", 1)).alias("ok"), F.min("end_us").alias("lo"), F.max("end_us").alias("hi"))
    left = lambda total, n: F.greatest(F.lit(0), total - F.col(n)).cast("bigint").alias("remaining")
    row = lambda name, remaining, total, stop: F.struct(F.lit(name).alias("name"), remaining, F.lit(total).cast("bigint").alias("total"), stop.cast("bigint").alias("stop_us"))
    none = F.lit(None).cast("bigint")
    parts = F.array(row("a", left(40, "n"), 40, F.col("hi")), row("b", left(30, "ok"), 30, F.col("lo") + 86_400_000_000), row("c", none.alias("remaining"), None, none))
    return lc.progress(r.select("run_index", F.explode(parts).alias("p")).select("run_index", "p.*"), ["run_index"])


@query(f"WITH {REQUESTS} SELECT request_id, max(end_us) OVER (PARTITION BY run_index ORDER BY start_us, request_id) AS latest FROM requests")
def latest_update(spark: SparkSession, d: str) -> DataFrame:
    return lc.latest_so_far(rq.requests(spark, d), ["run_index"], "start_us", "end_us").select("request_id", "latest")


#: Value and weight of every distribution of values.
ALL = {
    "request_latency_s": (METRICS["request_latency_s"], "1"), "token_iterations": ("token_iterations", "1"), "prompt_tokens": ("prompt_tokens", "1"), "output_tokens": ("output_tokens", "1"),
    "total_tokens": ("prompt_tokens + output_tokens", "1"), "ttft_ms": (METRICS["ttft_ms"], "1"), "ttfo_ms": ("(first_output_token - request_start) / 1000.0", "1"),
    "tpot_ms": (METRICS["tpot_ms"], "coalesce(output_tokens, 0)"), "itl_ms": (METRICS["itl_ms"], "coalesce(output_tokens, 1) - 1"),
}
ITERATIONS_SQL = """iters AS (SELECT status, 'output_tokens_per_iteration' AS metric, CASE WHEN token_iterations <= 1 THEN CAST(output_tokens AS DOUBLE) ELSE 1.0 END AS value, 1 AS weight FROM life
  UNION ALL SELECT status, m, round((output_tokens - 1) / (token_iterations - 1), 6), token_iterations - 1 FROM life, (VALUES ('output_tokens_per_iteration'), ('iter_tokens_per_iteration')) n(m) WHERE output_tokens > 1 AND token_iterations > 1)"""
ALL_SQL = "vals AS (" + " UNION ALL ".join(f"SELECT status, '{m}' AS metric, round(CAST(coalesce({e}, 0) AS DOUBLE), 6) AS value, CAST({w} AS BIGINT) AS weight FROM life" for m, (e, w) in ALL.items()) + " UNION ALL SELECT * FROM iters)"


@query(f"WITH {LIFE}, {ITERATIONS_SQL}, {ALL_SQL}, both_ AS (SELECT * FROM vals UNION ALL SELECT * REPLACE ('total' AS status) FROM vals), {summary_sql('both_', 'status, metric', whole=1_000_000)} SELECT status, metric, n, exact_mean AS mean, mode, min_value, max_value, p001, p01, p05, p10, p25, p50, p75, p90, p95, p99, p999 FROM summary")
def all_distributions(spark: SparkSession, d: str) -> DataFrame:
    """Every distribution of values in one pass over one long frame; missing values count as zero, some weigh by tokens."""
    r = life(spark, d)
    parts = F.array(*(F.struct(F.lit(m).alias("metric"), F.round(F.coalesce(F.expr(e).cast("double"), F.lit(0.0)), 6).alias("value"), F.expr(w).cast("bigint").alias("weight")) for m, (e, w) in ALL.items()))
    point = lambda m: lambda p: F.struct(F.lit(m).alias("metric"), F.round(p["w"], 6).alias("value"), F.lit(1).cast("bigint").alias("weight"))
    lists = F.concat(parts, F.transform(rq.output_points(), point("output_tokens_per_iteration")), F.transform(rq.iteration_points(), point("iter_tokens_per_iteration")))
    p = ds.with_totals(ds.pdf(r.select("status", F.explode(lists).alias("p")).select("status", "p.*"), ["status", "metric"], weight="weight"), "status", "weight")
    s = ds.summarise(p, ["status", "metric"], whole=1_000_000)
    return s.select("status", "metric", F.col("count").alias("n"), "mean", "mode", F.col("min").alias("min_value"), F.col("max").alias("max_value"), *ds.PERCENTILES)


WINDOWS_SQL = """ends_ AS (SELECT *, row_number() OVER (PARTITION BY run_index ORDER BY end_us, request_id) AS done FROM life),
windows AS (SELECT run_index, coalesce(max(CASE WHEN done = 21 THEN start_us END), min(start_us)) AS lo, least(min(start_us) + 1728000000000, max(end_us)) AS hi FROM ends_ GROUP BY 1),
inside AS (SELECT l.*, lo, hi FROM life l JOIN windows USING (run_index) WHERE end_us >= lo AND start_us <= hi)"""
RUN_VALUES_SQL = "vals AS (" + " UNION ALL ".join(f"SELECT run_index, status, '{m}' AS metric, round(CAST(coalesce({e}, 0) AS DOUBLE), 6) AS value, CAST({w} AS BIGINT) AS weight FROM inside" for m, (e, w) in ALL.items()) + """
  UNION ALL SELECT run_index, status, 'output_tokens_per_iteration', CASE WHEN token_iterations <= 1 THEN CAST(output_tokens AS DOUBLE) ELSE 1.0 END, 1 FROM inside
  UNION ALL SELECT run_index, status, m, round((output_tokens - 1) / (token_iterations - 1), 6), token_iterations - 1 FROM inside, (VALUES ('output_tokens_per_iteration'), ('iter_tokens_per_iteration')) n(m) WHERE output_tokens > 1 AND token_iterations > 1)"""
RUN_POINTS_SQL = """own AS (SELECT run_index, status, 'prompt_tokens_per_second' AS metric, first_token_us AS t, CAST(prompt_tokens AS DOUBLE) AS w FROM inside
  UNION ALL SELECT run_index, status, 'output_tokens_per_second', CASE WHEN token_iterations <= 1 THEN last_token_us ELSE first_token_us END, CASE WHEN token_iterations <= 1 THEN output_tokens ELSE 1.0 END FROM inside
  UNION ALL SELECT run_index, status, 'output_tokens_per_second', first_token_us + CAST(floor((last_token_us - first_token_us) * i / (token_iterations - 1)) AS BIGINT), (output_tokens - 1) / (token_iterations - 1) FROM inside, range(1, 8) x(i) WHERE i < token_iterations AND output_tokens > 1),
pts AS (SELECT * FROM own UNION ALL SELECT * REPLACE ('tokens_per_second' AS metric) FROM own
  UNION ALL SELECT run_index, status, 'requests_per_second', end_us, 1.0 FROM inside WHERE end_us BETWEEN lo AND hi
  UNION ALL SELECT DISTINCT run_index, status, 'requests_per_second', unnest([lo, hi]), 0.0 FROM inside
  UNION ALL SELECT run_index, status, 'request_concurrency', greatest(start_us, lo), 1.0 FROM inside UNION ALL SELECT run_index, status, 'request_concurrency', end_us, -1.0 FROM inside WHERE end_us <= hi
  UNION ALL SELECT DISTINCT run_index, status, 'request_concurrency', hi, 0.0 FROM inside),
src AS (SELECT * FROM pts UNION ALL SELECT * REPLACE ('total' AS status) FROM pts)"""
RUN_LONG_SQL = """lv AS (SELECT run_index, status, metric, greatest(0, sum(w) OVER o) AS value, lead(t) OVER o - t AS weight FROM points WHERE metric = 'request_concurrency' WINDOW o AS (PARTITION BY run_index, status, metric ORDER BY t)),
long AS (SELECT * FROM vals UNION ALL SELECT * REPLACE ('total' AS status) FROM vals
  UNION ALL SELECT run_index, status, metric, round(w / duration, 6), CAST(round(duration * 2e6) AS BIGINT) FROM dur WHERE metric <> 'request_concurrency' UNION ALL SELECT * FROM lv WHERE weight IS NOT NULL),
asked AS (SELECT run_index, status, metric, n FROM evs WHERE metric <> 'request_concurrency' UNION ALL SELECT run_index, status, 'request_concurrency', count(*) FROM (SELECT run_index, status FROM inside UNION ALL SELECT run_index, 'total' FROM inside) GROUP BY 1, 2)"""


@query(f"""WITH RECURSIVE {LIFE}, {WINDOWS_SQL}, {RUN_VALUES_SQL}, {RUN_POINTS_SQL}, {rate_sql('src', 'run_index, status, metric')}, {RUN_LONG_SQL}, {summary_sql('long', 'run_index, status, metric', whole=1_000_000)}
SELECT s.run_index, s.status, s.metric, coalesce(a.n, s.n) AS n, exact_mean AS mean, mode, min_value, max_value, p01, p50, p95, p99 FROM summary s LEFT JOIN asked a USING (run_index, status, metric)""")
def run_distributions(spark: SparkSession, d: str) -> DataFrame:
    """All sixteen distributions of each run over its measured window: after twenty requests, and before twenty days are over."""
    r = life(spark, d)
    keys = ["run_index"]
    windows = lc.measured_window(r, keys, warmup=(None, 20), cooldown=(0.0, None), seconds=1_728_000.0)
    windows = windows.withColumn("measure_end", F.least("measure_end", "request_end"))
    value = lambda m, v, w: F.struct(F.lit(m).alias("metric"), F.round(F.coalesce(v.cast("double"), F.lit(0.0)), 6).alias("value"), w.cast("bigint").alias("weight"))
    each = lambda points, m: F.transform(points, lambda p: value(m, p["w"], F.lit(1)))
    values = F.concat(F.array(*(value(m, F.expr(e), F.expr(w)) for m, (e, w) in ALL.items())), each(rq.output_points(), "output_tokens_per_iteration"), each(rq.iteration_points(), "iter_tokens_per_iteration"))
    at = lambda points, m: F.transform(points, lambda p: F.struct(F.lit(m).alias("metric"), p["t"].alias("t"), p["w"].cast("double").alias("w")))
    both = ((rq.prompt_points(), "prompt_tokens_per_second"), (rq.output_points(), "output_tokens_per_second"))
    tokens = F.concat(*(at(p, m) for p, own in both for m in (own, "tokens_per_second")))
    s = sm.run_distributions(sm.within_windows(r, windows, keys), keys, values, tokens)
    return s.select("run_index", "status", "metric", F.col("count").alias("n"), "mean", "mode", F.col("min").alias("min_value"), F.col("max").alias("max_value"), "p01", "p50", "p95", "p99")


@query(f"WITH {LIFE} SELECT run_index, " + ", ".join(f"round(sum(({e}) * ({w})) / nullif(sum(CASE WHEN ({e}) IS NOT NULL THEN {w} END), 0), 5) AS {m}" for m, (e, w) in ALL.items()) + " FROM life GROUP BY 1")
def metric_accumulators(spark: SparkSession, d: str) -> DataFrame:
    """Running means as sums: of values times their weights, over the weights of the values that are there."""
    r = life(spark, d)
    mean = lambda e, w: F.sum(F.expr(f"({e}) * ({w})")) / F.nullif(F.sum(F.expr(f"CASE WHEN ({e}) IS NOT NULL THEN {w} END")), F.lit(0))
    return r.groupBy("run_index").agg(*(F.round(mean(e, w), 5).alias(m) for m, (e, w) in ALL.items()))


#: Properties with a column of inputs and one of outputs; images have no outputs, tool calls no inputs.
USAGE = {"text_tokens": ("prompt_tokens", "output_tokens"), "text_characters": ("characters", "output_tokens"), "image_pixels": ("pixels", None), "tool_call_count": (None, "calls"), "video_bytes": ("nothing", "nothing")}
USED = {"characters": "CASE WHEN k % 2 = 0 THEN 5 * k END", "pixels": "CASE WHEN k % 4 = 1 THEN 64 * k END", "calls": "CASE WHEN status = 'successful' THEN k % 3 END", "nothing": "CAST(NULL AS BIGINT)"}
SIDED_SQL = f"used AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in USED.items())} FROM requests), parts AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, '{s}' AS side, status, CAST({c} AS DOUBLE) AS value, start_us, end_us FROM used" for m, pair in USAGE.items() for s, c in zip(("input", "output"), pair) if c) + """),
counted AS (SELECT metric, count(DISTINCT side) AS sides FROM parts WHERE value IS NOT NULL GROUP BY 1), own AS (SELECT p.* FROM parts p JOIN (SELECT DISTINCT metric, side FROM parts WHERE value IS NOT NULL) USING (metric, side)),
sided AS (SELECT * FROM own UNION ALL SELECT metric, 'total', status, value, start_us, end_us FROM own JOIN counted USING (metric) WHERE sides > 1), usage AS (SELECT * FROM sided UNION ALL SELECT * REPLACE ('total' AS status) FROM sided)"""


def usage(spark: SparkSession, d: str) -> DataFrame:
    return rq.requests(spark, d).withColumns({n: F.expr(e) for n, e in USED.items()})


@query(f"WITH {REQUESTS}, {SIDED_SQL}, src AS (SELECT metric, side, status, value, 1 AS weight FROM usage), {summary_sql('src', 'metric, side, status')} SELECT metric, side, status, n, round(mean, 4) AS mean, p50, p95, max_value FROM summary")
def usage_values(spark: SparkSession, d: str) -> DataFrame:
    s = sm.values(usage(spark, d), USAGE)
    return s.select(*sm.KEYS, F.col("count").alias("n"), F.round("mean", 4).alias("mean"), "p50", "p95", F.col("max").alias("max_value"))


@query(f"WITH RECURSIVE {REQUESTS}, {SIDED_SQL}, src AS (SELECT metric, side, status, end_us AS t, coalesce(value, 0) AS w FROM usage), {rate_sql('src', 'metric, side, status')} SELECT metric, side, status, n, mean FROM dsum JOIN evs USING (metric, side, status)")
def usage_rates(spark: SparkSession, d: str) -> DataFrame:
    return rate_columns(sm.rates(usage(spark, d), USAGE), sm.KEYS)


@query(f"""WITH RECURSIVE {REQUESTS}, {SIDED_SQL}, src AS (SELECT metric, side, status, start_us AS t, coalesce(value, 0) AS w FROM usage UNION ALL SELECT metric, side, status, end_us, -coalesce(value, 0) FROM usage), {merged_sql('src', 'metric, side, status')},
lv AS (SELECT *, greatest(0, sum(w) OVER o) AS level, lead(t) OVER o - t AS us FROM points WINDOW o AS (PARTITION BY metric, side, status ORDER BY t)) SELECT metric, side, status, round(sum(level * us) / sum(us), 4) AS mean, max(level) AS max_value FROM lv WHERE us IS NOT NULL GROUP BY ALL""")
def usage_concurrency(spark: SparkSession, d: str) -> DataFrame:
    x = sm.concurrency(usage(spark, d), USAGE)
    return x.groupBy(*sm.KEYS).agg(F.round(F.sum(F.col("level") * F.col("duration_us")) / F.sum("duration_us"), 4).alias("mean"), F.max("level").alias("max_value"))


@query(f"WITH {REQUESTS}, {TOTAL}, {BOUNDS} SELECT status, count(*) AS n FROM alls, bounds WHERE end_us >= lo AND start_us <= hi GROUP BY 1")
def requests_in_window(spark: SparkSession, d: str) -> DataFrame:
    from .telemetry import bounds

    lo, hi = bounds(spark, d)
    n = rq.requests(spark, d).where(rq.in_window(F.col("start_us"), F.col("end_us"), lo, hi)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return ds.with_totals(n, "status", "n")


SIDES = (("s", "started", 1.0), ("f", "first", 1e6))
SATURATION_SQL = """moves AS (SELECT run_index, start_us AS t, 1 AS d, request_id FROM requests UNION ALL SELECT run_index, end_us, -1, request_id FROM requests),
flight AS (SELECT *, sum(d) OVER (PARTITION BY run_index ORDER BY t, d, request_id) AS open_ FROM moves),
begin_ AS (SELECT run_index, min(start_us) AS lo FROM requests GROUP BY 1),
pts AS (SELECT run_index, request_id, 'started' AS kind, t - lo AS t, CAST(open_ AS BIGINT) AS v FROM flight JOIN begin_ USING (run_index) WHERE d = 1
  UNION ALL SELECT run_index, request_id, 'first', first_token_us - lo, first_token_us - start_us FROM requests JOIN begin_ USING (run_index)),
big AS (SELECT *, CAST(t AS HUGEINT) AS x, CAST(v AS HUGEINT) AS y FROM pts),
cum AS MATERIALIZED (SELECT run_index, request_id, kind, t, v, x""" + "".join(
    f", count(*) FILTER (kind = '{k}') OVER w AS n_{p}, count(*) FILTER (kind = '{k}') OVER (PARTITION BY run_index ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 864000000001 PRECEDING) AS old_{p}"
    + "".join(f", coalesce(sum(CASE WHEN kind = '{k}' THEN {e} END) OVER w, 0) AS {n}_{p}" for n, e in {"x": "x", "y": "y", "xx": "x * x", "xy": "x * y", "yy": "y * y", "late": "CAST(v > 85000000 AS HUGEINT)"}.items())
    for p, k, _ in SIDES
) + " FROM big WINDOW w AS (PARTITION BY run_index ORDER BY t, kind, request_id)),\n" + ",\n".join(
    f"win_{p} AS (SELECT c.run_index, c.request_id, c.kind, c.x, c.n_{p} - coalesce(o.n_{p}, 0) AS n, " + ", ".join(f"c.{m}_{p} - coalesce(o.{m}_{p}, 0) AS {m}" for m in ("x", "y", "xx", "xy", "yy", "late")).replace(" AS x,", " AS sx,", 1)
    + f" FROM cum c LEFT JOIN cum o ON o.run_index = c.run_index AND o.kind = '{k}' AND o.n_{p} = greatest(c.n_{p} - CAST(floor(c.n_{p} * 0.75) AS BIGINT), c.old_{p})),\n"
    f"mid_{p} AS (SELECT run_index, request_id, kind, n, late, CAST(x AS DOUBLE) / 1e6 AS now, CAST(sx - x * n AS DOUBLE) / 1e6 AS mx, CAST(y AS DOUBLE) / {u} AS my, CAST(n AS DOUBLE) AS dn, CAST(xx - 2 * x * sx + x * x * n AS DOUBLE) / 1e12 AS mxx, CAST(xy - x * y AS DOUBLE) / (1e6 * {u}) AS mxy, CAST(yy AS DOUBLE) / ({u} * {u}) AS myy FROM win_{p}),\n"
    f"reg_{p} AS (SELECT run_index, request_id, kind, n, late, now, least(now, dn) AS en, greatest(mxx - mx * mx / dn, 1e-12) AS safe, mxy - mx * my / dn AS cxy, myy - my * my / dn AS cyy FROM mid_{p}),\n"
    f"up_{p} AS (SELECT *, CASE WHEN en >= 3 THEN cxy / safe > 0 AND {t_sql('en')} * sqrt(greatest(cyy - cxy * cxy / safe, 0.0) / (en - 2) / safe) / greatest(cxy / safe, 1e-12) < 2.0 ELSE false END AS up FROM reg_{p})"
    for p, k, u in SIDES
)


@query(f"""WITH {REQUESTS}, {SATURATION_SQL}
SELECT s.run_index, s.request_id, s.kind, s.n AS n_started, f.n AS n_first, CAST(f.late AS BIGINT) AS n_late,
  CASE WHEN s.now >= 86400 AND f.n <= 2 * f.late AND s.en >= 5 THEN s.up AND (f.en < 5 OR f.up) ELSE false END AS saturated FROM up_s s JOIN up_f f USING (run_index, request_id, kind)""")
def saturation_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """A verdict at every start and first token, over windows of at most ten days and three quarters of all points."""
    r = rq.requests(spark, d)
    begin = r.groupBy("run_index").agg(F.min("start_us").alias("lo"))
    started = constraints.state_counts(r).where("d = 1").select("run_index", "request_id", "t", F.lit("started").alias("kind"), F.col("processing").cast("bigint").alias("value"))
    first = r.select("run_index", "request_id", F.col("first_token_us").alias("t"), F.lit("first").alias("kind"), (F.col("first_token_us") - F.col("start_us")).alias("value"))
    points = started.unionByName(first).join(begin, "run_index").withColumn("t_us", F.col("t") - F.col("lo"))
    v = sat.saturated_at(points, ["run_index"], least_s=86_400, age_s=864_000, most_ttft_s=85)
    return v.select("run_index", "request_id", "kind", "n_started", "n_first", "n_late", "saturated")


@query(f"""WITH {REQUESTS}, e AS (SELECT run_index, request_id, 'in_progress' AS status, start_us AS t, 1 AS o, 0 AS lat, 0 AS outs FROM requests
  UNION ALL SELECT run_index, request_id, CASE status WHEN 'successful' THEN 'completed' WHEN 'errored' THEN 'errored' ELSE 'cancelled' END, end_us, 0, latency_us, output_tokens FROM requests),
c AS (SELECT *, sum(2 * o - 1) OVER w AS in_flight, count(*) FILTER (status = 'completed') OVER w AS n_successful, count(*) FILTER (status = 'errored') OVER w AS n_errored, count(*) FILTER (status = 'cancelled') OVER w AS n_incomplete,
  sum(lat) OVER w AS latency_us, sum(outs) OVER w AS output_tokens, min(CASE WHEN o = 1 THEN t END) OVER (PARTITION BY run_index) AS begin_ FROM e WINDOW w AS (PARTITION BY run_index ORDER BY t, o, request_id)),
d AS (SELECT *, coalesce(lag(in_flight) OVER w * (t - lag(t) OVER w), 0) AS part FROM c WINDOW w AS (PARTITION BY run_index ORDER BY t, o, request_id))
SELECT run_index, request_id, status, t AS t_us, CASE WHEN t - begin_ < 172800000000 THEN 'warmup' WHEN t - begin_ >= 1728000000000 THEN 'cooldown' ELSE 'active' END AS phase, CAST(in_flight AS BIGINT) AS in_flight, n_successful, n_errored, n_incomplete,
  CAST(sum(part) OVER (PARTITION BY run_index ORDER BY t, o, request_id) AS BIGINT) AS area, CAST(latency_us AS BIGINT) AS latency_us, CAST(output_tokens AS BIGINT) AS output_tokens, CASE WHEN n_errored >= 50 THEN 'max_errors' END AS stopped_by FROM d""")
def progress_rows(spark: SparkSession, d: str) -> DataFrame:
    """Counts, concurrency over time, phase and stop of each run after every start and end; two days of warm-up, cool-down from the twentieth."""
    return lc.progress_rows(lc.status_events(rq.requests(spark, d)), 172_800_000_000, 1_728_000_000_000, max_errors=50)
