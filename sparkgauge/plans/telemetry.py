"""Request-telemetry queries: metrics, distributions, rates, concurrency, constraints, schedules, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import requests as rq
from ..operators import constraints, distribution as ds, report, schedule
from ..operators.ordered import neighbours

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: The fact table in SQL, as functions.requests.derive_requests has it.
REQUESTS = """requests AS (
  SELECT *, start_us + latency_us AS end_us, start_us + latency_us // 4 AS first_token_us, start_us + latency_us - latency_us // 20 AS last_token_us,
    16 + k AS prompt_tokens, 1 + k % 64 AS output_tokens, 1 + k % 8 AS token_iterations
  FROM (SELECT event_id AS request_id, user_id AS conversation_id, user_id % 5 AS run_index,
      CASE event_type WHEN 'error' THEN 'errored' WHEN 'signup' THEN 'incomplete' ELSE 'successful' END AS status,
      epoch_us(ts) AS start_us, CAST(round(value * 10000000) AS BIGINT) AS latency_us, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) AS k
    FROM events))"""
TOTAL = "alls AS (SELECT * FROM requests UNION ALL SELECT * REPLACE ('total' AS status) FROM requests)"


def query_into(queries: dict, sqls: dict):
    """A decorator that registers a query under its name, with the SQL that it is held against."""

    def query(sql: str | None = None):
        def keep(f):
            queries[f.__name__] = f
            if sql:
                sqls[f.__name__] = sql
            return f

        return keep

    return query


query = query_into(QUERIES, SQL)


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in names})


def summary_sql(source: str, keys: str, scale: float = 1.0, whole: int | None = None) -> str:
    """SQL for a summary of (keys, value, weight) rows of `source`; values are divided by scale in mean and variance.

    whole: values are multiples of 1 / whole; `exact_mean` is their exact sum divided once.
    """
    exact = f", CAST(sum(CAST(round(value * {whole}) AS HUGEINT) * CAST(weight AS HUGEINT)) AS DOUBLE) / (CAST(sum(weight) AS DOUBLE) * {whole}) AS exact_mean" if whole else ""
    kept, first = (", b.exact_mean", ", any_value(exact_mean) AS exact_mean") if whole else ("", "")
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    p = ", ".join(f"min(CASE WHEN cum >= {q} * tot THEN value END) AS {n}" for n, q in ds.PERCENTILES.items())
    ak = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""merged AS (SELECT {keys}, value, sum(weight) AS weight FROM {source} WHERE value IS NOT NULL GROUP BY {keys}, value HAVING sum(weight) > 0),
tots AS (SELECT {keys}, sum(weight) AS tot, sum(value * weight) / sum(weight) AS mean{exact} FROM merged GROUP BY {keys}),
cums AS (SELECT a.*, b.tot, b.mean{kept}, sum(a.weight) OVER (PARTITION BY {ak} ORDER BY a.value) AS cum FROM merged a JOIN tots b ON {on}),
summary AS (SELECT {keys}, CAST(round_even(any_value(tot), 0) AS BIGINT) AS n, round(any_value(mean) / {scale}, 6) AS mean{first}, round(sum((value - mean) * (value - mean) * weight) / any_value(tot) / {scale} / {scale}, 5) AS variance,
  arg_max(value, (weight, -value)) AS mode, min(value) AS min_value, max(value) AS max_value, {p} FROM cums GROUP BY {keys})"""


def summary_columns(s: DataFrame, keys: list[str], scale: float = 1.0) -> DataFrame:
    return s.select(
        *keys, F.col("count").alias("n"), F.round(F.col("mean") / scale, 6).alias("mean"), F.round(F.col("variance") / scale / scale, 5).alias("variance"), "mode", F.col("min").alias("min_value"), F.col("max").alias("max_value"), *ds.PERCENTILES
    )


@query(f"WITH {REQUESTS}, {TOTAL}, src AS (SELECT status, latency_us AS value, 1 AS weight FROM alls), {summary_sql('src', 'status', 1e6)} SELECT * FROM summary")
def latency_summary_by_status(spark: SparkSession, d: str) -> DataFrame:
    p = ds.with_totals(ds.pdf(rq.requests(spark, d), ["status"], "latency_us"), "status", "weight")
    return summary_columns(ds.summarise(p, ["status"]), ["status"], 1e6)


METRICS = {
    "request_latency_s": "latency_us / 1e6", "ttft_ms": "(first_token_us - start_us) / 1000.0", "tpot_ms": "(last_token_us - start_us) / 1000.0 / nullif(output_tokens, 0)",
    "itl_ms": "CASE WHEN output_tokens > 1 THEN (last_token_us - first_token_us) / 1000.0 / (output_tokens - 1) END",
    "tokens_per_second": "(prompt_tokens + output_tokens) / (nullif(latency_us, 0) / 1e6)", "output_tokens_per_second": "output_tokens / (nullif(latency_us, 0) / 1e6)",
    "output_tokens_per_iteration": "output_tokens / token_iterations", "iter_tokens_per_iteration": "CASE WHEN output_tokens > 1 AND token_iterations > 1 THEN (output_tokens - 1) / (token_iterations - 1) END",
}


@query(f"WITH {REQUESTS} SELECT request_id, status, prompt_tokens, output_tokens, prompt_tokens + output_tokens AS total_tokens, " + ", ".join(f"round(CAST({e} AS DOUBLE), 6) AS {n}" for n, e in METRICS.items()) + " FROM requests")
def request_metrics(spark: SparkSession, d: str) -> DataFrame:
    return r6(rq.with_metrics(rq.requests(spark, d)).select("request_id", "status", "prompt_tokens", "output_tokens", "total_tokens", *METRICS), *METRICS)


def weighted(metric: str, weight: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        r = rq.with_metrics(rq.requests(spark, d)).select("status", F.round(metric, 6).alias("value"), F.expr(weight).alias("weight"))
        s = ds.summarise(ds.with_totals(ds.pdf(r, ["status"], weight="weight"), "status", "weight"), ["status"])
        return s.select("status", F.col("count").alias("n"), F.round("mean", 5).alias("mean"), "p50", "p95")

    sql = f"WITH {REQUESTS}, {TOTAL}, src AS (SELECT status, round(CAST({METRICS[metric]} AS DOUBLE), 6) AS value, {weight} AS weight FROM alls), {summary_sql('src', 'status')} SELECT status, n, round(mean, 5) AS mean, p50, p95 FROM summary"
    return run, sql


QUERIES["itl_weighted_summary"], SQL["itl_weighted_summary"] = weighted("itl_ms", "coalesce(output_tokens, 1) - 1")
QUERIES["tpot_weighted_summary"], SQL["tpot_weighted_summary"] = weighted("tpot_ms", "coalesce(output_tokens, 0)")


@query(f"WITH {REQUESTS}, {TOTAL} SELECT status, value, count(*) AS weight FROM (SELECT status, latency_us // 1000000 AS value FROM alls) GROUP BY status, value")
def pdf_by_status(spark: SparkSession, d: str) -> DataFrame:
    r = rq.requests(spark, d).select("status", F.expr("latency_us div 1000000").alias("value"))
    return ds.with_totals(ds.pdf(r, ["status"]), "status", "weight")


@query(f"WITH {REQUESTS}, {TOTAL}, m AS (SELECT status, latency_us // 1000000 AS value, count(*) AS weight FROM alls GROUP BY ALL) SELECT status, arg_max(value, (weight, -value)) AS mode FROM m GROUP BY status")
def mode_by_status(spark: SparkSession, d: str) -> DataFrame:
    return ds.summarise(pdf_by_status(spark, d), ["status"]).select("status", "mode")


@query(f"WITH {REQUESTS}, {TOTAL}, m AS (SELECT status, latency_us // 1000000 AS value, count(*) AS weight FROM alls GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY status) AS c FROM m) SELECT status, value, weight FROM n WHERE c <= 5 OR i IN (0, (c - 1) // 4, 2 * (c - 1) // 4, 3 * (c - 1) // 4, c - 1)")
def pdf_sampled(spark: SparkSession, d: str) -> DataFrame:
    return ds.pdf_sample(pdf_by_status(spark, d), ["status"], 5)


def merged_sql(source: str, keys: str) -> str:
    """SQL for clusters of times in (keys, t, w); the greedy walk over a key's times is a recursive query."""
    k = keys
    on = " AND ".join(f"o.{x.strip()} = c.{x.strip()}" for x in keys.split(","))
    ok = ", ".join(f"o.{x.strip()}" for x in keys.split(","))
    return f"""once AS (SELECT {k}, t, CAST(sum(w) AS DOUBLE) AS w FROM {source} GROUP BY {k}, t),
gaps AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY {k} ORDER BY t) <= 100 THEN 0 ELSE 1 END AS fresh FROM once),
segs AS (SELECT *, sum(fresh) OVER (PARTITION BY {k} ORDER BY t) AS seg FROM gaps),
walk AS (SELECT {k}, seg, min(t) AS t FROM segs GROUP BY {k}, seg
  UNION ALL SELECT {ok}, o.seg, min(o.t) FROM walk c JOIN segs o ON {on} AND o.seg = c.seg AND o.t > c.t + 100 GROUP BY {ok}, o.seg, c.t),
merged_t AS (SELECT {ok.replace('o.', 's.')}, c.t, s.w FROM segs s ASOF JOIN walk c ON {on.replace('o.', 's.')} AND c.seg = s.seg AND s.t >= c.t),
points AS (SELECT {k}, t, sum(w) AS w FROM merged_t GROUP BY {k}, t)"""


def rate_sql(source: str, keys: str = "status") -> str:
    return f"""{merged_sql(source, keys)},
near AS (SELECT *, lag(t) OVER o AS p, lead(t) OVER o AS n FROM points WINDOW o AS (PARTITION BY {keys} ORDER BY t)),
dur AS (SELECT {keys}, t, w, CASE WHEN n IS NULL THEN greatest((t - p) / 2e6, 1e-6) ELSE (n - coalesce(p, t)) / 2e6 END AS duration FROM near WHERE p IS NOT NULL OR n IS NOT NULL),
evs AS (SELECT {keys}, CAST(round_even(sum(w), 0) AS BIGINT) AS n FROM dur GROUP BY {keys}),
dsum AS (SELECT {keys}, round(sum(w) / sum(duration), 6) AS mean FROM dur GROUP BY {keys})"""


def rate_columns(p: DataFrame, keys: list[str]) -> DataFrame:
    return p.groupBy(*keys).agg(F.bround(F.sum("w")).cast("bigint").alias("n"), F.round(F.sum("w") / F.sum("duration"), 6).alias("mean"))


def bounds(spark: SparkSession, d: str) -> tuple[int, int]:
    """The middle 80 % of the run."""
    lo, hi = rq.requests(spark, d).agg(F.min("start_us"), F.max("end_us")).first()
    return lo + (hi - lo) // 10, hi - (hi - lo) // 10


BOUNDS = "bounds AS (SELECT min(start_us) + (max(end_us) - min(start_us)) // 10 AS lo, max(end_us) - (max(end_us) - min(start_us)) // 10 AS hi FROM requests)"


def end_points(r: DataFrame) -> DataFrame:
    """(status, t, w): how many requests ended at each time, also over all statuses."""
    return ds.with_totals(r.groupBy("status", F.col("end_us").alias("t")).agg(F.count(F.lit(1)).alias("w")), "status", "w")


@query(f"WITH RECURSIVE {REQUESTS}, {TOTAL}, src AS (SELECT status, end_us AS t, 1 AS w FROM alls), {rate_sql('src')} SELECT dsum.status, n, mean FROM dsum JOIN evs USING (status)")
def rps_distribution(spark: SparkSession, d: str) -> DataFrame:
    return rate_columns(ds.rate_points(end_points(rq.requests(spark, d)), ["status"]), ["status"])


@query(f"""WITH RECURSIVE {REQUESTS}, {TOTAL}, {BOUNDS}, kept AS (SELECT * FROM alls, bounds WHERE end_us >= lo AND start_us <= hi),
src AS (SELECT status, end_us AS t, 1 AS w FROM kept WHERE end_us BETWEEN lo AND hi UNION ALL SELECT DISTINCT status, lo, 0 FROM kept UNION ALL SELECT DISTINCT status, hi, 0 FROM kept), {rate_sql('src')} SELECT dsum.status, n, mean FROM dsum JOIN evs USING (status)""")
def rps_distribution_windowed(spark: SparkSession, d: str) -> DataFrame:
    lo, hi = bounds(spark, d)
    r = rq.requests(spark, d).where(rq.in_window(F.col("start_us"), F.col("end_us"), lo, hi))
    return rate_columns(ds.rate_points(end_points(r), ["status"], start=lo, end=hi), ["status"])


@query(f"WITH RECURSIVE {REQUESTS}, {TOTAL}, src AS (SELECT status, end_us AS t, 1 AS w FROM alls), {rate_sql('src')}, src2 AS (SELECT status, round(w / duration, 6) AS value, CAST(round(duration * 1e6) AS BIGINT) AS weight FROM dur), {summary_sql('src2', 'status')} SELECT status, p10, p50, p90, p99, mode FROM summary")
def rps_percentiles(spark: SparkSession, d: str) -> DataFrame:
    p = ds.rate_points(end_points(rq.requests(spark, d)), ["status"]).select("status", F.round(F.col("w") / F.col("duration"), 6).alias("value"), F.round(F.col("duration") * 1e6).cast("bigint").alias("weight"))
    return ds.value_summary(p, ["status"], weight="weight").select("status", "p10", "p50", "p90", "p99", "mode")


SWEEP = """lv AS (SELECT status, t, CAST(greatest(0, sum(w) OVER o) AS BIGINT) AS level, lead(t) OVER o - t AS duration_us FROM points WINDOW o AS (PARTITION BY status ORDER BY t))"""
DELTAS = "src AS (SELECT status, start_us AS t, 1 AS w FROM alls UNION ALL SELECT status, end_us, -1 FROM alls)"


@query(f"WITH RECURSIVE {REQUESTS}, {TOTAL}, {DELTAS}, {merged_sql('src', 'status')}, {SWEEP} SELECT * FROM lv WHERE duration_us IS NOT NULL")
def concurrency_levels(spark: SparkSession, d: str) -> DataFrame:
    return ds.concurrency_levels(rq.with_total(rq.requests(spark, d).select("status", "start_us", "end_us")), ["status"])


@query(f"WITH RECURSIVE {REQUESTS}, {TOTAL}, {DELTAS}, {merged_sql('src', 'status')}, {SWEEP}, src2 AS (SELECT status, level AS value, duration_us AS weight FROM lv WHERE duration_us IS NOT NULL), {summary_sql('src2', 'status')}, cnt AS (SELECT status, count(*) AS c FROM alls GROUP BY status) SELECT status, c AS n, mean, max_value, p50, p90 FROM summary JOIN cnt USING (status)")
def concurrency_distribution(spark: SparkSession, d: str) -> DataFrame:
    s = ds.concurrency_summary(rq.with_total(rq.requests(spark, d).select("status", "start_us", "end_us")), ["status"])
    return s.select("status", F.col("count").alias("n"), F.round("mean", 6).alias("mean"), F.col("max").alias("max_value"), "p50", "p90")


@query(f"WITH RECURSIVE src AS (SELECT o_custkey AS k, CAST(floor(o_totalprice) AS BIGINT) // 200 AS t, 1 AS w FROM orders), {merged_sql('src', 'k')} SELECT * FROM points")
def time_merge(spark: SparkSession, d: str) -> DataFrame:
    """Dense times, so that most chains are longer than the threshold and are folded."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    return ds.merge_times(o.select(F.col("o_custkey").alias("k"), F.expr("cast(o_totalprice as bigint) div 200").alias("t"), F.lit(1).alias("w")), ["k"], 100)


@query(f"WITH RECURSIVE src AS (SELECT 1 AS k, l_orderkey * 5 + l_linenumber AS t, 1 AS w FROM lineitem), {merged_sql('src', 'k')} SELECT * FROM points")
def one_chain_merge(spark: SparkSession, d: str) -> DataFrame:
    """All times of one key in one chain without a gap beyond the threshold, over all ranges."""
    x = spark.read.parquet(f"{d}/lineitem.parquet")
    return ds.merge_times(x.select(F.lit(1).alias("k"), (F.col("l_orderkey") * 5 + F.col("l_linenumber")).alias("t"), F.lit(1).alias("w")), ["k"], 100)


POINTS_SQL = """pts AS (
  SELECT status, 'prompt' AS metric, first_token_us AS t, CAST(prompt_tokens AS DOUBLE) AS w FROM alls
  UNION ALL SELECT status, 'output', CASE WHEN token_iterations <= 1 THEN last_token_us ELSE first_token_us END, CASE WHEN token_iterations <= 1 THEN output_tokens ELSE 1.0 END FROM alls
  UNION ALL SELECT status, 'output', first_token_us + CAST(floor((last_token_us - first_token_us) * i / (token_iterations - 1)) AS BIGINT), (output_tokens - 1) / (token_iterations - 1) FROM alls, range(1, 8) x(i) WHERE i < token_iterations AND output_tokens > 1),
src AS (SELECT * FROM pts UNION ALL SELECT status, 'total', t, w FROM pts)"""


def token_points(spark: SparkSession, d: str) -> DataFrame:
    """(status, metric, t, w): points of equal times are summed up, then stand under the totals of metric and status too; a time has few rows."""
    r = rq.requests(spark, d)
    p = r.select("status", F.explode(F.array(F.struct(F.lit("prompt").alias("metric"), rq.prompt_points().alias("p")), F.struct(F.lit("output").alias("metric"), rq.output_points().alias("p")))).alias("m"))
    p = p.select("status", "m.metric", F.explode("m.p").alias("p")).groupBy("status", "metric", F.col("p.t").alias("t")).agg(F.sum("p.w").alias("w"))
    return ds.under_total(p, "metric", "status")


@query(f"WITH RECURSIVE {REQUESTS}, {TOTAL}, {POINTS_SQL}, {rate_sql('src', 'status, metric')} SELECT dsum.status, dsum.metric, n, round(mean, 4) AS mean FROM dsum JOIN evs USING (status, metric)")
def token_rate(spark: SparkSession, d: str) -> DataFrame:
    s = rate_columns(ds.rate_points(token_points(spark, d), ["status", "metric"], grouped=True), ["status", "metric"])
    return s.withColumn("mean", F.round("mean", 4))


@query(f"WITH {REQUESTS}, {TOTAL} SELECT status, round((output_tokens - 1) / (token_iterations - 1), 6) AS value, CAST(sum(token_iterations - 1) AS BIGINT) AS n FROM alls WHERE output_tokens > 1 AND token_iterations > 1 GROUP BY 1, 2")
def iteration_fanout(spark: SparkSession, d: str) -> DataFrame:
    n = rq.requests(spark, d).select("status", F.explode(rq.iteration_points()).alias("p")).groupBy("status", F.round("p.w", 6).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return ds.with_totals(n, "status", "n")


BASE = ("request_latency_s", "prompt_tokens", "output_tokens", "total_tokens", "ttft_ms", "token_iterations")
LONG_SQL = "long AS (" + " UNION ALL ".join(f"SELECT status, '{m}' AS metric, round(CAST(coalesce({METRICS.get(m, 'prompt_tokens + output_tokens' if m == 'total_tokens' else m)}, 0) AS DOUBLE), 6) AS value, 1 AS weight FROM alls" for m in BASE) + ")"


@query(f"WITH {REQUESTS}, {TOTAL}, {LONG_SQL}, {summary_sql('long', 'status, metric')} SELECT status, metric, n, round(mean, 4) AS mean, p50, p90, p95, p99 FROM summary")
def base_metrics(spark: SparkSession, d: str) -> DataFrame:
    """All value distributions in one pass over one long frame; missing values count as zero."""
    r = rq.with_metrics(rq.requests(spark, d)).select("status", *BASE)
    long = r.select("status", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.round(F.coalesce(F.col(m).cast("double"), F.lit(0.0)), 6).alias("value")) for m in BASE))).alias("m")).select("status", "m.*")
    p = ds.with_totals(ds.pdf(long, ["status", "metric"]), "status", "weight")
    return ds.summarise(p, ["status", "metric"]).select("status", "metric", F.col("count").alias("n"), F.round("mean", 4).alias("mean"), "p50", "p90", "p95", "p99")


@query(f"WITH {REQUESTS} SELECT run_index, coalesce(status, 'total') AS status, count(*) AS n FROM requests GROUP BY GROUPING SETS ((run_index, status), (run_index))")
def request_totals(spark: SparkSession, d: str) -> DataFrame:
    return ds.with_totals(rq.requests(spark, d).groupBy("run_index", "status").agg(F.count(F.lit(1)).alias("n")), "status", "n")


PARTS = {"prefill_s": "(first_token_us - start_us) / 1e6", "decode_s": "(last_token_us - first_token_us) / 1e6", "finish_s": "(end_us - last_token_us) / 1e6", "queued_s": "0.0"}


@query(f"WITH {REQUESTS} SELECT run_index, " + ", ".join(f"round(coalesce(nullif(avg({e}), 0), -1), 6) AS {n}" for n, e in PARTS.items()) + " FROM requests GROUP BY run_index")
def scheduler_averages(spark: SparkSession, d: str) -> DataFrame:
    r = rq.requests(spark, d).select("run_index", *(F.expr(e).cast("double").alias(n) for n, e in PARTS.items()))
    return r6(r.groupBy("run_index").agg(*(ds.mean_or(n).alias(n) for n in PARTS)), *PARTS)


@query(f"""WITH {REQUESTS}, o AS (SELECT *, lag(latency_us) OVER w AS p, end_us - lag(end_us) OVER w AS dt FROM requests WINDOW w AS (PARTITION BY run_index ORDER BY end_us, request_id))
SELECT run_index, count(*) AS n, round(avg(latency_us) / 1e6, 6) AS mean, round(sum(p / 1e6 * (dt / 1e6)) / nullif(sum(dt / 1e6), 0), 6) AS tw_mean, round(sum(latency_us) / 1e6 / nullif(sum(dt / 1e6), 0), 6) AS rate FROM o GROUP BY run_index""")
def running_stats(spark: SparkSession, d: str) -> DataFrame:
    o = neighbours(rq.requests(spark, d), ["run_index"], "end_us", ("request_id",), ("latency_us",))
    o = o.withColumns({"p": F.col("prev_latency_us") / 1e6, "dt": (F.col("end_us") - F.col("prev_end_us")) / 1e6})
    span = F.nullif(F.sum("dt"), F.lit(0.0))
    return r6(o.groupBy("run_index").agg(F.count(F.lit(1)).alias("n"), (F.avg("latency_us") / 1e6).alias("mean"), (F.sum(F.col("p") * F.col("dt")) / span).alias("tw_mean"), (F.sum("latency_us") / 1e6 / span).alias("rate")), "mean", "tw_mean", "rate")


@query("WITH e AS (SELECT min(n_chars) AS lo, (1 + max(n_chars) - min(n_chars)) / 10 AS w FROM documents) SELECT round(CAST(lo + least(floor((n_chars - lo) / w), 9) * w AS DOUBLE), 6) AS bucket_start, count(*) AS n FROM documents, e GROUP BY 1")
def token_histogram(spark: SparkSession, d: str) -> DataFrame:
    return r6(ds.histogram(spark.read.parquet(f"{d}/documents.parquet"), "n_chars"), "bucket_start")


@query(f"""WITH {REQUESTS}, h AS (SELECT request_id, k, row_number() OVER (PARTITION BY status ORDER BY md5(request_id || ':3')) <= 10 AS sampled FROM requests)
SELECT request_id, sampled, CASE WHEN sampled THEN k END AS k FROM h""")
def reservoir_rows(spark: SparkSession, d: str) -> DataFrame:
    """Which rows of each status are in the sample, and that the others lose their payload."""
    return ds.reservoir(rq.requests(spark, d), ["status"], 10, seed=3, payload=("k",)).select("request_id", "sampled", "k")


@query(f"WITH {REQUESTS} SELECT status, least(count(*), 10) AS n FROM requests GROUP BY status")
def reservoir_sizes(spark: SparkSession, d: str) -> DataFrame:
    r = ds.reservoir(rq.requests(spark, d), ["status"], 10, payload=("k",))
    return r.groupBy("status").agg(F.count(F.when(F.col("sampled") & F.col("k").isNotNull(), 1)).alias("n"))


# Constraints, phases, saturation


@query(f"""WITH {REQUESTS}, o AS (SELECT request_id, run_index, row_number() OVER w AS seq, avg(CASE WHEN status = 'errored' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY run_index ORDER BY end_us, request_id ROWS 49 PRECEDING) AS rate FROM requests WINDOW w AS (PARTITION BY run_index ORDER BY end_us, request_id))
SELECT request_id, seq, round(rate, 6) AS rate, rate >= 0.25 AND seq >= 50 AS triggered FROM o""")
def error_rate_window(spark: SparkSession, d: str) -> DataFrame:
    return r6(constraints.error_rate(rq.requests(spark, d), 0.25, 50).select("request_id", "seq", "rate", "triggered"), "rate")


@query(f"""WITH {REQUESTS}, o AS (SELECT *, row_number() OVER w AS seq, sum(CASE WHEN status = 'errored' THEN 1 ELSE 0 END) OVER w AS errs, end_us - min(start_us) OVER (PARTITION BY run_index) AS elapsed FROM requests WINDOW w AS (PARTITION BY run_index ORDER BY end_us, request_id)),
c AS (SELECT run_index, 'max_requests' AS name, min(seq) AS seq FROM o WHERE seq >= 100 GROUP BY 1 UNION ALL SELECT run_index, 'max_errors', min(seq) FROM o WHERE errs >= 10 GROUP BY 1
  UNION ALL SELECT run_index, 'max_duration', min(seq) FROM o WHERE elapsed >= 86400000000 GROUP BY 1 UNION ALL SELECT run_index, 'max_global_error_rate', min(seq) FROM o WHERE errs >= 0.2 * seq AND seq >= 30 GROUP BY 1)
SELECT * FROM c""")
def first_trigger(spark: SparkSession, d: str) -> DataFrame:
    return constraints.first_triggers(rq.requests(spark, d), max_requests=100, max_errors=10, max_duration_us=86_400_000_000, max_global_error_rate=(0.2, 30))


SLOPE_SQL = "slope AS (SELECT run_index, count(*) AS n, regr_slope(y, x) AS slope, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM (SELECT run_index, (start_us - min(start_us) OVER (PARTITION BY run_index)) / 1e6 AS x, latency_us / 1e6 AS y FROM requests) GROUP BY 1)"


def t_sql(n: str) -> str:
    """The upper end of 95 % of Student's t with n - 2 degrees of freedom, by its first three terms, written out."""
    return f"(1.9603949169253396::DOUBLE + 2.373620793152307::DOUBLE / ({n} - 2) + 2.1450395664834403::DOUBLE / (({n} - 2) * ({n} - 2)))"


T_SQL = t_sql("n")


@query(f"""WITH {REQUESTS}, {SLOPE_SQL}, se AS (SELECT *, sqrt(greatest(syy - sxy * sxy / sxx, 0) / (n - 2) / sxx) AS se FROM slope), m AS (SELECT *, {T_SQL} * se / greatest(slope, 1e-12) AS margin FROM se)
SELECT run_index, n, round(slope, 8) AS slope, round(se, 8) AS se, CASE WHEN slope > 0 THEN round(margin, 4) END AS margin, slope > 0 AND margin < 2.0 AS alert FROM m""")
def slope_check(spark: SparkSession, d: str) -> DataFrame:
    s = constraints.slope(rq.requests(spark, d), ["run_index"])
    return s.select("run_index", "n", F.round("slope", 8).alias("slope"), F.round("se", 8).alias("se"), F.when(F.col("slope") > 0, F.round("margin", 4)).alias("margin"), "alert")


@query(f"""WITH {REQUESTS}, b AS (SELECT run_index, min(start_us) AS lo, max(end_us) - min(start_us) AS len FROM requests GROUP BY 1)
SELECT request_id, CASE WHEN end_us < lo + len // 10 THEN 'warmup' WHEN start_us > lo + len - len // 10 THEN 'cooldown' ELSE 'active' END AS phase FROM requests JOIN b USING (run_index)""")
def phase_status(spark: SparkSession, d: str) -> DataFrame:
    return constraints.phases(rq.requests(spark, d), 0.1, 0.1).select("request_id", "phase")


@query(f"""WITH {REQUESTS}, e AS (SELECT run_index, start_us AS t, 1 AS d, request_id, status FROM requests UNION ALL SELECT run_index, end_us, -1, request_id, status FROM requests)
SELECT run_index, request_id, t, CAST(sum(CASE WHEN d = 1 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS created, CAST(sum(CASE WHEN d = -1 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS processed, CAST(sum(CASE WHEN d = -1 AND status = 'errored' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS errored FROM e WHERE true WINDOW w AS (PARTITION BY run_index ORDER BY t, d, request_id)""")
def scheduler_state(spark: SparkSession, d: str) -> DataFrame:
    return constraints.state_counts(rq.requests(spark, d)).select("run_index", "request_id", "t", "created", "processed", "errored")


# Schedules


@query("SELECT i, round(i / 2.0, 6) AS offset_s FROM range(1, 1001) x(i)")
def constant_schedule(spark: SparkSession, d: str) -> DataFrame:
    return r6(schedule.constant(spark, 1000, 2.0), "offset_s")


@query("SELECT i, round(CASE WHEN i = 1 THEN 0 WHEN i <= 4 THEN sqrt(2.0 * i * 4 / 2) ELSE 4 + (i - 4) / 2.0 END, 6) AS offset_s FROM range(1, 1001) x(i)")
def ramp_schedule(spark: SparkSession, d: str) -> DataFrame:
    return r6(schedule.constant(spark, 1000, 2.0, ramp=4.0), "offset_s")


@query("SELECT i, round(6.0 * least(1.0, i / 100.0), 6) AS offset_s FROM range(1, 501) x(i)")
def throughput_schedule(spark: SparkSession, d: str) -> DataFrame:
    return r6(schedule.throughput(spark, 500, 6.0, 100), "offset_s")


@query("SELECT k, round(CASE WHEN k = 0 THEN 2.0 WHEN k = 1 THEN 10.0 ELSE 2.0 + 8.0 * (k - 1) / 8.0 END, 6) AS rate FROM range(0, 10) x(k)")
def sweep_rates(spark: SparkSession, d: str) -> DataFrame:
    return r6(schedule.sweep(spark, 2.0, 10.0, 10), "rate")


@query(f"WITH {REQUESTS} SELECT request_id, round((coalesce(sum(latency_us) OVER (PARTITION BY run_index ORDER BY start_us, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / 1e6, 6) AS offset_s FROM requests")
def synchronous_schedule(spark: SparkSession, d: str) -> DataFrame:
    return r6(schedule.synchronous(rq.requests(spark, d), ["run_index"]).select("request_id", "offset_s"), "offset_s")


@query("SELECT o_orderkey, (epoch_us(o_orderdate) - min(epoch_us(o_orderdate)) OVER (PARTITION BY o_custkey)) / 1e6 AS rel_s FROM orders")
def trace_relative_ts(spark: SparkSession, d: str) -> DataFrame:
    return schedule.relative(spark.read.parquet(f"{d}/orders.parquet").withColumn("t", F.unix_micros(F.col("o_orderdate").cast("timestamp"))), "t", ["o_custkey"]).select("o_orderkey", "rel_s")


@query("SELECT o_orderkey, round(100.0 + 0.5 * (epoch_us(o_orderdate) - min(epoch_us(o_orderdate)) OVER (PARTITION BY o_custkey)) / 1e6, 6) AS target_s FROM orders")
def trace_schedule(spark: SparkSession, d: str) -> DataFrame:
    return r6(schedule.replay(trace_relative_ts(spark, d), 100.0, 0.5).select("o_orderkey", "target_s"), "target_s")


# Reports


RUNS_SQL = f"""{REQUESTS}, {TOTAL}, src AS (SELECT run_index, status, latency_us AS value, 1 AS weight FROM alls), {summary_sql('src', 'run_index, status')},
span AS (SELECT run_index, status, count(*) / ((max(end_us) - min(start_us)) / 1e6) AS rps, sum(latency_us) / CAST(max(end_us) - min(start_us) AS DOUBLE) AS concurrency, sum(output_tokens) / ((max(end_us) - min(start_us)) / 1e6) AS tps FROM alls GROUP BY 1, 2),
pts AS (SELECT t.run_index, round(t.rps, 6) AS requests_per_second, round(t.concurrency, 6) AS concurrency, round(t.tps, 6) AS tokens_per_second, round(s.p50 / 1e6, 6) AS latency_p50_s, round(s.p95 / 1e6, 6) AS latency_p95_s, round(t.tps / t.concurrency, 6) AS efficiency
  FROM span t JOIN summary s ON s.run_index = t.run_index AND s.status = 'successful' WHERE t.status = 'total')"""


@query(f"WITH {RUNS_SQL} SELECT * FROM pts")
def plot_points(spark: SparkSession, d: str) -> DataFrame:
    return report.points(rq.requests(spark, d))


@query(f"WITH {RUNS_SQL} SELECT run_index, requests_per_second, tokens_per_second FROM pts ORDER BY tokens_per_second DESC LIMIT 1")
def peak_throughput(spark: SparkSession, d: str) -> DataFrame:
    return report.peak(report.points(rq.requests(spark, d)), "tokens_per_second").select("run_index", "requests_per_second", "tokens_per_second")


@query(f"WITH {RUNS_SQL} SELECT run_index, latency_p95_s <= 4500 AS latency_ok, requests_per_second >= 0.0005 AS rate_ok FROM pts")
def slo_match(spark: SparkSession, d: str) -> DataFrame:
    p = report.points(rq.requests(spark, d))
    return report.slo(p, {"latency_ok": ("latency_p95_s", "<=", 4500), "rate_ok": ("requests_per_second", ">=", 0.0005)}).select("run_index", "latency_ok", "rate_ok")


@query(f"WITH {RUNS_SQL}, f AS (SELECT run_index, status, unnest(['p50', 'p75', 'p90', 'p95', 'p99']) AS p, unnest([p50, p75, p90, p95, p99]) // 1000000000 AS v FROM summary), g AS (SELECT *, lead(v) OVER (PARTITION BY run_index, status ORDER BY p) AS n FROM f) SELECT run_index, status, p, v FROM g WHERE n IS NULL OR n <> v")
def dedup_percentiles(spark: SparkSession, d: str) -> DataFrame:
    p = ds.with_totals(ds.pdf(rq.requests(spark, d), ["run_index", "status"], "latency_us"), "status", "weight")
    s = ds.summarise(p, ["run_index", "status"]).select("run_index", "status", *(F.expr(f"{p} div 1000000000").alias(p) for p in ("p50", "p75", "p90", "p95", "p99")))
    return report.distinct_percentiles(s, ["run_index", "status"], ["p50", "p75", "p90", "p95", "p99"])


@query(f"WITH {RUNS_SQL} SELECT run_index, " + ", ".join(f"max(CASE WHEN status = '{s}' THEN {e} END) AS {s}_{n}" for s in rq.STATUSES for n, e in (("mean", "round(mean / 1e6, 6)"), ("median", "round(p50 / 1e6, 6)"), ("std", "round(sqrt(variance) / 1e6, 4)"))) + " FROM summary GROUP BY run_index")
def csv_wide(spark: SparkSession, d: str) -> DataFrame:
    return report.wide(rq.requests(spark, d))


@query("SELECT 'x' AS curve, x, round(x * x, 6) AS y FROM (SELECT unnest([1.0, 2.0, 3.0]) AS x)")
def spline_at_knots(spark: SparkSession, d: str) -> DataFrame:
    knots = spark.createDataFrame([("x", float(x), float(x * x)) for x in (1, 2, 3, 4)], "curve string, x double, y double")
    return report.spline(knots, ["curve"], [1.0, 2.0, 3.0])
