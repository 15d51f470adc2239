"""Report queries: statistics blocks, wide and JSON reports, chart tables, lines and interpolation, scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import requests as rq, scalars as sc
from ..operators import distribution as ds, export as ex, report
from .datasets import table
from .runs import ALL, LIFE, life
from .telemetry import REQUESTS, TOTAL, merged_sql, query_into, r6, rate_sql, summary_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = query_into(QUERIES, SQL)

LATENCY_SQL = f"{REQUESTS}, {TOTAL}, src AS (SELECT run_index, status, latency_us AS value, 1 AS weight FROM alls WHERE run_index < 4 OR status <> 'errored'), {summary_sql('src', 'run_index, status')}"
LIST_SQL = "'[' || concat_ws(', ', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in ("min_value", *ex.LISTED, "max_value")) + ") || ']'"
BLOCK_SQL = f"""cells AS (SELECT run_index, upper(status[1]) || status[2:] || ' us' AS unit, unnest(['Mean', 'Median', 'Std Dev', 'Percentiles']) AS name,
  unnest([CAST(CAST(round(mean, 2) AS DECIMAL(38, 4)) AS VARCHAR), CAST(CAST(p50 AS DECIMAL(38, 4)) AS VARCHAR), 'std', {LIST_SQL}]) AS value FROM summary WHERE status <> 'total')"""


def latency_summaries(spark: SparkSession, d: str) -> DataFrame:
    r = rq.with_total(rq.requests(spark, d).select("run_index", "status", F.col("latency_us").alias("value")))
    return ds.value_summary(r.where("run_index < 4 or status <> 'errored'"), ["run_index", "status"])


def blocks(spark: SparkSession, d: str) -> DataFrame:
    cells = ex.stats_block(latency_summaries(spark, d), ["run_index"], "us", places=2)
    return cells.withColumn("value", F.when(F.col("name") == "Std Dev", F.lit("std")).otherwise(F.col("value")))


@query(f"WITH {LATENCY_SQL}, {BLOCK_SQL} SELECT * FROM cells")
def csv_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Four statistics a status; deviations, which sums of floats give in any order, are compared in latency_summary_by_status."""
    return blocks(spark, d)


NAMES = [("Latency", f"{s} us", n) for s in ("Successful", "Incomplete", "Errored") for n in ex.BLOCK]


@query(f"WITH {LATENCY_SQL}, {BLOCK_SQL} SELECT run_index, " + ", ".join(f"coalesce(max(CASE WHEN unit = '{u}' AND name = '{n}' THEN value END), '') AS \"{g}|{u}|{n}\"" for g, u, n in NAMES) + " FROM cells GROUP BY 1")
def csv_report(spark: SparkSession, d: str) -> DataFrame:
    """One row a benchmark; run 4 has no errored requests here, so its cells are blank."""
    return ex.wide(blocks(spark, d).withColumn("group", F.lit("Latency")), "run_index", NAMES)


@query(f"""WITH {LATENCY_SQL}, {BLOCK_SQL} SELECT -3 + i AS line, array_to_string(['"' || coalesce(string_split(x, '|')[i + 1], '') || '"' FOR x IN ['run_index', {', '.join(f"'{g}|{u}|{n}'" for g, u, n in NAMES)}]], ',') AS text FROM range(0, 3) r(i)
UNION ALL SELECT row_number() OVER (ORDER BY run_index), concat_ws(',', '"' || run_index || '"', {', '.join(f"'{chr(34)}' || coalesce(max(CASE WHEN unit = '{u}' AND name = '{n}' THEN value END), '') || '{chr(34)}'" for g, u, n in NAMES)}) FROM cells GROUP BY run_index""")
def csv_lines(spark: SparkSession, d: str) -> DataFrame:
    return ex.csv_lines(csv_report(spark, d))


@query(f"WITH {LATENCY_SQL} SELECT run_index, status, n, p50, p95 FROM summary")
def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    s = latency_summaries(spark, d).select("run_index", "status", F.col("count").alias("n"), "p50", "p95")
    return ex.parse_report(ex.json_report(s, "run_index"), "run_index", "status string, n bigint, p50 bigint, p95 bigint")


@query(f"WITH {LATENCY_SQL} SELECT run_index, status, concat_ws(' | ', lpad(status, 12, ' '), lpad(CAST(n AS VARCHAR), 8, ' '), lpad(CAST(p50 AS VARCHAR), 14, ' ')) AS line FROM summary")
def console_lines(spark: SparkSession, d: str) -> DataFrame:
    s = latency_summaries(spark, d)
    return ex.console_lines(s.withColumn("k", F.struct("run_index", "status")), "k", {"status": ("%s", 12), "count": ("%d", 8), "p50": ("%d", 14)}).select("k.*", "line")


@query(f"""WITH {REQUESTS}, b AS (SELECT run_index, count(*) AS n FROM requests GROUP BY 1), p AS (SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 2)
SELECT '{{"run_info":[{{"model":"m","runs":5}}],"workload_details":[' || (SELECT string_agg('{{"doc_id":' || doc_id || ',"source":"' || source || '"}}', ',' ORDER BY doc_id) FROM p) || '],"benchmarks":[' || (SELECT string_agg('{{"run_index":' || run_index || ',"n":' || n || '}}', ',' ORDER BY run_index) FROM b) || ']}}' AS payload""")
def html_payload(spark: SparkSession, d: str) -> DataFrame:
    run = spark.range(1).select(F.lit("m").alias("model"), F.lit(5).alias("runs"))
    n = rq.requests(spark, d).groupBy("run_index").agg(F.count(F.lit(1)).alias("n"))
    return ex.html_payload(run, n, table(spark, d, "documents").orderBy("doc_id").limit(2).select("doc_id", "source"))


@query("SELECT r_name AS name, r_regionkey AS key, NULL AS nation FROM region UNION ALL SELECT NULL, n_regionkey, n_name FROM nation")
def union_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns of all parts, those of the first first."""
    a, b = table(spark, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("key")), table(spark, d, "nation").select(F.col("n_name").alias("nation"), F.col("n_regionkey").alias("key"))
    return ex.union_columns([a, b]).select("name", "key", "nation")


VALUES_SQL = ", ".join(f"('{n}', {e}, {w})" for n, e, w in (("ttft", ALL["ttft_ms"][0], "1"), ("ttfo", ALL["ttfo_ms"][0], "1"), ("e2e", ALL["request_latency_s"][0], "1"), ("tpot", ALL["tpot_ms"][0], "output_tokens"), ("itl", ALL["itl_ms"][0], "output_tokens - 1")))
POINTS_SQL = f"""{LIFE}, vals AS (SELECT run_index, metric, round(CAST(coalesce(value, 0) AS DOUBLE), 6) AS value, CAST(weight AS BIGINT) AS weight FROM life, LATERAL (VALUES {VALUES_SQL}) v(metric, value, weight) WHERE status = 'successful'), {summary_sql('vals', 'run_index, metric')},
tok AS (SELECT run_index, 'prompt' AS metric, first_token_us AS t, CAST(prompt_tokens AS DOUBLE) AS w FROM life
  UNION ALL SELECT run_index, 'output', CASE WHEN token_iterations <= 1 THEN last_token_us ELSE first_token_us END, CASE WHEN token_iterations <= 1 THEN output_tokens ELSE 1.0 END FROM life
  UNION ALL SELECT run_index, 'output', first_token_us + CAST(floor((last_token_us - first_token_us) * i / (token_iterations - 1)) AS BIGINT), (output_tokens - 1) / (token_iterations - 1) FROM life, range(1, 8) x(i) WHERE i < token_iterations AND output_tokens > 1),
ends AS (SELECT * FROM tok UNION ALL SELECT run_index, 'total', t, w FROM tok UNION ALL SELECT run_index, 'requests', end_us, 1.0 FROM life
  UNION ALL SELECT run_index, 'level', start_us, 1.0 FROM life UNION ALL SELECT run_index, 'level', end_us, -1.0 FROM life), {rate_sql('ends', 'run_index, metric')},
lv AS (SELECT run_index, greatest(0, sum(w) OVER o) AS level, lead(t) OVER o - t AS us FROM points WHERE metric = 'level' WINDOW o AS (PARTITION BY run_index ORDER BY t)),
conc AS (SELECT run_index, sum(level * us) / sum(us) AS c FROM lv WHERE us IS NOT NULL GROUP BY 1), counts AS (SELECT run_index, count(*) FILTER (status = 'successful') AS successful, count(*) FILTER (status = 'incomplete') AS incomplete, count(*) FILTER (status = 'errored') AS errored, count(*) AS total_requests FROM life GROUP BY 1),
rates AS (SELECT run_index, """ + ", ".join(f"max(CASE WHEN metric = '{m}' THEN mean END) AS {n}" for m, n in (("requests", "request_rate"), ("total", "total_tps"), ("prompt", "input_tps"), ("output", "output_tps"))) + """ FROM (SELECT run_index, metric, sum(w) / sum(duration) AS mean FROM dur GROUP BY 1, 2) GROUP BY 1),
lat AS (SELECT run_index, """ + ", ".join(f"round(max(CASE WHEN metric = '{m}' THEN {q} END) * {1000 if m == 'e2e' else 1}, 4) AS {m}_{n}_ms" for m in ("ttft", "ttfo", "e2e", "tpot", "itl") for q, n in (("p50", "median"), ("p95", "p95"))) + """ FROM summary GROUP BY 1),
pts AS (SELECT run_index, round(request_rate, 4) AS request_rate, round(c, 4) AS concurrency, round(total_tps, 4) AS total_tps, round(input_tps, 4) AS input_tps, round(output_tps, 4) AS output_tps, lat.* EXCLUDE (run_index), successful, incomplete, errored, total_requests FROM counts JOIN rates USING (run_index) JOIN conc USING (run_index) JOIN lat USING (run_index))"""


def token_points_by_run(spark: SparkSession, d: str) -> DataFrame:
    r = rq.requests(spark, d)
    p = r.select("run_index", F.explode(F.array(F.struct(F.lit("prompt").alias("metric"), rq.prompt_points().alias("p")), F.struct(F.lit("output").alias("metric"), rq.output_points().alias("p")))).alias("m"))
    p = p.select("run_index", "m.metric", F.explode("m.p").alias("p")).groupBy("run_index", "metric", F.col("p.t").alias("t")).agg(F.sum("p.w").alias("w"))
    return ds.under_total(p, "metric")


def points(spark: SparkSession, d: str) -> DataFrame:
    r = rq.with_metrics(life(spark, d)).withColumn("ttfo_ms", F.expr(ALL["ttfo_ms"][0]))
    return ex.run_points(r, token_points_by_run(spark, d))


@query(f"WITH RECURSIVE {POINTS_SQL} SELECT * FROM pts")
def run_points(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d)


LINES = ("ttft_median_ms", "e2e_p95_ms", "total_tps")
SIMPLE_SQL = f"""{LIFE}, src AS (SELECT run_index, status, latency_us AS value, 1 AS weight FROM life WHERE status = 'successful'), {summary_sql('src', 'run_index, status')},
span AS (SELECT run_index, count(*) AS total_requests, count(*) FILTER (status = 'errored') AS errored, round(count(*) / ((max(end_us) - min(start_us)) / 1e6), 9) AS rate, round(sum(output_tokens) / ((max(end_us) - min(start_us)) / 1e6), 9) AS tps FROM life GROUP BY 1),
pts AS (SELECT run_index, rate, tps, CAST(p50 AS DOUBLE) AS p50, CAST(p95 AS DOUBLE) AS p95, total_requests, errored FROM span JOIN summary USING (run_index))"""


def simple_points(spark: SparkSession, d: str) -> DataFrame:
    """(run_index, rate, tps, p50, p95, total_requests, errored), for the tables of the charts."""
    r = rq.requests(spark, d)
    span = (F.max("end_us") - F.min("start_us")) / 1e6
    a = r.groupBy("run_index").agg(F.count(F.lit(1)).alias("total_requests"), F.count(F.when(F.col("status") == "errored", 1)).alias("errored"), F.round(F.count(F.lit(1)) / span, 9).alias("rate"), F.round(F.sum("output_tokens") / span, 9).alias("tps"))
    s = ds.value_summary(r.where("status = 'successful'").select("run_index", F.col("latency_us").alias("value")), ["run_index"])
    return a.join(s.select("run_index", F.col("p50").cast("double").alias("p50"), F.col("p95").cast("double").alias("p95")), "run_index")


LONG_SQL = "long AS (" + " UNION ALL ".join(f"SELECT run_index, rate, '{m}' AS metric, {m} AS y FROM pts" for m in ("p50", "p95", "tps")) + ")"


@query(f"WITH {SIMPLE_SQL}, {LONG_SQL} SELECT metric, row_number() OVER (PARTITION BY metric ORDER BY rate) AS place, rate AS x, y FROM long")
def metric_lines(spark: SparkSession, d: str) -> DataFrame:
    return ex.metric_lines(simple_points(spark, d), "rate", ["p50", "p95", "tps"])


@query(f"WITH {SIMPLE_SQL}, {LONG_SQL} SELECT metric, round((arg_min(y, rate) + arg_max(y, rate)) / 2, 0) AS slo FROM long GROUP BY 1")
def default_slos(spark: SparkSession, d: str) -> DataFrame:
    return ex.default_slos(simple_points(spark, d), "rate", ["p50", "p95", "tps"])


@query(f"WITH {SIMPLE_SQL}, {LONG_SQL} SELECT metric, ceil(min(rate) * 100) / 100 AS min_x, floor(max(rate) * 100) / 100 AS max_x, ceil(min(y) * 100) / 100 AS min_y, floor(max(y) * 100) / 100 AS max_y FROM long GROUP BY 1")
def axis_bounds(spark: SparkSession, d: str) -> DataFrame:
    return ex.axis_bounds(metric_lines(spark, d))


@query(f"WITH {SIMPLE_SQL} SELECT run_index, unnest(['p50', 'p95']) AS series, unnest([p50, p95]) AS value FROM pts")
def detail_lines(spark: SparkSession, d: str) -> DataFrame:
    return ex.detail_lines(simple_points(spark, d), ["run_index"], ["p50", "p95"])


@query(f"WITH {SIMPLE_SQL}, top AS (SELECT * FROM pts ORDER BY tps DESC, run_index LIMIT 1) SELECT unnest(['p50', 'p95']) AS part, unnest([p50, p95]) AS value FROM top")
def peak_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return ex.breakdown(simple_points(spark, d), ["p50", "p95"], "tps")


@query(f"WITH {SIMPLE_SQL} SELECT run_index, tps, p95, row_number() OVER (ORDER BY tps, run_index) AS place FROM pts WHERE tps > 0 AND p95 > 0")
def latency_knee(spark: SparkSession, d: str) -> DataFrame:
    return ex.knee(simple_points(spark, d), "tps", "p95", "run_index")


@query(f"WITH {LIFE} SELECT run_index, count(*) FILTER (status = 'successful') AS successful, count(*) FILTER (status = 'incomplete') AS incomplete, count(*) FILTER (status = 'errored') AS errored, count(*) AS total_requests FROM life GROUP BY 1")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return ex.totals_by_status(rq.requests(spark, d), "run_index")


SPLINE_SQL = """k AS (SELECT metric, rate AS x, y, lead(rate) OVER w AS x1, lead(y) OVER w AS y1, lag(rate) OVER w AS x0, lag(y) OVER w AS y0 FROM long WINDOW w AS (PARTITION BY metric ORDER BY rate)),
g AS (SELECT *, x1 - x AS h, x - x0 AS hp, (y1 - y) / (x1 - x) AS s, (y - y0) / (x - x0) AS sp FROM k),
m AS (SELECT *, CASE WHEN sp IS NULL THEN s WHEN s IS NULL THEN sp WHEN sp * s <= 0 THEN 0 ELSE 3 * (hp + h) / ((2 * h + hp) / sp + (h + 2 * hp) / s) END AS m0 FROM g),
n AS (SELECT *, lead(m0) OVER (PARTITION BY metric ORDER BY x) AS m1 FROM m), at_ AS (SELECT (min(rate) + max(rate)) / 2 AS a FROM pts),
u AS (SELECT n.*, a, (a - x) / h AS t FROM n, at_ WHERE a >= x AND a < x1)
SELECT metric, round((2 * t ** 3 - 3 * t ** 2 + 1) * y + (t ** 3 - 2 * t ** 2 + t) * h * m0 + (3 * t ** 2 - 2 * t ** 3) * y1 + (t ** 3 - t ** 2) * h * m1, 4) AS y FROM u"""


@query(f"WITH {SIMPLE_SQL}, {LONG_SQL}, {SPLINE_SQL}")
def interpolated_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Between the runs, where the tangents decide."""
    p = simple_points(spark, d)
    lo, hi = p.agg(F.min("rate"), F.max("rate")).first()
    return ex.interpolated(p, "rate", ["p50", "p95", "tps"], (lo + hi) / 2).withColumn("y", F.round("y", 4))


@query("SELECT 'x' AS curve, x, y FROM (VALUES (1.5, 2.40625), (2.0, 4.0), (3.5, 12.354167)) v(x, y)")
def spline_between_knots(spark: SparkSession, d: str) -> DataFrame:
    """Worked out by hand through (1, 1), (2, 4), (3, 9), (4, 16): tangents 3, 3.75, 5.833333 and 7."""
    knots = spark.createDataFrame([("x", float(x), float(x * x)) for x in (1, 2, 3, 4)], "curve string, x double, y double")
    return report.spline(knots, ["curve"], [1.5, 2.0, 3.5])


@query("""SELECT doc_id, substr(text, 3) AS after_two, text[3:12] AS cut, regexp_matches(left(text, 1), '^[^\\p{L}\\p{N}\\s]$') AS punct,
  CASE WHEN length(text) > 0 THEN '<think>' || text || '</think>' END AS thought, CASE lang WHEN 'en' THEN 640 WHEN 'de' THEN 3840 END AS width, (1 + doc_id % 5) / (2.0 + doc_id % 3) AS ratio FROM documents""")
def text_scalars(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    size = sc.resolution(F.when(F.col("lang") == "en", "360P").when(F.col("lang") == "de", "4k").otherwise("x"))
    ratio = sc.aspect_ratio(F.concat_ws(":", (1 + F.col("doc_id") % 5).cast("string"), (2 + F.col("doc_id") % 3).cast("string")))
    return table(spark, d, "documents").select("doc_id", sc.filter_text(t, 2).alias("after_two"), sc.filter_text(t, 2, 10).alias("cut"), sc.is_punctuation(F.substring(t, 1, 1)).alias("punct"), sc.reasoning(t).alias("thought"), size["width"].alias("width"), ratio.alias("ratio"))


@query(f"WITH {REQUESTS}, o AS (SELECT run_index, status, count(*) AS n FROM requests GROUP BY 1, 2) SELECT run_index, status, n FROM o QUALIFY row_number() OVER (ORDER BY n DESC, run_index, status) <= 7")
def sorted_points(spark: SparkSession, d: str) -> DataFrame:
    n = rq.requests(spark, d).groupBy("run_index", "status").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), "run_index", "status").limit(7)
