"""Report files and tables: statistics blocks, wide CSV with three header lines, JSON and its load, console lines, chart points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import distribution as ds

#: The percentiles of a CSV report, between minimum and maximum.
LISTED = ("p001", "p01", "p05", "p10", "p25", "p75", "p90", "p95", "p99")
#: Statistics of a block, in order.
BLOCK = ("Mean", "Median", "Std Dev", "Percentiles")


def percentile_list(show=lambda c: c.cast("string")) -> Column:
    """[min, percentiles, max] of a summary as a string."""
    return F.concat(F.lit("["), F.concat_ws(", ", *(show(F.col(c)) for c in ("min", *LISTED, "max"))), F.lit("]"))


def stats_block(s: DataFrame, keys: list[str], unit: str, places: int = 4, show=lambda c: c.cast("string")) -> DataFrame:
    """(keys, unit, name, value) of summaries by status: four statistics each; those whose sum is zero are left out, as is the total."""
    named = F.concat(F.initcap("status"), F.lit(f" {unit}"))
    number = lambda c: F.round(c, places).cast("decimal(38,4)").cast("string")
    values = (number(F.col("mean")), number(F.col("p50").cast("double")), number(F.sqrt("variance")), percentile_list(show))
    block = F.array(*(F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in zip(BLOCK, values, strict=True)))
    return s.where("status <> 'total' and total_sum <> 0").select(*keys, named.alias("unit"), F.explode(block).alias("b")).select(*keys, "unit", "b.*")


def used_modalities(s: DataFrame) -> DataFrame:
    """Summaries (metric, ..., count) of the metrics that counted something; tool calls are never shown."""
    return s.where((F.col("count") > 0) & (F.col("metric") != "tool_call"))


def wide(cells: DataFrame, key: str, names: list[tuple[str, str, str]]) -> DataFrame:
    """One row a key, a column for each (group, unit, name) in the given order; blanks where a key has none."""
    label = lambda g, u, n: f"{g}|{u}|{n}"
    labels = [label(*x) for x in names]
    x = cells.withColumn("_c", F.concat_ws("|", "group", "unit", "name")).groupBy(key).pivot("_c", labels).agg(F.first("value"))
    return x.select(key, *(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in labels))


def union_columns(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts, with all their columns in the order in which they are first met."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def csv_lines(w: DataFrame) -> DataFrame:
    """(line, text): a wide report as CSV, of which the first three lines are the levels of the header; one row a benchmark."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    spark = w.sparkSession
    levels = [[(c.split("|") + ["", ""])[k] for c in w.columns] for k in range(3)]
    head = spark.createDataFrame([(k - 3, ",".join('"' + x.replace('"', '""') + '"' for x in row)) for k, row in enumerate(levels)], "line long, text string")
    body = w.select(F.row_number().over(Window.orderBy(w.columns[0])).cast("long").alias("line"), F.concat_ws(",", *(quoted(F.col(f"`{c}`")) for c in w.columns)).alias("text"))
    return head.unionByName(body)


def write_csv(w: DataFrame, path: str) -> None:
    """A report of a few benchmarks as one file."""
    csv_lines(w).coalesce(1).sortWithinPartitions("line").select("text").write.text(path)


def json_report(s: DataFrame, key: str) -> DataFrame:
    """(key, report): all columns of a key's rows as one JSON object."""
    others = [c for c in s.columns if c != key]
    return s.groupBy(key).agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(*others))).alias("rows"))).alias("report"))


def write_json(s: DataFrame, path: str) -> None:
    s.write.json(path)


def load_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A report of `write_json`, from a file or folder."""
    return spark.read.schema(schema).json(path)


def parse_report(reports: DataFrame, key: str, schema: str) -> DataFrame:
    """The rows of `json_report`."""
    return reports.select(key, F.inline(F.from_json("report", f"struct<rows:array<struct<{schema}>>>")["rows"]))


def console_lines(s: DataFrame, key: str, columns: dict[str, tuple[str, int]]) -> DataFrame:
    """(key, line): formatted values next to each other; columns: name to format and width."""
    cells = [F.lpad(F.format_string(f, F.col(c)), w, " ") for c, (f, w) in columns.items()]
    return s.select(key, F.concat_ws(" | ", *cells).alias("line"))


def html_payload(run: DataFrame, benchmarks: DataFrame, prompts: DataFrame) -> DataFrame:
    """(payload): run information, sample prompts and the benchmarks (a few rows each) as one JSON object."""
    one = lambda df, name: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))
    joined = one(run, "run_info").crossJoin(one(prompts, "workload_details")).crossJoin(one(benchmarks, "benchmarks"))
    return joined.select(F.to_json(F.struct("run_info", "workload_details", "benchmarks")).alias("payload"))


def inject(page: str, payload: str, mark: str = "</head>") -> str:
    """A page with the payload as a script before the end of its head; a page without one is an error."""
    if mark not in page:
        raise ValueError("the page has no head")
    return page.replace(mark, f"<script>window.report = {payload.replace('</', '<\\/')};</script>{mark}", 1)


def metric_lines(p: DataFrame, x: str, metrics: list[str]) -> DataFrame:
    """(metric, place, x, y): a line for each metric, in order of x; a missing value is zero."""
    long = p.unpivot([x], metrics, "metric", "y")
    return long.select("metric", F.row_number().over(Window.partitionBy("metric").orderBy(x)).alias("place"), F.col(x).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))


def default_slos(p: DataFrame, x: str, metrics: list[str]) -> DataFrame:
    """(metric, slo): half the sum of the first and the last run's values, rounded."""
    long = p.unpivot([x], metrics, "metric", "y")
    return long.groupBy("metric").agg(F.round((F.min_by("y", x) + F.max_by("y", x)) / 2, 0).alias("slo"))


def axis_bounds(lines: DataFrame) -> DataFrame:
    """(metric, min_x, max_x, min_y, max_y): minima rounded up and maxima down to two places."""
    up, down = lambda c: F.ceil(F.min(c) * 100) / 100, lambda c: F.floor(F.max(c) * 100) / 100
    return lines.groupBy("metric").agg(up("x").alias("min_x"), down("x").alias("max_x"), up("y").alias("min_y"), down("y").alias("max_y"))


def detail_lines(s: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, series, value): mean and percentiles as series."""
    return s.unpivot(keys, names, "series", "value")


def breakdown(p: DataFrame, parts: list[str], by: str) -> DataFrame:
    """(part, value) of the run with the largest `by`."""
    return p.orderBy(F.desc(by), p.columns[0]).limit(1).unpivot([], parts, "part", "value")


def knee(p: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """The points of x and y that a logarithmic axis can show, in order of x."""
    return p.where((F.col(x) > 0) & (F.col(y) > 0)).select(key, x, y, F.row_number().over(Window.orderBy(x, key)).alias("place"))


def interpolated(p: DataFrame, x: str, metrics: list[str], at: float) -> DataFrame:
    """(metric, y): each metric on a monotone curve through the runs at a rate; zero outside their range or with fewer than two."""
    from .report import spline

    long = p.unpivot([x], metrics, "metric", "y").select("metric", F.col(x).cast("double").alias("x"), F.coalesce(F.col("y").cast("double"), F.lit(0.0)).alias("y"))
    ends = long.groupBy("metric").agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    curve = spline(long, ["metric"], [at]).select("metric", F.col("y").alias("_y"))
    inside = (F.col("_n") >= 2) & (F.lit(at) >= F.col("_lo")) & (F.lit(at) <= F.col("_hi"))
    return ends.join(curve, "metric", "left").select("metric", F.when(inside, F.coalesce("_y", F.lit(0.0))).otherwise(F.lit(0.0)).alias("y"))


def totals_by_status(r: DataFrame, key: str) -> DataFrame:
    """(key, successful, incomplete, errored, total_requests)."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return r.groupBy(key).agg(n("successful"), n("incomplete"), n("errored"), F.count(F.lit(1)).alias("total_requests"))


def run_points(r: DataFrame, token_points: DataFrame, key: str = "run_index") -> DataFrame:
    """One row a run with its 19 figures: rates and concurrency over all requests, latencies over successful ones, counts by status."""
    ends = r.groupBy(key, F.col("end_us").alias("t")).agg(F.count(F.lit(1)).cast("double").alias("w")).withColumn("metric", F.lit("requests"))
    p = ds.rate_points(ends.unionByName(token_points), [key, "metric"], grouped=True)
    rate = p.groupBy(key, "metric").agg((F.sum("w") / F.sum("duration")).alias("v"))
    rate = rate.groupBy(key).pivot("metric", ["requests", "total", "prompt", "output"]).agg(F.first("v"))
    level = ds.concurrency_levels(r, [key]).groupBy(key).agg((F.sum(F.col("level") * F.col("duration_us")) / F.sum("duration_us")).alias("concurrency"))
    metrics = {"ttft": ("ttft_ms", F.lit(1)), "ttfo": ("ttfo_ms", F.lit(1)), "e2e": ("request_latency_s", F.lit(1)), "tpot": ("tpot_ms", F.col("output_tokens")), "itl": ("itl_ms", F.col("output_tokens") - 1)}
    long = r.where("status = 'successful'").select(key, F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.round(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), 6).alias("value"), w.cast("bigint").alias("weight")) for n, (c, w) in metrics.items()))).alias("m")).select(key, "m.*")
    s = ds.value_summary(long, [key, "metric"], weight="weight")
    s = s.groupBy(key).pivot("metric", list(metrics)).agg(F.first("p50").alias("p50"), F.first("p95").alias("p95"))
    ms = lambda n, q: F.round(F.coalesce(F.col(f"{n}_{q}"), F.lit(0.0)) * (1000 if n == "e2e" else 1), 4).alias(f"{n}_{'median' if q == 'p50' else q}_ms")
    x = totals_by_status(r, key).join(rate, key, "left").join(level, key, "left").join(s, key, "left")
    r4 = lambda c, n: F.round(F.coalesce(F.col(f"`{c}`"), F.lit(0.0)), 4).alias(n)
    rates = [r4("requests", "request_rate"), r4("concurrency", "concurrency"), r4("total", "total_tps"), r4("prompt", "input_tps"), r4("output", "output_tps")]
    return x.select(key, *rates, *(ms(n, q) for n in metrics for q in ("p50", "p95")), "successful", "incomplete", "errored", "total_requests")
