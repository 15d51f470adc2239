"""Stopping constraints, phases and saturation over finished requests, in event time."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.student import t_quantile, two_sided
from .ordered import running_sum

def failed() -> Column:
    return F.when(F.col("status") == "errored", 1).otherwise(0)


def counted(r: DataFrame, keys: list[str]) -> DataFrame:
    """Finished requests with seq and errs: how many have ended, and how many of these with an error, itself included."""
    x = running_sum(r.withColumns({"_one": F.lit(1), "_bad": failed()}), keys, "end_us", {"seq": "_one", "errs": "_bad"}, ties=("request_id",))
    return x.drop("_one", "_bad")


def recent_rate(o: DataFrame, window: int, keys: list[str], name: str = "rate") -> DataFrame:
    """Adds the share of errors in the last `window` of counted requests.

    The requests are dealt to blocks of at least `window` by their number, and the last of each block go to the next one as
    well, so a block's own window holds all that a request looks back on.
    """
    size = max(4096, window)
    block = F.floor((F.col("seq") - 1) / size)
    late = (F.col("seq") - 1) % size >= size - window
    o = o.withColumn("_block", F.explode(F.when(late, F.array(block, block + 1)).otherwise(F.array(block))))
    w = Window.partitionBy(*keys, "_block").orderBy("seq")
    x = o.withColumn("_before", F.lag("errs", window).over(w)).where(F.col("_block") == block)
    return x.withColumn(name, (F.col("errs") - F.coalesce("_before", F.lit(0))) / F.least("seq", F.lit(window))).drop("_before", "_block")


def error_rate(r: DataFrame, most: float, window: int, keys=("run_index",)) -> DataFrame:
    """Adds seq, rate over the last `window` finished requests, and whether it stops the run."""
    out = recent_rate(counted(r, list(keys)), window, list(keys)).drop("errs")
    return out.withColumn("triggered", (F.col("rate") >= most) & (F.col("seq") >= window))


def first_triggers(r: DataFrame, max_requests=None, max_errors=None, max_duration_us=None, max_error_rate=None, max_global_error_rate=None, keys=("run_index",)) -> DataFrame:
    """(keys, name, seq): the first finished request at which each constraint triggers, where it does."""
    keys = list(keys)
    begin = r.groupBy(*keys).agg(F.min("start_us").alias("_begin"))
    o = counted(r, keys).join(begin, keys)
    when = {}
    if max_requests is not None:
        when["max_requests"] = F.col("seq") >= max_requests
    if max_errors is not None:
        when["max_errors"] = F.col("errs") >= max_errors
    if max_duration_us is not None:
        when["max_duration"] = F.col("end_us") - F.col("_begin") >= max_duration_us
    if max_global_error_rate is not None:
        rate, least = max_global_error_rate
        when["max_global_error_rate"] = (F.col("errs") >= rate * F.col("seq")) & (F.col("seq") >= least)
    if max_error_rate is not None:
        rate, window = max_error_rate
        o = recent_rate(o, window, keys, "_recent")
        when["max_error_rate"] = (F.col("_recent") >= rate) & (F.col("seq") >= window)
    s = o.groupBy(*keys).agg(*(F.min(F.when(c, F.col("seq"))).alias(n) for n, c in when.items()))
    return s.unpivot(keys, list(when), "name", "seq").where("seq is not null")


def per_benchmark(values: list, index: Column) -> Column:
    """The value for a benchmark's index; the last one serves all further ones."""
    return F.element_at(F.array(*map(F.lit, values)), F.least(index + 1, F.lit(len(values))).cast("int"))


def slope(r: DataFrame, keys: list[str], x: str = "start_us", y: str = "latency_us", confidence: float = 0.95, most_error: float = 2.0) -> DataFrame:
    """Least-squares slope of y (s) over x (s from the start): n, slope, standard error, relative margin, alert."""
    begin = r.groupBy(*keys).agg(F.min(x).alias("_x0"))
    p = r.join(begin, keys).select(*keys, ((F.col(x) - F.col("_x0")) / 1e6).alias("x"), (F.col(y) / 1e6).alias("y"))
    s = p.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"))
    s = s.withColumn("slope", F.col("sxy") / F.greatest("sxx", F.lit(1e-12)))
    rss = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.greatest("sxx", F.lit(1e-12)), F.lit(0.0))
    s = s.withColumn("se", F.when(F.col("n") > 2, F.sqrt(rss / (F.col("n") - 2) / F.greatest("sxx", F.lit(1e-12)))))
    s = s.withColumn("margin", t_quantile(two_sided(confidence), F.col("n") - 2) * F.col("se") / F.greatest("slope", F.lit(1e-12)))
    return s.withColumn("alert", F.coalesce((F.col("slope") > 0) & (F.col("margin") < most_error), F.lit(False))).drop("sxx", "syy", "sxy")


def phases(r: DataFrame, warmup: float, cooldown: float, keys=("run_index",)) -> DataFrame:
    """Adds phase. Values below 1 are shares of the run, others seconds."""
    keys = list(keys)
    ends = r.groupBy(*keys).agg(F.min("start_us").alias("_lo"), F.max("end_us").alias("_hi"))
    length = F.col("_hi") - F.col("_lo")
    part = lambda x: F.floor(length * x) if 0 < x < 1 else F.lit(int(x * 1_000_000))
    if 0 < warmup < 1 and (1 / warmup).is_integer():
        part = lambda x: F.expr(f"(_hi - _lo) div {round(1 / x)}") if 0 < x < 1 else F.lit(int(x * 1_000_000))
    x = r.join(F.broadcast(ends) if not keys else ends, keys)
    phase = F.when(F.col("end_us") < F.col("_lo") + part(warmup), "warmup").when(F.col("start_us") > F.col("_hi") - part(cooldown), "cooldown").otherwise("active")
    return x.withColumn("phase", phase).drop("_lo", "_hi")


def state_counts(r: DataFrame, keys=("run_index",)) -> DataFrame:
    """Running counts after every start and end of a request: created, processed, errored, processing."""
    e = r.select(*keys, "request_id", "status", F.explode(F.array(F.struct(F.col("start_us").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end_us").alias("t"), F.lit(-1).alias("d")))).alias("e")).select(*keys, "request_id", "status", "e.*")
    is_end = F.col("d") == -1
    e = e.withColumns({"_start": F.when(is_end, 0).otherwise(1), "_end": F.when(is_end, 1).otherwise(0), "_bad": F.when(is_end, failed()).otherwise(0)})
    out = running_sum(e, list(keys), "t", {"created": "_start", "processed": "_end", "errored": "_bad"}, ties=("d", "request_id")).drop("_start", "_end", "_bad")
    return out.withColumn("processing", F.col("created") - F.col("processed"))
