"""Summaries of usage: sides at the same times are merged once, and no step has a key for each property alone."""

import random

import pytest
from pyspark.sql import functions as F

from sparkgauge.operators import clusters as cl, distribution as ds, summary as sm

PROPERTIES = {"text": ("a", "b"), "image": ("c", None), "calls": (None, "a"), "none": ("d", "d")}


@pytest.fixture(scope="module")
def used(spark):
    r = random.Random(5)
    rows = [(r.choice(["x", "y"]), s, s + r.randrange(900), r.randrange(9), r.choice([None, 3]), 2 * k if k % 3 else None, None) for k in range(400) for s in [r.randrange(20_000)]]
    return spark.createDataFrame(rows, "status string, start_us long, end_us long, a long, b long, c long, d long").cache()


def long(used):
    """A row for each sample under each side, and again under the status total."""
    sides = [("text", "input", "a"), ("text", "output", "b"), ("text", "total", "a"), ("text", "total", "b"), ("image", "input", "c"), ("calls", "output", "a")]
    x = used.select("status", "start_us", "end_us", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(s).alias("side"), F.col(c).cast("double").alias("value")) for m, s, c in sides))).alias("p"))
    return x.select("p.*", "start_us", "end_us", F.explode(F.array("status", F.lit("total"))).alias("status"))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*sm.KEYS, *columns).collect())


def test_concurrency_merges_times_once(spark, used, monkeypatch):
    asked = []
    monkeypatch.setattr(sm, "clusters", lambda points, keys, *rest: asked.append(keys) or cl.clusters(points, keys, *rest))
    got = rows(sm.concurrency(used, PROPERTIES, threshold=50), "t", "level", "duration_us")
    assert asked == [["status"]]
    x = long(used).withColumn("value", F.coalesce("value", F.lit(0.0)))
    points = x.select(*sm.KEYS, F.explode(F.array(F.struct(F.col("start_us").alias("t"), F.col("value").alias("w")), F.struct(F.col("end_us").alias("t"), (-F.col("value")).alias("w")))).alias("p")).select(*sm.KEYS, "p.*")
    assert got == rows(ds.levels_of(cl.clusters(points, sm.KEYS, 50), sm.KEYS), "t", "level", "duration_us")


def test_rates_merge_times_once(spark, used, monkeypatch):
    asked = []
    monkeypatch.setattr(ds, "clusters", lambda points, keys, *rest: asked.append(keys) or cl.clusters(points, keys, *rest))
    got = rows(sm.rates(used, PROPERTIES, threshold=50, start=1000, end=15_000), "t", "w", "duration")
    assert asked == [["status"]]
    x = long(used).select(*sm.KEYS, F.col("end_us").alias("t"), F.coalesce("value", F.lit(0.0)).alias("w"))
    assert got == rows(ds.rate_points(x, sm.KEYS, 50, 1000, 15_000), "t", "w", "duration")


def test_values_need_no_join_by_property(spark, used):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        x = sm.sided(used, PROPERTIES)
        assert "Join" not in x._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, x.where("value is not null").groupBy("metric", "side").count().collect())) == sorted(
            map(tuple, long(used).where("status <> 'total' and value is not null").groupBy("metric", "side").count().collect())
        )
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_no_side_has_a_value(spark, used):
    for x in (sm.sided(used, {"none": ("d", "d")}), sm.rates(used, {"none": ("d", "d")}), sm.concurrency(used, {"none": ("d", None)}), sm.rates(used.where("false"), PROPERTIES)):
        assert x.count() == 0
