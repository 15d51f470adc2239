"""Operators against results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from sparkgauge.functions import scalars
from sparkgauge.operators import conversations as cv
from sparkgauge.operators import distribution as ds
from sparkgauge.operators import preprocess as pp
from sparkgauge.sources import readers
from sparkgauge.streaming import runs

from .conftest import SMALL


def test_weighted_summary(spark):
    rows = [(0, 10, 1), (0, 20, 2), (0, 30, 3), (0, 40, 2), (0, 50, 1)]
    r = ds.value_summary(spark.createDataFrame(rows, "k int, value long, weight long"), ["k"], weight="weight").first()
    assert (r["count"], r["mean"], r["mode"], r.p50, r.p25, r.p90, r.total_sum) == (9, 30, 30, 30, 20, 50, 270) and abs(r.variance - 1200 / 9) < 1e-9
    r = ds.value_summary(spark.createDataFrame([(0, x) for x in (3, 1, 3, 1)], "k int, value long"), ["k"]).first()
    assert r["mode"] == 1
    assert ds.value_summary(spark.createDataFrame([], "k int, value long"), ["k"]).count() == 0


def test_concurrency(spark):
    spans = spark.createDataFrame([(0, 1_000_000, 5_000_000), (0, 2_000_000, 6_000_000), (0, 3_000_000, 7_000_000)], "k int, start_us long, end_us long")
    got = sorted((r.t, r.level, r.duration_us) for r in ds.concurrency_levels(spans, ["k"]).collect())
    assert [x[1:] for x in got] == [(1, 10**6), (2, 10**6), (3, 2 * 10**6), (2, 10**6), (1, 10**6)]
    s = ds.concurrency_summary(spans, ["k"]).first()
    assert (s["count"], s["mean"], s["max"]) == (3, 2, 3)


def test_pivot_turns(spark):
    x = spark.createDataFrame([(1, 0, ["a", "b"]), (1, 1, ["c"])], "k int, turn int, v array<string>")
    assert sorted((r.i, r.v) for r in cv.pivot_turns(x, "k", "turn", "v").collect()) == [(0, ["a", "c"]), (1, ["b"])]


def test_graph_checks(spark):
    nodes = spark.createDataFrame([(1, "a"), (1, "b")], "g int, node string")
    edges = spark.createDataFrame([(1, "a", "b", "full"), (1, "c", "b", "full")], "g int, source string, target string, history string")
    assert [r.source for r in cv.dangling(nodes, edges, "g", "node").collect()] == ["c"]
    assert [r.n for r in cv.crowded(edges, "g").collect()] == [2]
    assert [r.source for r in cv.subgraph(edges, nodes, "g", "node").collect()] == ["a"]


def test_scalars(spark):
    r = spark.range(1).select(
        scalars.safe_divide(F.lit(None).cast("double"), F.lit(0)).alias("a"), scalars.safe_add(F.lit(3), F.lit(None).cast("int"), F.lit(2), signs=[1, 1, -1]).alias("b"), scalars.format_number(F.lit(None)).alias("c"),
        scalars.format_time(F.lit(-1)).alias("d"), scalars.clean_text(F.lit(" a  b\n")).alias("e"), scalars.endless(F.array(F.lit("x"), F.lit("y")), F.lit(3)).alias("f"), scalars.split_text(F.lit("hi, you."), True).alias("g"),
        *(c.alias(n) for c, n in zip(scalars.fit(F.lit(200), F.lit(100), 100, 100), "hi", strict=True)),
    ).first()
    assert tuple(r) == (0.0, 1, "--", "N/A", "a b", "x y x", ["hi", ",", "you", "."], 100, 50)


def test_preprocess_errors(spark):
    x = spark.createDataFrame([("a b",)], "text string")
    with pytest.raises(ValueError):
        pp.pad_short(x, "text", 3, " ")
    with pytest.raises(Exception, match="fewer than 3"):
        pp.fail_short(x, "text", 3).collect()


def test_readers(spark, tmp_path):
    x = readers.read(spark, "in_memory_dict", {"a": [1, 2], "b": ["x", "y"]})
    for kind in ("csv", "jsonl", "parquet"):
        readers.save(x, path := str(tmp_path / f"out.{kind}"))
        assert sorted((r.a, r.b) for r in readers.read(spark, kind, path).collect()) == [(1, "x"), (2, "y")]
    for bad in ({}, {"a": [1], "b": []}):
        with pytest.raises(ValueError):
            readers.read(spark, "in_memory_dict", bad)
    assert [r.data for r in readers.read(spark, "IN_MEMORY_ITEM_LIST", [7]).collect()] == [7]
    assert readers.split_of(["x", "val", "train"]) == "train" and readers.split_of(["x"]) == "x"
    with pytest.raises(ValueError):
        readers.save(x, str(tmp_path / "out.xls"))
    t = spark.createDataFrame([(0.5, 10, -1)], "t double, i int, o int")
    with pytest.raises(Exception, match="negative"):
        readers.trace(t, "t", "i", "o").collect()


def test_stream_equals_batch(spark, tmp_path):
    folder = str(tmp_path / "events")
    spark.read.parquet(f"{SMALL}/events.parquet").repartition(3).write.parquet(folder)
    stream = runs.windowed_stats(runs.read_requests(spark, folder), late="10000 days")
    q = stream.writeStream.format("memory").queryName("windowed").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = spark.table("windowed").groupBy("window_start", "status").agg(F.max("n").alias("n"))
    total = last.agg(F.sum("n")).first()[0]
    assert total == spark.read.parquet(folder).count()
