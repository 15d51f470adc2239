"""Greedy clusters over ranges against a walk over each key's times."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparkgauge.operators import clusters as cl, distribution as ds


def walk(points, threshold):
    by_key = defaultdict(lambda: defaultdict(float))
    for k, j, t, w in points:
        by_key[k, j][t] += w
    out = set()
    for key, times in by_key.items():
        heads, level = [], 0.0
        for t, w in sorted(times.items()):
            if not heads or t > heads[-1][0] + threshold:
                heads.append([t, 0.0, 0.0])
            level += w
            heads[-1][1] += w
            heads[-1][2] = level
        for i, (t, w, level) in enumerate(heads):
            out.add((*key, t, w, heads[i - 1][0] if i else None, heads[i + 1][0] if i + 1 < len(heads) else None, level))
    return out


def found(spark, points, threshold):
    df = spark.createDataFrame(points, "k string, j long, t long, w double")
    return {tuple(r) for r in cl.clusters(df, ["k", "j"], threshold).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_clusters(spark, seed):
    r = random.Random(seed)
    points = [(r.choice(["a", "b", None]), r.choice([1, None]), r.randrange(r.choice([300, 40_000])), float(r.randrange(-2, 5))) for _ in range(3000)]
    points += [("one", 1, 5, 1.0), ("far", 1, -(10**15), 1.0), ("far", 1, 10**15, 2.0)]
    points += [("dense", 1, t, 1.0) for t in range(r.choice([150, 5000]))]  # one chain over many ranges
    points += [("a", 1, 7, 1.0)] * 500  # a time of very many rows
    for threshold in (0, 1, 100, 50_000):
        assert found(spark, points, threshold) == walk(points, threshold)


def test_whole_ranges_within_one_cluster(spark):
    points = [("a", 1, t, 1.0) for t in range(60)] + [("b", 1, 5, 1.0)]
    assert found(spark, points, 100) == walk(points, 100) == {("a", 1, 0, 60.0, None, None, 60.0), ("b", 1, 5, 1.0, None, None, 1.0)}
    assert found(spark, [], 100) == set()


def test_a_long_chain_is_in_several_ranges(spark):
    """Three hundred thousand times without a gap over the threshold: every range has its part of them, and no list holds a chain."""
    n = 300_000
    df = spark.range(n).select(F.lit("k").alias("k"), (F.col("id") * 37).alias("t"), F.lit(1).alias("w"))
    got = cl.clusters(df, ["k"], 100)
    assert got.rdd.getNumPartitions() > 1 and got.groupBy(F.spark_partition_id()).count().count() > 1
    # 37, 74 lie within 100: every third time is a head.
    assert got.agg(F.count("*"), F.min("w"), F.max("w"), F.max("level"), F.sum(F.when(F.col("next_t") - F.col("t") == 111, 1))).first() == (n // 3, 3.0, 3.0, float(n), n // 3 - 1)


def test_jumps_keep_keys_apart(spark):
    spans = [("a", 0, 10, 1), ("a", 1, 5, 1), ("b", 2, 3, 1)]
    df = spark.createDataFrame(spans, "k string, start_us long, end_us long, n int")
    got = {tuple(r) for r in ds.concurrency_levels(df, ["k"], threshold=0).collect()}
    assert got == {("a", 0, 1, 1), ("a", 1, 2, 4), ("a", 5, 1, 5), ("b", 2, 1, 1)}


def test_grouped_points_give_the_same(spark):
    """Points under several totals without being summed up first; equal times are made one where they are walked."""
    r = random.Random(3)
    points = [(r.choice(["a", "b"]), r.choice([1, 2, None]), t, float(r.randrange(5))) for t in r.sample(range(40_000), 3000) for _ in range(r.choice([1, 2]))]
    df = ds.under_total(spark.createDataFrame(points, "k string, j long, t long, w double"), "k").repartition(3)
    want = {tuple(x) for x in cl.clusters(df, ["k", "j"], 100).collect()}
    got = cl.clusters(df, ["k", "j"], 100, grouped=True)
    assert {tuple(x) for x in got.collect()} == want == walk(points + [("total", *p[1:]) for p in points], 100)


def test_packed_ranges_come_back_in_order(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(cl, "PIECE", 25)
    batches = [pa.RecordBatch.from_pydict({"k": [str(i)] * 10, "t": list(range(10 * i, 10 * i + 10))}) for i in range(7)]
    pieces = list(cl.packed(iter([batches[0].slice(0, 0), *batches])))
    assert len(pieces) == 3 and sum(p.num_rows for p in pieces) == 3
    assert cl.unpacked(iter(pieces)).to_pydict() == pa.Table.from_batches(batches).to_pydict()
    assert cl.unpacked(iter([])) is None and not list(cl.packed(iter([])))
