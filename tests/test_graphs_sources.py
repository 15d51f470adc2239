"""Branched graphs, tool turns, containers, synthetic data and live saturation, against small cases worked out by hand."""

import io
import sqlite3
import tarfile

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkgauge.operators import chats, graphs
from sparkgauge.sources import containers, readers, synthetic
from sparkgauge.operators.saturation import saturated_at
from sparkgauge.streaming.saturation import saturation


def test_merging_branch(spark):
    nodes, edges = graphs.branches(spark, 2, 3, [(0, 1, 2)])
    got = {r.node: r.turn_index for r in graphs.turn_indices(nodes, edges, "graph_id", "node").where("graph_id = 1").collect()}
    assert got == {"main_0": 0, "main_1": 1, "main_2": 2, "branch_0_0": 0}
    got = {r.node: r.history for r in graphs.histories(nodes, edges, "graph_id", "node").where("graph_id = 0").collect()}
    assert got["main_2"] == ["main_0", "main_1", "branch_0_0"] and got["main_0"] == [] == got["branch_0_0"]
    with pytest.raises(ValueError):
        graphs.branches(spark, 1, 3, [(0, 1, 3)])


@pytest.mark.parametrize("size", [1, 3, 4])
def test_cycles_end_with_an_error(spark, size):
    edges = spark.createDataFrame([(1, i, (i + 1) % size, "full") for i in range(size)], "k long, source long, target long, history string")
    with pytest.raises(ValueError):
        graphs.ancestry(edges, "k")
    with pytest.raises(ValueError):
        graphs.levels(spark.createDataFrame([(1, i) for i in range(size)], "k long, node long"), edges, "k", "node")


@pytest.mark.parametrize("most", [0, 100_000])
def test_levels_of_either_way(spark, most):
    nodes, edges = graphs.branches(spark, 3, 4, [(0, 2, 3), (1, 1, None)])
    got = {(r.graph_id, r.node): r.level for r in graphs.levels(nodes, edges, "graph_id", "node", most).collect()}
    one = {"main_0": 0, "main_1": 1, "main_2": 2, "main_3": 3, "branch_0_0": 1, "branch_0_1": 2, "branch_1_0": 2}
    assert got == {(g, n): v for g in range(3) for n, v in one.items()}
    with pytest.raises(ValueError):
        graphs.levels(nodes.where("node <> 'main_0'"), edges, "graph_id", "node", most).count()


def test_turns_of_a_very_long_chain(spark):
    """Twenty thousand turns: a row a node in each of some fifteen rounds, where all pairs would be two hundred million."""
    n = 20_000
    nodes = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("node"))
    edges = nodes.where("node > 0").select("k", (F.col("node") - 1).alias("source"), F.col("node").alias("target"), F.lit("full").alias("history"))
    led = spark.createDataFrame([(1, 5, 0, "last"), (1, 3, 9, "last")], edges.schema)
    got = graphs.turn_indices(nodes, edges.unionByName(led), "k", "node")
    assert got.where(F.col("turn_index") != F.col("node") + 1).count() == 0 and got.count() == n
    with pytest.raises(ValueError):
        graphs.turn_indices(nodes, edges.unionByName(spark.createDataFrame([(1, n - 1, 0, "full")], edges.schema)), "k", "node").count()


def test_long_chain(spark):
    edges = spark.createDataFrame([(1, i, i + 1, "full") for i in range(40)], "k long, source long, target long, history string")
    got = graphs.ancestry(edges, "k").groupBy("node").agg(F.count("*").alias("n"), F.max("distance").alias("d")).collect()
    assert {r.node: (r.n, r.d) for r in got} == {i: (i, i) for i in range(1, 41)}


def test_tool_turns(spark):
    turns = spark.createDataFrame([(1, "t0", True, "yes", 9), (1, "t1", False, None, 4)], "k long, node string, is_tool boolean, tool_response string, output_tokens long")
    edges = spark.createDataFrame([(1, "t0", "t1", "full")], "k long, source string, target string, history string")
    t, e = graphs.expand_tools(turns, edges, "k", "node")
    assert {tuple(r) for r in e.collect()} == {(1, "t0_injection", "t1", "full"), (1, "t0", "t0_injection", "full")}
    assert {(r.node, r.tool_response, r.output_tokens, r.injected) for r in t.collect()} == {("t0", None, None, False), ("t0_injection", "yes", 9, True), ("t1", None, 4, False)}


def test_chat_columns(spark):
    df = spark.createDataFrame([(["a", "b"], ["x"], '{"usage":{"completion_tokens":7,"completion_tokens_details":{"text_tokens":5},"prompt_tokens":0}}')], "t array<string>, i array<string>, body string")
    r = df.select(chats.round_robin({"text": F.col("t"), "image": F.col("i")}).alias("p"), chats.usage("body", "completion").alias("c"), chats.usage("body", "prompt").alias("n"), chats.tool_messages(F.col("t"), F.col("i")).alias("m"), chats.embedding_input(F.col("i")).alias("e")).first()
    assert [tuple(x) for x in r.p] == [("text", "a"), ("image", "x"), ("text", "b")]
    assert (r.c, r.n, r.e) == (5, None, '{"input":"x"}')
    assert [tuple(x) for x in r.m] == [("a", "x"), ("b", chats.NO_RESPONSE)]


def test_containers(spark, tmp_path):
    t = pa.table({"a": [1, 2], "b": ["x", None]})
    with pa.ipc.new_file(f"{tmp_path}/f.arrow", t.schema) as w:
        w.write_table(t)
    with pa.ipc.new_stream(f"{tmp_path}/s.arrow", t.schema) as w:
        w.write_table(t)
    assert sorted(map(tuple, readers.read(spark, "arrow_file", f"{tmp_path}/*.arrow", schema="a long, b string").collect()), key=str) == [(1, "x"), (1, "x"), (2, None), (2, None)]
    con = sqlite3.connect(f"{tmp_path}/d.db")
    con.execute("CREATE TABLE p (prompt TEXT, n INT)")
    con.execute("INSERT INTO p VALUES ('hi', 3), ('yo', 4)")
    con.commit()
    con.close()
    assert sorted(map(tuple, readers.read(spark, "db_file", f"{tmp_path}/d.db", schema="prompt string, n long", query="SELECT * FROM p").collect())) == [("hi", 3), ("yo", 4)]
    with tarfile.open(f"{tmp_path}/w.tar", "w") as f:
        for name, data in (("a.txt", b"one"), ("a.bin", b"\0"), ("b.txt", b"two")):
            m = tarfile.TarInfo(name)
            m.size = len(data)
            f.addfile(m, io.BytesIO(data))
    got = readers.read(spark, "tar_file", f"{tmp_path}/w.tar", schema="__key__ string, txt string, bin binary").collect()
    assert sorted((r["__key__"], r.txt, r.bin and bytes(r.bin)) for r in got) == [("a", "one", b"\0"), ("b", "two", None)]


def test_traces(spark):
    wrapped = spark.createDataFrame([("x", '[{"t": 1.0, "n": 130}, {"t": 2.0, "n": 64}]'), ("y", '[{"t": 5.0, "n": 1}]')], "name string, requests string")
    got = containers.unwrap(wrapped, {"t": "double", "n": "bigint"})
    assert sorted((r.t, r.n) for r in got.collect()) == [(1.0, 130), (2.0, 64), (5.0, 1)] and got.select("conversation").distinct().count() == 2
    with pytest.raises(ValueError):
        containers.unwrap(wrapped, {"missing": "bigint"})


def test_synthetic(spark):
    make = lambda: synthetic.conversations(spark, 300, 2, {"mean": 40, "spread": 9.0}, {"mean": 5, "least": 2, "most": 8}, [(1, 3), (3, 4)], seed=4)
    rows = make().repartition(3).orderBy("conv_id", "turn").collect()
    assert rows == make().orderBy("conv_id", "turn").collect() and len({r.prompt for r in rows}) == 600
    assert all(len(r.prompt.split()) == r.prompt_tokens and 1 <= r.prompt_tokens <= 85 for r in rows)
    assert {r.output_tokens_count for r in rows} == set(range(2, 9))
    assert 38 < sum(r.prompt_tokens for r in rows) / 600 < 42
    first = [len(r.prefix.split()) for r in rows if r.turn == 0]
    assert 0.6 < first.count(4) / 300 < 0.9 and all(r.prefix is None for r in rows if r.turn)


def test_live_saturation(spark, tmp_path):
    schema = "run_index long, t_s double, kind string, value double"
    for part, (a, z) in enumerate(((0, 60), (60, 200))):
        bad = [(1, float(t), "started", float(t)) for t in range(a, z)] + [(1, float(t), "first", 3 + t / 10) for t in range(a, z)]
        calm = [(2, float(t), "started", 5.0) for t in range(a, z)] + [(2, float(t), "first", 0.2) for t in range(a, z)]
        pd.DataFrame(bad + calm, columns=["run_index", "t_s", "kind", "value"]).to_parquet(f"{tmp_path}/{part}.parquet")
    stream = saturation(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path)))
    q = stream.writeStream.format("memory").queryName("live_saturation").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = spark.table("live_saturation").orderBy("run_index", "at_s", "kind").collect()
    assert len(rows) == 800 and [r.saturated for r in rows if r.at_s == 199] == [True, True, False, False]
    assert not any(r.saturated for r in rows if r.run_index == 2 or r.at_s < 30)
    assert [r.n_started for r in rows if r.at_s == 199 and r.kind == "started"] == [121, 121]  # of 200, by age
    # The batch form gives the same at every point.
    points = spark.read.schema(schema).parquet(str(tmp_path)).withColumn("t_us", (F.col("t_s") * 1e6).cast("long")).withColumn("request_id", F.col("t_us"))
    whole = points.withColumn("value", F.when(F.col("kind") == "first", F.round(F.col("value") * 1e6)).otherwise(F.col("value")).cast("long"))
    batch = saturated_at(whole, ["run_index"]).orderBy("run_index", "t_us", "kind").collect()
    assert [(r.run_index, r.kind, r.n_started, r.n_first, r.n_late, r.saturated) for r in batch] == [(r.run_index, r.kind, r.n_started, r.n_first, r.n_late, r.saturated) for r in rows]


def test_saturation_of_crooked_series(spark, tmp_path):
    """Uneven times and values, late and missing ones: the stream over three files equals the batch over all of them."""
    r = np.random.default_rng(8)
    t = np.cumsum(r.exponential(0.7, 400)).round(3)
    rows = [(1, float(x), ("started", "first")[int(k)], float(max(0, 3 * np.sin(x / 40) * 5 + x / 8 + r.normal()))) for x, k in zip(t, r.integers(0, 2, 400), strict=True)]
    for part in range(3):
        pd.DataFrame(rows[part * 134 : part * 134 + 134] + [(1, None, "first", 1.0), (1, 5.0, "other", 1.0)], columns=["run_index", "t_s", "kind", "value"]).to_parquet(f"{tmp_path}/{part}.parquet")
    schema = "run_index long, t_s double, kind string, value double"
    options = {"age_s": 60.0, "most_ttft_s": 12.0, "most_error": 1.0}
    units = spark.read.schema(schema).parquet(str(tmp_path)).withColumns({"t_us": F.round(F.col("t_s") * 1e6).cast("long"), "value": F.round(F.when(F.col("kind") == "first", F.col("value") * 1e6).otherwise(F.col("value"))).cast("long")})
    batch = saturated_at(units.withColumn("request_id", F.col("t_us")), ["run_index"], **options).orderBy("t_us").collect()
    # The stream takes the same whole numbers.
    for part in range(3):
        f = pd.read_parquet(f"{tmp_path}/{part}.parquet")
        f["value"] = np.where(f["kind"] == "first", f["value"].mul(1e6).round() / 1e6, f["value"].add(0.5).floordiv(1))
        f.to_parquet(f"{tmp_path}/{part}.parquet")
    stream = saturation(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path)), **options)
    q = stream.writeStream.format("memory").queryName("crooked").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    live = spark.table("crooked").orderBy("at_s").collect()
    assert len(live) == len(batch) == 400 and 20 < sum(x.saturated for x in live) < 380
    assert [(x.kind, x.n_started, x.n_first, x.n_late, x.saturated) for x in live] == [(x.kind, x.n_started, x.n_first, x.n_late, x.saturated) for x in batch]
