"""Mapping, readers, registries, limits, exports and ordered frames: what SQL over the tables doesn't reach."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparkgauge import plugins
from sparkgauge.functions import scalars as sc
from sparkgauge.operators import blocks, chats, conversations, export, lifecycle, mapping, ordered, preprocess, schedule
from sparkgauge.sources import readers, synthetic


def test_resolve():
    found = mapping.resolve([("chat", ["id", "Prompts", "prompts-2", "PROMPTS", "systems", "answer"])])
    assert found == {("text_column", 0): [(0, "Prompts")], ("text_column", 2): [(0, "PROMPTS"), (0, "prompts-2")], ("prefix_column", 0): [(0, "systems")]}
    both = mapping.resolve([("a", ["prompt", "text"]), ("b", ["prompt", "text"])], {"text_column": ["b.text", "0.prompt"], "pooling_column": "prompt"})
    assert both == {("text_column", 0): [(0, "prompt"), (1, "text")], ("pooling_column", 0): [(0, "prompt"), (1, "prompt")]}
    assert mapping.resolve([("0", ["prompt"])], mapping.POOLING) == {("pooling_column", 0): [(0, "prompt")]}
    with pytest.raises(ValueError):
        mapping.resolve([("a", ["x"])])


def test_mapping_frames(spark):
    df = spark.createDataFrame([("q", "s", 3)], "question string, system string, n int")
    assert mapping.choose(df) == ("question", "system", "output_tokens_count")
    with pytest.raises(ValueError):
        mapping.choose(df.select("system"))
    turns = mapping.map_columns(df).first().turns
    assert [t.asDict() for t in turns] == [{"prefix_column": ["s"], "text_column": ["q"]}]
    for short, pad in (("pad", "x y"), ("ignore", ""), ("error", "")):
        out = preprocess.prepare(spark.createDataFrame([("a b c",), ("d",), ("",)], "text string"), F.lit(2), F.lit(1), short=short, pad=pad)
        if short == "error":
            with pytest.raises(PySparkException):
                out.collect()
        else:
            assert sorted(r.prompt for r in out.collect()) == (["a b", "d x", "x y"] if short == "pad" else ["a b"])
    with pytest.raises(ValueError):
        preprocess.prepare(df, F.lit(2), F.lit(1), short="pad", pad=" ")


def test_limits_and_failures(spark):
    df = spark.range(5)
    assert preprocess.exactly(df, 5, "id").count() == 5
    with pytest.raises(ValueError):
        preprocess.exactly(df, 6, "id")
    assert preprocess.without_failures(df.withColumn("v", F.try_divide(F.lit(1), "id")), "v").count() == 4
    with pytest.raises(ValueError):
        preprocess.without_failures(df.withColumn("v", F.lit(None)), "v")
    assert {r.id for r in preprocess.sample_rows(df, 3, "id", 1).collect()} == {r.id for r in preprocess.sample_rows(df.repartition(3), 3, "id", 1).collect()}


def test_phase_limits():
    f = lifecycle.phase_limits
    assert f(0.1, None, "duration", 200, 60.0) == (6.0, None) and f(0.1, 5, "requests", 200, 60.0) == (None, 20)
    assert f(None, 5, "both", 200, 60.0) == (5.0, 5) and f(None, 5, "prefer_duration", 200, None) == (None, 5)
    assert f(0.5, None, "prefer_duration", 200, 60.0) == (30.0, None) and f(0.5, None, "prefer_requests", 200, 60.0) == (None, 100)
    assert lifecycle.phase_config(0.25) == {"percent": 0.25, "value": None} and lifecycle.phase_config(3) == {"percent": None, "value": 3} and lifecycle.phase_config(None) == {"percent": None, "value": None}


def test_measured_window_without_phases(spark):
    r = spark.createDataFrame([(1, k, 10 * k, 10 * k + 25) for k in range(6)], "run_index int, request_id long, start_us long, end_us long")
    assert tuple(lifecycle.measured_window(r, ["run_index"]).first())[1:] == (0, 0, 75, 75)
    assert tuple(lifecycle.measured_window(r, ["run_index"], warmup=(None, 1), cooldown=(None, 1), total=6).first())[1:] == (0, 10, 55, 75)
    assert tuple(lifecycle.measured_window(r, ["run_index"], warmup=(None, 9), cooldown=(1e-5, None), seconds=6e-5).first())[1:] == (0, 0, 50, 75)


def test_ids_must_match(spark):
    a, b = spark.range(3).withColumnRenamed("id", "request_id"), spark.range(2).withColumnRenamed("id", "request_id")
    assert lifecycle.join_by_id(a.withColumn("x", F.lit(1)), a.withColumn("y", F.lit(1)), a.withColumn("z", F.lit(1))).count() == 3
    with pytest.raises(ValueError):
        lifecycle.join_by_id(a.withColumn("x", F.lit(1)), b.withColumn("y", F.lit(1)), a.withColumn("z", F.lit(1)))


def test_graph_checks(spark):
    nodes = spark.createDataFrame([(1, "a", []), (1, "b", ["a"]), (1, "c", ["b"])], "g int, n string, p array<string>")
    assert conversations.built_edges(nodes, "g", "n", "p").count() == 2
    for more in ([(1, "d", ["z"])], [(1, "d", ["a", "b"])], [(2, "x", ["y"]), (2, "y", ["x"])]):
        with pytest.raises(ValueError):
            conversations.built_edges(nodes.unionByName(spark.createDataFrame(more, nodes.schema)), "g", "n", "p")


def test_readers(spark, tmp_path):
    (tmp_path / "x.txt").write_text("one\ntwo\n")
    assert [r.text for r in readers.read(spark, "txt", str(tmp_path / "x.txt")).collect()] == ["one\n", "two\n"]
    for split, n in (("valid", 2), ("train_data", 3)):
        spark.range(n).write.parquet(str(tmp_path / "set" / split))
    assert readers.read(spark, "hf", str(tmp_path / "set")).count() == 3 and readers.read(spark, "directory", str(tmp_path / "set"), split="valid").count() == 2
    for split in ("none", None):
        with pytest.raises(ValueError):
            readers.directory(spark, str(tmp_path / "set" / "valid"), "x") if split is None else readers.directory(spark, str(tmp_path / "set"), split)
    lines = [{"timestamp": 20, "input_length": 700, "output_length": 3, "hash_ids": [4, 9]}, {"timestamp": 10, "input_length": 512, "output_length": 1, "hash_ids": [4]}, {"timestamp": 30, "input_length": 1000, "output_length": 1, "hash_ids": [4, 8]}]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = readers.read(spark, "mooncake", str(tmp_path / "t.jsonl")).withColumn("tokens", blocks.block_tokens("blocks", 1000)).collect()
    assert [r.timestamp for r in got] == [10, 20, 30] and [[len(t) for t in r.tokens] for r in got] == [[512], [512, 188], [512, 488]]
    assert got[0].tokens[0] == got[1].tokens[0] and got[1].tokens[1] != got[2].tokens[1][:188]
    (tmp_path / "bad.jsonl").write_text(json.dumps(lines[0] | {"hash_ids": [1]}))
    with pytest.raises(PySparkException):
        readers.read(spark, "mooncake", str(tmp_path / "bad.jsonl")).collect()


def test_options(tmp_path):
    (tmp_path / "o.json").write_text('{"rate": 3}')
    assert readers.options(str(tmp_path / "o.json")) == {"rate": 3} and readers.options('{"a": [1]}') == {"a": [1]}
    assert readers.options("rate=2.5, name=x y,flag=true") == {"rate": 2.5, "name": "x y", "flag": True} and readers.options({"k": 1}) == {"k": 1}
    with pytest.raises(ValueError):
        readers.options("rate")


def test_registries(spark):
    assert plugins.PREPROCESSORS.find("Column_Mapper") is mapping.map_columns
    with pytest.raises(ValueError):
        plugins.OUTPUTS.find("none")
    with pytest.raises(ValueError):
        plugins.TOKENIZERS.register("words")(len)
    plugins.FINALIZERS.register("own")(lambda df, n=1: df.withColumn("n", F.lit(n)))
    assert plugins.FINALIZERS.apply("OWN", spark.range(1), n=4).first().n == 4


def test_exports(spark, tmp_path):
    w = spark.createDataFrame([(1, 'a "q"'), (2, "b")], "run int, `Latency|us|Mean` string")
    export.write_csv(w, str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("part*")))
    assert text == '"run","Latency"\n"","us"\n"","Mean"\n"1","a ""q"""\n"2","b"\n'
    export.write_json(w, str(tmp_path / "json"))
    assert sorted(map(tuple, export.load_report(spark, str(tmp_path / "json"), "run int, `Latency|us|Mean` string").collect())) == sorted(map(tuple, w.collect()))
    assert export.inject("<head></head>", '{"a": "</script>"}') == '<head><script>window.report = {"a": "<\\/script>"};</script></head>'
    with pytest.raises(ValueError):
        export.inject("none", "{}")
    s = spark.createDataFrame([("text", 3), ("image", 0), ("tool_call", 5)], "metric string, count int")
    assert [r.metric for r in export.used_modalities(s).collect()] == ["text"]
    p = spark.createDataFrame([(1.0, 5.0)], "x double, m double")
    assert export.interpolated(p, "x", ["m"], 1.0).first().y == 0 and export.interpolated(p.unionByName(p.select((F.col("x") + 1).alias("x"), "m")), "x", ["m"], 9.0).first().y == 0


def test_profiles(spark):
    assert [tuple(r) for r in schedule.profile(spark, "constant", [1, 2.5]).collect()] == [(0, "constant", 1.0), (1, "constant", 2.5)]
    assert schedule.profile(spark, "replay").first().rate is None
    for kind, rates in (("constant", []), ("poisson", [0]), ("x", [1]), ("throughput", [1, 2])):
        with pytest.raises(ValueError):
            schedule.profile(spark, kind, rates)
    runs = spark.createDataFrame([(k, False) for k in range(3)], "k int, stop boolean")
    assert schedule.escalated(runs, "k", "stop").count() == 3


def test_scalars(spark):
    one = lambda *c: tuple(spark.range(1).select(*c).first())
    t = F.lit("start here and end there")
    assert one(sc.filter_text(t, "here", " end"), sc.filter_text(t, None, 5), sc.filter_text(t)) == ("here and end t", "start", "start here and end there")
    with pytest.raises(PySparkException):
        one(sc.filter_text(t, "nowhere"))
    assert one(sc.is_punctuation(F.lit("!")), sc.is_punctuation(F.lit("é")), sc.is_punctuation(F.lit("!!"))) == (True, False, False)
    assert one(sc.camelize(F.lit("Snake_case_NAME")), sc.camelize(F.lit("x"))) == ("snakeCaseName", "x")
    assert one(sc.wrap(F.lit("aa bb cccccc d"), 5))[0] == ["aa bb", "cccccc", "d"]
    assert one(sc.value_display(F.lit(3.14159), "rate", "/s", 2, 16), sc.value_display(F.lit(2), "n")) == ("   3.14/s [rate]", "2 [n]")
    m = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2))
    assert one(sc.merged_map(m, F.create_map(F.lit("b"), F.lit(9))), sc.renamed_keys(m, {"a": "z"}), sc.without_keys(m, "a")) == ({"a": 1, "b": 9}, {"z": 1, "b": 2}, {"b": 2})
    assert one(sc.as_json(F.lit('{"a": 1}')), sc.as_json(F.lit("{a")), sc.as_json(F.lit("3"))) == ('{"a": 1}', None, None)
    assert one(sc.aspect_ratio(F.lit("16:9")), sc.reasoning(F.lit("why"), "[{reasoning}]"), sc.reasoning(F.lit("")), sc.reasoning(F.lit("x"), False)) == (16 / 9, "[why]", None, None)
    with pytest.raises(PySparkException):
        one(sc.aspect_ratio(F.lit("16")))
    u, z = synthetic.uniform(3, "id"), synthetic.normal(3, "id")
    x = spark.range(2000).select(sc.float_around(5, u, z, least=2, most=3).alias("even"), sc.float_around(1, u, z, spread=2.0).alias("normal"), sc.float_around(4, u, z).alias("same"))
    lo, hi, low, mean, same = x.agg(F.min("even"), F.max("even"), F.min("normal"), F.avg("normal"), F.max("same")).first()
    assert 2 <= lo < 2.1 and 2.9 < hi <= 3 and low == 0 and 1 < mean < 1.8 and same == 4


def test_bodies(spark):
    one = lambda c: json.loads(spark.range(1).select(c).first()[0])
    assert one(chats.limits_body(F.lit(5), "m", True)) == {"model": "m", "stream": True, "stream_options": {"include_usage": True, "continuous_usage_stats": True}, "max_tokens": 5, "ignore_eos": True}
    assert one(chats.limits_body(F.lit(None).cast("int"))) == {}
    df = spark.createDataFrame([('{"data": {"x": 1}, "priority": 2}',), ("{}",)], "e string")
    assert [json.loads(r[0]) for r in df.select(chats.pooling_body("e", "m")).collect()] == [{"model": "m", "data": '{"x":1}', "priority": 2}, {"model": "m"}]


def test_ranges_are_balanced_whatever_the_values(spark):
    x = spark.range(20_000).select(F.lit(1).alias("k"), F.exp(F.randn(7)).alias("v"), "id").unionByName(spark.createDataFrame([(1, 1e9, -1)], "k int, v double, id long"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in ordered.in_order(x, ["k"], "v", ("id",)).groupBy("_r").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 2 * sum(sizes) / len(sizes)
    s = ordered.running_sum(x.withColumn("one", F.lit(1)), ["k"], "v", {"n": "one"}, ties=("id",))
    assert [r.n for r in s.orderBy("v", "id").select("n").collect()] == list(range(1, 20_002))
    m = ordered.running_max(x, ["k"], "id", {"top": "v"}).orderBy("id").select("top").collect()
    assert all(a.top <= b.top for a, b in zip(m, m[1:], strict=False))
    near = ordered.neighbours(x.limit(1000), ["k"], "v", ("id",), ("id",)).orderBy("v", "id").collect()
    assert all(a.next_id == b.id and b.prev_v == a.v for a, b in zip(near, near[1:], strict=False)) and near[0].prev_v is None and near[-1].next_id is None
