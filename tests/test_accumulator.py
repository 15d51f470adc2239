"""The live accumulator against the batch form, in pieces and after a restart."""

import random

import pytest
from pyspark.sql import functions as F

from sparkgauge import plugins
from sparkgauge.operators import lifecycle
from sparkgauge.streaming.accumulator import live_progress

COLUMNS = "run_index long, request_id long, t_us long, status string, started boolean, latency_us long, output_tokens long"


def events():
    r = random.Random(6)
    out = []
    for i in range(300):
        start = 10_000_000 + r.randrange(600) * 1_000_000
        latency = r.randrange(1, 90) * 500_000
        end = r.choice(["completed"] * 6 + ["errored", "cancelled"])
        out += [(i % 3, i, start, "in_progress", None, None, None), (i % 3, i, start + latency, end, True, latency, i % 50)]
    out += [(0, 1000, 10_500_000, "queued", None, None, None), (0, 1001, 300_000_000, "cancelled", False, 5, 5), (5, 2000, 20_000_000, "queued", None, None, None)]
    return sorted(out, key=lambda e: e[2])


def run(spark, folder, checkpoint, name, **options):
    stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(folder)
    q = live_progress(stream, **options).writeStream.format("parquet").option("path", name).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None


def test_live_rows_equal_the_batch_rows(spark, tmp_path):
    rows = events()
    cuts = [0, 100, 260, 410, len(rows)]
    # A cut never parts events of one time.
    cuts = [next((k for k in range(c, len(rows)) if k == 0 or rows[k][2] != rows[k - 1][2]), len(rows)) for c in cuts[:-1]] + [len(rows)]
    options = {"warmup_us": 60_000_000, "active_us": 500_000_000, "constraints": {"max_errors": {"n": 9}}}
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
        spark.createDataFrame(rows[a:z], COLUMNS).coalesce(1).write.mode("append").parquet(folder)
        if k in (1, 3):  # two starts from one checkpoint, with two files each
            run(spark, folder, str(tmp_path / "checkpoint"), out, **options)
    live = spark.read.parquet(out)
    batch = lifecycle.progress_rows(spark.createDataFrame(rows, COLUMNS), 60_000_000, 500_000_000, max_errors=9)
    key = lambda r: (r.run_index, r.t_us, r.status, r.request_id)
    assert sorted(map(tuple, live.where("status <> 'phase'").collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)
    begins = {r.run_index: r.b for r in batch.where("status = 'in_progress'").groupBy("run_index").agg(F.min("t_us").alias("b")).collect()}
    told = {(r.run_index, r.t_us, r.phase, r.in_flight) for r in live.where("status = 'phase'").collect()}
    assert told == {(k, b + 60_000_000, "active", None) for k, b in begins.items()} | {(k, b + 500_000_000, "cooldown", None) for k, b in begins.items()}
    assert {r.phase for r in batch.collect()} == {"pending", "warmup", "active", "cooldown"} and batch.where("stopped_by is not null").count() > 10
    assert len({key(r) for r in batch.collect()}) == len(rows)


def test_a_step_of_ones_own(spark, tmp_path):
    if "few_in_flight" not in plugins.STEPS:
        plugins.STEPS.register("few_in_flight")(lambda most: lambda state, row: "stop" if state["in_flight"] > most else "continue")
    rows = [(1, i, (i + 1) * 1_000_000, "in_progress", None, None, None) for i in range(5)]
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.parquet(folder)
    run(spark, folder, str(tmp_path / "c"), str(tmp_path / "out"), constraints={"few_in_flight": {"most": 2}, "max_duration": {"us": 4_000_000}})
    got = {r.request_id: r.stopped_by for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: None, 1: None, 2: "few_in_flight", 3: "few_in_flight", 4: "few_in_flight"}
    with pytest.raises(ValueError):
        live_progress(spark.readStream.schema(COLUMNS).parquet(folder), constraints={"unknown": {}})
