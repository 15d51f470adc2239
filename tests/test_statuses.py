"""Status events joined as streams against the batch form."""

import random

from pyspark.sql import functions as F

from sparkgauge.operators import lifecycle
from sparkgauge.streaming import statuses as st

SCHEMA = "request_id long, status string, t timestamp, extra string"
STATUSES = ("queued", "in_progress", "completed")


def stamped(rows):
    from datetime import datetime, timedelta

    return [(i, s, datetime(2024, 1, 1) + timedelta(seconds=t), "x") for i, s, t in rows]


def run(spark, make, folder, checkpoint, out):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    q = make(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(240) and q.exception() is None


def test_streams_equal_batch(spark, tmp_path):
    r, rows = random.Random(2), []
    for i in range(120):
        t = r.randrange(400)
        told = [("queued", t), ("in_progress", t + r.randrange(0, 20)), ("completed", t + r.randrange(20, 50))]
        rows += [(i, s, at) for s, at in told if r.random() < 0.8]  # any of the three may be missing
    rows += [(1000, "queued", 100), (1000, "completed", 100), (1001, "queued", 50), (1001, "completed", 200), (1002, "other", 60)]
    rows.sort(key=lambda e: e[2])
    folder = str(tmp_path / "in")
    cuts = [0, 90, 200, len(rows)]
    pieces = [rows[a:z] for a, z in zip(cuts, cuts[1:], strict=False)]
    pieces[1] = pieces[1] + pieces[1][:5]  # repeated reports
    pieces.append([(9999, "queued", 5000)])  # the watermark passes all before
    pieces.append([(3, "completed", 10), (5000, "queued", 20), (9998, "queued", 5001)])  # too late to be seen
    make = lambda s: st.live_status_times(s, STATUSES, most="60 seconds")
    lost = lambda s: st.live_orphans(s, STATUSES, most="60 seconds")
    for k, piece in enumerate(pieces):
        spark.createDataFrame(stamped(piece), SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        if k in (1, 4):  # started twice from one checkpoint
            run(spark, make, folder, str(tmp_path / "c1"), str(tmp_path / "rows"))
            run(spark, lost, folder, str(tmp_path / "c2"), str(tmp_path / "lost"))
    seen = [e for e in rows if e[1] in STATUSES]
    batch = spark.createDataFrame(stamped(seen), SCHEMA).withColumn("t", F.unix_micros("t"))
    want = {tuple(x) for x in lifecycle.status_times(batch, STATUSES).collect()}
    base = {x[1] for x in want if x[0] == 1001}.pop()
    want = {x if x[0] != 1001 else (1001, base, None, None, "queued") for x in want}  # beyond 60 seconds
    got = [tuple(x) for x in spark.read.parquet(str(tmp_path / "rows")).collect()]
    assert len(got) == len(set(got)) and set(got) == {x for x in want if x[1] is not None}
    queued = {i for i, s, _ in seen if s == "queued"}
    orphans = sorted((x.request_id, x.status) for x in spark.read.parquet(str(tmp_path / "lost")).collect())
    assert orphans == sorted({(i, s) for i, s, _ in seen if i not in queued} | {(1001, "completed")})
    assert {x[4] for x in want} == set(STATUSES) and len(orphans) > 10
