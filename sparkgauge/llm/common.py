"""Shared helpers: scratch tables in the shared folder, row numbers, connected components."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_inside: ContextVar[str | None] = ContextVar("inside", default=None)
_lock, _writers = threading.Lock(), {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a session within one process (as in tests) gets a temporary one; a cluster gets an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a table; under the folder of `tables_in` where one is open."""
    return f"{(_inside.get() or shared_dir(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def tables_in(folder: str) -> Iterator[None]:
    """Scratch tables made inside go under one folder, so that they can go together."""
    token = _inside.set(folder)
    try:
        yield
    finally:
        _inside.reset(token)


def delete(spark: SparkSession, *paths: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def shuffle_files_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go at the end of each query run inside; several threads of a session may be inside at once."""
    key = spark.sparkContext.applicationId
    with _lock:
        n, before = _writers.get(key, (0, None))
        before = before if n else spark.conf.get(CLEANUP)
        _writers[key] = n + 1, before
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            n, before = _writers[key]
            _writers[key] = n - 1, before
            if n == 1:
                spark.conf.set(CLEANUP, before)


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Cuts lineage through a table in the shared folder; later steps read only the columns they need.

    The shuffle files behind the table go as soon as it is written, since only the table is read again.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    with shuffle_files_go(spark):
        df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def drop(*tables: DataFrame | None) -> None:
    """Deletes tables made by `cut` that nothing will read any more."""
    for t in tables:
        if t is not None and (path := getattr(t, "_scratch", None)):
            delete(t.sparkSession, path)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or with underscores before it a name that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def numbered(docs: DataFrame, column: str) -> DataFrame:
    """docs with a number of each row, as a table in the shared folder: reading it again gives the same numbers."""
    return cut(docs.withColumn(column, F.monotonically_increasing_id()), "rows")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014): each step is two
    pre-aggregated groupings, and the number of rounds grows with the logarithm of the diameter.
    Self loops and nulls are ignored; an empty input gives an empty result. The result is a table that
    `drop` deletes.
    """
    first = e = cut(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v").distinct())
    last = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: neighbours above u point to u's smallest neighbour.
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its smaller neighbours point to the smallest of them.
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, e = e, cut(small)
        if before is not first:
            drop(before)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == last:
            break
        last = tuple(now)
    nodes = first.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    found = nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("m")), "node", "left").groupBy("node").agg(F.least(F.min("m"), F.col("node")).alias("component"))
    found = cut(found)
    drop(first, e)
    return found
