"""Datasets in containers that Spark has no reader for: a task opens whole files, as many tasks as files."""

from __future__ import annotations

import io
import os
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import settle
from .readers import reader


def opened(spark: SparkSession, path: str, schema: str, tables: Callable[[bytes], Iterator[pd.DataFrame]]) -> DataFrame:
    """Rows of all files under path (a folder, file or pattern), by the schema; columns that a file lacks are null."""
    target = spark.createDataFrame([], schema).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                for t in tables(data):
                    yield t.reindex(columns=target.names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, target)


@reader("arrow_file", "arrow")
def arrow(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Arrow files and streams."""

    def tables(data: bytes) -> Iterator[pd.DataFrame]:
        try:
            f = pa.ipc.open_file(data)
            yield from (f.get_batch(i).to_pandas() for i in range(f.num_record_batches))
        except pa.ArrowInvalid:
            yield from (b.to_pandas() for b in pa.ipc.open_stream(data))

    return opened(spark, path, schema, tables)


@reader("db_file", "db", "sqlite")
def sqlite(spark: SparkSession, path: str, schema: str, query: str) -> DataFrame:
    """What a query gives over each SQLite file."""

    def tables(data: bytes) -> Iterator[pd.DataFrame]:
        import sqlite3
        from contextlib import closing

        with closing(sqlite3.connect(":memory:")) as con:
            con.deserialize(data)
            yield from pd.read_sql_query(query, con, chunksize=10_000)

    return opened(spark, path, schema, tables)


@reader("tar_file", "tar")
def tar(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each base name in a tar; members' endings name the columns, `__key__` is the base name.

    Columns that the schema has as strings are decoded as UTF-8, binary ones stay bytes. Members of a base
    name stand together, as the format asks.
    """
    strings = {f.name for f in spark.createDataFrame([], schema).schema if f.dataType.typeName() == "string"}

    def tables(data: bytes) -> Iterator[pd.DataFrame]:
        import tarfile

        row: dict = {}
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for m in t:
                if not m.isfile():
                    continue
                base, _, ending = os.path.basename(m.name).partition(".")
                base = os.path.join(os.path.dirname(m.name), base)
                if row and row["__key__"] != base:
                    yield pd.DataFrame([row])
                    row = {}
                raw = t.extractfile(m).read()
                row |= {"__key__": base, ending: raw.decode() if ending in strings else raw}
        if row:
            yield pd.DataFrame([row])

    return opened(spark, path, schema, tables)


@reader("hdf5_file", "hdf5", "h5")
def hdf5(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Columns of a group in HDF5 files, one data set each."""
    try:
        import h5py  # noqa: F401
    except ImportError as e:
        raise ValueError("HDF5 files need the h5py library, which is not installed") from e

    def tables(data: bytes) -> Iterator[pd.DataFrame]:
        import h5py

        with h5py.File(io.BytesIO(data)) as f:
            yield pd.DataFrame({c: f[key][c][:] for c in f[key]})

    return opened(spark, path, schema, tables)


def unwrap(df: DataFrame, required: dict[str, str]) -> DataFrame:
    """Rows of a trace with the required columns (name: type): as they are, or out of the one column that holds JSON lists of them.

    Unwrapped rows have `conversation`, a number of the row that they came from (rising with it, not without gaps), the same for all readers.
    """
    if set(required) <= set(df.columns):
        return df
    item = "array<struct<" + ",".join(f"`{c}`:{t}" for c, t in required.items()) + ">>"
    texts = [f.name for f in df.schema if f.dataType.typeName() == "string"]
    whole = lambda c: F.forall(F.from_json(c, item), lambda x: F.forall(F.array(*(x[n].isNotNull() for n in required)), lambda y: y))
    found = df.agg(*(F.min(F.coalesce(whole(c), F.lit(False))).alias(c) for c in texts)).first() if texts else ()
    fit = [c for c, ok in zip(texts, found, strict=True) if ok]
    if len(fit) != 1:
        raise ValueError(f"{len(fit)} columns hold lists of rows with {', '.join(required)}; there has to be one")
    x = settle(df.select(F.monotonically_increasing_id().alias("conversation"), F.col(fit[0]).alias("_cell")))
    return x.withColumn("_rows", F.from_json("_cell", item)).select("conversation", F.explode("_rows").alias("_row")).select("conversation", "_row.*")
