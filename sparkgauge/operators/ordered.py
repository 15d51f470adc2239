"""Running sums, running maxima and neighbours over long orders without one task per key.

`in_order` deals the rows to ranges of (keys, order, ties) of about equal size, wherever their values lie,
so a key of many rows is in many ranges. Sums and edge values of whole ranges are combined over one row a
key and range, and windows work within ranges; several steps on one ordered frame share its partitioning.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def settle(df: DataFrame) -> DataFrame:
    """df from a reliable checkpoint in spark.checkpoint.dir, so that all readers see the same rows in the same ranges.

    Where no folder is set, a session within one process (as in tests) gets a temporary one; a cluster gets an error.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return df.checkpoint(eager=True)


def in_order(df: DataFrame, keys: list[str], order: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """df with the number `_r` of the range that a row falls in; ranges follow the order of (keys, order, ties)."""
    return settle(df.repartitionByRange(*keys, order, *ties).withColumn("_r", F.spark_partition_id()))


def before_ranges(parts: DataFrame, keys: list[str], values: dict) -> DataFrame:
    """(keys, _r, _b_name ...): for each name, an aggregate function and column, over the key's earlier ranges."""
    along = Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(*keys, "_r", *(f(c).over(along).alias(f"_b_{n}") for n, (f, c) in values.items()))


def with_running(x: DataFrame, keys: list[str], order: str, values: dict[str, str], ties: tuple[str, ...] = (), f=F.sum) -> DataFrame:
    """x, a frame of `in_order`, with for each name: column of values the sum (or other f) up to and including the row."""
    parts = x.groupBy(*keys, "_r").agg(*(f(c).alias(f"_s_{n}") for n, c in values.items()))
    parts = before_ranges(parts, keys, {n: (f, f"_s_{n}") for n in values})
    within = Window.partitionBy(*keys, "_r").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    x = x.join(parts, [*keys, "_r"])
    both = (lambda a, b: a + F.coalesce(b, F.lit(0))) if f is F.sum else lambda a, b: F.greatest(a, b)
    return x.withColumns({n: both(f(c).over(within), F.col(f"_b_{n}")) for n, c in values.items()}).drop(*(f"_b_{n}" for n in values))


def with_neighbours(x: DataFrame, keys: list[str], order: str, ties: tuple[str, ...] = (), carried: tuple[str, ...] = ()) -> DataFrame:
    """x, a frame of `in_order`, with prev_<column> and next_<column> of order and of the carried columns, also across ranges."""
    columns = (order, *carried)
    by = F.struct(order, *ties)
    edges = x.groupBy(*keys, "_r").agg(F.min_by(F.struct(*columns), by).alias("_min"), F.max_by(F.struct(*columns), by).alias("_max"))
    along = Window.partitionBy(*keys).orderBy("_r")
    edges = edges.select(*keys, "_r", F.lag("_max").over(along).alias("_p"), F.lead("_min").over(along).alias("_n"))
    within = Window.partitionBy(*keys, "_r").orderBy(order, *ties)
    row = F.struct(*columns)
    x = x.join(edges, [*keys, "_r"]).withColumns({"_p": F.coalesce(F.lag(row).over(within), "_p"), "_n": F.coalesce(F.lead(row).over(within), "_n")})
    return x.withColumns({f"prev_{c}": F.col(f"_p.{c}") for c in columns} | {f"next_{c}": F.col(f"_n.{c}") for c in columns}).drop("_p", "_n")


def running_sum(df: DataFrame, keys: list[str], order: str, values: dict[str, str], ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds, for each name: column of values, the sum up to and including the row. `order`, then `ties`, is unique in a key."""
    return with_running(in_order(df, keys, order, ties), keys, order, values, ties).drop("_r")


def running_max(df: DataFrame, keys: list[str], order: str, values: dict[str, str], ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds, for each name: column of values, the largest value up to and including the row."""
    return with_running(in_order(df, keys, order, ties), keys, order, values, ties, F.max).drop("_r")


def neighbours(df: DataFrame, keys: list[str], order: str, ties: tuple[str, ...] = (), carried: tuple[str, ...] = ()) -> DataFrame:
    """Adds prev_<column> and next_<column> of order and of the carried columns."""
    return with_neighbours(in_order(df, keys, order, ties), keys, order, ties, carried).drop("_r")
