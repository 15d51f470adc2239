"""Greedy clusters of times over long orders: a jump structure composed over ranges.

A cluster's head takes all times within the threshold after it, and the first time beyond is the next head: a walk that
depends on where it began. So the walk is a function from a time to the next head, and a range of the order is known by what it
makes of each possible head before it. As times are whole numbers, at most threshold + 1 rows of a range can be its first
head, so that is a short table; the tables of all ranges are composed in order, a row a range, and then each range knows
the head before it and walks on its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import settle


def jumps(t: np.ndarray, starts: np.ndarray, threshold: int) -> np.ndarray:
    """For each row the next head if it is one; rows of one key lie between two starts, and t rises in them."""
    if not len(t):
        return np.zeros(0, np.int64)
    # One rising axis for all keys: a key begins more than the threshold after the one before it.
    span = np.diff(np.append(starts, len(t)))
    first, last = t[starts], t[np.append(starts[1:], len(t)) - 1]
    begin = np.concatenate([[0], np.cumsum(last - first + threshold + 1)[:-1]])
    axis = t + np.repeat(begin - first, span)
    return np.searchsorted(axis, axis + threshold, "right")


def ends_of(jump: np.ndarray, n: int) -> np.ndarray:
    """The last head below n of a walk from each of the first n rows, by pointer doubling."""
    here = np.arange(n)
    at = np.where(jump[:n] < n, jump[:n], here)
    while True:
        further = at[at]
        if (further == at).all():
            return at
        at = further


def visited(jump: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The rows that walks from `begins` come to, in order, by pointer doubling."""
    n = len(jump)
    seen = np.zeros(n + 1, bool)
    seen[begins] = True
    step = np.append(jump, n)
    while True:
        seen[step[np.flatnonzero(seen)]] = True
        further = step[step]
        if (further == step).all():
            return np.flatnonzero(seen[:n])
        step = further


def key_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where each key's rows begin; equal keys are together, nulls are equal."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        code = table.column(k).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


#: Rows in a packed piece of a range.
PIECE = 1 << 20


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's rows as Arrow tables of up to about PIECE rows, each in one binary value, so that a checkpoint writes and reads few rows."""

    def piece(held: list) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
            out.write_table(pa.Table.from_batches(held).combine_chunks())
        return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["rows"])

    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= PIECE:
            yield piece(held)
            held, n = [], 0
    if held:
        yield piece(held)


def unpacked(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """The rows of a range, in order."""
    tables = [pa.ipc.open_stream(x.as_buffer()).read_all() for b in batches for x in b.column(0)]
    return pa.concat_tables(tables) if tables else None


def arrays(table: pa.Table, weights: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Times, and a row of weights for each."""
    return table.column("t").to_numpy().astype(np.int64), np.column_stack([table.column(w).to_numpy().astype(float) for w in weights])


def merged(table: pa.Table, keys: list[str], weights: tuple[str, ...]) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """A range's rows, times, weights and key starts, with rows of equal key and time made one."""
    t, w = arrays(table, weights)
    starts = key_starts(table, keys)
    new = np.zeros(len(t), bool)
    new[starts] = True
    new[1:] |= t[1:] != t[:-1]
    if new.all():
        return table, t, w, starts
    rows = np.flatnonzero(new)
    return table.select([*keys, "_r"]).take(pa.array(rows)), t[rows], np.add.reduceat(w, rows, 0), np.searchsorted(rows, starts)


def sums_of(w: np.ndarray) -> np.ndarray:
    """The weights of the rows before each row, and of all."""
    return np.concatenate([np.zeros((1, w.shape[1])), np.cumsum(w, 0)])


def summary_of(keys: list[str], threshold: int, weights: tuple[str, ...] = ("w",)):
    """A row for a range's first key, and one for its last if it is another: what the range makes of a head before it.

    candidates: the rows that may be the first head, by time, with the weight ahead of each and the last head of a walk from it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = unpacked(batches)
        if rows is None:
            return
        table, t, w, starts = merged(rows, keys, weights)
        jump, out = jumps(t, starts, threshold), []
        ends = np.append(starts[1:], len(t))
        for place, k in enumerate(sorted({0, len(starts) - 1})):
            a, z = starts[k], ends[k]
            m = min(z - a, int(np.searchsorted(t[a:z], t[a] + threshold, "left")) + 1)
            sums = sums_of(w[a:z])
            last = t[a + ends_of(jump[a:z] - a, z - a)[:m]]
            row = {c: [table.column(c)[int(a)].as_py()] for c in keys}
            out.append(row | {"_r": [table.column("_r")[0].as_py()], "_place": [place], "candidates": [t[a : a + m].tolist()], "ahead": [sums[:m].tolist()], "last": [last.tolist()], "n": [z - a], "total": [sums[-1].tolist()]})
        kinds = {c: table.schema.field(c).type for c in keys} | {"_r": pa.int32(), "_place": pa.int32(), "candidates": pa.list_(pa.int64()), "ahead": pa.list_(pa.list_(pa.float64())), "last": pa.list_(pa.int64()), "n": pa.int64(), "total": pa.list_(pa.float64())}
        for row in out:
            yield pa.RecordBatch.from_arrays([pa.array(row[c], k) for c, k in kinds.items()], list(kinds))

    return run


@dataclass
class Entry:
    """What a range needs to know of the others: the head before it, the weights of its first key before it, the weights that later ranges add to its last head, and the head after that."""

    head: int | None = None
    before: np.ndarray | float = 0.0
    more: np.ndarray | float = 0.0
    after: int | None = None


def compose(rows: list, keys: list[str], threshold: int) -> dict[int, Entry]:
    """Entries of all ranges from their summaries; one pass over a row or two a range."""
    entries: dict[int, Entry] = {}
    key = head = owner = None
    weight = 0.0
    for s in sorted(rows, key=lambda s: (s["_r"], s["_place"])):
        mine = tuple(s[c] for c in keys)
        entry = entries.setdefault(s["_r"], Entry())
        if key != mine or owner is None:
            key, head, weight, first = mine, None, 0.0, 0
        else:
            entry.head, entry.before = head, weight
            first = int(np.searchsorted(s["candidates"], head + threshold, "right"))
            inside = first < s["n"]
            entries[owner].more = entries[owner].more + np.array(s["ahead"][first] if inside else s["total"])
            if inside:
                entries[owner].after = s["candidates"][first]
        weight = weight + np.array(s["total"])
        if first < s["n"]:
            head, owner = s["last"][first], s["_r"]
    return entries


def columns_of(table: pa.Table, keys: list[str], rows: np.ndarray | None = None) -> list[pa.Array]:
    columns = [table.column(c).combine_chunks() for c in keys]
    return columns if rows is None else [c.take(pa.array(rows)) for c in columns]


def levels(weights: tuple[str, ...]) -> list[str]:
    return ["level"] if weights == ("w",) else [f"level_{w}" for w in weights]


def walk(keys: list[str], threshold: int, entries, members: bool, weights: tuple[str, ...] = ("w",)):
    """(keys, t, weights, prev_t, next_t, levels) of the heads in each range, from its entry; with members (keys, t, head) of all its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = unpacked(batches)
        if rows is None:
            return
        table, t, w, starts = merged(rows, keys, weights)
        entry = entries.value[table.column("_r")[0].as_py()]
        jump = jumps(t, starts, threshold)
        begins = starts.copy()
        if entry.head is not None:
            begins[0] = np.searchsorted(t[: np.append(starts[1:], len(t))[0]], entry.head + threshold, "right")
        heads = visited(jump, begins)
        if members:
            at = np.searchsorted(heads, np.arange(len(t)), "right") - 1
            head = np.where(at >= 0, t[heads[at]] if len(heads) else 0, entry.head or 0)
            yield pa.RecordBatch.from_arrays([*columns_of(table, keys), pa.array(t), pa.array(head)], [*keys, "t", "head"])
            return
        if not len(heads):
            return
        segment = np.searchsorted(starts, heads, "right") - 1
        same = segment[1:] == segment[:-1]
        stop = np.append(starts[1:], len(t))[segment]  # the end of a head's cluster: the next head, or the end of the key
        stop[:-1] = np.where(same, heads[1:], stop[:-1])
        sums = sums_of(w)
        weight, level = sums[stop] - sums[heads], sums[stop] - sums[starts[segment]]
        level[segment == 0] += entry.before
        weight[-1] += entry.more
        level[-1] += entry.more
        none = np.zeros(len(heads), bool)
        prev_none, next_none = none.copy(), none.copy()
        prev_none[0], next_none[-1] = segment[0] != 0 or entry.head is None, entry.after is None
        prev_none[1:], next_none[:-1] = ~same, ~same
        prev, after = np.concatenate([[entry.head or 0], t[heads[:-1]]]), np.append(t[heads[1:]], entry.after or 0)
        each = lambda x: [pa.array(np.ascontiguousarray(c)) for c in x.T]
        columns = [*columns_of(table, keys, heads), pa.array(t[heads]), *each(weight), pa.array(prev, mask=prev_none), pa.array(after, mask=next_none), *each(level)]
        yield pa.RecordBatch.from_arrays(columns, [*keys, "t", *weights, "prev_t", "next_t", *levels(weights)])

    return run


def walked(points: DataFrame, keys: list[str], threshold: int, members: bool, weights: tuple[str, ...] = ("w",), grouped: bool = False) -> DataFrame:
    """The rows are dealt to ranges once, and each range is read twice, whole, by one task: for its summary and for its walk."""
    spark = points.sparkSession
    t, w = F.col("t").cast("bigint").alias("t"), {w: F.col(w).cast("double") for w in weights}
    once = points.select(*keys, t, *(c.alias(n) for n, c in w.items())) if grouped else points.groupBy(*keys, t).agg(*(F.sum(c).alias(n) for n, c in w.items()))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = once.repartitionByRange(ranges, *keys, "t").sortWithinPartitions(*keys, "t").withColumn("_r", F.spark_partition_id())
    ordered = settle(dealt.mapInArrow(packed, "rows binary"))
    kinds = "".join(f"`{c}` {once.schema[c].dataType.simpleString()}, " for c in keys)
    rows = ordered.mapInArrow(summary_of(keys, threshold, weights), f"{kinds}_r int, _place int, candidates array<bigint>, ahead array<array<double>>, last array<bigint>, n bigint, total array<double>").collect()
    entries = spark.sparkContext.broadcast(compose(rows, keys, threshold))
    doubles = lambda names: ", ".join(f"`{n}` double" for n in names)
    out = "t bigint, head bigint" if members else f"t bigint, {doubles(weights)}, prev_t bigint, next_t bigint, {doubles(levels(weights))}"
    return ordered.mapInArrow(walk(keys, threshold, entries, members, weights), kinds + out)


def clusters(points: DataFrame, keys: list[str], threshold: int = 100, weights: tuple[str, ...] = ("w",), grouped: bool = False) -> DataFrame:
    """(keys, t, w, prev_t, next_t, level) for points (keys, t, w): the head and weight of each cluster of a key, the
    heads before and after it, and the weight of all clusters up to it. Times are whole numbers without nulls.

    Series at the same times are clustered once, as several weights; a weight x then has its level in level_x.

    Equal times are summed up first, so a range has as many rows as distinct times; of `grouped` points no time of a key has more
    than a few rows, so these are summed up where they are walked, and rows move once less.
    """
    return walked(points, keys, threshold, False, weights, grouped)


def heads_of(points: DataFrame, keys: list[str], threshold: int) -> DataFrame:
    """(keys, t, head): for each distinct time of points (keys, t) the head of its cluster."""
    return walked(points.withColumn("w", F.lit(0)), keys, threshold, True)
