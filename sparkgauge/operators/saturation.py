"""Over-saturation at every event of a run: regressions over windows that end at the event and begin where age and share allow.

A window is known by the numbers of its first and last point in the series, so its sums are differences of running sums. These are
whole numbers, so nothing is lost in the difference, however long the run.

Windows begin later for later events. So the windows of a range of events begin within one stretch of earlier points, a few ranges
before: each range hands later ones the points of its stretch, and a row a range and run (counts, sums, times) stands for the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import wide as wd
from ..functions.student import t_quantile, two_sided
from .clusters import key_starts, packed, unpacked
from .ordered import settle

KINDS = ("started", "first")
TERMS = ("late", "x", "y", "xx", "xy", "yy")
#: Events whose windows are in numpy arrays at a time.
SLICE = 1 << 18
NEVER = np.iinfo(np.int64).min


def terms_of(t: np.ndarray, v: np.ndarray, late_us: int) -> list[wd.Wide]:
    """Running sums of TERMS over points."""
    x, y = wd.wide(t), wd.wide(v)
    return [wd.sums(p) for p in (wd.wide(v > late_us), x, y, wd.times(x, t), wd.times(x, v), wd.times(y, v))]


class Range:
    """The points of a range, in order; a key's rows lie between two starts."""

    def __init__(self, table: pa.Table, keys: list[str], late_us: int):
        column = lambda c: table.column(c).to_numpy().astype(np.int64)
        self.table, self.r, self.t = table, table.column("_r")[0].as_py(), column("t_us")
        self.starts = key_starts(table, keys)
        self.ends = np.append(self.starts[1:], len(self.t))
        first, v = column("_first") == 1, column("value")
        self.at = [np.flatnonzero(~first), np.flatnonzero(first)]
        self.v = [v[at] for at in self.at]
        self.sums = [terms_of(self.t[at], x, late_us) for at, x in zip(self.at, self.v, strict=True)]

    def edges(self) -> list[int]:
        """The numbers of the keys that other ranges may have rows of: the first and the last."""
        return sorted({0, len(self.starts) - 1})

    def part(self, key: int, k: int) -> tuple[int, int]:
        """Where a key's points are among those of a kind."""
        a, z = np.searchsorted(self.at[k], [self.starts[key], self.ends[key]])
        return int(a), int(z)


@dataclass
class Chain:
    """The parts of one key in all its ranges, in order: range, first and last time; per kind the points and sums before each part and after the last, and the latest time so far."""

    ranges: list[int]
    begin: np.ndarray
    end: np.ndarray
    before: list[np.ndarray]
    sums: list[list[list[int]]]
    latest: list[np.ndarray]


def parts_of(keys: list[str], late_us: int):
    """A row for a range's first key, and one for its last if it is another; sums as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = unpacked(only_rows(batches))
        if rows is None:
            return
        x, out = Range(rows, keys, late_us), []
        for place, key in enumerate(x.edges()):
            row = {c: rows.column(c)[int(x.starts[key])].as_py() for c in keys} | {"_r": x.r, "_place": place, "_begin": int(x.t[x.starts[key]]), "_end": int(x.t[x.ends[key] - 1])}
            spans = [x.part(key, k) for k in (0, 1)]
            row["_n"] = [z - a for a, z in spans]
            row["_latest"] = [int(x.t[x.at[k][z - 1]]) if z > a else NEVER for k, (a, z) in enumerate(spans)]
            row["_sums"] = [str(wd.to_int(s, z) - wd.to_int(s, a)) for k, (a, z) in enumerate(spans) for s in x.sums[k]]
            out.append(row)
        whole, many = pa.int64(), pa.list_(pa.int64())
        kinds = {c: rows.schema.field(c).type for c in keys} | {"_r": pa.int32(), "_place": pa.int32(), "_begin": whole, "_end": whole, "_n": many, "_latest": many, "_sums": pa.list_(pa.string())}
        yield pa.RecordBatch.from_pylist(out, pa.schema(kinds))

    return run


def chains_of(rows: list, keys: list[str]) -> tuple[list[Chain], dict[int, list[tuple[int, int]]]]:
    """The keys' chains, and for each range the chain and place of its edges; one pass over a row or two a range."""
    found, where = [], {}
    for s in sorted(rows, key=lambda s: (s["_r"], s["_place"])):
        mine = tuple(s[c] for c in keys)
        if not found or found[-1][0] != mine:
            found.append((mine, []))
        where.setdefault(s["_r"], []).append((len(found) - 1, len(found[-1][1])))
        found[-1][1].append(s)
    chains = []
    for _, parts in found:
        before, sums, latest = [], [], []
        for k in (0, 1):
            before.append(np.cumsum([0, *(s["_n"][k] for s in parts)]))
            total = [[0] * len(TERMS)]
            for s in parts:
                total.append([a + int(b) for a, b in zip(total[-1], s["_sums"][k * len(TERMS) : (k + 1) * len(TERMS)], strict=True)])
            sums.append(total)
            latest.append(np.maximum.accumulate([s["_latest"][k] for s in parts]))
        chains.append(Chain([s["_r"] for s in parts], np.array([s["_begin"] for s in parts]), np.array([s["_end"] for s in parts]), before, sums, latest))
    return chains, where


PIECES = "_r int, kind int, at bigint, sums string, rows binary"


def piece(r: int, kind: int, at: int, sums: str, rows) -> pa.RecordBatch:
    """A piece of a range's own rows (kind -1, in order of `at`), or of the points of a kind that it is handed: their place and the sums before them."""
    return pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([kind], pa.int32()), pa.array([at], pa.int64()), pa.array([sums]), pa.array([rows], pa.binary())], ["_r", "kind", "at", "sums", "rows"])


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's rows in a few packed pieces."""
    r = []

    def seen() -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and not r:
                r.append(b.column("_r")[0].as_py())
            yield b

    for i, p in enumerate(packed(seen())):
        yield piece(r[0], -1, i, "", p.column(0)[0].as_py())


def only_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.select(["rows"]) for b in batches)


def left_out(n: np.ndarray, ratio: float) -> np.ndarray:
    """Of n points so far, how many the share leaves out."""
    return n - np.floor(n.astype(float) * ratio).astype(np.int64)


def handed(keys: list[str], age_us: int, ratio: float, late_us: int, known):
    """For each later range whose windows of a kind begin among a range's points: these points, their number and the sums before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = unpacked(only_rows(batches))
        if rows is None:
            return
        chains, where = known.value
        x = Range(rows, keys, late_us)
        for key, (of, place) in zip(x.edges(), where[x.r], strict=True):
            c = chains[of]
            for k in (0, 1):
                a, z = x.part(key, k)
                n, t, base = z - a, x.t[x.at[k][a:z]], c.before[k][place]
                later = np.arange(place + 1, len(c.ranges))
                most = lambda share, old: np.maximum(np.clip(left_out(share, ratio) - base, 0, n), np.searchsorted(t, old - age_us, "left"))
                lo, hi = most(c.before[k][later], c.begin[later]), most(c.before[k][later + 1], c.end[later])
                for i in np.flatnonzero((hi > 0) & (lo < n)):
                    p, q = int(a + lo[i]), int(a + hi[i])
                    own = [wd.to_int(s, p) - wd.to_int(s, a) + b for s, b in zip(x.sums[k], c.sums[k][place], strict=True)]
                    data = np.stack([t[p - a : q - a], x.v[k][p:q]]).tobytes()
                    yield piece(c.ranges[later[i]], k, int(base + lo[i]), ",".join(map(str, own)), data)

    return run


@dataclass
class Earlier:
    """What a range's first key has before it of a kind: numbers of points with the sums up to them, and times of numbered points."""

    n: int
    least: int
    t: np.ndarray
    number: np.ndarray
    numbers: np.ndarray
    sums: list[wd.Wide]


def earlier_of(c: Chain, place: int, k: int, pieces: list[tuple], late_us: int) -> Earlier:
    numbers, sums, times, of_times = [c.before[k][: place + 1]], [[wd.of_ints(list(s)) for s in zip(*c.sums[k][: place + 1], strict=True)]], [], []
    pieces = sorted(pieces, key=lambda p: p[0])
    for at, before, data in pieces:
        t, v = np.frombuffer(data, np.int64).reshape(2, -1)
        numbers.append(at + np.arange(len(t) + 1))
        sums.append([wd.plus(s, wd.of_ints([b])) for s, b in zip(terms_of(t, v, late_us), before, strict=True)])
        times.append(t)
        of_times.append(at + 1 + np.arange(len(t)))
    every = np.concatenate(numbers)
    order = np.argsort(every, kind="stable")
    joined = [tuple(np.concatenate([s[i][half] for s in sums])[order] for half in (0, 1)) for i in range(len(TERMS))]
    none = np.zeros(0, np.int64)
    return Earlier(int(c.before[k][place]), pieces[0][0] if pieces else 0, np.concatenate([none, *times]), np.concatenate([none, *of_times]), every[order], joined)


def begins_of(x: Range, k: int, own: Earlier, c: Chain, place: int, age_us: int, ratio: float) -> tuple[np.ndarray, ...]:
    """For each event: the key's points of a kind so far and before its window, and in the range the points up to the event, up to its key and, if the window begins in it, before the window."""
    span = x.ends - x.starts
    marked = np.zeros(len(x.t), np.int64)
    marked[x.at[k]] = 1
    upto = np.cumsum(marked)
    base = np.repeat(upto[x.starts] - marked[x.starts], span)
    more = np.zeros(len(x.t), np.int64)
    more[: x.ends[0]] = own.n
    n = upto - base + more
    # One rising axis for all keys: a key begins more than the age after the one before it.
    first, last = x.t[x.starts], x.t[x.ends - 1]
    axis = x.t + np.repeat(np.concatenate([[0], np.cumsum(last - first + age_us + 1)[:-1]]) - first, span)
    old = np.searchsorted(axis[x.at[k]], axis - age_us, "left") - base
    begin = np.maximum(left_out(n, ratio), np.where(old > 0, old + more, 0))
    if place:
        limit = x.t[: x.ends[0]] - age_us
        whole = c.before[k][np.searchsorted(c.latest[k][:place], limit, "left")]
        at = np.searchsorted(own.t, limit, "left")
        single = np.append(own.least, own.number)[at]
        begin[: x.ends[0]] = np.maximum.reduce([begin[: x.ends[0]], whole, single])
    return n, begin, upto, begin - more + base


def windows(keys: list[str], age_us: int, ratio: float, late_us: int, known, names: list[str]):
    """Each point of a range with n, late and the sums x, y, xx, xy and yy over its windows of both kinds."""

    def of_range(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        own = sorted((p for p in rows if p["kind"] < 0), key=lambda p: p["at"])
        x = Range(pa.concat_tables([pa.ipc.open_stream(p["rows"]).read_all() for p in own]), keys, late_us)
        chains, where = known.value
        of, place = where[x.r][0]
        earlier = [earlier_of(chains[of], place, k, [(p["at"], [int(s) for s in p["sums"].split(",")], p["rows"]) for p in rows if p["kind"] == k], late_us) for k in (0, 1)]
        begins = [begins_of(x, k, earlier[k], chains[of], place, age_us, ratio) for k in (0, 1)]
        table = x.table.select(names).combine_chunks()
        for a in range(0, len(x.t), SLICE):
            z = slice(a, a + SLICE)
            t, out = x.t[z], []
            for k in (0, 1):
                n, begin, upto, inside = (b[z] for b in begins[k])
                before = np.flatnonzero(inside < 0)
                at = np.searchsorted(earlier[k].numbers, begin[before])
                if (np.append(earlier[k].numbers, -1)[at] != begin[before]).any():
                    raise ValueError("a window begins at a point that no range has handed on")
                inside = inside.copy()
                inside[before] = 0
                s = {}
                for i, name in enumerate(TERMS):
                    p = wd.minus(wd.take(x.sums[k][i], upto), wd.take(x.sums[k][i], inside))
                    if len(before):
                        more = wd.minus(wd.of_ints([chains[of].sums[k][place][i]]), wd.take(earlier[k].sums[i], at))
                        p[0][before], p[1][before] = wd.plus(wd.take(p, before), more)
                    s[name] = p
                count = n - begin
                # Times before the event, as windows are short and runs long.
                here = wd.wide(t)
                s["xx"] = wd.plus(wd.minus(s["xx"], wd.times(s["x"], 2 * t)), wd.times(wd.times(here, t), count))
                s["xy"] = wd.minus(s["xy"], wd.times(s["y"], t))
                s["x"] = wd.minus(s["x"], wd.times(here, count))
                out += [count, s["late"][0].view(np.int64), *(wd.doubles(s[c]) for c in TERMS[1:])]
            columns = [c.combine_chunks() for c in table.slice(a, SLICE).columns]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, out)], [*names, *(f"{k}_{c}" for k in KINDS for c in ("n", *TERMS))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges: dict[int, list[dict]] = {}
        for b in batches:
            for p in b.to_pylist():
                ranges.setdefault(p["_r"], []).append(p)
        for r in sorted(ranges):
            yield from of_range(ranges.pop(r))

    return run


def window_sums(points: DataFrame, keys: list[str], age_us: int, ratio: float, late_us: int, ident: str) -> DataFrame:
    """points with, for both kinds, n, late and the sums x, y, xx, xy and yy over its window, x in microseconds before the event.

    points: keys, ident, t_us, kind and value, whole numbers; ties of a time go by kind, then ident, which is unique for a kind.
    A window begins at the later of two points: the first not older than age_us, and the one that leaves
    int(ratio x all points so far).
    """
    spark = points.sparkSession
    names, order = [*keys, ident, "t_us", "kind", "value"], [*keys, "t_us", "kind", ident]
    points = points.select(*keys, ident, F.col("t_us").cast("bigint").alias("t_us"), "kind", F.col("value").cast("bigint").alias("value"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = points.withColumn("_first", (F.col("kind") == "first").cast("int")).repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_r", F.spark_partition_id())
    ordered = settle(dealt.mapInArrow(numbered, PIECES))
    types = {f.name: f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema}
    rows = ordered.mapInArrow(parts_of(keys, late_us), ", ".join([*(types[c] for c in keys), "_r int, _place int, _begin bigint, _end bigint, _n array<bigint>, _latest array<bigint>, _sums array<string>"])).collect()
    known = spark.sparkContext.broadcast(chains_of(rows, keys))
    both = ordered.unionByName(ordered.mapInArrow(handed(keys, age_us, ratio, late_us, known), PIECES)).repartitionById(ranges, "_r")
    made = (f"{k}_{c} {'bigint' if c in ('n', 'late') else 'double'}" for k in KINDS for c in ("n", *TERMS))
    return both.mapInArrow(windows(keys, age_us, ratio, late_us, known, names), ", ".join([*(types[c] for c in names), *made]))


def rising(k: str, n: Column, confidence: float, most_error: float, unit: float) -> Column:
    """Whether the slope of a kind's window is positive with a relative margin below most_error; n: how many points count as independent."""
    s = {c: F.col(f"{k}_{c}").cast("double") for c in ("n", "x", "y", "xx", "xy", "yy")}
    x, y = s["x"] / 1e6, s["y"] / unit
    xx, xy, yy = s["xx"] / 1e12 - x * x / s["n"], s["xy"] / (1e6 * unit) - x * y / s["n"], s["yy"] / (unit * unit) - y * y / s["n"]
    safe = F.greatest(xx, F.lit(1e-12))
    slope = xy / safe
    rest = F.greatest(yy - xy * xy / safe, F.lit(0.0))
    margin = t_quantile(two_sided(confidence), n - 2) * F.sqrt(rest / (n - 2) / safe) / F.greatest(slope, F.lit(1e-12))
    return F.when(n >= 3, (slope > 0) & (margin < most_error)).otherwise(False)


def saturated_at(
    points: DataFrame, keys: list[str], least_s: float = 30.0, age_s: float = 120.0, most_error: float = 2.0, most_ttft_s: float = 2.5, ratio: float = 0.75, least: int = 5, confidence: float = 0.95, ident: str = "request_id"
) -> DataFrame:
    """points with n_started, n_first, n_late and `saturated`: the verdict at every event.

    points: keys, ident, t_us (from the run's begin), kind and value: `started` with the requests in flight, `first`
    with the microseconds to the first token. A run is saturated after least_s seconds if most first tokens in
    the window are late and both series rise, or the first alone while fewer than `least` first tokens count. Seconds bound how many points
    count as independent. Points of other kinds, and rows with nulls, are left out.
    """
    kept = points.where(F.col("kind").isin(*KINDS) & F.col("value").isNotNull() & F.col("t_us").isNotNull()).dropna(subset=keys).select(*keys, ident, "t_us", "kind", "value")
    x = window_sums(kept, keys, int(age_s * 1e6), ratio, int(most_ttft_s * 1e6), ident).where(F.col(ident).isNotNull())
    now = F.col("t_us") / 1e6
    n = {k: F.least(now, F.col(f"{k}_n").cast("double")) for k in KINDS}
    first = rising("first", n["first"], confidence, most_error, 1e6)
    started = rising("started", n["started"], confidence, most_error, 1.0)
    may = (now >= max(least_s, most_ttft_s)) & (F.col("first_n") <= 2 * F.col("first_late")) & (n["started"] >= least)
    verdict = F.when(may, started & F.when(n["first"] < least, True).otherwise(first)).otherwise(False)
    return x.select(*keys, ident, "t_us", "kind", "value", *(F.col(f"{k}_n").alias(f"n_{k}") for k in KINDS), F.col("first_late").alias("n_late"), verdict.alias("saturated"))
