"""Exact removal of repeated byte strings by merging the shards' suffix orders over a parse of the texts.

The texts are parsed at content-defined anchors (minima of window hashes), so that equal passages parse
into equal phrases wherever they stand, and the suffixes that matter are those at anchors. Each shard's
suffixes fall into intervals of equal prefixes, with their sizes (what a Burrows-Wheeler transform keeps
of their order). The shards' intervals are merged by iterative refinement: in a round, intervals with
equal prefixes meet (map-side sums give one row for each interval and shard), those met by one suffix
only are final and leave, the rest is refined by longer prefixes, until a common prefix reaches the
length sought. Suffixes are never compared or sorted again over all shards. What remains, the places
at the ends of repeated passages, is settled at byte level in two refinements: blocks of STEP neighbouring
places first, by what all their strings share and by what they span together, then single places of the
blocks that this leaves open.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, delete, drop, numbered, scratch, tables_in
from .minhash import mix64

GRAM, WINDOW, STEP = 16, 96, 16
BASES = (np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD6E8FEB86659FD93 | 1))


@lru_cache
def byte_values(which: int) -> np.ndarray:
    return np.random.default_rng(97 + which).integers(0, 2**64, 256, dtype=np.uint64)


_powers: dict[int, np.ndarray] = {}


def powers(which: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    known = _powers.get(which)
    if known is None or len(known) < n:
        size = max(1 << 17, 1 << (n - 1).bit_length())
        known = np.empty(size, np.uint64)
        known[0], have = 1, 1
        step = BASES[which]
        while have < size:  # doubling
            take = min(have, size - have)
            known[have : have + take] = known[:take] * step
            have, step = have + take, np.uint64(int(step) * int(step) % 2**64)
        _powers[which] = known
    return known[:n]


def window_hash(data: np.ndarray, length: int, which: int) -> np.ndarray:
    """Hash of every string of `length` bytes, by doubling: h of two strings end to end is h1 * base ** n2 + h2."""
    x = byte_values(which)[data]
    p = lambda n: powers(which, n + 1)[n]
    out, size, have, at = None, 1, 0, length
    while at:
        if at & 1:
            out = x if out is None else combine(x, size, out, have, p)
            have += size
        at >>= 1
        if at:
            x = x[:-size] * p(size) + x[size:] if len(x) > size else x[:0]
            size *= 2
    return mix64(out)


def combine(x: np.ndarray, size: int, out: np.ndarray, have: int, p) -> np.ndarray:
    """Hashes of size + have bytes: a string of `size` followed by one of `have`."""
    n = min(len(x), len(out) - size)
    return x[:n] * p(have) + out[size : size + n] if n > 0 else x[:0]


def slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over every `width` neighbours."""
    size = 1
    while 2 * size <= width:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def anchors(data: np.ndarray) -> np.ndarray:
    """Starts of 16-byte strings whose hash is least in one of the windows that hold them; all ties count."""
    h = window_hash(data, GRAM, 0)
    if len(h) < WINDOW:
        return np.zeros(0, np.int64)
    low = slide(h, WINDOW, np.minimum)
    pad = np.zeros(WINDOW - 1, np.uint64)
    return np.flatnonzero(slide(np.concatenate([pad, low, pad]), WINDOW, np.maximum) == h)


def prefix_sums(data: np.ndarray, which: int) -> np.ndarray:
    """Prefix sums of value * base ** place."""
    return np.concatenate([[np.uint64(0)], np.cumsum(byte_values(which)[data] * powers(which, len(data)))])


def span_hash(sums: np.ndarray, a: np.ndarray, b: np.ndarray, which: int) -> np.ndarray:
    """Hash of the bytes a .. b - 1, wherever they stand: their sum, brought to a common place by the power still missing."""
    n = len(sums) - 1
    return mix64((sums[b] - sums[a]) * powers(which, n)[n - 1 - a] * inverse_power(n - 1, which) ^ mix64((b - a).astype(np.uint64)))


def phrases(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit symbol of each phrase between neighbouring anchors."""
    if len(at) < 2:
        return np.zeros(0, np.uint64)
    return span_hash(prefix_sums(data, 1), at[:-1], at[1:], 1)


@lru_cache(maxsize=4096)
def inverse_power(n: int, which: int) -> np.uint64:
    return np.uint64(pow(pow(int(BASES[which]), -1, 2**64), n, 2**64))


def sequence_sums(syms: np.ndarray) -> np.ndarray:
    return np.concatenate([[np.uint64(0)], np.cumsum(mix64(syms) * powers(0, len(syms)))])


def sequence_key(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A key of the symbols a .. b - 1, wherever they stand."""
    n = len(sums)
    inv = np.uint64(pow(pow(int(BASES[0]), -1, 2**64), n, 2**64))
    return mix64((sums[b] - sums[a]) * powers(0, n + 1)[n - a] * inv ^ mix64((b - a).astype(np.uint64))).view(np.int64)


def candidates(n: int, at: np.ndarray, alive: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs start .. stop - 1 of places p for which every phrase inside the core of [p, p + length) is repeated somewhere.

    The core leaves a window at either end, so its anchors depend on the string alone. A phrase that isn't repeated rules
    out a run of places; both ends of these runs rise.
    """
    size = n - length + 1
    dead = np.flatnonzero(~alive)
    lo = np.clip(at[dead + 1] - (length - GRAM - WINDOW + 1), 0, size)
    hi = np.clip(at[dead] - WINDOW + 2, 0, size)
    ok = lo < hi
    start, stop = np.append(0, hi[ok]), np.append(lo[ok], size)
    ok = start < stop
    return start[ok], stop[ok]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]])))
    return step[::2], step[1::2]


def covered(n: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, stop, -1)
    return np.cumsum(edge[:-1]) > 0


def cores(n: int, at: np.ndarray, alive: np.ndarray, done: np.ndarray, length: int):
    """(first anchor, last anchor, first place, end place, asked) for the places with the same core; asked: some isn't covered yet.

    The core changes where an anchor enters or leaves it, so there is work for each anchor, not for each place.
    """
    start, stop = candidates(n, at, alive, length)
    if not len(start):
        return [np.zeros(0, np.int64)] * 5
    ahead = length - GRAM - WINDOW + 1
    change = np.concatenate([at - WINDOW + 2, at - ahead])
    run = np.searchsorted(start, change, "right") - 1
    lo = np.unique(np.concatenate([start, change[(run >= 0) & (change < stop[run])]]))
    hi = np.minimum(stop[np.searchsorted(start, lo, "right") - 1], np.append(lo[1:], stop[-1]))
    full, last_byte = np.concatenate([[0], np.cumsum(done)]), hi - 1 + length
    return [np.searchsorted(at, lo + WINDOW - 1), np.searchsorted(at, lo + ahead, "right") - 1, lo, hi, full[last_byte] - full[lo] < last_byte - lo]


def gathered(parts: Iterator[dict[str, np.ndarray]], most: int = 200_000) -> Iterator[pd.DataFrame]:
    """Frames of about `most` rows from many short pieces."""
    held, n = [], 0
    for x in parts:
        held.append(x)
        n += len(next(iter(x.values())))
        if n >= most:
            yield pd.DataFrame({k: np.concatenate([h[k] for h in held]) for k in x})
            held, n = [], 0
    if held:
        yield pd.DataFrame({k: np.concatenate([h[k] for h in held]) for k in held[0]})


def blocks_of(los: np.ndarray, his: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Starts, each once, of the blocks of STEP places (aligned to a range's mark) that touch the ranges lo .. hi - 1."""
    first, last = (los - marks) // STEP, (his - 1 - marks) // STEP
    n = last - first + 1
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.unique(np.repeat(marks + first * STEP, n) + nth * STEP)


def as_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def listed(df: DataFrame, value, name: str) -> DataFrame:
    return df.groupBy("row").agg(F.collect_list(value).alias(name))


def repeated(df: DataFrame, *key: str) -> DataFrame:
    """The rows of df whose key more than one row has. Each shard's interval is one row of the sums that meet.

    The keys are a table of their own, which `drop` of the rows deletes: with a sum between shuffle and join Spark would
    not split the partition of a very common key.
    """
    return those_of(df, df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*key))


def those_of(df: DataFrame, keys: DataFrame) -> DataFrame:
    table = cut(keys)
    rows = df.join(table, table.columns, "left_semi")
    rows._scratch = table._scratch
    return rows


def remove_repeats(docs: DataFrame, length: int = 400, growth: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of start, stop).

    Removes every byte covered by a `length`-byte string that also starts elsewhere, in the same document
    or another (length >= 304). Null texts are empty, texts under `length` bytes keep all; rows of a
    repeated or null id are documents of their own; other columns are not carried; an empty table gives no
    rows. 64-bit hashes of phrases only choose what is looked at; whatever is removed has met its equal by
    128 bits over all its bytes. Tables of finished rounds are deleted.
    """
    if length < 3 * WINDOW + GRAM:
        raise ValueError("length is too short for the anchors")
    spark, folder = docs.sparkSession, scratch(docs.sparkSession, "repeats")
    docs = numbered(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "row")
    with tables_in(folder):
        gone = spans_of(docs.select("row", "text"), length, growth)
    none, shape = F.lit(0).cast("long"), "array<struct<start:int,stop:int>>"
    whole = docs.select("row", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    found = whole.join(gone, "row", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("left", "sha").alias("kept_sha256"), F.coalesce("spans", F.array().cast(shape)).alias("spans")
    )
    found = cut(found)
    delete(spark, folder)
    drop(docs)
    return found


def spans_of(docs: DataFrame, length: int, growth: int) -> DataFrame:
    """(row, n_removed, n_spans, left, spans) of the rows of docs that lose something."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row, t in zip(b["row"], b["text"], strict=True):
                data = np.frombuffer(as_bytes(t), np.uint8)
                at = anchors(data)
                out.append((row, len(data), at.astype(np.int32), phrases(data, at).view(np.int64)))
            yield pd.DataFrame(out, columns=["row", "n_bytes", "at", "syms"])

    # Shorter texts hold no string of that length.
    parsed = cut(docs.where(F.octet_length("text") >= length).mapInPandas(parse, "row long, n_bytes long, at array<int>, syms array<long>"))

    # First round: intervals of one phrase.
    single = parsed.where(F.size("syms") > 0).select("row", F.posexplode("syms").alias("i", "key"))
    twice = repeated(single, "key")
    alive = listed(twice, F.col("i"), "alive")

    def zone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for n, at, alive in zip(b["n_bytes"], b["at"], b["alive"], strict=True):
                mask = np.zeros(len(at) - 1, bool)
                mask[alive] = True
                keep.append(len(candidates(n, at.astype(np.int64), mask, length)[0]) > 0)
            yield b[keep]

    zones = cut(parsed.join(alive, "row").select("row", "n_bytes", "at", "syms", "alive").mapInPandas(zone, "row long, n_bytes long, at array<int>, syms array<long>, alive array<int>"))
    drop(parsed, twice)

    # Further rounds: prefixes of growth ** 2, growth ** 4, ... phrases, or as many as reach the length. Most sequences of
    # repeated phrases are repeated too, so rounds between these would cost more than they tell apart.
    def refine(depth: int):
        def pieces(b: pd.DataFrame) -> Iterator[dict[str, np.ndarray]]:
            for row, at, syms, live in zip(b["row"], b["at"], b["syms"], b["live"], strict=True):
                at, every = at.astype(np.int64), np.sort(live.astype(np.int64))
                live = every
                end = np.searchsorted(at, at[live] + length)
                live, end = live[end < len(at)], end[end < len(at)]
                stop = np.minimum(live + depth, end)
                if depth == start:  # all phrases of the prefix must have lived through the first round
                    dead = np.ones(len(at), np.int64)
                    dead[every] = 0
                    sums = np.concatenate([[0], np.cumsum(dead)])
                    ok = sums[stop] == sums[live]
                    live, end, stop = live[ok], end[ok], stop[ok]
                if len(live):
                    key = sequence_key(sequence_sums(syms.view(np.uint64)), live, stop)
                    yield {"row": np.full(len(live), row), "i": live, "key": key, "settled": stop == end, "start": at[live], "stop": at[end]}

        return lambda batches: gathered(x for b in batches for x in pieces(b))

    start = growth**2
    live, depth, rounds = zones.withColumn("live", F.col("alive")), start, []
    while True:
        keyed = cut(live.mapInPandas(refine(depth), "row long, i int, key long, settled boolean, start int, stop int"))
        twice = repeated(keyed, "key")
        met = cut(twice)
        drop(keyed, twice)
        rounds.append(met)
        open_ = met.where("not settled")
        if depth > length or not open_.head(1):
            break
        depth *= start
        live = zones.select("row", "at", "syms").join(listed(open_, F.col("i"), "live"), "row")

    # What the rounds settled, by all its bytes. Texts of documents in zones only.
    text = cut(docs.join(zones.select("row"), "row", "left_semi"))

    def digests(b: pd.DataFrame) -> Iterator[dict[str, np.ndarray]]:
        for row, t, starts, stops in zip(b["row"], b["text"], b["starts"], b["stops"], strict=True):
            raw = as_bytes(t)
            d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[a:z]) for a, z in zip(starts, stops, strict=True)), "<i8").reshape(-1, 2)
            yield {"row": np.full(len(d), row), "start": starts, "stop": stops, "h1": d[:, 0], "h2": d[:, 1]}

    settled = reduce(DataFrame.unionByName, (m.where("settled").select("row", "start", "stop") for m in rounds)).groupBy("row").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    found = cut(text.join(settled, "row").mapInPandas(lambda batches: gathered(x for b in batches for x in digests(b)), "row long, start int, stop int, h1 long, h2 long"))
    drop(*rounds)
    twice = repeated(found, "h1", "h2")
    blocks = cut(twice.select("row", "start", "stop"))
    drop(found, twice)

    # Places by their cores; only cores that an uncovered place asks for go on.
    grouped = blocks.groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("blocks"))
    zoned = zones.join(grouped, "row", "left").withColumn("starts", F.coalesce(F.col("blocks.start"), F.array().cast("array<int>"))).withColumn("stops", F.coalesce(F.col("blocks.stop"), F.array().cast("array<int>")))

    def find_cores(b: pd.DataFrame) -> Iterator[dict[str, np.ndarray]]:
        for row, n, at, syms, alive, starts, stops in zip(*(b[c] for c in ("row", "n_bytes", "at", "syms", "alive", "starts", "stops")), strict=True):
            mask = np.zeros(len(at) - 1, bool)
            mask[alive] = True
            first, last, lo, hi, asked = cores(n, at.astype(np.int64), mask, covered(n, starts, stops), length)
            if len(first):
                yield {"row": np.full(len(first), row), "key": sequence_key(sequence_sums(syms.view(np.uint64)), first, last), "mark": at[first], "lo": lo, "hi": hi, "asked": asked}

    core = cut(zoned.select("row", "n_bytes", "at", "syms", "alive", "starts", "stops").mapInPandas(lambda batches: gathered(x for b in batches for x in find_cores(b)), "row long, key long, mark int, lo int, hi int, asked boolean"))
    wanted = core.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("asked").alias("asked")).where("asked and n > 1").select("key")
    drop(zones)
    common = those_of(core, wanted)
    places = common.groupBy("row").agg(F.collect_list(F.struct("lo", "hi", "mark")).alias("places"))

    # Byte level: whole strings by 128 bits.
    def neighbours(b: pd.DataFrame) -> Iterator[dict[str, np.ndarray]]:
        """Blocks of places: a hash of what all their strings share, and 128 bits of what they span."""
        for row, t, los, his, marks in zip(b["row"], b["text"], b["los"], b["his"], b["marks"], strict=True):
            data = np.frombuffer(as_bytes(t), np.uint8)
            q = blocks_of(los.astype(np.int64), his.astype(np.int64), marks.astype(np.int64))
            h1, h2 = prefix_sums(data, 0), prefix_sums(data, 1)
            inside = (q >= 0) & (q + STEP - 1 + length <= len(data))
            a, z = np.where(inside, q, 0), np.where(inside, q + STEP - 1 + length, length)
            # A block that passes the text's ends spans nothing that could be repeated whole.
            whole = [np.where(inside, span_hash(h, a, z, k).view(np.int64), own) for k, (h, own) in enumerate(((h1, row), (h2, q)))]
            yield {"row": np.full(len(q), row), "q": q, "shared": span_hash(h1, q + STEP - 1, q + length, 0).view(np.int64), "w1": whole[0], "w2": whole[1]}

    asked = text.join(places, "row").select("row", "text", F.col("places.lo").alias("los"), F.col("places.hi").alias("his"), F.col("places.mark").alias("marks"))
    near = cut(asked.mapInPandas(lambda batches: gathered(x for b in batches for x in neighbours(b)), "row long, q int, shared long, w1 long, w2 long"))
    drop(core, common)
    # One block of each kind, whichever comes first, serves as partner for all of them; both its numbers are of the same row, and are hashed, not sorted.
    kinds = cut(near.groupBy("shared", "w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.first("row").alias("row"), F.first("q").alias("q")))
    spanned = near.join(kinds.where("n > 1"), ["shared", "w1", "w2"], "left_semi").select("row", F.col("q").alias("start"), (F.col("q") + STEP - 1 + length).alias("stop"))
    twice = repeated(kinds.select("shared", "row", "q"), "shared")
    open_blocks = listed(twice, F.col("q"), "qs")

    def strings(b: pd.DataFrame) -> Iterator[dict[str, np.ndarray]]:
        for row, t, qs in zip(b["row"], b["text"], b["qs"], strict=True):
            data = np.frombuffer(as_bytes(t), np.uint8)
            p = np.unique(qs.astype(np.int64)[:, None] + np.arange(STEP))
            p = p[(p >= 0) & (p <= len(data) - length)]
            yield {"row": np.full(len(p), row), "p": p} | {f"h{k + 1}": span_hash(prefix_sums(data, k), p, p + length, k).view(np.int64) for k in (0, 1)}

    found = text.join(open_blocks, "row").mapInPandas(lambda batches: gathered(x for b in batches for x in strings(b)), "row long, p int, h1 long, h2 long")
    found = cut(found)
    drop(twice)
    starts = repeated(found, "h1", "h2").select("row", F.col("p").alias("start"), (F.col("p") + length).alias("stop"))
    spans = blocks.unionByName(spanned).unionByName(starts).groupBy("row").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row, t, starts, stops in zip(b["row"], b["text"], b["starts"], b["stops"], strict=True):
                data = np.frombuffer(as_bytes(t), np.uint8)
                gone = covered(len(data), starts, stops)
                a, z = runs(gone)
                out.append((row, int(gone.sum()), len(a), hashlib.sha256(data[~gone].tobytes()).hexdigest(), [{"start": int(x), "stop": int(y)} for x, y in zip(a, z, strict=True)]))
            yield pd.DataFrame(out, columns=["row", "n_removed", "n_spans", "left", "spans"])

    return text.join(spans, "row").mapInPandas(remove, "row long, n_removed long, n_spans long, left string, spans array<struct<start:int,stop:int>>")
