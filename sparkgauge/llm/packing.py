"""Best-fit packing, improved by swaps and moves between underfull bins."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .tokens import ByteBpe


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Best-fit decreasing: bins as lists of item numbers."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        k = bisect_left(room, (n, -1))
        if k < len(room):
            free, b = room.pop(k)
        else:
            free, b = size, len(bins)
            bins.append([])
        bins[b].append(i)
        if free > n:
            insort(room, (free - n, b))
    return bins


def improve(bins: list[list[int]], lengths: list[int], size: int) -> list[list[int]]:
    """Moves one item, or exchanges one for one or two for one, between underfull bins while the sum of squared fills grows.

    Works on the emptiest bin first, so that bins run empty; every step raises a bounded whole
    number, so it ends. A bin from which no step helps is set aside.
    """
    bins = [list(b) for b in bins if b]
    fill = [sum(lengths[i] for i in b) for b in bins]
    live = sorted((k for k in range(len(bins)) if fill[k] < size), key=lambda k: (-fill[k], k))  # the emptiest is last
    while len(live) > 1:
        a = live[-1]
        others = [k for k in live if k != a]
        step = best_step(a, others, bins, fill, lengths, size)
        if step is None:
            live.pop()
            continue
        b, out, back = step
        for i in out:
            bins[a].remove(i)
        for i in back:
            bins[b].remove(i)
        bins[a] += back
        bins[b] += out
        moved = sum(lengths[i] for i in out) - sum(lengths[i] for i in back)
        fill[a] -= moved
        fill[b] += moved
        live = sorted((k for k in live if bins[k] and fill[k] < size), key=lambda k: (-fill[k], k))
    return [b for b in bins if b]


def best_step(a: int, others: list[int], bins, fill, lengths, size):
    """The step out of bin a that fills another bin most: (bin, items out, items back) or None."""
    owner = np.array([k for k in others for _ in bins[k]])
    item = np.array([i for k in others for i in bins[k]])
    size_of = np.array([lengths[i] for i in item])
    free = np.array([size - fill[k] for k in others])
    full = np.array([fill[k] for k in others])
    room, have = size - np.array(fill)[owner], np.array(fill)[owner]
    best = (0, None)
    mine: dict[int, list[int]] = {}  # by length; distinct lengths that fit in a bin are few
    for i in sorted(bins[a]):
        mine.setdefault(lengths[i], []).append(i)
    singles = {n: (own[0],) for n, own in mine.items()}
    pairs: dict[int, tuple] = {}
    for n, own in mine.items():
        for m, more in mine.items():
            if m < n:
                pairs.setdefault(n + m, (own[0], more[0]))
        if len(own) > 1:
            pairs.setdefault(2 * n, (own[0], own[1]))
    for n, out in singles.items():  # one item moves
        gain = np.where(free >= n, 2 * n * (full - fill[a] + n), 0)
        if (g := gain.max()) > best[0]:
            best = (int(g), (others[int(gain.argmax())], list(out), []))
    for n, out in (*singles.items(), *pairs.items()):  # one or two items for a smaller one
        d = n - size_of
        gain = np.where((d > 0) & (d <= room), 2 * d * (have - fill[a] + d), 0)
        if (g := gain.max()) > best[0]:
            k = int(gain.argmax())
            best = (int(g), (int(owner[k]), list(out), [int(item[k])]))
    return best[1]


def pack(lengths: list[int], size: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each item."""
    number, offset = [0] * len(lengths), [0] * len(lengths)
    for k, b in enumerate(improve(best_fit(lengths, size), lengths, size)):
        at = 0
        for i in b:
            number[i], offset[i] = k, at
            at += lengths[i]
    return number, offset


PIECES = "array<struct<piece:int,start:long,length:long,ids_crc32:long>>"


def cut_pieces(docs: DataFrame, size: int, path: str | None, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of rows (doc_id, text); of a document longer than a sequence the first piece holds the remainder."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe, end = ByteBpe(path), np.uint32(end_id).tobytes()
        for texts in batches:
            rows = []
            for t in texts:
                raw = bpe.encode(t) + end
                n = len(raw) // 4
                found, start, piece, length = [], 0, 0, n % size or size
                while start < n:
                    found.append({"piece": piece, "start": start, "length": length, "ids_crc32": zlib.crc32(raw[4 * start : 4 * (start + length)])})
                    start, piece, length = start + length, piece + 1, size
                rows.append(found)
            yield pd.Series(rows)

    return docs.select("doc_id", F.inline(F.pandas_udf(run, PIECES)(F.col("text"))))


def pack_documents(docs: DataFrame, size: int = 1024, path: str | None = None, end_id: int = 2, group_items: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A piece as long as a sequence fills one of its own, with a negative number, and moves nowhere. The others are dealt
    by a hash over groups of about group_items, whose number follows theirs; each group is packed whole in
    one task of bounded memory, and costs at most about one sequence more than packing all at once. A null
    text is the end id alone; a null id and repeated ids are packed like others; an empty table gives no
    rows; other columns are not carried.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    pieces = cut(cut_pieces(docs, size, path, end_id).withColumn("n", F.monotonically_increasing_id()), "pieces")  # equal rows have numbers of their own
    full = pieces.where(F.col("length") == size).withColumn("sequence_id", -1 - F.col("n")).withColumn("offset", F.lit(0).cast("long"))
    open_ = pieces.where(F.col("length") < size)
    groups = max(1, round(open_.count() / group_items))
    open_ = open_.withColumn("g", F.pmod(F.xxhash64("n"), F.lit(groups))).drop("n")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("doc_id", "piece", "ids_crc32")])
        number, offset = pack(t["length"].to_pylist(), size)
        ids = np.array(number, np.int64) * groups + t["g"].to_numpy()
        return t.drop_columns("g").append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset, pa.int64()))

    id_type = pieces.schema["doc_id"].dataType.simpleString()
    packed = open_.groupBy("g").applyInArrow(run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return packed.unionByName(full.drop("n"))
