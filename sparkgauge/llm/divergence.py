"""How far the sources of a language differ in their terms, and which terms set a source apart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_words import LOWER, boundaries, group_slices, text_bytes, text_shares
from .common import cut, drop

SCALE = 1_000_000_000
#: Counted (group, term) rows in a block of terms, on average.
BLOCK = 1 << 17


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of each share of a batch: how often a term occurs in the group's texts, and in how many of them."""
    for b in (share for whole in batches for share in text_shares(whole, "text")):
        data, offsets = text_bytes(b["text"])
        data = LOWER[data]
        starts, ends = boundaries(data, offsets)
        if not len(starts):
            continue
        first, term = group_slices(data, starts, ends)
        group = pa.StructArray.from_arrays([b["lang"], b["source"]], ["lang", "source"])
        seen: dict = {}
        of_text = np.array([seen.setdefault((x["lang"], x["source"]), len(seen)) for x in group.to_pylist()], np.int64)
        text = np.searchsorted(offsets, starts, "right") - 1
        width = len(first)
        # A text's terms once with their counts, then the groups'.
        key, n = np.unique(text * width + term, return_counts=True)
        key, back = np.unique(of_text[key // width] * width + key % width, return_inverse=True)
        raw = data.tobytes()
        used, at = np.unique(key % width, return_inverse=True)
        words = pa.array([raw[starts[k] : ends[k]].decode() for k in first[used]], pa.string()).take(pa.array(at))
        names = list(seen)
        columns = [pa.array([x[j] for x in names], pa.string()).take(pa.array(key // width)) for j in (0, 1)]
        counts = [pa.array(np.bincount(back, w, len(key)).astype(np.int64)) for w in (n, None)]
        yield pa.RecordBatch.from_arrays([*columns, words, *counts], ["lang", "source", "term", "n", "docs"])


def probability(count: np.ndarray, total, kept) -> np.ndarray:
    """1 + floor(SCALE x (count + 2) / (total + 2 x kept)) by long division, exact below 9e15 terms in all."""
    under = np.asarray(total + 2 * kept, np.int64)
    left, out = np.asarray(count, np.int64) + 2, 0
    for _ in range(3):
        whole, left = np.divmod(left * 1000, under)
        out = out * 1000 + whole
    return out + 1


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def sums(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of values; reduceat gives an empty run its next value, so those are set to 0."""
    if not len(values):
        return np.zeros(len(sizes), np.int64)
    found = np.add.reduceat(values, np.minimum(begins, len(values) - 1))
    return np.where(sizes > 0, found, 0)


def compare_block(top: int):
    """For a block of a language's terms: what each pair of sources differs by over them, and each source's foremost terms of it."""

    def run(key: tuple, counts: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        groups = groups.sort_values("source")
        names, total, kept = groups["source"].to_numpy(), groups["total"].to_numpy(np.int64), int(groups["kept"].iloc[0])
        parts = []
        row = pd.Index(names).get_indexer(counts["source"])
        col, words = pd.factorize(counts["term"], sort=True)
        # CSR: rows are sources, columns the block's terms.
        order = np.lexsort((col, row))
        row, col, n = row[order], col[order], counts["n"].to_numpy(np.int64)[order]
        size = np.bincount(row, minlength=len(names))
        begin = np.cumsum(size) - size
        width = len(words)
        if kept:
            none = probability(np.zeros(len(names), np.int64), total, kept)
            p = probability(n, total[row], kept)
            every = np.zeros(width, np.int64)
            np.add.at(every, col, n)
            q = probability(every, total.sum(), kept)[col]
            apart = np.flatnonzero((p > q) & (n > 0))
            f = difference(p[apart], q[apart])
            best = np.lexsort((col[apart], -f, row[apart]))
            r = row[apart][best]
            rank = np.arange(len(r)) - np.searchsorted(r, r)
            best, r = best[rank < top], r[rank < top]
            parts.append(pd.DataFrame({"source": names[r], "part": "term", "item": np.asarray(words)[col[apart][best]], "value": f[best]}))
        for a in range(len(names) - 1):
            others = np.arange(a + 1, len(names))
            value = np.zeros(len(others), np.int64)
            if kept:
                own = np.full(width, none[a])
                mine = slice(begin[a], begin[a] + size[a])
                own[col[mine]] = p[mine]
                # Every other source as if it had no term, then its own terms put right.
                value += (width - size[a]) * difference(none[others], none[a])
                for i in range(0, len(others), 64):
                    value[i : i + 64] += difference(p[mine][None], none[others[i : i + 64], None]).sum(1)
                rest = slice(begin[a] + size[a], None)
                mend = difference(p[rest], own[col[rest]]) - difference(none[row[rest]], own[col[rest]])
                value += sums(mend, begin[others] - begin[a + 1], size[others])
            parts += [pd.DataFrame({"source": x, "part": "pair", "item": y, "value": value}) for x, y in ((names[a], names[others]), (names[others], names[a]))]
        found = pd.concat(parts) if parts else pd.DataFrame({"source": [], "part": [], "item": [], "value": []})
        found.insert(0, "lang", key[0])
        return found.astype({"value": "int64"})

    return run


def audit_sources(docs: DataFrame, least: int = 10, top: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): what sets the sources of a language apart.

    Part `pair` has a row for each other source of the language, part `term` at most `top` for terms that the
    source has more often than the language. Null text, lang and source count as empty strings; a repeated row is
    another document; terms in fewer than `least` documents of a language count nowhere, and a language
    without a kept term gives pairs of value 0. An empty table gives no rows; other columns are not read.

    Terms are counted batch by batch, so a group of any size or a common word is summed up before it
    moves. Terms are then dealt to blocks of about `BLOCK` counts; a block holds for each source only its own terms, and the
    sources' totals are a row for each group and block.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    counted = docs.mapInArrow(count_terms, "lang string, source string, term string, n long, docs long")
    counted = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    found = Window.partitionBy("lang", "term")
    kept = cut(counted.withColumn("docs", F.sum("docs").over(found)).where(F.col("docs") >= least).drop("docs"), "terms")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = kept.groupBy("lang", "term").agg(F.lit(1).alias("one")).groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["total", "kept"])
    blocks = max(1, kept.count() // BLOCK)
    dealt = kept.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int"))
    each = cut(groups, "groups")
    copies = each.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt, copies = dealt.toDF(*dealt.columns), copies.toDF(*copies.columns)
    parts = dealt.groupBy("lang", "block").cogroup(copies.groupBy("lang", "block")).applyInPandas(compare_block(top), "lang string, source string, part string, item string, value long")
    # Terms of a group's blocks: at most `top` of each, and the first of these are the group's.
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    parts = cut(parts, "parts")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = pairs.unionByName(parts.where("part = 'term'")).withColumn("rank", F.row_number().over(order))
    drop(kept, each)
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))
