"""Toxicity by a factorization machine over hashed terms.

A term is a word, or the first letters of a longer one, met at least 1, 2, 4 or 8 times; the powers of two that a text's
length reaches are terms too. A score is a bias, a weight for each term, and for each pair of terms the product of their
factors, so an insult may weigh more beside the mention of a group, or less in a long text, than the sum of both says.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_words import boundaries, pieces, prefix_hashes, text_bytes
from .common import cut, drop

#: Bytes of a word's beginnings that are terms, and the least number of times.
STEMS, TIMES = (4, 5, 6, 7, 8), (1, 2, 4, 8)
TIMES_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
#: A key holds the number of a text below this many, and the other 48 bits of a hash.
TEXTS, HASH = 1 << 12, ~np.uint64(0xFFFF)
#: Chi-square values that a term, and a pair of terms, must reach: one chance in a thousand, and far less for pairs, as there are many.
TERM_CHI, PAIR_CHI = 10.8, 60.0


def places(h: np.ndarray, time: int, bits: int) -> np.ndarray:
    return (h * TIMES_ODD[time] >> np.uint64(64 - bits)).astype(np.int64)


def lengths(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, place): a term for each power of two that a text's number of words reaches."""
    reached = np.where(words > 0, np.floor(np.log2(np.maximum(words, 1))).astype(int) + 1, 0)
    text = np.repeat(np.arange(len(words)), reached)
    power = np.arange(len(text)) - np.repeat(np.cumsum(reached) - reached, reached)
    return text, places(power.astype(np.uint64) + np.uint64(7), 3, bits)


def terms(column: pa.Array, bits: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, place), distinct and sorted, of all terms of a column of texts; of wanted places alone if given. Every word counts, however long the text."""
    data, offsets = text_bytes(column)
    starts, ends = boundaries(data, offsets)
    text = np.searchsorted(offsets, starts, "right") - 1
    keys, times = [], []
    for part in pieces(ends, starts):
        for which, h in prefix_hashes(data, starts[part], ends[part], STEMS):
            h &= HASH
            if wanted is not None:
                may = wanted[places(h, 0, bits)]
                for t in range(1, len(TIMES)):
                    may |= wanted[places(h, t, bits)]
                which, h = which[may], h[may]
            key, n = np.unique(text[part][which].astype(np.uint64) | h, return_counts=True)
            keys.append(key)
            times.append(n)
    key, n = np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, np.int64), *times])
    if len(keys) > len(STEMS) + 1:  # texts whose words are in several pieces
        key, back = np.unique(key, return_inverse=True)
        n = np.bincount(back, n, len(key))
    out = [lengths(np.bincount(text, minlength=len(column)), bits)]
    for t, least in enumerate(TIMES):
        k = key[n >= least]
        out.append(((k & ~HASH).astype(np.int64), places(k & HASH, t, bits)))
    found = np.concatenate([(a << bits) | p for a, p in out])
    found = np.unique(found if wanted is None else found[wanted[found & ((1 << bits) - 1)]])
    return found >> bits, found & ((1 << bits) - 1)


def term_rows(column: pa.Array, bits: int, wanted: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """The terms of each text, in order."""
    for i in range(0, len(column), TEXTS):
        part = column.slice(i, TEXTS)
        text, place = terms(part, bits, wanted)
        yield from np.split(place, np.searchsorted(text, np.arange(1, len(part))))


@dataclass
class Machine:
    """`slot` gives the row of `weight` and `factors` for each place, or -1; bounded by the hash space."""

    bits: int
    bias: float
    slot: np.ndarray
    weight: np.ndarray
    factors: np.ndarray

    def scores(self, column: pa.Array) -> np.ndarray:
        out = []
        for i in range(0, len(column), TEXTS):
            part = column.slice(i, TEXTS)
            text, place = terms(part, self.bits, self.slot >= 0)
            at, n = self.slot[place], len(part)
            v = self.factors[at]
            s = np.stack([np.bincount(text, v[:, q], n) for q in range(v.shape[1])], 1)
            z = self.bias + np.bincount(text, self.weight[at], n) + ((s * s).sum(1) - np.bincount(text, (v * v).sum(1), n)) / 2
            out.append(1 / (1 + np.exp(-np.clip(z, -35, 35))))
        return np.concatenate(out) if out else np.zeros(0)


def chi_square(a, b, pos: float, neg: float):
    """Of terms found in a of pos and b of neg rows; 0 where it isn't defined."""
    n, total = a + b, pos + neg
    under = n * (total - n) * pos * neg
    return np.where(under > 0, total * (a * neg - b * pos) ** 2 / np.maximum(under, 1e-300), 0.0)


def chosen_terms(rows: list[np.ndarray], y: np.ndarray, bits: int, common: int) -> np.ndarray:
    """Places of terms that go with the label, alone or as one of a pair among the `common` most frequent ones, and of lengths."""
    pos, neg = float(y.sum()), float(len(y) - y.sum())
    a, b = (np.bincount(np.concatenate([r for r, t in zip(rows, y, strict=True) if t == k] or [np.zeros(0, int)]), minlength=1 << bits).astype(float) for k in (1, 0))
    single = (chi_square(a, b, pos, neg) >= TERM_CHI) & (a + b >= 3)
    # A term of no weight of its own may matter beside another: all pairs of the most frequent of these.
    often = np.where(single | (a + b > 0.9 * len(y)) | (a + b < 5), 0, a + b)
    top = np.argsort(-often, kind="stable")[:common]
    top = top[often[top] > 0]
    seat = np.full(1 << bits, -1)
    seat[top] = np.arange(len(top))
    both = {}
    for k in (1, 0):
        both[k] = np.zeros((len(top), len(top)))
        part = [r for r, t in zip(rows, y, strict=True) if t == k]
        for i in range(0, len(part), 2048):
            x = np.zeros((len(part[i : i + 2048]), len(top)), np.float32)
            for j, r in enumerate(part[i : i + 2048]):
                x[j, seat[r][seat[r] >= 0]] = 1
            both[k] += x.T @ x
    paired = (chi_square(both[1], both[0], pos, neg) >= PAIR_CHI) & ~np.eye(len(top), dtype=bool)
    keep = single.copy()
    keep[top[paired.any(1)]] = True
    keep[lengths(np.array([1 << 40]), bits)[1]] = True
    return np.flatnonzero(keep)


def fit(rows: list[np.ndarray], y: np.ndarray, bits: int, rank: int = 4, rounds: int = 300, step: float = 0.05, ridge: float = 1e-3, common: int = 512, seed: int = 1) -> Machine:
    """Logistic loss over all rows at once by Adam. With one class only, or no rows, a machine of nothing but a bias."""
    pos, n = float(y.sum()), len(y)
    if not 0 < pos < n:
        return Machine(bits, log((pos + 0.5) / (n - pos + 1.5)), np.full(1 << bits, -1, np.int32), np.zeros(1), np.zeros((1, rank)))
    kept = chosen_terms(rows, y, bits, common)
    slot = np.full(1 << bits, -1, np.int32)
    slot[kept] = np.arange(len(kept))
    at = [slot[r][slot[r] >= 0] for r in rows]
    row, col = np.repeat(np.arange(n), [len(x) for x in at]), np.concatenate(at)
    table = np.zeros((len(kept), 1 + rank))
    table[:, 1:] = np.random.default_rng(seed).normal(0, 0.05, (len(kept), rank))
    decay = np.array([ridge / 10] + [ridge] * rank)
    bias, mean, power, bias_mean, bias_power = log(pos / (n - pos)), np.zeros_like(table), np.zeros_like(table), 0.0, 0.0
    by_column = lambda index, x, size: np.stack([np.bincount(index, x[:, q], size) for q in range(x.shape[1])], 1)
    for t in range(1, rounds + 1):
        x = table[col]
        s = by_column(row, x, n)
        squares = np.bincount(row, (x[:, 1:] ** 2).sum(1), n)
        z = bias + s[:, 0] + ((s[:, 1:] ** 2).sum(1) - squares) / 2
        d = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y) / n
        slope = s[row] - x
        slope[:, 0] = 1
        g = by_column(col, d[row][:, None] * slope, len(kept)) + decay * table
        mean, power = 0.9 * mean + 0.1 * g, 0.999 * power + 0.001 * g * g
        table -= step * (mean / (1 - 0.9**t)) / (np.sqrt(power / (1 - 0.999**t)) + 1e-10)
        bias_mean, bias_power = 0.9 * bias_mean + 0.1 * d.sum(), 0.999 * bias_power + 0.001 * d.sum() ** 2
        bias -= step * (bias_mean / (1 - 0.9**t)) / (np.sqrt(bias_power / (1 - 0.999**t)) + 1e-10)
    return Machine(bits, bias, slot, table[:, 0].copy(), table[:, 1:].copy())


def whole(text_col: str):
    return F.lower(F.coalesce(F.col(text_col), F.lit("")))


def learn(docs: DataFrame, labels: DataFrame, sample: int = 20_000, bits: int = 18, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> Machine:
    """A machine fitted on at most `sample` labelled rows (the only bounded step), chosen by a hash.

    The ids of the sample are the only thing broadcast, so no text moves but the sample's. Of labels of one id the
    largest counts; null labels, null ids and labels of unknown ids count nothing. Where one id has very
    many rows, all are looked at and at most `sample` of them fit.
    """
    y = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).cast("int").alias("_y"))
    y = cut(y.orderBy(F.xxhash64("_id"), "_id").limit(sample), "labels")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [t.astype(np.int32).tobytes() for t in term_rows(b["text"], bits)]
            yield pa.RecordBatch.from_arrays([b["h"], b["y"], pa.array(packed, pa.binary())], ["h", "y", "t"])

    rows = docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("text")).join(F.broadcast(y), "_id")
    rows = rows.select(F.xxhash64("_id", "text").alias("h"), F.col("_y").alias("y"), "text").mapInArrow(pack, "h long, y int, t binary")
    found = rows.orderBy("h", "y", "t").limit(sample).toPandas()
    drop(y)
    return fit([np.frombuffer(t, np.int32) for t in found["t"]], found["y"].to_numpy(float), bits, **options)


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row, repeated and null ids too; null and empty texts score as a text without terms."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(m.scores(b["text"]))], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(doc_id, folds: int = 5):
    """Whether an id's labels are kept from learning; a null id counts as an empty text, and is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def score_toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, by a machine learnt from labels of ids that aren't held out.

    Only the text is an input of a score. An empty table gives no rows; without labels every score is the same and below 0.5.
    """
    machine = learn(docs, labels.where(~held_out(F.col("doc_id"))), **options)
    return score(docs, machine).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
