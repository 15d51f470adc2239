"""Token counts by a two-tier lookup: a broadcast table of frequent pre-token lengths, then worker caches."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import WordBpe

SUMMARY = "pieces array<string>, counts array<long>"


class Frequent(Counter):
    """Counts of frequent strings in bounded space: when there are too many, every count falls by that of the one to be dropped first."""

    def bound(self, most: int) -> None:
        if len(self) > 4 * most:
            low = sorted(self.values())[len(self) - most]
            kept = {k: v - low for k, v in self.items() if v > low}
            self.clear()
            super().update(kept)

    def summary(self, most: int, longest: int) -> pd.DataFrame:
        top = [(k, v) for k, v in self.most_common(most) if len(k) <= longest]
        return pd.DataFrame({"pieces": [[k for k, _ in top]], "counts": [[v for _, v in top]]})


def frequent_lengths(docs: DataFrame, path: str | None, entries: int, longest: int) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of all documents; which they are changes nothing but the speed.

    Each task keeps a summary of bounded size and gives one row of at most a quarter of `entries` strings of
    at most `longest` characters; these rows, one for each task, are merged in two steps, each in bounded
    space: in 64 tasks, then in one. Pre-tokens are never shuffled.
    """
    if not entries:
        return {}

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, bpe = Frequent(), WordBpe(path)
        for b in batches:
            for t in b["text"]:
                if t and "<|" not in t:
                    for part in bpe.pieces(t):
                        seen.update(part)
                        seen.bound(4 * entries)
        yield seen.summary(entries // 4, longest)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = Frequent()
        for b in batches:
            for pieces, counts in zip(b["pieces"], b["counts"], strict=True):
                seen.update(dict(zip(pieces, map(int, counts), strict=True)))
                seen.bound(4 * entries)
        yield seen.summary(entries, longest)

    parts = docs.select("text").mapInPandas(summarise, SUMMARY).repartition(64).mapInPandas(merge, SUMMARY)
    rows = parts.repartition(1).mapInPandas(merge, SUMMARY).collect()
    top = sorted({p for r in rows for p in r.pieces})
    measure = WordBpe(path).length
    return {p: measure(p) for p in top}


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 2048, entries: int = 16384, longest: int = 32, cache: int = 250_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document.

    Null or empty texts have 0 bytes and tokens; repeated and null ids give a row each; other columns are
    not carried; an empty table gives no rows. Texts with special strings are encoded whole by the library.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs.select(F.col(text_col).alias("text")), path, entries, longest))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = WordBpe(path, table.value, cache)
        for texts in batches:
            yield texts.map(bpe.count)

    n = F.pandas_udf(run, "long")(F.col(text_col))
    found = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), n.alias("n_tokens"))
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
