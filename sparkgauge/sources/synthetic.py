"""Synthetic conversations: draws depend on the seed and the row alone, so a lost task draws the same again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that prompts are made of, where none are given.
WORDS = ("river", "stone", "amber", "quiet", "north", "paper", "cloud", "seven", "garden", "signal", "harbor", "lantern")


def uniform(seed: int, *ids: str) -> Column:
    """A number in (0, 1) for each seed and ids."""
    return (F.pmod(F.xxhash64(*ids, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normal(seed: int, *ids: str) -> Column:
    """A standard normal number, by Box and Muller."""
    return F.sqrt(-2 * F.log(uniform(2 * seed, *ids))) * F.cos(6.283185307179586 * uniform(2 * seed + 1, *ids))


def integers(mean: float, seed: int, *ids: str, spread: float | None = None, least: int | None = None, most: int | None = None) -> Column:
    """Whole numbers around mean: constant, even between bounds, or normal between bounds (mean and five deviations, 1 at least)."""
    if spread is None and least is None and most is None or least is not None and least == most:
        return F.lit(int(mean if least is None else least)).cast("bigint")
    if spread is None:
        lo, hi = int(mean if least is None else least), int(mean if most is None else most)
        return (lo + F.floor(uniform(seed, *ids) * (hi - lo + 1))).cast("bigint")
    lo, hi = max(1, round(mean - 5 * spread)) if least is None else least, round(mean + 5 * spread) if most is None else most
    return F.greatest(F.lit(lo), F.least(F.lit(hi), F.bround(mean + spread * normal(seed, *ids)))).cast("bigint")


def bucket(weights: list[float], seed: int, *ids: str) -> Column:
    """The number of a bucket, drawn by weight."""
    total, cum, u = sum(weights), 0.0, uniform(seed, *ids)
    case = None
    for i, w in enumerate(weights[:-1]):
        cum += w / total
        case = F.when(u < cum, i) if case is None else case.when(u < cum, i)
    return (case.otherwise(len(weights) - 1) if case is not None else F.lit(0)).cast("int")


def conversations(spark: SparkSession, n: int, turns: int = 1, prompt: dict | None = None, output: dict | None = None, prefixes: list[tuple[float, int]] = (), words: tuple[str, ...] = WORDS, seed: int = 0) -> DataFrame:
    """(conv_id, turn, prefix, prompt, prompt_tokens, output_tokens_count); a token is a word.

    prompt and output are options of `integers`; prefixes are (weight, tokens) of buckets, drawn by
    conversation and used in its first turn. Every prompt begins with its own mark, so that no two are equal.
    """
    p, o = {"mean": 128} | (prompt or {}), {"mean": 64} | (output or {})
    x = spark.range(n).withColumnRenamed("id", "conv_id").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    ids = ("conv_id", "turn")
    x = x.withColumns({"prompt_tokens": _drawn(p, 8 * seed + 1, ids), "output_tokens_count": _drawn(o, 8 * seed + 2, ids)})
    vocabulary = F.array(*map(F.lit, words))
    mark = F.concat(F.lit("#"), F.col("conv_id"), F.lit("."), F.col("turn"))
    start = F.pmod(F.xxhash64(*ids, F.lit(seed)), F.lit(len(words))).cast("int")
    body = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("prompt_tokens").cast("int"))), lambda i: F.when(i == 1, mark).otherwise(F.get(vocabulary, F.pmod(start + i * i, F.lit(len(words))))))
    x = x.withColumn("prompt", F.array_join(body, " "))
    if not prefixes:
        return x.withColumn("prefix", F.lit(None).cast("string"))
    texts = F.array(*(F.lit(" ".join(words[(b + i) % len(words)] for i in range(size))) for b, (_, size) in enumerate(prefixes)))
    return x.withColumn("prefix", F.when(F.col("turn") == 0, F.get(texts, bucket([w for w, _ in prefixes], 8 * seed + 3, "conv_id"))))


def _drawn(options: dict, seed: int, ids: tuple[str, ...]) -> Column:
    o = dict(options)
    return integers(o.pop("mean"), seed, *ids, **o)
