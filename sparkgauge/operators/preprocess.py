"""Prompts cut, padded or dropped to a length in words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import words
from .clusters import heads_of
from .mapping import choose
from .ordered import running_sum


def trim(df: DataFrame, text: str, most: int) -> DataFrame:
    """Prompt and count of its first `most` words."""
    return df.withColumn("prompt", F.array_join(F.slice(words(F.col(text)), 1, most), " ")).withColumn("prompt_tokens", F.size(words(F.col("prompt"))).cast("bigint"))


def ignore_short(df: DataFrame, text: str, least: int) -> DataFrame:
    """Rows with `least` words or more."""
    return df.where(F.size(words(F.col(text))) >= least)


def pad_short(df: DataFrame, text: str, least: int, pad: str) -> DataFrame:
    """Short prompts get words of the pad, going round, up to the length; an empty pad is an error."""
    fill = pad.split()
    if not fill:
        raise ValueError("the pad has no words")
    have = words(F.col(text))
    ring = F.array(*map(F.lit, fill))
    missing = F.greatest(F.lit(0), least - F.size(have))
    more = F.when(missing > 0, F.transform(F.sequence(F.lit(0), missing - 1), lambda i: ring[(i % len(fill)).cast("int")])).otherwise(F.array().cast("array<string>"))
    return df.withColumn("prompt", F.array_join(F.concat(have, more), " ")).withColumn("prompt_tokens", F.size(words(F.col("prompt"))).cast("bigint"))


def fail_short(df: DataFrame, text: str, least: int) -> DataFrame:
    """The rows; a short one ends the query with an error."""
    short = F.size(words(F.col(text))) < least
    return df.withColumn(text, F.when(short, F.raise_error(F.lit(f"a prompt has fewer than {least} words")).cast("string")).otherwise(F.col(text)))


def prepare(df: DataFrame, target: Column, output: Column, short: str = "ignore", pad: str = "", most_prefix: int | None = None, count_prefix: bool = False, aliases: dict | None = None) -> DataFrame:
    """df with prompt, prefix, prompt_tokens_count and output_tokens_count, by columns that the mapper finds.

    A prefix is cut to most_prefix words, and counts towards the target if asked. Rows without room for a
    prompt go; short prompts are dropped ("ignore"), padded ("pad") or an error ("error"); long ones are cut.
    """
    prompt, prefix, _ = choose(df, aliases)
    first = F.slice(words(F.col(prefix)), 1, most_prefix) if prefix and most_prefix is not None else words(F.col(prefix)) if prefix else F.array().cast("array<string>")
    x = df.withColumns({"_prefix": first, "_words": words(F.col(prompt)), "_target": target}).withColumn("_room", F.col("_target") - (F.size("_prefix") if count_prefix else 0))
    x = x.where((F.col("_target") > 0) & (F.col("_room") > 0))
    lacks = F.col("_room") - F.size("_words")
    if short == "ignore":
        x = x.where(lacks <= 0)
    elif short == "error":
        x = x.withColumn("_words", F.when(lacks > 0, F.raise_error(F.lit("a prompt is too short")).cast("array<string>")).otherwise(F.col("_words")))
    else:
        if not pad.split():
            raise ValueError("the pad has no words")
        ring = F.array(*map(F.lit, pad.split()))
        more = F.when(lacks > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), lacks - 1), lambda i: ring[(i % F.size(ring)).cast("int")])).otherwise(F.array().cast("array<string>"))
        x = x.withColumn("_words", F.concat("_words", more))
    x = x.withColumn("_words", F.slice("_words", F.lit(1), F.col("_room").cast("int")))
    x = x.withColumns({"prompt": F.array_join("_words", " "), "prefix": F.array_join("_prefix", " "), "prompt_tokens_count": F.size("_words").cast("bigint"), "output_tokens_count": output})
    return x.drop("_prefix", "_words", "_target", "_room")


def concatenate(df: DataFrame, keys: list[str], order: str, text: str, least: int, between: str = " ") -> DataFrame:
    """(keys, first, prompt, prompt_tokens): rows of a key joined in order until they have `least` words; an unfinished end goes.

    order is unique in a key. A prompt begins with the first row that has `least` words or more between it and the
    beginning of the one before, so the beginnings are heads of clusters over the words that came before each row. Keys may be
    of any size, or none; only a prompt's own rows meet in a task.
    """
    if least < 1:
        raise ValueError("a prompt needs a word at least")
    x = df.select(*keys, F.col(order).alias("_o"), F.col(text).alias("_text"), F.size(words(F.col(text))).cast("bigint").alias("_n"), F.lit(1).alias("_one"))
    x = running_sum(x, keys, "_o", {"_end": "_n", "_i": "_one"}).withColumn("t", F.col("_end") - F.col("_n"))
    x = x.join(heads_of(x.select(*keys, "t"), keys, least - 1), [*keys, "t"])
    parts = F.transform(F.array_sort(F.collect_list(F.struct("_o", "_text"))), lambda r: r["_text"])
    out = x.groupBy(*keys, "head").agg((F.min("_i") - 1).cast("int").alias("first"), F.array_join(parts, between).alias("prompt"), F.sum("_n").alias("prompt_tokens"))
    return out.where(F.col("prompt_tokens") >= least).drop("head")


def first_rows(df: DataFrame, most: int, order: str) -> DataFrame:
    """The first `most` rows."""
    return df.orderBy(order).limit(most)


def exactly(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first n rows; fewer are an error."""
    out = first_rows(df, n, order)
    if out.count() < n:
        raise ValueError(f"fewer than {n} rows")
    return out


def sample_rows(df: DataFrame, most: int, key: str, seed: int = 0) -> DataFrame:
    """`most` rows by a seeded hash of the key."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))).limit(most)


def shards(df: DataFrame, n: int, order: str, shift: int = 0) -> DataFrame:
    """df with `shard`: the row's place in the order of a unique number, plus a shift, modulo n."""
    x = running_sum(df.withColumn("_one", F.lit(1)), [], order, {"_place": "_one"})
    return x.withColumn("shard", (F.col("_place") - 1 + shift) % n).drop("_one", "_place")


def without_failures(df: DataFrame, value: str) -> DataFrame:
    """Rows whose value came out; that none did is an error."""
    out = df.where(F.col(value).isNotNull())
    if not out.head(1) and df.head(1):
        raise ValueError("the transformation failed in every row")
    return out
