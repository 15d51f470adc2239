"""Quality rules as weak supervision: rules vote or abstain, EM learns their accuracies, a posterior decides."""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name

SYMBOLS = "#*$%&|<>"
SPACE = re.compile(r"[\x20\x09-\x0D]")
UPPER, LOWER = re.compile(r"[A-Z\u00c0-\u00d6\u00d8-\u00de]"), re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]")
BASE = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long"}
MORE = {"n_lines": "long", "n_distinct": "long", "n_alpha": "long", "n_same_next": "long", "n_ends": "long", "n_upper": "long", "n_lower": "long"}
FEATURES = ", ".join(f"{k} {v}" for k, v in (BASE | MORE).items())
END = re.compile(r"[.!?\u3002\uff01\uff1f](?![^\s\"'\u201d)\]])")


def repeated_words(ids: np.ndarray, width: int = 8) -> int:
    """Words covered by windows of `width` words that are found twice or more; exact, by doubling ranks."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    rank, step = ids, 1
    while step < width:
        pair = rank[:-step].astype(np.int64) * (int(rank.max()) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
        step *= 2
    twice = np.bincount(rank)[rank] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure(text: str | None) -> tuple:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    lines = [x for x in text.split("\n") if x and SPACE.sub("", x)] if "\n" in text else [text] * bool(words)
    spaces = sum(map(text.count, " \t\n\x0b\x0c\r"))
    return (
        len(words), len(text) - spaces, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(ids) if len(known) < len(words) else 0,
        len(lines), len(known), sum(map(bytes.isalpha, (w.strip(b".,;:!?\"'()") for w in words))) + sum(not w.isascii() for w in words), int((ids[1:] == ids[:-1]).sum()),
        len(END.findall(text)), len(UPPER.findall(text)), len(LOWER.findall(text)),
    )


def measure_all(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([measure(t) for t in texts], columns=[*BASE, *MORE])


def measured(text: Column) -> Column:
    return F.pandas_udf(measure_all, FEATURES)(text)


def rules(at: str) -> dict[str, tuple[Column, Column]]:
    """Name: (condition to vote good, condition to vote bad) over the features in struct `at`; between the two a rule abstains."""
    x = lambda c: F.col(f"`{at}`.`{c}`")
    share = lambda c, of="n_words": x(c) / F.greatest(x(of), F.lit(1))
    n, variety = x("n_words"), F.ln(F.greatest(x("n_distinct"), F.lit(1))) / F.ln(F.greatest(x("n_words"), F.lit(2)))
    upper = x("n_upper") / F.greatest(x("n_upper") + x("n_lower"), F.lit(1))
    return {
        "length": (n >= 50, n < 25),
        "word_length": (share("word_chars").between(3, 7), ~share("word_chars").between(2, 12)),
        "symbols": (share("n_symbols") < 0.02, share("n_symbols") > 0.1),
        "dup_lines": ((x("n_dup_lines") == 0) & (x("n_lines") > 2), share("n_dup_lines", "n_lines") > 0.3),
        "repeats": ((share("n_repeat_words") < 0.02) & (n >= 50), share("n_repeat_words") > 0.2),
        "variety": (variety > 0.85, variety < 0.65),
        "stutter": (share("n_same_next") < 0.03, share("n_same_next") > 0.15),
        "prose": (share("n_alpha") > 0.8, share("n_alpha") < 0.4),
        "sentences": (share("n_ends").between(0.02, 0.3), ~share("n_ends").between(0.004, 0.6)),
        "shouting": (upper < 0.15, upper > 0.5),
    }


def votes(at: str) -> list[Column]:
    return [F.when(bad, -1).when(good, 1).otherwise(0).alias(f"v_{k}") for k, (good, bad) in rules(at).items()]


#: P(vote bad, abstain, vote good) of a good and of a bad text, before anything is learnt.
START = np.array([[0.01, 0.19, 0.8], [0.2, 0.3, 0.5]])


def learn(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200, prior: float = 0.8, trust: float = 0.02) -> dict:
    """EM over counts of vote patterns (at most 3 ** rules of them, whatever the corpus size).

    Each rule has P(vote | good) and P(vote | bad) over bad votes, abstention and good votes. The start
    weighs in either class as that share of the documents, 20 at least: enough to say which class is the
    good one, and little beside what the votes say. Stops when nothing moves by more than 1e-9.
    """
    if not patterns:
        return {"prior": prior, "table": []}
    v = np.array([p for p, _ in patterns]) + 1
    w = np.array([c for _, c in patterns], float)
    table = start = np.stack([START] * v.shape[1])
    known = max(20.0, trust * w.sum())
    for _ in range(rounds):
        like = np.log(table)[np.arange(v.shape[1]), :, v].sum(1) + np.log([prior, 1 - prior])
        post = 1 / (1 + np.exp(np.clip(like[:, 1] - like[:, 0], -700, 700)))
        new = known * start
        for vote in range(3):
            at = v == vote
            new[:, 0, vote] += (at * (w * post)[:, None]).sum(0)
            new[:, 1, vote] += (at * (w * (1 - post))[:, None]).sum(0)
        new /= new.sum(2, keepdims=True)
        moved = np.abs(new - table).max()
        table, prior = new, min(0.99, max(0.01, float((w * post).sum() / w.sum())))
        if moved < 1e-9:
            break
    return {"prior": prior, "table": table.tolist()}


def judged(found: DataFrame, at: str) -> tuple[Column, Column]:
    """(base_failed, quality) over the features in struct `at` of found, a table.

    The model is learnt from all rows that pass the base, as the others go anyway and have votes of their own kind.
    """
    n, repeats = F.col(f"`{at}`.n_words"), F.col(f"`{at}`.n_repeat_words")
    failed = (n < 20) | (100 * repeats > 30 * n)
    names = [f"v_{k}" for k in rules(at)]
    counts = found.where(~failed).select(*votes(at)).groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3 ** 10 rows
    model = learn(sorted((tuple(int(r[c]) for c in names), int(r["n"])) for r in counts))
    weight = F.lit(log(model["prior"] / (1 - model["prior"])))
    for (good, bad), table in zip(rules(at).values(), model["table"], strict=False):
        step = [log(g / b) for g, b in zip(*table, strict=True)]
        weight = weight + F.when(bad, step[0]).when(good, step[2]).otherwise(step[1])
    return failed, 1 / (1 + F.exp(F.least(F.lit(700.0), -weight)))


def score_documents(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, base counts, base_failed, posterior quality, kept and the rules' votes.

    Null texts count as no words, so they fail; repeated and null ids give a row each; other columns are
    not carried; an empty table gives no rows. kept: not base_failed and posterior >= threshold.
    """
    found = cut(docs.select(F.col(id_col).alias("doc_id"), measured(F.col(text_col)).alias("f")))
    failed, quality = judged(found, "f")
    return found.select("doc_id", *(f"f.{k}" for k in BASE), failed.alias("base_failed"), (~failed & (quality >= threshold)).alias("kept"), quality.alias("quality"), *votes("f"))


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score_documents keeps, with their own columns, whatever their names.

    Texts are measured as they are copied to a table, which the result filters: no shuffle. Null and empty
    texts go; rows of a repeated or null id are judged one by one; an empty table stays empty.
    """
    at = free_name(docs, "features")
    found = cut(docs.withColumn(at, measured(F.col("text"))))
    failed, quality = judged(found, at)
    return found.where(~failed & (quality >= threshold)).drop(at)
