"""Repeated byte strings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np

from sparkgauge.llm import suffix_dedup

from .data import LONG, ROWS, frame, texts
from .test_documents import by_id


def brute(rows, length=400):
    seen = Counter()
    data = {i: (t or "").encode() for i, t, *_ in rows}
    for raw in data.values():
        seen.update(hash(raw[p : p + length]) for p in range(len(raw) - length + 1))
    out = {}
    for i, raw in data.items():
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - length + 1):
            if seen[hash(raw[p : p + length])] > 1:
                gone[p : p + length] = True
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        out[i] = (len(raw), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest())
    return out


def hard(seed=4):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = [word(n) for n in (399, 400, 401, 430, 520, 900, 3000)]
    rows = []
    for k in range(60):
        parts = []
        for _ in range(r.randrange(1, 5)):
            x = r.choice(passage)
            a = r.randrange(len(x))
            parts += [word(r.randrange(300)), r.choice([x, x[a:], x[:a], x[a : a + 410]])]
        rows.append((700 + k, "".join(parts) + word(r.randrange(50)), "s", "x"))
    rows += [(800, "ab" * 700, "s", "x"), (801, "a" * 900, "s", "x"), (802, "x" + "a" * 399 + "y", "s", "x"), (803, word(2000) * 2, "s", "x")]
    return rows


def test_remove_repeats(spark):
    r = random.Random(8)
    long = "".join(r.choice("abcdefgh ") for _ in range(150_000))
    rows = [(a + 1000, b, c, d) for a, b, c, d in texts()] + ROWS + hard() + [(900, long + LONG, "s", "x"), (901, "x" + long[70_000:71_000] + LONG * 2, "s", "x")]
    want = brute(rows)
    got = by_id(suffix_dedup.remove_repeats(frame(spark, rows)))
    bad = {i: (want[i], tuple(got[i])[1:5]) for i in want if want[i] != tuple(got[i])[1:5]}
    assert not bad and len(got) == len(rows)
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_clashes_of_short_keys_remove_nothing(spark, monkeypatch):
    """With seven keys for all phrase sequences nearly everything is looked at, and nothing else is removed."""
    from pyspark import cloudpickle

    key = suffix_dedup.sequence_key
    monkeypatch.setattr(suffix_dedup, "sequence_key", lambda sums, a, b: np.abs(key(sums, a, b)) % 7)
    cloudpickle.register_pickle_by_value(suffix_dedup)
    try:
        rows = [(a, t[:6000], s, x) for a, t, s, x in hard()[:14] + hard()[-4:]]
        got = by_id(suffix_dedup.remove_repeats(frame(spark, rows)))
    finally:
        cloudpickle.unregister_pickle_by_value(suffix_dedup)
    assert {i: tuple(r)[1:5] for i, r in got.items()} == brute(rows)


def test_hashes():
    data = np.frombuffer(b"some bytes that repeat, some bytes that repeat, " * 20, np.uint8)
    for n in (1, 2, 3, 16, 100, 400):
        for which in (0, 1):
            h = suffix_dedup.window_hash(data, n, which)
            assert len(h) == len(data) - n + 1 and h[0] == h[24] and len(set(h.tolist())) <= 24


def test_rounds_are_few_and_compute_their_keys_once(spark, monkeypatch):
    """Rounds of 4, 16, 64, 256 and 1024 phrases took up to five passes, and each computed its keys for either side of its join."""
    met, twice = [], suffix_dedup.repeated

    def watched(df, *key):
        met.append((key, df._jdf.queryExecution().analyzed().toString()))
        return twice(df, *key)

    monkeypatch.setattr(suffix_dedup, "repeated", watched)
    rows = hard()
    got = by_id(suffix_dedup.remove_repeats(frame(spark, rows)))
    assert {i: tuple(r)[1:5] for i, r in got.items()} == brute(rows)
    rounds = [plan for key, plan in met if key == ("key",)][1:]
    assert 1 <= len(rounds) <= 3 and not any("MapInPandas" in plan for plan in rounds)


def by_place(n, at, alive, done, length):
    """The cores of all places, one at a time."""
    out = []
    for p in range(n - length + 1):
        lo, hi = p + suffix_dedup.WINDOW - 1, p + length - suffix_dedup.GRAM - suffix_dedup.WINDOW + 1
        if all(alive[j] or not (at[j] >= lo and at[j + 1] <= hi) for j in range(len(at) - 1)):
            core, asked = (int((at < lo).sum()), int((at <= hi).sum()) - 1), not done[p : p + length].all()
            if out and out[-1][:2] == core and out[-1][3] == p:
                out[-1] = (*core, out[-1][2], p + 1, out[-1][4] or asked)
            else:
                out.append((*core, p, p + 1, asked))
    return out


def test_cores_equal_those_of_single_places():
    r = np.random.default_rng(5)
    for _ in range(40):
        n = int(r.integers(400, 1200))
        at = np.unique(r.integers(0, n - 15, n // int(r.choice([20, 48, 150])) + 2)).astype(np.int64)
        alive, done = r.random(len(at) - 1) < r.choice([0.0, 0.8, 1.0]), np.zeros(n, bool)
        a = int(r.integers(0, n))
        done[a : a + 700] = True
        got = list(zip(*(x.tolist() for x in suffix_dedup.cores(n, at, alive, done, 400)), strict=True))
        assert got == by_place(n, at, alive, done, 400)
        assert bool(got) == (len(suffix_dedup.candidates(n, at, alive, 400)[0]) > 0)


def test_a_very_common_key_is_split(spark):
    """The sum between shuffle and join kept Spark from splitting: one task had all rows of a key."""
    small = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k"}
    small |= {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        df = suffix_dedup.cut(spark.range(0, 60_000, 1, 8).selectExpr("id AS row", "if(id % 3 = 0, -1, id div 4) AS key"))
        found = suffix_dedup.repeated(df, "key").groupBy("row").count()
        rows = found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    n = {}
    for i in range(60_000):
        n.setdefault(-1 if i % 3 == 0 else i // 4, []).append(i)
    assert sorted(r["row"] for r in rows) == sorted(i for x in n.values() if len(x) > 1 for i in x)
    assert "SortMergeJoin(skew=true)" in plan
