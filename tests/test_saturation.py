"""Windows of over-saturation: whatever ranges the points are dealt to, their sums equal brute force, and no point is joined by its number."""

import random

import numpy as np
import pytest

from sparkgauge.functions import wide as wd
from sparkgauge.operators import saturation as sat

AGE, RATIO, LATE = 3_000_000, 0.75, 40


def points(seed):
    """Runs of very different sizes, one with a single kind for long, ties of times, a pause longer than the age, times and values beyond 2 ** 40."""
    r, rows = random.Random(seed), []
    for run, (n, far) in enumerate(((700, 0), (3, 10**12), (1, 0), (260, 10**12), (40, -(10**9)))):
        t = far
        for i in range(n):
            t += r.choice([0, 0, 7, 90_000, 4_000_000 if i % 97 == 0 else 11_000])
            kind = "first" if run == 3 and i < 200 else r.choice(["started", "first"])
            rows.append((run, i, t, kind, r.choice([0, 3, 41, 2**41, -5])))
    r.shuffle(rows)
    return rows


def by_hand(rows):
    out = {}
    for run in {x[0] for x in rows}:
        series = sorted((x for x in rows if x[0] == run), key=lambda x: (x[2], x[3], x[1]))
        for i, x in enumerate(series):
            t, mine = x[2], []
            for kind in sat.KINDS:
                p = [y for y in series[: i + 1] if y[3] == kind]
                a = max(len(p) - int(len(p) * RATIO), sum(y[2] < t - AGE for y in p))
                w = [(y[2] - t, y[4]) for y in p[a:]]
                mine += [len(w), sum(v > LATE for _, v in w), *map(float, (sum(u for u, _ in w), sum(v for _, v in w), sum(u * u for u, _ in w), sum(u * v for u, v in w), sum(v * v for _, v in w)))]
            out[x[0], x[3], x[1]] = mine
    return out


@pytest.mark.parametrize("ranges", [1, 4, 61])
def test_windows_over_ranges(spark, ranges):
    rows = points(ranges)
    df = spark.createDataFrame(rows, "run_index long, request_id long, t_us long, kind string, value long").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        x = sat.window_sums(df, ["run_index"], AGE, RATIO, LATE, "request_id")
        plan = x._jdf.queryExecution().executedPlan().toString()
        got = {(r.run_index, r.kind, r.request_id): [r[f"{k}_{c}"] for k in sat.KINDS for c in ("n", *sat.TERMS)] for r in x.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert "Join" not in plan and "Window" not in plan
    want = by_hand(rows)
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k] == pytest.approx(w, rel=1e-15, abs=0), k


def test_empty_series(spark):
    df = spark.createDataFrame([], "run_index long, request_id long, t_us long, kind string, value long")
    assert sat.saturated_at(df, ["run_index"]).collect() == []


def test_wide_numbers():
    r = np.random.default_rng(2)
    a, b = r.integers(-(2**50), 2**50, 500), r.integers(-(2**40), 2**40, 500)
    p, exact = wd.times(wd.wide(a), b), [int(x) * int(y) for x, y in zip(a, b, strict=True)]
    total = wd.sums(p)
    assert [wd.to_int(p, i) for i in range(500)] == exact
    assert [wd.to_int(total, i) for i in range(501)] == [sum(exact[:i]) for i in range(501)]
    assert [wd.to_int(wd.minus(p, wd.of_ints(exact[::-1])), i) for i in range(500)] == [x - y for x, y in zip(exact, exact[::-1], strict=True)]
    assert wd.doubles(wd.of_ints([-5, 0, 7, -(2**90)])).tolist() == [-5.0, 0.0, 7.0, -(2.0**90)]
