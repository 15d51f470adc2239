"""Near-duplicates against all pairs."""

import random
import re

from pyspark.sql import functions as F

from sparkgauge.llm import common, minhash

from .data import ROWS, frame, texts
from .test_documents import by_id, lower


def brute(rows, width, similarity=80):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        k = min(width, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= similarity * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i)) for i in ids}


def copies():
    r = random.Random(3)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    out = []
    for i in range(40):
        w = list(base)
        for _ in range(r.randrange(1, 6)):
            w[r.randrange(len(w))] = f"x{r.randrange(1000)}"
        out.append((500 + i, " ".join(w), "s9", "x"))
    return out


def test_near_duplicates(spark):
    rows = [(a + 1000, b, c, d) for a, b, c, d in texts()] + ROWS + copies()
    for width in (2, 5):
        got = by_id(minhash.near_duplicates(frame(spark, rows), width=width))
        assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute(rows, width)
        assert all(r.kept == (i == r.component_id) for i, r in got.items())
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def hub(n, edits, at, seed):
    """A text, as row `at`, and n copies of it, each with other words changed: they link to it, hardly any to each other."""
    r = random.Random(seed)
    base = [f"w{k}" for k in range(400)]
    out = []
    for i in range(n):
        w = list(base)
        for k in r.sample(range(0, 400, 2), edits):
            w[k] = f"x{i}y{k}"
        out.append(" ".join(w))
    return list(enumerate([*out[:at], " ".join(base), *out[at:]]))


def test_copies_that_link_to_one_text_only(spark):
    """What links to the document that the largest component is known by, its first, was compared with nothing but a few leaders."""
    for at, seed in ((0, 2), (150, 1)):
        rows = hub(300, 21, at, seed)
        got = {r.id: (r.n_shingles, r.component) for r in minhash.classes(spark.createDataFrame(rows, "id long, text string"), 2).collect()}
        want = brute(rows, 2)
        assert {c for _, c in want.values()} == {0}
        assert got == want


def test_keep_representatives(spark):
    rows = [*ROWS, ROWS[4], ROWS[9]]
    kept = minhash.keep_representatives(frame(spark, rows), width=5)
    assert kept.columns == ["doc_id", "text", "source", "n_words"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in brute(ROWS, 5).values()})


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (7, 7)] + [(300, i) for i in range(301, 330)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | dict.fromkeys((100, 200, 150), 100) | dict.fromkeys(range(300, 330), 300)
    assert common.connected_components(spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))).count() == 0
