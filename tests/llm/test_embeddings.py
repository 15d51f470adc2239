"""Near vectors against all pairs."""

import duckdb
import numpy as np

from sparkgauge.llm import embedding_dedup, queries

ODD = [(9000, None, 1), (9001, [], 1), (9002, [0.0] * 64, 1), (9003, [1.0] * 63 + [float("nan")], 1), (9004, [1.0] * 63 + [None], 1), (9005, [1.0] * 64, None), (9006, [1.0] * 3, 1), (9007, [2.0] * 3, 1), (9008, [1.0] * 64, 1), (9009, [1.0] * 64, 1), (9010, [float("inf")] * 64, 1)]


def brute(rows, cosine=0.93):
    ok = [(i, np.array(v, float) / np.linalg.norm(np.array(v, float)), g) for i, v, g in rows if v and g is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: 0 for i, *_ in rows}
    parent = {i: i for i in links}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, v, g) in enumerate(ok):
        for j, u, h in ok[x + 1 :]:
            if g == h and len(u) == len(v) and float(u @ v) >= cosine:
                links[i] += 1
                links[j] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: (links[i], root(i)) for i in links}


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, kept string").repartition(3)
    return {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(df, **options).collect()}


def test_near_vectors(spark):
    rows = duckdb.sql("select vec_id, embedding, label from '/root/testdata/sf0.01/embeddings.parquet'").fetchall()
    r = np.random.default_rng(5)
    center = r.normal(size=64)
    near = [(5000 + k, (center + r.normal(size=64) * 0.27).tolist(), 1) for k in range(150)]
    rows = [(i, list(map(float, v)), g) for i, v, g in rows] + near + ODD
    want = brute(rows)
    assert 0 < sum(n for n, _ in want.values())
    for options in ({}, {"block": 40, "sample": 200}, {"sample": 100}):
        assert run(spark, rows, z=8.0, **options) == want  # every list that can matter
        got = run(spark, rows, **options)
        assert all(got[i][0] <= n for i, (n, _) in want.items())
        assert sum(n for n, _ in got.values()) >= 0.99 * sum(n for n, _ in want.values())
    assert run(spark, ODD[:5]) == {i: (0, i) for i, *_ in ODD[:5]} and run(spark, []) == {}


def test_equal_and_null_ids(spark):
    a, b = [1.0] + [0.0] * 7, [0.99, 0.1] + [0.0] * 6
    rows = [(7, a, 1), (7, b, 1), (None, a, 1), (None, [0.0, 1.0] + [0.0] * 6, 1), (2**53 + 1, [0.0] * 7 + [1.0], 1), (8, [0.0] * 8, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, row string")
    got = sorted(map(tuple, embedding_dedup.near_vectors(df).collect()), key=str)
    want = [(7, 2, 7, True), (7, 2, 7, True), (None, 2, 7, False), (None, 0, None, True), (2**53 + 1, 0, 2**53 + 1, True), (8, 0, 8, True)]
    assert got == sorted(want, key=str)


def test_query_function(spark):
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.op5_embedding_dedup(spark, "/root/testdata/sf0.001").collect()}
    rows = duckdb.sql("select vec_id, embedding, label from '/root/testdata/sf0.001/embeddings.parquet'").fetchall()
    want = brute([(i, None if v is None else list(map(float, v)), g) for i, v, g in rows])
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}


def test_probes_fall_with_the_number_of_lists():
    x = np.array(duckdb.sql("select embedding from '/root/testdata/sf0.1/embeddings.parquet' where embedding is not null limit 4000").df().embedding.tolist(), float)
    x /= np.sqrt((x * x).sum(1))[:, None]
    for first, fine in ((32, 1), (16, 4)):
        q = embedding_dedup.Quantizer(x, first, fine, 8, 32)
        probes = q.probes(x, 0.374 * 2.5 / 8)
        at, codes, err = q.encode(x)
        assert np.mean([len(p) for p in probes]) < 0.4 * first * fine and all(a in p for a, p in zip(at, probes, strict=True))
        near = np.abs(np.sqrt(((x[:50, None] - x[at == at[0]][None]) ** 2).sum(2)) - q.distances(x[:50], at[0], codes[at == at[0]]))
        assert (near <= err[at == at[0]] + 1e-9).all()
