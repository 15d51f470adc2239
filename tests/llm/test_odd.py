"""Odd tables through the registered queries, and the pipeline stage by stage against brute force."""

import re
import struct
import zlib
from collections import Counter
from math import log

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sparkgauge.llm import mixing, pii, quality_rules, queries

from . import test_minhash, test_pii
from .data import LONG, ROWS

BIG = 2**53 + 1
IDS = [None, None, BIG, 7, 7, 7, 1, 2, 3, 4, 5]
TEXTS = ["a null id with words", None, "an id beyond doubles", "two of one id", "two of one id", "unlike the others", None, "", " \n", LONG, "cc by someone"]
EXTRA = "doc_id long, text string, source string, lang string, n_chars long, row long, f string, at double, _row string, spans string, features int, n_words string, h string, size int"


def rows():
    return [(i, t, (None, "s1", "s2")[k % 3], "en", len(t or ""), k, "f", 0.5, "r", "s", 1, "w", "h", 2) for k, (i, t) in enumerate(zip(IDS, TEXTS, strict=True))]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    full, empty = (str(tmp_path_factory.mktemp(x)) for x in ("full", "empty"))
    for folder, data in ((full, rows()), (empty, [])):
        spark.createDataFrame(data, EXTRA).repartition(2).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(7, 1, 1, "x"), (7, 0, None, "x"), (None, 1, 1, "x"), (2, 1, 0, "x"), (99, 1, 1, "x")][: len(data)], "doc_id long, quality int, toxic int, text string").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(BIG, [1.0, 2.0], 1, "x"), (None, [1.0, 2.0], 1, "x"), (3, None, None, None)][: len(data)], "vec_id long, embedding array<double>, label int, row string").write.parquet(f"{folder}/embeddings.parquet")
    return full, empty


@pytest.mark.parametrize("name", [x for x in queries.QUERIES if not x.startswith(("op5", "op12", "op13"))])
def test_rows_and_ids_stay(spark, folders, name):
    full, empty = folders
    got = queries.QUERIES[name](spark, full).collect()
    ids = Counter(r.doc_id for r in got if getattr(r, "piece", 0) == 0)
    assert ids == Counter(IDS)
    if name.startswith("op8"):
        assert {(r.component_id, r.kept) for r in got if r.doc_id is None} == {(None, True)}
        assert Counter((r.component_id, r.kept) for r in got if r.doc_id == 7) == {(7, True): 3}
    assert queries.QUERIES[name](spark, empty).count() == 0


def test_vectors(spark, folders):
    full, empty = folders
    got = {r.vec_id: tuple(r)[1:] for r in queries.op5_embedding_dedup(spark, full).collect()}
    assert got == {BIG: (1, BIG, True), None: (1, BIG, False), 3: (0, 3, True)}
    assert queries.op5_embedding_dedup(spark, empty).count() == 0


def test_stages_keep_columns(spark, folders):
    full, empty = folders
    names = [c.split()[0] for c in EXTRA.split(", ")]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, spark.read.parquet(f"{empty}/documents.parquet"), empty).columns == names
        out = stage(spark, spark.read.parquet(f"{full}/documents.parquet"), full)
        assert out.columns == names and all(r.f == "f" and r._row == "r" and r.h == "h" for r in out.collect())
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_pipeline(spark, tmp_path):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    base = [" ".join(words[(7 * k + j * (k + 3)) % 20] + str((k * j) % 13) for j in range(60)) + "." for k in range(40)]
    texts = base + [x + " tail" for x in base[:10]] + base[10:15] + ["# $ % " * 30, "few words", None, "", " ".join(base[3].split()[::-1]) + " mail a.b@x.example.com or 10.0.0.1 now."] + [t for _, t, *_ in ROWS]
    docs = [(i, t, ("s1", "s2", None)[i % 3], len(t or ""), "x") for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, n_chars long, row string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")

    measured = {i: dict(zip([*quality_rules.BASE, *quality_rules.MORE], quality_rules.measure(t), strict=True)) for i, t, *_ in docs}
    score = {r.doc_id: r for r in quality_rules.score_documents(spark.createDataFrame(docs, "doc_id long, text string, source string, n_chars long, row string")).collect()}
    votes = {i: tuple(r[f"v_{k}"] for k in quality_rules.rules("f")) for i, r in score.items()}
    failed = {i: m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"] for i, m in measured.items()}
    model = quality_rules.learn(sorted(Counter(v for i, v in votes.items() if not failed[i]).items()))
    weight = {i: log(model["prior"] / (1 - model["prior"])) + sum(log(g[x + 1] / b[x + 1]) for (g, b), x in zip(model["table"], v, strict=True)) for i, v in votes.items()}
    kept = [d for d in docs if not failed[d[0]] and weight[d[0]] >= 0]
    assert 20 < len(kept) < len(docs)
    root = {i: c for i, (_, c) in test_minhash.brute([d[:2] for d in kept], 5).items()}
    kept = [d for d in kept if root[d[0]] == d[0]]

    def redacted(t):
        at, out = 0, ""
        for a, k, z in sorted(sum(test_pii.brute(t), [])):
            if a >= at:
                out += t[at:a] + f"[{pii.KINDS[k].upper()}]"
            at = max(at, z)
        return out + t[at:]

    kept = [(i, x := redacted(t), s, len(x), r) for i, t, s, _, r in kept]
    assert any("[EMAIL]" in t for _, t, *_ in kept)
    plan = {r.doc_id: r.copies for r in mixing.plan_mix(spark.createDataFrame(kept, "doc_id long, text string, source string, n_chars long, row string")).collect()}
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter()
    for i, x, *_ in kept:
        ids = [*t.encode(x, add_special_tokens=False).ids, 2]
        start, piece = 0, 0
        while start < len(ids):
            n = (len(ids) - start) % 1024 or 1024
            part = ids[start : start + n]
            want[i, piece, start, n, zlib.crc32(struct.pack(f"<{n}I", *part))] += plan[i]
            start, piece = start + n, piece + 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == +want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 1024
    assert not re.search("@", "".join(x for _, x, *_ in kept))
