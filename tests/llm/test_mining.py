"""Toxicity, hard negatives and source divergence against brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkgauge.llm import byte_words, divergence, hard_negatives, queries, toxicity

from .data import LONG

MID = "/root/testdata/sf0.01"


# Toxicity


def test_terms_are_those_of_whole_texts():
    texts = ["", "one", "One two two, three3three " + "x" * 9, LONG.lower(), "é日本 é"]
    for column in (pa.array(texts), pa.array(["skip", *texts]).slice(1)):
        rows = list(toxicity.term_rows(column, 18))
        assert len(rows) == len(texts) and all((np.diff(r) > 0).all() for r in rows)
        assert len(rows[0]) == 0 and len(rows[1]) == 2  # the word, and a length of at least one
    # Words once or twice, by value; stems only of longer words.
    words = Counter(re.findall("[a-z]+", texts[2].lower()))
    bases = Counter()
    for w, n in words.items():
        for k in (None, *toxicity.STEMS):
            if k is None or len(w) > k:
                bases[w[:k], k] += n
    lengths = sum(words.values()).bit_length()
    assert len(rows[2]) == sum(sum(n >= t for t in toxicity.TIMES) for n in bases.values()) + lengths
    some = np.zeros(1 << 18, bool)
    some[rows[3][::3]] = True
    assert [r.tolist() for r in toxicity.term_rows(column, 18, some)] == [[x for x in r.tolist() if some[x]] for r in rows]


def test_pieces_of_a_long_text_add_up(monkeypatch):
    column = pa.array([LONG.lower(), "alpha beta " * 50])
    want = [r.tolist() for r in toxicity.term_rows(column, 18)]
    monkeypatch.setattr(byte_words.pieces, "__defaults__", (100,))
    assert [r.tolist() for r in toxicity.term_rows(column, 18)] == want


def test_pairs_are_learnt_that_no_sum_of_weights_can_tell():
    """Insult with group, greeting with animal: each word alone is as often clean as toxic."""
    r = np.random.default_rng(3)
    texts, y = [], []
    for k in range(800):
        a, b = r.integers(2, size=2)
        texts.append(" ".join(r.choice([f"w{chr(97 + i)}" for i in range(26)], 5)) + f" {('insult', 'greeting')[a]} {('group', 'animal')[b]}")
        y.append(float(a == b))
    column = pa.array(texts)
    rows = list(toxicity.term_rows(column, 18))
    machine = toxicity.fit(rows[:600], np.array(y[:600]), 18)
    assert ((machine.scores(column)[600:] >= 0.5) == np.array(y[600:])).mean() > 0.97
    flat = toxicity.Machine(18, machine.bias, machine.slot, machine.weight, np.zeros_like(machine.factors))
    assert ((flat.scores(column)[600:] >= 0.5) == np.array(y[600:])).mean() < 0.75


def test_toxicity_of_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op11_toxicity(spark, d).collect()}
    truth = dict(duckdb.sql(f"select doc_id, toxic from '{d}/labels.parquet'").fetchall())
    assert len(got) == duckdb.sql(f"select count(*) from '{d}/documents.parquet'").fetchall()[0][0]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [i for i in truth if got[i].held_out]
    caught, toxic = sum(got[i].predicted for i in held if truth[i]), sum(truth[i] for i in held)
    assert caught >= 0.88 * toxic and sum(got[i].predicted for i in held if not truth[i]) <= 0.012 * len(held)


def test_held_out_labels_change_nothing(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    labels = spark.read.parquet(f"{MID}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.score_toxicity(docs.withColumn("lang", F.lit(x)), y).collect())) for x, y in (("a", labels), ("b", turned)))
    assert a == b


def test_labels_of_one_kind_or_none(spark):
    docs = spark.createDataFrame([(1, "idiot"), (2, None), (None, ""), (2, "again")], "doc_id long, text string")
    for labels in ([], [(1, 0)], [(77, 1)]):
        got = toxicity.score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
        assert len(got) == 4 and {r.predicted for r in got} == {0} and len({r.score for r in got}) == 1


def test_a_sample_bounds_what_is_fitted(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda rows, y, bits: seen.append(len(rows)))
    docs = spark.createDataFrame([(i % 3, f"text {i}") for i in range(60)], "doc_id long, text string")
    toxicity.learn(docs, spark.createDataFrame([(i, 1) for i in range(3)], "doc_id long, toxic int"), sample=10)
    assert seen == [10]


# Hard negatives


def brute_negatives(rows, positives=5, negatives=10):
    """rows: (id, vector of whole numbers, label, asks)."""
    ok = [(k, i, np.array(v, float), g, a) for k, (i, v, g, a) in enumerate(rows) if v is not None and g is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    last = lambda i: math.inf if i is None else i
    for k, i, v, g, a in ok:
        if not a:
            continue
        scored = sorted(((-int(v @ u), last(j), m, j, h == g) for m, j, u, h, _ in ok if m != k and len(u) == len(v)), key=lambda t: t[:3])
        for p, _, _, pid, same in [t for t in scored if t[4]][:positives]:
            fits = [t for t in scored if not t[4] and 30 * -p <= 100 * -t[0] <= 90 * -p][:negatives]
            out.update((i, pid, r, t[3], -p, -t[0]) for r, t in enumerate(fits, 1))
    return out


def mined(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, asks boolean, row string").repartition(3)
    return Counter(map(tuple, hard_negatives.mine_hard_negatives(df, F.col("asks"), **options).collect()))


def clustered(n, dim=8, seed=4):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dim)) * 60
    return [(k, np.floor(centres[r.integers(6)] + r.normal(size=dim) * 25).tolist(), int(r.integers(4)), k % 9 == 0) for k in range(n)]


def test_mined_negatives_are_exact(spark):
    rows = clustered(700)
    hot = [(2000 + k, rows[5][1], 2, k == 0) for k in range(300)]  # one vector of very many rows: ties by id
    odd = [(9000, None, 1, True), (9001, [1.0] * 7 + [None], 1, True), (9002, [1.0] * 7 + [float("nan")], 1, True), (9003, [float("inf")] * 8, 1, False), (9004, [1.0] * 8, None, True), (9005, [0.0] * 8, 1, True), (9006, [3.0, 4.0], 1, True), (9007, [5.0, 4.0], 1, False), (9008, [2.0, 3.0], 2, False), (9009, [], 1, True), (9010, [], 1, False), (9011, [], 2, False), (None, rows[9][1], 3, True), (7, rows[9][1], 0, False), (7, rows[9][1], 0, True), (9012, [40000.0] * 8, 1, True)]
    want = brute_negatives(rows + hot + odd)
    assert len(want) > 2000
    assert mined(spark, rows + hot + odd, block=32) == want
    assert mined(spark, rows + hot + odd, block=50, sample=60) == want  # few pivots, widths the sample lacks


def test_rings_end_before_all_is_scanned(spark, monkeypatch):
    """Anchors in well-parted clusters certify their best rows without asking the intervals far away."""
    r = np.random.default_rng(1)
    rows = [(k, np.floor(np.eye(16)[k % 16] * 1000 + r.normal(size=16) * 10).tolist(), 0, k % 50 == 0) for k in range(1600)]
    asked = []
    plain = hard_negatives.cut
    monkeypatch.setattr(hard_negatives, "cut", lambda df, name="step": (lambda t: (asked.append(t.count()) if name == "asks" else None, t)[1])(plain(df, name)))
    df = spark.createDataFrame(rows, "row long, v array<double>, label long, asks boolean").withColumn("id", F.col("row"))
    index, blocks = hard_negatives.build(df, 20_000, 32)
    total = sum(sum(p.bins) for p in index.value.pivots.values())
    anchors = [(k, 16, 0, hard_negatives.packed(np.array([v])), [-math.inf], [1e301]) for k, v, _, a in rows if a]
    got = hard_negatives.search(index, blocks, spark.createDataFrame(anchors, "q long, w int, label long, v binary, lows array<double>, highs array<double>"), 5, True)
    x = np.array([v for _, v, *_ in rows])
    for r in got.collect():
        s = x @ x[r.q]
        s[r.q] = -math.inf
        assert sorted(s)[-r.rank] == r.score
    assert 0 < sum(asked) < 0.5 * total * len(anchors) and 0 not in asked


def sent_to_driver(spark, run):
    """(What run returns, bytes that the tasks of its stages send to the driver)."""
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def stages():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.resultSize() for s in (found.apply(i) for i in range(found.size()))}

    before = stages()
    out = run()
    return out, sum(n for k, n in stages().items() if k not in before)


def test_pivots_are_fitted_without_the_whole_table_on_the_driver(spark, monkeypatch):
    """Every task of a sorted limit sent as many rows as the whole sample has."""
    fit, sizes = [], {}
    plain = hard_negatives.kmeans
    monkeypatch.setattr(hard_negatives, "kmeans", lambda x, k: (fit.append(x), plain(x, k))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # small tables are sent whole otherwise
    try:
        for parts in (4, 16):
            v = [F.floor(F.rand(k) * 1000).cast("double") for k in range(64)]
            rows = spark.range(0, 1000 * parts, 1, parts).select(F.col("id").alias("row"), "id", F.lit(0).cast("long").alias("label"), F.when(F.col("id") % 3 > 0, F.array(*v)).otherwise(F.array(*v[:5])).alias("v"))
            for sample in (500, 20_000):  # the latter is more than there are
                fit.clear()
                _, sizes[parts, sample] = sent_to_driver(spark, lambda rows=rows, sample=sample: hard_negatives.build(rows, sample, 1024))
                want = [r.v for r in rows.orderBy(F.xxhash64("row"), "row").limit(sample).select("v").collect()]
                assert sorted(map(len, fit)) == sorted(sum(len(x) == w for x in want) for w in (5, 64))
                assert {x.shape[1] - 1: x[:, :-1].tolist() for x in fit} == {w: [x for x in want if len(x) == w] for w in (5, 64)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sizes[16, 500] < 2 * sizes[4, 500]  # four times the tasks, each with its figures


def test_no_rows(spark):
    assert not mined(spark, []) and not mined(spark, [(1, None, 1, True)]) and not mined(spark, [(100, [1.0], 1, True)])


# Source divergence


def brute_audit(docs, least=10):
    terms = [(g or "", s or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for t, g, s in docs]
    found = defaultdict(Counter)
    for g, _, ws in terms:
        found[g].update(set(ws))
    out = set()
    for g in found.keys() | {g for g, *_ in terms}:
        kept = sorted(w for w, n in found[g].items() if n >= least)
        count = {s: Counter() for h, s, _ in terms if h == g}
        for h, s, ws in terms:
            if h == g:
                count[s].update(w for w in ws if found[g][w] >= least)
        every = sum(count.values(), Counter())
        p = lambda c, w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept))  # noqa: B023, E731
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, c in count.items():
            pairs = sorted((-sum(f(p(c, w), p(o, w)) for w in kept), x.encode()) for x, o in count.items() if x != s)
            words = sorted((-f(p(c, w), p(every, w)), w.encode()) for w in kept if c[w] and p(c, w) > p(every, w))[:10]
            out |= {(g, s, part, x.decode(), -v, k) for part, l in (("pair", pairs), ("term", words)) for k, (v, x) in enumerate(l, 1)}
    return out


def test_audit(spark, monkeypatch):
    docs = [tuple(r) for r in duckdb.sql("select text, lang, source from '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    docs += [(None, "en", "quiet"), ("", None, None), ("rare words only", None, "s"), (LONG + " Été ÉTÉ z" + "q" * 3000, "en", None), *[("tie tock", "xx", s) for s in "abc" * 5], ("日本 日本", "xx", "a")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "text string, lang string, source string, term string, n int").repartition(3)
    want = brute_audit(docs)
    got = lambda: {tuple(r) for r in divergence.audit_sources(df).collect()}
    assert got() == want and ("", "", "pair", "s", 0, 1) in want
    monkeypatch.setattr(divergence, "BLOCK", 50)  # many blocks
    assert got() == want
    assert divergence.audit_sources(df.limit(0)).count() == 0


def test_slices_of_one_hash_are_told_apart():
    r = np.random.default_rng(2)
    words = ["".join(r.choice(list("abc"), r.integers(1, 5))) for _ in range(500)]
    column = pa.array([" ".join(words[:200]), "", "-".join(words[200:])])
    data, offsets = byte_words.text_bytes(column)
    starts, ends = byte_words.boundaries(data, offsets)
    assert [data[a:z].tobytes().decode() for a, z in zip(starts, ends, strict=True)] == words
    for digest in (xxhash.xxh3_64_intdigest, lambda b: len(b) % 2, lambda b: b[0]):
        first, code = byte_words.group_slices(data, starts, ends, digest)
        assert len(set(words)) == len(set(code)) and [words[first[c]] for c in code] == words


@pytest.mark.parametrize("count, total, kept", [(0, 0, 1), (7, 100, 13), (10**14, 3 * 10**15, 10**6), (3 * 10**15, 3 * 10**15, 1)])
def test_probability_is_exact(count, total, kept):
    assert divergence.probability(np.array([count]), total, kept)[0] == 1 + 10**9 * (count + 2) // (total + 2 * kept)


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_source_divergence"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{MID}/{t}.parquet'")
    got = queries.QUERIES[name](spark, MID)
    want = con.execute(queries.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert Counter(tuple(r) for r in got.select(*names).collect()) == Counter(want.fetchall())


def test_a_batch_is_counted_in_shares_of_bounded_text():
    """Numbers of all words of 10000 documents at once took an executor's memory."""
    texts = ["", "Alpha beta " * 9, "x" * 7, "beta gamma " * 200_000, "", *(f"alpha w{chr(97 + k % 26)} " * 5000 for k in range(200)), ""]
    langs, sources = (pa.array([f"{c}{i % k}" for i in range(len(texts))]) for c, k in (("l", 2), ("s", 3)))
    whole = pa.RecordBatch.from_arrays([langs, sources, pa.array(texts)], ["lang", "source", "text"])
    shares = list(byte_words.text_shares(whole, "text"))
    assert pa.Table.from_batches(shares).combine_chunks() == pa.Table.from_batches([whole]).combine_chunks()
    assert max(len(byte_words.text_bytes(x["text"])[0]) for x in shares) <= 1 << 22  # the longest text alone is some 2 MB
    parts = list(divergence.count_terms(iter([whole])))
    assert len(parts) == len(shares) > 1
    got, want = defaultdict(lambda: np.zeros(2, int)), defaultdict(lambda: np.zeros(2, int))
    for row in pa.Table.from_batches(parts).to_pylist():
        got[row["lang"], row["source"], row["term"]] += row["n"], row["docs"]
    for x in whole.to_pylist():
        for term, n in Counter(re.findall("[a-z]+", x["text"].lower())).items():
            want[x["lang"], x["source"], term] += n, 1
    assert {k: tuple(v) for k, v in got.items()} == {k: tuple(v) for k, v in want.items()}
    assert not list(byte_words.text_shares(whole.slice(0, 0), "text"))
