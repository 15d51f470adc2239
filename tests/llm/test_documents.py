"""The map-like document operators against brute force."""

import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from sparkgauge.llm import license_scan, mixing, packing, quality_rules, token_count, token_files, tokens

from .data import COLUMNS, ROWS, frame, texts

ALL = [(a + 100, b, c, d) for a, b, c, d in texts()] + ROWS


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_license_scan(spark):
    got = by_id(license_scan.scan_licenses(frame(spark, ALL)))
    assert len(got) == len(ALL)
    for i, t, *_ in ALL:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        at = [(k, l) for p, l in license_scan.BASE.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert r.base_labels == ",".join(sorted({l for _, l in at})) and 0 <= r.score <= 1
        assert {l for _, l in at} <= set(r.labels.split(",")) and r.labels == ",".join(sorted(set(r.labels.split(","))))
    assert got[13].labels == "apache-2.0,cc-by,gpl,gpl-2.0-only,mit" and got[2].score == 0


def test_expressions():
    value = lambda s: license_scan.parse(s)[0]
    assert value("mit") == 1 and value("mit and gpl-2.0") == 0.3 and value("mit or gpl-2.0") == 1
    assert value("gpl-2.0 or mit and agpl-3.0") == 0.3  # and binds closer
    assert value("(gpl-2.0 or mit) and agpl-3.0") == 0.2
    assert value("gpl-2.0 with classpath-exception") == 0.5
    assert value("and mit") is None and value("") is None and value("(mit") is None
    assert license_scan.parse(" mit or ) x")[1] == ["mit"]


def test_expressions_hold_known_ids_only():
    a = license_scan.automaton()
    scan = lambda t: license_scan.scan(t, a)[5:]
    assert scan("SPDX-License-Identifier: see the file") == ("", 0.0)
    assert scan("License Identifier: MIT") == scan("SPDX-License-Identifier:" + " " * 4100 + "MIT.") == scan("license identifier\n\n= mit or later") == ("mit", 1.0)
    assert scan("SPDX-License-Identifier: " + "gpl-3.0 OR " * 150 + "MIT") == ("gpl-3.0,mit", 1.0)
    assert scan("SPDX-License-Identifier: mitre OR foo-1.0") == ("", 0.0) and scan("x license identifier: foo-1.0 or mitre") == ("", 0.2) == scan("license-identifier: chapter-2")
    assert scan("SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 AND BSD-3-Clause.") == ("bsd-3-clause,gpl-2.0-or-later", 0.5)
    assert scan("spdx license identifier mit. Spdx-License-Identifier: gpl-2.0-only") == ("gpl-2.0-only,mit", 0.3)


def test_long_expressions():
    a = license_scan.automaton()
    for n in (150, 3000, 200_000):
        long = "mit and " * n
        assert license_scan.parse(long + "proprietary")[:2] == (0.0, ["mit"] * n + ["proprietary"])
        assert license_scan.parse("gpl or " + "(" * n + "mit" + ")" * n + " and isc with llvm-exception and proprietary or and")[:2] == (0.3, ["gpl", "mit", "isc", "proprietary"])
        found = license_scan.scan(f"SPDX-License-Identifier: {long}proprietary", a)
        assert found[5:] == ("mit,proprietary", 0.0)


def test_quality_base(spark):
    got = by_id(quality_rules.score_documents(frame(spark, ALL)))
    for i, t, *_ in ALL:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        covered = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(words) < 20 or 100 * len(covered) > 30 * len(words)) and not (r.base_failed and r.kept)


def test_quality_against_labels(spark):
    import duckdb

    d = "/root/testdata/sf0.01"
    truth = dict(duckdb.sql(f"select doc_id, quality from '{d}/labels.parquet'").fetchall())
    got = by_id(quality_rules.score_documents(spark.read.parquet(f"{d}/documents.parquet")))
    good = [got[i].kept for i, q in truth.items() if q == 1 and not got[i].base_failed]
    bad = [got[i].kept for i, q in truth.items() if q == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.15
    kept = quality_rules.keep_good(frame(spark, ALL))
    wanted = {r.doc_id for r in quality_rules.score_documents(frame(spark, ALL)).collect() if r.kept}
    assert kept.columns == ["doc_id", "text", "source", "n_words"] and wanted and {r.doc_id for r in kept.collect()} == wanted


def test_quality_posterior_beats_any_bad_vote(spark):
    import duckdb

    d = "/root/testdata/sf0.1"
    truth = dict(duckdb.sql(f"select doc_id, quality from '{d}/labels.parquet'").fetchall())
    rows = [r for r in quality_rules.score_documents(spark.read.parquet(f"{d}/documents.parquet")).collect() if r.doc_id in truth and not r.base_failed]
    votes = [c for c in rows[0].asDict() if c.startswith("v_")]
    right = np.mean([r.kept == (truth[r.doc_id] == 1) for r in rows])
    plain = np.mean([all(r[c] >= 0 for c in votes) == (truth[r.doc_id] == 1) for r in rows])
    assert right > 0.998 and right > plain
    assert any(r.kept and min(r[c] for c in votes) < 0 for r in rows) and {r[c] for r in rows for c in votes} == {-1, 0, 1}


def test_em_finds_accuracies():
    r = np.random.default_rng(1)
    y = r.random(20000) < 0.8
    right = [0.95, 0.8, 0.7, 0.9]
    v = np.stack([np.where(r.random(20000) < 0.2, 0, np.where((r.random(20000) < a) == y, 1, -1)) for a in right], 1)
    model = quality_rules.learn(sorted(Counter(map(tuple, v.tolist())).items()), trust=1e-3)
    table = np.array(model["table"])
    assert abs(model["prior"] - 0.8) < 0.03
    assert np.allclose(table[:, 0, 2] / (table[:, 0, 0] + table[:, 0, 2]), right, atol=0.06)
    assert quality_rules.learn([])["table"] == []


@pytest.mark.parametrize("fixed", [0, 500])
def test_token_count(spark, fixed):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    more = [(900, "word, word. WORD don't \u03a3\u03a3 \u0130x e\u0301 12345 \x1c\x85\u3000y", "s", "x"), (901, "long " * 300_000, "s", "x"), (2**53 + 1, "x", "s", "x"), (None, "one two", "s", "x"), (900, "again", "s", "x")]
    rows = ALL + more
    got = sorted(map(tuple, token_count.count_tokens(frame(spark, rows), entries=fixed, cache=50).collect()), key=str)
    n = [len(t.encode(x or "", add_special_tokens=False).ids) for _, x, *_ in rows]
    assert got == sorted(((i, len((x or "").encode()), k, k > 2048) for (i, x, *_), k in zip(rows, n, strict=True)), key=str)
    assert token_count.count_tokens(frame(spark, [])).count() == 0


def test_pieces_of_every_character():
    bpe = tokens.WordBpe()
    points = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    for at in range(0, len(points), 2000):
        x = "".join(f"a{c}b {c}" for c in points[at : at + 2000])
        assert bpe.count(x) == bpe.length(x), hex(at)


def test_ranks_agree_with_the_library_on_a_whole_table(spark):
    t, bpe = Tokenizer.from_file(P.path("byte_bpe_50k.json")), tokens.ByteBpe()
    some = [x for _, x, *_ in texts("/root/testdata/sf0.01") + ALL if x]
    for x, e in zip(some, t.encode_batch_fast(some, add_special_tokens=False), strict=True):
        assert bpe.ids(x) == e.ids


def test_token_files(spark, tmp_path):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    folder = str(tmp_path / "out")
    manifest = token_files.write_token_files(frame(spark, ALL), folder, shard_ids=5000)
    got = sorted(token_files.read_token_files(manifest, folder).collect())
    start = 0
    for r, (i, x, *_) in zip(got, sorted(ALL, key=lambda r: r[0]), strict=True):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        assert tuple(r) == (i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))), i
        start += len(ids)
    empty = token_files.write_token_files(frame(spark, []), f"{folder}2")
    assert token_files.read_token_files(empty, f"{folder}2").collect() == []


@pytest.mark.parametrize("blank", [" ", "\n", "\u3000", "\t \r\n"])
def test_long_white_space(blank):
    bpe, t = tokens.ByteBpe(), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for n in (tokens.RUN - 1, tokens.RUN, 1_000_000):
        x = "left" + blank * (n // len(blank)) + "right"
        assert np.frombuffer(bpe.encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_long_white_space_rows(spark):
    x = "left" + "\n" * 1_000_000 + "right"
    n = len(Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode(x, add_special_tokens=False).ids) + 1
    assert sum(r.length for r in packing.pack_documents(frame(spark, [(0, x, "s", "x")])).collect()) == n


def test_simple8b_round_trip():
    r = np.random.default_rng(0)
    for n in (0, 1, 2, 239, 240, 241, 3000):
        for top in (1, 2, 300, 60000, 2**31, 2**63):
            v = r.integers(0, top, n, dtype=np.uint64)
            words, first = token_files.encode(v)
            assert (token_files.decode(words, first, n) == v).all()
    assert len(token_files.encode(np.zeros(2400, np.uint64))[0]) == 10


def test_packing(spark):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(frame(spark, ALL + [ROWS[0]])).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for i, x, *_ in ALL:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        own = sorted(pieces[i], key=lambda r: r.piece)
        if i == 0:  # the repeated row
            assert len(own) == 2
            continue
        assert [r.piece for r in own] == list(range(-(-len(ids) // 1024))) and sum(r.length for r in own) == len(ids)
        assert all(r.length == 1024 for r in own[1:])
        for r in own:
            part = ids[r.start : r.start + r.length]
            assert zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == r.ids_crc32
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= -(-sum(r.length for r in rows) // 1024) * 1.05 + 1
    assert packing.pack_documents(frame(spark, [])).collect() == []


def test_swaps_empty_bins():
    lengths = [6, 4, 5, 5, 4, 6, 3, 7]
    assert len(packing.improve([[0, 2], [1, 3], [4, 5], [6, 7]], lengths, 10)) <= 4
    assert len(packing.improve([[0], [1], [2], [3], [4], [5], [6], [7]], lengths, 10)) == 4
    assert packing.improve([], [], 10) == []


def test_pairs_leave_bins_of_many_items():
    lengths = [7] * 70 + [12] * 83
    bins = packing.improve([list(range(70)), list(range(70, 153))], lengths, 1000)
    assert sorted(sum(lengths[i] for i in b) for b in bins) == [486, 1000] and sorted(sum(bins, [])) == list(range(153))


def test_groups_follow_pieces(spark):
    rows = [(0, "word " * 30_000, "s", "x")]
    rows += [(k, "a few words of text", "s", "x") for k in range(1, 400)] + [(None, "", "s", "x")] * 400
    got = packing.pack_documents(frame(spark, rows), size=64, group_items=50).collect()
    n = round(sum(r.length < 64 for r in got) / 50)
    dealt = Counter(r.sequence_id % n for r in got if r.length < 64)
    assert n > 10 and len(dealt) == n and max(dealt.values()) < 100
    assert all((r.sequence_id < 0) == (r.length == 64) for r in got)


def near(target, taken, documents, total):
    """What is missing or too much is at most half of the smallest document that could be taken once more, or was taken last."""
    passes = target // total if total else 0
    spare = [n for n, copies in documents if n and copies == passes and passes < 2] or [n for n, _ in documents]
    return abs(target - taken) <= min(spare) / 2 + 1e-6 or not any(n and c == passes for n, c in documents) and abs(target - taken) <= max(spare) / 2 + 1e-6


def test_mixing_of_sources_of_few_documents(spark):
    for sizes, want in (([("a", 4000), ("b", 3000)], {"a": 8000, "b": 3000}), ([("a", 10)], {"a": 10}), ([("a", 5), ("a", 6), ("b", 1), ("b", 100), (None, 7)], None)):
        got = mixing.plan_mix(frame(spark, [(i, "a " * n, s, "x") for i, (s, n) in enumerate(sizes)])).collect()
        taken = Counter()
        for r in got:
            taken[r.source] += r.taken
            assert r.taken <= 2 * r.size and (r.copies < 2 or r.second_position is not None)
        if want:
            assert {s: n for s, n in taken.items()} == want and [round(r.target) for r in got] == ([7875, 2625] if len(got) == 2 else [15])
        for s in {s for s, _ in sizes}:
            own = [r for r in got if r.source == s]
            assert near(own[0].target, taken[s], [(r.size, r.copies) for r in own], own[0].source_size)


def test_mixing(spark):
    rows = [(a, b, c, d) for a, b, c, d in ALL]
    got = by_id(mixing.plan_mix(frame(spark, rows)))
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", x or "")) for i, x, *_ in rows}
    of = defaultdict(list)
    for i, _, s, _ in rows:
        of[s].append(i)
    names = sorted(of, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total = {s: sum(size[i] for i in of[s]) for s in names}
    target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(total.values()), set(names)
    while open_:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 2 * total[s]}
        if not over:
            target |= {s: left * weight[s] / w for s in open_}
            break
        target |= {s: 2.0 * total[s] for s in over}
        left -= sum(2 * total[s] for s in over)
        open_ -= over
    for s in names:
        for i in of[s]:
            r = got[i]
            assert (r.size, r.source_size) == (size[i], total[s]) and abs(r.target - target[s]) < 1e-6 * (1 + target[s]) and 0 <= r.taken <= 2 * size[i]
        taken = sum(got[i].taken for i in of[s])
        assert near(target[s], taken, [(got[i].size, got[i].copies) for i in of[s]], total[s])
    assert got == by_id(mixing.plan_mix(frame(spark, rows)))
    mixed = mixing.mix(frame(spark, rows))
    assert mixed.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: r.copies for i, r in got.items() if r.copies})
    assert mixing.plan_mix(frame(spark, [])).count() == 0


def test_mixing_fills_the_room(spark):
    r = np.random.default_rng(3)
    sizes = [("long", n) for n in (50_000, *r.integers(1, 60, 300).tolist())] + [("one", 9000)] + [("even", 100)] * 40 + [(None, int(n)) for n in r.integers(1, 3000, 200)] + [("big", 300_000)]
    rows = [(i, "a " * n, s, "x") for i, (s, n) in enumerate(sizes)]
    for share in (0.3, 1.2):
        got = mixing.plan_mix(frame(spark, rows), share=share).collect()
        assert len(got) == len(rows)
        for s in {s for s, _ in sizes}:
            own = [x for x in got if x.source == s]
            target, taken, passes = own[0].target, sum(x.taken for x in own), own[0].target // own[0].source_size
            assert near(target, taken, [(x.size, x.copies) for x in own], own[0].source_size), (share, s)
            last = sorted((x.second_position if passes else x.first_position, x.size) for x in own if x.copies > passes)
            assert len({p for p, _ in last}) == len(last)  # copies of a lap follow one another
    plan = mixing.plan_mix(frame(spark, [(i, "a " * n, "s", "x") for i, n in enumerate([50_000] + [10] * 1000)]), share=0.5)
    assert sum(x.taken for x in plan.collect()) == 10_000


def test_positions(spark):
    from pyspark.sql import functions as F

    for slope in (-0.5, 0.0, 0.5, 1.0):
        for r in spark.range(11).select((F.col("id") / 10).alias("y"), mixing.position(F.col("id") / 10, F.lit(slope)).alias("t")).collect():
            assert abs(r.t + slope * (r.t - r.t**2) - r.y) < 1e-9 and -1e-9 <= r.t <= 1 + 1e-9
