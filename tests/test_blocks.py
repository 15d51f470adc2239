"""Blocks of hashed prompts: siblings differ, whole prompts come together, conversations stand apart."""

import json
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparkgauge.operators import blocks
from sparkgauge.sources import readers

SCHEMA = "t long, n long, hash_ids array<long>"


def prompts(count=400, seed=3):
    """A tree of ids in which a third of all ids have the root as previous id, and one id is in nearly all prompts."""
    r, children, rows = random.Random(seed), {}, []
    fresh = iter(range(10**6))
    for t in range(count):
        ids, at = [], -1
        for depth in range(r.randrange(0, 5)):
            known = children.setdefault(at, [])
            pick = known[0] if depth == 0 and known and r.random() < 0.6 else None
            if pick is None:
                pick = next(fresh) if not known or r.random() < 0.4 else r.choice(known)
            if pick not in known:
                known.append(pick)
            ids.append(pick)
            at = pick
        rows.append((t, 8 * len(ids) - (r.randrange(0, 8) if ids else 0), ids))
    return rows


def by_hand(rows, block=8):
    entry, ranks = {}, {}
    for _, n, ids in sorted(rows):
        for k, x in enumerate(ids):
            if x not in entry:
                before = ids[k - 1] if k else -1
                entry[x] = (before, n % block if x == ids[-1] and n % block else block, ranks.get(before, 0))
                ranks[before] = ranks.get(before, 0) + 1
    return entry


def test_dictionary_and_prompts(spark):
    rows = prompts()
    df, want = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), SCHEMA).repartition(5), by_hand(rows)
    got = blocks.block_dictionary(df, ("t",), n_in="n", block=8).collect()
    assert {r.hash_id: (r.previous, r.length, r.sibling) for r in got} == want and len(got) == len(want)
    told = blocks.with_blocks(df, ("t",), n_in="n", block=8).withColumn("tokens", blocks.block_tokens("blocks", 50)).collect()
    assert sorted((r.t, r.n, r.hash_ids) for r in told) == rows
    tokens = {}
    for r in told:
        assert [(b.previous, b.length, b.sibling) for b in r.blocks] == [want[x] for x in r.hash_ids]
        for x, b in zip(r.hash_ids, r.tokens, strict=True):
            assert tokens.setdefault(x, tuple(b)) == tuple(b) and len(b) == want[x][1] and all(0 <= t < 50 for t in b)
    assert len({(want[x][0], b) for x, b in tokens.items()}) == len(tokens)


def test_cold_ids_are_joined(spark, monkeypatch):
    rows = prompts(60)
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(tuple, blocks.with_blocks(df, ("t",), n_in="n", block=8).collect()))
    for hot in (0, 3):
        monkeypatch.setattr(blocks, "HOT", hot)
        assert sorted(map(tuple, blocks.with_blocks(df, ("t",), n_in="n", block=8).collect())) == want


def test_conversations_stand_apart(spark):
    rows = [("a", 1, 130, [1, 2, 3]), ("a", 2, 130, [1, 4]), ("b", 1, 64, [1]), ("b", 2, 3, []), ("b", 3, 128, [9, 2])]
    df = spark.createDataFrame(rows, "id string, t long, `in` long, hash_ids array<long>")
    got = {(r.id, r.t): r for r in blocks.conversation_blocks(df, ("t",)).withColumn("rest", blocks.remainder_tokens("t", "remainder", 99)).collect()}
    assert {k: (r.hash_ids, r.remainder, len(r.rest)) for k, r in got.items()} == {("a", 1): ([1, 2], 2, 2), ("a", 2): ([1, 4], 2, 2), ("b", 1): ([1], 0, 0), ("b", 2): ([], 3, 3), ("b", 3): ([9, 2], 0, 0)}
    assert [b.sibling for b in got["a", 2].blocks] == [0, 1] and [(b.previous, b.sibling) for b in got["b", 3].blocks] == [(-1, 1), (9, 0)] and got["b", 2].blocks == []


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert blocks.with_blocks(empty, ("t",), n_in="n").collect() == [] and blocks.block_dictionary(empty, ("t",), n_in="n").collect() == []
    for row in ((None, 1, [1]), (1, None, [1]), (1, 1, None), (1, 1, [None]), (1, 1, [-1]), (1, 9, [1]), (1, 8, [1, 2])):
        with pytest.raises(PySparkException):
            blocks.with_blocks(spark.createDataFrame([row], SCHEMA), ("t",), n_in="n", block=8).collect()
    many = spark.createDataFrame([(k, 1, [k]) for k in range(6)], SCHEMA)
    told = blocks.with_blocks(many, ("t",), n_in="n", block=8)
    assert told.select(F.countDistinct(blocks.block_tokens("blocks", 6))).first()[0] == 6
    with pytest.raises(PySparkException):
        told.select(blocks.block_tokens("blocks", 5)).collect()
    with pytest.raises(ValueError):
        blocks.block_tokens("blocks", 1)


def test_reader_of_conversations(spark, tmp_path):
    lines = [{"id": "c", "t": 2.0, "in": 70, "out": 1, "hash_ids": [5]}, {"id": "c", "t": 1.0, "in": 64, "out": 1, "hash_ids": [7]}, {"id": "a", "t": 9.0, "in": 10, "out": 1, "hash_ids": []}]
    (tmp_path / "w.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = readers.read(spark, "weka", str(tmp_path / "w.jsonl")).collect()
    assert [(r.id, r.t, r.remainder, [b.sibling for b in r.blocks]) for r in got] == [("a", 9.0, 10, []), ("c", 1.0, 0, [0]), ("c", 2.0, 6, [1])]
    (tmp_path / "bad.jsonl").write_text(json.dumps(lines[0] | {"out": None}))
    with pytest.raises(PySparkException):
        readers.read(spark, "weka", str(tmp_path / "bad.jsonl")).collect()


def test_texts_of_prompts_are_their_tokens_joined(spark):
    """Arrow batches give what the token arrays give: no blocks, short blocks, several slices, null remainders."""
    rows = [(k, [(10**12 * k + j, j - 1 if j else -1, 1 + (k * 7 + j) % 40, (k + j) % 5) for j in range(k % 4)], k % 9 if k % 3 else None) for k in range(300)]
    x = spark.createDataFrame(rows, "k long, b array<struct<hash_id:long,previous:long,length:long,sibling:long>>, r long")
    for vocabulary in (7, 1000, 2_000_000):
        y = x.withColumns({"t": blocks.prompt_text("b", vocabulary), "r": F.coalesce("r", F.lit(0)), "s": blocks.remainder_text("k", "r", vocabulary)})
        y = y.withColumns({"want_t": F.array_join(blocks.prompt_tokens("b", vocabulary), ","), "want_s": F.array_join(blocks.remainder_tokens("k", "r", vocabulary), ",")})
        assert y.where("t <> want_t or s <> want_s or t is null or s is null").count() == 0
        assert y.where("t <> ''").count() == 225
    short = x.select(F.expr("array(named_struct('hash_id', 1L, 'previous', 0L, 'length', 1L, 'sibling', 7L))").alias("b"))
    with pytest.raises(Exception, match="too short"):
        short.select(blocks.prompt_text("b", 7)).collect()


def test_slices_of_a_batch(monkeypatch):
    first, step, lengths, of_row = np.arange(6), np.full(6, 2), np.array([3, 0, 5, 1, 1, 9]), np.array([0, 2, 2, 3, 6])
    whole = blocks.joined(first, step, lengths, of_row, 10).to_pylist()
    assert whole == ["0,2,4", "", "2,4,6,8,0", "3,4,5,7,9,1,3,5,7,9,1"]
    monkeypatch.setattr(blocks, "SLICE", 4)
    assert blocks.joined(first, step, lengths, of_row, 3).to_pylist() == [",".join(str(int(x) % 3) for x in s) for s in ([0, 2, 4], [], [2, 4, 6, 8, 10], [3, 4, 5, 7, 9, 11, 13, 15, 17, 19, 21])]
