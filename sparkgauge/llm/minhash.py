"""Near-duplicates by MinHash with tensored banding; every candidate is verified on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, drop, free_name, numbered

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


class Words(dict):
    """Hash of each word, in a cache that starts anew when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * M1
    x = (x ^ (x >> np.uint64(29))) * M2
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, width: int, words: Words) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; with fewer words than width, of the whole sequence."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    k = min(width, len(h))
    s = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        s = mix64(s * M2 + h[j : len(h) - k + 1 + j])
    return np.unique(s)


@lru_cache
def multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, n, dtype=np.uint64)


def small_keys(s: np.ndarray, size: int, rows: int) -> np.ndarray:
    """Two collections of `size` keys, each of `rows` minhashes: 2 x size x rows hash functions in all."""
    a, b = multipliers(2 * size * rows)
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):  # bounded memory for very long texts
        part = s[at : at + 4096]
        low = np.minimum(low, (part[None, :] * a[:, None] + b[:, None]).min(1))
    keys = low.reshape(2 * size, rows)
    out = np.arange(2 * size, dtype=np.uint64)
    for j in range(rows):
        out = mix64(out * M2 + keys[:, j])
    return out.view(np.int64)


def parities(s: np.ndarray) -> np.ndarray:
    """512 bits: whether an odd number of the set falls in each of as many classes. Two sets differ in at least as many shingles as bits."""
    odd = np.bincount((s * M2 >> np.uint64(55)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def may_be_alike(similarity: int, *sides: tuple[str, str]):
    """Whether two sets (bits, size) can reach the similarity; never false for a pair that does."""
    (x, n), (y, m) = sides
    apart = sum((F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k])) for k in range(1, 8)), F.bit_count(F.col(x)[0].bitwiseXOR(F.col(y)[0])))
    sizes = 100 * F.least(n, m) >= similarity * F.greatest(n, m)
    return sizes & ((100 + similarity) * apart <= (100 - similarity) * (F.col(n) + F.col(m)))


def signatures(docs: DataFrame, width: int, size: int, rows: int) -> DataFrame:
    """(id, n_shingles, d1, d2, keys, bits): set size, a 128-bit digest of the set, the small keys, the parities. Small keys of unlike places differ."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for b in batches:
            out = []
            for i, t in zip(b["id"], b["text"], strict=True):
                s = shingle_set(t, width, words)
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                out.append((i, len(s), (d >> 64) - 2**63, (d & (2**64 - 1)) - 2**63, small_keys(s, size, rows) if len(s) else [], parities(s) if len(s) else []))
            yield pd.DataFrame(out, columns=["id", "n_shingles", "d1", "d2", "keys", "bits"])

    return docs.mapInPandas(run, "id long, n_shingles long, d1 long, d2 long, keys array<long>, bits array<long>")


def sets_of(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "shingles": [shingle_set(t, width, words).view(np.int64) for t in b["text"]]})

    return docs.mapInPandas(run, "id long, shingles array<long>")


def paired(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs with the shingle sets sa, sb of a and b."""
    left, right = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(left, "a").join(right, "b")


def verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) with 100 x intersection >= similarity x union, on full sets, as a table."""
    x = paired(pairs, sets).withColumn("n", F.size(F.array_intersect("sa", "sb")))
    return cut(x.where(100 * F.col("n") >= similarity * (F.size("sa") + F.size("sb") - F.col("n"))).select("a", "b"))


def table_groups(reps: DataFrame, size: int) -> DataFrame:
    """(id, key) for every table key that more than one of reps (id, keys) has, as a table.

    A table's key joins two small keys, so only documents of which both small keys are met elsewhere can
    meet in it: the 2 x size small keys are counted first, and few tables are left to spread out.
    """
    small = reps.select("id", F.posexplode("keys").alias("at", "small"))
    met = small.groupBy("small").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("small")
    alive = small.join(met, "small", "left_semi").groupBy("id").agg(F.collect_list(F.struct("at", "small")).alias("s"))
    side = lambda test: F.filter("s", lambda x: test(x["at"]))
    keys = F.flatten(F.transform(side(lambda at: at < size), lambda i: F.transform(side(lambda at: at >= size), lambda j: F.xxhash64(i["small"], j["small"]))))
    keyed = cut(alive.select("id", F.explode(keys).alias("key")))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    groups = cut(keyed.join(shared, "key", "left_semi"))
    drop(keyed)
    return groups


def met_leaders(groups: DataFrame, reps: DataFrame, similarity: int, stars: int) -> DataFrame:
    """(a, b), each once: members and `stars` leaders of every group that may be alike, as a table. A few leaders serve the many tables in which the same documents meet."""
    g = groups.join(reps.select("id", "n_shingles", "bits"), "id")
    who = F.struct(F.col("id").alias("leader"), F.col("n_shingles").alias("n"), F.col("bits").alias("other"))
    firsts = [F.min_by(who, F.xxhash64("id", F.pmod("key", F.lit(4)), F.lit(k))) for k in range(stars)]
    lead = g.groupBy("key").agg(F.array_distinct(F.array(*firsts)).alias("m")).select("key", F.inline("m"))
    met = g.join(lead, "key").where((F.col("id") != F.col("leader")) & may_be_alike(similarity, ("bits", "n_shingles"), ("other", "n")))
    return cut(met.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct())


def across(groups: DataFrame, comp: DataFrame, reps: DataFrame, sets: DataFrame, similarity: int) -> tuple[DataFrame, DataFrame]:
    """(a, b) of different components of one group, each once, as two tables: those that link, and those that may.

    The first are of a leader and a document that links to it, though no table has brought the two together. The
    others are found by prefix filtering over differences from a leader L, the document that the group's largest component is
    known by; it is the same one in all tables in which the component's copies meet. Let D(x) be the
    shingles that x and L don't share, and c = (100 - similarity) / (100 + similarity): x and y link when
    |D(x) ^ D(y)| <= c (|x| + |y|). Documents that link to L are joined with it by the first table. Of two others, or
    one of each kind, one, x, doesn't link to L, so
    |D(x)| > c (|x| + |L|), and to link, x and y must share more than o = (|D(y)| + c (|L| - |y|)) / 2
    elements of D. Hence any |D(y)| - floor(o) elements of D(y) hold one of D(x). x is indexed by all of
    D(x); y asks by its rarest such elements, of which those that no document of another component has
    are free. What a group has in common, a template or a quoted passage, is in no D or is the last to
    be asked for, so documents meet only over what sets both apart from the rest in the same way.
    """
    g = groups.join(comp.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    parts = g.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max_by("component", F.struct("n", F.xxhash64("component"))).alias("leader")).where("c > 1").select("key", "leader")
    cohort = cut(g.join(mixed, "key").select("leader", "id", "component").distinct())
    x = paired(cohort.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b"), "component"), sets)
    left, right = 100 + similarity, 100 - similarity
    x = x.select(F.col("a").alias("leader"), F.col("b").alias("id"), "component", F.size("sa").alias("nl"), F.size("sb").alias("n"), F.concat(F.array_except("sa", "sb"), F.array_except("sb", "sa")).alias("d"))
    apart = cut(x.withColumn("far", left * F.size("d") > right * (F.col("n") + F.col("nl"))))
    drop(cohort)
    near = cut(apart.where("not far and component <> leader").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct())
    index = apart.where("far").select("leader", "id", "component", F.explode("d").alias("e"))
    held = index.groupBy("leader", "e").agg(F.count(F.lit(1)).alias("often"), F.min("component").alias("x"), F.max("component").alias("y"))
    asks = apart.select("leader", "id", "component", "n", "nl", F.size("d").alias("size"), F.explode("d").alias("e")).join(held, ["leader", "e"])
    asks = asks.where("component <> x or component <> y").groupBy("leader", "id", "component", "n", "nl", "size").agg(F.array_sort(F.collect_list(F.struct("often", "e"))).alias("hits"))
    # Of the elements that must be asked for, size - floor(o), all without a hit come first.
    probes = F.size("hits") - F.floor((F.col("size") * left + right * (F.col("nl") - F.col("n"))) / (2 * left))
    asks = cut(asks.where(probes > 0).select("leader", "id", "component", F.explode(F.slice("hits", F.lit(1), F.least(probes, F.size("hits")).cast("int"))["e"]).alias("e")))
    bits = reps.select("id", "n_shingles", "bits")
    ask = asks.join(bits, "id")
    found = index.select("leader", "e", F.col("id").alias("far"), F.col("component").alias("c")).join(bits.select(F.col("id").alias("far"), F.col("n_shingles").alias("n"), F.col("bits").alias("other")), "far")
    met = ask.join(found, ["leader", "e"]).where((F.col("component") != F.col("c")) & may_be_alike(similarity, ("bits", "n_shingles"), ("other", "n")))
    pairs = cut(met.select(F.least("id", "far").alias("a"), F.greatest("id", "far").alias("b")).distinct())
    drop(apart, asks)
    return near, pairs


def classes(docs: DataFrame, width: int, similarity: int = 80, size: int = 8, rows: int = 2, stars: int = 3) -> DataFrame:
    """(id, n_shingles, component) for rows (id, text) with unlike ids.

    1. Equal sets become one class, known by its smallest id.
    2. Tensored banding: table (i, j) is keyed by key i of the first small collection and key j of the
       second, so size ** 2 tables of 2 x rows minhashes cost only 2 x size x rows of them. At similarity
       0.8 the chance to miss a pair is below 0.1 % with the defaults.
    3. In each table's groups, members are verified against `stars` leaders; a group within one component
       needs no more. Members of different components of a group meet over what sets them apart from a
       leader (see `across`), which loses no pair of the group that links. Parities rule out most pairs
       that can't reach the similarity before anything is emitted.
    """
    sig = cut(signatures(docs, width, size, rows))
    some = sig.where("n_shingles > 0")
    same = cut(some.groupBy("d1", "d2").agg(F.min(F.struct("id", "n_shingles", "keys", "bits")).alias("m")).select("d1", "d2", "m.*"))
    groups = table_groups(same, size)
    # The full sets of all documents that meet others, from their texts, which move once and alike at every size.
    sets = cut(sets_of(docs.join(groups.select("id").distinct().hint("merge"), "id", "left_semi"), width))
    pairs = met_leaders(groups, same, similarity, stars)
    links = verified(pairs, sets, similarity)
    comp = connected_components(links)
    drop(pairs)
    near, pairs = across(groups, comp, same, sets, similarity)
    if near.head(1) or pairs.head(1):
        more = verified(pairs, sets, similarity)
        drop(comp)
        comp = connected_components(links.unionByName(near).unionByName(more))
        drop(more)
    drop(near, pairs, links, groups, sets)
    found = sig.join(same.select("d1", "d2", F.col("id").alias("rep")), ["d1", "d2"], "left").join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
    found = cut(found.select("id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep")).otherwise(F.col("id")).alias("component")))
    drop(sig, same, comp)
    return found


def near_duplicates(docs: DataFrame, width: int = 5, similarity: int = 80, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per document.

    Shingles are `width` words of the text with A-Z lower-cased; a shorter text is one shingle, a null,
    empty or blank text has none and stands alone. component_id is the smallest id reachable. Rows of a
    repeated id are documents of their own and keep a row each; a row whose id is null is linked with
    nothing: its component_id is null and it is kept. Other columns are not carried; an empty table
    gives no rows.
    """
    base = numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "id")
    ids = base.select("id", "doc_id")
    out = cut(classes(base.where("doc_id is not null").select("id", "text"), width, similarity, **options).join(ids, "id"))
    # A table, so that Spark can split the rows of a large component in the join.
    least = cut(out.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    out = out.join(least, "component", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    alone = classes_of_none(base.where("doc_id is null"), width)
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept")).unionByName(alone)


def classes_of_none(docs: DataFrame, width: int) -> DataFrame:
    """Rows without an id: their set's size only."""
    none = F.lit(None).cast(docs.schema["doc_id"].dataType)
    return sets_of(docs.select("id", "text"), width).select(none.alias("doc_id"), F.size("shingles").cast("long").alias("n_shingles"), none.alias("component_id"), F.lit(True).alias("kept"))


def keep_representatives(docs: DataFrame, width: int = 5, **options) -> DataFrame:
    """One row of each group of near copies, with the columns of docs: the smallest doc_id, of equal ids one of them.

    A row with a null doc_id is a document like others, and stays only where it has no near copy with an
    id. Empty and null texts link with nothing and stay. An empty table stays empty.
    """
    row = free_name(docs, "row")
    rows = numbered(docs, row)
    found = classes(rows.select(F.col(row).alias("id"), "text"), width, **options)
    lead = found.join(rows.select(F.col(row).alias("id"), "doc_id"), "id").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "id")).alias("m"))
    return rows.join(lead.select(F.col("m.id").alias(row)), row, "left_semi").drop(row)
