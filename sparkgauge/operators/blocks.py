"""Blocks of hashed prompts: a dictionary of hash ids with a rank among siblings, and prompts looked up in it.

A hash id stands for a block of tokens after the block of its previous id. The first row, in order, that names an
id settles its previous id and its length; ids with the same previous id (siblings) get ranks 0, 1, 2, ... in that
order, and a block begins with its rank in base `vocabulary`, so that no two siblings have equal blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import in_order, settle, with_running

#: An id that has at least one in HOT of all places is looked up by broadcast; there are at most HOT such ids.
HOT = 1000
#: The previous id of a prompt's first block.
ROOT = -1


def blocks_fit(n_in: str, ids: str, block: int = 512, floor_too: bool = False) -> Column:
    """Whether ids are no negative numbers and as many as the prompt has blocks, begun ones included (or, if so said, left out)."""
    n = F.size(ids)
    count = n == F.ceil(F.col(n_in) / block)
    if floor_too:
        count = count | (n == F.floor(F.col(n_in) / block))
    return F.forall(ids, lambda x: x >= 0) & count


def checked(df: DataFrame, needed: tuple[str, ...], n_in: str, ids: str, block: int, floor_too: bool = False) -> DataFrame:
    """df; a null in a needed column, a null or negative id, or a count of ids that doesn't fit ends the query with an error."""
    known = F.lit(True)
    for c in {*needed, n_in, ids}:
        known = known & F.col(c).isNotNull()
    ok = F.coalesce(known & blocks_fit(n_in, ids, block, floor_too), F.lit(False))
    return df.withColumn(ids, F.when(ok, F.col(ids)).otherwise(F.raise_error(F.lit("hash ids don't fit the prompt")).cast(df.schema[ids].dataType)))


def places(df: DataFrame, keys: list[str], order: tuple[str, ...], n_in: str, ids: str, block: int) -> DataFrame:
    """(keys, order, at, hash_id, previous, length): one row for each id of each prompt; an id that ends a prompt takes what is left of it."""
    rest = F.col(n_in) % block
    x = df.select(*keys, *order, rest.cast("bigint").alias("_rest"), F.element_at(ids, -1).alias("_last"), ids, F.posexplode(ids).alias("at", "_id"))
    length = F.when((F.col("_id") == F.col("_last")) & (F.col("_rest") > 0), F.col("_rest")).otherwise(F.lit(block).cast("bigint"))
    previous = F.when(F.col("at") > 0, F.get(ids, F.col("at") - 1)).otherwise(F.lit(ROOT))
    return x.select(*keys, *order, "at", F.col("_id").cast("bigint").alias("hash_id"), previous.cast("bigint").alias("previous"), length.alias("length"))


def dictionary(spots: DataFrame, keys: list[str], order: tuple[str, ...]) -> DataFrame:
    """(keys, hash_id, previous, length, sibling, n_places) from `places`; ids of different keys have nothing to do with each other.

    Ids are grouped before they move, and ranked by ranges: the children of one id may be any share of all ids.
    """
    first = (*order, "at")
    ids = spots.groupBy(*keys, "hash_id").agg(F.min_by(F.struct("previous", "length", *first), F.struct(*first)).alias("f"), F.count(F.lit(1)).alias("n_places"))
    ids = ids.select(*keys, "hash_id", "f.*", "n_places").withColumn("_one", F.lit(1).cast("bigint"))
    family = [*keys, "previous"]
    ranked = with_running(in_order(ids, family, first[0], first[1:]), family, first[0], {"_upto": "_one"}, first[1:])
    return ranked.select(*keys, "hash_id", "previous", "length", (F.col("_upto") - 1).alias("sibling"), "n_places")


def block_dictionary(df: DataFrame, order: tuple[str, ...], keys: list[str] | None = None, n_in: str = "input_length", ids: str = "hash_ids", block: int = 512) -> DataFrame:
    """The dictionary of a trace whose rows are told apart and ordered, within keys, by `order`."""
    keys = keys or []
    return dictionary(places(checked(df, (*keys, *order), n_in, ids, block), keys, order, n_in, ids, block), keys, order)


def with_blocks(df: DataFrame, order: tuple[str, ...], keys: list[str] | None = None, n_in: str = "input_length", ids: str = "hash_ids", block: int = 512) -> DataFrame:
    """df with `blocks`, the (hash_id, previous, length, sibling) of each id in order; empty for a prompt without ids.

    Ids in many places are few, so they are looked up by broadcast; the others are joined by id. Only these four
    numbers move, no tokens; a row's blocks come together in one array, as its ids were.
    """
    keys = keys or []
    df = checked(df, (*keys, *order), n_in, ids, block)
    spots = places(df, keys, order, n_in, ids, block)
    known = settle(dictionary(spots, keys, order))
    by, entry = [*keys, "hash_id"], ("previous", "length", "sibling")
    total = known.agg(F.sum("n_places").alias("_total"))
    marked = known.crossJoin(F.broadcast(total)).withColumn("_hot", F.col("n_places") * HOT >= F.col("_total"))
    hot, cold = (marked.where(c).select(*by, *entry) for c in ("_hot", "NOT _hot"))
    spots = spots.drop("previous", "length")
    found = spots.join(F.broadcast(hot), by).unionByName(spots.join(F.broadcast(hot.select(*by)), by, "left_anti").join(cold, by))
    row = [*keys, *order]
    lists = found.groupBy(*row).agg(F.array_sort(F.collect_list(F.struct("at", "hash_id", *entry))).alias("_b"))
    none = F.array().cast("array<struct<hash_id:bigint,previous:bigint,length:bigint,sibling:bigint>>")
    blocks = F.transform("_b", lambda b: F.struct(b["hash_id"].alias("hash_id"), *(b[c].alias(c) for c in entry)))
    return df.join(lists, row, "left").withColumn("blocks", F.coalesce(blocks, none)).drop("_b").select(*df.columns, "blocks")


def digits_of(vocabulary: int) -> int:
    """How many tokens of a block hold its rank."""
    if vocabulary < 2:
        raise ValueError("a vocabulary has at least two tokens")
    digits = 1
    while vocabulary ** (digits + 1) < 2**62:
        digits += 1
    return digits


def block_tokens(blocks: str, vocabulary: int) -> Column:
    """The token ids of each block: the rank among siblings in base `vocabulary`, moved by the previous id, then a walk by the id.

    A block too short to hold its rank ends the query with an error.
    """
    digits = digits_of(vocabulary)
    powers = "array(" + ", ".join(f"{vocabulary**i}L" for i in range(digits + 1)) + ")"
    v = f"{vocabulary}L"
    rank = f"pmod(b.sibling div get({powers}, CAST(i AS INT)) % {v} + (b.previous + 1) % {v} + i, {v})"
    walk = f"(b.hash_id % {v} * 7919L + i * (1 + b.hash_id % ({v} - 1))) % {v}"
    tokens = f"transform(sequence(0L, b.length - 1), i -> CASE WHEN i < {digits} THEN {rank} ELSE {walk} END)"
    short = f"b.sibling >= get({powers}, CAST(least(b.length, {digits}L) AS INT))"
    return F.expr(f"transform({blocks}, b -> CASE WHEN {short} THEN CAST(raise_error('a block is too short for its siblings') AS ARRAY<BIGINT>) ELSE {tokens} END)")


def prompt_tokens(blocks: str, vocabulary: int) -> Column:
    return F.flatten(block_tokens(blocks, vocabulary))


#: Tokens that are in numpy arrays at a time, but for those of a single longer prompt.
SLICE = 1 << 20


def joined(first: np.ndarray, step: np.ndarray, lengths: np.ndarray, of_row: np.ndarray, vocabulary: int, put=None) -> pa.Array:
    """For each row the comma-joined tokens (first + i x step) mod vocabulary of its pieces, i from 0 to below a piece's length.

    of_row: where each row's pieces begin, and their number. put(tokens, starts, pieces) may write over tokens of a slice of pieces.
    """
    names = pa.array([str(x) for x in range(vocabulary)], pa.string()) if vocabulary <= SLICE else None
    total = np.concatenate([[0], np.cumsum(lengths)])
    ends, out, a = total[of_row], [], 0  # tokens before each row
    if len(lengths) and first.max() + lengths.max() * step.max() < 2**31:  # half as wide, where it can't overflow
        first, step = first.astype(np.int32), step.astype(np.int32)
    while a < len(of_row) - 1:
        z = max(a + 1, int(np.searchsorted(ends, ends[a] + SLICE, "right")) - 1)
        pieces = slice(of_row[a], of_row[z])
        n = lengths[pieces]
        starts = total[pieces] - ends[a]
        i = (np.arange(n.sum()) - np.repeat(starts, n)).astype(first.dtype)
        tokens = (np.repeat(first[pieces], n) + i * np.repeat(step[pieces], n)) % vocabulary
        if put:
            put(tokens, starts, pieces)
        words = names.take(pa.array(tokens)) if names else pa.array(tokens).cast(pa.string())
        out.append(pc.binary_join(pa.ListArray.from_arrays(pa.array((ends[a : z + 1] - ends[a]).astype(np.int32)), words), ","))
        a = z
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def prompt_text(blocks: str, vocabulary: int) -> Column:
    """The tokens of `prompt_tokens`, comma-joined, computed by Arrow batches; none: empty."""
    digits = digits_of(vocabulary)

    def text(b: pa.Array) -> pa.Array:
        at = b.offsets.to_numpy().astype(np.int64)
        flat = b.values.slice(at[0], at[-1] - at[0])
        ident, previous, lengths, sibling = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("hash_id", "previous", "length", "sibling"))
        powers = np.array([vocabulary**i for i in range(digits + 1)], np.int64)
        if (sibling >= powers[np.minimum(lengths, digits)]).any():
            raise ValueError("a block is too short for its siblings")

        def rank(tokens: np.ndarray, starts: np.ndarray, pieces: slice) -> None:
            n, s, p = lengths[pieces], sibling[pieces], (previous[pieces] + 1) % vocabulary
            for i in range(digits):
                has = n > i
                tokens[starts[has] + i] = (s[has] // powers[i] % vocabulary + p[has] + i) % vocabulary

        return joined(ident % vocabulary * 7919, 1 + ident % (vocabulary - 1), lengths, at - at[0], vocabulary, rank)

    return F.arrow_udf(text, "string")(F.col(blocks))


def remainder_text(order: str, remainder: str, vocabulary: int) -> Column:
    """The tokens of `remainder_tokens`, comma-joined, computed by Arrow batches; none: empty."""

    def text(o: pa.Array, r: pa.Array) -> pa.Array:
        at = o.to_numpy(zero_copy_only=False).astype(np.int64) % vocabulary
        n = np.maximum(r.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), 0)
        return joined(at * 31, 1 + at % (vocabulary - 1), n, np.arange(len(n) + 1), vocabulary)

    return F.arrow_udf(text, "string")(F.col(order).cast("bigint"), F.col(remainder).cast("bigint"))


def conversation_blocks(df: DataFrame, order: tuple[str, ...], conversation: str = "id", n_in: str = "in", ids: str = "hash_ids", block: int = 64) -> DataFrame:
    """df with ids of whole blocks only, their `blocks` and `remainder`, the prompt's tokens beyond them.

    Each conversation has ids of its own. An id for a begun block may be there; it is dropped.
    """
    df = checked(df, (conversation, *order), n_in, ids, block, True)
    whole = F.slice(F.col(ids), F.lit(1), F.floor(F.col(n_in) / block).cast("int"))
    x = df.withColumns({ids: whole, "remainder": (F.col(n_in) % block).cast("bigint"), "_whole": F.col(n_in) - F.col(n_in) % block})
    return with_blocks(x, order, [conversation], "_whole", ids, block).drop("_whole")


def remainder_tokens(order: str, remainder: str, vocabulary: int) -> Column:
    """The tokens of a prompt beyond its whole blocks: a walk by the prompt's place in the order."""
    v = f"{vocabulary}L"
    at = f"pmod(CAST({order} AS BIGINT), {v})"
    return F.expr(f"CASE WHEN {remainder} > 0 THEN transform(sequence(0L, {remainder} - 1), i -> ({at} * 31L + i * (1 + {at} % ({v} - 1))) % {v}) ELSE CAST(array() AS ARRAY<BIGINT>) END")
