"""Queries over traces of hashed prompts: one made of orders, whose hash ids form a tree over the customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks as bl
from .datasets import table
from .telemetry import query_into

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = query_into(QUERIES, SQL)

BLOCK, VOCABULARY, ORDER = 64, 1000, ("o_orderdate", "o_orderkey")
#: The hash ids of a prompt, in Spark's and in DuckDB's SQL; every fifth prompt has two of them and ends within the second.
IDS = ("o_custkey % 16", "100 + o_custkey % 256", "1000 + o_custkey", "1000000000 + o_orderkey")


def length(least: int) -> str:
    return f"CASE WHEN o_orderkey % 5 = 0 THEN {BLOCK + 30} ELSE {least} + o_orderkey % {BLOCK} END"


def trace(spark: SparkSession, d: str, least: int) -> DataFrame:
    ids = f"CASE WHEN o_orderkey % 5 = 0 THEN array({', '.join(IDS[:2])}) ELSE array({', '.join(IDS)}) END"
    return table(spark, d, "orders").selectExpr(*ORDER, "o_custkey % 32 AS id", f"{ids} AS hash_ids", f"{length(least)} AS input_length")


def rows_sql(least: int) -> str:
    ids = f"CASE WHEN o_orderkey % 5 = 0 THEN [{', '.join(IDS[:2])}] ELSE [{', '.join(IDS)}] END"
    return f"rows_ AS (SELECT o_orderdate, o_orderkey, o_custkey % 32 AS id, {ids} AS ids, {length(least)} AS n FROM orders)"


#: Each id of each prompt; `n_ids` is the number of ids that count, `n_last` the length of a prompt's last block.
SPOTS = """spots AS (SELECT id, o_orderdate, o_orderkey, pos, ids[pos] AS hash_id, CASE WHEN pos > 1 THEN ids[pos - 1] ELSE -1 END AS previous, CAST(CASE WHEN pos = n_ids THEN n_last ELSE 64 END AS BIGINT) AS length
  FROM (SELECT *, unnest(range(1, CAST(n_ids + 1 AS BIGINT))) AS pos FROM counted))"""
#: Needs spots; {k} are further columns that part the dictionary, each followed by a comma.
KNOWN = """known AS (SELECT {k} hash_id, previous, length, row_number() OVER (PARTITION BY {k} previous ORDER BY o_orderdate, o_orderkey, pos) - 1 AS sibling, n_places
  FROM (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY {k} hash_id) AS n_places FROM spots WINDOW w AS (PARTITION BY {k} hash_id ORDER BY o_orderdate, o_orderkey, pos)) WHERE i = 1)"""
WHOLE = f"{rows_sql(193)}, counted AS (SELECT *, len(ids) AS n_ids, CASE WHEN n % 64 = 0 THEN 64 ELSE n % 64 END AS n_last FROM rows_), {SPOTS}, {KNOWN.format(k='')}"
PARTED = f"{rows_sql(256)}, counted AS (SELECT *, n // 64 AS n_ids, 64 AS n_last FROM rows_), {SPOTS}, {KNOWN.format(k='id,')}"
#: The tokens of a block of the dictionary b, with 1000 tokens in the vocabulary.
TOKENS = """[CASE WHEN i < 6 THEN (b.sibling // CAST(power(1000, least(i, 6)) AS BIGINT) % 1000 + (b.previous + 1) % 1000 + i) % 1000
  ELSE (b.hash_id % 1000 * 7919 + i * (1 + b.hash_id % 999)) % 1000 END FOR i IN range(b.length)]"""


@query(f"WITH {WHOLE} SELECT * FROM known")
def block_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return bl.block_dictionary(trace(spark, d, 193), ORDER, block=BLOCK)


@query(f"WITH {WHOLE} SELECT previous, count(*) AS n_siblings, count(*) AS n_blocks FROM known GROUP BY 1")
def sibling_blocks(spark: SparkSession, d: str) -> DataFrame:
    """All siblings have blocks of their own: as many different sequences of tokens as ids."""
    x = bl.block_dictionary(trace(spark, d, 193), ORDER, block=BLOCK).withColumn("b", F.array(F.struct("hash_id", "previous", "length", "sibling")))
    digest = F.sha2(F.array_join(F.flatten(bl.block_tokens("b", VOCABULARY)), ","), 256)
    return x.select("previous", digest.alias("t")).groupBy("previous").agg(F.count("t").alias("n_siblings"), F.countDistinct("t").alias("n_blocks"))


@query(f"""WITH {WHOLE}, parts AS (SELECT s.o_orderkey, s.pos, {TOKENS} AS t FROM spots s JOIN known b USING (hash_id))
SELECT o_orderkey, CAST(sum(len(t)) AS BIGINT) AS n_tokens, md5(string_agg(array_to_string(t, ','), ',' ORDER BY pos)) AS tokens_md5 FROM parts GROUP BY 1""")
def trace_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The tokens of each prompt, by the ids that all prompts share."""
    x = bl.with_blocks(trace(spark, d, 193), ORDER, block=BLOCK).withColumn("t", bl.prompt_text("blocks", VOCABULARY))
    n = F.aggregate("blocks", F.lit(0).cast("bigint"), lambda n, b: n + b["length"])
    return x.select("o_orderkey", n.alias("n_tokens"), F.md5(F.col("t").cast("binary")).alias("tokens_md5"))


@query(f"""WITH {PARTED}, parts AS (SELECT s.o_orderkey, s.pos, {TOKENS} AS t FROM spots s JOIN known b USING (id, hash_id)),
texts AS (SELECT o_orderkey, count(*) AS n_blocks, string_agg(array_to_string(t, ','), ',' ORDER BY pos) AS t FROM parts GROUP BY 1)
SELECT r.id, o_orderkey, n_blocks, r.n % 64 AS remainder,
  md5(concat_ws(',', t, nullif(array_to_string([(o_orderkey % 1000 * 31 + i * (1 + o_orderkey % 1000 % 999)) % 1000 FOR i IN range(r.n % 64)], ','), ''))) AS tokens_md5
FROM rows_ r JOIN texts USING (o_orderkey)""")
def conversation_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Whole blocks by the ids of each conversation alone, then what remains; begun blocks' ids are dropped."""
    x = bl.conversation_blocks(trace(spark, d, 256), ORDER, "id", "input_length", "hash_ids", BLOCK)
    x = x.withColumns({"t": bl.prompt_text("blocks", VOCABULARY), "r": bl.remainder_text("o_orderkey", "remainder", VOCABULARY)})
    tokens = F.concat_ws(",", *(F.nullif(F.col(c), F.lit("")) for c in ("t", "r")))
    return x.select("id", "o_orderkey", F.size("blocks").cast("bigint").alias("n_blocks"), "remainder", F.md5(tokens.cast("binary")).alias("tokens_md5"))
