"""Dataset queries: texts, conversations, their graphs, positional joins, preprocessing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import conversations as cv
from ..operators import preprocess as pp
from .telemetry import query_into

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = query_into(QUERIES, SQL)

#: Words of `text` in SQL.
WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query(f"SELECT doc_id, length(text) AS chars, len({WORDS}) AS words FROM documents")
def text_metrics(spark: SparkSession, d: str) -> DataFrame:
    t = F.coalesce(F.col("text"), F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.length(t).cast("bigint").alias("chars"), F.size(scalars.words(t)).cast("bigint").alias("words"))


@query("""SELECT conv_id, string_agg(text, ' ' ORDER BY turn) FILTER (lower(role) IN ('user', 'human')) AS text,
  string_agg(text, ' ' ORDER BY turn) FILTER (lower(role) = 'system') AS prefix FROM conversations WHERE length(text) > 0 GROUP BY conv_id""")
def message_extract(spark: SparkSession, d: str) -> DataFrame:
    return cv.extract_messages(table(spark, d, "conversations"))


EDGES = "edges AS (SELECT * FROM (SELECT conv_id, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS source, turn AS target FROM conversations) WHERE source IS NOT NULL)"


@query(f"WITH {EDGES} SELECT *, 'full' AS history FROM edges")
def linear_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return cv.linear_edges(table(spark, d, "conversations"))


@query("SELECT conv_id, turn AS node, row_number() OVER w - 1 AS turn_index, row_number() OVER w - 1 AS history_len FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def turn_index(spark: SparkSession, d: str) -> DataFrame:
    return cv.turn_index(table(spark, d, "conversations"))


@query(f"WITH {EDGES} SELECT e.conv_id, e.target AS turn, e.source * 10 + length(c.text) % 5 AS ready_at FROM edges e JOIN conversations c ON c.conv_id = e.conv_id AND c.turn = e.source")
def dag_readiness(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    done = c.select("conv_id", "turn", (F.col("turn") * 10).alias("ended"), (F.length("text") % 5).alias("delay"))
    return cv.readiness(cv.linear_edges(c), done, "conv_id", "turn", "ended", "delay")


@query(f"WITH {EDGES} SELECT conv_id, turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.conv_id = c.conv_id AND e.target = c.turn)")
def graph_roots(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return cv.roots(c.select("conv_id", "turn"), cv.linear_edges(c), "conv_id", "turn")


@query("""SELECT a.i, doc_id, item_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) a
JOIN (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i FROM benchmark) b USING (i)""")
def positional_zip(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "documents").select("doc_id"), table(spark, d, "benchmark").select("item_id")
    return cv.zip_rows(a, b, "doc_id", "item_id")


@query(f"SELECT doc_id, array_to_string(list_slice({WORDS}, 1, 50), ' ') AS prompt, least(len({WORDS}), 50) AS prompt_tokens FROM documents")
def preprocess_trim(spark: SparkSession, d: str) -> DataFrame:
    return pp.trim(table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit(""))), "text", 50).select("doc_id", "prompt", "prompt_tokens")


@query(f"SELECT doc_id FROM documents WHERE len({WORDS}) >= 50")
def preprocess_ignore(spark: SparkSession, d: str) -> DataFrame:
    return pp.ignore_short(table(spark, d, "documents"), "text", 50).select("doc_id")


@query(f"SELECT doc_id, array_to_string(list_concat({WORDS}, [CASE WHEN i % 2 = 0 THEN 'pad' ELSE 'word' END FOR i IN range(greatest(0, 64 - len({WORDS})))]), ' ') AS prompt, greatest(len({WORDS}), 64) AS prompt_tokens FROM documents")
def preprocess_pad(spark: SparkSession, d: str) -> DataFrame:
    return pp.pad_short(table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit(""))), "text", 64, "pad word").select("doc_id", "prompt", "prompt_tokens")


@query(r"SELECT doc_id, trim(regexp_replace(text, '[\s\x1C-\x1F]+', ' ', 'g')) AS clean FROM documents")
def cleaned_text(spark: SparkSession, d: str) -> DataFrame:
    """Three texts in four are damaged here, as latin-1, as windows-1252, or twice, and cleaned with the others."""
    wrong = lambda t: F.decode(F.encode(t, "UTF-8"), "ISO-8859-1")
    n, t = F.col("doc_id") % 4, F.col("text")
    damaged = F.when(n == 1, wrong(t)).when(n == 2, F.translate(wrong(t), scalars.LATIN_1, scalars.WINDOWS_1252)).when(n == 3, wrong(wrong(t))).otherwise(t)
    return table(spark, d, "documents").select("doc_id", scalars.clean_text(damaged).alias("clean"))
