"""Queries over conversation graphs and chat requests, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import requests as rq
from ..operators import chats, constraints, graphs
from .telemetry import REQUESTS, query_into

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = query_into(QUERIES, SQL)

#: A chain for each conversation, broken before every fifth turn; every third turn also takes the response two turns before.
EDGES = """chain AS (SELECT * FROM (SELECT conv_id, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS source, turn AS target FROM conversations) WHERE source IS NOT NULL),
edges AS (SELECT *, CASE WHEN target % 5 = 4 THEN 'new' ELSE 'full' END AS history FROM chain
  UNION ALL SELECT a.conv_id, a.turn, b.turn, 'last' FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 2 WHERE b.turn % 3 = 0)"""
UP = f"""{EDGES}, up AS (SELECT conv_id, turn AS node, turn AS anc, 0 AS d FROM conversations
  UNION ALL SELECT up.conv_id, node, source, d + 1 FROM up JOIN edges e ON e.conv_id = up.conv_id AND e.target = anc AND e.history = 'full')"""


def turns(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/conversations.parquet")


def edges(c: DataFrame) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    chain = c.select("conv_id", F.lag("turn").over(w).alias("source"), F.col("turn").alias("target")).where("source is not null")
    chain = chain.withColumn("history", F.when(F.col("target") % 5 == 4, "new").otherwise("full"))
    ends = c.where("turn % 3 = 0").select("conv_id", (F.col("turn") - 2).alias("source"), F.col("turn").alias("target"), F.lit("last").alias("history"))
    return chain.unionByName(ends.join(c.select("conv_id", F.col("turn").alias("source")), ["conv_id", "source"], "left_semi"))


@query(f"""WITH RECURSIVE {UP} SELECT up.conv_id, node AS turn, max(d + CASE WHEN l.target IS NULL THEN 0 ELSE 1 END) AS turn_index
FROM up LEFT JOIN (SELECT DISTINCT conv_id, target FROM edges WHERE history = 'last') l ON l.conv_id = up.conv_id AND l.target = anc GROUP BY 1, 2""")
def graph_turn_index(spark: SparkSession, d: str) -> DataFrame:
    c = turns(spark, d)
    return graphs.turn_indices(c, edges(c), "conv_id", "turn")


@query(f"""WITH RECURSIVE {UP}, h AS (SELECT conv_id, node, 0 AS part, -d AS pos, anc AS said FROM up WHERE d > 0
  UNION ALL SELECT up.conv_id, node, 1, -d, e.source FROM up JOIN edges e ON e.conv_id = up.conv_id AND e.target = anc AND e.history = 'last')
SELECT c.conv_id, c.turn, coalesce(string_agg(said, ',' ORDER BY part, pos, said), '') AS history FROM conversations c LEFT JOIN h ON h.conv_id = c.conv_id AND h.node = c.turn GROUP BY 1, 2""")
def graph_history(spark: SparkSession, d: str) -> DataFrame:
    c = turns(spark, d)
    return graphs.histories(c, edges(c), "conv_id", "turn").select("conv_id", "turn", F.concat_ws(",", F.col("history").cast("array<string>")).alias("history"))


@query(f"""WITH RECURSIVE {EDGES}, far AS (SELECT conv_id, turn AS node, 0 AS n FROM conversations UNION SELECT far.conv_id, target, n + 1 FROM far JOIN edges e ON e.conv_id = far.conv_id AND e.source = far.node)
SELECT conv_id, node AS turn, max(n) AS level FROM far GROUP BY 1, 2""")
def graph_levels(spark: SparkSession, d: str) -> DataFrame:
    c = turns(spark, d)
    return graphs.levels(c, edges(c), "conv_id", "turn")


@query(f"""WITH {EDGES}, tools AS (SELECT conv_id, turn FROM conversations WHERE turn % 4 = 1), e AS (
  SELECT e.conv_id, source || CASE WHEN t.turn IS NULL THEN '' ELSE '_injection' END AS source, CAST(target AS VARCHAR) AS target, history FROM edges e LEFT JOIN tools t ON t.conv_id = e.conv_id AND t.turn = e.source
  UNION ALL SELECT conv_id, CAST(turn AS VARCHAR), turn || '_injection', 'full' FROM tools) SELECT * FROM e""")
def tool_expansion(spark: SparkSession, d: str) -> DataFrame:
    c = turns(spark, d)
    e = edges(c).withColumns({x: F.col(x).cast("string") for x in ("source", "target")})
    nodes = c.select("conv_id", F.col("turn").cast("string").alias("node"), (F.col("turn") % 4 == 1).alias("is_tool"))
    return graphs.expand_tools(nodes, e, "conv_id", "node")[1]


@query("SELECT conv_id, turn, coalesce(string_agg(nullif(text, ''), ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), '') AS prompt FROM conversations")
def completions_prompt(spark: SparkSession, d: str) -> DataFrame:
    c = turns(spark, d).select("conv_id", "turn", F.nullif("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("none"))
    return chats.completions_prompt(c, "conv_id", "turn", "none", "text", "none")


@query("""SELECT conv_id, string_agg(role || ':' || text, '|' ORDER BY turn) AS messages FROM (SELECT conv_id, turn, role, text FROM conversations WHERE length(text) > 0) GROUP BY conv_id""")
def chat_messages(spark: SparkSession, d: str) -> DataFrame:
    said = lambda role: F.when(F.col("role") == role, F.col("text"))
    c = turns(spark, d).where(F.length("text") > 0).select("conv_id", "turn", said("system").alias("prefix"), said("user").alias("text"), said("assistant").alias("response"))
    m = chats.messages(c, "conv_id", "turn", "prefix", "text", "response")
    return m.select("conv_id", F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|").alias("messages"))


@query("SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS text, count(*) AS n_chunks FROM conversations GROUP BY conv_id")
def stream_assembly(spark: SparkSession, d: str) -> DataFrame:
    c = turns(spark, d)
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices")))
    lines = c.select("conv_id", "turn", F.concat(F.lit("data: "), body).alias("line"))
    ends = c.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn")).withColumn("line", F.lit(f"data: {chats.DONE}"))
    return chats.assembled(chats.stream_chunks(lines.unionByName(ends), "conv_id", "turn", "line"), "conv_id", "turn")


@query(f"""WITH {REQUESTS}, o AS (SELECT run_index, row_number() OVER w AS seq, avg(CASE WHEN status = 'errored' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY run_index ORDER BY end_us, request_id ROWS 19 PRECEDING) AS rate FROM requests WINDOW w AS (PARTITION BY run_index ORDER BY end_us, request_id))
SELECT run_index, 'max_error_rate' AS name, min(seq) AS seq FROM o WHERE rate >= 0.3 AND seq >= 20 GROUP BY 1""")
def error_rate_trigger(spark: SparkSession, d: str) -> DataFrame:
    return constraints.first_triggers(rq.requests(spark, d), max_error_rate=(0.3, 20))


@query(f"""WITH {REQUESTS}, b AS (SELECT conversation_id, bool_or(status = 'errored') AS bad FROM requests GROUP BY 1)
SELECT request_id, bad AND status <> 'successful' AS cancelled FROM requests JOIN b USING (conversation_id)""")
def graph_abort(spark: SparkSession, d: str) -> DataFrame:
    r = rq.requests(spark, d).withColumn("status", F.when(F.col("status") == "successful", "completed").otherwise(F.col("status")))
    return graphs.aborted(r, "conversation_id").select("request_id", "cancelled")
