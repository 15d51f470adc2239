"""Workload queries: column mapping, finalising turns, preprocessing, limits and shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import chats, conversations, mapping, schedule
from ..operators import preprocess as pp
from .datasets import WORDS, table
from .telemetry import query_into

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = query_into(QUERIES, SQL)


@query("""SELECT doc_id, 0 AS turn, 'text_column' AS kind, text AS value FROM documents UNION ALL SELECT doc_id, 0, 'prefix_column', source FROM documents
UNION ALL SELECT doc_id, 1, 'text_column', lang FROM documents""")
def column_map(spark: SparkSession, d: str) -> DataFrame:
    """Names in the plural, in capitals, with turns; the first alias in the order of columns wins."""
    x = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("length"), F.col("text").alias("Prompts"), F.col("lang").alias("prompts_1"), F.col("source").alias("system"), F.col("lang").alias("question"))
    m = mapping.map_columns(x).select("doc_id", F.posexplode("turns").alias("turn", "t"))
    kinds = ("text_column", "prefix_column")
    return m.select("doc_id", "turn", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"t.{k}").alias("v")) for k in kinds))).alias("c")).where("c.v is not null").select("doc_id", "turn", "c.kind", F.explode("c.v").alias("value"))


@query("SELECT conv_id, nullif(sum(length(text)) FILTER (turn % 2 = 1), 0) AS input_tokens, nullif(sum(0), 0) AS output_tokens FROM conversations GROUP BY conv_id")
def token_sums(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.when(F.col("turn") % 2 == 1, F.length("text")).alias("n"))).alias("c"), F.collect_list(F.lit(0)).alias("zeros"))
    return c.select("conv_id", mapping.token_sum(F.col("c.n")).alias("input_tokens"), mapping.token_sum(F.col("zeros")).alias("output_tokens"))


@query("""SELECT l_orderkey, sum(CASE WHEN l_linenumber > 1 THEN CAST(l_quantity AS BIGINT) END) AS image_pixels, sum(CASE WHEN l_linenumber > 9 THEN 1 END) AS image_bytes,
  round(CAST(sum(CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_discount AS DOUBLE) END) AS DOUBLE), 6) AS audio_seconds FROM lineitem GROUP BY 1""")
def media_sums(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    image = F.struct(F.when(n > 1, F.col("l_quantity").cast("bigint")).alias("image_pixels"), F.when(n > 9, 1).alias("image_bytes"))
    audio = F.struct(F.when(n % 2 == 0, F.col("l_discount").cast("double")).alias("audio_seconds"))
    x = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(image).alias("image_column"), F.collect_list(audio).alias("audio_column"))
    return mapping.media_sums(x).select("l_orderkey", "image_pixels", "image_bytes", F.round("audio_seconds", 6).alias("audio_seconds"))


TURNS = "turns AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN 'server_tool_call' END AS named, turn % 3 = 0 AS tooled, length(text) AS n FROM conversations)"


@query(f"""WITH {TURNS} SELECT conv_id, turn, coalesce(named, CASE WHEN tooled THEN 'server_tool_call' ELSE 'standard' END) AS turn_type, nullif(n, 0) AS input_tokens, turn / 2.0 AS relative_timestamp,
  tooled AND coalesce(named, CASE WHEN tooled THEN 'server_tool_call' END) IS DISTINCT FROM 'server_tool_call' AS has_tools FROM turns""")
def finalised_turns(spark: SparkSession, d: str) -> DataFrame:
    """Explicit type, then tools, then standard; settings lifted out; tools on the server leave the columns."""
    n = F.col("turn")
    x = table(spark, d, "conversations").select(
        "conv_id", "turn", F.array(F.when(n % 5 == 0, "server_tool_call")).alias("turn_type_column"), F.when(n % 3 == 0, F.array(F.lit("{}"))).alias("tools_column"),
        F.array(F.length("text").cast("bigint")).alias("prompt_tokens_count_column"), F.array((n / 2).cast("double")).alias("relative_timestamp_column"),
    )
    out = mapping.finalise(x, "server")
    return out.select("conv_id", "turn", "turn_type", "input_tokens", F.col("settings.relative_timestamp").alias("relative_timestamp"), F.col("tools_column").isNotNull().alias("has_tools"))


@query("""WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS texts FROM conversations GROUP BY 1)
SELECT conv_id, 'root' AS node_id, 'x' AS parent, 'given' AS text FROM c WHERE conv_id % 4 = 0
UNION ALL SELECT conv_id, 'turn_' || (i - 1), CASE WHEN i > 1 THEN 'turn_' || (i - 2) END, texts[i] FROM c, range(1, 100) r(i) WHERE conv_id % 4 <> 0 AND i <= len(texts)""")
def graph_payload(spark: SparkSession, d: str) -> DataFrame:
    """A graph in JSON wins, an empty one doesn't; else a chain over the texts."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text")))["text"].alias("texts"))
    given = F.when(F.col("conv_id") % 4 == 0, '{"turns": [{"node_id": "root", "parents": ["x"], "text": "given"}]}').when(F.col("conv_id") % 4 == 1, '{"turns": []}')
    x = mapping.graph_turns(c.withColumn("payload", given), "payload", "texts").select("conv_id", F.explode("nodes").alias("n"))
    return x.select("conv_id", "n.node_id", F.try_element_at("n.parents", F.lit(1)).alias("parent"), "n.text")


TARGET = "20 + doc_id % 50"
PREPARED = f"""src AS (SELECT doc_id, {WORDS} AS w, [source] AS p, {TARGET} AS target FROM documents),
adj AS (SELECT *, target - len(p) AS room FROM src), ok AS (SELECT * FROM adj WHERE room > 0 AND len(w) >= room)"""


@query(f"WITH {PREPARED} SELECT doc_id, array_to_string(list_slice(w, 1, room), ' ') AS prompt, array_to_string(p, ' ') AS prefix, room AS prompt_tokens_count, 7 + doc_id % 9 AS output_tokens_count FROM ok")
def preprocess_driver(spark: SparkSession, d: str) -> DataFrame:
    """Columns chosen by the mapper, prefix words counted towards the target, short prompts dropped, long ones cut."""
    x = table(spark, d, "documents").select("doc_id", "text", F.col("source").alias("prefix"), (7 + F.col("doc_id") % 9).alias("output_tokens_count"))
    out = pp.prepare(x, F.lit(20) + F.col("doc_id") % 50, F.col("output_tokens_count"), short="ignore", most_prefix=1, count_prefix=True)
    return out.select("doc_id", "prompt", "prefix", "prompt_tokens_count", "output_tokens_count")


@query("""WITH RECURSIVE d AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, text, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n FROM conversations),
walk AS (SELECT conv_id, i, i AS first, text, n FROM d WHERE i = 1
  UNION ALL SELECT d.conv_id, d.i, CASE WHEN w.n >= 60 THEN d.i ELSE w.first END, CASE WHEN w.n >= 60 THEN d.text ELSE w.text || ' ' || d.text END, CASE WHEN w.n >= 60 THEN d.n ELSE w.n + d.n END FROM walk w JOIN d ON d.conv_id = w.conv_id AND d.i = w.i + 1)
SELECT conv_id, first - 1 AS first, text AS prompt, n AS prompt_tokens FROM walk WHERE n >= 60""")
def preprocess_concatenate(spark: SparkSession, d: str) -> DataFrame:
    """Short prompts take the prompts after them until they are long enough; what is left at the end goes."""
    return pp.concatenate(table(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit(""))), ["conv_id"], "turn", "text", 60)


@query("""WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS i, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n FROM conversations),
walk AS (SELECT i, i AS first, text, n FROM d WHERE i = 1
  UNION ALL SELECT d.i, CASE WHEN w.n >= 200 THEN d.i ELSE w.first END, CASE WHEN w.n >= 200 THEN d.text ELSE w.text || ' ' || d.text END, CASE WHEN w.n >= 200 THEN d.n ELSE w.n + d.n END FROM walk w JOIN d ON d.i = w.i + 1)
SELECT first - 1 AS first, text AS prompt, n AS prompt_tokens FROM walk WHERE n >= 200""")
def concatenated_table(spark: SparkSession, d: str) -> DataFrame:
    """The whole table as one sequence, without a key."""
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("place"), F.coalesce("text", F.lit("")).alias("text"))
    return pp.concatenate(c, [], "place", "text", 200)


@query(f"SELECT doc_id FROM (SELECT doc_id FROM documents WHERE len({WORDS}) >= 30 ORDER BY doc_id LIMIT 50)")
def accepted_rows(spark: SparkSession, d: str) -> DataFrame:
    """The cap counts rows that preprocessing accepts."""
    return pp.first_rows(pp.ignore_short(table(spark, d, "documents"), "text", 30), 50, "doc_id").select("doc_id")


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1 + 2) % 4 AS shard FROM documents")
def modulo_shards(spark: SparkSession, d: str) -> DataFrame:
    return pp.shards(table(spark, d, "documents"), 4, "doc_id", shift=2).select("doc_id", "shard")


@query("SELECT doc_id, CASE WHEN n_chars % 7 = 0 THEN NULL ELSE 1000 // (n_chars % 7) END AS v FROM documents WHERE n_chars % 7 <> 0")
def row_errors(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose transformation fails go."""
    x = table(spark, d, "documents").withColumn("v", F.try_divide(F.lit(1000), F.col("n_chars") % 7).cast("bigint"))
    return pp.without_failures(x, "v").select("doc_id", "v")


@query("SELECT doc_id, text FROM (SELECT doc_id, text, md5(CAST(doc_id AS VARCHAR) || ':7') AS h FROM documents) ORDER BY h LIMIT 5")
def sampled_prompts(spark: SparkSession, d: str) -> DataFrame:
    return pp.sample_rows(table(spark, d, "documents"), 5, "doc_id", seed=7).select("doc_id", "text")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders")
def sorted_trace(spark: SparkSession, d: str) -> DataFrame:
    """A trace in order of conversation and time."""
    from ..sources.readers import sorted_rows

    x = sorted_rows(table(spark, d, "orders"), "o_orderdate", ["o_custkey"], ties=("o_orderkey",))
    return x.select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("place"))


KIND_SQL = "CASE turn % 3 WHEN 0 THEN 'standard' WHEN 1 THEN 'client_tool_call' ELSE 'tool_response_injection' END"


@query(f"SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN CASE WHEN {KIND_SQL} = 'client_tool_call' THEN 'required' ELSE 'none' END END AS tool_choice, CASE WHEN turn % 2 = 1 AND turn % 3 = 1 THEN 2 ELSE 0 END AS removed FROM conversations")
def tool_overrides(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "conversations").select("conv_id", "turn", F.expr(KIND_SQL).alias("kind"), F.when(F.col("turn") % 2 == 1, '[{"name": "f"}]').otherwise("[]").alias("tools"))
    return chats.tool_overrides(x, "tools", "kind").select("conv_id", "turn", "tool_choice", F.size("removed").alias("removed"))


@query("""SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END, 7) AS input_tokens, coalesce(CASE WHEN o_orderkey % 4 = 0 THEN 5 END, CASE WHEN o_orderstatus = 'F' THEN 9 END) AS output_tokens,
  coalesce(CASE WHEN o_orderstatus = 'F' AND o_orderkey % 7 = 0 THEN 2 END, CASE WHEN o_orderkey % 2 = 0 THEN 0 END) AS output_tool_call_count FROM orders""")
def compiled_usage(spark: SparkSession, d: str) -> DataFrame:
    k, done = F.col("o_orderkey"), F.col("o_orderstatus") == "F"
    x = table(spark, d, "orders").select(
        "o_orderkey", F.when(done, "completed").otherwise("errored").alias("status"), F.when(k % 2 == 0, "client_tool_call").otherwise("standard").alias("turn_type"), F.lit(7).alias("request_input_tokens"), F.when(k % 3 == 0, F.col("o_custkey")).alias("response_input_tokens"),
        F.lit(9).alias("request_output_tokens"), F.when(k % 4 == 0, 5).alias("response_output_tokens"), F.when(k % 7 == 0, 2).alias("request_output_tool_call_count"), F.lit(None).cast("int").alias("response_output_tool_call_count"),
    )
    names = ["input_tokens", "output_tokens", "output_tool_call_count"]
    return chats.compiled_usage(x, names).select("o_orderkey", *names)


@query("""SELECT conv_id, string_agg(CASE WHEN role = 'system' THEN text END, ' ' ORDER BY turn) AS instructions, coalesce(string_agg(CASE role WHEN 'user' THEN 'input_text:' || text WHEN 'assistant' THEN 'output_text:' || text END, '|' ORDER BY turn), '') AS items
FROM conversations WHERE length(text) > 0 GROUP BY 1""")
def input_items(spark: SparkSession, d: str) -> DataFrame:
    said = lambda role: F.when(F.col("role") == role, F.col("text"))
    c = table(spark, d, "conversations").where(F.length("text") > 0).select("conv_id", "turn", said("system").alias("p"), said("user").alias("u"), said("assistant").alias("a"))
    x = chats.input_items(c, "conv_id", "turn", "p", "u", "a")
    return x.select("conv_id", "instructions", F.array_join(F.transform("items", lambda i: F.concat(i["type"], F.lit(":"), i["text"])), "|").alias("items"))


@query("WITH l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2) SELECT l_orderkey, string_agg('f' || l_linenumber || '(' || p || s || ')', ',' ORDER BY l_linenumber) AS calls FROM l GROUP BY 1")
def stream_tool_calls(spark: SparkSession, d: str) -> DataFrame:
    """Two chunks a call, the second with the rest of its arguments; calls of a stream are interleaved."""
    x = table(spark, d, "lineitem").where("l_linenumber <= 3").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    first = lambda args: F.struct(F.col("l_linenumber").cast("int").alias("index"), F.struct(F.when(F.lit(args == "l_partkey"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string"))).alias("name"), F.col(args).cast("string").alias("arguments")).alias("function"))
    body = lambda args: F.to_json(F.struct(F.array(F.struct(F.struct(F.array(first(args)).alias("tool_calls")).alias("delta"))).alias("choices")))
    chunks = x.select("l_orderkey", F.col("l_linenumber").alias("t"), body("l_partkey").alias("data")).unionByName(x.select("l_orderkey", (10 + F.col("l_linenumber")).alias("t"), body("l_suppkey").alias("data")))
    calls = chats.assembled_calls(chunks, "l_orderkey", "t")
    return calls.select("l_orderkey", F.array_join(F.transform("calls", lambda c: F.concat(c["name"], F.lit("("), c["arguments"], F.lit(")"))), ",").alias("calls"))


@query("""WITH c AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS source FROM conversations) SELECT conv_id, source, turn AS target FROM c WHERE source IS NOT NULL""")
def built_edges(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn")
    linear = conversations.linear_edges(table(spark, d, "conversations")).select("conv_id", F.col("target").alias("turn"), F.col("source").alias("p"))
    nodes = c.join(linear, ["conv_id", "turn"], "left").select("conv_id", "turn", F.array_compact(F.array("p")).alias("parents"))
    return conversations.built_edges(nodes, "conv_id", "turn", "parents").select("conv_id", "source", "target")


@query("SELECT n_nationkey AS k, n_regionkey = 3 AS stop_all FROM nation WHERE n_nationkey <= (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 3)")
def escalated_runs(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_regionkey") == 3).alias("stop_all"))
    return schedule.escalated(n, "k", "stop_all")


@query("""WITH o AS (SELECT o_custkey AS c, o_orderkey AS request_id, epoch_us(o_orderdate) AS t, 1000 + o_orderkey % 97 AS latency_us, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) % 3 AS stream FROM orders)
SELECT request_id, stream, round(6.0 * stream / 3 + coalesce(sum(latency_us) OVER (PARTITION BY c, stream ORDER BY t, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 1e6, 6) AS offset_s FROM o""")
def closed_loop(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("request_id"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("start_us"), (1000 + F.col("o_orderkey") % 97).alias("latency_us"))
    return schedule.streams(o, 3, ["c"], ramp=6.0).select("request_id", "stream", F.round("offset_s", 6).alias("offset_s"))
