"""Requests and responses of chat services: bodies from turns, streamed lines back to texts, reported usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a tool turn answers where the data has no response, and how a stream ends.
NO_RESPONSE, DONE = '{"status": "ok"}', "[DONE]"


def completions_prompt(turns: DataFrame, key: str, order: str, prefix: str, text: str, response: str) -> DataFrame:
    """(key, order, prompt): of all earlier turns prefix, text and response, then this turn's prefix and text, joined by spaces.

    The prompt of every turn holds its history, so the result grows with the square of a conversation's turns, as the requests do.
    """
    said = turns.select(key, F.col(order).alias("_t"), F.concat_ws(" ", prefix, text).alias("_own"), F.concat_ws(" ", prefix, text, response).alias("_all"))
    past = said.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_t", "_own", "_all"))).alias("_h"))
    x = past.select(key, "_h", F.posexplode("_h").alias("_i", "_now"))
    before = F.transform(F.slice("_h", 1, F.col("_i")), lambda h: h["_all"])
    parts = F.filter(F.concat(before, F.array("_now._own")), lambda p: p != "")
    return x.select(key, F.col("_now._t").alias(order), F.array_join(parts, " ").alias("prompt"))


def round_robin(parts: dict[str, Column]) -> Column:
    """Items of arrays of strings in turn: the first of each, then the second of each; structs of (kind, value)."""
    def tag(rank: int, kind: str):
        return lambda v, i: F.struct(i.alias("at"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), v.cast("string").alias("value"))

    tagged = [F.transform(c, tag(n, k)) for n, (k, c) in enumerate(parts.items())]
    some = [F.coalesce(t, F.array().cast("array<struct<at:int,rank:int,kind:string,value:string>>")) for t in tagged]
    return F.transform(F.array_sort(F.concat(*some)), lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value")))


def messages(turns: DataFrame, key: str, order: str, prefix: str, text: str, response: str) -> DataFrame:
    """(key, messages): system, user and assistant messages in turn order; a turn without a response ends with the user."""
    one = lambda role, c: F.when(F.length(c) > 0, F.struct(F.lit(role).alias("role"), F.col(c).alias("content")))
    t = turns.select(key, F.struct(F.col(order).alias("t"), F.array_compact(F.array(one("system", prefix), one("user", text), one("assistant", response))).alias("m")).alias("_m"))
    return t.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list("_m")), lambda m: m["m"])).alias("messages"))


def tool_messages(calls: Column, responses: Column, default: str = NO_RESPONSE) -> Column:
    """One answer for each call, in order: the response at its place, else the default."""
    return F.transform(calls, lambda c, i: F.struct(c.alias("call"), F.coalesce(F.get(responses, i), F.lit(default)).alias("content")))


def turn_type(explicit: Column, tools: Column, server_side: bool = False) -> Column:
    """The stated kind of a turn, else a tool call where it has tools, else standard."""
    return F.coalesce(explicit, F.when(tools.isNotNull(), F.lit("server_tool_call" if server_side else "client_tool_call")), F.lit("standard"))


def embedding_input(texts: Column) -> Column:
    """JSON of the input: one text bare, several as a list."""
    return F.when(F.size(texts) == 1, F.to_json(F.struct(F.get(texts, 0).alias("input")))).otherwise(F.to_json(F.struct(texts.alias("input"))))


def stream_chunks(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """(key, order, data): JSON of `data:` lines before the end of a stream; blank and other lines are left out."""
    data = F.trim(F.regexp_extract(line, r"^data:(.*)$", 1))
    x = lines.select(key, F.col(order), data.alias("data")).where("data <> ''")
    end = x.where(F.col("data") == DONE).groupBy(key).agg(F.min(order).alias("_end"))
    return x.join(end, key, "left").where(F.col("_end").isNull() | (F.col(order) < F.col("_end"))).select(key, order, "data")


def assembled(chunks: DataFrame, key: str, order: str, data: str = "data") -> DataFrame:
    """(key, text, n_chunks): the deltas of a stream in order, joined."""
    delta = F.coalesce(F.get_json_object(data, "$.choices[0].delta.content"), F.get_json_object(data, "$.choices[0].text"))
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(delta, F.lit("")).alias("d"))))
    return chunks.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r["d"]), "").alias("text"), F.count(F.lit(1)).alias("n_chunks"))


def usage(body: str, side: str) -> Column:
    """Tokens that a response's JSON reports for `prompt` or `completion`: the details' text tokens, else the total; null where there are none or 0."""
    n = lambda path: F.nullif(F.get_json_object(body, f"$.usage.{path}").cast("bigint"), F.lit(0))
    return F.coalesce(n(f"{side}_tokens_details.text_tokens"), n(f"{side}_tokens"))


def tool_tokens(text: Column, calls: Column, tokens: Column) -> dict[str, Column]:
    """Tokens of responses that only call tools, and of those that speak besides."""
    called, spoke = F.coalesce(calls, F.lit(0)) > 0, F.length(F.coalesce(text, F.lit(""))) > 0
    return {"tool_call_tokens": F.when(called & ~spoke, tokens), "mixed_content_tool_tokens": F.when(called & spoke, tokens)}


def empty_response(text: Column, calls: Column, tokens: Column) -> Column:
    """Whether a response holds no text, no tool call and no token."""
    return (F.length(F.coalesce(text, F.lit(""))) == 0) & (F.coalesce(calls, F.lit(0)) == 0) & (F.coalesce(tokens, F.lit(0)) <= 0)


def tool_overrides(turns: DataFrame, tools: str, kind: str, choice: str | None = None) -> DataFrame:
    """turns with `tool_choice` and the body keys that have to go (`removed`).

    Without tools there is no choice; with them it is the given or `required`, but `none` where a turn is
    standard or follows a tool's answer. A turn that calls a tool must end by itself.
    """
    have = F.size(F.coalesce(F.from_json(tools, "array<string>"), F.array().cast("array<string>"))) > 0
    wanted = F.when(F.col(kind).isin("standard", "tool_response_injection"), "none").otherwise(F.lit(choice or "required"))
    gone = F.when(have & (F.col(kind) == "client_tool_call"), F.array(F.lit("ignore_eos"), F.lit("stop"))).otherwise(F.array().cast("array<string>"))
    return turns.withColumns({"tool_choice": F.when(have, wanted), "removed": gone})


def limits_body(tokens: Column, model: str | None = None, stream: bool = False) -> Column:
    """JSON of a request's settings: model and stream, and with an output count max_tokens, ignore_eos and no stop."""
    parts = {"model": F.lit(model).cast("string")} | ({"stream": F.lit(True), "stream_options": F.struct(F.lit(True).alias("include_usage"), F.lit(True).alias("continuous_usage_stats"))} if stream else {})
    known = tokens > 0
    parts |= {"max_tokens": F.when(known, tokens), "ignore_eos": F.when(known, F.lit(True))}
    return F.to_json(F.struct(*(c.alias(n) for n, c in parts.items())))


def pooling_body(entry: str, model: str | None = None) -> Column:
    """JSON of a pooling request: data and priority of the entry (JSON), where it has them."""
    return F.to_json(F.struct(F.lit(model).cast("string").alias("model"), F.get_json_object(entry, "$.data").alias("data"), F.get_json_object(entry, "$.priority").cast("bigint").alias("priority")))


def input_items(turns: DataFrame, key: str, order: str, prefix: str, text: str, response: str) -> DataFrame:
    """(key, instructions, items): the input of the responses service: all prefixes as instructions, user and assistant texts as typed items."""
    item = lambda role, kind, c: F.when(F.length(c) > 0, F.struct(F.lit(role).alias("role"), F.lit(kind).alias("type"), F.col(c).alias("text")))
    one = F.array_compact(F.array(item("user", "input_text", text), item("assistant", "output_text", response)))
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("t"), F.nullif(F.col(prefix), F.lit("")).alias("p"), one.alias("m"))))
    x = turns.groupBy(key).agg(rows.alias("_r"))
    said = F.array_compact(F.transform("_r", lambda r: r["p"]))
    return x.select(key, F.when(F.size(said) > 0, F.array_join(said, " ")).alias("instructions"), F.flatten(F.transform("_r", lambda r: r["m"])).alias("items"))


def assembled_calls(chunks: DataFrame, key: str, order: str, data: str = "data") -> DataFrame:
    """(key, calls): the tool calls of a stream by their index; names and arguments are joined in the order of the chunks."""
    parsed = F.from_json(F.get_json_object(data, "$.choices[0].delta.tool_calls"), "array<struct<index:int,id:string,function:struct<name:string,arguments:string>>>")
    x = chunks.select(key, F.col(order).alias("o"), F.explode(parsed).alias("c"))
    rows = F.array_sort(F.collect_list(F.struct("o", F.coalesce("c.function.name", F.lit("")).alias("n"), F.coalesce("c.function.arguments", F.lit("")).alias("a"))))
    joined = lambda part: F.array_join(F.transform(rows, lambda r: r[part]), "")
    calls = x.groupBy(key, F.col("c.index").alias("index")).agg(F.min_by("c.id", F.struct(F.col("c.id").isNull(), "o")).alias("id"), joined("n").alias("name"), joined("a").alias("arguments"))
    return calls.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("index", "id", "name", "arguments"))).alias("calls"))


def compiled_usage(r: DataFrame, counters: list[str], status: str = "status", kind: str = "turn_type", prefer_response: bool = True) -> DataFrame:
    """r with one column for each counter from its request_ and response_ columns.

    The preferred one counts where it is there, else the other. A request that didn't complete has no
    output of its own. A turn that was to call a tool counts zero calls where nothing is known.
    """
    out = {}
    for c in counters:
        asked = F.when(F.col(status) == "completed", F.col(f"request_{c}")) if c.startswith("output_") else F.col(f"request_{c}")
        told = F.col(f"response_{c}")
        merged = F.coalesce(told, asked) if prefer_response else F.coalesce(asked, told)
        out[c] = F.coalesce(merged, F.when(F.col(kind) == "client_tool_call", F.lit(0))) if c == "output_tool_call_count" else merged
    return r.withColumns(out)
