"""Conversations as graphs of turns: messages, linear chains, order, history, readiness, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import total_or_null

#: Role names of the two message formats.
USER, SYSTEM = ("user", "human"), ("system",)


def extract_messages(messages: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, text, prefix): user texts and system texts of each conversation, joined by a space; null where there is none."""
    some = messages.where(F.length(text) > 0)
    def joined(roles):  # noqa: E306
        rows = F.array_sort(F.collect_list(F.when(F.lower(role).isin(*roles), F.struct(order, text))))
        return F.nullif(F.array_join(F.transform(rows, lambda m: m[text]), " "), F.lit(""))

    return some.groupBy(key).agg(joined(USER).alias("text"), joined(SYSTEM).alias("prefix"))


def pivot_turns(rows: DataFrame, key: str, turn: str, values: str) -> DataFrame:
    """(key, i, values): of arrays by turn, the i-th items of all turns that have one, in turn order."""
    x = rows.select(key, turn, F.posexplode(values).alias("i", "v")).where("v is not null")
    x = x.groupBy(key, "i").agg(F.array_sort(F.collect_list(F.struct(turn, "v"))).alias("p"))
    return x.select(key, "i", F.transform("p", lambda s: s["v"]).alias(values))


def linear_edges(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, source, target, history): each turn follows the one before it with full history."""
    w = Window.partitionBy(key).orderBy(order)
    x = turns.select(key, F.lag(order).over(w).alias("source"), F.col(order).alias("target"))
    return x.where("source is not null").withColumn("history", F.lit("full"))


def roots(nodes: DataFrame, edges: DataFrame, key: str, node: str) -> DataFrame:
    """Nodes that no edge leads to."""
    return nodes.join(edges.select(key, F.col("target").alias(node)).distinct(), [key, node], "left_anti")


def dangling(nodes: DataFrame, edges: DataFrame, key: str, node: str) -> DataFrame:
    """Edges with an end that is no node."""
    known = nodes.select(key, node).distinct()
    ends = [edges.join(known.withColumnRenamed(node, c), [key, c], "left_anti").select(*edges.columns) for c in ("source", "target")]
    return ends[0].unionByName(ends[1]).distinct()


def crowded(edges: DataFrame, key: str) -> DataFrame:
    """Nodes with more than one edge of full history leading in."""
    return edges.where("history = 'full'").groupBy(key, "target").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def subgraph(edges: DataFrame, kept: DataFrame, key: str, node: str) -> DataFrame:
    """Edges with both ends among the kept nodes."""
    k = kept.select(key, node).distinct()
    for c in ("source", "target"):
        edges = edges.join(k.withColumnRenamed(node, c), [key, c], "left_semi")
    return edges


def turn_index(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, node, turn_index, history_len) of linear chains: how many turns stand before each."""
    w = Window.partitionBy(key).orderBy(order)
    n = F.row_number().over(w) - 1
    return turns.select(key, F.col(order).alias("node"), n.cast("bigint").alias("turn_index"), n.cast("bigint").alias("history_len"))


def readiness(edges: DataFrame, done: DataFrame, key: str, node: str, end: str, delay: str) -> DataFrame:
    """(key, node, ready_at): a node is ready when its last parent has ended and that parent's delay is over."""
    p = edges.join(done.select(key, F.col(node).alias("source"), end, delay), [key, "source"])
    last = p.groupBy(key, F.col("target").alias(node)).agg(F.max_by(F.struct(end, delay), F.struct(end, "source")).alias("m"))
    return last.select(key, node, (F.col(f"m.{end}") + F.coalesce(F.col(f"m.{delay}"), F.lit(0))).alias("ready_at"))


def zip_rows(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """Rows of both by their place in order; ends with the shorter. Places come from counts of ranges, not one task."""
    return place(left, left_order).join(place(right, right_order), "i")


def place(df: DataFrame, order: str) -> DataFrame:
    """df with its row's number i, from 0, in the order of a unique number."""
    from .ordered import running_sum

    x = running_sum(df.withColumns({"_k": F.lit(0), "_one": F.lit(1)}), ["_k"], order, {"i": "_one"})
    return x.withColumn("i", (F.col("i") - 1).cast("bigint")).drop("_k", "_one")


def merged_usage(request: Column, response: Column, prefer_response: bool = True) -> Column:
    """The preferred count where it is there, else the other's."""
    return F.coalesce(response, request) if prefer_response else F.coalesce(request, response)


def usage_total(*parts: Column) -> Column:
    """Text, image, video and audio tokens together; null only if all are."""
    return total_or_null(*parts)


def check_graph(nodes: DataFrame, edges: DataFrame, key: str, node: str) -> DataFrame:
    """The edges, if every end is a node, no node takes over two full histories and no chain returns to its start; else an error."""
    from .graphs import levels

    for found, what in ((dangling(nodes, edges, key, node), "an edge leads to no node"), (crowded(edges, key), "a node has two edges of full history")):
        if found.head(1):
            raise ValueError(f"{what}: {found.head(1)[0].asDict()}")
    levels(nodes, edges, key, node)
    return edges


def built_edges(nodes: DataFrame, key: str, node: str, parents: str, history: str = "full") -> DataFrame:
    """(key, source, target, history) of nodes with their parents' names, checked."""
    edges = nodes.select(key, F.explode(parents).alias("source"), F.col(node).alias("target"), F.lit(history).alias("history"))
    return check_graph(nodes, edges, key, node)
