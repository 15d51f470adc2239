"""Conversation graphs with branches and merges: levels, turn indices, histories, aborts, tool turns.

A node has at most one parent whose full history it takes over, so these edges form chains; they are
followed by doubling, in as many joins as the logarithm of the longest chain.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import settle


def ancestry(edges: DataFrame, key: str) -> DataFrame:
    """(key, node, ancestor, distance) along edges of full history; a node is not its own ancestor.

    A chain that returns to its start ends the query with an error.
    """
    step = settle(edges.where("history = 'full'").select(key, F.col("target").alias("node"), F.col("source").alias("ancestor"), F.lit(1).cast("bigint").alias("distance")))
    reach = step
    while not step.isEmpty():
        if not reach.where("node = ancestor").isEmpty():
            raise ValueError("a conversation graph has a cycle")
        onward = step.select(key, F.col("node").alias("ancestor"), F.col("ancestor").alias("_far"), F.col("distance").alias("_more"))
        grown = reach.join(onward, [key, "ancestor"]).select(key, "node", F.col("_far").alias("ancestor"), (F.col("distance") + F.col("_more")).alias("distance"))
        reach = settle(reach.unionByName(grown))
        far = step.join(onward, [key, "ancestor"])
        step = settle(far.select(key, "node", F.col("_far").alias("ancestor"), (F.col("distance") + F.col("_more")).alias("distance")))
    return reach


def beginnings(nodes: DataFrame, edges: DataFrame, key: str, node: str) -> DataFrame:
    """(key, node, first, distance): where the chain of full history that leads to a node begins, and how many turns before.

    Pointer doubling with a row a node: each round a node whose pointer isn't a beginning takes over its pointer's one.
    A chain that returns to its start ends the query with an error.
    """
    up = edges.where("history = 'full'").select(key, F.col("target").alias("node"), F.col("source").alias("_up"))
    every = nodes.select(key, F.col(node).alias("node")).unionByName(up.select(key, F.col("_up").alias("node"))).distinct()
    x = every.join(up, [key, "node"], "left").select(key, "node", F.coalesce("_up", "node").alias("first"), F.col("_up").isNotNull().alias("_open")).withColumn("distance", F.col("_open").cast("bigint"))
    x = settle(x)
    most = every.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(most.bit_length() + 1):
        left = x.where("_open")
        if left.isEmpty():
            return x.drop("_open")
        onward = x.select(key, F.col("node").alias("first"), F.col("first").alias("_far"), F.col("distance").alias("_more"), F.col("_open").alias("_further"))
        grown = left.drop("_open").join(onward, [key, "first"]).select(key, "node", F.col("_far").alias("first"), F.col("_further").alias("_open"), (F.col("distance") + F.col("_more")).alias("distance"))
        x = settle(x.where("not _open").unionByName(grown))
    raise ValueError("a conversation graph has a cycle")


def turn_indices(nodes: DataFrame, edges: DataFrame, key: str, node: str) -> DataFrame:
    """(key, node, turn_index): 0 without history, 1 after a last response, else one more than the turn of the full history.

    So it is the distance from the beginning of the chain, and one more where a last response led to that one;
    one that led to a later turn changes nothing, as the chain counts for more.
    """
    led = edges.where("history = 'last'").select(key, F.col("target").alias("first")).distinct().withColumn("_base", F.lit(1))
    x = beginnings(nodes, edges, key, node).join(led, [key, "first"], "left")
    x = x.select(key, F.col("node").alias(node), (F.col("distance") + F.coalesce("_base", F.lit(0))).alias("turn_index"))
    return nodes.select(key, node).distinct().join(x, [key, node])


def histories(nodes: DataFrame, edges: DataFrame, key: str, node: str) -> DataFrame:
    """(key, node, history): the chain of full history, oldest first, then last responses led into the chain, then into the node."""
    reach = ancestry(edges, key)
    own = nodes.select(key, F.col(node).alias("node"), F.col(node).alias("ancestor"), F.lit(0).cast("bigint").alias("distance"))
    last = edges.where("history = 'last'").select(key, F.col("target").alias("ancestor"), F.col("source").alias("_said"))
    chain = reach.select(key, "node", F.struct(F.lit(0).alias("part"), (-F.col("distance")).alias("at"), F.col("ancestor").alias("said")).alias("h"))
    merged = own.unionByName(reach).join(last, [key, "ancestor"]).select(key, "node", F.struct(F.lit(1).alias("part"), (-F.col("distance")).alias("at"), F.col("_said").alias("said")).alias("h"))
    found = chain.unionByName(merged).groupBy(key, F.col("node").alias(node)).agg(F.transform(F.array_sort(F.collect_list("h")), lambda h: h["said"]).alias("history"))
    return nodes.select(key, node).join(found, [key, node], "left").withColumn("history", F.coalesce("history", F.array().cast(found.schema["history"].dataType)))


def levels_by_joins(nodes: DataFrame, edges: DataFrame, key: str, node: str) -> DataFrame:
    """Levels of graphs of any size, by one join a level."""
    left = settle(nodes.select(key, F.col(node).alias("node")).distinct())
    open_, done, level = edges.select(key, "source", F.col("target").alias("node")), None, 0
    while not left.isEmpty():
        ready = settle(left.join(open_.select(key, "node").distinct(), [key, "node"], "left_anti"))
        if ready.isEmpty():
            raise ValueError("a conversation graph has a cycle")
        now = ready.select(key, F.col("node").alias(node), F.lit(level).cast("bigint").alias("level"))
        done = now if done is None else done.unionByName(now)
        left = settle(left.join(ready, [key, "node"], "left_anti"))
        open_ = settle(open_.join(ready.withColumnRenamed("node", "source"), [key, "source"], "left_anti"))
        level += 1
    return done if done is not None else nodes.select(key, node, F.lit(0).cast("bigint").alias("level"))


def levels(nodes: DataFrame, edges: DataFrame, key: str, node: str, most: int = 100_000) -> DataFrame:
    """(key, node, level): the longest way from a root over edges of any kind; nodes by level, then in order, stand topologically.

    Graphs of up to `most` nodes and edges are walked each in one task, in one job for all of them, however deep; larger
    ones by one join a level. A graph with a cycle ends the query with an error.
    """
    spots, lines = nodes.select(key, F.col(node).alias("node")).distinct(), edges.select(key, "source", F.col("target").alias("node"))
    sizes = spots.select(key).unionByName(lines.select(key)).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    large = settle(sizes.where(F.col("n") > most).select(key))

    def walk(k: tuple, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        names = pd.Index(n["node"])
        a, b = names.get_indexer(e["source"]), names.get_indexer(e["node"])
        a, b = a[b >= 0], b[b >= 0]
        lost = (a < 0).any()  # what isn't among the nodes never comes, and its followers wait for ever
        a, b = a[a >= 0], b[a >= 0]
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        begin, end = np.searchsorted(a, np.arange(len(names))), np.searchsorted(a, np.arange(len(names)), "right")
        waits, level = np.bincount(b, minlength=len(names)), np.zeros(len(names), np.int64)
        ready, seen = np.flatnonzero(waits == 0).tolist(), 0
        while ready:
            x = ready.pop()
            seen += 1
            for y in b[begin[x] : end[x]].tolist():
                level[y] = max(level[y], level[x] + 1)
                waits[y] -= 1
                if not waits[y]:
                    ready.append(y)
        return pd.DataFrame({key: n[key], node: n["node"], "level": -1 if lost or seen < len(names) else level})

    kinds = ", ".join(f"`{name}` {nodes.schema[name].dataType.simpleString()}" for name in (key, node))
    small_spots, small_lines = (x.join(large, key, "left_anti") for x in (spots, lines))
    small_spots, small_lines = small_spots.toDF(*small_spots.columns), small_lines.toDF(*small_lines.columns)
    done = settle(small_spots.groupBy(key).cogroup(small_lines.groupBy(key)).applyInPandas(walk, f"{kinds}, level bigint"))
    if done.where("level < 0").head(1):
        raise ValueError("a conversation graph has a cycle")
    if large.isEmpty():
        return done
    return done.unionByName(levels_by_joins(nodes.join(large, key, "left_semi"), edges.join(large, key, "left_semi"), key, node))


def aborted(turns: DataFrame, key: str, status: str = "status") -> DataFrame:
    """Adds `cancelled`: turns that have not completed in a graph where one failed or was cancelled."""
    bad = turns.groupBy(key).agg(F.max(F.col(status).isin("errored", "cancelled")).alias("_bad"))
    return turns.join(bad, key).withColumn("cancelled", F.col("_bad") & (F.col(status) != "completed")).drop("_bad")


def expand_tools(turns: DataFrame, edges: DataFrame, key: str, node: str, tool: str = "is_tool") -> tuple[DataFrame, DataFrame]:
    """(turns, edges) where every tool turn is followed by a turn `<node>_injection`; what followed it follows that one.

    The tool response, the output tokens and the settings move to the injected turn, where turns have these columns.
    """
    moved = [c for c in ("tool_response", "output_tokens", "relative_timestamp", "requeue_delay") if c in turns.columns]
    is_tool, name = F.coalesce(F.col(tool), F.lit(False)), F.concat(F.col(node), F.lit("_injection"))
    call = turns.withColumns({c: F.when(~is_tool, F.col(c)) for c in moved} | {"injected": F.lit(False)})
    kept = {key, node, *moved}
    inject = turns.where(is_tool).select(*(F.col(c) if c in kept and c != node else (name if c == node else F.lit(None).cast(turns.schema[c].dataType)).alias(c) for c in turns.columns), F.lit(True).alias("injected"))
    ends = turns.where(is_tool).select(key, F.col(node).alias("source"), name.alias("_end"))
    after = edges.join(ends, [key, "source"], "left").select(key, F.coalesce("_end", "source").alias("source"), "target", "history")
    own = ends.select(key, "source", F.col("_end").alias("target"), F.lit("full").alias("history"))
    return call.unionByName(inject), after.unionByName(own)


def branches(spark, graphs: int, turns: int, forks: list[tuple[int, int, int | None]]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of `graphs` conversations of a main chain and forks (at turn, turns, merge after how many, or none)."""
    for at, n, merge in forks:
        if not 0 <= at < turns or n < 1 or (merge is not None and not at < at + merge < turns):
            raise ValueError("a fork stands outside the conversation")
    nodes, edges = [f"main_{i}" for i in range(turns)], [(f"main_{i}", f"main_{i + 1}", "full") for i in range(turns - 1)]
    for b, (at, n, merge) in enumerate(forks):
        mine = [f"branch_{b}_{i}" for i in range(n)]
        nodes += mine
        edges += [(f"main_{at}", mine[0], "new"), *((x, y, "full") for x, y in zip(mine, mine[1:], strict=False))]
        if merge is not None:
            edges.append((mine[-1], f"main_{at + merge}", "last"))
    ids = spark.range(graphs).withColumnRenamed("id", "graph_id")
    lit = lambda e: F.struct(*(F.lit(x).alias(n) for x, n in zip(e, ("source", "target", "history"), strict=True)))
    none = F.array().cast("array<struct<source:string,target:string,history:string>>")
    return ids.withColumn("node", F.explode(F.array(*map(F.lit, nodes)))), ids.withColumn("e", F.explode(F.array(*map(lit, edges)) if edges else none)).select("graph_id", "e.*")
