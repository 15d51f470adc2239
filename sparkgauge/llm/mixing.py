"""Mixing sources to target weights under a curriculum that changes over training."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, delete, drop, free_name, numbered, scratch, tables_in

WORD = r"[^\x20\x09-\x0D]+"
#: Rows in a range of hashes, on average, beyond the least number of ranges.
ROWS = 4096


def targets(sizes: DataFrame, weights: Callable, share: float, most: float) -> DataFrame:
    """(source, source_size, target) of rows (source, source_size).

    share x all sizes are dealt out by weight; a source stops at most x its size and the excess goes to
    the others by weight until none is above. Solved in closed form: sources fill up in the order of
    cap / weight, so running sums over one row per source find the level at which the budget is spent.
    """
    w = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    s = sizes.withColumn("k", F.row_number().over(w) - 1).withColumn("w", weights(F.col("k"))).withColumn("cap", most * F.col("source_size"))
    s = s.withColumn("total", share * F.sum("source_size").over(Window.partitionBy()))
    fill = Window.orderBy(F.col("cap") / F.col("w"), "k")
    s = s.withColumn("full", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("open", F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    level = (F.col("total") - F.col("full")) / F.col("open")
    s = s.withColumn("level", F.min(F.when(level * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "k", level.alias("level")))).over(Window.partitionBy())["level"])
    return s.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"), "k")


def default_weights(k):
    """Sources in order weigh 3, 1, 2, repeating."""
    return F.element_at(F.array(F.lit(3.0), F.lit(1.0), F.lit(2.0)), (k % 3 + 1).cast("int"))


def default_slope(k):
    """Slope of a source's weight over training: weight(t) = target x (1 + slope x (1 - 2 t)), 0 <= t <= 1."""
    return F.element_at(F.array(F.lit(0.5), F.lit(0.0), F.lit(-0.5)), (k % 3 + 1).cast("int"))


def position(share, slope):
    """Training position t at which a source's cumulative demand t + slope x (t - t**2) reaches share, 0 <= share <= 1."""
    bent = (1 + slope - F.sqrt(F.greatest(F.lit(0.0), (1 + slope) * (1 + slope) - 4 * slope * share))) / (2 * slope)
    return F.when(slope == 0, share).otherwise(bent)


def plan_mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: Callable = default_weights, slope: Callable = default_slope, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, size, source, source_size, target, taken, copies, first_position, second_position.

    Size: words of the text (null: 0). Each source takes all its documents floor(target / source_size)
    times, then once more those whose cumulative size, in an order by a hash of id and text, stays within
    the rest; so taken is 0, 1 or 2 times the size. The room that this leaves goes to the documents behind
    (see `fill`) until none fits. Of those left, the smallest is taken too where that brings its source nearer its target
    than without it, so a source of few documents may go above; what is missing or too much is at most half
    of the smallest document that could still be taken. A copy's position is where the integral of its source's weight
    schedule reaches the words taken before it. Cumulative sizes come from sums over ranges of the hash, whose
    number follows that of the rows, so no source is gathered in one task. Equal ids and texts are told apart
    by the columns of carry, which the result keeps; a null source is a source of its own; an empty table gives no rows.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text_col).alias("_t"), *carry)
    base = base.withColumn("h", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("_t")).cast("binary")))
    rows = cut(base.withColumn("_n", F.monotonically_increasing_id()))
    ranges = 4096
    while ranges * ROWS < rows.count() and ranges < 1 << 24:
        ranges *= 16
    drop_table, digits = rows, len(f"{ranges:x}") - 1
    rows = rows.withColumn("r", F.conv(F.substring("h", 1, digits), 16, 10).cast("int"))
    parts = rows.groupBy("source", "r").agg(F.sum("size").alias("n"))
    sources = targets(parts.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share, most)
    before = Window.partitionBy("source").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    starts = starts.join(sources, starts.source.eqNullSafe(sources.source)).drop(sources.source)
    within = Window.partitionBy("source", "r").orderBy("h", "doc_id", "_t", *carry).rowsBetween(Window.unboundedPreceding, -1)
    ahead = rows.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0)))
    x = ahead.join(starts, ahead.source.eqNullSafe(starts.source) & (ahead.r == starts.r)).drop(starts.source).drop(starts.r)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    x = x.withColumn("passes", passes).withColumn("ahead", F.col("before") + F.col("ahead"))
    rest = F.col("target") - F.col("passes") * F.col("source_size")
    fits = (F.col("source_size") > 0) & (F.col("ahead") + F.col("size") <= rest)
    x = cut(x.withColumn("rest", rest).withColumn("fits", fits))
    drop(drop_table)
    rooms = x.groupBy("source").agg(F.first("rest").alias("rest"), F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0)).alias("used"))
    spare = x.where(~F.col("fits") & (F.col("size") > 0)).select("source", "r", "h", "doc_id", "_t", "_n", "size", *carry)
    more, rooms = fill(spare, cut(rooms), carry, ranges)
    x = x.join(more.unionByName(nearest(spare, more, rooms)), "_n", "left").withColumn("last", F.coalesce("at", "ahead"))
    x = x.withColumn("copies", F.when(F.col("source_size") > 0, F.col("passes") + (F.col("fits") | F.col("at").isNotNull()).cast("long")).otherwise(0))
    x = x.withColumn("taken", F.col("copies") * F.col("size"))
    words = lambda lap: F.when(F.col("passes") == lap, F.col("last")).otherwise(F.col("ahead")) + lap * F.col("source_size")
    at = lambda lap: F.when(F.col("copies") > lap, position(F.least(F.lit(1.0), words(lap) / F.col("target")), slope(F.col("k"))))
    return x.select("doc_id", "source", "size", "source_size", "target", "taken", "copies", at(0).alias("first_position"), at(1).alias("second_position"), F.col("_t").alias("text_hash"), *carry)


def nearest(spare: DataFrame, more: DataFrame, rooms: DataFrame) -> DataFrame:
    """(_n, at) of one document more a source: the smallest that is left, where it passes the target by less than is missing without it."""
    left = spare.join(more.select("_n"), "_n", "left_anti")
    least = left.groupBy(F.col("source").alias("_s")).agg(F.min(F.struct("size", "h", "doc_id", "_n")).alias("d"))
    x = least.join(rooms, F.col("source").eqNullSafe(F.col("_s")))
    return x.where(F.col("d.size") < 2 * (F.col("rest") - F.col("used"))).select("d._n", F.col("used").cast("long").alias("at"))


def fill(left: DataFrame, rooms: DataFrame, carry: tuple[str, ...], ranges: int) -> tuple[DataFrame, DataFrame]:
    """(_n, at): rows of left that go into the room of their source, and the words taken before each; and the rooms then.

    A round offers the room to the documents that fit it, those of at most half of it first, each kind in
    hash order, and takes them up to the first that doesn't fit. So the room halves or every small
    document is taken, of the others one fits at most, and the rounds are about the logarithm of the room.
    Running sums are made by ranges, and only ranges that the room reaches are sorted.
    """
    found = last = None
    while True:
        s = rooms.select(F.col("source").alias("_s"), "used", (F.col("rest") - F.col("used")).alias("room"))
        left = cut(left.join(s, F.col("source").eqNullSafe(F.col("_s"))).where(F.col("size") <= F.col("room")).drop("_s"))
        drop(last)
        last = left
        if not left.head(1):
            break
        x = left.withColumn("part", F.col("r") + ranges * (2 * F.col("size") > F.col("room")).cast("int"))
        w = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = x.groupBy("source", "part", "room").agg(F.sum("size").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
        parts = parts.where(F.col("before") < F.col("room")).select(F.col("source").alias("_s"), F.col("part").alias("_p"), "before")
        x = x.join(parts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_p")))
        w = Window.partitionBy("source", "part").orderBy("h", "doc_id", "_t", *carry).rowsBetween(Window.unboundedPreceding, -1)
        x = x.withColumn("ahead", F.col("before") + F.coalesce(F.sum("size").over(w), F.lit(0))).where(F.col("ahead") + F.col("size") <= F.col("room"))
        new = cut(x.select("source", "size", "_n", (F.col("used") + F.col("ahead")).alias("at")))
        found = new.select("_n", "at") if found is None else found.unionByName(new.select("_n", "at"))
        took = new.groupBy(F.col("source").alias("_s")).agg(F.sum("size").alias("took"))
        rooms = cut(rooms.join(took, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("used", F.col("used") + F.coalesce("took", F.lit(0))).drop("_s", "took"))
        left = left.drop("used", "room").join(new.select("_n"), "_n", "left_anti")
    return (left.select("_n", F.lit(0).cast("long").alias("at")) if found is None else found), rooms


def mix(docs: DataFrame, words: int = 1 << 24, **options) -> DataFrame:
    """The documents in training order: each as often as the mix takes it, by position.

    Keeps the columns of documents, whatever their names. The choice is plan_mix's, made over ids and
    sizes; positions are attached by a number of the row, so equal and null ids keep apart. A position is
    the time in training, from 0 to 1, at which its source's schedule comes to the copy; as the schedules together ask for nearly
    as much at all times (within a tenth with the default ones), equal ranges of positions hold about as many words, and texts are
    dealt to them without a pass to find the ranges: each text moves for the join and for its place, no more. Null and empty texts have no words and are in no mix; an empty table
    gives no rows.
    """
    row, at = free_name(docs, "row"), free_name(docs, "at")
    docs = numbered(docs, row)
    spark, folder = docs.sparkSession, scratch(docs.sparkSession, "plan")
    with tables_in(folder):
        plan = plan_mix(docs, carry=(row,), **options).where("copies > 0")
    copies = cut(plan.select(row, "size", F.explode(F.expr("filter(array(first_position, second_position), x -> x is not null)")).alias(at)))
    delete(spark, folder)
    total = copies.agg(F.sum("size")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // words))
    dealt = docs.join(copies.drop("size"), row).repartitionById(parts, F.least(F.floor(F.col(at) * parts), F.lit(parts - 1)).cast("int"))
    return dealt.sortWithinPartitions(at, row).drop(at, row)
