"""For every set the other sets it shares most with.

All pairs that share something are far too many where some keys are in most sets.  Keys
are therefore taken from the rare to the frequent, a range of frequencies at a time.  What
a set shares with others through the keys taken so far is a lower bound; what it can still
share with a set it has not met is at most the number of its keys not taken yet.  Once its
k-th best lower bound exceeds that number, no new partner can enter its best k: the set is
closed, its frequent keys form no pairs, and they are only looked up for the partners it
has met and that can still be among the best.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators import durable
from marginalia.operators.joins import lookup_join, skew_join

FIRST, FACTOR = 32, 16
"""Greatest frequency of the keys taken first, and by how much it grows each time."""

PART = 1024
"""Sets of one key that a task pairs with all others of that key."""


def common(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(owner, other, n): how many keys the two sets of each pair share; 0 is left out.

    ``sets`` may hold fewer keys for the owners than for the others by its column ``own``.
    """
    mine = sets.filter("own") if "own" in sets.columns else sets
    listed = skew_join(mine.select("owner", "key"), pairs.select("owner", "other"), ["owner"])
    theirs = sets.select(F.col("owner").alias("other"), "key")
    return listed.join(theirs, ["other", "key"]).groupBy("owner", "other").agg(F.count(F.lit(1)).alias("n"))


def _met(mine: DataFrame, level: DataFrame) -> DataFrame:
    """(owner, other, n) through the keys of one range; sets of a frequent key are dealt to
    several tasks, each of which meets all other sets of it."""
    parts = F.ceil(F.col("df") / F.lit(PART)).cast("int")
    left = mine.select("owner", "key", F.pmod(F.xxhash64("owner"), parts).cast("int").alias("_part"))
    right = level.select(F.col("owner").alias("other"), "key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"))
    met = left.join(right, ["key", "_part"]).filter(F.col("owner") != F.col("other"))
    return met.groupBy("owner", "other").agg(F.count(F.lit(1)).alias("n"))


def _kth(known: DataFrame, k: int) -> DataFrame:
    """(owner, least): the k-th greatest count of each owner that has met k others.

    Spark keeps k rows per owner and task before it shuffles them."""
    order = Window.partitionBy("owner").orderBy(F.desc("n"), "other")
    best = known.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k)
    return best.groupBy("owner").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("_k")).filter(F.col("_k") == k).drop("_k")


def top_overlaps(sets: DataFrame, k: int, first: int = FIRST, factor: int = FACTOR) -> DataFrame:
    """(owner, other, n): the k others that share most keys with each owner, and all others
    that share as many as the k-th; fewer if fewer share any.

    ``sets`` has distinct rows (owner, key); rows with a null in either are ignored.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    sets = sets.select("owner", "key").filter(F.col("owner").isNotNull() & F.col("key").isNotNull())
    shared = sets.groupBy("key").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > 1)
    rows = durable.stored(skew_join(sets, shared, ["key"]).select("owner", "key", "df"), "overlap-rows")
    greatest = rows.agg(F.max("df").alias("m")).first()["m"] or 0
    known = rows.select("owner", F.col("owner").alias("other"), "df").filter(F.lit(False)).withColumnRenamed("df", "n")
    closed, open_owners = None, None
    low, high = 1, max(2, first)
    while True:
        level = rows.filter((F.col("df") > low) & (F.col("df") <= high))
        mine = level if open_owners is None else lookup_join(level, open_owners.select("owner"), ["owner"], "left_semi")
        both = known.unionByName(_met(mine, level))
        known = durable.stored(both.groupBy("owner", "other").agg(F.sum("n").alias("n")), "overlap-known")
        left = rows.groupBy("owner").agg(F.count_if(F.col("df") > high).alias("rest"))
        if open_owners is not None:
            left = lookup_join(left, open_owners.select("owner"), ["owner"], "left_semi")
        state = durable.stored(
            left.join(_kth(known, k), "owner", "left").withColumn("high", F.lit(high).cast("bigint"))
            .withColumn("open", (F.col("rest") > 0) & (F.col("least").isNull() | (F.col("rest") >= F.col("least")))), "overlap-state",
        )
        done = state.filter(~F.col("open")).drop("open")
        closed = done if closed is None else closed.unionByName(done)
        open_owners = state.filter("open")
        if high >= greatest or open_owners.isEmpty():
            break
        low, high = high, high * factor
    # Of the partners met, those that cannot reach the k-th any more go; the rest is counted in full.
    can = known.join(closed, "owner").filter(F.col("least").isNull() | (F.col("n") + F.col("rest") >= F.col("least")))
    can = durable.stored(can.select("owner", "other", "n", "rest", "high"), "overlap-candidates")
    ends = closed.select("owner", "high")
    frequent = rows.join(ends, "owner").select("owner", "key", (F.col("df") > F.col("high")).alias("own"))
    more = common(can.filter(F.col("rest") > 0), frequent).withColumnRenamed("n", "more")
    whole = can.join(more, ["owner", "other"], "left").select(
        "owner", "other", (F.col("n") + F.coalesce("more", F.lit(0))).cast("bigint").alias("n")
    )
    best = Window.partitionBy("owner").orderBy(F.desc("n"))
    return whole.withColumn("_r", F.rank().over(best)).filter(F.col("_r") <= k).drop("_r")
