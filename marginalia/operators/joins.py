"""Joins and orderings that stay even when one key holds much of the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 * 1024 * 1024
"""Largest lookup handed to every executor."""

NULL_PARTS = 4096
"""Parts over which rows are dealt that cannot match."""

HOT_ROWS = 2_000_000
"""Rows of one key that a single task may take before the key is split."""


def fits_broadcast(df: DataFrame) -> bool:
    """Whether the rows, measured as text, stay within the broadcast limit."""
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("bigint"))
    return (df.agg(size.alias("n")).first()["n"] or 0) <= BROADCAST_BYTES


def by_shuffle(rows: DataFrame) -> DataFrame:
    """Rows that a join shuffles and never hands to every executor by way of the driver.

    For tables that grow with the input: Spark guesses the size of what is made from a
    small file, and texts cut into pieces are many times larger than it guesses.
    """
    return rows.hint("merge")


def lookup_join(facts: DataFrame, lookup: DataFrame, keys: list[str],
                how: str = "left") -> DataFrame:
    """Join a table that is usually small and has one row per key.

    The lookup is measured first: within the limit it is broadcast and the facts
    are not shuffled; beyond it the join shuffles with hot keys split.
    """
    if fits_broadcast(lookup):
        return facts.join(F.broadcast(lookup), keys, how)
    return skew_join(facts, lookup, keys, how)


def skew_join(facts: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner",
              rows: int | None = None) -> DataFrame:
    """Equi-join with hot fact keys spread over several tasks; null keys never match.

    ``rows`` is an upper bound of the fact rows when the caller knows one: a table no
    larger than ``HOT_ROWS`` cannot hold a hot key and is joined plainly.

    Otherwise keys with more than ``HOT_ROWS`` fact rows are counted first (map-side
    combined, key columns only).  At most ``rows / HOT_ROWS`` such keys can exist,
    so that list is small whatever the data.  A hot key gets one part per
    ``HOT_ROWS`` rows: its fact rows take a part by hash, its lookup rows are
    repeated once per part.  All other keys join once, on part 0.
    """
    if rows is not None and rows <= HOT_ROWS:
        return facts.join(lookup, keys, how)
    hot = (
        facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > HOT_ROWS)
        .select(*keys, F.ceil(F.col("_n") / F.lit(HOT_ROWS)).cast("int").alias("_parts"))
    )
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    # Rows with a null key match nothing; they are dealt out by their other columns.
    unmatched = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    spread = F.pmod(F.xxhash64(*facts.columns), F.when(unmatched, NULL_PARTS).otherwise(parts)).cast("int")
    left = (
        facts.join(F.broadcast(hot), keys, "left").withColumn("_part", spread).drop("_parts")
    )
    right = (
        lookup.join(F.broadcast(hot), keys, "left")
        .withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
        .drop("_parts")
    )
    return left.join(right, [*keys, "_part"], how).drop("_part")


def with_one_row(facts: DataFrame, one: DataFrame) -> DataFrame:
    """Add the columns of a one-row table (an aggregate without keys) to every row."""
    key = F.lit(1).alias("_one")
    return facts.select("*", key).join(F.broadcast(one.select("*", key)), "_one", "left").drop("_one")


def latest_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row with the greatest order per key.

    An aggregate, not a window: rows are reduced before the shuffle, so a key with
    very many versions costs one row per task.
    """
    others = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*others), F.struct(*order)).alias("_best")
    return rows.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*rows.columns)


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row with the smallest order per key, reduced before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    best = F.min_by(F.struct(*others), F.struct(*order)).alias("_best")
    return rows.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*rows.columns)


def with_position(rows: DataFrame, group: list[str], chunk: str, order: list[str],
                  name: str = "position") -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... without sorting a group in one task.

    ``chunk`` splits a group into consecutive runs of limited size (file blocks, say)
    and grows with the order.  Rows are numbered inside their chunk, and a running sum
    over the few chunk sizes gives each chunk its start.
    """
    inside = Window.partitionBy(*group, chunk).orderBy(*order)
    before = Window.partitionBy(*group).orderBy(chunk).rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = (
        rows.groupBy(*group, chunk).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    return (
        rows.withColumn("_i", F.row_number().over(inside) - 1)
        .join(starts, [*group, chunk])
        .withColumn(name, (F.col("_start") + F.col("_i")).cast("bigint"))
        .drop("_i", "_start")
    )


def joined_names(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Distinct values per key as one sorted comma list.

    Duplicates go before the list is built, so a key costs its distinct values only.
    """
    return (
        rows.select(*keys, value).filter(F.col(value).isNotNull()).distinct()
        .groupBy(*keys)
        .agg(F.array_join(F.array_sort(F.collect_list(value)), ", ").alias(name))
    )
