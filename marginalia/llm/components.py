"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators.durable import stored

SMALL = 200_000
"""Links up to which a round is written by one task: many small files cost more than its work."""


def _mark(links: DataFrame) -> tuple[int, int | None]:
    """The number of links and a hash that tells whether they have changed."""
    now = links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return now["n"], now["h"]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the smallest node.

    Alternates two steps until nothing changes: every node's greater neighbours are linked
    to its smallest one, then its smaller neighbours and itself.  Each step combines
    before it shuffles, and edges are written after each round, so a hub is a skewed join
    that Spark splits, never a group in one task (but for graphs of at most ``SMALL``
    links, which one task holds).  Null ends are ignored.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    # greatest and least skip nulls, so an edge with a null end becomes a loop and goes
    links = stored(links.filter(F.col("u") > F.col("v")).distinct(), "component-links")
    mark = _mark(links)
    while True:
        # No table of a round has more than twice its links.
        kept = (lambda rows, name: stored(rows.coalesce(1), name)) if mark[0] <= SMALL else stored
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = kept(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "component-least")
        greater = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        greater = kept(greater.filter(F.col("u") != F.col("v")).distinct(), "component-large")
        least = kept(greater.groupBy("u").agg(F.min("v").alias("m")), "component-least")
        smaller = greater.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = kept(smaller.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "component-links")
        before, mark = mark, _mark(links)
        if mark == before:
            break
    roots = links.groupBy("v").agg(F.count(F.lit(1)).alias("_n")).select(F.col("v").alias("node"), F.col("v").alias("root"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
