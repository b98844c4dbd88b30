"""One row of each group of documents, chosen by row and not by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators.durable import stored
from marginalia.operators.joins import skew_join


def row_key(id_col: Column, content: Column) -> Column:
    """What tells rows apart: id (null or not) and content; never null."""
    return F.concat_ws(":", F.when(id_col.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), id_col.cast("string"))), content.cast("string"))


def chosen_rows(docs: DataFrame, key: Column, chosen: DataFrame) -> DataFrame:
    """One row of ``docs`` for each ``_row_key`` of ``chosen`` (which has each once), with its columns.

    Only rows that share a key are compared; they are reduced before the shuffle.
    """
    names = docs.columns
    keyed = docs.select(F.struct(*names).alias("_row"), key.alias("_row_key"))
    counts = keyed.groupBy("_row_key").agg(F.count(F.lit(1)).alias("_n"))
    chosen = stored(chosen.select("_row_key").join(counts, "_row_key"), "one-row-keys")
    once = skew_join(keyed, chosen.filter(F.col("_n") == 1), ["_row_key"])
    many = skew_join(keyed, chosen.filter(F.col("_n") > 1), ["_row_key"])
    first = many.groupBy("_row_key").agg(F.min_by("_row", F.xxhash64(*[F.col("_row")[n] for n in names])).alias("_row"))
    return once.select("_row").unionByName(first.select("_row")).select(*(F.col("_row")[n].alias(n) for n in names))
