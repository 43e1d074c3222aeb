"""Ordered streams as DataFrames: positions come from a unique integer key, in its order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.facts import number_rows


def take(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows; a top-n plan, without a full sort."""
    return df.orderBy(F.col(key).asc_nulls_last()).limit(n)


def drop(df: DataFrame, key: str, n: int) -> DataFrame:
    """All but the first n rows."""
    return number_rows(df, key, "_position", 0).where(F.col("_position") >= n).drop("_position")


def batch(df: DataFrame, key: str, n: int, *aggregates: Column) -> DataFrame:
    """Runs of n rows, the last one maybe shorter: batch (from 0), n_items, and the aggregates given."""
    numbered = number_rows(df, key, "_position", 0)
    return numbered.groupBy(F.floor(F.col("_position") / n).cast("bigint").alias("batch")).agg(F.count(F.lit(1)).alias("n_items"), *aggregates)


def merge(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of a and b in turn, then the rest of the longer one; column position is the place in the result."""
    n_a, n_b = (x.agg(F.count(F.lit(1)).alias("n")) for x in (a, b))
    sides = number_rows(a, key, "_at", 0).withColumn("_side", F.lit(0)).unionByName(number_rows(b, key, "_at", 0).withColumn("_side", F.lit(1)))
    shorter = F.broadcast(n_a.union(n_b).agg(F.min("n").alias("_shorter")))  # one row
    rows = sides.join(shorter)
    place = F.when(F.col("_at") < F.col("_shorter"), 2 * F.col("_at") + F.col("_side")).otherwise(F.col("_at") + F.col("_shorter"))
    return rows.withColumn("position", place.cast("bigint")).drop("_at", "_side", "_shorter")


def last_n(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The last n rows of each key, as a ring buffer that overwrites keeps."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last()))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def first_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row of each key, the first in order."""
    return df.groupBy(*keys).agg(F.min_by(F.struct("*"), F.col(order)).alias("_one")).select("_one.*")


def tee(df: DataFrame, *sinks) -> None:
    """Hand one DataFrame to several sinks, computed once."""
    df.persist()
    try:
        for sink in sinks:
            sink(df)
    finally:
        df.unpersist()
