"""Sets of intervals held as rows (keys, start, end)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _islands(df: DataFrame, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (before < F.col("start")), 1).otherwise(0)
    island = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_new", new).withColumn("_island", island).groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def normalize(df: DataFrame, keys: list[str], bucket: int | None = 1 << 16) -> DataFrame:
    """Merge spans of a set that overlap or touch; empty spans go. Rows: keys, start, end.

    bucket: merge inside buckets of starts first, so that one set with a large share of all spans is not sorted in
    one task; the second step then sees merged spans alone. None leaves that step out, for many small sets.
    """
    kept = df.select(*keys, "start", "end").where("start < end")
    if bucket:
        kept = _islands(kept.withColumn("_bucket", F.floor(F.col("start") / bucket)), [*keys, "_bucket"]).drop("_bucket")
    return _islands(kept, keys)


def coverage(df: DataFrame, keys: list[str], bucket: int | None = 1 << 16) -> DataFrame:
    """keys, covered (positions in at least one span), n_islands."""
    return normalize(df, keys, bucket).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("covered"), F.count(F.lit(1)).alias("n_islands"))


def hull(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, end of the smallest span around all spans that aren't empty."""
    return df.where("start < end").groupBy(*keys).agg(F.min("start").alias("start"), F.max("end").alias("end"))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], bucket: int, within: bool = False) -> DataFrame:
    """Pairs of rows with equal keys whose spans (start, end) overlap; within: the right lies inside the left.

    Each span is placed in every bucket of positions that it meets, and a pair is returned only in the bucket
    where the later of the two starts, so nothing has to be made distinct. Choose a bucket of about the usual
    length of a span. Right columns get the prefix r_; empty spans match nothing.
    """
    def placed(df: DataFrame) -> DataFrame:
        cells = F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("end") - 1) / bucket))
        return df.where("start < end").withColumn("_cell", F.explode(cells))

    r = placed(right)
    r = r.select(*[F.col(c).alias(c if c in [*keys, "_cell"] else f"r_{c}") for c in r.columns])
    meet = placed(left).join(r, [*keys, "_cell"]).where((F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end")))
    meet = meet.where(F.floor(F.greatest("start", "r_start") / bucket) == F.col("_cell")).drop("_cell")
    return meet.where((F.col("r_start") >= F.col("start")) & (F.col("r_end") <= F.col("end"))) if within else meet


def remove(df: DataFrame, removed: DataFrame, keys: list[str], bucket: int) -> DataFrame:
    """The spans of df that overlap no span of removed; spans are removed whole."""
    hit = overlap_join(df.select(*keys, "start", "end").distinct(), removed, keys, bucket).select(*keys, "start", "end").distinct()
    return df.where("start < end").join(hit, [*keys, "start", "end"], "left_anti")


def covering(df: DataFrame, keys: list[str], at: int) -> DataFrame:
    """keys, held: whether a span of the set holds a position."""
    return df.groupBy(*keys).agg(F.coalesce(F.bool_or((F.col("start") <= at) & (F.lit(at) < F.col("end"))), F.lit(False)).alias("held"))
