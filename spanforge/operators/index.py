"""Access paths over facts, atoms, the store's life cycle and reference joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import category
from ..sources.facts import number_rows


def by_predicate(facts: DataFrame, predicate: str) -> DataFrame:
    return facts.where(F.col("predicate") == predicate)


def by_span(facts: DataFrame, start: int, end: int) -> DataFrame:
    """Facts with exactly this span."""
    return facts.where((F.col("span_start") == start) & (F.col("span_end") == end))


def by_confidence(facts: DataFrame, low: float, high: float) -> DataFrame:
    return facts.where(F.col("confidence").between(low, high))


def by_all(facts: DataFrame, predicate: str | None = None, span: tuple[int, int] | None = None, confidence: tuple[float, float] | None = None) -> DataFrame:
    """Facts that meet every criterion given; none if there is no criterion."""
    if predicate is None and span is None and confidence is None:
        return facts.limit(0)
    out = facts if predicate is None else by_predicate(facts, predicate)
    out = out if span is None else by_span(out, *span)
    return out if confidence is None else by_confidence(out, *confidence)


def confidence_bucket(confidence: Column) -> Column:
    """0 to 10, a tenth wide each; 10 holds 1.0 and above."""
    return F.least(F.floor(confidence * 10), F.lit(10)).cast("bigint")


def confidence_histogram(facts: DataFrame) -> DataFrame:
    return facts.groupBy(confidence_bucket(F.col("confidence")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def category_rollup(facts: DataFrame) -> DataFrame:
    """Counts by category and predicate, by category, and in all (nulls where summed up)."""
    rows = facts.select(category(F.col("predicate")).alias("category"), "predicate")
    return rows.rollup("category", "predicate").agg(F.count(F.lit(1)).alias("n"))


def write_index(facts: DataFrame, path: str, mode: str = "append") -> None:
    """Facts as Parquet by predicate, so that a predicate is a folder; spans and confidence use file statistics."""
    facts.repartition("predicate", F.pmod(F.xxhash64("id"), F.lit(16))).sortWithinPartitions("span_start").write.mode(mode).partitionBy("predicate").parquet(path)


def append(facts: DataFrame, new: DataFrame, key: str, generation: int) -> DataFrame:
    """facts and new, whose ids follow the largest there is in the order of key."""
    last = facts.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    numbered = number_rows(new, key, "_n").join(F.broadcast(last))  # one row
    added = numbered.withColumn("id", F.col("_last") + F.col("_n")).withColumn("generation", F.lit(generation)).drop("_n", "_last")
    return facts.unionByName(added.select(*facts.columns))


def clear(facts: DataFrame) -> DataFrame:
    """A store of the same columns without facts."""
    return facts.where(F.lit(False))


def update(facts: DataFrame, changed: DataFrame, generation: int) -> DataFrame:
    """facts with the rows of changed in place of those with their ids; the new ones carry the generation."""
    new = changed.withColumn("generation", F.lit(generation)).select(*facts.columns)
    return facts.join(new.select("id"), "id", "left_anti").select(*facts.columns).unionByName(new)


def read_index(spark: SparkSession, path: str, predicate: str | None = None, schema=None) -> DataFrame:
    """Facts that write_index wrote; with a predicate only its folder is read."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    out = reader.parquet(path)
    return out if predicate is None else by_predicate(out, predicate)


def hit_rate(lookups: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """hits, misses, rate of lookups of a key in what a cache holds."""
    found = lookups.join(cached.select(key).distinct().withColumn("_hit", F.lit(1)), key, "left")
    hits, n = F.count("_hit"), F.count(F.lit(1))
    return found.agg(hits.alias("hits"), (n - hits).alias("misses"), (hits / n).alias("rate"))


def recent(lookups: DataFrame, key: str, at: str, n: int) -> DataFrame:
    """The n keys looked up last: what a cache of n entries holds that drops the least recently used."""
    return lookups.groupBy(key).agg(F.max(at).alias("last")).orderBy(F.desc("last"), key).limit(n)


def compact(facts: DataFrame, least_confidence: float) -> DataFrame:
    """Facts at or above a confidence; ids stay as they are."""
    return facts.where(F.col("confidence") >= least_confidence)


def store_stats(facts: DataFrame) -> DataFrame:
    return facts.groupBy("generation").agg(F.count(F.lit(1)).alias("n_facts"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def intern(df: DataFrame, text: str, order: str) -> DataFrame:
    """atom_id, text, n: distinct texts with dense ids from 1 in the order of their first appearance."""
    seen = df.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("text")).agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("n"))
    # texts that first appear in one row share its place; they follow each other by text
    place = F.row_number().over(Window.partitionBy("_first").orderBy("text"))
    per_row = seen.groupBy("_first").agg(F.count(F.lit(1)).alias("_k"))
    rows = number_rows(per_row, "_first", "_row", 0)
    before = rows.withColumn("_bucket", F.floor(F.col("_row") / 65536))
    sums = before.groupBy("_bucket").agg(F.sum("_k").alias("_s"))
    offset = F.coalesce(F.sum("_s").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("_k").over(Window.partitionBy("_bucket").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = before.join(sums.select("_bucket", offset.alias("_o")), "_bucket").select("_first", (F.col("_o") + inside).alias("_start"))
    return seen.join(starts, "_first").select((F.col("_start") + place).cast("bigint").alias("atom_id"), "text", "n")


def lookup(df: DataFrame, atoms: DataFrame, text: str) -> DataFrame:
    """df with the atom_id of a text column; 0 where the text is no atom."""
    return df.join(atoms.select("atom_id", F.col("text").alias(text)), text, "left").withColumn("atom_id", F.coalesce("atom_id", F.lit(0)))


def interning_efficiency(df: DataFrame, text: str) -> DataFrame:
    """efficiency: the share of texts that repeat an earlier one."""
    return df.agg((1 - F.countDistinct(text) / F.count(text)).alias("efficiency"))


def references(facts: DataFrame, reference: str = "value_ref") -> DataFrame:
    """Each fact that refers to another, with the other's predicate and confidence."""
    target = facts.select(F.col("id").alias(reference), F.col("predicate").alias("ref_predicate"), F.col("confidence").alias("ref_confidence"))
    return facts.where(F.col(reference).isNotNull()).join(target, reference)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """left with the values of the last right row of its keys at or before `at`; nulls if there is none.

    One sort by key and time over the union of both sides, no join; equal times count as before.
    """
    names = left.columns
    l = left.withColumn("_right", F.lit(0)).withColumns({f"_{v}": F.lit(None).cast(right.schema[v].dataType) for v in values})
    r = right.select(*keys, at, *[F.col(v).alias(f"_{v}") for v in values]).withColumn("_right", F.lit(1))
    r = r.select(*[F.col(c) if c in [*keys, at] else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in names], "_right", *[f"_{v}" for v in values])
    back = Window.partitionBy(*keys).orderBy(F.col(at), F.desc("_right")).rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r).withColumn("_seen", F.last(F.when(F.col("_right") == 1, F.struct(*[f"_{v}" for v in values])), ignorenulls=True).over(back))
    return both.where("_right = 0").select(*names, *[F.col(f"_seen._{v}").alias(v) for v in values])


def benchmark_statistics(results: DataFrame, baseline: DataFrame) -> DataFrame:
    """name, operations, mean_ns, percent_change against the baseline, verdict and confidence class.

    results: name, operations, total_ns; baseline: name, mean_ns. A change of over 20 % is a regression, one
    below -1 % an improvement; 1000 operations give high confidence, 100 medium, 10 low.
    """
    own = results.groupBy("name").agg(F.sum("operations").alias("operations"), (F.sum("total_ns") / F.sum("operations")).alias("mean_ns"))
    both = own.join(baseline.select("name", F.col("mean_ns").alias("_base")), "name", "left").withColumn("percent_change", 100 * (F.col("mean_ns") - F.col("_base")) / F.col("_base"))
    verdict = F.when(F.col("percent_change") > 20, "regression").when(F.col("percent_change") < -1, "improvement").when(F.col("percent_change").isNull(), "new").otherwise("stable")
    n = F.col("operations")
    level = F.when(n >= 1000, "high").when(n >= 100, "medium").when(n >= 10, "low").otherwise("insufficient")
    return both.select("name", "operations", "mean_ns", "percent_change", verdict.alias("verdict"), level.alias("confidence"))
