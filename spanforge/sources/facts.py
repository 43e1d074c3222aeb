"""Adapters: tables as facts. Each has its DuckDB text beside it, for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import complete


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event as a fact: its time in seconds and its value as a span, its type as predicate."""
    e = table(spark, sf_dir, "events")
    start = F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)").cast("bigint")
    return complete(
        e.select(
            (F.col("event_id") + 1).alias("id"),
            F.col("user_id").cast("string").alias("source"),
            start.alias("span_start"),
            (start + F.floor("value").cast("bigint")).alias("span_end"),
            F.col("event_type").alias("predicate"),
            F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"),
            F.lit("number").alias("value_type"),
            F.get_json_object("props", "$.k").cast("bigint").alias("value_number"),
            F.col("value").alias("value_float"),
            F.lit(1).alias("generation"),
        )
    )


EVENTS_SQL = """
SELECT event_id + 1 AS id, CAST(user_id AS VARCHAR) AS source, date_diff('second', TIMESTAMP '2024-01-01 00:00:00', ts) AS span_start,
  date_diff('second', TIMESTAMP '2024-01-01 00:00:00', ts) + CAST(floor(value) AS BIGINT) AS span_end, event_type AS predicate,
  least(value / 100, 1.0) AS confidence, 'number' AS value_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS value_number,
  value AS value_float, CAST(NULL AS INTEGER) AS value_atom, 1 AS generation
FROM events
"""


# Most parts (lines, tags) of a document that get ids of their own, and lines that are summed up at a time.
PARTS, LINE_RUN = 1 << 24, 256


def part_id(owner: str) -> Column:
    """The id of the part at column pos of a document; fails if it would be one of the next document."""
    at = F.col("pos")
    fits = F.when(at < PARTS, at).otherwise(F.raise_error(F.lit(f"a document has more than {PARTS} parts")).cast("int"))
    return (F.col(owner) * PARTS + fits + 1).alias("id")


def facts_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of a document as a fact: its place in characters, its words as value."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", -1).alias("lines"))
    # where a line starts: the lengths of the lines before it, and their line ends; summed up by runs of LINE_RUN lines
    # first, so that no line looks at all that are before it
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x)
    lines = lines.withColumn("sizes", F.transform("lines", lambda x: (F.length(x) + 1).cast("bigint")))
    runs = F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / LINE_RUN).cast("int"))
    lines = lines.withColumn("runs", F.transform(runs, lambda r: total(F.slice("sizes", r * LINE_RUN + 1, LINE_RUN))))
    lines = lines.withColumn("before", F.transform("runs", lambda _, r: total(F.slice("runs", F.lit(1), r))))
    run = lambda i: F.floor(i / LINE_RUN).cast("int")
    starts = F.transform(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.get("before", run(i)) + total(F.slice("sizes", run(i) * LINE_RUN + 1, i % LINE_RUN)))
    rows = lines.select("doc_id", F.size("lines").alias("n"), F.posexplode(F.arrays_zip(starts.alias("start"), F.col("lines").alias("line"))).alias("pos", "one"))
    rows = rows.select("doc_id", "n", "pos", F.col("one.start").alias("span_start"), F.col("one.line").alias("line"))
    kind = F.when(F.col("pos") == 0, "starts_block").when(F.col("pos") == F.col("n") - 1, "ends_block").otherwise("has_text")
    words = F.size(F.filter(F.split("line", " "), lambda w: w != "")).cast("bigint")
    return complete(
        rows.select(
            part_id("doc_id"),
            F.col("doc_id").cast("string").alias("source"),
            "span_start",
            (F.col("span_start") + F.length("line")).alias("span_end"),
            kind.alias("predicate"),
            F.lit(1.0).alias("confidence"),
            F.lit("number").alias("value_type"),
            words.alias("value_number"),
            F.lit(1).alias("generation"),
        )
    )


DOCUMENTS_SQL = """
SELECT doc_id * 16777216 + pos + 1 AS id, CAST(doc_id AS VARCHAR) AS source, span_start, span_start + length(line) AS span_end,
  CASE WHEN pos = 0 THEN 'starts_block' WHEN pos = n - 1 THEN 'ends_block' ELSE 'has_text' END AS predicate, 1.0::DOUBLE AS confidence,
  'number' AS value_type, CAST(len(list_filter(string_split(line, ' '), lambda w: w <> '')) AS BIGINT) AS value_number, 1 AS generation
FROM (
  SELECT doc_id, n, pos, line, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS span_start
  FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents)
)
"""


def facts_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item as a fact: its ship date in days and its quantity as a span, its return flag as predicate."""
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date")).cast("bigint")
    quantity = F.col("l_quantity").cast("bigint")
    return complete(
        table(spark, sf_dir, "lineitem").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
            F.col("l_suppkey").cast("string").alias("source"),
            day.alias("span_start"),
            (day + quantity).alias("span_end"),
            F.col("l_returnflag").alias("predicate"),
            (F.col("l_discount") * 10).alias("confidence"),
            F.lit("number").alias("value_type"),
            quantity.alias("value_number"),
            F.lit(1).alias("generation"),
        )
    )


LINEITEM_SQL = """
SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_suppkey AS VARCHAR) AS source, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS span_start,
  date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS BIGINT) AS span_end, l_returnflag AS predicate,
  l_discount * 10 AS confidence, 'number' AS value_type, CAST(l_quantity AS BIGINT) AS value_number, 1 AS generation
FROM lineitem
"""


def facts_from_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of a page as facts, by one regular expression; the value is the number of the tag in the page."""
    tags = F.regexp_extract_all("html", F.lit(r"<(/?[a-zA-Z][a-zA-Z0-9]*)"), 1)
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(tags).alias("pos", "tag"))
    kind = F.when(F.col("tag").startswith("/"), "ends_block").otherwise("html_is_tag")
    return complete(
        rows.select(
            part_id("page_id"), F.col("page_id").cast("string").alias("source"), F.col("pos").cast("bigint").alias("span_start"),
            (F.col("pos") + 1).cast("bigint").alias("span_end"), kind.alias("predicate"), F.lit(1.0).alias("confidence"), F.lit("text").alias("value_type"), F.col("tag").alias("value_text"), F.lit(1).alias("generation"),
        )
    )


PAGES_SQL = r"""
SELECT page_id * 16777216 + pos + 1 AS id, CAST(page_id AS VARCHAR) AS source, CAST(pos AS BIGINT) AS span_start, CAST(pos + 1 AS BIGINT) AS span_end,
  CASE WHEN starts_with(tag, '/') THEN 'ends_block' ELSE 'html_is_tag' END AS predicate, 1.0::DOUBLE AS confidence, 'text' AS value_type, tag AS value_text, 1 AS generation
FROM (SELECT page_id, unnest(t) AS tag, unnest(range(0, len(t))) AS pos FROM (SELECT page_id, regexp_extract_all(html, '<(/?[a-zA-Z][a-zA-Z0-9]*)', 1) AS t FROM pages))
"""


def number_rows(df: DataFrame, key: str, column: str = "id", first: int = 1, buckets: int = 1024, least: int = 1 << 16) -> DataFrame:
    """Dense numbers in the order of a unique integer key, without sorting everything in one task.

    Splitters from approximate quantiles of the key cut the rows into buckets of about equal size, whatever the keys
    look like (at most `buckets`, about `least` rows each or more). Rows are counted by bucket; each row's number is
    its bucket's offset and its rank inside the bucket. Only the list of buckets is ordered as a whole. Null keys
    come first.
    """
    n = df.count()
    parts = max(1, min(buckets, n // least))
    edges = []
    if parts > 1:
        shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
        edges = sorted(set(df.agg(F.percentile_approx(key, shares, 20 * buckets)).first()[0] or []))
    bucket = F.when(F.col(key).isNull(), -1).otherwise(_at_or_below(F.col(key), edges))
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))  # a row for each bucket
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(F.col(key).asc_nulls_first()))
    offsets = F.broadcast(counts.select("_bucket", before.alias("_before")))  # buckets + 1 rows at most
    return rows.join(offsets, "_bucket").withColumn(column, F.col("_before") + inside - 1 + first).drop("_bucket", "_before")


def _at_or_below(value: Column, edges: list) -> Column:
    """How many of the sorted edges are at or below value: first among every 32nd, then in the run after it."""
    if not edges:
        return F.lit(0)
    runs = [edges[i : i + 32] for i in range(0, len(edges), 32)]
    coarse = F.size(F.filter(F.lit([r[0] for r in runs]), lambda e: e <= value))
    fine = F.size(F.filter(F.element_at(F.array(*[F.lit(r) for r in runs]), F.greatest(coarse, F.lit(1))), lambda e: e <= value))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * 32 + fine)
