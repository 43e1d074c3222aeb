"""File sources and sinks, directory trees and bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns
from ..functions.text import fence_length

MAX_BUNDLED = 10 << 20


def read_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """path, name, size, modified, content of whole files; ** of a glob is what recursive does."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob.rsplit("/", 1)[-1])
    df = reader.load(path)
    return df.select("path", patterns.basename(F.col("path")).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def expand_globs(spark: SparkSession, root: str, globs: list[str]) -> DataFrame:
    """Files below a root that match a glob, with the number of the first glob that they match."""
    wanted = [(i, p) for i, g in enumerate(globs) for p in patterns.expand_braces(g)]
    files = read_files(spark, root).drop("content")
    relative = F.regexp_replace("path", "^.*?" + root.split("://")[-1].rstrip("/") + "/", "")
    first = F.coalesce(*[F.when(patterns.matches_glob(relative, p.replace("**/", "*")), F.lit(i)) for i, p in wanted])
    return files.withColumns({"relative": relative, "pattern": first}).where(F.col("pattern").isNotNull())


def content_hash(content: Column) -> Column:
    return F.xxhash64(content)


def limited(content: Column, n: int) -> Column:
    """The first n bytes."""
    return F.substring(content, 1, n)


def write_text(df: DataFrame, path: str, column: str = "value") -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_parquet(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).parquet(path)


def write_nothing(df: DataFrame) -> None:
    """Run a plan and discard its rows."""
    df.write.format("noop").mode("overwrite").save()


def generate(spark: SparkSession, n: int, value: Column) -> DataFrame:
    """pos, value: n rows of an expression over pos."""
    return spark.range(n).select(F.col("id").alias("pos"), value.alias("value")) if n else spark.range(0).select(F.col("id").alias("pos"), value.alias("value"))


def failing(df: DataFrame, message: str) -> DataFrame:
    """df whose first row raises an error."""
    return df.where(F.raise_error(F.lit(message)).isNull())


def entries(paths: DataFrame, path: str = "path") -> DataFrame:
    """path, name, depth, is_dir, parent: every file of a table of relative paths and every folder above it."""
    parts = F.split(path, "/")
    rows = paths.select(parts.alias("p")).select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("n"))
    rows = rows.select(F.array_join(F.slice("p", 1, F.col("n")), "/").alias("path"), (F.col("n") < F.size("p")).alias("is_dir")).groupBy("path").agg(F.bool_or("is_dir").alias("is_dir"))
    return rows.select("path", patterns.basename(F.col("path")).alias("name"), (F.size(F.split("path", "/")) - 1).alias("depth"), "is_dir", F.when(F.col("path").contains("/"), patterns.dirname(F.col("path"))).otherwise("").alias("parent"))


def tree(paths: DataFrame, path: str = "path", max_depth: int = 64, ignored: list[str] | None = None) -> DataFrame:
    """seq_key, line: a listing with connectors; folders first, then by name. Order by seq_key.

    Hidden entries go. An ignored file goes; an ignored folder, or one at the depth limit, is shown as [...].
    """
    rows = entries(paths, path).where(~F.exists(F.split("path", "/"), lambda x: x.startswith(".")))
    hidden = patterns.ignored(F.col("path"), ignored or [])
    rows = rows.withColumn("_closed", hidden | ((F.col("depth") >= max_depth) & F.col("is_dir"))).where(~(hidden & ~F.col("is_dir")))
    # below a closed folder nothing is shown
    closed = rows.where("_closed and is_dir").select(F.col("path").alias("_above"))
    chain = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda n: F.array_join(F.slice(F.split("path", "/"), 1, n), "/"))
    above = rows.where("depth > 0").select("path", F.explode(F.slice(chain, 1, F.size(chain) - 1)).alias("_above")).join(closed, "_above").select("path").distinct()
    rows = rows.join(above, "path", "left_anti")
    siblings = Window.partitionBy("parent").orderBy(F.col("is_dir").desc(), "name")
    rows = rows.withColumns({"_last": F.lead("path").over(siblings).isNull(), "_key": F.concat(F.when(F.col("is_dir"), "0").otherwise("1"), "name")})
    up = rows.select("path", F.posexplode(chain).alias("at", "_step")).join(rows.select(F.col("path").alias("_step"), F.col("_key").alias("k"), F.col("_last").alias("l")), "_step")
    up = up.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("at", "k", "l"))).alias("steps"))
    out = rows.join(up, "path")
    bars = F.array_join(F.transform(F.slice("steps", 1, F.size("steps") - 1), lambda s: F.when(s["l"], F.lit("    ")).otherwise(F.lit("│   "))), "")
    line = F.concat(bars, F.when(F.col("_last"), "└── ").otherwise("├── "), "name", F.when(F.col("_closed"), " [...]").otherwise(""))
    return out.select(F.array_join(F.transform("steps", lambda s: s["k"]), "\x01").alias("seq_key"), "path", line.alias("line"))


def bundle(files: DataFrame, path: str = "path", text: str = "text", most: int = MAX_BUNDLED) -> DataFrame:
    """path, block: each file fenced by more backticks than it holds; files over `most` bytes go."""
    mark = F.repeat(F.lit("`"), fence_length(F.col(text)).cast("int"))
    lang = patterns.language(F.col(path))
    body = F.concat(F.lit('<File path="./'), F.col(path), F.lit('">\n\n'), mark, F.when(lang == "unknown", "").otherwise(lang), F.lit("\n"), F.col(text), F.when(F.col(text).endswith("\n"), "").otherwise("\n"), mark, F.lit("\n\n</File>\n"))
    return files.where(F.octet_length(text) <= most).select(path, body.alias("block"))


def unformatted(files: DataFrame, formatted: Column, text: str = "text") -> DataFrame:
    """Files whose text differs from its formatted form; those that can't be formatted are left out."""
    return files.withColumn("formatted", formatted).where(F.col("formatted").isNotNull() & (F.col(text) != F.col("formatted")))


def dependencies(declared: DataFrame, installed: DataFrame) -> DataFrame:
    """name, version, installed_version, status of every declared dependency."""
    both = declared.select("name", "version").join(installed.select("name", F.col("version").alias("installed_version")), "name", "left")
    return both.withColumn("status", patterns.dependency_status(F.col("version"), F.col("installed_version")))
