"""Token counts: an exact histogram of encoded lengths, whose suffix sums answer every context limit.

Documents are encoded once, in Arrow batches, and reduced to their lengths before anything is shuffled.
The histogram has one row for each distinct length, so its size follows the longest document and not the
number of documents; a length shared by a third of the corpus is summed on the map side.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, held, small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the published pre-tokenization pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

def encoder(path: str, pattern: str = PATTERN):
    """The worker's tokenizer of a ranks file."""

    def make():
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    return held(("ranks", path), make)


def token_length(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of a whole text; 0 for null or empty."""

    @F.pandas_udf("long")
    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(vocabulary)
        for texts in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return lengths(text)


def length_histogram(lengths: DataFrame, column: str = "n_tokens", block: int = 1024) -> DataFrame:
    """One row per distinct length with everything a context limit of that length needs.

    n_tokens, n_docs; docs_at_least and tokens_at_least (suffix sums); truncated_total: tokens left if every
    document is cut to n_tokens; kept_whole: documents that fit; quantile: share of documents no longer;
    total_docs and total_tokens. An empty table gives no rows. Suffix sums run inside blocks of lengths and
    over one total per block, so no task holds more than `block` lengths or the list of blocks.
    """
    work = Workspace(lengths.sparkSession, "token-counts")
    hist = work.stash(lengths.groupBy(F.col(column).alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs")), "histogram")
    hist = hist.withColumn("_block", F.floor(F.col("n_tokens") / block)).withColumn("_tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = hist.groupBy("_block").agg(F.sum("n_docs").alias("_docs"), F.sum("_tokens").alias("_sum"))
    above = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "_block",
        F.coalesce(F.sum("_docs").over(above), F.lit(0)).alias("_docs_above"),
        F.coalesce(F.sum("_sum").over(above), F.lit(0)).alias("_sum_above"),
        F.sum("_docs").over(every).alias("total_docs"),
        F.sum("_sum").over(every).alias("total_tokens"),
    )
    inside = Window.partitionBy("_block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    at_least = F.col("_docs_above") + F.sum("n_docs").over(inside)
    sum_at_least = F.col("_sum_above") + F.sum("_tokens").over(inside)
    out = hist.join(blocks, "_block").withColumns({"docs_at_least": at_least, "tokens_at_least": sum_at_least})
    longer = F.col("docs_at_least") - F.col("n_docs")
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("_tokens") + longer * F.col("n_tokens")).alias("truncated_total"),
        (F.col("total_docs") - longer).alias("kept_whole"),
        ((F.col("total_docs") - longer) / F.col("total_docs")).alias("quantile"),
        "total_docs",
        "total_tokens",
    )


def token_counts(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The length histogram of a table of texts.

    Null and empty texts have length 0; repeated rows count each time. Texts are encoded whole, however long. Other
    columns are not read, so their names can't clash. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    return length_histogram(docs.select(token_length(F.col(text), vocabulary).alias("n_tokens")))
