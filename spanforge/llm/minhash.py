"""MinHash near-duplicates by a signature-coordinate inverted join.

1. Each document becomes the set of its word shingles; documents with equal sets form a class, and only one
   row per class goes on, however many copies there are.
2. A class is posted under each of its (coordinate, value) pairs. Pairs that meet on at least `matches` of the
   `coordinates` must meet in the rarest coordinates - matches + 1 of either (prefix). Postings with one class
   are skipped, and so is every class with fewer than `matches` shared postings.
3. The classes that share prefix postings form clusters. In a cluster, collisions are counted over whole
   signatures; pairs above the match threshold are confirmed on their full sets and joined in a forest, and
   a pair that is connected already needs no test. A cluster larger than a task's share is first compared with
   a few pivots; what is not connected to its largest part is then compared with all of it, in blocks.
4. Components of the confirmed links.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, only, shuffled, small_batches
from .components import connected_components
from .shingles import shingles, word_hashes, words_of

COORDINATES = 32
# Chance that a pair at the threshold is not a candidate.
MISS = 2e-5
PIVOTS, BLOCK = 8, 512
# Shingles of the texts that meet in one block, more or less.
BLOCK_SHINGLES = 4_000_000

_FACTORS = np.random.default_rng(97).integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def match_threshold(coordinates: int, percent: int, miss: float = MISS) -> int:
    """The most matches that a pair with a similarity of percent reaches but for a chance of miss."""
    p, below, k = percent / 100, 0.0, 0
    while k < coordinates:
        below += comb(coordinates, k) * p**k * (1 - p) ** (coordinates - k)
        if below > miss:
            break
        k += 1
    return max(1, k)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    return np.unique(shingles(word_hashes(words_of(text)), n))


def signature(found: np.ndarray, coordinates: int) -> np.ndarray:
    """The least value of each coordinate's permutation over a set, upper 32 bits."""
    out = np.full(coordinates, 2**64 - 1, dtype=np.uint64)
    for i in range(0, len(found), 4096):
        np.minimum(out, (found[i : i + 4096, None] * _FACTORS[:coordinates]).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, doc_id: str, text: str, n: int, coordinates: int) -> DataFrame:
    """doc_id, n_shingles, print (equal for equal sets; null if empty), sig (array of the coordinates' values)."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for b in batches:
            rows = []
            for i, t in zip(b["id"], b["text"]):
                found = shingle_set(t, n)
                if len(found):
                    rows.append((i, len(found), xxhash.xxh3_128_digest(found.tobytes()), signature(found, coordinates).astype(np.int64)))
                else:
                    rows.append((i, 0, None, None))
            out = pd.DataFrame(rows, columns=["doc_id", "n_shingles", "print", "sig"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInPandas(sign, "doc_id long, n_shingles long, print binary, sig array<long>")


def prefixes(classes: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """rep, key, weight: the rarest shared postings of each class that can still reach `matches`."""
    posts = classes.select("rep", F.posexplode("sig").alias("at", "value")).select("rep", (F.shiftleft(F.col("at").cast("long"), 32) + F.col("value")).alias("key"))
    shared = posts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    lists = posts.join(shuffled(shared), "key").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("own"))
    weight = F.aggregate("own", F.lit(0.0), lambda a, x: a + F.log1p(x["n"].cast("double")))
    room = F.size("own") - (matches - 1)
    return lists.where(room >= 1).select("rep", weight.alias("weight"), F.explode(F.slice("own", 1, room)).alias("one")).select("rep", "weight", F.col("one.key").alias("key"))


class Forest:
    """Disjoint sets over row numbers."""

    def __init__(self, labels):
        self.up, first = list(range(len(labels))), {}
        for i, x in enumerate(labels):
            self.up[i] = first.setdefault(x, i)

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def unite(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def confirmed_links(reps: list[int], parts: list[int], texts: list[str], sizes: np.ndarray, signs: np.ndarray, anchors: np.ndarray, n: int, matches: int, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between anchors (a mask) and all rows; rows of equal parts are connected already.

    Only pairs with enough collisions of their signatures, and not connected yet, are compared on their full sets.
    """
    forest, out, known = Forest(parts), [], {}

    def shingled(i: int) -> np.ndarray:
        if i not in known:
            known[i] = shingle_set(texts[i], n)
        return known[i]

    order = np.nonzero(anchors)[0]
    done = np.zeros(len(reps), dtype=bool)
    for i in order:
        done[i] = True
        small, large = np.minimum(sizes, sizes[i]), np.maximum(sizes, sizes[i])
        hits = (signs == signs[i]).sum(axis=1)
        maybe = np.nonzero((hits >= matches) & (100 * small >= percent * large) & ~done)[0]
        for j in maybe[np.argsort(-hits[maybe], kind="stable")]:
            if forest.find(i) == forest.find(j):
                continue
            both = len(np.intersect1d(shingled(i), shingled(j), assume_unique=True))
            if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                forest.unite(i, j)
                out.append((reps[i], reps[j]))
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, coordinates: int = COORDINATES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets; component_id is the
    smallest doc_id reachable, kept marks that document. Without words a document is linked with nothing. Rows
    that share a doc_id are one node. A row without doc_id joins the component of equal texts (and is not
    kept), or has none and is kept. Texts are read whole, however long; those that meet in one task are bounded in
    number and in shingles. An empty table gives no rows; other columns are not read.
    """
    matches = match_threshold(coordinates, percent)
    small_batches(docs.sparkSession)
    work = Workspace(docs.sparkSession, "near-duplicates")
    signed = work.stash(signatures(docs, doc_id, text, n, coordinates), "signatures")
    classes = signed.where("print is not null").groupBy("print").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("size")).where("rep is not null")
    classes = work.stash(classes.select("rep", "sig", "size"), "classes")
    posted = work.stash(prefixes(classes, coordinates, matches), "prefixes")
    hubs = posted.groupBy("key").agg(F.min("rep").alias("hub"))
    star = posted.join(shuffled(hubs), "key").where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    clusters = connected_components(work.stash(star, "stars"), work).withColumnRenamed("node", "rep").withColumnRenamed("component", "cluster")
    weights = posted.groupBy("rep").agg(F.first("weight").alias("weight"))
    clusters = work.stash(clusters.join(shuffled(weights), "rep"), "clusters")
    clusters = clusters.join(shuffled(classes), "rep")
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("m_blocks"))
    clusters = work.stash(clusters.join(shuffled(sizes), "cluster"), "sized")
    about = clusters.select("rep", "sig", "size")
    texts = docs.select(F.col(doc_id).cast("long").alias("rep"), F.col(text).alias("text"))
    texts = work.stash(only(texts, clusters.select("rep"), "rep"), "texts")
    edge = "a long, b long"

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        anchors = pdf["anchor"].to_numpy(dtype=bool)
        links = confirmed_links(pdf["rep"].tolist(), pdf["part"].tolist(), pdf["text"].tolist(), pdf["size"].to_numpy(), np.stack(pdf["sig"].to_numpy()), anchors, n, matches, percent)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    few = clusters.where("m_blocks = 1").select("rep", "cluster", F.col("rep").alias("part"), F.lit(True).alias("anchor"), "sig", "size")
    links = few.join(shuffled(texts), "rep").groupBy("cluster").applyInPandas(compare, edge)
    links = work.stash(links, "links")
    many = clusters.where("m_blocks > 1").drop("sig", "size")
    if not many.isEmpty():
        block = lambda of: F.pmod(F.xxhash64("rep"), of.cast("long")).cast("int")
        # Pivots: the classes whose postings are the most common, found without sorting a cluster in one task.
        top = F.broadcast(_top(many))  # of a block of BLOCK classes or more, PIVOTS
        with_blocks = top.join(many, ["cluster", "rep"]).select("rep", "cluster", F.explode(F.sequence(F.lit(0), F.col("m_blocks") - 1)).alias("block"), F.lit(True).alias("anchor"))
        members = many.select("rep", "cluster", block(F.col("m_blocks")).alias("block"), F.lit(False).alias("anchor"))
        members = members.join(top.withColumn("is_top", F.lit(True)), ["cluster", "rep"], "left").where("is_top is null").drop("is_top")
        round1 = with_blocks.unionByName(members).withColumn("part", F.col("rep"))
        found = work.stash(round1.join(shuffled(about), "rep").join(shuffled(texts), "rep").groupBy("cluster", "block").applyInPandas(compare, edge), "pivot-links")
        parts = connected_components(found.union(many.select(F.col("rep").alias("a"), F.col("rep").alias("b"))), work)
        parts = work.stash(parts.select(F.col("node").alias("rep"), F.col("component").alias("part")).join(shuffled(many), "rep"), "parts")
        by_part = parts.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("k"))
        largest = by_part.groupBy("cluster").agg(F.max_by("part", F.struct("k", "part")).alias("largest"))
        outside = parts.join(F.broadcast(largest), "cluster").where("part <> largest")
        out_size = outside.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("a_blocks"))
        spread = lambda of, name: F.explode(F.sequence(F.lit(0), F.col(of) - 1)).alias(name)
        asks = outside.join(F.broadcast(out_size), "cluster").select("rep", "part", "cluster", block(F.col("a_blocks")).alias("ablock"), spread("m_blocks", "mblock"), F.lit(True).alias("anchor"))
        told = parts.join(F.broadcast(out_size), "cluster").select("rep", "part", "cluster", spread("a_blocks", "ablock"), block(F.col("m_blocks")).alias("mblock"), F.lit(False).alias("anchor"))
        round2 = asks.unionByName(told)
        more = work.stash(round2.join(shuffled(about), "rep").join(shuffled(texts), "rep").groupBy("cluster", "ablock", "mblock").applyInPandas(compare, edge), "outside-links")
        links = links.union(found).union(more)
    joined = connected_components(links, work).withColumnRenamed("node", "rep").withColumnRenamed("component", "component_id")
    keep = signed.where("print is not null").groupBy("print").agg(F.min("doc_id").alias("rep"))
    labelled = keep.join(shuffled(joined), "rep", "left").select("print", F.coalesce("component_id", "rep").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "print").join(shuffled(labelled), "print", "left")
    component = F.when(F.col("print").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _top(many: DataFrame) -> DataFrame:
    """cluster, rep: the PIVOTS classes of the greatest weight in each cluster, by a ranking in two levels."""
    salted = many.withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("m_blocks").cast("long")))
    order = (F.desc("weight"), F.asc("rep"))
    first = salted.withColumn("r", F.row_number().over(Window.partitionBy("cluster", "salt").orderBy(*order))).where(F.col("r") <= PIVOTS)
    return first.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(*order))).where(F.col("r") <= PIVOTS).select("cluster", "rep")
