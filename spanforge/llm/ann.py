"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

1. Equal vectors form a class, known by a 128-bit hash of the vector; of a class only the k + 1 smallest ids can
   be among k nearest. Only one row per class goes on, however many copies there are.
2. Rotations are learned on a bounded sample, so that the signs of the rotated vectors lose little (iterative
   quantization). A code has BITS bits; the first INDEXED of them are cut into substrings.
3. The index posts a class under each (substring, value). A query probes, in each substring, the values within its
   share of the radius: by the pigeonhole principle no code whose indexed part is within the radius is missed.
   A posting met is kept if the whole code is within its radius too, at the first substring that meets only.
   A value that many classes have is dealt over several salts.
4. The classes kept are reranked by the exact cosine of the original vectors.

The two radii hold a stated share of the true neighbours of a bounded number of sample vectors, which are looked
for among all rows; so they shrink as the table gets denser. A query with too few candidates asks again with
wider radii, up to the whole space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from .common import Workspace, shuffled, small

# Rows that the rotations, and those that the radii are fitted on; bits of a code, of its indexed part, of a substring.
SAMPLE, FIT_QUERIES = 20_000, 200
BITS, INDEXED, SUBSTRING = 256, 64, 8
RECALL = 0.97
# Classes posted under one value and salt; bytes up to which query vectors are broadcast.
POSTINGS, BROADCAST_BYTES = 4096, 32 << 20
WORD = 64


@dataclass
class Codes:
    """The learned coding: mean, rotation (dimensions x bits), and the radii of the indexed part and of the whole code."""

    mean: np.ndarray
    rotation: np.ndarray
    radii: tuple[int, int] = (INDEXED, BITS)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Rows of 64-bit words."""
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        signs = (unit - self.mean) @ self.rotation > 0
        return np.packbits(signs, axis=1, bitorder="little").view("<i8")


def learn_rotation(x: np.ndarray, bits: int, rounds: int = 30, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Mean and rotation by iterative quantization; several rotations side by side if bits pass the dimensions."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    mean = unit.mean(axis=0)
    centred, d = unit - mean, x.shape[1]
    rng, parts = np.random.default_rng(seed), []
    while sum(p.shape[1] for p in parts) < bits:
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(rounds):
            signs = np.where(centred @ r > 0, 1.0, -1.0)
            u, _, vt = np.linalg.svd(signs.T @ centred)
            r = (u @ vt).T
        parts.append(r)
    return mean, np.concatenate(parts, axis=1)[:, :bits]


def bits_set(words: np.ndarray) -> np.ndarray:
    """Ones in signed words; numpy would count those of the absolute value."""
    return np.bitwise_count(words.view(np.uint64))


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between the codes of a and of b."""
    return bits_set(a[:, None, :] ^ b[None, :, :]).sum(axis=2, dtype=np.int64)


def shares(radius: int, parts: int) -> list[int]:
    """Substring radii of which one must hold for any code within the radius: they sum to radius - parts + 1."""
    low, more = divmod(radius + 1, parts)
    return [low + (j < more) - 1 for j in range(parts)]


def probe_masks(radius: int) -> dict[int, list[int]]:
    """For each substring that has to be probed, what its value is combined with: all masks within its share."""
    own = shares(radius, INDEXED // SUBSTRING)
    for j, share in enumerate(own):
        if share >= SUBSTRING:  # any value: this substring alone finds everything
            return {j: list(range(1 << SUBSTRING))}
    return {j: [m for m in range(1 << SUBSTRING) if m.bit_count() <= share] for j, share in enumerate(own) if share >= 0}


def substring(word: Column, j: int) -> Column:
    return F.shiftrightunsigned(word, SUBSTRING * j).bitwiseAND(F.lit((1 << SUBSTRING) - 1)).cast("int")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def usable(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, x, cls: rows with an id and a finite vector that isn't zero or empty; equal vectors have one cls.

    Vectors of doubles whose squares could overflow or vanish are scaled, which leaves their cosines as they are.
    """
    ok = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("x"))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("x") > 0) & F.forall("x", ok) & F.exists("x", lambda v: v != 0))
    if isinstance(rows.schema["x"].dataType.elementType, DoubleType):
        most = F.array_max(F.transform("x", F.abs))
        rows = rows.withColumn("x", F.when((most > 1e100) | (most < 1e-100), F.transform("x", lambda v: v / most)).otherwise(F.col("x")))
    return rows.withColumn("cls", F.struct(F.xxhash64("x").alias("a"), F.xxhash64(F.lit(1), "x").alias("b")))


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """cls, x, members (the k + 1 smallest ids): one row per class; copies are cut before the shuffle."""
    place = F.row_number().over(Window.partitionBy("cls").orderBy("vec_id"))
    few = rows.withColumn("place", place).where(F.col("place") <= k + 1)
    return few.groupBy("cls").agg(F.first("x").alias("x"), F.array_sort(F.collect_list("vec_id")).alias("members"))


def sample_of(classes: DataFrame, n: int, most: int) -> np.ndarray:
    """At most `most` vectors, of the length that most of them have, chosen by their hash."""
    share = min(1.0, 0.98 * most / max(1, n))
    some = classes.where(F.col("cls.a") < int(2**63 * (2 * share - 1))) if share < 1 else classes
    got = some.select("cls", "x").limit(most).toPandas()
    if not len(got):
        return np.zeros((0, 0))
    got = got.iloc[sorted(range(len(got)), key=lambda i: tuple(got["cls"].iloc[i]))]
    lengths = got["x"].map(len)
    return np.stack(got["x"][lengths == int(lengths.mode()[0])].to_numpy()).astype(float)


def code_udf(codes: Codes):
    @F.pandas_udf("array<long>")
    def code(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for xs in batches:
            yield pd.Series(list(codes.encode(np.stack(xs.to_numpy()).astype(float))) if len(xs) else [], dtype=object)

    return code


def neighbour_distances(classes: DataFrame, codes: Codes, x: np.ndarray, k: int) -> np.ndarray:
    """Hamming distances (indexed part, whole code) to the k classes nearest to each row of x, among all classes."""
    unit, own = x / np.linalg.norm(x, axis=1, keepdims=True), codes.encode(x)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            y = np.stack(b["x"].to_numpy()).astype(float)
            score = unit @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
            top = np.argpartition(-score, min(k, len(y) - 1), axis=1)[:, : k + 1]
            at = np.repeat(np.arange(len(x)), top.shape[1])
            apart = bits_set(own[at] ^ np.stack(b["code"].to_numpy())[top.ravel()])
            yield pd.DataFrame({"q": at, "score": score[at, top.ravel()], "first": apart[:, : INDEXED // WORD].sum(axis=1), "all": apart.sum(axis=1)}).astype({"first": "int32", "all": "int32"})

    found = classes.select("x", "code").mapInPandas(scan, "q long, score double, first int, all int")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "all"))
    # the nearest is the row itself
    got = found.withColumn("rank", rank).where((F.col("rank") > 1) & (F.col("rank") <= k + 1)).select("first", "all").toPandas()
    return got.to_numpy()


def wider(radii: tuple[int, int]) -> tuple[int, int]:
    return min(INDEXED, radii[0] + INDEXED // 8), min(BITS, radii[1] + BITS // 8)


def retrieve(asked: DataFrame, classes: DataFrame, radii: tuple[int, int], salts: list[int]) -> DataFrame:
    """q, v: the classes whose codes are within the radii of each asked class, by probing the substrings."""
    parts, masks = INDEXED // SUBSTRING, probe_masks(radii[0])
    words = [F.element_at("code", i + 1).alias(f"c{i}") for i in range(BITS // WORD)]
    first, key = F.element_at("code", 1), lambda j, value: F.lit(j << SUBSTRING) + value
    salt_of = F.element_at(F.lit(salts), F.col("key") + 1)
    posted = F.explode(F.array(*[key(j, substring(first, j)) for j in masks])).alias("key")
    posts = classes.select(F.col("cls").alias("v"), *words, posted).withColumn("salt", F.pmod(F.xxhash64("v"), salt_of).cast("int"))
    ball = lambda j, own: F.transform(F.lit(own), lambda m: key(j, substring(first, j).bitwiseXOR(m.cast("int"))))
    probed = F.explode(F.concat(*[ball(j, own) for j, own in masks.items()])).alias("key")
    probes = asked.select(F.col("cls").alias("q"), *words, probed).withColumn("salt", F.explode(F.sequence(F.lit(0), salt_of - 1)))
    met = probes.alias("p").join(shuffled(posts.alias("s")), ["key", "salt"])
    apart = [F.bit_count(F.col(f"p.c{i}").bitwiseXOR(F.col(f"s.c{i}"))) for i in range(BITS // WORD)]
    near = apart[0] <= radii[0] if INDEXED == WORD else sum(apart[1 : INDEXED // WORD], apart[0]) <= radii[0]
    differ, own = F.col("p.c0").bitwiseXOR(F.col("s.c0")), shares(radii[0], parts)
    at = F.coalesce(*[F.when(F.bit_count(substring(differ, j)) <= own[j], F.lit(j)) for j in masks])
    whole = sum(apart[1:], apart[0]) <= radii[1]
    return met.where(near & whole & (at == F.shiftright("key", SUBSTRING))).select("q", "v")


def nearest(asked: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, dimensions: int) -> DataFrame:
    """q, best: the k + 1 nearest rows among the pairs, as structs (negative score, vec_id, own: of the query's class)."""
    norm = lambda c: F.sqrt(total(F.transform(c, lambda v: v.cast("double") * v.cast("double"))))
    left = asked.select(F.col("cls").alias("q"), F.col("x").alias("a"), norm("x").alias("na"))
    right = classes.select(F.col("cls").alias("v"), F.col("x").alias("b"), norm("x").alias("nb"), "members")
    both = pairs.join(shuffled(right), "v").join(small(left, BROADCAST_BYTES // (8 * dimensions + 32)), "q")
    dot = total(F.zip_with("a", "b", lambda a, b: a.cast("double") * b.cast("double")))
    scored = both.select("q", "members", (F.col("q") == F.col("v")).alias("own"), (dot / (F.col("na") * F.col("nb"))).alias("score"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("members")[0])
    top = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)
    one = F.transform("members", lambda i: F.struct((-F.col("score")).alias("far"), i.alias("vec_id"), F.col("own").alias("own")))
    return top.groupBy("q").agg(F.slice(F.array_sort(F.flatten(F.collect_list(one))), 1, k + 1).alias("best"))


def search(df: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", embedding: str = "embedding", sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose id is divisible by `every`.

    Every row but the query's own is a candidate, rows that repeat it or its id included. Scores are exact cosines
    in double precision; ties go to the smaller vec_id. Vectors that are null, empty, zero or hold nulls or values
    that aren't finite take no part, nor do those of another length than most of the sample. With k or fewer
    candidates all are returned. An empty table gives no rows. Other columns are not read.
    """
    empty = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    work = Workspace(df.sparkSession, "ann")
    rows = usable(df, vec_id, embedding)
    classes = work.stash(classes_of(rows, k), "classes")
    x = sample_of(classes, classes.count(), sample)
    if not len(x):
        return empty
    d = x.shape[1]
    codes = Codes(*learn_rotation(x, BITS))
    classes = work.stash(classes.where(F.size("x") == d).withColumn("code", code_udf(codes)("x")), "codes")
    rows = work.stash(rows.where((F.size("x") == d) & (F.col("vec_id") % every == 0)).select("vec_id", "cls"), "queries")
    asked = classes.join(small(rows.select("cls").distinct(), BROADCAST_BYTES // 128), "cls", "left_semi")
    asked = work.stash(asked.select("cls", "x", "code"), "asked")
    apart = neighbour_distances(classes, codes, x[:: max(1, len(x) // FIT_QUERIES)][:FIT_QUERIES], k)
    radii = tuple(int(np.ceil(np.quantile(apart[:, i], recall))) for i in (0, 1)) if len(apart) else (INDEXED, BITS)
    # rows of each class up to k + 1: enough to know whether a query can have k
    others = min(k, classes.select(F.size("members").alias("n")).agg(F.sum("n")).first()[0] - 1)
    posted = F.explode(F.array(*[F.lit(j << SUBSTRING) + substring(F.element_at("code", 1), j) for j in range(INDEXED // SUBSTRING)]))
    found = {r["key"]: r["n"] for r in classes.select(posted.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()}
    salts = [max(1, -(-found.get(i, 0) // POSTINGS)) for i in range(INDEXED // SUBSTRING << SUBSTRING)]

    out, left = None, asked
    while True:
        best = work.stash(nearest(left, classes, work.stash(retrieve(left, classes, radii, salts), "pairs"), k, d), "best")
        enough = F.size("best") > others
        part = best if radii == (INDEXED, BITS) else best.where(enough)
        out = part if out is None else out.unionByName(part)
        if radii == (INDEXED, BITS):
            break
        left = work.stash(left.join(shuffled(best.where(enough).select(F.col("q").alias("cls"))), "cls", "left_anti"), "left")
        if left.isEmpty():
            break
        radii = wider(radii)
    found = rows.join(small(out.withColumnRenamed("q", "cls"), BROADCAST_BYTES // (64 * (k + 1))), "cls")
    mine = F.array_position(F.transform("best", lambda e: e["own"] & (e["vec_id"] == F.col("vec_id"))), F.lit(True))
    rest = F.slice(F.filter("best", lambda e, i: (i + 1) != F.col("mine")), 1, k)
    ranked = found.withColumn("mine", mine).select(F.col("vec_id").alias("query_id"), F.posexplode(rest).alias("at", "one"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("one.vec_id").alias("vec_id"), (-F.col("one.far")).alias("score"))
