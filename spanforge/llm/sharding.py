"""Sharding by histogram sort, in DataFrame operations only.

Splitters are found without sorting: each round counts, over all partitions, the exact bytes and rows below
candidate key boundaries and narrows the bracket of every splitter, until the bracket is down to one key or
within the tolerance. Only narrow (key, tie, size) columns are read again in these rounds. Then the rows are
exchanged once, to cells (parts of shards), and numbered inside their cell; exact counts below each cell give
the gapless slot in the shard. A key that many rows share is split by the hash of the row, and rows that are equal
in every column by their count, as it doesn't matter which of them goes where. Rows are never kept together for
having equal texts: a group of copies is dealt in key order like any other rows, or the sizes would not be near equal.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, fresh

PROBES = 64
MAX_CELLS = 8192
LOWEST, HIGHEST = -(2**63), 2**63 - 1
WIDE = "decimal(20,0)"


@dataclass(frozen=True)
class Edge:
    """A boundary: so many bytes and rows are before it, those with (key, tie) < (key, tie) of the edge and `inside`
    of those equal to it."""

    key: int
    tie: int
    bytes: int
    rows: int
    inside: int = 0


def _index(value: Column, edges: list, literal) -> Column:
    """How many of the sorted edges are at or below value, by a search in two levels."""
    step = max(1, int(len(edges) ** 0.5))
    groups = [edges[i : i + step] for i in range(0, len(edges), step)]
    coarse = F.size(F.filter(F.array(*[literal(g[0]) for g in groups]), lambda e: e <= value))
    inner = F.element_at(F.array(*[F.array(*[literal(e) for e in g]) for g in groups]), F.greatest(coarse, F.lit(1)))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * step + F.size(F.filter(inner, lambda e: e <= value)))


def refine(rows: DataFrame, column: str, targets: list[int], tolerance: int, low: int, high: int, total: tuple[int, int], before: tuple[int, int] = (0, 0)) -> dict[int, tuple]:
    """For each target byte count, the bracket (lo, hi) of boundaries around it with exact counts.

    Boundaries are (position, bytes below, rows below). A bracket is final when it is one position wide or one
    of its ends is within the tolerance. Each round collects at most PROBES counts for each open bracket.
    """
    first, last = (low, *before), (high + 1, before[0] + total[0], before[1] + total[1])
    brackets = {t: (first, last) for t in targets}

    def done(t: int) -> bool:
        lo, hi = brackets[t]
        return hi[0] - lo[0] <= 1 or min(abs(t - lo[1]), abs(hi[1] - t)) <= tolerance

    while open_ := sorted({b for t, b in brackets.items() if not done(t)}):
        probes = max(4, min(PROBES, 131072 // len(open_)))
        starts = [b[0][0] for b in open_]
        ends = [b[1][0] for b in open_]
        widths = [-(-(e - s) // probes) for s, e in zip(starts, ends)]
        at = _index(F.col(column), starts, F.lit) if len(starts) > 1 else F.when(F.col(column) >= starts[0], 1).otherwise(0)
        pick = lambda xs, i: F.element_at(F.array(*[F.lit(x).cast("long") for x in xs]), i)
        found = (
            rows.select(F.col(column), "size", at.alias("at"))
            .where("at > 0")
            .where(F.col(column) <= pick([e - 1 for e in ends], F.col("at")))
            # decimals: differences of 64-bit keys can pass 63 bits
            .select("at", "size", (F.col(column).cast(WIDE) - pick(starts, F.col("at")).cast(WIDE)).alias("off"), F.element_at(F.array(*[F.lit(str(w)).cast(WIDE) for w in widths]), F.col("at")).alias("w"))
            .select("at", "size", F.expr("cast((off - off % w) / w as int)").alias("bin"))
            .groupBy("at", "bin")
            .agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
            .collect()
        )
        cells: dict[int, dict[int, tuple[int, int]]] = {}
        for r in found:
            cells.setdefault(r["at"] - 1, {})[r["bin"]] = (r["b"], r["n"])
        for i, (lo, hi) in enumerate(open_):
            edges, b, n = [lo], lo[1], lo[2]
            for k, (db, dn) in sorted(cells.get(i, {}).items()):
                # the edge before this bin's rows, and the one after them
                if (p := lo[0] + k * widths[i]) > edges[-1][0]:
                    edges.append((p, b, n))
                b, n = b + db, n + dn
                edges.append((min(lo[0] + (k + 1) * widths[i], hi[0]), b, n))
            if edges[-1][0] < hi[0]:
                edges.append(hi)
            below = [e[1] for e in edges]
            for t, old in brackets.items():
                if old == (lo, hi):
                    j = min(max(bisect_right(below, t) - 1, 0), len(edges) - 2)
                    brackets[t] = (edges[j], edges[j + 1])
    return brackets


def splitters(keys: DataFrame, parts: int, tolerance: int = 0) -> tuple[list[Edge], tuple[int, int]]:
    """parts - 1 edges that cut (key, tie, size) rows into parts of nearly equal bytes, and the totals.

    With tolerance 0 each edge is the one nearest to its share, ties to the lower. Rows equal in key and tie have
    equal sizes.
    """
    t = keys.agg(F.min("key"), F.max("key"), F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    total = (t[2], t[3])
    if not total[1]:
        return [Edge(LOWEST, LOWEST, 0, 0)] * (parts - 1), total
    targets = [total[0] * i // parts for i in range(1, parts)]
    brackets = refine(keys, "key", targets, tolerance, t[0], t[1], total)
    within: dict[int, dict] = {}
    for target, (lo, hi) in brackets.items():
        # one key is left and holds several rows: look inside it
        if hi[0] - lo[0] == 1 and hi[2] - lo[2] > 1 and min(target - lo[1], hi[1] - target) > tolerance:
            within.setdefault(lo[0], {"lo": lo, "hi": hi, "targets": []})["targets"].append(target)
    found: dict[int, tuple] = {}
    for key, x in within.items():
        own = keys.where(F.col("key") == key)
        size = (x["hi"][1] - x["lo"][1], x["hi"][2] - x["lo"][2])
        for target, (lo, hi) in refine(own, "tie", x["targets"], tolerance, LOWEST, HIGHEST, size, x["lo"][1:]).items():
            found[target] = tuple(Edge(key, e[0], e[1], e[2]) if e[0] <= HIGHEST else Edge(key + 1, LOWEST, e[1], e[2]) for e in (lo, hi))
    out = []
    for target in targets:
        lo, hi = found.get(target) or tuple(Edge(e[0], LOWEST, e[1], e[2]) for e in brackets[target])
        if (n := hi.rows - lo.rows) > 1 and target in found and lo.key == hi.key and hi.tie - lo.tie == 1 and hi.bytes > lo.bytes:
            # equal rows: as many of them as come nearest
            each = (hi.bytes - lo.bytes) // n
            k = min(n, max(0, (2 * (target - lo.bytes) + each - 1) // (2 * each)))
            out.append(Edge(lo.key, lo.tie, lo.bytes + k * each, lo.rows + k, k) if k < n else hi)
        else:
            out.append(lo if target - lo.bytes <= hi.bytes - target else hi)
    return out, total


def histogram_sort_shards(df: DataFrame, n_shards: int, key: str = "doc_id", size: Column | None = None, tolerance: int = 0, cell_rows: int = 4096, shard_name: str = "shard", slot_name: str = "slot") -> DataFrame:
    """df with the shard (0 to n_shards - 1, nearly equal bytes, ordered by key) and the slot in it.

    key: a column of integers; a null key comes first. size: bytes of a row as an integer column, 1 if not
    given. tolerance: bytes by which a boundary may miss its share; 0 takes the nearest boundary there is.
    cell_rows: about how many rows one task sorts. Rows equal in every column have one size and may be split. Long
    texts are one row each, whatever their share. An empty table gives no rows. Further columns pass through; slot and
    shard come last, with an underscore before a name that df has.
    """
    spark = df.sparkSession
    k, t, s, cell, row, slot_name, shard_name = fresh(df, "key", "tie", "size", "cell", "row", slot_name, shard_name)
    position = F.coalesce(F.col(key).cast("long"), F.lit(LOWEST))
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    full = df.withColumns({k: position, t: tie, s: (F.lit(1) if size is None else size).cast("long")})
    work = Workspace(spark, "histogram-sort")
    keys = work.stash(full.select(F.col(k).alias("key"), F.col(t).alias("tie"), F.col(s).alias("size")), "keys")
    edges, (n_bytes, n_rows) = splitters(keys, n_shards, tolerance)
    per_shard = max(1, min(MAX_CELLS // n_shards, -(-n_rows // (n_shards * cell_rows))))
    inner = [] if per_shard == 1 else splitters(keys, n_shards * per_shard, max(1, n_bytes // (n_shards * per_shard) // 10))[0]
    work.drop()
    place = lambda e: (e.key, e.tie)
    # a cell begins before the rows equal to its edge; slots and shards follow from the number of the row in all
    cells = sorted({place(e): e for e in [*inner, *edges]}.values(), key=place)
    base = [0, *(e.rows - e.inside for e in cells)]
    firsts = sorted(e.rows for e in edges)
    literal = lambda e: F.struct(F.lit(e.key).cast("long").alias("key"), F.lit(e.tie).cast("long").alias("tie"))
    at = _index(F.struct(F.col(k).alias("key"), F.col(t).alias("tie")), cells, literal) if cells else F.lit(0)
    pick = lambda xs, kind: F.element_at(F.array(*[F.lit(x).cast(kind) for x in xs]), F.col(cell) + 1)
    number = F.row_number().over(Window.partitionBy(cell).orderBy(k, t))
    numbered = full.withColumn(cell, at).withColumn(row, pick(base, "long") + number - 1)
    shard = _index(F.col(row), firsts, lambda v: F.lit(v).cast("long")).cast("int") if firsts else F.lit(0)
    start = F.element_at(F.array(*[F.lit(x).cast("long") for x in [0, *firsts]]), shard + 1)
    return numbered.withColumns({slot_name: F.col(row) - start, shard_name: shard}).drop(k, t, s, cell, row)
