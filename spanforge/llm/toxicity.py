"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

The features of a text are densities: words of a fixed lexicon and of one learned from labelled texts, their
distance to words of the second person, capitals, punctuation, and obfuscated spellings. Each distinct token
is analysed once per worker and remembered; a text is then a gather and a few sums over its whole length.
The model is fitted on the driver from a bounded sample of labelled rows (SAMPLE). For the trees and the
calibration each half of the sample is scored with the lexicon learned from the other half, so that no word
vouches for itself; the lexicon that is kept comes from both.
"""

from __future__ import annotations

import re
import warnings
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, fresh, release, small_batches

# Most labelled rows that the model is fitted on, and most learned lexicon entries.
SAMPLE, LEARNED = 20_000, 20_000
THRESHOLD = 0.3
# Log likelihood ratio from which an entry is learned: by chance, one unit in some 10,000 reaches it.
LEAST_GAIN = 9.0

# Insults and words of the second person in the languages served.
LEXICON = set(
    """idiot idiots idiotic moron morons moronic stupid dumb dumbass loser losers scum trash garbage clown pathetic worthless
    disgusting filthy vermin imbecile retard freak creep pig coward liar hate kill bastard bitch asshole fool ugly shut
    dumm dumme dummkopf trottel arschloch abschaum idioten versager widerlich hässlich hasse blöd
    connard imbécile crétin débile salaud ordure pourriture stupide nul dégoûtant
    estúpido estúpida imbécil inútil basura asqueroso patético patética perdedor payaso odio tonto""".split()
)
SECOND_PERSON = set("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre vos tú ti tuyo usted ustedes vosotros".split())
LEET = str.maketrans("013457@$!|", "oieastasii")
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W\d_]")
_REPEAT = re.compile(r"(.)\1{2,}")

COLUMNS = ["chars", "upper", "punct", "loud", "digits", "shout", "lexicon", "learned", "obfuscated", "hidden", "second", "repeat"]
PREFIXES = range(3, 8)


def units(word: str) -> list[str]:
    """What the learned lexicon may hold of a word: the word, and its beginnings, marked by a star."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


def plain(token: str) -> str:
    return _EDGE.sub("", token).lower()


def token_row(token: str, learned: dict[str, float]) -> list[float]:
    """The features of one token."""
    core = token.strip(MARKS)
    loud = token.count("!") + token.count("?")
    if core.isalpha():  # most tokens: letters, with marks around them at most
        word, letters, digits, masked = core.lower(), len(core), 0, False
        upper = 0 if core == word else sum(map(str.isupper, core))
        marks, shown = len(token) - letters, word
    else:
        word = plain(token)
        letters, upper, digits = (sum(map(f, token)) for f in (str.isalpha, str.isupper, str.isdigit))
        marks = len(token) - sum(map(str.isalnum, token))
        masked = bool(_INNER.search(word)) and any(map(str.isalpha, word))
        shown = _INNER.sub("", word.translate(LEET)) if masked else word
    single = _REPEAT.sub(r"\1", shown)
    in_lexicon = word in LEXICON
    score = max((learned.get(u, 0.0) for u in units(word)), default=0.0) if learned and word else 0.0
    hidden = not in_lexicon and (shown in LEXICON or single in LEXICON)
    if not score and learned and (masked or single != word):
        score = max(max(learned.get(u, 0.0) for u in units(w)) if w else 0.0 for w in (shown, single))
    return [len(token), upper, marks, loud, digits, float(letters > 2 and upper == letters), float(in_lexicon), score, float(masked), float(hidden), float(word in SECOND_PERSON), float(single != shown)]


class TokenTable:
    """Feature rows of the tokens seen, at most `most` of them at a time."""

    def __init__(self, learned: dict[str, float], most: int = 120_000):
        self.learned, self.most = learned, most
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.rows = np.zeros((1 << 14, len(COLUMNS)), dtype=np.float32)

    def __call__(self, tokens: list[str]) -> np.ndarray:
        if new := {t for t in tokens if t not in self.ids}:
            if len(self.ids) + len(new) > self.most:
                self.clear()
                new = set(tokens)
            for t in new:
                if (i := len(self.ids)) == len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                self.rows[i] = token_row(t, self.learned)
                self.ids[t] = i
        return self.rows[np.fromiter(map(self.ids.__getitem__, tokens), dtype=np.int64, count=len(tokens))]


NEAR = 5
FEATURES = ["lexicon density", "lexicon count", "learned sum density", "learned sum", "learned max", "learned density", "learned count", "near second person", "near count", "second person", "capitals", "shouting", "punctuation", "loud marks", "digits", "obfuscation", "hidden lexicon", "repeats", "log words"]


def features(text: str | None, table: TokenTable) -> np.ndarray:
    """The feature vector of a whole text; zeros if it has no words."""
    tokens = text.split() if text else []
    if not tokens:
        return np.zeros(len(FEATURES), dtype=np.float32)
    m = table(tokens)
    n = len(tokens)
    s = m.sum(axis=0, dtype=np.float64)
    c = dict(zip(COLUMNS, s))
    learned = m[:, 7]
    hit = (learned > 0) | (m[:, 6] > 0) | (m[:, 9] > 0)
    cum = np.concatenate([[0.0], np.cumsum(m[:, 10])])
    at = np.nonzero(hit)[0]
    near = float(np.count_nonzero(cum[np.minimum(at + NEAR + 1, n)] - cum[np.maximum(at - NEAR, 0)]))
    k, chars = float(np.count_nonzero(learned)), max(c["chars"], 1.0)
    return np.array([c["lexicon"] / n, c["lexicon"], c["learned"] / n, c["learned"], learned.max(), k / n, k, near / n, near, c["second"] / n, c["upper"] / chars, c["shout"] / n, c["punct"] / chars, c["loud"] / chars, c["digits"] / chars, c["obfuscated"] / n, c["hidden"], c["repeat"] / n, np.log1p(n)], dtype=np.float32)


@dataclass
class Trees:
    """Boosted trees of equal depth: split features and values by level order, and leaf values."""

    depth: int
    base: float
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), dtype=np.int64))
    value: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), dtype=np.float32))
    leaf: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, v, leaf in zip(self.feature, self.value, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > v[node])
            out += leaf[node - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, l2: float = 5.0) -> Trees:
    """Fit boosted trees to labels by second-order logistic loss over quantile bins."""
    prior = min(max(y.mean(), 1e-4), 1 - 1e-4)
    model = Trees(depth, float(np.log(prior / (1 - prior))))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])).astype(np.float32) for j in range(x.shape[1])]
    # rare positive values have no quantile of their own
    cuts = [np.unique(np.concatenate([[np.float32(0)], c, np.quantile(p, np.linspace(0, 1, 9)[:-1]).astype(np.float32)])) if len(p := x[:, j][x[:, j] > 0]) else c for j, c in enumerate(cuts)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    width = max(len(c) for c in cuts) + 1
    margin, inner = np.full(len(y), model.base), 2**depth - 1
    out_f, out_v, out_l = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        f, v = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf, dtype=np.float32)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            best = np.zeros(count)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                at = (node - first) * width + binned[:, j]
                gs = np.bincount(at, g, count * width).reshape(count, width)
                hs = np.bincount(at, h, count * width).reshape(count, width)
                gl, hl = np.cumsum(gs, 1)[:, : len(c)], np.cumsum(hs, 1)[:, : len(c)]
                gt, ht = gs.sum(1)[:, None], hs.sum(1)[:, None]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(hl < 0.5) | (ht - hl < 0.5)] = 0
                k = gain.argmax(1)
                top = gain[np.arange(count), k]
                for i in np.nonzero(top > best + 1e-9)[0]:
                    best[i], f[first + i], v[first + i] = top[i], j, c[k[i]]
            node = 2 * node + 1 + (x[np.arange(len(y)), f[node]] > v[node])
        at = node - inner
        leaf = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + l2)
        margin += leaf[at]
        out_f.append(f)
        out_v.append(v)
        out_l.append(leaf)
    model.feature, model.value, model.leaf = np.array(out_f), np.array(out_v), np.array(out_l)
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y on score (pool adjacent violators); equal scores are one place."""
    blocks: list[list[float]] = []
    places, at = np.unique(score, return_inverse=True)
    for s, t, k in zip(places.tolist(), np.bincount(at, y).tolist(), np.bincount(at).tolist()):
        blocks.append([s, t, k])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            a = blocks.pop()
            blocks[-1] = [(blocks[-1][0] * blocks[-1][2] + a[0] * a[2]) / (blocks[-1][2] + a[2]), blocks[-1][1] + a[1], blocks[-1][2] + a[2]]
    # half a row of each label at the ends keeps the scores inside (0, 1)
    n = len(y) + 2.0
    return np.array([b[0] for b in blocks]), np.clip([b[1] / b[2] for b in blocks], 0.5 / n, 1 - 0.5 / n)


@dataclass
class Model:
    learned: dict[str, float]
    trees: Trees | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities. Without enough labels: how much of the lexicon a text holds."""
        if self.trees is None:
            hits = x[:, 1].astype(float) + x[:, 16]
            return hits / (hits + 2)
        return np.interp(self.trees.margin(x), *self.knots)


def learn_lexicon(sample: DataFrame, most: int = LEARNED) -> dict[str, float]:
    """Words and beginnings of words whose share of toxic texts stands out: unit -> log odds."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        seen = {0: Counter(), 1: Counter()}
        for b in batches:
            for t, y in zip(b["text"], b["toxic"]):
                seen[int(y)].update({u for w in {plain(x) for x in (t or "").split()} if w for u in units(w)})
                if len(seen[0]) > 100_000:
                    yield pd.DataFrame([(u, seen[1].pop(u, 0), n) for u, n in seen[0].items()], columns=["unit", "bad", "good"])
                    seen[0] = Counter()
        yield pd.DataFrame([(u, seen[1][u], seen[0][u]) for u in {*seen[0], *seen[1]}], columns=["unit", "bad", "good"])

    sizes = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return {}
    counts = sample.select("text", "toxic").mapInPandas(count, "unit string, bad long, good long").groupBy("unit").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    # log likelihood ratio of the unit's own share of toxic texts against the overall one
    seen, prior = F.col("bad") + F.col("good"), bad / (bad + good)
    gain = F.col("bad") * F.log(F.col("bad") / seen / prior) + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / seen / (1 - prior))).otherwise(0.0)
    kept = counts.where("bad > 0").withColumns({"odds": odds, "gain": gain}).where((F.col("odds") > 1.5) & (F.col("gain") > LEAST_GAIN))
    kept = kept.orderBy(F.desc("gain"), "unit").limit(most)
    return {r["unit"]: float(r["odds"]) for r in kept.collect()}


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from at most `sample` labelled rows, chosen by the hash of their id.

    Labels other than 0 and 1 are left out; a row labelled twice is toxic if one of its labels says so. With
    fewer than 10 rows of either label, or 5 in a fold, the model is the fixed lexicon alone, and a warning says so.
    doc_id: any type that both tables share. The learned lexicon has LEARNED entries at most, the most telling ones.
    """
    small_batches(docs.sparkSession)
    work = Workspace(docs.sparkSession, "toxicity")
    one = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("toxic"))
    chosen = one.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text"))
    rows = texts.join(F.broadcast(chosen), "_id")  # at most `sample` rows
    rows = work.stash(rows.withColumn("half", F.pmod(F.xxhash64("_id", F.lit("half")), F.lit(4)) < 2), "sample")
    learned, first, second = (learn_lexicon(x) for x in (rows, rows.where("half"), rows.where("not half")))

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        tables = {True: TokenTable(second), False: TokenTable(first)}
        for b in batches:
            yield pd.DataFrame({"x": [features(t, tables[h]) for t, h in zip(b["text"], b["half"])], "toxic": b["toxic"], "id": b["_id"].astype(str)})

    got = rows.mapInPandas(vectors, "x array<float>, toxic int, id string").toPandas()
    got = got.iloc[sorted(range(len(got)), key=lambda i: (zlib.crc32(got["id"].iloc[i].encode()), got["id"].iloc[i], got["toxic"].iloc[i], tuple(got["x"].iloc[i])))]
    work.drop()
    y = got["toxic"].to_numpy(dtype=float)
    fold = np.arange(len(y)) % 3 == 0
    counts = [int(side.sum()) for part in (y[fold], y[~fold]) for side in (part, 1 - part)]
    if counts[0] + counts[2] < 10 or counts[1] + counts[3] < 10 or min(counts) < 5:
        warnings.warn(f"too few labels to fit trees: {counts[0] + counts[2]} toxic, {counts[1] + counts[3]} clean; scores come from the fixed lexicon", stacklevel=2)
        return Model(learned)
    x = np.stack(got["x"].to_numpy())
    trees = boost(x[~fold], y[~fold])
    return Model(learned, trees, isotonic(trees.margin(x[fold]), y[fold]))


def toxicity_score(text: Column, model: Model) -> Column:
    """The calibrated score of a whole text, 0 to 1; null and empty texts are scored as texts without words."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release()
        table = TokenTable(model.learned)
        for b in batches:
            yield pd.Series(model.score(np.stack([features(t, table) for t in b])) if len(b) else [], dtype="float64")

    return scores(text)


def held_out(doc_id: Column) -> Column:
    """Whether labels of a row may not be learned from: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """docs with the score in a last column, with an underscore before its name if docs has it.

    Texts of any length are scored whole; null and empty ones as texts without words. Repeated rows stay repeated and
    score the same. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    return docs.withColumn(fresh(docs, column)[0], toxicity_score(F.col(text), model))
