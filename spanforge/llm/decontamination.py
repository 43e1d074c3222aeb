"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

1. Count, over all documents, how often each test term occurs.
2. Store the postings (term, doc_id, pos) of the rarest terms of every test window.
3. Subtract from each posting the term's offset in the item: equal differences line a document up with an
   item. A window can only occur on a diagonal where all of its rarest terms meet.
4. Compare the windows of these diagonals with the words of the document.

Documents without a diagonal never leave their scan. A diagonal is at most one row for each document and
item position, so a passage that a third of the documents share costs rows in proportion to its occurrences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, fresh, small

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Terms up to which they are broadcast, some 100 bytes each, and bytes up to which candidates are.
BROADCAST_TERMS, BROADCAST_BYTES = 500_000, 64 << 20


def words(text: Column) -> Column:
    """The words of a text with A-Z in lower case; none for null."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS)
    return F.filter(parts, lambda w: w != "")


def item_windows(items: DataFrame, item_id: str, text: str, n: int) -> DataFrame:
    """Distinct items with an id and words: item, item_id, item_words, width of a window."""
    out = items.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("item_words")).where(F.col("item_id").isNotNull() & (F.size("item_words") > 0))
    out = out.distinct().withColumn("item", F.xxhash64("item_id", "item_words"))
    return out.withColumn("width", F.least(F.lit(n), F.size("item_words")))


def tokens(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(words(F.col(text))).alias("pos", "term"))


def term_counts(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """term, n: occurrences of the given terms in all documents."""
    found = tokens(docs, doc_id, text).join(small(terms, BROADCAST_TERMS), "term", "left_semi")
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def postings(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The positional index of the given terms: term, doc_id, pos."""
    return tokens(docs, doc_id, text).join(small(terms, BROADCAST_TERMS), "term", "left_semi").select("term", "doc_id", "pos")


def rarest_terms(items: DataFrame, counts: DataFrame, rarest: int) -> DataFrame:
    """item, term, offset, need: for every window that can occur, its rarest terms with their place in the item.

    need: terms that have to meet on a diagonal, the least over the item's windows.
    """
    starts = F.sequence(F.lit(0), F.size("item_words") - F.col("width"))
    windows = items.select("item", "width", "item_words", F.explode(starts).alias("start"))
    places = windows.select("item", "start", "width", F.posexplode(F.slice("item_words", F.col("start") + 1, F.col("width"))).alias("at", "term"))
    places = places.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    by_window = Window.partitionBy("item", "start")
    places = places.withColumns({
        "least": F.min("n").over(by_window),
        "rank": F.row_number().over(by_window.orderBy("n", "term", "at")),
        "need": F.least(F.lit(rarest), F.col("width")),
    })
    kept = places.where((F.col("least") > 0) & (F.col("rank") <= rarest))
    return kept.select("item", "term", (F.col("start") + F.col("at")).alias("offset"), "need").distinct()


def diagonals(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """doc_id, item, diagonal: where enough of an item's rarest terms meet at their distances."""
    lists = index.join(small(anchors, BROADCAST_TERMS), "term")
    lists = lists.groupBy("doc_id", "item", (F.col("pos") - F.col("offset")).alias("diagonal"))
    return lists.agg(F.count(F.lit(1)).alias("met"), F.max("need").alias("need")).where("met >= need").drop("met", "need")


def _windows_on(c: Column, diagonal: Column, text_words: Column) -> Column:
    """The spans of the item's windows that the document has on a diagonal."""
    starts = F.sequence(F.lit(0), F.size(c["item_words"]) - c["width"])

    def occurs(s: Column) -> Column:
        at = diagonal + s
        inside = (at >= 0) & (at + c["width"] <= F.size(text_words))
        return F.when(inside, F.slice(text_words, F.greatest(at, F.lit(0)) + 1, c["width"]) == F.slice(c["item_words"], s + 1, c["width"])).otherwise(False)

    return F.transform(F.filter(starts, occurs), lambda s: F.struct((diagonal + s).alias("start"), (diagonal + s + c["width"]).alias("end"), c["item_id"].alias("item_id")))


def phrase_matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 10, rarest: int = 3) -> DataFrame:
    """Every row of docs with words (array), and hits: array of (start, end, item_id) in words, end exclusive.

    A hit is an occurrence of n consecutive words of an item, or of a whole item of fewer words. Items without id
    or words, null texts and empty tables give no hits. Rows that share a doc_id, a null one included, are
    matched each against its own text. A text of any length is matched whole; what its candidates add to its row is the
    words of each item that may occur in it, once, and a number for each diagonal. docs keeps its columns; words and hits come last, with an underscore
    before a name that docs has.
    """
    words_name, hits_name, doc, lined_name = fresh(docs, "words", "hits", "doc", "lined")
    work = Workspace(docs.sparkSession, "decontamination")
    wanted = work.stash(item_windows(items, item_id, item_text, n), "items")
    terms = wanted.select(F.explode("item_words").alias("term")).distinct()
    counts = work.stash(term_counts(docs, terms, doc_id, text), "term-counts")
    anchors = work.stash(rarest_terms(wanted, counts, rarest), "rarest-terms")
    index = work.stash(postings(docs, anchors.select("term").distinct(), doc_id, text), "postings")
    # an item's words once for each document that may hold it, however many diagonals they have
    lined = diagonals(index, anchors).groupBy("doc_id", "item").agg(F.collect_list("diagonal").alias("diagonals")).join(wanted, "item")
    one = F.struct("diagonals", "item_id", "item_words", "width")
    found = lined.groupBy(F.col("doc_id").alias(doc)).agg(F.collect_list(one).alias(lined_name))
    found = work.stash(found, "candidates")
    texts = docs.withColumn(words_name, words(F.col(text)))
    joined = texts.join(bounded(found, lined_name), F.col(doc_id).eqNullSafe(F.col(doc)), "left")
    on = lambda c: F.flatten(F.transform(c["diagonals"], lambda d: _windows_on(c, d, F.col(words_name))))
    hits = F.flatten(F.transform(F.col(lined_name), on))
    empty = F.from_json(F.lit("[]"), found.select(hits_type(lined_name)).schema[0].dataType)
    return joined.withColumn(hits_name, F.coalesce(hits, empty)).drop(doc, lined_name)


def hits_type(lined: str) -> Column:
    """An expression of the type of hits, for the empty case."""
    c = F.col(lined)[0]
    return F.array(F.struct(c["diagonals"][0].alias("start"), c["diagonals"][0].alias("end"), c["item_id"].alias("item_id")))


def bounded(found: DataFrame, lined: str) -> DataFrame:
    """The candidates, to be broadcast if they take at most BROADCAST_BYTES; else the join is left to shuffle."""
    entry = F.aggregate(lined, F.lit(0).cast("long"), lambda a, c: a + 4 * F.size(c["diagonals"]) + F.aggregate(c["item_words"], F.lit(64), lambda n, w: n + 16 + F.octet_length(w)))
    size = found.agg(F.coalesce(F.sum(entry + 64), F.lit(0))).first()[0]
    return F.broadcast(found) if size <= BROADCAST_BYTES else found


def covered(hits: Column) -> Column:
    """How many positions the spans of hits cover."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, h: F.struct((a["n"] + F.greatest(F.lit(0), h["end"] - F.greatest(a["end"], h["start"]))).alias("n"), F.greatest(a["end"], h["end"]).alias("end"))
    return F.aggregate(F.array_sort(hits), start, step, lambda a: a["n"])


def hit_items(hits: Column) -> Column:
    """The item ids of hits as strings, each once, sorted."""
    return F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["item_id"].cast("string"))))


def remove_spans(text_words: Column, hits: Column) -> Column:
    """The words outside every hit."""
    return F.filter(text_words, lambda _, i: ~F.exists(hits, lambda h: (i >= h["start"]) & (i < h["end"])))


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", rarest: int = 3) -> DataFrame:
    """doc_id, item_id, first, last: places where the item's rarest terms all occur within slop words, in any order.

    An item's terms are its `rarest` least frequent distinct words; items with a word that no document has
    don't match. One row for each place that ends a match.
    """
    work = Workspace(docs.sparkSession, "proximity")
    wanted = item_windows(items, item_id, item_text, 1)
    item_terms = work.stash(wanted.select("item", "item_id", F.explode(F.array_distinct("item_words")).alias("term")), "item-terms")
    counts = work.stash(term_counts(docs, item_terms.select("term").distinct(), doc_id, text), "term-counts")
    ranked = item_terms.join(counts, "term", "left").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.coalesce("n", F.lit(0)), "term")))
    kept = ranked.where(F.col("rank") <= rarest).withColumn("need", F.count(F.lit(1)).over(Window.partitionBy("item")))
    index = postings(docs, kept.select("term").distinct(), doc_id, text)
    near = Window.partitionBy("doc_id", "item").orderBy("pos").rangeBetween(-slop, 0)
    placed = index.join(small(kept.select("item", "item_id", "term", "need"), BROADCAST_TERMS), "term")
    placed = placed.withColumns({"met": F.size(F.collect_set("term").over(near)), "lasts": F.collect_list(F.struct("term", "pos")).over(near)})
    nearest = F.array_min(F.transform(F.array_distinct(F.transform("lasts", lambda x: x["term"])), lambda t: F.array_max(F.transform(F.filter("lasts", lambda x: x["term"] == t), lambda x: x["pos"]))))
    return placed.where("met = need").select("doc_id", "item_id", nearest.alias("first"), F.col("pos").alias("last"))
