"""Sharding, decontamination and token counts against plain Python."""

import hashlib
import re
import zlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanforge.llm import decontamination as dc
from spanforge.llm import queries, token_counts
from spanforge.llm.common import Workspace, fresh, utf8_size
from spanforge.llm.sharding import histogram_sort_shards, splitters

from ..oracle import connect, same

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


# Sharding


def shares(rows, n):
    """Brute force: the boundary nearest to each share of the bytes, over rows in key order."""
    rows = sorted(rows)
    below = [0]
    for _, size in rows:
        below.append(below[-1] + size)
    cuts = []
    for i in range(1, n):
        target = below[-1] * i // n
        cuts.append(min(range(len(below)), key=lambda k: (abs(below[k] - target), k)))
    return [sum(k >= c for c in cuts) for k in range(len(rows))]


def sharded(spark, rows, n, **options):
    df = spark.createDataFrame(rows, "doc_id long, size_ long")
    return sorted((r.doc_id, r.shard, r.slot) for r in histogram_sort_shards(df, n, "doc_id", F.col("size_"), **options).collect())


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.one_of(st.integers(-100, 100), st.integers(-(2**62), 2**62)), st.integers(1, 500), min_size=1, max_size=60), st.integers(1, 7))
def test_shards_match_brute_force(spark, sizes, n):
    rows = sorted(sizes.items())
    got = sharded(spark, rows, n)
    assert [s for _, s, _ in got] == shares(rows, n)
    for s in {x for _, x, _ in got}:
        assert [slot for _, x, slot in got if x == s] == list(range(sum(x == s for _, x, _ in got)))


def test_equal_rows_are_split(spark):
    got = sharded(spark, [(7, 10)] * 1000, 4)
    assert [sum(s == i for _, s, _ in got) for i in range(4)] == [250] * 4
    assert all(sorted(slot for _, s, slot in got if s == i) == list(range(250)) for i in range(4))
    rows = [(1, 5)] * 90 + [(2, 5), (3, 40)] + [(3, 40)] * 20
    got = sharded(spark, rows, 6, cell_rows=10)
    assert [s for _, s, _ in got] == shares(rows, 6)
    for s in range(6):
        assert sorted(slot for _, x, slot in got if x == s) == list(range(sum(x == s for _, x, _ in got)))


def test_op3_matches_sql(spark, sf_dir):
    same(queries.op3_histogram_sort(spark, sf_dir), connect(sf_dir), queries.oracle_sql()["op3_histogram_sort"])


def test_many_cells_and_slots(spark):
    rows = [(i, 1 + i % 7) for i in range(3000)]
    got = sharded(spark, rows, 5, cell_rows=50)
    assert [s for _, s, _ in got] == shares(rows, 5)
    assert [slot for _, s, slot in got if s == 3] == list(range(sum(s == 3 for _, s, _ in got)))


def test_a_key_that_many_rows_share_is_split(spark):
    df = spark.range(1000).select(F.lit(7).cast("long").alias("doc_id"), F.col("id").alias("x"))
    got = histogram_sort_shards(df, 4, "doc_id").groupBy("shard").count().collect()
    assert sorted(r["count"] for r in got) == [250] * 4


def test_shards_of_nulls_repeats_and_nothing(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (1, None), (2, ""), (2, "")], "doc_id long, text string")
    got = histogram_sort_shards(df, 2, "doc_id", utf8_size(F.col("text")) + 16).collect()
    assert len(got) == 5 and {r.shard for r in got} == {0, 1}
    assert histogram_sort_shards(df.limit(0), 2, "doc_id").count() == 0
    assert histogram_sort_shards(df.withColumnsRenamed({"text": "key"}).withColumn("cell", F.lit(1)), 2, "doc_id").columns == ["doc_id", "key", "cell", "slot", "shard"]
    assert histogram_sort_shards(df.withColumn("Shard", F.lit(1)), 2, "doc_id").columns[-2:] == ["slot", "_shard"]


def test_tolerance_needs_fewer_rounds(spark):
    keys = spark.range(5000).select((F.col("id") * 1_000_003).alias("key"), F.lit(0).cast("long").alias("tie"), F.lit(10).cast("long").alias("size"))
    exact, total = splitters(keys, 4)
    loose, _ = splitters(keys, 4, tolerance=500)
    assert total == (50000, 5000) and [e.rows for e in exact] == [1250, 2500, 3750]
    assert all(abs(e.bytes - 12500 * (i + 1)) <= 500 for i, e in enumerate(loose))


def test_op3(spark, sf_dir):
    got = queries.op3_histogram_sort(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(got) == len(texts)
    expect = dict(zip(sorted(texts), shares([(i, len(t.encode()) + 16) for i, t in texts.items()], 40)))
    for r in got:
        assert r.size == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        assert r.law == "bytes" and r.grown_shard is None and r.shard == expect[r.doc_id]


# Decontamination


def brute(doc_rows, items, n=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))

    out = []
    for i, t in doc_rows:
        w, hit, found = words(t), set(), set()
        for item, it in items:
            v = words(it)
            k = min(n, len(v))
            for s in range(len(v) - k + 1) if k else ():
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == v[s : s + k]:
                        hit.update(range(p, p + k))
                        found.add(str(item))
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def matched(spark, doc_rows, items, **options):
    b = spark.createDataFrame(items, "item_id long, text string")
    got = dc.phrase_matches(docs(spark, doc_rows), b, **options)
    got = got.select("doc_id", F.size("words").alias("n"), dc.covered(F.col("hits")).alias("h"), dc.hit_items(F.col("hits")).alias("i")).collect()
    return sorted(((r.doc_id, r.n, r.h, list(r.i)) for r in got), key=str)


def test_phrases_by_hand(spark):
    rows = [(1, "x A, b c! D e f g h i j k y"), (2, "a b c d e f g h i k j"), (3, None), (4, ""), (5, "short One two"), (6, "a b c d e f g h i j " * 3), (None, "one TWO"), (7, "ÄB über é"), (7, "nothing")]
    items = [(1, "a b c d e f g h i j k"), (2, "one two"), (3, None), (4, " .. "), (5, "über é"), (2, "one two"), (None, "nothing"), (9, "zz never")]
    assert matched(spark, rows, items) == brute(rows, [x for x in items if x[0] is not None])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab .", max_size=40), max_size=5), st.lists(st.text("ab ", max_size=14), max_size=4))
def test_phrases_match_brute_force(spark, texts, items):
    rows, items = list(enumerate(texts)), list(enumerate(items))
    assert matched(spark, rows, items, n=3, rarest=2) == brute(rows, items, 3)


def test_empty_tables_and_clashes(spark):
    assert matched(spark, [], [(1, "a")]) == []
    assert matched(spark, [(1, "a b")], []) == [(1, 2, 0, [])]
    names = {n: F.lit(i) for i, n in enumerate(("term", "item", "pos", "lined", "doc", "Hits", "words", "item_id", "diagonal"))}
    got = dc.phrase_matches(docs(spark, [(1, "one two three")]).withColumns(names), spark.createDataFrame([(1, "two three")], "item_id long, text string"))
    assert got.columns[-2:] == ["_words", "_hits"] and got.first()["_hits"][0].start == 1 and got.first()["Hits"] == 5


def test_joins_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(dc, "BROADCAST_TERMS", 0)
    monkeypatch.setattr(dc, "BROADCAST_BYTES", -1)
    rows, items = [(1, "a b c d"), (2, "b c x")], [(1, "b c"), (2, "c d")]
    assert matched(spark, rows, items) == brute(rows, items)


def test_proximity(spark):
    d = docs(spark, [(1, "alpha x x beta x gamma"), (2, "alpha " + "x " * 30 + "beta gamma"), (3, "gamma beta alpha")])
    b = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha missing")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.first, r.last) for r in dc.proximity_matches(d, b, 5).collect())
    assert got == [(1, 1, 0, 5), (3, 1, 0, 2)]


def test_remove_spans(spark):
    b = spark.createDataFrame([(1, "c d")], "item_id long, text string")
    got = dc.phrase_matches(docs(spark, [(1, "a b c d e")]), b).select(F.array_join(dc.remove_spans(F.col("words"), F.col("hits")), " ").alias("t")).first()
    assert got.t == "a b e"


def test_op10_matches_sql_and_stays_native(spark, sf_dir):
    df = queries.op10_decontamination(spark, sf_dir)
    same(df, connect(sf_dir), queries.oracle_sql()["op10_decontamination"])
    assert hashlib.sha256(b"").hexdigest() in {r.items_sha256 for r in df.collect()}
    for q in (df, queries.op3_histogram_sort(spark, sf_dir)):
        assert not re.search("Python|Pandas|Arrow", q._jdf.queryExecution().executedPlan().toString())


# Token counts


def test_histogram_answers_every_limit(spark):
    lengths = [0, 0, 3, 3, 3, 7, 5000, 2048]
    df = spark.createDataFrame([(n,) for n in lengths], "n_tokens long")
    rows = {r.n_tokens: r for r in token_counts.length_histogram(df).collect()}
    assert set(rows) == set(lengths)
    for n, r in rows.items():
        assert r.n_docs == lengths.count(n) and r.docs_at_least == sum(x >= n for x in lengths)
        assert r.tokens_at_least == sum(x for x in lengths if x >= n) and r.truncated_total == sum(min(x, n) for x in lengths)
        assert r.kept_whole == sum(x <= n for x in lengths) and r.quantile == r.kept_whole / len(lengths)
        assert (r.total_docs, r.total_tokens) == (len(lengths), sum(lengths))
    assert token_counts.length_histogram(df.limit(0)).count() == 0


def test_token_lengths(spark):
    tokenizers = pytest.importorskip("tokenizers")
    texts = ["", None, "Hello world", "a" * 5000, "naïve über 日本 😀", "x <|endoftext|> y", "line\n\n  two", "word " * 4000]
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    expect = sorted(len(t.encode(x or "", add_special_tokens=False).ids) for x in texts)
    got = docs(spark, list(enumerate(texts))).select(token_counts.token_length(F.col("text")).alias("n")).collect()
    assert sorted(r.n for r in got) == expect


def test_op8(spark, sf_dir):
    """Every column against brute force over the whole table, by another library of the same vocabulary."""
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    lengths = [len(t.encode(r.text or "", add_special_tokens=False).ids) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = {r.n_tokens: r for r in queries.op8_token_counts(spark, sf_dir).collect()}
    assert set(rows) == set(lengths)
    for n, r in rows.items():
        whole = sum(x <= n for x in lengths)
        expect = (lengths.count(n), sum(x >= n for x in lengths), sum(x for x in lengths if x >= n), sum(min(x, n) for x in lengths), whole, whole / len(lengths), len(lengths), sum(lengths))
        assert tuple(r)[1:] == expect


def test_repeated_rows_count_each_time(spark):
    rows = [(1, "Hello world")] * 3 + [(2, None), (2, "")]
    got = token_counts.token_counts(docs(spark, rows).withColumn("n_tokens", F.lit(9))).collect()
    assert sorted((r.n_tokens, r.n_docs) for r in got) == [(0, 2), (2, 3)]


# Shared helpers


def test_workspace(spark):
    work = Workspace(spark, "test")
    a = work.stash(spark.range(3), "a")
    assert a.count() == 3
    work.drop(a)
    with pytest.raises(Exception):
        spark.read.parquet(f"{work.root}/001-a").count()
    work.stash(spark.range(2), "b")
    work.drop()
    assert fresh(spark.createDataFrame([(1, 2)], "Key int, _key int"), "key", "other") == ["__key", "other"]
