import pytest
from pyspark.sql import functions as F

from spanforge.operators import index, streams
from spanforge.sources import facts as adapters
from spanforge.sources import files
from spanforge.sources.facts import number_rows

from .test_query import facts


def items(spark, values):
    return spark.createDataFrame([(i * 10, v) for i, v in enumerate(values)], "pos long, value long")


def values(df):
    return [r.value for r in df.orderBy("pos").collect()]


def test_take_drop_batch(spark):
    df = items(spark, range(1, 6))
    assert values(streams.take(df, "pos", 3)) == [1, 2, 3]
    assert values(streams.drop(df, "pos", 2)) == [3, 4, 5]
    got = streams.batch(df, "pos", 2, F.sum("value").alias("total")).orderBy("batch").collect()
    assert [tuple(r) for r in got] == [(0, 2, 3), (1, 2, 7), (2, 1, 5)]
    assert streams.drop(df.limit(0), "pos", 2).count() == 0


def test_merge_alternates(spark):
    a, b = items(spark, [1, 2, 3, 4]), items(spark, [10, 20])
    got = streams.merge(a, b, "pos").orderBy("position").collect()
    assert [r.value for r in got] == [1, 10, 2, 20, 3, 4]
    assert [r.position for r in got] == list(range(6))


def test_last_n_and_first_of(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 9)], "k string, pos long")
    assert sorted(tuple(r) for r in streams.last_n(df, ["k"], "pos", 2).collect()) == [("a", 2), ("a", 3), ("b", 9)]
    assert sorted(tuple(r) for r in streams.first_of(df, ["k"], "pos").collect()) == [("a", 1), ("b", 9)]


def test_tee_and_sinks(spark, tmp_path):
    seen = []
    streams.tee(spark.range(3), lambda d: seen.append(d.count()), files.write_nothing, lambda d: files.write_parquet(d, str(tmp_path / "p")))
    assert seen == [3] and spark.read.parquet(str(tmp_path / "p")).count() == 3


def test_number_rows(spark):
    df = spark.createDataFrame([(x,) for x in (70000, 5, 200000, -3)], "key long")
    assert {r.key: r.id for r in number_rows(df, "key").collect()} == {-3: 1, 5: 2, 70000: 3, 200000: 4}


def test_sources(spark):
    assert [r.value for r in files.generate(spark, 4, F.col("id") * F.col("id")).collect()] == [0, 1, 4, 9]
    with pytest.raises(Exception, match="boom"):
        files.failing(spark.range(1), "boom").collect()


@pytest.fixture
def indexed(spark):
    return facts(spark, [("is_string", 1, 17, 0.9), ("has_text", 1, 17, 0.8), ("is_string", 16, 48, 0.7)])


def test_index_paths(indexed):
    assert index.by_predicate(indexed, "is_string").count() == 2
    assert index.by_span(indexed, 1, 17).count() == 2
    assert index.by_confidence(indexed, 0.75, 1.0).count() == 2
    assert index.by_all(indexed, "is_string", (1, 17), (0.8, 1.0)).count() == 1
    assert index.by_all(indexed).count() == 0


def test_confidence_buckets(spark):
    f = facts(spark, [("a", 0, 1, c) for c in (0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0)])
    assert index.by_confidence(f, 0.7, 1).count() == 4 and index.by_confidence(f, 0, 0.3).count() == 2
    assert {r.bucket: r.n for r in index.confidence_histogram(f).collect()} == {1: 1, 2: 1, 5: 1, 7: 1, 9: 2, 10: 1}


def test_store(spark, indexed, tmp_path):
    more = index.append(indexed, indexed, "id", 2)
    assert [r.id for r in more.orderBy("id").collect()] == [1, 2, 3, 4, 5, 6]
    assert [r.id for r in index.compact(more, 0.85).orderBy("id").collect()] == [1, 4]
    assert {r.generation: r.n_facts for r in index.store_stats(more).collect()} == {None: 3, 2: 3}
    index.write_index(indexed.drop("value_span"), str(tmp_path / "facts"))
    back = spark.read.parquet(str(tmp_path / "facts")).where("predicate = 'is_string'")
    assert back.count() == 2 and "PartitionFilters: [isnotnull(predicate" in back._jdf.queryExecution().executedPlan().toString()


def test_atoms(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, None), (5, "c")], "pos long, text string")
    atoms = index.intern(df, "text", "pos")
    assert {r.text: (r.atom_id, r.n) for r in atoms.collect()} == {"b": (1, 2), "a": (2, 1), "c": (3, 1)}
    assert {r.pos: r.atom_id for r in index.lookup(df, atoms, "text").collect()} == {1: 1, 2: 2, 3: 1, 4: 0, 5: 3}
    assert index.interning_efficiency(df, "text").first().efficiency == 0.25


def test_as_of(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t long")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("a", 7, 70)], "k string, t long, v long")
    assert sorted((r.k, r.t, r.v) for r in index.as_of(left, right, ["k"], "t", ["v"]).collect()) == [("a", 1, None), ("a", 5, 50), ("b", 9, None)]


def test_benchmark_statistics(spark):
    r = spark.createDataFrame([("x", 1000, 130_000), ("y", 50, 50), ("z", 5, 5)], "name string, operations long, total_ns long")
    b = spark.createDataFrame([("x", 100.0), ("y", 2.0)], "name string, mean_ns double")
    got = {x.name: (x.verdict, x.confidence) for x in index.benchmark_statistics(r, b).collect()}
    assert got == {"x": ("regression", "high"), "y": ("improvement", "low"), "z": ("new", "insufficient")}


def test_tree(spark):
    paths = spark.createDataFrame([(p,) for p in ("b.txt", "src/main.zig", "src/lib/a.zig", "src/.hidden", "out/x/y", ".git/config")], "path string")
    lines = [r.line for r in files.tree(paths, ignored=["out/"]).orderBy("seq_key").collect()]
    assert lines == ["├── out", "│   └── x [...]", "├── src", "│   ├── lib", "│   │   └── a.zig", "│   └── main.zig", "└── b.txt"]


def test_bundle_and_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.json").write_text('{"a": "```"}')
    (tmp_path / "b.txt").write_text("hello\n")
    found = files.expand_globs(spark, str(tmp_path), ["**/*.{json,ts}", "*.txt"])
    assert sorted((r.relative, r.pattern) for r in found.collect()) == [("b.txt", 1), ("d/a.json", 0)]
    read = files.read_files(spark, str(tmp_path)).select(F.col("name").alias("path"), F.col("content").cast("string").alias("text"))
    blocks = {r.path: r.block for r in files.bundle(read).collect()}
    assert blocks["a.json"] == '<File path="./a.json">\n\n````json\n{"a": "```"}\n````\n\n</File>\n'
    assert blocks["b.txt"].startswith('<File path="./b.txt">\n\n```\nhello\n```')


def test_dependencies(spark):
    declared = spark.createDataFrame([("a", "v1.0.0"), ("b", "2.0.0"), ("c", "3.0.0")], "name string, version string")
    installed = spark.createDataFrame([("a", "1.0.0"), ("b", "1.0.0")], "name string, version string")
    assert {r.name: r.status for r in files.dependencies(declared, installed).collect()} == {"a": "up_to_date", "b": "needs_update", "c": "missing"}


def test_numbers_of_sparse_keys(spark):
    """Keys that aren't dense, in few buckets of about equal size; a null key comes first."""
    keys = [None, *(i**3 * 7_919_333 - 10**15 for i in range(3000))]
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(5)
    got = {r.k: r.id for r in number_rows(df, "k", buckets=40, least=50).collect()}
    assert got == {k: i + 1 for i, k in enumerate(keys)}
    assert number_rows(df.limit(0), "k").count() == 0


def test_lines_of_a_long_document(spark, tmp_path):
    lines = [f"line {i}" * (i % 3) for i in range(2000)]
    spark.createDataFrame([(5, "\n".join(lines)), (6, "one"), (7, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = adapters.facts_from_documents(spark, str(tmp_path)).select("source", "span_start", "span_end", "id").collect()
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x) + 1)
    assert sorted((r.span_start, r.span_end) for r in got if r.source == "5") == [(s, s + len(x)) for s, x in zip(starts, lines)]
    assert [(r.span_start, r.span_end) for r in got if r.source != "5"] == [(0, 3), (0, 0)]
    assert len({r.id for r in got}) == len(got)


def test_too_many_parts_are_noticed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(adapters, "PARTS", 10)
    spark.createDataFrame([(1, "\n".join("abcdefghijkl"))], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    with pytest.raises(Exception, match="more than 10 parts"):
        adapters.facts_from_documents(spark, str(tmp_path)).collect()


def test_index_reads_one_folder(spark, sf_dir, tmp_path):
    f = adapters.facts_from_events(spark, sf_dir)
    index.write_index(f, str(tmp_path / "index"))
    got = index.read_index(spark, str(tmp_path / "index"), "click")
    assert got.count() == f.where("predicate = 'click'").count()
    assert all("predicate=click" in x for x in got.inputFiles()) or "PartitionFilters: [isnotnull(predicate" in got._jdf.queryExecution().executedPlan().toString()
