"""Near-duplicates, repeated passages and components against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.llm import ann, minhash, queries
from spanforge.llm import components as components_module
from spanforge.llm import substring_dedup as sd
from spanforge.llm.common import Workspace
from spanforge.llm.components import connected_components
from spanforge.llm.shingles import WordHashes, words_of

from ..oracle import connect, same
from .test_native import docs


def prose(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(rng, words, changes):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def shingle_sets(rows, n=5):
    out = {}
    for i, t in rows:
        w = words_of(t)
        out[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    return out


def components(rows, percent):
    sets = shingle_sets(rows)
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                i, j = find(a), find(b)
                up[max(i, j)] = min(i, j)
    return {i: find(i) for i in sets}, sets


def corpus(seed=1):
    rng = random.Random(seed)
    rows, shared = [], prose(rng, 60)
    for _ in range(25):
        base = prose(rng, rng.choice([6, 30, 120, 300]))
        for k in range(rng.choice([1, 1, 2, 6])):
            rows.append(" ".join(edited(rng, base, rng.randrange(0, max(1, len(base) // 40) + k))))
    rows += [" ".join(prose(rng, 80) + shared + prose(rng, 80)) for _ in range(10)]
    rows += ["", " \n ", "one", "One", "one two three", "a b c d", "A  b\tc D", None]
    rng.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("percent", [80, 85])
def test_components_match_brute_force(spark, percent):
    rows = corpus(percent)
    expect, sets = components(rows, percent)
    got = minhash.near_duplicates(docs(spark, rows), percent=percent).collect()
    assert {r.doc_id: r.component_id for r in got} == expect
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == expect[r.doc_id]) for r in got)


def test_a_cluster_beyond_one_block(spark, monkeypatch):
    """Near copies of which some are linked only through others, compared in several blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(5)
    base = prose(rng, 100)
    rows = [(i, " ".join(edited(rng, base, rng.randrange(0, 4)))) for i in range(90)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)]
    expect, _ = components(rows, 85)
    assert len(set(expect.values())) > 1
    got = minhash.near_duplicates(docs(spark, rows), percent=85).collect()
    assert {r.doc_id: r.component_id for r in got} == expect


def test_nulls_repeats_and_empty(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (2, "x y z"), (3, "")]
    got = minhash.near_duplicates(docs(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 0, None, True), (2, 1, 2, True), (3, 0, 3, True)], key=str)
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


def test_a_template(spark):
    """Hundreds of pages around one template, at a similarity of some 0.6, are not linked; their copies are."""
    rng = random.Random(9)
    template = prose(rng, 150)
    rows = [(i, " ".join(template + prose(rng, 50))) for i in range(700)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(0, 700, 100)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == {i: i % 1000 for i, _ in rows}


def test_blocks_bounded_in_shingles(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 1500)
    rng = random.Random(5)
    base = prose(rng, 100)
    rows = [(i, " ".join(edited(rng, base, rng.randrange(0, 4)))) for i in range(60)]
    expect, _ = components(rows, 85)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, rows), percent=85).collect()} == expect


def test_a_template(spark):
    """Hundreds of pages around one template, at a similarity of some 0.6, are not linked; their copies are."""
    rng = random.Random(9)
    template = prose(rng, 150)
    rows = [(i, " ".join(template + prose(rng, 50))) for i in range(700)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(0, 700, 100)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == {i: i % 1000 for i, _ in rows}


def test_blocks_bounded_in_shingles(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 1500)
    rng = random.Random(5)
    base = prose(rng, 100)
    rows = [(i, " ".join(edited(rng, base, rng.randrange(0, 4)))) for i in range(60)]
    expect, _ = components(rows, 85)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, rows), percent=85).collect()} == expect


def test_threshold():
    assert minhash.match_threshold(32, 100) == 32
    assert 14 <= minhash.match_threshold(32, 85) <= 19


def test_word_memo_is_bounded(monkeypatch):
    monkeypatch.setattr("spanforge.llm.shingles.MEMO", 10)
    h = WordHashes()
    a = h([b"x%d" % i for i in range(8)])
    h([b"y%d" % i for i in range(8)])
    assert len(h.memo) <= 16 and (h([b"x%d" % i for i in range(8)]) == a).all()


def test_long_text(spark):
    t = " ".join(prose(random.Random(2), 60_000, 10**6))
    got = minhash.near_duplicates(docs(spark, [(1, t), (2, t + " end"), (3, "x")])).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3}


def test_op5_matches_sql(spark, sf_dir):
    same(queries.op5_minhash(spark, sf_dir), connect(sf_dir), queries.oracle_sql()["op5_minhash"])


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 260)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "cc")).collect()}
    up = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert got == up
    assert connected_components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "cc")).count() == 0


# Repeated passages


def tree(a, width):
    out = []

    def rec(lo, hi):
        if hi - lo + 1 >= width:
            c = lo + int(np.argmin(a[lo : hi + 1]))
            out.append((lo, c, hi))
            rec(lo, c - 1)
            rec(c + 1, hi)

    rec(0, len(a) - 1)
    return sorted(out, key=lambda x: x[1])


def test_compact_windows_are_the_cartesian_tree():
    rng = np.random.default_rng(0)
    for _ in range(400):
        a = rng.integers(0, rng.choice([2, 8, 10**9]), size=rng.integers(1, 150)).astype(np.uint64)
        width = int(rng.integers(1, 40))
        got = sd.compact_windows(a, width)
        assert list(zip(*(x.tolist() for x in got))) == tree(a, width)


def repeated_words(rows, words=50):
    """Brute force: positions in runs of `words` words that a document with a smaller id has too."""
    first, out = {}, {}
    for i, t in sorted((i, t) for i, t in rows if t):
        w = words_of(t)
        runs = [tuple(w[k : k + words]) for k in range(len(w) - words + 1)]
        out[i] = {p for k, r in enumerate(runs) if r in first for p in range(k, k + words)}
        for r in runs:
            first.setdefault(r, i)
    return {i: p for i, p in out.items() if p}


def test_exact_passages_are_found(spark):
    rng = random.Random(11)
    shared = [prose(rng, n) for n in (50, 55, 80, 200, 49, 30)]
    rows = []
    for i in range(60):
        w = prose(rng, rng.randrange(20, 200))
        for s in rng.sample(shared, rng.randrange(0, 3)):
            at = rng.randrange(len(w))
            w = w[:at] + (s if rng.random() < 0.7 else [x.upper() for x in s]) + w[at:]
        rows.append((i, " ".join(w)))
    expect = repeated_words(rows)
    got = {}
    for r in sd.shared_passages(docs(spark, rows)).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start, r.end))
        assert r.source_id < r.doc_id and r.end - r.start >= 50 and r.similarity >= 0.8
    assert all(p <= got.get(i, set()) for i, p in expect.items())
    assert set(got) == set(expect)


def test_passages_whose_values_other_documents_had_first(spark):
    """Every shingle of a passage occurs in earlier documents, in pieces; so does its near copy."""
    rng = random.Random(13)
    passage, other = prose(rng, 60), prose(rng, 110)
    pieces = [p[k : k + 12] for p in (passage, other) for k in range(0, len(p), 6)]
    rows = [(i, " ".join(prose(rng, 60) + piece + prose(rng, 60))) for i, piece in enumerate(pieces)]
    rows += [(100 + i, " ".join(prose(rng, 60) + passage + prose(rng, 60))) for i in range(3)]
    rows += [(200, " ".join(prose(rng, 60) + other)), (201, " ".join(other[:55] + ["changed"] + other[56:] + prose(rng, 60)))]
    # the same first 30 words lead to other texts in earlier documents
    rows += [(50 + i, " ".join(other[20:48] + prose(rng, 60))) for i in range(6)]
    got = sd.shared_passages(docs(spark, rows)).collect()
    assert {(r.doc_id, r.source_id) for r in got} == {(101, 100), (102, 100), (201, 200)}
    found = {}
    for r in got:
        found.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    assert all(p <= found[i] for i, p in repeated_words(rows).items()) and len(found[201]) >= 105


def test_run_hashes():
    s = np.random.default_rng(1).integers(0, 2**63, size=40).astype(np.uint64)
    s[25:35] = s[5:15]
    h = sd.run_hashes(s, 10)
    assert len(h) == 31 and len(set(h.tolist())) == 30 and h[5] == h[25] and len(sd.run_hashes(s[:9], 10)) == 0


@pytest.mark.parametrize("k", [0, 1, 2, 3, 4, 6])
def test_passages_with_insertions(k):
    """96 words with k words more in the middle of either side have a similarity of 0.86 or more."""
    rng = random.Random(k)
    passage, extra = prose(rng, 96, 10**6), prose(rng, k, 10**6)
    longer = passage[:48] + extra + passage[48:]
    for mine, other in ((passage, longer), (longer, passage)):
        a, b = (sd.text_shingles(" ".join(prose(rng, 40, 10**6) + w + prose(rng, 30, 10**6)), 5) for w in (mine, other))
        ((lo, hi, j0, j1, s),) = sd.passages(a, b, 5, 50, 80)
        assert (lo, hi, j0, j1) == (40, 40 + len(mine), 40, 40 + len(other)) and s >= 0.86


@pytest.mark.parametrize("teasers", [1, 3, 20])
def test_passages_after_a_teaser(teasers):
    rng = random.Random(6)
    passage, text = prose(rng, 60, 10**6), []
    for _ in range(teasers):
        text += passage[:30] + prose(rng, 20, 10**6)
    a, b = sd.text_shingles(" ".join(passage), 5), sd.text_shingles(" ".join(text + passage), 5)
    assert sd.passages(a, b, 5, 50, 80) == [(0, 60, 50 * teasers, 50 * teasers + 60, 1.0)]
    same = sd.text_shingles("same " * 3000, 5)
    assert [p[:2] for p in sd.passages(same[:900], same, 5, 50, 80)] == [(0, 904)]


def test_near_passages_are_found(spark):
    rng = random.Random(12)
    passage = prose(rng, 120)
    near = passage[:40] + ["changed"] + passage[41:90] + passage[91:]
    rows = [(1, " ".join(prose(rng, 40) + passage + prose(rng, 40))), (2, " ".join(prose(rng, 70) + near)), (3, " ".join(prose(rng, 300)))]
    got = sd.shared_passages(docs(spark, rows)).collect()
    assert {(r.doc_id, r.source_id) for r in got} == {(2, 1)}
    assert min(r.start for r in got) == 70 and max(r.end for r in got) == 70 + len(near)


def test_passages_of_nulls_repeats_and_empty(spark):
    t = " ".join(prose(random.Random(1), 80))
    rows = [(1, t), (1, t), (None, t), (2, None), (3, ""), (4, "short"), (5, "same " * 300), (6, "same " * 200)]
    got = {(r.doc_id, r.source_id) for r in sd.shared_passages(docs(spark, rows)).collect()}
    assert got == {(6, 5)}
    assert sd.shared_passages(docs(spark, [])).count() == 0


def test_remove_repeats(spark):
    rng = random.Random(4)
    p, a, b = prose(rng, 60), prose(rng, 20), prose(rng, 20)
    rows = [(1, " ".join(p)), (2, " ".join(a) + "\n" + "  ".join(p) + "\n" + " ".join(b)), (3, " ".join(p)), (4, None), (5, "clean"), (None, " ".join(p))]
    got = {r.doc_id: r.text for r in sd.remove_repeats(docs(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: " ".join(a) + "\n" + " ".join(b), 4: None, 5: "clean", None: rows[5][1]}


def test_texts_of_one_id_are_cut_each_by_its_own(spark):
    rng = random.Random(5)
    p, other = prose(rng, 60), prose(rng, 90)
    rows = [(1, " ".join(p)), (2, " ".join(p + other[:5])), (2, " ".join(other)), (2, " ".join(other))]
    got = sorted((r.doc_id, r.text) for r in sd.remove_repeats(docs(spark, rows)).collect())
    assert got == sorted([rows[0], (2, " ".join(other[:5])), rows[2], rows[3]])


def test_cut_words():
    assert sd.cut_words("a b\nc d", [(1, 3)]) == "a d"
    assert sd.cut_words(" a b ", [(0, 1), (1, 2)]) == ""
    assert sd.cut_words("a b c", [(0, 1), (0, 2)]) == "c"


def test_joins_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(sd, "BROADCAST_PAIRS", 0)
    t = " ".join(prose(random.Random(1), 80))
    assert sd.shared_passages(docs(spark, [(1, t), (2, t)])).count() == 1


def test_op1(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    expect, got = repeated_words(rows, 51), {}
    for r in queries.op1_substring_dedup(spark, sf_dir).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    missed = sum(len(p - got.get(i, set())) for i, p in expect.items())
    assert missed <= 0.01 * sum(map(len, expect.values()))


@pytest.fixture
def plans(monkeypatch):
    """The plans of the tables that operators write, by name."""
    seen, stash = {}, Workspace.stash

    def kept(self, df, name):
        seen.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return stash(self, df, name)

    monkeypatch.setattr(Workspace, "stash", kept)
    return seen


def test_exploded_probes_are_not_broadcast(spark, plans):
    """A row of the queries becomes hundreds of probes, which the planner's guess of a size leaves out."""
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, rng.standard_normal(16).tolist()) for i in range(300)], "vec_id long, embedding array<float>")
    assert ann.search(rows).count() == 30
    assert all("BroadcastHashJoin" not in p for p in plans["pairs"])


def test_classes_and_edges_are_not_broadcast(spark, plans, monkeypatch):
    """Tables that grow with the documents are joined by shuffles, however small Parquet makes them look."""
    monkeypatch.setattr(components_module, "FEW", 0)
    rows = corpus(3)
    expect, _ = components(rows, 80)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, rows)).collect()} == expect
    for name in ("prefixes", "stars", "clusters", "sized", "links", "edges"):
        assert plans[name] and all("BroadcastHashJoin" not in p for p in plans[name]), name


def test_near_passages_whose_runs_other_documents_had_first(spark):
    """Each run that two near passages share stands in earlier documents that have no more of them."""
    rng = random.Random(17)
    passage = prose(rng, 60, 10**6)
    near = passage[:30] + ["changed"] + passage[31:]
    rows = [(i, " ".join(prose(rng, 60, 10**6) + part + prose(rng, 60, 10**6))) for i, part in enumerate((passage[:30], passage[31:], passage[:30], passage[31:]))]
    rows += [(10, " ".join(prose(rng, 60, 10**6) + passage)), (11, " ".join(prose(rng, 60, 10**6) + near + prose(rng, 60, 10**6)))]
    got = [(r.doc_id, r.source_id, r.start, r.end) for r in sd.shared_passages(docs(spark, rows)).collect()]
    assert got == [(11, 10, 60, 120)]


@pytest.fixture
def stashed(monkeypatch):
    """The rows of the tables that operators write, by name."""
    seen, stash = {}, Workspace.stash

    def kept(self, df, name):
        out = stash(self, df, name)
        seen.setdefault(name, []).append([tuple(r) for r in out.collect()])
        return out

    monkeypatch.setattr(Workspace, "stash", kept)
    return seen


def test_words_again_and_again_are_no_passage(spark, stashed):
    """Texts that share one word 24 times, between others of their own, aren't compared; exact passages of it are found."""
    rng = random.Random(19)
    rows = [(i, " ".join(prose(rng, 30, 10**6) + ["the"] * 24 + prose(rng, 30, 10**6))) for i in range(12)]
    assert sd.shared_passages(docs(spark, rows)).count() == 0
    assert not any(pairs for name in ("pairs", "more-pairs", "later", "later-pairs") for pairs in stashed.get(name, []))
    rows += [(20, " ".join(["the"] * 60 + prose(rng, 30, 10**6))), (21, " ".join(prose(rng, 60, 10**6) + ["the"] * 55))]
    assert [(r.doc_id, r.source_id, r.start, r.end) for r in sd.shared_passages(docs(spark, rows)).collect()] == [(21, 20, 60, 115)]


def test_near_passages_around_one_word_again_and_again(spark):
    rng = random.Random(23)
    a, b, the = prose(rng, 12, 10**6), prose(rng, 12, 10**6), ["the"]
    rows = [(1, " ".join(prose(rng, 60, 10**6) + a + the * 30 + b)), (2, " ".join(a + the * 26 + b + prose(rng, 60, 10**6)))]
    assert {(r.doc_id, r.source_id) for r in sd.shared_passages(docs(spark, rows)).collect()} == {(2, 1)}


def test_copies_are_not_compared(spark, stashed):
    """Equal texts repeat the first one of them, whole; the others are no documents of any window."""
    rng = random.Random(29)
    passage = prose(rng, 60, 10**6)
    t = " ".join(prose(rng, 40, 10**6) + passage) + "\x0b end"
    rows = [(i, t) for i in (3, 5, 5, 7, 8)] + [(9, " ".join(prose(rng, 40, 10**6) + passage)), (5, "short"), (10, "short")]
    got = sorted((r.doc_id, r.source_id, r.start, r.end, r.similarity) for r in sd.shared_passages(docs(spark, rows)).collect())
    n = len(words_of(t))
    assert got == [(i, 3, 0, n, 1.0) for i in (5, 7, 8)] + [(9, 3, 40, 100, 1.0)]
    assert sorted(pair for pairs in stashed["pairs"] + stashed["more-pairs"] + stashed.get("later-pairs", []) for pair in pairs) == [(9, 3)]


def test_only_runs_that_are_long_enough_are_compared(spark, stashed):
    """Twelve shingles in a row are no run of 19, though they go on beside the half run."""
    rng = random.Random(31)
    piece = prose(rng, 16, 10**6)
    rows = [(i, " ".join(prose(rng, 60, 10**6) + piece + prose(rng, 60, 10**6))) for i in range(40)]
    assert sd.shared_passages(docs(spark, rows)).count() == 0
    assert stashed["pairs"] == [[]] and stashed["later"] == [[]]
