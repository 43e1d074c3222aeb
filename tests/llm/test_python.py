"""WARC, nearest neighbours, HTML, toxicity, SentencePiece and the pipeline."""

import base64
import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.llm import ann, html_text, queries, toxicity, warc
from spanforge.llm import sentencepiece_codec as spc

from ..oracle import connect, same
from .test_native import brute, docs
from .test_near import prose

# WARC


def pages(spark, rows):
    return spark.createDataFrame([(i, f"https://x/{i}", h) for i, h in rows], "page_id long, url string, html string")


def archived(spark, rows, **options):
    return warc.archive(spark, pages(spark, rows), "page_id", "url", "html", **options)


def test_records_round_trip(spark):
    rows = [(i, f"<p>page {i % 7} ü{'x' * (i % 50)}</p>") for i in range(300)] + [(900, None), (901, ""), (902, "\r\n\r\nWARC/1.1\r\n")]
    index, folder = archived(spark, rows, frame_bytes=2000, bundle_bytes=5000)
    first = {}
    for i, h in sorted(rows):
        first.setdefault(h or "", i)
    got = {int(r.record_id): r for r in warc.read_bundles(index).collect()}
    assert set(got) == {i for i, _ in rows}
    for i, h in rows:
        r, p = got[i], (h or "").encode()
        assert r.payload_bytes == len(p) and r.payload_digest == base64.b32encode(hashlib.sha1(p).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if first[h or ""] == i else ("revisit", str(first[h or ""])))
        assert r.payload == (p if r.record_type == "response" else None) and r.target_uri == f"https://x/{i}"
    assert index.select("bundle").distinct().count() > 1 and index.agg(F.max("frame")).first()[0] > 0


def test_random_access_and_seek_table(spark):
    rows = [(i, str(random.Random(i).random()) * 20) for i in range(50)]
    index, _ = archived(spark, rows, frame_bytes=1000)
    for e in index.where("record_id in ('3', '44')").collect():
        assert warc.read_record(e.asDict())["payload"].decode() == rows[int(e.record_id)][1]
    import zstandard

    bundle = index.first().bundle
    store, path = warc._store(bundle)
    with store.open_input_file(path) as f:
        table, data = warc.read_seek_table(f), None
        f.seek(0)
        data = f.read()
    # the frames without the seek table are plain Zstandard
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert len(whole) == sum(d for *_, d in table) and table[1][0] == table[0][1]


def test_small_payloads_and_repeats(spark):
    got = warc.read_bundles(archived(spark, [(1, "a"), (2, "a"), (3, "long one"), (4, "long one"), (4, "long one"), (None, "long one")], least_bytes=2)[0]).collect()
    assert sorted((r.record_id, r.record_type, r.refers_to or "") for r in got) == [("", "revisit", "3"), ("1", "response", ""), ("2", "response", ""), ("3", "response", ""), ("4", "revisit", "3"), ("4", "revisit", "3")]
    empty, _ = warc.archive(spark, pages(spark, []), "page_id", "url", "html")
    assert empty.count() == 0 and warc.read_bundles(empty).count() == 0


def test_long_payloads_and_parallel_reading(spark, monkeypatch):
    """Payloads longer than a frame and a bundle; each range of frames is read by a task of its own."""
    rng = random.Random(1)
    rows = [(i, "".join(rng.choices("abcdefgh", k=30_000 if i % 5 else 200))) for i in range(40)]
    index, _ = archived(spark, rows, frame_bytes=4000, bundle_bytes=50_000)
    monkeypatch.setattr(warc, "READ_BYTES", 20_000)
    got = warc.read_bundles(index)
    n_bundles = index.select("bundle").distinct().count()
    assert n_bundles >= 8 and got.rdd.getNumPartitions() >= n_bundles
    assert {int(r.record_id): bytes(r.payload).decode() for r in got.collect()} == dict(rows)
    tasks = got.groupBy(F.spark_partition_id().alias("task")).count().count()
    assert tasks > n_bundles / 2
    marked = warc.mark_revisits(pages(spark, rows).withColumn("_size", F.lit("own")), "page_id", "html")
    assert marked.where("_size = 'own'").count() == len(rows) and "__size" in marked.columns


def test_damage_is_noticed():
    data = bytearray(warc.record("1", "u", b"payload", warc.base32_sha1(b"payload"), 7, None))
    data[data.index(b"payload")] ^= 1
    with pytest.raises(ValueError):
        warc.parse_record(bytes(data), 0)


def test_op4_matches_sql(spark, sf_dir):
    same(queries.op4_warc(spark, sf_dir), connect(sf_dir), queries.oracle_sql()["op4_warc"])


# Nearest neighbours


def vectors(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in row], 0) for i, row in zip(range(len(x)) if ids is None else ids, x)], "vec_id long, embedding array<float>, label int")


def nearest(x, ids, q, k=5):
    s = [(-float((x[q].astype(float) * y.astype(float)).sum() / np.linalg.norm(x[q].astype(float)) / np.linalg.norm(y.astype(float))), int(i)) for y, i in zip(x, ids) if i != ids[q]]
    return sorted(s)[:k]


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(900, 32)), rng.normal(size=(20, 32)).repeat(20, axis=0) + 0.1 * rng.normal(size=(400, 32))]).astype(np.float32)
    got = ann.search(vectors(spark, x)).collect()
    hit = total = 0
    for q in range(0, len(x), 50):
        best = nearest(x, range(len(x)), q)
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5]
        for r in mine:
            a, b = x[q].astype(float), x[r.vec_id].astype(float)
            assert r.score == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)
        hit += len({r.vec_id for r in mine} & {i for _, i in best})
        total += 5
    assert hit >= 0.9 * total


def test_ties_repeats_and_useless_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "POSTINGS", 3)  # several salts
    rng = np.random.default_rng(2)
    x = rng.normal(size=(101, 16)).astype(np.float32)
    x[60:70] = x[0]  # ties go to the smaller id
    df = vectors(spark, x).union(spark.createDataFrame([(200, None, 0), (250, [0.0] * 16, 0), (300, [float("nan")] + [1.0] * 15, 0), (350, [float("inf")] + [1.0] * 15, 0), (400, [None] + [1.0] * 15, 0), (450, [], 0), (None, [1.0] * 16, 0)], "vec_id long, embedding array<float>, label int"))
    got = ann.search(df.union(df.where("vec_id = 60"))).collect()
    assert {r.query_id for r in got} == {0, 50, 100}
    # a repeated row is a candidate of its own
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 0), key=lambda r: r.rank)] == [60, 60, 61, 62, 63]
    assert sorted(tuple(r) for r in got) == sorted(everyone(x, [*range(101), 60], k=5))


def everyone(x, ids, k):
    """Brute force for few rows: exact, all candidates."""
    rows = [(i, x[i].astype(float)) for i in ids]
    out = []
    for at, (q, a) in enumerate(rows):
        if q % 50 == 0:
            near = sorted((-float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))), i) for j, (i, b) in enumerate(rows) if j != at)
            out += [(q, rank + 1, i, pytest.approx(-far, abs=1e-12)) for rank, (far, i) in enumerate(near[:k])]
    return out


def test_repeated_queries_and_huge_values(spark):
    x = [[1e200, 2e200, 1.0], [1e200, 2e200, 1.0], [2.0, 1.0, 3.0], [1e-200, 3e-200, 0.0], [1.0, -1.0, 0.5]]
    df = spark.createDataFrame([(0, x[0], 1), (0, x[1], 2), (1, x[2], 3), (2, x[3], 4), (3, x[4], 5)], "vec_id long, embedding array<double>, query_id int")
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in ann.search(df, k=2).collect())
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    second = round(cos([1.0, 2.0, 0.0], [1.0, 3.0, 0.0]), 9)
    assert got == [(0, 1, 0, 1.0), (0, 1, 0, 1.0), (0, 2, 2, second), (0, 2, 2, second)]


def test_a_hot_vector(spark):
    """A third of the rows are one vector: copies are cut to k + 1 before the search, and every query is answered."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[::3] = x[0]
    got = {}
    for r in ann.search(vectors(spark, x)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert set(got) == set(range(0, 600, 50))
    for q in got:
        if q % 3 == 0:
            assert [i for _, i in sorted(got[q])] == [i for i in range(0, 21, 3) if i != q][:5]


def test_op6(spark):
    """Recall of the registered query against brute force over the whole table."""
    sf_dir = "/root/testdata/sf0.1"
    if not os.path.isdir(sf_dir):
        pytest.skip("the test tables are not here")
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in queries.op6_ann(spark, sf_dir).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    hit = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        near = unit @ unit[i]
        near[i] = -2
        best = set(ids[np.argsort(-near)[:5]].tolist())
        assert len(got[ids[i]]) == 5
        hit, total = hit + len(best & set(got[ids[i]])), total + 5
    assert total == 5 * len(got) and hit >= 0.9 * total


def test_few_and_no_vectors(spark):
    x = np.eye(3, 16)
    got = ann.search(vectors(spark, x)).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(0, 1, 1), (0, 2, 2)]
    assert ann.search(vectors(spark, x).limit(0)).count() == 0
    assert ann.search(vectors(spark, x, [1, 2, 3])).count() == 0


def test_pigeonhole(spark):
    """Probing retrieves every code within the radii, each once, and nothing else."""
    rng = np.random.default_rng(3)
    codes = rng.integers(-(2**63), 2**63, size=(200, 4))
    codes[100:] = codes[:100] ^ rng.choice([0, 1, 5, 257, 2**40 + 2**50], size=(100, 4))
    rows = spark.createDataFrame([(i, [int(c) for c in row]) for i, row in enumerate(codes)], "cls int, code array<long>")
    far, first = ann.hamming(codes, codes), ann.hamming(codes[:, :1], codes[:, :1])
    for radii in ((0, 0), (3, 20), (9, 256), (25, 110), (31, 130), (64, 256)):
        got = [(r.q, r.v) for r in ann.retrieve(rows.where("cls < 20"), rows, radii, [1, 2, 3, 1] * 512).collect()]
        assert len(got) == len(set(got))
        assert set(got) == {(int(q), int(v)) for q, v in zip(*np.nonzero((far <= radii[1]) & (first <= radii[0]))) if q < 20}
        assert sum(ann.shares(radii[0], 8)) == radii[0] - 7


# HTML


def test_article_and_everything_else():
    stop = "the of and to in is that it was for on are as with his they at be this from " * 3
    page = f"""<!DOCTYPE html><html lang=en><head><title>T</title><style>p{{}}</style><script>var a="</p><article>";</script></head><body>
    <header><a href=/>Site</a></header><nav><ul><li><a href=x>Menu</a></ul></nav><div class="ad banner">{stop}</div><!-- <p>{stop}</p> -->
    <article><h1>Head &amp; line</h1><p>First <b>bo</b>ld&nbsp;text,\n two   spaces<br>{stop}<p>Short.</p><aside>{stop}</aside><form>{stop}</form>
    <ul class="share-buttons"><li>Share</ul><p hidden>{stop}</p><p>Last &lt;one&gt; &#8364;</p><div id=comments><p>{stop}</p></div></article>
    <div class=sidebar>{stop}</div><footer>&copy; x {stop}</footer></body>"""
    assert html_text.extract(page) == f"Head & line First bold text, two spaces {stop.strip()} Short. Last <one> €"


def test_pages_without_an_article():
    stop = ("the cat of the house and the dog in it was on a mat for all that is to be " * 5).strip()
    page = f"<body><div><a href=1>Home</a> <a href=2>News</a></div><h2>Title here</h2><p>{stop}</p><p>Short one.</p><p>{stop}</p><div>Copyright</div><div><a href=3>Imprint</a></div>"
    assert html_text.extract(page) == f"Title here {stop} Short one. {stop}"


def test_an_article_beside_the_main_text():
    stop = ("the cat of the house and the dog in it was on a mat for all that is to be " * 5).strip()
    prose = f"<div>{stop}</div><div>{stop}</div>"
    assert html_text.extract(f"<body>{prose}<article>Read more here</article></body>") == f"{stop} {stop}"
    assert html_text.extract(f"<body><main><h1>A title</h1></main>{prose}</body>").endswith(f"{stop} {stop}")
    # prose outside stays where the container holds more; what is open there goes
    assert html_text.extract(f"<main><p>{stop}</p><p>{stop}</p><p>Short.</p></main><div>{stop}</div><div>Short.</div>") == f"{stop} {stop} Short. {stop}"


GOOD = ("the cat of the house and the dog in it was on a mat for all that is to be seen " * 5).strip()


@pytest.mark.parametrize("name", ["no-sidebar", "content-sidebar-wrap", "has-nav", "social-science", "site has-menu", "ad-free", "sidebar"])
def test_wrappers_of_the_main_part(name):
    assert html_text.extract(f'<body><div class="{name}"><main><p>{GOOD}</p><p>Short.</p></main></div></body>') == f"{GOOD} Short."


@pytest.mark.parametrize("attribute", ['class="post related"', 'id="share-price-report"'])
def test_an_articles_own_name(attribute):
    assert html_text.extract(f"<body><article {attribute}><p>{GOOD}</p></article></body>") == GOOD


@pytest.mark.parametrize("name", ["sidebar", "share-buttons", "cookie-banner", "site-footer", "related posts", "comments", "widget-area"])
def test_boilerplate_by_class(name):
    assert html_text.extract(f'<body><main><p>{GOOD}</p></main><div class="{name}"><p>{GOOD}</p></div></body>') == GOOD
    assert html_text.extract(f'<body><main><p>{GOOD}</p><div class="{name}"><p>{GOOD}</p></div></main></body>') == GOOD


def test_comments_marked_up_as_articles():
    assert html_text.extract(f"<article><p>{GOOD}</p></article><div class=comments><article class=comment><p>{GOOD}</p></article></div>") == GOOD


def test_language_behind_a_long_comment():
    text = ("der Hund und die Katze sind in dem Haus mit vielen anderen Tieren " * 5).strip()
    page = f"<html lang=de><body><div>{text}</div></body></html>"
    assert html_text.extract(page) == html_text.extract(f"<!--{'x' * 9000}-->{page}") == text


def test_text_without_spaces():
    text = "これは日本語の記事です。とても長い文章が続きます。" * 10
    assert html_text.extract(f"<html lang=ja><body><div>{text}</div><ul><li><a href=/>リンク</a></ul></body>") == text


def test_links_around_blocks():
    assert html_text.extract("<body>" + "".join(f"<a href=/{i}><div>{GOOD}</div></a>" for i in range(5))) == ""
    assert html_text.extract(f"<body><a name=top><div>{GOOD}</div>") == GOOD


def test_blocks_between_asides_and_copyright_signs():
    assert html_text.extract(f"<main><h1>Title</h1><aside>{GOOD}</aside><p>{GOOD}</p><aside>{GOOD}</aside><p>End.</p><p>\xa9 is a sign.</p></main>") == f"Title {GOOD} End. \xa9 is a sign."


def test_second_pass():
    b = [html_text.Block(t, 0, False, False, h) for t, h in (("x", False), ("h", True), ("g", False), ("s", False), ("b", False), ("n", False))]
    for x, label in zip(b, ("short", "short", "good", "short", "bad", "near")):
        x.label = label
    html_text.second_pass(b)
    assert [x.label for x in b] == ["bad", "good", "good", "bad", "bad", "bad"]


@pytest.mark.parametrize("page", [None, "", "<", "<!--", "<script>", "<p", "&", "<p>" * 3000, "<div class='" * 3000, "</div>" * 500, "<a 'b\"c>" * 500, "\x00"])
def test_odd_pages(page):
    assert isinstance(html_text.extract(page), str)


def test_long_page():
    words = "the of and to it " * 40_000
    assert html_text.extract(f"<article><p>{words}</p></article>") == words.strip()


def test_op7(spark, sf_dir):
    import re
    from html import unescape

    source = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = queries.op7_html_text(spark, sf_dir).collect()
    assert len(got) == len(source)
    for r in got:
        article = re.search(r"(?s)<article>(.*?)</article>", source[r.page_id])[1]
        assert r.text == " ".join(unescape(re.sub(r"<[^>]*>", " ", article)).split()) and r.n_chars == len(r.text)
    assert html_text.extract_pages(pages(spark, []).withColumn("text", F.lit(""))).columns[-1] == "_text"
    assert html_text.extract_pages(pages(spark, [(1, None), (1, None)])).count() == 2


# Toxicity


def labelled(seed, n, rate=0.15):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w, bad = prose(rng, rng.randrange(5, 120)), rng.random() < rate
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "you", "m0ron", "zorgling", "zorglo", "zorgla"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = labelled(1, 1500)
    d, la = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(d, la.where(~toxicity.held_out(F.col("doc_id"))))
    assert model.trees is not None and "zorgl*" in model.learned
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(d, model).collect()}
    y = {i: t for i, _, t in labels if zlib.crc32(str(i).encode()) % 4 == 2}
    pairs = [(got[a] > got[b]) + 0.5 * (got[a] == got[b]) for a in y if y[a] for b in y if not y[b]]
    assert sum(pairs) / len(pairs) > 0.95
    assert sum((got[i] >= 0.3) == bool(t) for i, t in y.items()) / len(y) > 0.93
    assert all(0 <= s <= 1 for s in got.values())


def test_scores_of_odd_texts(spark):
    model = toxicity.Model({})
    rows = [(1, None), (2, ""), (3, "   "), (4, "you idiot " * 50_000), (4, "clean")]
    got = toxicity.score_toxicity(docs(spark, rows).withColumn("x", F.lit(1)), model).collect()
    assert [r.score for r in got[:3]] == [0, 0, 0] and got[3].score > 0.9 and got[4].score == 0
    assert toxicity.score_toxicity(docs(spark, []), model).count() == 0
    assert toxicity.score_toxicity(docs(spark, []).withColumn("score", F.lit(1)), model).columns[-1] == "_score"
    empty = toxicity.fit(docs(spark, []).withColumns({"_id": F.lit(1), "toxic": F.lit(1)}), spark.createDataFrame([], "doc_id long, toxic int"))
    assert empty.trees is None
    with pytest.warns(UserWarning, match="too few labels"):
        toxicity.fit(docs(spark, []), spark.createDataFrame([], "doc_id long, toxic int"))
    by_name = docs(spark, [(1, "a"), (2, "b")]).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert toxicity.fit(by_name, spark.createDataFrame([("d1", 1)], "doc_id string, toxic int")).trees is None
    null_labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.fit(docs(spark, rows), null_labels).trees is None


def test_features_and_obfuscation():
    t = toxicity.TokenTable({}, most=5)
    f = dict(zip(toxicity.FEATURES, toxicity.features("You are an 1d1ot and st*pid MORON!!", t)))
    assert f["lexicon count"] == 1 and f["hidden lexicon"] == 1 and f["second person"] > 0 and f["near count"] >= 1 and f["shouting"] > 0
    assert not toxicity.features(None, t).any()


def test_isotonic_and_trees():
    x, y = toxicity.isotonic(np.array([1.0, 2.0, 3.0, 4.0]), np.array([0.0, 1.0, 0.0, 1.0]))
    assert (np.diff(y) >= 0).all() and (np.diff(x) > 0).all() and 0 < y[0] and y[-1] < 1
    # equal scores are pooled before anything else
    for toxic in (np.arange(100) < 10, np.arange(100) >= 90):
        x, y = toxicity.isotonic(np.ones(100), toxic.astype(float))
        assert x.tolist() == [1.0] and y == pytest.approx([0.1])
    rng = np.random.default_rng(0)
    data = rng.random((2000, 3)).astype(np.float32)
    labels = ((data[:, 0] > 0.5) ^ (data[:, 1] > 0.5)).astype(float)
    margin = toxicity.boost(data, labels, trees=60).margin(data)
    assert ((margin > 0) == (labels > 0)).mean() > 0.95


def test_op9(spark, sf_dir):
    got = queries.op9_toxicity(spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1


def test_op9_on_held_out_rows(spark):
    """Ranking of the labelled rows that nothing was learned from; the tables at sf0.01 have some 300 others."""
    sf_dir = "/root/testdata/sf0.01"
    if not os.path.isdir(sf_dir):
        pytest.skip("the test tables are not here")
    got = {r.doc_id: r for r in queries.op9_toxicity(spark, sf_dir).collect()}
    y = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.doc_id in got and got[r.doc_id].held_out}
    bad, good = ([got[i].score for i in y if y[i] == t] for t in (1, 0))
    # 305 rows to learn from teach few words
    assert np.mean([(a > b) + 0.5 * (a == b) for a in bad for b in good]) > 0.8
    assert np.mean([s >= 0.3 for s in good]) < 0.1


# SentencePiece


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=spc.MODEL)


def texts_to_encode():
    rng = random.Random(3)
    alphabets = ["ab", "aaab ", "the in er on ", "    a\n", "日本語テキスト ", "😀é x", "0123 ", "abcdefghijklmnopqrstuvwxyz", "=-_*# /\\", "\x00\x80ÿ𝔘 a", ".,;!? 'tsx", " the"]
    out = ["", " ", "a", " a", "a ", "\n", "x" * 5000, " " * 3000, "the quick brown fox" * 500, "▁a ▁", "Don't, won't... (x)"]
    return out + ["".join(rng.choice(rng.choice(alphabets) if rng.random() < 0.02 else a) for _ in range(rng.choice([1, 4, 20, 80, 400]))) for a in alphabets for _ in range(60)]


def test_ids_equal_the_library(library):
    c = spc.codec()
    for t in texts_to_encode():
        ids = c.encode(t)
        assert ids == library.encode(t), t[:80]
        assert c.decode(ids) == library.decode(ids) == t.replace("▁", " ")


def test_streaming_commits_with_a_bounded_window(library):
    c, rng = spc.codec(), random.Random(9)
    text = "▁" + "".join(rng.choice("etaoinshrdlu") for _ in range(20_000))
    search, out, most = spc.StreamingViterbi(c), [], 0
    for i in range(0, len(text), 37):
        out += search.feed(text[i : i + 37])
        most = max(most, len(search.text))
    out += search.finish()
    assert out == library.encode(text[1:]) and most < 400


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(spc, "MEMO", 20)
    c = spc.Codec(spc.MODEL)
    rng = random.Random(1)
    for _ in range(50):
        t = " ".join("".join(rng.choice("abcdef") for _ in range(6)) for _ in range(10))
        assert c.decode(c.encode(t)) == t
    assert len(c.memo) <= 20 and len(c.old) <= 20


def test_columns(spark):
    rows = [(1, None), (2, ""), (3, "Hello\nworld é"), (3, "Hello\nworld é"), (4, "has ▁ mark")]
    got = spc.encode_documents(docs(spark, rows).withColumn("extra", F.lit(1))).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got[:2]] == [0, 0] and [r.round_trip for r in got] == [True, True, True, True, False]
    assert all(r.n_tokens == len(r.token_ids) for r in got)
    back = spc.encode_documents(docs(spark, rows)).select(spc.decode(F.col("token_ids")).alias("t"), spc.encode(F.col("text")).alias("i"), "token_ids").collect()
    assert [r.t for r in back] == ["", "", "Hello\nworld é", "Hello\nworld é", "has   mark"] and all(r.i == r.token_ids for r in back)
    assert spc.encode_documents(docs(spark, [])).count() == 0
    assert spc.encode_documents(docs(spark, []).withColumns({"n_tokens": F.lit(1), "encoded": F.lit(2)})).columns[-3:] == ["token_ids", "_n_tokens", "round_trip"]


def test_op2(spark, sf_dir, library):
    for r in queries.op2_sentencepiece(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        assert r.token_ids == library.encode(r.text) and r.round_trip


# The pipeline


def test_pipeline_on_planted_cases(spark, tmp_path):
    import corpus_pipeline
    from spanforge.llm.shingles import words_of

    rng = random.Random(21)
    tox, labels = labelled(2, 600)
    passage, item = prose(rng, 70), prose(rng, 14)
    clean = [(10_000 + i, " ".join(prose(rng, 90, 10**6))) for i in range(30)]
    base = prose(rng, 150, 10**6)
    near = [(20_000 + i, " ".join(base[:-1] + [f"e{i}"])) for i in range(4)]
    repeat = [(30_000 + i, " ".join(prose(rng, 60, 10**6) + passage + prose(rng, 60, 10**6))) for i in range(3)]
    leak = [(40_000, " ".join(prose(rng, 40, 10**6) + item + prose(rng, 40, 10**6)))]
    odd = [(50_000, None), (50_001, ""), (None, "no id")]
    rows = tox + clean + near + repeat + leak + odd
    clashes = {n: F.lit(n) for n in ("hits", "words", "score", "kept", "spans", "doc", "toxic", "left", "rep", "component_id", "start", "key")}
    docs(spark, rows).withColumns(clashes).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    d, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        before = d.columns
        stage(spark, d, str(tmp_path)).write.parquet(str(tmp_path / name))
        d = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id: r for r in d.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert d.columns == before
    after = list(seen.values())
    assert {i for i, _ in clean} <= set(after[-1])
    bad = {i for i, _, t in labels if t}
    assert len(bad & set(after[0])) < 0.1 * len(bad) and {i for i, _ in rows if (i or 0) >= 10_000} <= set(after[0])
    assert {i for i in after[1] if i and 20_000 <= i < 30_000} == {20_000}
    holders = [i for i in (30_000, 30_001, 30_002) if " ".join(passage) in after[2][i].text]
    assert holders == [30_000] and all(after[2][i].n_chars == len(after[2][i].text) for i in after[2] if after[2][i].text is not None)
    assert 40_000 in after[2] and 40_000 not in after[3]
    kept = brute([(i, r.text) for i, r in after[2].items()], [(1, " ".join(item))])
    assert {x[0] for x in kept if not x[2]} == set(after[3])
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) for r in after[4].values())
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    there = set(os.listdir(shared))
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(after[4])
    # of the tables that it made, only the last one is left
    (left,) = [x for x in set(os.listdir(shared)) - there if any(f.endswith(".parquet") for _, _, fs in os.walk(f"{shared}/{x}") for f in fs)]
    assert [x.split("-", 1)[1] for x in os.listdir(f"{shared}/{left}")] == ["sentencepiece"]
    # every row is a document of its own: copies without an id, or with another's id, go too
    t = " ".join(prose(rng, 30))
    got = corpus_pipeline.minhash(spark, docs(spark, [(1, t), (None, t), (None, ""), (None, t + " end"), (2, "x"), (2, "x"), (2, "y"), (None, "z"), (None, "z")]), str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [("1", t), ("2", "x"), ("2", "y"), ("None", ""), ("None", "z")]
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs(spark, []), str(tmp_path)).count() == 0
    assert words_of("A b") == [b"a", b"b"]


def test_registry():
    assert [q for q in queries.queries() if q.startswith("op")] and set(queries.oracle_sql()) <= set(queries.queries())
    assert sorted(int(q[2:].split("_")[0]) for q in queries.queries()) == list(range(1, 11))
