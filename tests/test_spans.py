from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanforge.functions.span import Span
from spanforge.operators import spans


def rows(spark, data):
    return spark.createDataFrame([("k", a, b) for a, b in data], "k string, start long, end long")


def test_normalize_and_coverage(spark):
    df = rows(spark, [(0, 10), (5, 15), (20, 30), (25, 35), (35, 36), (50, 50)])
    for bucket in (None, 7, 1000):
        assert sorted(tuple(r)[1:] for r in spans.normalize(df, ["k"], bucket).collect()) == [(0, 15), (20, 36)]
    got = spans.coverage(df, ["k"]).first()
    assert (got.covered, got.n_islands) == (31, 2)
    assert spans.normalize(df.limit(0), ["k"]).count() == 0


def test_span_functions(spark):
    a, b = Span.of(10, 20), Span.of(30, 40)
    pair = lambda s: F.struct(s.start, s.end)
    one = spark.range(1).select(
        a.before(b), a.after(b), a.distance(b), pair(a.extend(25)), pair(a.expand(5)), pair(a.shift(10)), pair(a.split(15)[0]), pair(a.split(15)[1]),
        a.intersect(b), pair(a.merge(b)), pair(a.shrink(6)), a.contains(19), a.contains(20), Span.empty().is_empty(), Span.point(3).length(), Span.of(2, 5).slice(F.lit("abcdefg")), pair(a.split(99)[1]),
    ).first()
    assert [tuple(x) if hasattr(x, "asDict") else x for x in one] == [
        True, False, 10, (10, 26), (5, 25), (20, 30), (10, 15), (15, 20), None, (10, 40), (0, 0), True, False, True, 1, "cde", (20, 20),
    ]


def test_overlap_join_finds_each_pair_once(spark):
    left, right = [(0, 100), (3, 4), (7, 7)], [(2, 5), (50, 60), (99, 120), (100, 101)]
    got = spans.overlap_join(rows(spark, left), rows(spark, right), ["k"], 10).collect()
    assert sorted((r.start, r.end, r.r_start, r.r_end) for r in got) == sorted((a, b, c, d) for a, b in left for c, d in right if a < b and a < d and c < b)
    inside = spans.overlap_join(rows(spark, left), rows(spark, right), ["k"], 10, within=True).collect()
    assert sorted((r.r_start, r.r_end) for r in inside) == [(2, 5), (50, 60)]


def test_remove_and_hull(spark):
    df = rows(spark, [(0, 5), (4, 9), (20, 30)])
    assert sorted((r.start, r.end) for r in spans.remove(df, rows(spark, [(4, 5)]), ["k"], 4).collect()) == [(20, 30)]
    assert tuple(spans.hull(df, ["k"]).first()) == ("k", 0, 30)
    assert spans.covering(df, ["k"], 25).first().held and not spans.covering(df, ["k"], 15).first().held


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 15)), max_size=12))
def test_normalize_is_the_union(spark, data):
    data = [(a, a + n) for a, n in data]
    df = rows(spark, data)
    merged = spans.normalize(df, ["k"], 16)
    got = sorted(tuple(r)[1:] for r in merged.collect())
    assert {p for a, b in got for p in range(a, b)} == {p for a, b in data for p in range(a, b)}
    assert all(x[1] < y[0] for x, y in zip(got, got[1:]))
    assert sorted(tuple(r)[1:] for r in spans.normalize(merged, ["k"]).collect()) == got


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 2**32 - 1), st.integers(0, 2**31))
def test_pack_round_trip(spark, start, length):
    packed = Span.of(start, start + length).pack()
    back = spark.range(1).select(Span.unpack(packed).start, Span.unpack(packed).end).first()
    assert tuple(back) == (start, start + length)
