import duckdb
import pytest
from pyspark.sql import functions as F

from spanforge.plans.query import Query, Selected, condition, estimate_and, estimate_or, estimate_selectivity, query_by_span, query_high_confidence
from spanforge.schema import CATEGORY, FACTS, category, complete, predicate_table, subject



def facts(spark, rows):
    """rows: (predicate, start, end, confidence[, number]); ids from 1."""
    data = [(i + 1, "s", r[1], r[2], r[0], float(r[3]), r[4] if len(r) > 4 else None) for i, r in enumerate(rows)]
    return complete(spark.createDataFrame(data, "id long, source string, span_start long, span_end long, predicate string, confidence double, value_number long"))


@pytest.fixture
def three(spark):
    return facts(spark, [("is_function", 1, 17, 0.95), ("is_class", 32, 64, 0.85), ("is_function", 48, 96, 0.75)])


def test_confidence_filter(three):
    assert query_high_confidence(0.8)(three).count() == 2


def test_select_predicates(spark):
    f = facts(spark, [(p, i, i + 16, 1.0) for i, p in enumerate(("is_function", "is_class", "is_method", "is_token"))])
    assert Query().select("is_function", "is_method")(f).count() == 2


def test_order_descending_and_limit(spark):
    f = facts(spark, [("is_token", i, i + 1, c) for i, c in enumerate((0.9, 0.5, 0.7, 0.3, 0.8))])
    assert [r.confidence for r in Query().order_by("confidence", True).limit(3)(f).collect()] == [0.9, 0.8, 0.7]


def test_limit_and_offset(spark):
    f = facts(spark, [("is_token", i, i + 1, 1.0) for i in range(10)])
    assert [r.id for r in Query().limit(3).offset(5)(f).collect()] == [6, 7, 8]
    assert Query().limit(3).offset(50)(f).count() == 0


def test_combined(spark):
    f = facts(spark, [("is_function" if i % 2 else "is_class", i, i + 10 * i, i / 20) for i in range(20)])
    got = Query().where("confidence", ">=", 0.5).and_where("span.length", "<=", 150).order_by("confidence", True).limit(5)(f).collect()
    assert 0 < len(got) <= 5 and all(r.confidence >= 0.5 and r.span_end - r.span_start <= 150 for r in got)


def test_hundred_facts(spark):
    f = facts(spark, [(("is_function", "is_class", "is_variable")[i % 3], i, i + 1, i / 100, i) for i in range(100)])
    assert Query().where("predicate", "=", "is_function").where("confidence", ">=", 0.5)(f).count() == 17


def test_every_second_of_fifty(spark):
    f = facts(spark, [("is_class" if i % 2 else "is_function", i, i + 1, 1.0) for i in range(50)])
    assert Query().where("predicate", "=", "is_function")(f).count() == 25


def test_best_of_two_predicates(spark):
    f = facts(spark, [("is_function", 0, 10, 0.95), ("is_function", 10, 20, 0.75), ("is_class", 20, 30, 0.85), ("is_variable", 30, 40, 0.65)])
    got = Query().select("is_function", "is_class").where("confidence", ">=", 0.7).order_by("confidence", True).limit(2)(f)
    assert [r.confidence for r in got.collect()] == [0.95, 0.85]


def test_or_takes_everything_before_it(three):
    q = Query().where("confidence", ">", 0.9).or_where("predicate", "=", "is_class").where("span.start", ">", 10)
    assert [r.id for r in q(three).collect()] == [2]
    assert "((((confidence > 0.9) OR (predicate = 'is_class'))" in q.to_sql().replace("WHERE ", "WHERE (")


def test_nulls_are_three_valued(spark):
    f = facts(spark, [("a", 0, 1, 1.0, 5), ("a", 0, 1, 1.0, None)])
    assert Query().where("value.number", "not in", [1])(f).count() == 1
    assert Query().where_not("value.number", "=", 1)(f).count() == 1
    assert Query().where("value.number", "is null")(f).count() == 1
    assert Query().where("value.number", "in", [])(f).count() == 0


def test_aggregates_and_having(spark):
    f = facts(spark, [("a", 0, 1, 0.5, 1), ("a", 0, 1, 0.5, 3), ("b", 0, 1, 0.5, 9)])
    q = Query().group_by("predicate").select_fields(Selected("value.number", "sum", "total"), Selected("value.number", "first", "first")).having("count", "*", ">", 1)
    assert [tuple(r) for r in q(f).collect()] == [("a", 4, 1)]
    assert [r.id for r in Query().first_per_group("predicate")(f).orderBy("id").collect()] == [1, 3]


def test_span_query_and_empty_table(spark, three):
    assert [r.id for r in query_by_span(30, 70)(three).collect()] == [2]
    assert Query().order_by("confidence").limit(1)(three.limit(0)).count() == 0


def test_errors():
    with pytest.raises(KeyError):
        condition("nothing", "=", 1)
    with pytest.raises(ValueError):
        condition("id", "resembles", 1)


def test_sql_quotes(spark, three):
    q = Query().where("predicate", "=", "it's").select_fields("id")
    con = duckdb.connect()
    con.sql("CREATE TABLE facts AS SELECT 1 AS id, 'it''s' AS predicate")
    assert con.sql(q.to_sql()).fetchall() == [(1,)]


def test_dimension(spark, three):
    assert predicate_table(spark).count() == len(CATEGORY) == 54
    got = {r[0]: r[1] for r in spark.createDataFrame([("is_token",), ("json_is_key",), ("x",)], "p string").select("p", category(F.col("p"))).collect()}
    assert got == {"is_token": "lexical", "json_is_key": "language_specific", "x": "unknown"}
    assert three.select(subject().alias("s")).first().s == (1 << 32) + 16
    assert len(three.columns) == FACTS.count(",") + 1 - 1


def test_selectivity():
    assert estimate_selectivity("predicate", "=") == 0.05
    assert estimate_selectivity("id", "between") == 0.2
    assert abs(estimate_and([0.5, 0.2]) - 0.1) < 1e-12 and abs(estimate_or([0.5, 0.2]) - 0.6) < 1e-12
