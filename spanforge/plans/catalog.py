"""The registry of queries over the provided tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chars, dates, patterns, text, unicode
from ..functions.span import Span
from ..operators import index, jsonx, spans, streams, zon
from ..schema import category
from ..sources import facts as sources
from ..sources import files
from ..sources.facts import table
from ..streaming import events as streaming
from .query import Query, Selected, query_by_predicate, query_by_span, query_high_confidence

ADAPTERS = {
    "events": (sources.facts_from_events, sources.EVENTS_SQL),
    "documents": (sources.facts_from_documents, sources.DOCUMENTS_SQL),
    "lineitem": (sources.facts_from_lineitem, sources.LINEITEM_SQL),
    "pages": (sources.facts_from_pages, sources.PAGES_SQL),
}
_queries: dict[str, Callable] = {}
_sql: dict[str, str] = {}


def register(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    run.__name__ = name
    _queries[name] = run
    if sql is not None:
        _sql[name] = sql


def facts_query(name: str, query: Query, adapter: str = "events") -> None:
    """A fluent query: its plan and the SQL that it prints."""
    load, sql = ADAPTERS[adapter]
    register(name, lambda spark, d: query(load(spark, d)), f"WITH facts AS ({sql}) {query.to_sql()}")


def on_facts(name: str, run: Callable[[DataFrame], DataFrame], sql: str, adapter: str = "events") -> None:
    load, facts = ADAPTERS[adapter]
    register(name, lambda spark, d: run(load(spark, d)), f"WITH facts AS ({facts}) {sql}")


def on_table(name: str, source: str, run: Callable[[DataFrame], DataFrame], sql: str | None) -> None:
    register(name, lambda spark, d: run(table(spark, d, source)), sql)


def shown(name: str, source: str, key: str, **columns) -> None:
    """Columns over a table, each as a pair of a Spark expression (made when it is run) and SQL."""
    keys = key.split()
    sql = ", ".join([*keys, *(f"{s} AS {c}" for c, (_, s) in columns.items())])
    on_table(name, source, lambda df: df.select(*keys, *[e().alias(c) for c, (e, _) in columns.items()]), f"SELECT {sql} FROM {source}")


# Filters

S = Selected
facts_query("facts_demo_topk", Query().where("confidence", ">=", 0.8).order_by("confidence", True).limit(10))
facts_query("facts_documents", Query(), "documents")
facts_query("facts_lineitem_filter", Query().select("R").where("confidence", ">=", 0.5).where("span.length", ">", 40), "lineitem")
facts_query("facts_pages_tags", Query().group_by("predicate", "value.text").select_fields(S("*", "count", "n")), "pages")
facts_query("select_all", query_high_confidence(0.0).select_all())
facts_query("where_cmp", Query().where("value.number", ">", 50).where("span.length", "!=", 7))
facts_query("where_and", Query().where("confidence", ">=", 0.5).and_where("value.number", "<", 40).and_where("predicate", "=", "click"))
facts_query("where_or_leftassoc", Query().where("confidence", ">=", 0.9).or_where("predicate", "=", "error").where("value.number", ">", 10))
facts_query("where_not", Query().where_not("predicate", "=", "view").where_not("confidence", "<", 0.3))
facts_query("where_in", Query().where_in("predicate", ["click", "signup"]))
facts_query("where_not_in", Query().where("predicate", "not in", ["click", "signup"]))
facts_query("where_between", Query().where_between("value.number", 10, 20))
facts_query("where_not_between", Query().where("value.number", "not between", (10, 90)))
facts_query("where_like", Query().where("predicate", "like", "%ic%"))
facts_query("where_not_like", Query().where("predicate", "not like", "s%"))
facts_query("where_is_null", Query().where("value.atom", "is null").where("confidence", ">", 0.9))
facts_query("where_is_not_null", Query().where("value.number", "is not null").where("confidence", ">", 0.9))
facts_query("where_span", query_by_span(86400, 864000))
facts_query("where_predicate", query_by_predicate("purchase"))
facts_query("where_predicate_any", Query().select("purchase", "error"))
facts_query("where_subject", Query().where("subject", ">=", 864000 << 32).select_fields("id", "subject"))

# Order, paging, projection, aggregates

facts_query("order_multi", Query().order_by("predicate").order_by("confidence", True).limit(500))
facts_query("limit_offset", Query().where("confidence", ">=", 0.5).order_by("value.number").limit(30).offset(50))
facts_query("topk", Query().order_by("span.length", True).limit(25))
facts_query("select_fields", Query().select_fields("id", S("span.length", alias="length"), S("confidence", alias="c"), "value.type", "generation").where("predicate", "=", "error"))
for _agg, _field in (("count", "*"), ("sum", "value.number"), ("min", "confidence"), ("max", "span.end"), ("first", "value.number"), ("last", "predicate"), ("count_distinct", "source")):
    facts_query(f"agg_{_agg}", Query().select_fields(S(_field, _agg, "result")))
on_facts("agg_avg", lambda f: Query().select_fields(S("value.number", "avg", "result"))(f).select(F.round("result", 6).alias("result")), "SELECT round(avg(value_number), 6) AS result FROM facts")
facts_query("group_multi", Query().group_by("predicate", "value.number").select_fields(S("*", "count", "n"), S("span.length", "max", "longest")))
facts_query("group_first_last", Query().group_by("source").select_fields(S("predicate", "first", "first_predicate"), S("value.number", "last", "last_number")))
facts_query("having", Query().group_by("source").select_fields(S("*", "count", "n")).having("count", "*", ">=", 3).order_by("source"))
facts_query("having_max", Query().group_by("value.number").select_fields(S("span.length", "sum", "total")).having("max", "confidence", ">", 0.95))
facts_query("first_row_per_group", Query().first_per_group("predicate", "value.number"))

# Index paths

facts_query("by_predicate", query_by_predicate("click"))
def _same_span(f: DataFrame) -> DataFrame:
    one = f.where("id = 77").first()
    return index.by_span(f, one.span_start, one.span_end).select("id")


on_facts("by_span", _same_span, "SELECT id FROM facts WHERE (span_start, span_end) = (SELECT (span_start, span_end) FROM facts WHERE id = 77)")
on_facts("by_confidence", lambda f: index.by_confidence(f, 0.7, 0.75).select("id", "confidence"), "SELECT id, confidence FROM facts WHERE confidence BETWEEN 0.7 AND 0.75")
on_facts("by_complex", lambda f: index.by_all(f, "error", None, (0.5, 1.0)).select("id"), "SELECT id FROM facts WHERE predicate = 'error' AND confidence BETWEEN 0.5 AND 1.0")
on_facts("confidence_histogram", index.confidence_histogram, "SELECT CAST(least(floor(confidence * 10), 10) AS BIGINT) AS bucket, count(*) AS n FROM facts GROUP BY 1")
_CATEGORY = "CASE WHEN predicate IN ('has_text') THEN 'lexical' WHEN predicate IN ('starts_block', 'ends_block') THEN 'structural' ELSE 'unknown' END"
on_facts("category_rollup", index.category_rollup, f"SELECT category, predicate, count(*) AS n FROM (SELECT {_CATEGORY} AS category, predicate FROM facts) GROUP BY ROLLUP (category, predicate)", "documents")
on_facts("category_of", lambda f: f.groupBy(category(F.col("predicate")).alias("category")).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("total")), f"SELECT {_CATEGORY} AS category, CAST(sum(span_end - span_start) AS BIGINT) AS total FROM facts GROUP BY 1", "documents")
facts_query("point_lookup", Query().where("id", "=", 77))
facts_query("id_range", Query().where("id", ">=", 100).where("id", "<", 200))
on_facts("store_append", lambda f: index.append(f.where("id <= 500"), f.where("id > 500 and predicate = 'error'"), "id", 2).select("id", "predicate", "generation", "value_number"), "SELECT id, predicate, generation, value_number FROM facts WHERE id <= 500 UNION ALL SELECT 500 + row_number() OVER (ORDER BY id), predicate, 2, value_number FROM facts WHERE id > 500 AND predicate = 'error'")
on_facts("store_compact", lambda f: index.compact(f, 0.6).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")), "SELECT count(*) AS n, min(id) AS first_id FROM facts WHERE confidence >= 0.6")
on_facts("store_stats", index.store_stats, "SELECT generation, count(*) AS n_facts, min(id) AS first_id, max(id) AS last_id FROM facts GROUP BY generation")

# Span functions: a fact's span against another one made from it

_A = lambda: Span.of("span_start", "span_end")
_B = lambda: Span.of(F.col("span_start") + F.col("id") % 50 - 25, F.col("span_start") + F.col("id") % 50 - 25 + F.col("value_number"))
_PAIR = f"(SELECT id, span_start AS s, span_end AS e, span_start + id % 50 - 25 AS bs, span_start + id % 50 - 25 + value_number AS be, span_start + value_number - 20 AS p FROM ({sources.EVENTS_SQL}))"
_P = lambda: F.col("span_start") + F.col("value_number") - 20


def span_query(name: str, **columns) -> None:
    load, _ = ADAPTERS["events"]
    sql = ", ".join(f"{s} AS {c}" for c, (_, s) in columns.items())
    register(name, lambda spark, d: load(spark, d).select("id", *[e().alias(c) for c, (e, _) in columns.items()]), f"SELECT id, {sql} FROM {_PAIR}")


def both(span: Callable[[], Span], start: str, end: str, prefix: str = "") -> dict:
    return {f"{prefix}start_": (lambda: span().start, start), f"{prefix}end_": (lambda: span().end, end)}


span_query("span_len", length=(lambda: _A().length(), "greatest(e - s, 0)"), is_empty=(lambda: _A().is_empty(), "s >= e"))
span_query("span_contains", held=(lambda: _A().contains(_P()), "p >= s AND p < e"), spans=(lambda: _A().contains_span(_B()), "bs >= s AND be <= e"), same=(lambda: _A().equals(_B()), "s = bs AND e = be"))
span_query("span_overlaps", overlaps=(lambda: _A().overlaps(_B()), "s < be AND bs < e"))
span_query("span_merge", **both(lambda: _A().merge(_B()), "least(s, bs)", "greatest(e, be)"))
span_query("span_intersect", start_=(lambda: _A().intersect(_B())["start"], "CASE WHEN greatest(s, bs) < least(e, be) THEN greatest(s, bs) END"), end_=(lambda: _A().intersect(_B())["end"], "CASE WHEN greatest(s, bs) < least(e, be) THEN least(e, be) END"))
span_query("span_distance", distance=(lambda: _A().distance(_B()), "greatest(0, bs - e, s - be)"))
span_query("span_before_after", before=(lambda: _A().before(_B()), "e <= bs"), after=(lambda: _A().after(_B()), "s >= be"))
span_query("span_extend", **both(lambda: _A().extend(_P()), "least(s, p)", "greatest(e, p + 1)"))
span_query("span_shrink", **both(lambda: _A().shrink(10), "CASE WHEN s + 10 < e - 10 THEN s + 10 ELSE 0 END", "CASE WHEN s + 10 < e - 10 THEN e - 10 ELSE 0 END"))
span_query("span_expand", **both(lambda: _A().expand(100000), "greatest(s - 100000, 0)", "e + 100000"))
span_query("span_shift", **both(lambda: _A().shift(-500000), "greatest(s - 500000, 0)", "greatest(e - 500000, 0)"))
_cut = "greatest(least(p, e), s)"
span_query("span_split", **both(lambda: _A().split(_P())[0], "s", _cut, "left_"), **both(lambda: _A().split(_P())[1], _cut, "e", "right_"))
span_query("span_relpos", position=(lambda: F.round(_A().relative_position(_P()), 9), "round(coalesce(greatest(least((p - s)::DOUBLE / nullif(greatest(e - s, 0), 0), 1.0), 0.0), 0.0), 9)"))
span_query("span_clamp_center", clamped=(lambda: _A().clamp(_P()), "least(greatest(p, s), e)"), center=(lambda: _A().center(), "s + greatest(e - s, 0) // 2"))
span_query("span_pack_unpack", packed=(lambda: _A().pack(), "s * 4294967296 + greatest(e - s, 0)"), **both(lambda: Span.unpack(_A().pack()), "s", "s + greatest(e - s, 0)"))

# Span sets: one per user

_SET = lambda: (F.col("source"), F.col("span_start").alias("start"), (F.col("span_end") + F.col("value_number") * 600).alias("end"), F.col("id"), F.col("predicate"))
_SET_SQL = "s AS (SELECT source, span_start AS start_, span_end + value_number * 600 AS end_, id, predicate FROM facts)"
_ISLANDS = f"""{_SET_SQL},
m AS (SELECT source, start_, end_, max(end_) OVER (PARTITION BY source ORDER BY start_, end_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM s WHERE start_ < end_),
g AS (SELECT *, sum(CASE WHEN pm IS NULL OR pm < start_ THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY start_, end_ ROWS UNBOUNDED PRECEDING) AS island FROM m),
n AS (SELECT source, min(start_) AS start_, max(end_) AS end_ FROM g GROUP BY source, island)"""


def set_query(name: str, run: Callable[[DataFrame], DataFrame], sql: str) -> None:
    renamed = lambda df: df.select(*[F.col(c).alias({"start": "start_", "end": "end_"}.get(c, c)) for c in df.columns])
    on_facts(name, lambda f: renamed(run(f.select(*_SET()))), "".join(sql))


def _with(sql: str) -> str:
    return f"SELECT * FROM (WITH {sql})"


set_query("span_normalize", lambda s: spans.normalize(s, ["source"], 86400), _with(f"{_ISLANDS} SELECT source, start_, end_ FROM n"))
set_query("span_coverage", lambda s: spans.coverage(s, ["source"]), _with(f"{_ISLANDS} SELECT source, CAST(sum(end_ - start_) AS BIGINT) AS covered, count(*) AS n_islands FROM n GROUP BY source"))
set_query("span_hull", lambda s: spans.hull(s, ["source"]), _with(f"{_SET_SQL} SELECT source, min(start_) AS start_, max(end_) AS end_ FROM s WHERE start_ < end_ GROUP BY source"))
set_query("span_remove", lambda s: spans.remove(s.where("predicate <> 'error'"), s.where("predicate = 'error'"), ["source"], 43200).select("source", "start", "end", "id"), _with(f"{_SET_SQL} SELECT source, start_, end_, id FROM s a WHERE predicate <> 'error' AND start_ < end_ AND NOT EXISTS (SELECT 1 FROM s b WHERE b.predicate = 'error' AND b.start_ < b.end_ AND a.source = b.source AND a.start_ < b.end_ AND b.start_ < a.end_)"))
_JOIN = "FROM s a JOIN s b ON a.source = b.source AND a.predicate = 'click' AND b.predicate = 'error' AND a.start_ < a.end_ AND b.start_ < b.end_"
set_query("span_overlap_join", lambda s: spans.overlap_join(s.where("predicate = 'click'"), s.where("predicate = 'error'"), ["source"], 43200).select("id", "r_id"), _with(f"{_SET_SQL} SELECT a.id, b.id AS r_id {_JOIN} AND a.start_ < b.end_ AND b.start_ < a.end_"))
set_query("span_containment_join", lambda s: spans.overlap_join(s.where("predicate = 'click'"), s.where("predicate = 'error'"), ["source"], 43200, True).select("id", "r_id"), _with(f"{_SET_SQL} SELECT a.id, b.id AS r_id {_JOIN} AND b.start_ >= a.start_ AND b.end_ <= a.end_"))
set_query("span_covering", lambda s: spans.covering(s, ["source"], 1000000), _with(f"{_SET_SQL} SELECT source, bool_or(start_ <= 1000000 AND 1000000 < end_) AS held FROM s GROUP BY source"))

# Streams in the order of event_id

on_table("stream_map", "events", lambda e: e.select("event_id", (F.col("value") * 2 + 1).alias("mapped")), "SELECT event_id, value * 2 + 1 AS mapped FROM events")
on_table("stream_filter", "events", lambda e: e.where("event_id % 2 = 0 and value > 40").select("event_id", "value"), "SELECT event_id, value FROM events WHERE event_id % 2 = 0 AND value > 40")
on_table("stream_take", "events", lambda e: streams.take(e, "event_id", 100).select("event_id", "event_type"), "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 100")
on_table("stream_drop", "events", lambda e: streams.drop(e, "event_id", 9000).select("event_id", "event_type"), "SELECT event_id, event_type FROM events ORDER BY event_id OFFSET 9000")
on_table("stream_batch", "events", lambda e: streams.batch(e, "event_id", 64, F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")), "SELECT batch, count(*) AS n_items, min(event_id) AS first_id, max(event_id) AS last_id FROM (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 64 AS batch FROM events) GROUP BY batch")
on_table("stream_merge", "events", lambda e: streams.merge(e.where("event_type = 'click'"), e.where("event_type = 'error'"), "event_id").select("event_id", "position"), "WITH r AS (SELECT event_id, CASE WHEN event_type = 'click' THEN 0 ELSE 1 END AS side, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events WHERE event_type IN ('click', 'error')) SELECT event_id, row_number() OVER (ORDER BY CASE WHEN rn <= (SELECT min(m) FROM (SELECT max(rn) AS m FROM r GROUP BY side)) THEN rn ELSE rn END, side) - 1 AS position FROM r")
on_table("stream_last_n", "events", lambda e: streams.last_n(e, ["user_id"], "event_id", 3).select("user_id", "event_id"), "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3")
on_table("stream_count", "events", lambda e: e.agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM events")
on_table("stream_dedupe", "events", lambda e: streams.first_of(e, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id"), "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")

# Text, characters, patterns, unicode

_T = lambda: F.col("text")
_U = lambda: F.col("url")
shown("line_count", "documents", "doc_id", n_lines=(lambda: text.count_lines(_T()), "CAST(len(string_split(text, chr(10))) AS BIGINT)"))
shown("nonblank_lines", "documents", "doc_id", n=(lambda: text.count_non_empty_lines(_T()), r"CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '')) AS BIGINT)"))
shown("lines_prefix", "documents", "doc_id", n=(lambda: F.size(text.lines_with_prefix(_T(), "Th")).cast("bigint"), "CAST(len(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, 'Th'))) AS BIGINT)"))
shown("lines_containing", "documents", "doc_id", found=(lambda: F.array_join(text.lines_containing(_T(), "tion"), "|"), "array_to_string(list_filter(string_split(text, chr(10)), lambda x: contains(x, 'tion')), '|')"))
shown("trim_sets", "documents", "doc_id", trimmed=(lambda: text.trim_all(F.concat(F.lit(" \t"), "text", F.lit("\n "))), r"trim(text, ' ' || chr(9) || chr(13) || chr(10))"), blank=(lambda: text.is_blank(F.when(F.col("doc_id") % 2 == 0, F.lit(" \t")).otherwise(_T())), "doc_id % 2 = 0"))
shown("split_trim", "documents", "doc_id", n=(lambda: F.size(text.parse_comma_separated(_T())).cast("bigint"), r"CAST(len(list_filter(list_transform(string_split(text, ','), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(10))), lambda x: x <> '')) AS BIGINT)"))
shown("count_char", "documents", "doc_id", n=(lambda: text.count_char(_T(), "e"), "CAST(length(text) - length(replace(text, 'e', '')) AS BIGINT)"))
shown("count_balance", "pages", "page_id", n=(lambda: text.count_balance(F.col("html"), "<", ">"), "CAST((length(html) - length(replace(html, '<', ''))) - (length(html) - length(replace(html, '>', ''))) AS BIGINT)"))
shown("extract_between", "pages", "page_id", title=(lambda: text.extract_between(F.col("html"), "<title>", "</title>"), "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"), n_links=(lambda: F.size(text.extract_all_between(F.col("html"), "<a ", "</a>")).cast("bigint"), "CAST(len(regexp_extract_all(html, '(?s)<a (.*?)</a>', 1)) AS BIGINT)"))
shown("indent_level", "events", "event_id", level=(lambda: text.indent_level(F.concat(F.repeat(F.lit(" "), (F.col("event_id") % 13).cast("int")), F.lit("x"))), "CAST((event_id % 13) // 4 AS BIGINT)"))
shown("strip_ansi", "events", "event_id", plain=(lambda: text.strip_ansi(F.concat(F.lit("\x1b[1;31m"), "event_type", F.lit("\x1b[0m"))), "regexp_replace(chr(27) || '[1;31m' || event_type || chr(27) || '[0m', chr(27) || '\\[[^A-Za-z]*[A-Za-z]', '', 'g')"))
shown("pad", "events", "event_id", right_=(lambda: text.pad_right(F.col("event_type"), 6, "."), "CASE WHEN length(event_type) >= 6 THEN event_type ELSE rpad(event_type, 6, '.') END"), left_=(lambda: text.pad_left(F.col("event_type"), 6), "CASE WHEN length(event_type) >= 6 THEN event_type ELSE lpad(event_type, 6, ' ') END"))
shown("fence_len", "documents", "doc_id", n=(lambda: text.fence_length(F.concat("text", F.repeat(F.lit("`"), (F.col("doc_id") % 6).cast("int")))), "CAST(greatest(3, coalesce(list_max(list_transform(regexp_extract_all(text || repeat('`', CAST(doc_id % 6 AS INTEGER)), '(`+)', 1), lambda x: length(x))), 0) + 1) AS BIGINT)"))
_K = lambda: F.get_json_object("props", "$.k").cast("bigint")
_K_SQL = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_LINE = lambda: F.concat(F.when(_K() % 3 == 0, "  // ").when(_K() % 3 == 1, "# ").otherwise(""), "event_type")
shown("comment_lines", "events", "event_id", is_c=(lambda: text.is_comment(_LINE(), "c"), f"{_K_SQL} % 3 = 0"), is_hash=(lambda: text.is_comment(_LINE(), "hash"), f"{_K_SQL} % 3 = 1"))
shown("extract_lines", "documents", "doc_id", kept=(lambda: text.extract_lines(_T(), ["The", "Th"]), r"array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: starts_with(ltrim(x, ' ' || chr(9)), 'Th')), lambda x: x || chr(10)), '')"))
_ESCAPED = "text"
for _a, _b in (("'\\'", "'\\\\'"), ("chr(34)", "'\\' || chr(34)"), ("chr(10)", "'\\n'"), ("chr(13)", "'\\r'"), ("chr(9)", "'\\t'")):
    _ESCAPED = f"replace({_ESCAPED}, {_a}, {_b})"
shown("escape_json", "documents", "doc_id", escaped=(lambda: text.escape(_T(), "json"), _ESCAPED))
shown("unescape_json", "documents", "doc_id", text_=(lambda: text.unescape(text.escape(_T(), "json")), "text"))
shown("unicode_escapes", "documents", "doc_id", size=(lambda: F.length(unicode.format_escapes(_T())).cast("bigint"), r"CAST(length(text) + 5 * len(regexp_extract_all(text, '[^\x00-\x7F]')) + 6 * len(regexp_extract_all(text, '[\x{10000}-\x{10FFFF}]')) AS BIGINT)"), back=(lambda: unicode.parse_escapes(unicode.format_escapes(_T())), "text"))
shown("escape_html", "pages", "page_id", escaped=(lambda: text.escape(F.col("html"), "html"), "replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '\'\'', '&#39;')".replace("'\'\''", "chr(39)")))
_QUOTED = lambda: F.when(_K() % 3 == 0, text.add_quotes(F.col("event_type"), "single")).when(_K() % 3 == 1, text.add_quotes(F.col("event_type"), "double")).otherwise(F.col("event_type"))
shown("quotes", "events", "event_id", style=(lambda: text.quote_style(_QUOTED()), f"CASE {_K_SQL} % 3 WHEN 0 THEN 'single' WHEN 1 THEN 'double' END"), stripped=(lambda: text.strip_quotes(_QUOTED()), "event_type"))
shown("quotes_ensured", "events", "event_id", quoted=(lambda: text.ensure_quoted(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("'"), "event_type", F.lit("'"))).otherwise(F.col("event_type"))), "CASE WHEN event_id % 2 = 0 THEN '''' || event_type || '''' ELSE '\"' || event_type || '\"' END"), conflict=(lambda: text.has_quote_conflicts(F.col("event_type"), "single"), "false"))
shown("terminal_output", "events", "event_id", clean=(lambda: text.clean_terminal_output(F.concat(F.lit("\x1b[1m"), "event_type", F.lit("\x1b[0m \r\n\n  x"))), "event_type || chr(10) || '  x'"), section=(lambda: text.markdown_section(F.col("event_type"), F.lit("b")), "'## ' || event_type || chr(10) || chr(10) || 'b' || chr(10)"), bar=(lambda: text.progress_bar(F.col("event_id") % 5, F.lit(4), 4), "'[' || repeat('#', CAST(event_id % 5 AS INTEGER)) || repeat('-', CAST(4 - event_id % 5 AS INTEGER)) || '] ' || CAST((event_id % 5) * 25 AS INTEGER) || '%'"))
shown("repeat_join", "events", "event_id", echoed=(lambda: text.repeat_join(F.col("event_type"), 3, "-"), "event_type || '-' || event_type || '-' || event_type"))
shown("char_classes", "documents", "doc_id", digits=(lambda: chars.count_class(_T(), "digit"), "CAST(len(regexp_extract_all(text, '[0-9]')) AS BIGINT)"), upper=(lambda: chars.count_class(_T(), "upper"), "CAST(len(regexp_extract_all(text, '[A-Z]')) AS BIGINT)"), delimiters=(lambda: chars.count_class(_T(), "delimiter"), r"CAST(len(regexp_extract_all(text, '[(){}\[\];:,.]')) AS BIGINT)"))
shown("consumers", "events", "event_id", identifier=(lambda: chars.consume(F.concat("event_type", F.lit("_1 x")), "identifier"), "CAST(length(event_type) + 2 AS BIGINT)"), number=(lambda: chars.consume(F.concat(F.col("event_id").cast("string"), F.lit(".5e3x")), "number"), "CAST(length(CAST(event_id AS VARCHAR)) + 4 AS BIGINT)"))
shown("glob_match", "pages", "page_id", news=(lambda: patterns.matches_glob(_U(), "https://*.example.???/[a-m]*"), r"regexp_matches(url, '(?s)^https://.*\.example\....' || '/[a-m].*$')"), any_=(lambda: patterns.matches_any_glob(_U(), ["*#top", "*/"]), "url LIKE '%#top' OR url LIKE '%/'"))
shown("path_component", "pages", "page_id", en=(lambda: patterns.has_component(_U(), "en"), "list_contains(string_split(url, '/'), 'en')"), sub=(lambda: patterns.contains_subpath(_U(), "en/25"), "contains('/' || url || '/', '/en/25/')"), base=(lambda: patterns.basename(_U()), "list_last(string_split(url, '/'))"), dir=(lambda: patterns.dirname(_U()), "regexp_replace(url, '/[^/]*$', '')"))
shown("gitignore", "pages", "page_id", ignored=(lambda: patterns.ignored(_U(), ["# rules", "en/", "de", "*.html"]), "contains('/' || url, '/en/') OR contains('/' || url || '/', '/de/') OR url LIKE '%.html'"))
shown("include_exclude", "pages", "page_id", taken=(lambda: patterns.included(_U(), ["https://m*"], ["*/de/*"]), "url LIKE 'https://m%' AND NOT url LIKE '%/de/%'"))
shown("ext_language", "pages", "page_id", language=(lambda: patterns.language(F.concat(F.lit("a/b"), F.element_at(F.array(*map(F.lit, (".ts", ".zig", ".json", ".txt"))), (F.col("page_id") % 4 + 1).cast("int")))), "CASE page_id % 4 WHEN 0 THEN 'typescript' WHEN 1 THEN 'zig' WHEN 2 THEN 'json' ELSE 'unknown' END"))
_V = lambda: F.concat(F.lit("v"), (F.col("event_id") % 3).cast("string"), F.lit("."), (F.col("event_id") % 11).cast("string"), F.lit("."), (F.col("event_id") % 5).cast("string"), F.when(F.col("event_id") % 2 == 0, F.lit("-rc.1+b7")).otherwise(""))
on_table("semver_order", "events", lambda e: e.select("event_id", patterns.semver_key(_V()).alias("k")).orderBy("k", "event_id").limit(200).select("event_id", "k.major", "k.minor", "k.patch", "k.prerelease"), "SELECT event_id, event_id % 3 AS major, event_id % 11 AS minor, event_id % 5 AS patch, CASE WHEN event_id % 2 = 0 THEN 'rc.1' ELSE '' END AS prerelease FROM events ORDER BY major, minor, patch, prerelease = '', prerelease, event_id LIMIT 200")
shown("dependency_status", "events", "event_id", status=(lambda: patterns.dependency_status(F.lit("v1.2.0"), F.when(F.col("event_id") % 3 == 1, "1.2.0").when(F.col("event_id") % 3 == 2, "1.1.0")), "CASE event_id % 3 WHEN 1 THEN 'up_to_date' WHEN 2 THEN 'needs_update' ELSE 'missing' END"))
shown("control_chars", "documents", "doc_id", valid=(lambda: unicode.is_valid(_T()), r"NOT regexp_matches(text, '[\x00-\x08\x0B-\x1F\x7F-\x{9F}\x{FDD0}-\x{FDEF}\x{FFFE}\x{FFFF}]') AND NOT starts_with(text, chr(65279))"), n=(lambda: unicode.count_rejected(F.concat("text", F.lit("\r\x00\x07")), "sanitize"), "CAST(len(regexp_extract_all(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}\\x{FDD0}-\\x{FDEF}\\x{FFFE}\\x{FFFF}]')) + 2 AS BIGINT)"))
shown("sanitize", "documents", "doc_id", clean=(lambda: unicode.sanitize(F.concat(F.lit("a\rb"), "text")), "'a' || chr(65533) || 'b' || regexp_replace(text, '[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x{9F}]', chr(65533), 'g')"))
_CHARS = lambda: F.transform(F.split("text", ""), lambda c: F.ascii(c))
shown("code_points", "documents", "doc_id", n_bytes=(lambda: F.aggregate(_CHARS(), F.lit(0).cast("bigint"), lambda a, c: a + unicode.utf8_length(c)), "CAST(strlen(text) AS BIGINT)"), n_ascii=(lambda: F.size(F.filter(_CHARS(), lambda c: unicode.classify(c) == "ascii")).cast("bigint"), r"CAST(len(regexp_extract_all(text, '[\x20-\x7E]')) AS BIGINT)"))
shown("durations", "events", "event_id", ns=(lambda: patterns.parse_duration_ns(F.concat(F.col("event_id").cast("string"), F.lit("ms"))), "event_id * 1000000"), shown_=(lambda: text.format_time(F.col("event_id") % 1000 * 1000000), "CASE WHEN event_id % 1000 = 0 THEN '0ns' ELSE printf('%.2fms', (event_id % 1000)::DOUBLE) END"))
_ERRORS = lambda: F.when(_K() % 5 == 0, "File not found").when(_K() % 5 == 1, "access denied").when(_K() % 5 == 2, "connection timeout").when(_K() % 5 == 3, "unexpected token").otherwise(F.col("event_type"))
shown("error_classes", "events", "event_id", class_=(lambda: patterns.error_class(_ERRORS()), f"CASE {_K_SQL} % 5 WHEN 0 THEN 'not_found' WHEN 1 THEN 'permission' WHEN 2 THEN 'network' WHEN 3 THEN 'syntax' ELSE 'other' END"), retry=(lambda: patterns.retryable(_ERRORS()), f"{_K_SQL} % 5 = 2"))

# Atoms

on_table("atom_intern", "documents", lambda d: index.intern(d, "source", "doc_id"), "SELECT row_number() OVER (ORDER BY f, text) AS atom_id, text, n FROM (SELECT source AS text, min(doc_id) AS f, count(*) AS n FROM documents GROUP BY source)")
on_table("atom_lookup", "documents", lambda d: index.lookup(d, index.intern(d.where("lang = 'en'"), "source", "doc_id"), "source").select("doc_id", "atom_id"), "WITH a AS (SELECT row_number() OVER (ORDER BY f, text) AS atom_id, text FROM (SELECT source AS text, min(doc_id) AS f FROM documents WHERE lang = 'en' GROUP BY source)) SELECT doc_id, coalesce(atom_id, 0) AS atom_id FROM documents LEFT JOIN a ON source = a.text")
on_table("atom_efficiency", "documents", lambda d: index.interning_efficiency(d, "source"), "SELECT 1 - count(DISTINCT source)::DOUBLE / count(source) AS efficiency FROM documents")

# JSON

_J = lambda: F.col("props")
_NESTED = lambda: F.concat(F.lit('{"a": [1, {"b": '), "props", F.lit('}], "c": "x", "c": 2}'))
shown("json_kind", "events", "event_id", kind=(lambda: jsonx.kind(_J()), "lower(json_type(props))"))
shown("json_keys", "events", "event_id", keys=(lambda: F.array_join(F.json_object_keys("props"), ","), "array_to_string(json_keys(props), ',')"), repeated=(lambda: jsonx.top_level_duplicates(_J()), "false"))
shown("json_number", "events", "event_id", k=(lambda: F.get_json_object("props", "$.k").cast("bigint"), "CAST(json_extract_string(props, '$.k') AS BIGINT)"))
_VARIED = lambda: F.concat(F.lit('{"k": '), _K().cast("string"), F.lit(', "a": ['), F.repeat(F.lit("1, "), (_K() % 5).cast("int")), F.lit('0], "d": '), F.repeat(F.lit("["), (_K() % 5).cast("int")), F.lit("true"), F.repeat(F.lit("]"), (_K() % 5).cast("int")), F.when(_K() % 3 == 0, F.lit(', "k": null')).otherwise(""), F.lit("}"))
_M, _DUP = f"({_K_SQL} % 5)", f"(CASE WHEN {_K_SQL} % 3 = 0 THEN 1 ELSE 0 END)"
_VARIED_SQL = f"""('{{"k": ' || {_K_SQL} || ', "a": [' || repeat('1, ', CAST({_M} AS INTEGER)) || '0], "d": ' || repeat('[', CAST({_M} AS INTEGER)) || 'true' || repeat(']', CAST({_M} AS INTEGER)) || CASE WHEN {_K_SQL} % 3 = 0 THEN ', "k": null' ELSE '' END || '}}')"""
_varied = lambda e: e.select("event_id", _VARIED().alias("doc"))
on_table("json_stats", "events", lambda e: jsonx.statistics_table(_varied(e), "doc").select("event_id", "max_depth", "total_keys", "objects", "arrays", "strings", "numbers", "booleans", "nulls"), f"SELECT event_id, CAST(greatest(2, 1 + {_M}) AS INTEGER) AS max_depth, 3 + {_DUP} AS total_keys, 1 AS objects, CAST(1 + {_M} AS INTEGER) AS arrays, 0 AS strings, CAST(2 + {_M} AS INTEGER) AS numbers, 1 AS booleans, {_DUP} AS nulls FROM events")
on_table("json_complexity", "events", lambda e: jsonx.statistics_table(e.select("event_id", _NESTED().alias("doc")), "doc").select("event_id", "max_depth", "total_keys", F.round("complexity", 6).alias("complexity")), "SELECT event_id, 4 AS max_depth, 5 AS total_keys, 14.85::DOUBLE AS complexity FROM events")
shown("json_schema", "events", "event_id", schema=(lambda: jsonx.schema_column(_NESTED()), "'{a: [any], c: number}'"))
on_table("json_lint", "events", lambda e: jsonx.lint_table(_varied(e), "doc").select("event_id", "rule", "severity", "span_start"), f"SELECT event_id, 'no_duplicate_keys' AS rule, 'err' AS severity, CAST(length({_VARIED_SQL}) - 10 AS BIGINT) AS span_start FROM events WHERE {_K_SQL} % 3 = 0")
_BROKEN = lambda: F.when(_K() % 4 == 0, F.expr("substring(props, 1, length(props) - 1)")).when(_K() % 4 == 1, F.concat(F.lit('{"a": 1, "a": '), "props", F.lit("}"))).otherwise(F.col("props"))
on_table("json_diagnostics", "events", lambda e: jsonx.diagnostics_table(e.select("event_id", _BROKEN().alias("doc")), "doc").select("event_id", "rule").distinct(), f"SELECT event_id, CASE {_K_SQL} % 4 WHEN 0 THEN 'syntax_error' ELSE 'no_duplicate_keys' END AS rule FROM events WHERE {_K_SQL} % 4 < 2")
on_table("json_merged_schema", "events", lambda e: e.sparkSession.createDataFrame([(jsonx.schema_text(jsonx.merged_schema(e.select("props"), "props")),)], "schema string"), "SELECT '{k: number}' AS schema")
shown("json_minified", "events", "event_id", small=(lambda: F.pandas_udf(lambda v: v.map(jsonx.minify), "string")(_VARIED()), f"replace({_VARIED_SQL}, ' ', '')"))
on_table("json_elements", "events", lambda e: jsonx.nodes_table(_varied(e), "doc").where("kind = 'number' and depth = 2").groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("raw").cast("bigint")).alias("total")), f"SELECT event_id, 1 + {_M} AS n, {_M} AS total FROM events")
on_table("json_symbols", "events", lambda e: jsonx.symbols_table(e.select("event_id", "props"), "props").select("event_id", "name", "kind", "span_start"), "SELECT event_id, 'root' AS name, 'object' AS kind, 0::BIGINT AS span_start FROM events UNION ALL SELECT event_id, 'k', 'property', 1 FROM events UNION ALL SELECT event_id, 'k', 'number', 6 FROM events")
on_table("json_facts", "events", lambda e: jsonx.facts_table(_varied(e), "doc").where("predicate = 'starts_block'").groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.max("span_end").alias("end_")), f"SELECT event_id, 2 + {_M} AS n, CAST(length({_VARIED_SQL}) AS BIGINT) AS end_ FROM events")
on_table("json_tokens", "events", lambda e: jsonx.tokens_table(_varied(e), "doc").groupBy("event_id", "kind").agg(F.count(F.lit(1)).alias("n")).where("kind in ('number_value', 'colon', 'array_start', 'null_value')"), f"SELECT event_id, kind, n FROM (SELECT event_id, unnest(['number_value', 'colon', 'array_start', 'null_value']) AS kind, unnest([2 + {_M}, 3 + {_DUP}, 1 + {_M}, {_DUP}]) AS n FROM events) WHERE n > 0")
shown("json_format", "events", "event_id", laid_out=(lambda: jsonx.format_column(_J()), "'{' || chr(10) || '  \"k\": ' || json_extract_string(props, '$.k') || chr(10) || '}'"))

on_table("json_token_facts", "events", lambda e: jsonx.token_facts_table(_varied(e), "doc").where("predicate in ('is_number', 'json_is_key')").groupBy("event_id", "predicate").agg(F.count(F.lit(1)).alias("n")), f"SELECT event_id, 'is_number' AS predicate, 2 + {_M} AS n FROM events UNION ALL SELECT event_id, 'json_is_key', 3 + {_DUP} FROM events")

# Joins and references

on_facts("fact_self_join", lambda f: index.references(f.withColumn("value_ref", F.when(F.col("id") > 10, F.col("id") - F.col("value_number") % 10))).select("id", "value_ref", "ref_predicate"), "SELECT a.id, b.id AS value_ref, b.predicate AS ref_predicate FROM facts a JOIN facts b ON a.id > 10 AND b.id = a.id - a.value_number % 10")


def _tables(name: str, run: Callable[..., DataFrame], names: str, sql: str) -> None:
    register(name, lambda spark, d: run(*[table(spark, d, n) for n in names.split()]), sql)


_tables("join_inner", lambda o, c: o.join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")), "orders customer", "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
_tables("join_left", lambda c, o: c.join(o, o.o_custkey == c.c_custkey, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n")), "customer orders", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
_tables("join_semi", lambda p, li: p.join(li.where("l_quantity >= 49"), p.p_partkey == li.l_partkey, "left_semi").select("p_partkey"), "part lineitem", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
_tables("join_anti", lambda c, o: c.join(o.where("o_orderpriority = '1-URGENT'"), o.o_custkey == c.c_custkey, "left_anti").select("c_custkey"), "customer orders", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
_tables("join_asof", lambda e: index.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("value").alias("value")), ["user_id"], "ts", ["value"]).select("event_id", F.col("value").alias("click_value")), "events", "WITH c AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY ALL) SELECT event_id, c.value AS click_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.ts")
_tables("set_operations", lambda e: e.where("value > 30").select("user_id").intersect(e.where("value < 30").select("user_id")).exceptAll(e.where("event_type = 'signup' and value > 60").select("user_id").distinct()), "events", "(SELECT user_id FROM events WHERE value > 30 INTERSECT SELECT user_id FROM events WHERE value < 30) EXCEPT SELECT user_id FROM events WHERE event_type = 'signup' AND value > 60")
_tables("cube", lambda e: e.cube("event_type", (F.col("user_id") % 3).alias("g")).agg(F.count(F.lit(1)).alias("n")), "events", "SELECT event_type, g, count(*) AS n FROM (SELECT event_type, user_id % 3 AS g FROM events) GROUP BY CUBE (event_type, g)")

# Dates, paths, delimiters, indents

_SECONDS = lambda: F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
shown("dates", "events", "event_id", day=(lambda: dates.format_date(_SECONDS()), "strftime(ts, '%Y-%m-%d')"), at_=(lambda: dates.format_date_time(_SECONDS()), "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"), month_=(lambda: dates.simple_date(_SECONDS())["month"], "CAST(month(ts) AS INTEGER)"))
_PATH = lambda: F.concat(F.when(F.col("page_id") % 2 == 0, "/").otherwise(""), F.lit("a//./"), F.regexp_replace("url", "^https://", ""), F.lit("/"))
_PATH_SQL = "(CASE WHEN page_id % 2 = 0 THEN '/' ELSE '' END || 'a/' || array_to_string(list_filter(string_split(regexp_replace(url, '^https://', ''), '/'), lambda x: x <> ''), '/'))"
shown("path_normalize", "pages", "page_id", path=(lambda: patterns.normalize(_PATH()), _PATH_SQL), prefixed=(lambda: patterns.add_relative_prefix(patterns.normalize(_PATH())), f"CASE WHEN page_id % 2 = 0 THEN '' ELSE './' END || {_PATH_SQL}"))
_FILE = lambda: F.concat(F.element_at(F.array(*map(F.lit, ("src", "build", "x/node_modules", ".git"))), (F.col("page_id") % 4 + 1).cast("int")), F.lit("/p"), F.col("page_id").cast("string"))
shown("should_ignore", "pages", "page_id", ignored=(lambda: patterns.should_ignore(_FILE()), "page_id % 4 <> 0"), hidden=(lambda: patterns.should_hide(F.when(F.col("page_id") % 3 == 0, "Thumbs.db").otherwise("x")), "page_id % 3 = 0"))
shown("brace_globs", "pages", "page_id", taken=(lambda: patterns.matches_any_glob(_U(), patterns.expand_braces("https://[a-m]*/{en,d{e,k}}/*")), "regexp_matches(url, '^https://[a-m].*/(en|de|dk)/')"))
_CALL = lambda: F.concat("event_type", F.lit("("), "props", F.lit(', ["a, b)", 2], {x})'), F.when(_K() % 2 == 1, ")").otherwise(""))
_CALLED = "props || ', [\"a, b)\", 2], {x}'"
shown("delimiters", "events", "event_id", balanced=(lambda: text.is_balanced(_CALL()), f"{_K_SQL} % 2 = 0"), inside=(lambda: text.between_delimiters(_CALL()), _CALLED), n=(lambda: F.size(text.split_respecting_nesting(F.concat("props", F.lit(', ["a, b)", 2], {x}'))))
 .cast("bigint"), "3::BIGINT"), before=(lambda: text.before_brace(_CALL()), "event_type || '('"), end_=(lambda: text.find_matching_delimiter(F.concat(F.lit("("), "props", F.lit(")x)"))), "CAST(length(props) + 1 AS INTEGER)"))
_BLOCK = lambda: F.concat(F.repeat(F.lit("  "), (_K() % 4).cast("int")), "event_type", F.lit("\n"), F.repeat(F.lit("  "), (_K() % 4 + 2).cast("int")), F.lit("x"))
shown("indents", "events", "event_id", dedented=(lambda: text.dedent(_BLOCK()), "event_type || chr(10) || '    x'"), nested=(lambda: text.format_indented(F.col("event_type"), 2), "repeat(' ', 8) || event_type"))
shown("echo_escapes", "events", "event_id", plain=(lambda: text.echo_unescape(F.concat("event_type", F.lit(r"\t\x41\102\q"))), r"event_type || chr(9) || 'AB\q'"), json=(lambda: text.echo_json(_J()), r"""'"' || replace(props, '"', '\"') || '"'"""))

# ZON: a document for each event; a third of them name a field twice

_ZON = lambda: F.concat(F.lit('.{ .name = "'), "event_type", F.lit('", .k = '), _K().cast("string"), F.when(_K() % 2 == 1, ".5").otherwise(""), F.when(_K() % 3 == 0, ", .k = 1").otherwise(""), F.lit(" }"))
_zon = lambda e: e.select("event_id", _ZON().alias("doc"))
_Z = f"(SELECT event_id, event_type, {_K_SQL} AS k, {_K_SQL} || CASE WHEN {_K_SQL} % 2 = 1 THEN '.5' ELSE '' END AS n FROM events)"
on_table("zon_json", "events", lambda e: _zon(e).select("event_id", zon.to_json(F.col("doc")).alias("json")), f"""SELECT event_id, '{{"name": "' || event_type || '", "k": ' || CASE WHEN k % 3 = 0 THEN '1' ELSE n END || '}}' AS json FROM {_Z}""")
on_table("zon_lint", "events", lambda e: zon.lint_table(_zon(e), "doc").select("event_id", "rule", "severity", "span_start"), f"SELECT event_id, 'no_duplicate_keys' AS rule, 'err' AS severity, CAST(22 + length(event_type) + length(n) AS BIGINT) AS span_start FROM {_Z} WHERE k % 3 = 0")
on_table("zon_known_schema", "events", lambda e: zon.lint_table(_zon(e), "doc", {"unknown_field", "missing_required_field"}).select("event_id", "rule"), f"SELECT event_id, unnest(CASE WHEN k % 3 = 0 THEN ['missing_required_field', 'unknown_field', 'unknown_field'] ELSE ['missing_required_field', 'unknown_field'] END) AS rule FROM {_Z}")
on_table("zon_types", "events", lambda e: _zon(e).select("event_id", zon.type_column(F.col("doc")).alias("type"), zon.kind_column(F.col("doc")).alias("kind")), f"SELECT event_id, 'struct {{ name: []const u8, k: ' || CASE WHEN k % 2 = 1 THEN 'f64' ELSE 'i64' END || CASE WHEN k % 3 = 0 THEN ', k: i64' ELSE '' END || ' }}' AS type, 'build' AS kind FROM {_Z}")
on_table("zon_format", "events", lambda e: _zon(e).select("event_id", zon.format_column(F.col("doc")).alias("laid_out")), f"""SELECT event_id, '.{{' || chr(10) || '    .name = "' || event_type || '",' || chr(10) || '    .k = ' || n || ',' || CASE WHEN k % 3 = 0 THEN chr(10) || '    .k = 1,' ELSE '' END || chr(10) || '}}' AS laid_out FROM {_Z}""")
on_table("zon_facts", "events", lambda e: zon.facts_table(_zon(e), "doc").where("predicate = 'is_number'").select("event_id", "id", (F.col("span_end") - F.col("span_start")).alias("width")), f"SELECT event_id, 4::BIGINT AS id, CAST(length(n) AS BIGINT) AS width FROM {_Z} UNION ALL SELECT event_id, 6, 1 FROM {_Z} WHERE k % 3 = 0")

# Files, bundles, trees and the index, through the shared folder


def _files(spark: SparkSession, d: str) -> DataFrame:
    path = streaming.shared_path(spark, "files")
    table(spark, d, "documents").select("lang", F.col("text").alias("value")).write.partitionBy("lang").text(path)
    found = files.read_files(spark, path, "*.txt")
    lang = F.regexp_extract("path", "/lang=([a-z]+)/", 1)
    return found.groupBy(lang.alias("lang")).agg(F.sum("size").alias("size"), F.sum(F.octet_length("content")).alias("n_read"), F.bool_and(files.content_hash(F.col("content")).isNotNull()).alias("hashed"))


register("files_read", _files, "SELECT lang, CAST(sum(strlen(text) + 1) AS BIGINT) AS size, CAST(sum(strlen(text) + 1) AS BIGINT) AS n_read, true AS hashed FROM documents GROUP BY lang")
on_table("bundle", "documents", lambda d: files.bundle(d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".json")).alias("path"), "text")), """SELECT 'd' || doc_id || '.json' AS path, '<File path="./d' || doc_id || '.json">' || chr(10) || chr(10) || f || 'json' || chr(10) || text || CASE WHEN ends_with(text, chr(10)) THEN '' ELSE chr(10) END || f || chr(10) || chr(10) || '</File>' || chr(10) AS block
FROM (SELECT doc_id, text, repeat('`', CAST(greatest(3, coalesce(list_max(list_transform(regexp_extract_all(text, '(`+)', 1), lambda x: length(x))), 0) + 1) AS INTEGER)) AS f FROM documents)""")
_tables("tree", lambda n, r: files.tree(n.join(r, n.n_regionkey == r.r_regionkey).select(F.concat("r_name", F.lit("/"), "n_name").alias("path"))).select("path", "line"), "nation region", """WITH e AS (SELECT r_name AS parent, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey),
d AS (SELECT DISTINCT parent FROM e)
SELECT parent AS path, CASE WHEN parent = (SELECT max(parent) FROM d) THEN '└── ' ELSE '├── ' END || parent AS line FROM d
UNION ALL SELECT parent || '/' || name, CASE WHEN parent = (SELECT max(parent) FROM d) THEN '    ' ELSE '│   ' END || CASE WHEN name = max(name) OVER (PARTITION BY parent) THEN '└── ' ELSE '├── ' END || name FROM e""")


def _indexed(f: DataFrame) -> DataFrame:
    path = streaming.shared_path(f.sparkSession, "index")
    index.write_index(f, path)
    return index.read_index(f.sparkSession, path, "click").select("id", "span_start")


on_facts("index_layout", _indexed, "SELECT id, span_start FROM facts WHERE predicate = 'click'")
on_facts("store_clear", lambda f: index.append(index.clear(f), f.where("predicate = 'error'"), "id", 3).select("id", "generation"), "SELECT row_number() OVER (ORDER BY id) AS id, 3 AS generation FROM facts WHERE predicate = 'error'")
on_facts("store_update", lambda f: index.update(f, f.where("predicate = 'error'").withColumn("confidence", F.lit(0.25)), 2).groupBy("generation").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 6).alias("total")), "SELECT CASE WHEN predicate = 'error' THEN 2 ELSE 1 END AS generation, count(*) AS n, round(sum(CASE WHEN predicate = 'error' THEN 0.25 ELSE confidence END), 6) AS total FROM facts GROUP BY 1")
_LATELY = "SELECT user_id, max(event_id) AS last FROM events GROUP BY 1 ORDER BY last DESC, user_id LIMIT 100"
on_table("cache_hits", "events", lambda e: index.hit_rate(e, index.recent(e, "user_id", "event_id", 100), "user_id"), f"SELECT count(r.user_id) AS hits, count(*) - count(r.user_id) AS misses, count(r.user_id) / count(*) AS rate FROM events e LEFT JOIN ({_LATELY}) r ON e.user_id = r.user_id")
on_table("cache_recent", "events", lambda e: index.recent(e, "user_id", "event_id", 100), _LATELY)
_tables("grouping_sets", lambda e: e.select("event_type", (F.col("user_id") % 3).alias("g")).groupingSets([["event_type"], ["g"], []], "event_type", "g").agg(F.count(F.lit(1)).alias("n")), "events", "SELECT event_type, g, count(*) AS n FROM (SELECT event_type, user_id % 3 AS g FROM events) GROUP BY GROUPING SETS ((event_type), (g), ())")
_RESULTS = lambda e: e.select(F.col("event_type").alias("name"), F.lit(10).alias("operations"), (F.col("value") * 1000).alias("total_ns"))
on_table("benchmark_statistics", "events", lambda e: index.benchmark_statistics(_RESULTS(e), e.where("event_id % 2 = 0").groupBy(F.col("event_type").alias("name")).agg(F.avg(F.col("value") * 80).alias("mean_ns"))).select("name", "operations", F.round("mean_ns", 6).alias("mean_ns"), F.round("percent_change", 6).alias("percent_change"), "verdict", "confidence"), """WITH b AS (SELECT event_type AS name, avg(value * 80) AS base FROM events WHERE event_id % 2 = 0 GROUP BY 1), r AS (SELECT event_type AS name, count(*) * 10 AS operations, sum(value * 1000) / (count(*) * 10) AS mean_ns FROM events GROUP BY 1)
SELECT name, operations, round(mean_ns, 6) AS mean_ns, round(100 * (mean_ns - base) / base, 6) AS percent_change, CASE WHEN 100 * (mean_ns - base) / base > 20 THEN 'regression' WHEN 100 * (mean_ns - base) / base < -1 THEN 'improvement' ELSE 'stable' END AS verdict,
  CASE WHEN operations >= 1000 THEN 'high' WHEN operations >= 100 THEN 'medium' WHEN operations >= 10 THEN 'low' ELSE 'insufficient' END AS confidence FROM r JOIN b USING (name)""")

# Structured Streaming, over the files that are there


def _streamed(name: str, run: Callable[[DataFrame], DataFrame], mode: str, sql: str) -> None:
    register(name, lambda spark, d: streaming.run_now(run(streaming.read_events(spark, d)), name, mode), sql)


def _plain(df: DataFrame) -> DataFrame:
    """Times as seconds, so that no zone matters."""
    return df.withColumn("start", F.unix_seconds("start"))


_streamed("stream_filter_append", lambda s: streaming.filtered(s, 95.0), "append", "SELECT event_id, user_id, event_type, value FROM events WHERE value >= 95.0")
# append mode: a window comes once the watermark, an hour behind the newest event, has passed its end
_PASSED = "(SELECT epoch(max(ts)) - 3600 FROM events)"
_DAYS = "SELECT CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"
_streamed("stream_tumbling", lambda s: _plain(streaming.tumbling(s)).withColumn("total", F.round("total", 4)), "append", f"SELECT * FROM ({_DAYS}) WHERE start + 86400 <= {_PASSED}")
register("stream_updates", lambda spark, d: streaming.update_now(_plain(streaming.tumbling(streaming.read_events(spark, d))), ["start", "event_type"], "updates").withColumn("total", F.round("total", 4)), _DAYS)
register("stream_totals", lambda spark, d: streaming.update_now(streaming.running_totals(streaming.read_events(spark, d)), ["user_id"], "totals").withColumn("total", F.round("total", 4)), "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
_streamed("stream_sliding", lambda s: _plain(streaming.sliding(s)), "append", f"SELECT * FROM (SELECT start, count(*) AS n FROM (SELECT unnest([CAST(floor(epoch(ts) / 43200) * 43200 AS BIGINT), CAST(floor(epoch(ts) / 43200) * 43200 AS BIGINT) - 43200]) AS start FROM events) GROUP BY 1) WHERE start + 86400 <= {_PASSED}")
_streamed("stream_sessions", lambda s: _plain(streaming.sessions(s)), "append", "WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM i GROUP BY user_id, k HAVING epoch(max(ts)) + 21600 <= (SELECT epoch(max(ts)) - 3600 FROM events)")
_streamed("stream_dedupe_watermark", streaming.deduplicated, "append", "SELECT DISTINCT user_id, event_type FROM events")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
