import pytest

from spanforge.operators import jsonx, zon

DOC = '{"user": {"name": "A", "age": 3, "active": true, "hobbies": ["x", "y"]}, "timestamp": null, "count": 1e2}'


def test_statistics():
    s = jsonx.statistics(DOC)
    assert (s["max_depth"], s["total_keys"], s["total_values"]) == (3, 7, 9)
    assert (s["objects"], s["arrays"], s["strings"], s["numbers"], s["booleans"], s["nulls"]) == (2, 1, 3, 2, 1, 1)
    assert s["complexity"] == pytest.approx(1.5 * 3 + 0.1 * 7 + 0.05 * 9 + 2 * 6)
    assert jsonx.statistics("{") is None


def test_schema():
    s = jsonx.infer_schema(DOC)
    assert sorted(s["properties"]) == ["count", "timestamp", "user"]
    assert jsonx.schema_text(jsonx.infer_schema('[1, "a"]')) == "[any]" and jsonx.schema_text(jsonx.infer_schema("[1, 2]")) == "[number]"
    a, b = jsonx.infer_schema('{"a": 1}'), jsonx.infer_schema('{"a": 2, "b": "x"}')
    assert jsonx.compatible(a, b) and not jsonx.compatible(b, a)
    assert jsonx.schema_text(jsonx.merge_schemas(a, jsonx.infer_schema('{"a": "x"}'))) == "{a: any}"
    assert jsonx.suggestions(jsonx.infer_schema('{"item1": 1, "x_0": 2}')) != [] and "URL" in jsonx.suggestions(jsonx.infer_schema('"http://x"'))[0]


@pytest.mark.parametrize("text", ["01", "-01", "[01]", '{"a": 01}', "1.", "1e", "{", "[1 2]", '{"a" 1}', '{"a":}', "tru", '"a', '"\\x"', "", "1 2", "]", "{a: 1}", '"\x01"'])
def test_rejected(text):
    assert jsonx.parse(text)[1]


@pytest.mark.parametrize("text", ["0", "-0.5e+3", "[1, 2,]", '{"a": 1,}', "// c\n1", "/* c */ [ ]", '"\\u00e9\\n"', '{"a": {"a": []}}', " null ", '"/* no */"'])
def test_accepted(text):
    root, errors = jsonx.parse(text)
    assert root is not None and not errors


def test_lint():
    assert [x[0] for x in jsonx.lint('{"key": 1, "key": 2}')] == ["no_duplicate_keys"]
    assert [x[0] for x in jsonx.lint('[{"a": {"k": 1, "k": 2}}]')] == ["no_duplicate_keys"]
    assert [x[0] for x in jsonx.lint("01")] == ["no_leading_zeros"]
    assert "deep_nesting" in [x[0] for x in jsonx.lint("[" * 30 + "]" * 30)]
    assert [x[0] for x in jsonx.lint("12345678901234567890", {"large_number_precision"})] == ["large_number_precision"]


def test_symbols_and_facts():
    assert [(s[0], s[1]) for s in jsonx.symbols('{"a": {"b": [1]}}')] == [("root", "object"), ("a", "property"), ("a", "object"), ("b", "property"), ("a.b", "array"), ("a.b[0]", "array_element"), ("a.b[0]", "number")]
    assert [f[3] for f in jsonx.facts('{"key": "value", "number": 42}')] == ["starts_block", "is_string", "is_number"]
    assert [t.kind for t in jsonx.tokenize('{"key": "value", "number": 42}')] == ["object_start", "property_name", "colon", "string_value", "comma", "property_name", "colon", "number_value", "object_end"]


def test_format():
    assert jsonx.format_json('{"b":1e2,"a":[1,{}]}') == '{\n  "b": 1e2,\n  "a": [\n    1,\n    {}\n  ]\n}'
    assert jsonx.format_json('{"b":1,"a":2}', indent=4, sort_keys=True) == '{\n    "a": 2,\n    "b": 1\n}'
    assert jsonx.format_json('{"b":1,"a":[1,2]}', compact=3) == '{\n  "b": 1,\n  "a": [1, 2]\n}'
    once = jsonx.format_json(DOC)
    assert jsonx.format_json(once) == once and jsonx.format_json("{") is None


def test_tables(spark):
    df = spark.createDataFrame([(1, DOC), (2, None), (3, "{"), (4, "")], "id long, doc string")
    assert {r.id for r in jsonx.statistics_table(df, "doc").collect()} == {1}
    assert jsonx.lint_table(df, "doc").where("id = 3").count() == 1
    assert jsonx.nodes_table(df, "doc").where("id = 1 and kind = 'property'").count() == 7
    assert jsonx.tokens_table(df.limit(0), "doc").count() == 0
    got = {r.id: r.k for r in df.select("id", jsonx.kind(df.doc).alias("k")).collect()}
    assert got == {1: "object", 2: None, 3: None, 4: None}


def test_merged_schema_and_minify(spark):
    df = spark.createDataFrame([(1, '{"a": 1}'), (2, '{"a": 2, "b": [1]}'), (3, "{"), (4, None)], "id long, doc string")
    assert jsonx.schema_text(jsonx.merged_schema(df, "doc")) == "{a: number, b: [number]}"
    assert jsonx.merged_schema(df.limit(0), "doc") == {"kind": "any"}
    assert jsonx.minify('{ "b": 1e2, "a": [1, {}] }') == '{"b":1e2,"a":[1,{}]}' and jsonx.minify("[") is None


ZON = '.{\n    .name = .app, // c\n    .version = "1.0.0",\n    .n = .{ 0x1F, 1_000, 2.5, \'a\', true, null },\n    .@"odd name" = .{},\n    .text =\n    \\\\line one\n    \\\\line two\n    ,\n}'


def test_zon_values():
    got = zon.loads(ZON)
    assert got == {"name": "app", "version": "1.0.0", "n": [31, 1000, 2.5, "a", True, None], "odd name": {}, "text": "line one\nline two"}
    assert zon.loads(zon.dumps(got)) == got and zon.loads(zon.dumps(got, None)) == got
    assert zon.loads('.{ .name = "test", 1, 2, .flag = true }') == {"name": "test", "1": 1, "2": 2, "flag": True}


@pytest.mark.parametrize("text", [".{}", '.{ .field = "value" }', ".{ .a = 1, .b = 2 }", '.{ .nested = .{ .inner = "v" } }', ".{ 1, 2, 3 }", '.{ .f = .{ "a", "b" } }', "42", ".{ .a = 1, }", '@import("x")'])
def test_zon_accepted(text):
    assert not zon.parse(text)[1]


@pytest.mark.parametrize("text", ["", ".{", ".{ .a = }", ".{ .a 1 }", ".{ 1 2 }", ".{} .{}", ".{ .a = 01 }", '.{ .a = "x }', "}", ".{ .a = foo }", ".{ .fn = 1 }", ".{ , }"])
def test_zon_rejected(text):
    assert zon.parse(text)[1]


def test_zon_lint_types_and_format():
    assert [x[0] for x in zon.lint(".{ .a = 1, .a = 2 }")] == ["no_duplicate_keys"]
    schema = {"missing_required_field", "invalid_field_type", "unknown_field"}
    assert [x[0] for x in zon.lint('.{ .name = 1, .odd = 2 }', schema)] == ["missing_required_field", "invalid_field_type", "unknown_field"]
    assert zon.type_text(zon.parse('.{ .a = 1, .b = .{ "x" }, .c = 1.5 }')[0]) == "struct { a: i64, b: []const []const u8, c: f64 }"
    assert zon.format_zon(".{.a=0x1,.b=.{1,2}}", compact=2) == ".{\n    .a = 0x1,\n    .b = .{ 1, 2 },\n}"
    assert [f[3] for f in zon.facts(".{ .a = 1 }")] == ["starts_block", "is_identifier", "is_number"]
    assert [zon.number_format(x) for x in ("1", "0x1", "0b1", "0o7", "1.5", "1e3")] == ["decimal", "hex", "binary", "octal", "float", "float"]


def test_zon_tables(spark):
    df = spark.createDataFrame([(1, ".{ .a = 1, .a = 2 }"), (2, None), (3, ".{")], "id long, doc string")
    assert {r.id for r in zon.lint_table(df, "doc").collect()} == {1, 3}
    assert [r.j for r in df.select(zon.to_json(df.doc).alias("j")).collect()] == ['{"a": 2}', None, None]


def test_halves_of_pairs_and_many_rows(spark, monkeypatch):
    monkeypatch.setattr(jsonx, "EXPLODED_ROWS", 3)
    df = spark.createDataFrame([(1, r'{"a\ud83d": 1, "😀": 2}'), (2, "[1, 2, 3, 4, 5]"), (3, None), (4, "[6]")], "id long, doc string")
    got = jsonx.nodes_table(df, "doc").collect()
    assert [r.key for r in got if r.id == 1 and r.kind == "property"] == ["a�", "😀"]
    assert [r.raw for r in got if r.id in (2, 4) and r.kind == "number"] == list("123456")
    assert {(r.id, r.rule) for r in jsonx.diagnostics_table(df.union(spark.createDataFrame([(5, "[1,"), (6, '{"a":1,"a":2}')], df.schema)), "doc").collect()} == {(5, "syntax_error"), (6, "no_duplicate_keys")}
