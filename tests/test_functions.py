import pytest
from pyspark.sql import functions as F

from spanforge.functions import chars, dates, patterns, text, unicode


def ask(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_globs(spark):
    cases = [("test.zig", "*.zig", True), ("src/main.zig", "src/*.zig", True), ("test", "t??t", True), ("file.cpp", "file.?", False), ("a]b", "a[]]b", True), ("x.c", "[!y].c", True), ("a", "a*a", False), ("a*b", r"a\*b", True)]
    assert ask(spark, *[patterns.matches_glob(F.lit(t), g) for t, g, _ in cases]) == [x for *_, x in cases]
    assert patterns.expand_braces("a{b,c{d,e}}f{") == ["abf{", "acdf{", "acef{"]


def test_paths(spark):
    p = F.lit("src/lib/.hidden.tar.gz")
    assert ask(spark, patterns.basename(p), patterns.dirname(p), patterns.extension(p), patterns.is_hidden(p), patterns.dirname(F.lit("x")), patterns.dirname(F.lit("/x")), patterns.extension(F.lit(".rc")), patterns.join_path(F.lit("a/"), F.lit("/b"))) == [".hidden.tar.gz", "src/lib", ".gz", True, ".", "/", "", "a/b"]
    assert ask(spark, patterns.matches_path(p, "lib"), patterns.matches_path(p, "src/lib"), patterns.matches_path(p, "li"), patterns.matches_path(p, "*.gz")) == [True, True, False, True]


def test_include_exclude(spark):
    inc, exc = ["src/", "*.zig"], ["*.test.zig", "test/"]
    got = ask(spark, *[patterns.included(F.lit(p), inc, exc) for p in ("src/a.c", "main.zig", "main.test.zig", "test/x.zig", "README.md", ".git/config")])
    assert got == [True, True, False, False, False, False]


def test_ignore_rules(spark):
    rules = ["# c", "", "build/", "/root.txt", "*.log", "node_modules"]
    got = ask(spark, *[patterns.ignored(F.lit(p), rules) for p in ("a/build/x", "root.txt", "b/x.log", "node_modules/x", "src/rooted", "xbuild/y")])
    assert got == [True, True, True, True, False, False]


def test_versions(spark):
    df = spark.createDataFrame([(v,) for v in ("v1.2.3", "1.2.3-rc.1", "1.10.0", "1.2.4+b", "bad")], "v string")
    assert [r.v for r in df.where(patterns.semver(F.col("v")).isNotNull()).orderBy(patterns.semver_key(F.col("v"))).collect()] == ["1.2.3-rc.1", "v1.2.3", "1.2.4+b", "1.10.0"]
    assert ask(spark, patterns.is_major_change(F.lit("1.0.0"), F.lit("v2.0.0")), patterns.parse_duration_ns(F.lit("2s")), patterns.parse_duration_ns(F.lit("x"))) == [True, 2 * 10**9, None]


def test_fence_and_layout(spark):
    assert ask(spark, text.fence_length(F.lit("hello")), text.fence_length(F.lit("a ``` b"))) == [3, 4]
    assert ask(spark, text.pad_left(F.lit("abc"), 2), text.pad_left(F.lit("a"), 3), text.strip_ansi(F.lit("\x1b[31mx\x1b[0m")), text.format_time(F.lit(1500)), text.repeat_join(F.lit("a"), 3, ",")) == ["abc", "  a", "x", "1.50us", "a,a,a"]


def test_lines(spark):
    t = F.lit("a\n\n  // b\nfn c() {\n}\n")
    assert ask(spark, text.count_lines(t), text.count_lines(F.lit("")), text.count_non_empty_lines(t), text.extract_lines(t, ["//"]), text.extract_lines(t, ["//"], False), text.extract_block(t), text.before_brace(F.lit(" x { y")), text.before_brace(F.lit("x"))) == [6, 1, 4, "  // b\n", "// b\n", "fn c() {\n}", "x", None]
    assert ask(spark, text.split_and_trim(F.lit(" a, ,b "), ","), text.is_comment(F.lit(" -- x"), "sql"), text.extract_between(F.lit("a[b]c"), "[", "]"), text.extract_between(F.lit("ab"), "[", "]"), text.extract_all_between(F.lit("<1><2>"), "<", ">")) == [["a", "b"], True, "b", None, ["1", "2"]]


def test_delimiters(spark):
    assert ask(spark, text.is_balanced(F.lit('f("(") [x]')), text.is_balanced(F.lit("(]")), text.split_respecting_nesting(F.lit("a,(b,c),'d,e'")), text.find_matching_delimiter(F.lit("f(a(b))"), 1), text.count_balance(F.lit("(()"), "(", ")")) == [True, False, ["a", "(b,c)", "'d,e'"], 6, 1]


def test_between_delimiters(spark):
    assert ask(spark, text.between_delimiters(F.lit("f(a(b)c) d")), text.between_delimiters(F.lit("f(")), text.between_delimiters(F.lit("x")), text.command_line(F.lit("ls")), text.progress_bar(F.lit(0), F.lit(0), 2)) == ["a(b)c", None, None, "```bash\n$ ls\n```\n", "[##] 100%"]


def test_indents(spark):
    assert ask(spark, text.indent_style(F.lit("a\n  b\n    c")), text.indent_style(F.lit("a\n\tb")), text.indent_style(F.lit("\ta\n  b")), text.dedent(F.lit("    a\n      b\n")), text.convert_indent(F.lit("a\n  b\n    c")), text.indent_level(F.lit("\t    x"))) == ["spaces:2", "tabs", "mixed", "a\n  b\n", "a\n\tb\n\t\tc", 2]
    assert ask(spark, text.wrap_text(F.lit("aa bb cc"), 5), text.format_indented(F.lit("a\n\nb"), 1, 2)) == ["aa bb\ncc", "  a\n\n  b"]


@pytest.mark.parametrize("language", ["json", "zon", "javascript", "html", "xml", "csv", "regex", "shell"])
def test_escapes_round_trip(spark, language):
    t = "a\"b\\c'd<e>&f\n\tg$ [x]*"
    assert ask(spark, text.unescape(text.escape(F.lit(t), language), language)) == [t]


def test_echo_json(spark):
    assert ask(spark, text.echo_json(F.lit('a/b"\n\x01'))) == ['"a\\/b\\"\\n\\u0001"']


def test_quotes(spark):
    assert ask(spark, text.quote_style(F.lit('"""x"""')), text.strip_quotes(F.lit('"""x"""')), text.convert_quotes(F.lit("'x'"), "backtick"), text.quote_style(F.lit("x")), text.strip_quotes(F.lit("x"))) == ["triple_double", "x", "`x`", None, "x"]


def test_chars(spark):
    assert ask(spark, chars.is_class(F.lit(" \t"), "whitespace"), chars.is_class(F.lit(" \n"), "whitespace"), chars.is_class(F.lit("a_$9"), "identifier_char"), chars.consume(F.lit("0x1Fz"), "number"), chars.consume(F.lit('"a\\"b" c'), "string"), chars.consume(F.lit("1.x"), "number"), chars.consume(F.lit("/* a\n */b"), "block_comment"), chars.block_comment_lines(F.lit("/* a\n */b"))) == [True, False, True, 4, 6, 1, 8, 1]


def test_unicode(spark):
    bad, cr = F.lit("Hello\x00World"), F.lit("Hello\rWorld")
    assert ask(spark, unicode.is_valid(bad), unicode.first_invalid_byte(bad), unicode.is_valid(cr), unicode.first_invalid_byte(cr), unicode.is_valid(cr, "sanitize"), unicode.is_valid(F.lit("﻿a")), unicode.is_valid(F.lit("﻿a"), "permissive")) == [False, 5, False, 5, True, False, True]
    clean = ask(spark, unicode.sanitize(F.lit("Hello\x00World\x08Test")))[0]
    assert clean.count("�") == 2 and len(clean.encode()) == 20
    assert ask(spark, unicode.classify(F.lit(0xD800)), unicode.classify(F.lit(0xFDD0)), unicode.classify(F.lit(65)), unicode.utf8_length(F.lit(0x20AC)), unicode.utf8_length(F.lit(0xD800))) == ["surrogate", "noncharacter", "ascii", 3, 0]
    assert ask(spark, unicode.format_escapes(F.lit("a😀")), unicode.parse_escapes(F.lit("a\\ud83d\\ude00\\u{41}\\x42")), unicode.format_escapes(F.lit("é"), "hex")) == ["a\\ud83d\\ude00", "a😀AB", "\\xC3\\xA9"]
    assert ask(spark, unicode.repair_utf8(F.lit(b"a\xff".hex()).substr(1, 2))) == ["61"]


def test_nulls(spark):
    n = F.lit(None).cast("string")
    assert ask(spark, text.count_lines(n), text.is_balanced(n), text.unescape(n), patterns.basename(n), unicode.sanitize(n), text.strip_quotes(n))[1:] == [None] * 5


def test_unescape_pairs_and_halves(spark):
    df = spark.createDataFrame([(r"😀!",), (r"a\ud83d",), (r"é\n",), (None,)], "t string")
    assert [r[0] for r in df.select(text.unescape(F.col("t"))).collect()] == ["😀!", "a�", "é\n", None]


def test_echo_unescape():
    f = text.echo_unescape.scalar
    assert f(r"a\tb\\n\q") == "a\tb\\n\\q" and f(r"\101\x41\x4") == "AA\x04" and f(r"\777") == "?7" and f(r"\xc3\xa9") == "é" and f("\\") == "\\"


def test_dates(spark):
    df = spark.createDataFrame([(0,), (951782399,), (951782400,), (-1,), (None,)], "s long")
    got = df.select(dates.format_date(F.col("s")), dates.format_date_time(F.col("s")), dates.simple_date(F.col("s")).alias("d")).collect()
    assert [r[0] for r in got] == ["1970-01-01", "2000-02-28", "2000-02-29", "1969-12-31", None]
    assert got[1][1] == "2000-02-28T23:59:59Z" and tuple(got[2].d) == (2000, 2, 29, 0, 0, 0) and got[4].d is None


def test_paths(spark):
    rows = [("", ".", "./."), ("a//b/./c/", "a/b/c", "./a/b/c"), ("/", "/", "/"), ("//x", "/x", "/x"), ("./a", "a", "./a"), ("../a", "../a", "../a"), (".", ".", ".")]
    df = spark.createDataFrame([r[:1] for r in rows], "p string")
    got = df.select(patterns.normalize(F.col("p")).alias("n")).select("n", patterns.add_relative_prefix(F.col("n")).alias("r")).collect()
    assert [r.n for r in got] == [r[1] for r in rows]
    assert [r.r for r in got][1:] == [r[2] for r in rows][1:] and got[0].r == "."
