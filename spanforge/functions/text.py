"""Functions on lines, delimiters, quotes, indents and layout. Native where expressions can say it."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS, ALL_BLANKS = " \t", " \t\r\n"


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def split(text: Column, separator: str) -> Column:
    return F.split(text, _quoted(separator), -1)


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def trim_blanks(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def trim_all(text: Column) -> Column:
    return F.btrim(text, F.lit(ALL_BLANKS))


def is_blank(text: Column) -> Column:
    return trim_all(text) == ""


def trimmed_not_empty(text: Column) -> Column:
    """The trimmed text; null if nothing is left."""
    return F.nullif(trim_all(text), F.lit(""))


def split_and_trim(text: Column, separator: str) -> Column:
    """Parts without the blanks around them; empty ones go."""
    return F.filter(F.transform(split(text, separator), trim_all), lambda x: x != "")


def parse_comma_separated(text: Column) -> Column:
    return split_and_trim(text, ",")


def parse_space_separated(text: Column) -> Column:
    return split_and_trim(text, " ")


def starts_with_any(text: Column, prefixes: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, prefixes)), lambda p: text.startswith(p)) if prefixes else F.lit(False)


def contains_any(text: Column, parts: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, parts)), lambda p: text.contains(p)) if parts else F.lit(False)


# What a comment begins with in a style.
COMMENTS = {"c": ["//", "/*", "*"], "hash": ["#"], "html": ["<!--"], "sql": ["--"]}


def is_comment(line: Column, style: str) -> Column:
    return starts_with_any(trim_all(line), COMMENTS[style])


def count_lines(text: Column) -> Column:
    """Line ends plus one; an empty text has one line."""
    return F.size(lines(text)).cast("bigint")


def count_non_empty_lines(text: Column) -> Column:
    return F.size(F.filter(lines(text), lambda x: F.btrim(x, F.lit(" \t\r")) != "")).cast("bigint")


def lines_containing(text: Column, part: str) -> Column:
    return F.filter(lines(text), lambda x: x.contains(part))


def lines_with_prefix(text: Column, prefix: str) -> Column:
    return F.filter(lines(text), lambda x: x.startswith(prefix))


def extract_lines(text: Column, prefixes: list[str], keep_indent: bool = True) -> Column:
    """Lines that begin, after blanks, with one of the prefixes; each ends with a line end."""
    kept = F.filter(lines(text), lambda x: starts_with_any(F.ltrim(x, F.lit(BLANKS)), prefixes))
    return F.array_join(F.transform(kept, lambda x: F.concat(x if keep_indent else F.ltrim(x, F.lit(BLANKS)), F.lit("\n"))), "")


def filter_non_empty_lines(text: Column) -> Column:
    return F.array_join(F.filter(lines(text), lambda x: trim_all(x) != ""), "\n")


def before_brace(text: Column) -> Column:
    """The trimmed text before the first brace; null without one or without text."""
    return F.when(text.contains("{"), trimmed_not_empty(F.substring_index(text, "{", 1)))


def count_char(text: Column, char: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))).cast("bigint")


def count_balance(text: Column, opening: str, closing: str) -> Column:
    return count_char(text, opening) - count_char(text, closing)


def extract_between(text: Column, opening: str, closing: str) -> Column:
    """The text between the first opening and the next closing delimiter; null if there is none."""
    pattern = f"(?s){_quoted(opening)}(.*?){_quoted(closing)}"
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def extract_all_between(text: Column, opening: str, closing: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s){_quoted(opening)}(.*?){_quoted(closing)}"), 1)


def indent_level(line: Column, size: int = 4) -> Column:
    """Indents at the start of a line; a tab counts as one indent."""
    lead = F.regexp_extract(line, r"^[ \t]*", 0)
    return F.floor((F.length(lead) + count_char(lead, "\t") * (size - 1)) / size).cast("bigint")


def format_indented(text: Column, level: int, size: int = 4) -> Column:
    pad = " " * (level * size)
    return F.array_join(F.transform(lines(text), lambda x: F.when(trim_all(x) == "", F.lit("")).otherwise(F.concat(F.lit(pad), x))), "\n")


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, r"\x1B\[[^A-Za-z]*[A-Za-z]", "")


def pad_right(text: Column, width: int, char: str = " ") -> Column:
    """Never cut."""
    return F.when(F.length(text) >= width, text).otherwise(F.rpad(text, width, char))


def pad_left(text: Column, width: int, char: str = " ") -> Column:
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, char))


def format_time(ns: Column) -> Column:
    """Nanoseconds with the unit that fits."""
    return (
        F.when(ns < 1000, F.format_string("%dns", ns))
        .when(ns < 1_000_000, F.format_string("%.2fus", ns / 1000))
        .when(ns < 1_000_000_000, F.format_string("%.2fms", ns / 1_000_000))
        .otherwise(F.format_string("%.2fs", ns / 1_000_000_000))
    )


def fence_length(text: Column) -> Column:
    """Backticks of a fence that the text doesn't hold: 3 to 32."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("(`+)"), 1), F.length)
    lengths = F.sequence(F.lit(3), F.lit(32))
    free = F.filter(lengths, lambda n: n > F.coalesce(F.array_max(runs), F.lit(0)))
    return F.coalesce(F.array_min(free), F.lit(32)).cast("bigint")


def markdown_section(title: Column, body: Column, level: int = 2) -> Column:
    """A heading, an empty line and the body."""
    return F.concat(F.lit("#" * level + " "), title, F.lit("\n\n"), body, F.lit("\n"))


def command_line(command: Column) -> Column:
    """A command as a fenced shell block."""
    return F.concat(F.lit("```bash\n$ "), command, F.lit("\n```\n"))


def clean_terminal_output(text: Column) -> Column:
    """Without escape sequences, carriage returns, blanks at line ends and empty lines."""
    kept = F.filter(F.transform(lines(F.replace(strip_ansi(text), F.lit("\r"), F.lit(""))), lambda x: F.rtrim(x, F.lit(BLANKS))), lambda x: x != "")
    return F.array_join(kept, "\n")


def progress_bar(done: Column, total: Column, width: int = 20) -> Column:
    """[####----] and the percentage; full for a total of 0."""
    share = F.when(total > 0, F.least(done / total, F.lit(1.0))).otherwise(F.lit(1.0))
    full = F.floor(share * width).cast("int")
    return F.concat(F.lit("["), F.repeat(F.lit("#"), full), F.repeat(F.lit("-"), width - full), F.lit("] "), F.round(share * 100).cast("int").cast("string"), F.lit("%"))


def repeat_join(text: Column, times: int, separator: str = " ") -> Column:
    """A text `times` times (10,000 at most) with a separator between."""
    return F.array_join(F.array_repeat(text, min(times, 10_000)), separator)


def echo_json(text: Column) -> Column:
    """A JSON string that escapes the slash too."""
    out = text
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("/", "\\/"), ("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    for i in range(32):
        if chr(i) not in "\b\f\n\r\t":
            out = F.replace(out, F.lit(chr(i)), F.lit(f"\\u{i:04x}"))
    return F.concat(F.lit('"'), out, F.lit('"'))


def python_function(returns: str) -> Callable:
    """A scalar Python function as a function of columns, in Arrow batches; null in, null out."""

    def wrap(f: Callable) -> Callable:
        def on_columns(text: Column, *args) -> Column:
            @F.pandas_udf(returns)
            def run(values: pd.Series) -> pd.Series:
                return pd.Series([None if v is None else f(v, *args) for v in values], dtype=object)

            return run(text)

        on_columns.scalar, on_columns.__doc__, on_columns.__name__ = f, f.__doc__, f.__name__
        return on_columns

    return wrap


# Escapes of one letter that echo knows.
ECHO = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v", "\\": "\\", '"': '"', "'": "'"}
_ECHO = re.compile(r"""\\(?:([ntrabfv\\"'])|([0-3][0-7]{0,2}|[4-7][0-7]?)|x([0-9a-fA-F]{1,2}))""")


@python_function("string")
def echo_unescape(text: str) -> str:
    r"""Escapes as echo -e reads them: letters, \NNN octal, \xHH; what it doesn't know stays. Bytes that aren't UTF-8 become U+FFFD."""
    at, out = 0, bytearray()
    for m in _ECHO.finditer(text):
        out += text[at : m.start()].encode("utf-8", "surrogatepass")
        out += ECHO[m[1]].encode() if m[1] else bytes([int(m[2], 8) if m[2] else int(m[3], 16)])
        at = m.end()
    return (bytes(out) + text[at:].encode("utf-8", "surrogatepass")).decode("utf-8", "replace")


PAIRS = {"(": ")", "[": "]", "{": "}"}


def _scan(text: str):
    """Characters with the depth before them; text in quotes has depth None."""
    depth, quote = 0, ""
    for i, c in enumerate(text):
        if quote:
            yield i, c, None
            quote = "" if c == quote else quote
        elif c in "\"'`":
            quote = c
            yield i, c, None
        else:
            yield i, c, depth
            depth += (c in PAIRS) - (c in PAIRS.values())


@python_function("boolean")
def is_balanced(text: str) -> bool:
    """Whether brackets close in order, leaving out quoted text; quotes have no escapes."""
    stack = []
    for _, c, depth in _scan(text):
        if depth is not None and c in PAIRS:
            stack.append(PAIRS[c])
        elif depth is not None and c in PAIRS.values() and (not stack or stack.pop() != c):
            return False
    return not stack


@python_function("array<string>")
def split_respecting_nesting(text: str, separator: str = ",") -> list[str]:
    """Parts at separators outside brackets and quotes."""
    cuts = [i for i, c, depth in _scan(text) if c == separator and depth == 0]
    return [text[a + 1 : b] for a, b in zip([-1, *cuts], [*cuts, len(text)])]


@python_function("int")
def find_matching_delimiter(text: str, at: int = 0) -> int | None:
    """Where the bracket at a position is closed; null if it isn't."""
    opening = text[at : at + 1]
    level = 0
    for i, c, depth in _scan(text[at:]):
        if depth is not None:
            level += (c == opening) - (c == PAIRS.get(opening))
            if level == 0:
                return at + i
    return None


@python_function("string")
def between_delimiters(text: str, opening: str = "(") -> str | None:
    """What the first bracket of a kind holds, nested ones included; null if it isn't closed."""
    for i, c, depth in _scan(text):
        if depth is not None and c == opening:
            end = find_matching_delimiter.scalar(text, i)
            return None if end is None else text[i + 1 : end]
    return None


@python_function("string")
def extract_block(text: str) -> str:
    """The lines from the first brace to the line where it closes."""
    out, level, seen = [], 0, False
    for line in text.split("\n"):
        level += line.count("{") - line.count("}")
        seen = seen or "{" in line
        if seen:
            out.append(line)
            if level <= 0:
                break
    return "\n".join(out)


@python_function("string")
def wrap_text(text: str, width: int = 80) -> str:
    """Words in lines of at most `width` characters; a longer word has its own line."""
    out, line = [], ""
    for w in text.split():
        if line and len(line) + 1 + len(w) > width:
            out.append(line)
            line = w
        else:
            line = f"{line} {w}" if line else w
    return "\n".join([*out, line] if line else out)


def _indents(text: str) -> tuple[list[str], str, int]:
    found = [m[0] for m in (re.match(r"[ \t]+", x) for x in text.split("\n") if x.strip()) if m]
    tabs, spaces = sum("\t" in x for x in found), sum(" " in x for x in found)
    style = "mixed" if tabs and spaces else "tabs" if tabs else "spaces"
    size = math.gcd(*[len(x) for x in found if "\t" not in x]) if any("\t" not in x for x in found) else 0
    return found, style, size if 0 < size <= 8 else 4


@python_function("string")
def indent_style(text: str) -> str:
    """spaces:n, tabs or mixed; n is the greatest common divisor of the indents, 4 if that is 0 or over 8."""
    _, style, size = _indents(text)
    return f"spaces:{size}" if style == "spaces" else style


@python_function("string")
def dedent(text: str) -> str:
    """Without the indent that all lines with text share."""
    leads = [re.match(r"[ \t]*", x)[0] for x in text.split("\n") if x.strip()]
    common = leads[0] if leads else ""
    for lead in leads:
        while not lead.startswith(common):
            common = common[:-1]
    return "\n".join(x.removeprefix(common) if x.strip() else x for x in text.split("\n"))


@python_function("string")
def convert_indent(text: str, to: str = "tabs", size: int = 4) -> str:
    """Indents in tabs, or in spaces of a size."""
    _, _, old = _indents(text)
    out = []
    for line in text.split("\n"):
        lead = re.match(r"[ \t]*", line)[0]
        level = lead.count("\t") + lead.count(" ") // old
        out.append(("\t" if to == "tabs" else " " * size) * level + line[len(lead) :] if line.strip() else line)
    return "\n".join(out)


# Quote styles and their marks.
QUOTES = {"double": ('"', '"'), "single": ("'", "'"), "backtick": ("`", "`"), "triple_double": ('"""', '"""'), "triple_single": ("'''", "'''"), "angle": ("<", ">"), "smart_double": ("“", "”"), "smart_single": ("‘", "’")}


def quote_style(text: Column) -> Column:
    """The style of the quotes around a text; null without."""
    out = F
    for name in ("triple_double", "triple_single", "double", "single", "backtick", "angle", "smart_double", "smart_single"):
        a, b = QUOTES[name]
        out = out.when(text.startswith(a) & text.endswith(b) & (F.length(text) >= len(a) + len(b)), F.lit(name))
    return out


def strip_quotes(text: Column) -> Column:
    style = quote_style(text)
    n = F.when(style.startswith("triple"), 3).otherwise(1)
    return F.when(style.isNull(), text).otherwise(F.substring(text, n + 1, F.length(text) - 2 * n))


def ensure_quoted(text: Column, style: str = "double") -> Column:
    """The text in quotes of any style; those of `style` are added where there are none."""
    return F.when(quote_style(text).isNull(), add_quotes(text, style)).otherwise(text)


def has_quote_conflicts(text: Column, style: str) -> Column:
    """Whether a text holds the marks that a style would put around it."""
    return contains_any(text, list(dict.fromkeys(QUOTES[style])))


def add_quotes(text: Column, style: str) -> Column:
    return F.concat(F.lit(QUOTES[style][0]), text, F.lit(QUOTES[style][1]))


def convert_quotes(text: Column, style: str) -> Column:
    return add_quotes(strip_quotes(text), style)


# What a language escapes, and how.
ESCAPES = {
    "json": {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"},
    "zon": {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"},
    "javascript": {"\\": "\\\\", '"': '\\"', "'": "\\'", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f", "\v": "\\v"},
    "html": {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#39;"},
    "xml": {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&apos;"},
    "regex": {c: "\\" + c for c in "\\.^$*+?()[]{}|"},
    "csv": {'"': '""'},
    "shell": {c: "\\" + c for c in "\\\"'$` "},
}
ESCAPES["typescript"] = ESCAPES["javascript"]


def escape(text: Column, language: str) -> Column:
    """A text for use in a string of a language. The escape character itself comes first."""
    out = text
    for a, b in ESCAPES[language].items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


@python_function("string")
def unescape(text: str, language: str = "json") -> str:
    """The inverse of escape, in one pass."""
    back = {b: a for a, b in ESCAPES[language].items()}
    found = re.compile("|".join(map(re.escape, sorted(back, key=len, reverse=True))) + (r"|\\u[0-9a-fA-F]{4}" if language in ("json", "javascript", "typescript") else ""))
    out = found.sub(lambda m: back[m[0]] if m[0] in back else chr(int(m[0][2:], 16)), text)
    return whole_pairs(out)


def whole_pairs(text: str) -> str:
    """Halves of surrogate pairs joined; one that stands alone becomes U+FFFD."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def needs_escape(text: Column, language: str) -> Column:
    return contains_any(text, list(ESCAPES[language]))
