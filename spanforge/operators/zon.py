"""ZON: reading, writing, linting and schemas, built on the tree of the JSON module."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jsonx import DEEP, MANY_KEYS, MAX_DEPTH, Node, explode_documents

# Lint rules with severity, default and description.
ZON_RULES = {
    "no_duplicate_keys": ("err", True, "Object keys must be unique"),
    "max_depth_exceeded": ("err", True, "ZON structure exceeds maximum nesting depth"),
    "large_structure": ("warning", False, "ZON structure is very large"),
    "deep_nesting": ("warning", True, "ZON has deep nesting that may be hard to read"),
    "invalid_field_type": ("err", False, "Field has invalid type for known schema"),
    "unknown_field": ("warning", False, "Field is not recognized in known schema"),
    "missing_required_field": ("err", False, "Required field is missing from object"),
    "invalid_identifier": ("err", True, "Identifier uses invalid ZON syntax"),
    "prefer_explicit_type": ("hint", False, "Prefer an explicit type"),
    "schema_validation": ("err", True, "Document doesn't match its schema"),
    "invalid_string": ("err", True, "String format is invalid"),
    "invalid_number": ("err", True, "Number format is invalid"),
}
# Fields of known documents with the kinds they may have, and those required.
KNOWN = {
    "build": {"marks": ["name", "version", "dependencies"], "required": ["name", "version"], "fields": {"name": {"string", "enum"}, "version": {"string"}, "fingerprint": {"number"}, "minimum_zig_version": {"string"}, "dependencies": {"object"}, "paths": {"array"}}},
    "config": {"marks": ["base_patterns", "ignored_patterns", "symlink_behavior"], "required": [], "fields": {"base_patterns": {"string", "array", "enum"}, "ignored_patterns": {"array"}, "hidden_files": {"array"}, "symlink_behavior": {"string", "enum"}, "respect_gitignore": {"boolean"}}},
}

_TOKEN = re.compile(
    r"(?P<space>[ \t\r\n]+)|(?P<comment>//[^\n]*)|(?P<multi>(?:\\\\[^\n]*(?:\n[ \t]*(?=\\\\))?)+)|(?P<string>\"(?:[^\"\\\n]|\\.)*+\"?)|(?P<char>'(?:[^'\\\n]|\\.[^']*)'?)"
    r"|(?P<open>\.\{)|(?P<field>\.@\"(?:[^\"\\\n]|\\.)*+\"|\.[A-Za-z_]\w*)|(?P<number>-?(?:0[xob][0-9a-fA-F_.pP+\-]+|\d[\w.]*(?:(?<=[eE])[+-]\d+)?|inf\b|nan\b))|(?P<word>@?[A-Za-z_]\w*)|(?P<mark>[{}=,()\[\]:])|(?P<other>.)",
    re.S,
)
_NUMBER = re.compile(r"-?(?:0x[0-9a-fA-F]+(?:_[0-9a-fA-F]+)*(?:\.[0-9a-fA-F]+)?(?:[pP][+-]?\d+)?|0o[0-7]+(?:_[0-7]+)*|0b[01]+(?:_[01]+)*|(?:0|[1-9]\d*(?:_\d+)*)(?:\.\d+)?(?:[eE][+-]?\d+)?|inf|nan)")
WORDS = {"true": "boolean", "false": "boolean", "null": "null", "undefined": "undefined"}
IDENTIFIER = re.compile(r"[A-Za-z_]\w*")
KEYWORDS = set("const var fn pub struct enum union error return if else while for switch break continue and or try catch test comptime inline defer null true false undefined".split())


def number_format(raw: str) -> str:
    """decimal, hex, binary, octal or float."""
    raw = raw.lstrip("-").lower()
    if raw.startswith("0x"):
        return "float" if "p" in raw or "." in raw else "hex"
    if raw[:2] in ("0b", "0o"):
        return {"0b": "binary", "0o": "octal"}[raw[:2]]
    return "float" if any(c in raw for c in ".e") or raw in ("inf", "nan") else "decimal"


def number_value(raw: str) -> int | float:
    plain = raw.replace("_", "")
    if number_format(raw) == "float":
        return float.fromhex(plain) if "0x" in plain.lower() else float(plain)
    return int(plain, 0) if re.match(r"-?0[xob]", plain) else int(plain)


_SIMPLE = {"n": "\n", "r": "\r", "t": "\t", "\\": "\\", '"': '"', "'": "'"}


def unquote(raw: str) -> str:
    """The value of a string, a character or a multi-line string."""
    if raw.startswith("\\\\"):
        return "\n".join(x.strip()[2:] for x in raw.split("\n") if x.strip())
    one = lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _SIMPLE[m[3]]
    return re.sub(r"\\(?:x([0-9a-fA-F]{2})|u\{([0-9a-fA-F]+)\}|([nrt\\\"']))", one, raw[1:-1])


def field_name(raw: str) -> str:
    return unquote(raw[2:]) if raw.startswith('.@"') else raw[1:]


def parse(text: str) -> tuple[Node | None, list[tuple[int, int, str, str]]]:
    """The tree and the errors (start, end, rule, message).

    A struct is an object if it has a named field, else an array; a mixed one is an object whose positional
    values are named by their place. An empty one is an object.
    """
    tokens = [m for m in _TOKEN.finditer(text) if m.lastgroup not in ("space", "comment")]
    errors: list[tuple[int, int, str, str]] = []
    root: Node | None = None
    stack: list[Node] = []
    i = 0

    def bad(m: re.Match, rule: str, message: str) -> None:
        errors.append((m.start(), m.end(), rule, message))

    def place(node: Node) -> None:
        nonlocal root
        if not stack:
            root = node
        elif stack[-1].kind == "property":
            stack[-1].children.append(node)
            if node.kind != "struct":
                stack.pop().end = node.end
        else:
            stack[-1].children.append(node)

    expect = True  # a value or a field may begin
    while i < len(tokens):
        m, kind = tokens[i], tokens[i].lastgroup
        i += 1
        if kind == "mark" and m[0] == "," and stack and not expect:
            expect = True
        elif kind == "mark" and m[0] == "}" and stack and stack[-1].kind == "struct":
            node = stack.pop()
            node.end = m.end()
            named = [c for c in node.children if c.kind == "property"]
            node.kind = "object" if named or not node.children else "array"
            if node.kind == "object":
                node.children = [c if c.kind == "property" else Node("property", c.start, c.end, "", str(k), [c]) for k, c in enumerate(node.children)]
            if stack and stack[-1].kind == "property":
                stack.pop().end = m.end()
            expect = False
        elif not expect:
            bad(m, "schema_validation", "Expected a comma")
        elif kind == "open":
            node = Node("struct", m.start(), m.end())
            place(node)
            stack.append(node)
        elif kind == "field" and i < len(tokens) and tokens[i][0] == "=" and stack and stack[-1].kind == "struct":
            name = field_name(m[0])
            if not m[0].startswith('.@"') and name in KEYWORDS:
                bad(m, "invalid_identifier", f"'{name}' is a keyword and has to be quoted")
            node = Node("property", m.start(), m.end(), m[0], name)
            place(node)
            stack.append(node)
            i += 1
        else:
            if kind == "field":
                node = Node("enum", m.start(), m.end(), m[0])
            elif kind in ("string", "multi"):
                node = Node("string", m.start(), m.end(), m[0])
                if kind == "string" and (len(m[0]) < 2 or not m[0].endswith('"') or re.search(r"\\(?!x[0-9a-fA-F]{2}|u\{[0-9a-fA-F]+\}|[nrt\\\"'])", m[0][1:-1].replace("\\\\", ""))):
                    bad(m, "invalid_string", "String format is invalid")
            elif kind == "char":
                node = Node("character", m.start(), m.end(), m[0])
            elif kind == "number":
                node = Node("number", m.start(), m.end(), m[0])
                if not _NUMBER.fullmatch(m[0]):
                    bad(m, "invalid_number", "Number format is invalid")
            elif kind == "word" and m[0] in WORDS:
                node = Node(WORDS[m[0]], m.start(), m.end(), m[0])
            elif kind == "word" and m[0] == "@import" and i + 2 < len(tokens) and tokens[i][0] == "(" and tokens[i + 2][0] == ")":
                node = Node("import", m.start(), tokens[i + 2].end(), tokens[i + 1][0])
                i += 3
            else:
                bad(m, "invalid_identifier" if kind == "word" else "schema_validation", "Expected a value")
                node = Node("null", m.start(), m.end(), "null")
            if not stack and root is not None:
                bad(m, "schema_validation", "Unexpected content after the value")
                continue
            place(node)
            expect = False
    if stack or root is None:
        errors.append((len(text), len(text), "schema_validation", "Unexpected end of input"))
    return root, errors


class EnumLiteral(str):
    """The name of an enum literal."""


def to_value(node: Node) -> Any:
    if node.kind == "object":
        return {p.key: to_value(p.children[0]) for p in node.children if p.children}
    if node.kind == "array":
        return [to_value(c) for c in node.children]
    if node.kind == "number":
        return number_value(node.raw)
    if node.kind == "boolean":
        return node.raw == "true"
    if node.kind == "enum":
        return EnumLiteral(field_name(node.raw))
    return None if node.kind in ("null", "undefined") else unquote(node.raw)


def loads(text: str) -> Any:
    """A document as Python values; ValueError with the first error if it has one."""
    root, errors = parse(text)
    if errors or root is None:
        raise ValueError(f"at {errors[0][0]}: {errors[0][3]}")
    return to_value(root)


def quote(text: str) -> str:
    back = {v: "\\" + k for k, v in _SIMPLE.items() if v != "'"}
    return '"' + "".join(back.get(c) or (f"\\x{ord(c):02x}" if ord(c) < 32 else c) for c in text) + '"'


def quote_name(name: str) -> str:
    """A field name, quoted where it has to be."""
    return f".{name}" if IDENTIFIER.fullmatch(name) and name not in KEYWORDS else f".@{quote(name)}"


def dumps(value: Any, indent: int | None = 4, level: int = 0) -> str:
    """Python values as ZON; indent None gives one line."""
    if isinstance(value, EnumLiteral):
        return quote_name(value)
    if isinstance(value, bool) or value is None:
        return {True: "true", False: "false", None: "null"}[value]
    if isinstance(value, str):
        return quote(value)
    if isinstance(value, (int, float)):
        return repr(value)
    rows = [f"{quote_name(str(k))} = {dumps(v, indent, level + 1)}" for k, v in value.items()] if isinstance(value, dict) else [dumps(v, indent, level + 1) for v in value]
    if not rows:
        return ".{}"
    if indent is None:
        return ".{ " + ", ".join(rows) + " }"
    pad = "\n" + " " * indent * (level + 1)
    return ".{" + "".join(pad + r + "," for r in rows) + "\n" + " " * indent * level + "}"


def format_zon(text: str, indent: int = 4, compact: int = 0) -> str | None:
    """The text laid out again with raw scalars kept; null if it has errors. compact: scalars that share a line."""
    root, errors = parse(text)
    if errors or root is None:
        return None

    def show(n: Node, level: int) -> str:
        if n.kind == "import":
            return f"@import({n.raw})"
        if n.kind not in ("object", "array"):
            return n.raw
        rows = [(f"{p.raw} = " if p.raw else "") + show(p.children[0], level + 1) if n.kind == "object" else show(p, level + 1) for p in n.children]
        values = [p.children[0] if n.kind == "object" else p for p in n.children]
        if not rows:
            return ".{}"
        if len(rows) <= compact and all(v.kind not in ("object", "array") for v in values):
            return ".{ " + ", ".join(rows) + " }"
        pad = "\n" + " " * indent * (level + 1)
        return ".{" + "".join(pad + r + "," for r in rows) + "\n" + " " * indent * level + "}"

    return show(root, 0)


def lint(text: str, rules: set[str] | None = None) -> list[tuple[str, str, str, int, int]]:
    """rule, severity, message, start, end for every node; null rules take the defaults."""
    on = {r for r, (_, default, _) in ZON_RULES.items() if default} if rules is None else rules
    root, errors = parse(text)
    out = [(rule, ZON_RULES[rule][0], message, start, end) for start, end, rule, message in errors if rule in on]

    def report(rule: str, message: str, n: Node) -> None:
        if rule in on:
            out.append((rule, ZON_RULES[rule][0], message, n.start, n.end))

    for node, depth in root.walk() if root else ():
        if node.kind == "object":
            seen: dict[str, int] = {}
            for p in node.children:
                if p.key in seen:
                    report("no_duplicate_keys", f"Duplicate field '{p.key}', first at {seen[p.key]}", p)
                seen.setdefault(p.key, p.start)
        if node.kind in ("object", "array"):
            if len(node.children) > MANY_KEYS:
                report("large_structure", f"{len(node.children)} entries", node)
            if depth > MAX_DEPTH:
                report("max_depth_exceeded", f"Nesting depth {depth} exceeds {MAX_DEPTH}", node)
            elif depth == DEEP + 1:
                report("deep_nesting", f"Nesting is deeper than {DEEP}", node)
    if root is not None and root.kind == "object" and (known := document_kind(root)):
        rule, names = KNOWN[known], {p.key for p in root.children}
        for name in rule["required"]:
            if name not in names:
                report("missing_required_field", f"Required field '{name}' is missing", root)
        for p in root.children:
            if p.key not in rule["fields"]:
                report("unknown_field", f"Field '{p.key}' is not known", p)
            elif p.children and p.children[0].kind not in rule["fields"][p.key]:
                report("invalid_field_type", f"'{p.key}' must be {' or '.join(sorted(rule['fields'][p.key]))}", p)
    return sorted(out, key=lambda x: (x[3], x[4], x[0]))


def document_kind(root: Node) -> str:
    """The known kind of a document, by the first of its fields that marks one; empty if none does."""
    for p in root.children:
        for name, rule in KNOWN.items():
            if p.key in rule["marks"]:
                return name
    return ""


def type_text(node: Node) -> str:
    """The struct type of a value."""
    if node.kind == "object":
        return "struct { " + ", ".join(f"{p.key}: {type_text(p.children[0])}" for p in node.children if p.children) + " }" if node.children else "struct {}"
    if node.kind == "array":
        return f"[]const {type_text(node.children[0])}"
    names = {"string": "[]const u8", "boolean": "bool", "character": "u8", "enum": "enum", "null": "?void", "undefined": "void", "import": "type"}
    return names.get(node.kind) or ("f64" if number_format(node.raw) == "float" else "i64")


def facts(text: str) -> list[tuple[int, int, int, str]]:
    """id (from 0), start, end, predicate in pre-order; field names are identifiers."""
    root, errors = parse(text)
    names = {"object": "starts_block", "array": "starts_block", "string": "is_string", "character": "is_string", "number": "is_number", "enum": "is_identifier", "property": "is_identifier"}
    return [] if errors or root is None else [(i, n.start, n.end, names.get(n.kind, "is_keyword")) for i, (n, _) in enumerate(root.walk())]


def lint_table(df: DataFrame, text: str, rules: set[str] | None = None) -> DataFrame:
    return explode_documents(df, text, lambda t: lint(t, rules), "rule string, severity string, message string, span_start long, span_end long", ["rule", "severity", "message", "span_start", "span_end"])


def facts_table(df: DataFrame, text: str) -> DataFrame:
    return explode_documents(df, text, facts, "id long, span_start long, span_end long, predicate string", ["id", "span_start", "span_end", "predicate"])


def zon_column(text: Column, function, returns: str = "string") -> Column:
    """What a function gives for each document; null for null."""

    @F.pandas_udf(returns)
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else function(v) for v in values], dtype=object)

    return run(text)


def format_column(text: Column, **options) -> Column:
    return zon_column(text, lambda v: format_zon(v, **options))


def type_column(text: Column) -> Column:
    """The struct type of a document; null if it has errors."""

    def one(v: str) -> str | None:
        root, errors = parse(v)
        return None if errors or root is None else type_text(root)

    return zon_column(text, one)


def kind_column(text: Column) -> Column:
    """The known kind of a document, empty if none; null if it has errors."""

    def one(v: str) -> str | None:
        root, errors = parse(v)
        return None if errors or root is None else document_kind(root)

    return zon_column(text, one)


def to_json(text: Column) -> Column:
    """A ZON document as JSON text; null for null or a document with errors."""
    import json

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        def one(v):
            try:
                return None if v is None else json.dumps(loads(v), ensure_ascii=False)
            except ValueError:
                return None

        return pd.Series([one(v) for v in values], dtype=object)

    return run(text)


def from_rows(rows: Iterator[dict]) -> str:
    """Rows as one ZON document, for a sink of bounded size."""
    return dumps(list(rows))
