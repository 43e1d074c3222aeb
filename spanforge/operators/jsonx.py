"""JSON analysis: tokens, tree, diagnostics, statistics, schema, symbols, facts and layout of whole documents.

Clean flat documents need none of this: get_json_object, json_object_keys and variants stay in the JVM (see the
native functions at the end). What they can't say (positions, duplicate keys, comments, raw numbers) is done
here in Arrow batches, one document at a time. Offsets are in characters.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import whole_pairs

MAX_SCHEMA_DEPTH, MAX_DEPTH, DEEP, MANY_KEYS, MANY_ELEMENTS = 20, 100, 20, 50, 100

# Lint rules with severity, default and description.
JSON_RULES = {
    "no_duplicate_keys": ("err", True, "Object keys must be unique"),
    "no_leading_zeros": ("warning", True, "Numbers should not have leading zeros"),
    "valid_string_encoding": ("err", True, "Strings must be valid UTF-8"),
    "max_depth_exceeded": ("err", True, "JSON structure exceeds maximum nesting depth"),
    "large_number_precision": ("warning", False, "Number has high precision that may cause issues"),
    "large_structure": ("warning", False, "JSON structure is very large"),
    "deep_nesting": ("warning", True, "JSON has deep nesting that may be hard to read"),
    "invalid_number": ("err", True, "Number format is invalid"),
    "invalid_escape_sequence": ("err", True, "String contains invalid escape sequence"),
    "syntax_error": ("err", True, "Invalid JSON syntax"),
}
# Messages of error tokens.
ERRORS = {
    "unterminated_string": "Unterminated string",
    "invalid_escape_sequence": "Invalid escape sequence",
    "invalid_unicode_escape": "Invalid Unicode escape sequence",
    "control_character_in_string": "Unescaped control character in string",
    "decimal_no_digits": "Invalid number: decimal point must be followed by digits",
    "exponent_no_digits": "Invalid number: exponent must contain digits",
    "leading_zero": "Invalid number: leading zeros not allowed",
    "invalid_character": "Invalid character",
    "unexpected_eof": "Unexpected end of input",
}

_TOKEN = re.compile(
    r"(?P<space>[ \t\r\n]+)|(?P<comment>//[^\n]*|/\*(?:[^*]|\*(?!/))*+(?:\*/|\Z))|(?P<string>\"(?:[^\"\\\n]|\\.)*+(?P<closed>\")?)"
    r"|(?P<number>-?\d[\w.+\-]*|-(?=\D|\Z))|(?P<word>[A-Za-z_$][\w$]*)|(?P<mark>[{}\[\],:])|(?P<other>.)",
    re.S,
)
MARKS = {"{": "object_start", "}": "object_end", "[": "array_start", "]": "array_end", ",": "comma", ":": "colon"}
WORDS = {"true": "boolean_true", "false": "boolean_false", "null": "null_value"}


@dataclass
class Token:
    kind: str
    start: int
    end: int
    depth: int
    error: str = ""


def number_error(raw: str) -> str:
    """What is wrong with a number; empty if nothing is."""
    if re.fullmatch(r"-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?", raw):
        return ""
    if re.match(r"-?0\d", raw):
        return "leading_zero"
    if re.match(r"-?\d+\.(?!\d)", raw):
        return "decimal_no_digits"
    if re.match(r"-?\d+(\.\d+)?[eE][+-]?(?!\d)", raw):
        return "exponent_no_digits"
    return "invalid_character"


def string_error(raw: str, closed: bool) -> str:
    if not closed:
        return "unterminated_string"
    if re.search(r"\\u(?![0-9a-fA-F]{4})", raw.replace("\\\\", "")):
        return "invalid_unicode_escape"
    if re.search(r"\\[^\"\\/bfnrtu]", raw.replace("\\\\", "")):
        return "invalid_escape_sequence"
    return "control_character_in_string" if re.search(r"[\x00-\x1f]", raw) else ""


def tokenize(text: str) -> list[Token]:
    """Tokens without white space; a string before a colon is a property name, and what is wrong is `err`."""
    out, depth = [], 0
    for m in _TOKEN.finditer(text):
        kind, raw = m.lastgroup, m[0]
        if m["string"] is not None:
            kind = "string"
        if kind == "space":
            continue
        error = ""
        if kind == "string":
            error = string_error(raw, m["closed"] is not None)
            kind = "err" if error else "string_value"
        elif kind == "number":
            error = number_error(raw)
            kind = "err" if error else "number_value"
        elif kind == "word":
            kind, error = (WORDS[raw], "") if raw in WORDS else ("err", "invalid_character")
        elif kind == "mark":
            kind = MARKS[raw]
            if kind.endswith("end"):
                depth = max(0, depth - 1)
            elif kind == "colon" and out and out[-1].kind == "string_value":
                out[-1].kind = "property_name"
        elif kind == "other":
            kind, error = "err", "invalid_character"
        out.append(Token(kind, m.start(), m.end(), depth, error))
        if kind in ("object_start", "array_start"):
            depth += 1
    return out


@dataclass
class Node:
    """A value or a property of the tree, with its span; raw is the source of scalars and keys."""

    kind: str
    start: int
    end: int
    raw: str = ""
    key: str = ""
    children: list[Node] = field(default_factory=list)

    def walk(self, depth: int = 0) -> Iterator[tuple[Node, int]]:
        """Pre-order, with the depth in containers (a property's value is one deeper than its object)."""
        stack = [(self, depth)]
        while stack:
            node, d = stack.pop()
            yield node, d
            stack += [(c, d if node.kind == "property" else d + 1) for c in reversed(node.children)]


SCALARS = {"string_value": "string", "number_value": "number", "boolean_true": "boolean", "boolean_false": "boolean", "null_value": "null"}


def unquote(raw: str) -> str:
    try:
        return whole_pairs(json.loads(raw, strict=False))
    except ValueError:
        return raw.strip('"')


def parse(text: str) -> tuple[Node | None, list[tuple[int, int, str]]]:
    """The tree and the errors (start, end, message). Comments and trailing commas are fine, duplicate keys stay."""
    errors: list[tuple[int, int, str]] = []
    root: Node | None = None
    stack: list[Node] = []
    state = "value"  # value, after, key or colon

    def bad(t: Token, what: str) -> None:
        errors.append((t.start, t.end, what))

    def place(node: Node) -> None:
        nonlocal root
        if not stack:
            root = node
        else:
            stack[-1].children.append(node)

    def done(end: int) -> str:
        """A value is complete: close its property."""
        if stack and stack[-1].kind == "property":
            stack.pop().end = end
        return "after"

    for t in tokenize(text):
        if t.kind == "comment":
            continue
        if t.kind == "err":
            bad(t, ERRORS[t.error])
            if state == "value" and (stack or root is None):
                # a place holder, so that one error doesn't make others
                place(Node("null", t.start, t.end, "null"))
                state = done(t.end)
            continue
        if t.kind in ("object_end", "array_end"):
            if stack and stack[-1].kind == "property":
                bad(t, "Expected a value")
                done(t.start)
            if not stack or stack[-1].kind != t.kind[:-4]:
                bad(t, "Unexpected closing bracket")
                continue
            stack.pop().end = t.end
            state = done(t.end)
        elif state == "after":
            if not stack:
                bad(t, "Unexpected content after the value")
            elif t.kind == "comma":
                state = "key" if stack[-1].kind == "object" else "value"
            else:
                bad(t, "Expected a comma")
        elif state == "key":
            if t.kind in ("property_name", "string_value"):
                node = Node("property", t.start, t.end, text[t.start : t.end], unquote(text[t.start : t.end]))
                place(node)
                stack.append(node)
                state = "colon"
            else:
                bad(t, "Expected a property name")
        elif state == "colon":
            if t.kind == "colon":
                state = "value"
            else:
                bad(t, "Expected a colon")
        elif t.kind in ("object_start", "array_start"):
            node = Node(t.kind[:-6], t.start, t.end)
            place(node)
            stack.append(node)
            state = "key" if node.kind == "object" else "value"
        elif t.kind in SCALARS or t.kind == "property_name":
            place(Node(SCALARS.get(t.kind, "string"), t.start, t.end, text[t.start : t.end]))
            state = done(t.end)
        else:
            bad(t, "Expected a value")
    if stack or root is None:
        errors.append((len(text), len(text), ERRORS["unexpected_eof"]))
    return root, errors


def statistics(text: str) -> dict | None:
    """Depth, keys, values, kinds and the sum of all spans; null if the text has errors."""
    root, errors = parse(text)
    if errors or root is None:
        return None
    out = dict.fromkeys(("max_depth", "total_keys", "total_values", "objects", "arrays", "strings", "numbers", "booleans", "nulls", "size_bytes"), 0)
    for node, depth in root.walk():
        if node.kind == "property":
            out["total_keys"] += 1
            out["total_values"] += 1
            out["size_bytes"] += node.end - node.start
            continue
        if node.kind == "array":
            out["total_values"] += len(node.children)
        out[node.kind + "s"] += 1
        out["max_depth"] = max(out["max_depth"], depth)
        out["size_bytes"] += node.end - node.start
    return out | {"complexity": complexity(out)}


def complexity(s: dict) -> float:
    kinds = sum(s[k] > 0 for k in ("strings", "numbers", "booleans", "nulls", "objects", "arrays"))
    return 1.5 * s["max_depth"] + 0.1 * s["total_keys"] + 0.05 * s["total_values"] + 2.0 * kinds


def schema_of(node: Node, depth: int = 0) -> dict:
    """kind, with properties (the last of equal keys) or items; scalars carry an example."""
    if depth > MAX_SCHEMA_DEPTH:
        return {"kind": "any"}
    if node.kind == "object":
        return {"kind": "object", "properties": {p.key: schema_of(p.children[0], depth + 1) for p in node.children if p.children}}
    if node.kind == "array":
        items = [schema_of(c, depth + 1) for c in node.children]
        same = items and len({x["kind"] for x in items}) == 1
        return {"kind": "array", "items": items[0] if same else {"kind": "any"}}
    return {"kind": node.kind, "examples": [unquote(node.raw) if node.kind == "string" else node.raw]}


def infer_schema(text: str) -> dict | None:
    root, errors = parse(text)
    return None if errors or root is None else schema_of(root)


def merge_schemas(a: dict, b: dict) -> dict:
    """The schema of values of both: any if the kinds differ, with the examples of either."""
    if a["kind"] != b["kind"]:
        return {"kind": "any"}
    out = {"kind": a["kind"]}
    if a["kind"] == "object":
        out["properties"] = {k: merge_schemas(a["properties"][k], b["properties"][k]) if k in a["properties"] and k in b["properties"] else a["properties"].get(k) or b["properties"][k] for k in [*a["properties"], *b["properties"]]}
    elif a["kind"] == "array":
        out["items"] = merge_schemas(a["items"], b["items"])
    elif a["kind"] != "any":
        out["examples"] = list(dict.fromkeys([*a.get("examples", []), *b.get("examples", [])]))[:10]
    return out


def compatible(a: dict, b: dict) -> bool:
    """Whether b has all that a asks for."""
    if a["kind"] == "any":
        return True
    if a["kind"] != b["kind"]:
        return False
    if a["kind"] == "object":
        return all(k in b["properties"] and compatible(x, b["properties"][k]) for k, x in a["properties"].items())
    return compatible(a["items"], b["items"]) if a["kind"] == "array" else True


def schema_text(schema: dict) -> str:
    if schema["kind"] == "object":
        return "{" + ", ".join(f"{k}: {schema_text(v)}" for k, v in sorted(schema["properties"].items())) + "}"
    return f"[{schema_text(schema['items'])}]" if schema["kind"] == "array" else schema["kind"]


def suggestions(schema: dict) -> list[str]:
    out = []
    if schema["kind"] == "object":
        if len(schema["properties"]) > MANY_KEYS:
            out.append("Consider splitting large objects with >50 properties")
        out += [f"Property '{k}' suggests array-like structure" for k in schema["properties"] if k.startswith("item") or k.endswith(("_0", "_1"))]
    elif schema["kind"] == "array" and schema["items"]["kind"] == "any":
        out.append("Array has mixed types - consider using consistent types")
    elif schema["kind"] == "string" and schema.get("examples"):
        first = schema["examples"][0]
        if first.startswith(("http://", "https://")):
            out.append("String appears to be URL - consider URL validation")
        if "@" in first and "." in first:
            out.append("String appears to be email - consider email validation")
    return out


def symbols(text: str) -> list[tuple[str, str, int, int, str]]:
    """name, kind, start, end, signature in pre-order; containers and leaves are named by their path."""
    root, errors = parse(text)
    out: list[tuple[str, str, int, int, str]] = []

    def visit(node: Node, path: str) -> None:
        name = path or "root"
        if node.kind == "object":
            out.append((name, "object", node.start, node.end, f"object with {len(node.children)} properties"))
            for p in node.children:
                out.append((p.key, "property", p.start, p.end, f"property: {p.key}"))
                if p.children:
                    visit(p.children[0], f"{path}.{p.key}" if path else p.key)
        elif node.kind == "array":
            out.append((name, "array", node.start, node.end, f"array with {len(node.children)} elements"))
            for i, c in enumerate(node.children):
                out.append((f"{name}[{i}]", "array_element", c.start, c.end, f"element {i}"))
                visit(c, f"{name}[{i}]")
        else:
            out.append((name, node.kind, node.start, node.end, f"{node.kind}: {node.raw}"))

    if root is not None and not errors:
        visit(root, "")
    return out


def facts(text: str) -> list[tuple[int, int, int, str, int | None, int | None]]:
    """id (from 0), start, end, predicate, start and end of the value; in pre-order."""
    root, errors = parse(text)
    if errors or root is None:
        return []
    names = {"object": "starts_block", "array": "starts_block", "string": "is_string", "number": "is_number", "boolean": "is_keyword", "null": "is_keyword"}
    out, stack = [], [(root, root)]
    while stack:
        node, place = stack.pop()
        if node.kind == "property":
            stack += [(c, node) for c in node.children]
            continue
        value = (node.start, node.end) if node.kind == "number" else (None, None)
        out.append((len(out), place.start, place.end, names[node.kind], *value))
        stack += [(c, c) for c in reversed(node.children)]
    return out


TOKEN_FACTS = {"object_start": "json_is_object", "array_start": "json_is_array", "property_name": "json_is_key", "string_value": "is_string", "number_value": "is_number", "boolean_true": "json_is_boolean", "boolean_false": "json_is_boolean", "null_value": "json_is_null"}


def lint(text: str, rules: set[str] | None = None) -> list[tuple[str, str, str, int, int]]:
    """rule, severity, message, start, end for every node of a document; null rules take the defaults."""
    on = {r for r, (_, default, _) in JSON_RULES.items() if default} if rules is None else rules
    root, errors = parse(text)
    out = []

    def report(rule: str, message: str, start: int, end: int) -> None:
        if rule in on:
            out.append((rule, JSON_RULES[rule][0], message, start, end))

    names = {ERRORS["leading_zero"]: "no_leading_zeros", ERRORS["decimal_no_digits"]: "invalid_number", ERRORS["exponent_no_digits"]: "invalid_number", ERRORS["invalid_escape_sequence"]: "invalid_escape_sequence", ERRORS["invalid_unicode_escape"]: "invalid_escape_sequence", ERRORS["control_character_in_string"]: "valid_string_encoding"}
    for start, end, message in errors:
        report(names.get(message, "syntax_error"), message, start, end)
    for node, depth in root.walk() if root else ():
        if node.kind == "object":
            seen: set[str] = set()
            for p in node.children:
                if p.key in seen:
                    report("no_duplicate_keys", f"Duplicate object key '{p.key}'", p.start, p.end)
                seen.add(p.key)
            if len(node.children) > MANY_KEYS:
                report("large_structure", f"Object has {len(node.children)} properties", node.start, node.end)
        elif node.kind == "array" and len(node.children) > MANY_ELEMENTS:
            report("large_structure", f"Array has {len(node.children)} elements", node.start, node.end)
        elif node.kind == "number" and len(re.sub(r"[eE].*|\D", "", node.raw)) > 15:
            report("large_number_precision", "Number may lose precision", node.start, node.end)
        if node.kind in ("object", "array"):
            if depth > MAX_DEPTH:
                report("max_depth_exceeded", f"Nesting depth {depth} exceeds {MAX_DEPTH}", node.start, node.end)
            elif depth == DEEP + 1:
                report("deep_nesting", f"Nesting is deeper than {DEEP}", node.start, node.end)
    return sorted(out, key=lambda x: (x[3], x[4], x[0]))


def format_json(text: str, indent: int = 2, sort_keys: bool = False, compact: int = 0, tabs: bool = False) -> str | None:
    """The text laid out again, with raw numbers and the order of keys kept; null if it has errors.

    compact: objects of at most so many scalar properties, and arrays of as many scalars, stay on one line.
    """
    root, errors = parse(text)
    if errors or root is None:
        return None
    step = "\t" if tabs else " " * indent

    def scalar(n: Node) -> bool:
        return n.kind not in ("object", "array")

    def show(n: Node, level: int) -> str:
        if scalar(n):
            return n.raw
        opening, closing = ("{", "}") if n.kind == "object" else ("[", "]")
        if not n.children:
            return opening + closing
        rows = sorted(n.children, key=lambda p: p.key) if sort_keys and n.kind == "object" else n.children
        shown = [f"{p.raw}: {show(p.children[0], level + 1)}" if n.kind == "object" else show(p, level + 1) for p in rows]
        values = [p.children[0] if n.kind == "object" else p for p in rows]
        if len(rows) <= compact and all(map(scalar, values)):
            return f"{{ {', '.join(shown)} }}" if n.kind == "object" else f"[{', '.join(shown)}]"
        pad = "\n" + step * (level + 1)
        return opening + pad + ("," + pad).join(shown) + "\n" + step * level + closing

    return show(root, 0)


# As DataFrames


# Rows that a task holds before it hands them on, but for those of one document.
EXPLODED_ROWS = 20_000


def explode_documents(df: DataFrame, text: str, function, schema: str, names: list[str]) -> DataFrame:
    """df without the text, with one row for each row that a function gives for a document; null gives none."""
    keys = [c for c in df.columns if c != text]
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at, found = [], []
            for i, t in zip(b.index, b[text]):
                own = [] if t is None else function(t)
                at += [i] * len(own)
                found += own
                if len(found) >= EXPLODED_ROWS:
                    yield frame(b, at, found)
                    at, found = [], []
            yield frame(b, at, found)

    def frame(b: pd.DataFrame, at: list, found: list) -> pd.DataFrame:
        if not found:
            return pd.DataFrame(columns=[*keys, *names])
        return pd.concat([b[keys].loc[at].reset_index(drop=True), pd.DataFrame(found, columns=names)], axis=1)[[*keys, *names]]

    return spread(df).mapInPandas(run, f"{key_schema}, {schema}" if key_schema else schema)


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores at least: a small file in one piece would keep one worker busy."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.isStreaming or df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def tokens_table(df: DataFrame, text: str) -> DataFrame:
    rows = lambda t: [(i, x.kind, x.start, x.end, x.depth, x.error or None) for i, x in enumerate(tokenize(t))]
    return explode_documents(df, text, rows, "seq int, kind string, span_start long, span_end long, depth int, error string", ["seq", "kind", "span_start", "span_end", "depth", "error"])


def nodes_table(df: DataFrame, text: str) -> DataFrame:
    def rows(t: str) -> list:
        root, errors = parse(t)
        return [] if errors or root is None else [(i, n.kind, n.key or None, n.raw or None, n.start, n.end, d) for i, (n, d) in enumerate(root.walk())]

    return explode_documents(df, text, rows, "node_id int, kind string, `key` string, raw string, span_start long, span_end long, depth int", ["node_id", "kind", "key", "raw", "span_start", "span_end", "depth"])


def diagnostics_table(df: DataFrame, text: str) -> DataFrame:
    """rule, severity, message, span_start, span_end of each document: its syntax errors, or, without any, what lint finds."""

    def rows(t: str) -> list:
        errors = parse(t)[1]
        return [("syntax_error", "err", message, start, end) for start, end, message in errors] or lint(t)

    return explode_documents(df, text, rows, "rule string, severity string, message string, span_start long, span_end long", ["rule", "severity", "message", "span_start", "span_end"])


def symbols_table(df: DataFrame, text: str) -> DataFrame:
    return explode_documents(df, text, symbols, "name string, kind string, span_start long, span_end long, signature string", ["name", "kind", "span_start", "span_end", "signature"])


def lint_table(df: DataFrame, text: str, rules: set[str] | None = None) -> DataFrame:
    return explode_documents(df, text, lambda t: lint(t, rules), "rule string, severity string, message string, span_start long, span_end long", ["rule", "severity", "message", "span_start", "span_end"])


def facts_table(df: DataFrame, text: str) -> DataFrame:
    return explode_documents(df, text, facts, "id long, span_start long, span_end long, predicate string, value_start long, value_end long", ["id", "span_start", "span_end", "predicate", "value_start", "value_end"])


def token_facts_table(df: DataFrame, text: str) -> DataFrame:
    """A fact for each token that means something, without a tree; error tokens give none."""
    rows = lambda t: [(i, x.start, x.end, TOKEN_FACTS[x.kind]) for i, x in enumerate(y for y in tokenize(t) if y.kind in TOKEN_FACTS)]
    return explode_documents(df, text, rows, "id long, span_start long, span_end long, predicate string", ["id", "span_start", "span_end", "predicate"])


def merged_schema(df: DataFrame, text: str) -> dict:
    """One schema for all documents of a table; documents with errors are left out.

    Each task merges its documents, so the driver gets one small schema for each partition.
    """

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = None
        for b in batches:
            for v in b[text]:
                if v is not None and (s := infer_schema(v)) is not None:
                    out = s if out is None else merge_schemas(out, s)
        yield pd.DataFrame({"schema": [json.dumps(out)] if out is not None else []}, dtype=object)

    found = [json.loads(r.schema) for r in df.select(text).mapInPandas(merge, "schema string").collect()]
    out = found[0] if found else {"kind": "any"}
    for s in found[1:]:
        out = merge_schemas(out, s)
    return out


def minify(text: str) -> str | None:
    """The text on one line without blanks, with raw numbers and the order of keys kept; null if it has errors."""
    root, errors = parse(text)
    if errors or root is None:
        return None

    def show(n: Node) -> str:
        if n.kind == "object":
            return "{" + ",".join(f"{p.raw}:{show(p.children[0])}" for p in n.children) + "}"
        return "[" + ",".join(map(show, n.children)) + "]" if n.kind == "array" else n.raw

    return show(root)


STATISTICS = "max_depth int, total_keys int, total_values int, objects int, arrays int, strings int, numbers int, booleans int, nulls int, size_bytes long, complexity double"


def statistics_table(df: DataFrame, text: str) -> DataFrame:
    names = [x.split()[0] for x in STATISTICS.split(", ")]
    return explode_documents(df, text, lambda t: [tuple(s[n] for n in names)] if (s := statistics(t)) else [], STATISTICS, names)


def schema_column(text: Column) -> Column:
    """The inferred schema as text; null for null or a document with errors."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None or (s := infer_schema(v)) is None else schema_text(s) for v in values], dtype=object)

    return run(text)


def format_column(text: Column, **options) -> Column:
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else format_json(v, **options) for v in values], dtype=object)

    return run(text)


# Native, for clean documents


def kind(text: Column) -> Column:
    """The kind of the root value; null if it isn't JSON."""
    first = F.substring(F.btrim(text, F.lit(" \t\r\n")), 1, 1)
    named = F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(first.isin("t", "f"), "boolean").when(first == "n", "null").otherwise("number")
    return F.when(F.try_parse_json(text).isNotNull(), named)


def top_level_duplicates(text: Column) -> Column:
    keys = F.json_object_keys(text)
    return F.size(keys) > F.size(F.array_distinct(keys))
