"""Character classes as column predicates: true if every character of a non-empty string is in the class."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The classes as regular expressions.
CLASSES = {
    "whitespace": r"[ \t\r]",
    "whitespace_or_newline": r"[ \t\r\n]",
    "newline": r"\n",
    "digit": r"[0-9]",
    "hex_digit": r"[0-9a-fA-F]",
    "binary_digit": r"[01]",
    "octal_digit": r"[0-7]",
    "alpha": r"[a-zA-Z]",
    "alphanumeric": r"[a-zA-Z0-9]",
    "identifier_start": r"[a-zA-Z_$]",
    "identifier_char": r"[a-zA-Z0-9_$]",
    "string_delimiter": r"[\"'`]",
    "operator": r"[+\-*/%=<>!&|^~?]",
    "delimiter": r"[(){}\[\];:,.]",
    "upper": r"[A-Z]",
    "lower": r"[a-z]",
    "control": r"[\x00-\x1F\x7F]",
    "printable": r"[\x20-\x7E]",
}
# What a scanner takes from the start of a text.
CONSUMERS = {
    "whitespace": r"^[ \t\r]*",
    "whitespace_and_newlines": r"^[ \t\r\n]*",
    "identifier": r"^[a-zA-Z_$][a-zA-Z0-9_$]*",
    "number": r"^-?(0[xX][0-9a-fA-F]+|0[bB][01]+|0[oO][0-7]+|[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?)",
    "string": r"(?s)^(\"(\\.|[^\"\\])*\"|'(\\.|[^'\\])*')",
    "line_comment": r"^//[^\n]*",
    "block_comment": r"(?s)^/\*.*?\*/",
}


def is_class(text: Column, name: str) -> Column:
    return text.rlike(f"^{CLASSES[name]}+$") & ~text.endswith("\n") if name not in ("newline", "control", "whitespace_or_newline") else text.rlike(f"^(?:{CLASSES[name]})+\\z")


def count_class(text: Column, name: str) -> Column:
    """How many characters of a text are in a class."""
    return F.regexp_count(text, F.lit(CLASSES[name])).cast("bigint")


def consume(text: Column, what: str) -> Column:
    """How many characters a scanner takes from the start; 0 if it finds nothing."""
    return F.length(F.regexp_extract(text, CONSUMERS[what], 0)).cast("bigint")


def block_comment_lines(text: Column) -> Column:
    """Line ends inside the block comment that a text starts with."""
    return F.regexp_count(F.regexp_extract(text, CONSUMERS["block_comment"], 0), F.lit("\n")).cast("bigint")
