"""Unicode validation, classification and escapes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import python_function

# Characters that a mode rejects.
REJECTED = {
    "strict": "[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x9F\\uFDD0-\\uFDEF\\uFFFE\\uFFFF]",
    "sanitize": "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F\\uFDD0-\\uFDEF\\uFFFE\\uFFFF]",
    "permissive": "[\\x00]",
}
BOM = "\ufeff"


def is_valid(text: Column, mode: str = "strict") -> Column:
    """Whether a mode accepts a text. A byte order mark at the start is accepted in permissive mode alone."""
    bad = text.rlike(REJECTED[mode])
    return ~(bad if mode == "permissive" else bad | text.startswith(BOM))


def count_rejected(text: Column, mode: str = "strict") -> Column:
    return F.regexp_count(text, F.lit(REJECTED[mode])).cast("bigint")


@python_function("int")
def first_invalid_byte(text: str, mode: str = "strict") -> int:
    """UTF-8 offset of the first character that a mode rejects; -1 if there is none."""
    if mode != "permissive" and text.startswith(BOM):
        return 0
    m = re.search(REJECTED[mode], text)
    return len(text[: m.start()].encode()) if m else -1


def sanitize(text: Column) -> Column:
    """Characters that strict mode rejects become U+FFFD."""
    return F.regexp_replace(text, REJECTED["strict"], "\ufffd")


def repair_utf8(data: Column) -> Column:
    return F.make_valid_utf8(data)


def classify(code_point: Column) -> Column:
    """The class of a code point."""
    c = code_point
    return (
        F.when((c < 0x20) | c.between(0x7F, 0x9F), "control")
        .when(c.between(0xD800, 0xDFFF), "surrogate")
        .when(c.between(0xFDD0, 0xFDEF) | (c.bitwiseAND(0xFFFE) == 0xFFFE), "noncharacter")
        .when(c.between(0xE000, 0xF8FF) | c.between(0xF0000, 0x10FFFD), "private_use")
        .when((c < 0) | (c > 0x10FFFF), "invalid")
        .when(c < 0x80, "ascii")
        .otherwise("other")
    )


def utf8_length(code_point: Column) -> Column:
    """Bytes of a code point in UTF-8; 0 if it has none."""
    c = code_point
    return F.when((c < 0) | c.between(0xD800, 0xDFFF) | (c > 0x10FFFF), 0).when(c < 0x80, 1).when(c < 0x800, 2).when(c < 0x10000, 3).otherwise(4)


@python_function("string")
def parse_escapes(text: str) -> str:
    r"""\xXX, \uXXXX (surrogate pairs too), \u{X} and \UXXXXXXXX as characters."""
    one = lambda m: chr(int(next(g for g in m.groups() if g), 16))
    out = re.sub(r"\\x([0-9a-fA-F]{2})|\\u\{([0-9a-fA-F]{1,6})\}|\\u([0-9a-fA-F]{4})|\\U([0-9a-fA-F]{8})", one, text)
    return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


@python_function("string")
def format_escapes(text: str, style: str = "json") -> str:
    r"""Characters outside ASCII as escapes: json (surrogate pairs), braces \u{X}, hex \xXX bytes, long \UXXXXXXXX, entity &#xX;."""
    def one(m: re.Match) -> str:
        c = ord(m[0])
        if style == "json":
            return "".join(f"\\u{u:04x}" for u in ([c] if c < 0x10000 else [0xD7C0 + (c >> 10), 0xDC00 + (c & 0x3FF)]))
        return {"braces": f"\\u{{{c:X}}}", "hex": "".join(f"\\x{b:02X}" for b in m[0].encode()), "long": f"\\U{c:08X}", "entity": f"&#x{c:X};"}[style]

    return re.sub(r"[^\x00-\x7F]", one, text)
