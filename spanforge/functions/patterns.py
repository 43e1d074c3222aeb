"""Globs, paths, ignore rules, versions and languages."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

REGEX_MARKS = set("\\.^$*+?()[]{}|")


def glob_to_regex(pattern: str) -> str:
    """A glob as an anchored regular expression: * (slashes too), ?, [..], [!..] and \\x.

    The wildcards mean the same before and after a star. An open bracket without an end is itself.
    """
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append(f"[^{body[1:]}]" if body[0] in "!^" else f"[{body}]")
            i = end
        else:
            out.append("\\" + c if c in REGEX_MARKS else c)
        i += 1
    return "(?s)^" + "".join(out) + "$"


def matches_glob(text: Column, pattern: str) -> Column:
    return text.rlike(glob_to_regex(pattern))


def matches_any_glob(text: Column, patterns: list[str]) -> Column:
    return text.rlike("|".join(glob_to_regex(p) for p in patterns)) if patterns else F.lit(False)


def has_wildcard(text: Column) -> Column:
    return text.rlike(r"[*?\[]")


def expand_braces(pattern: str) -> list[str]:
    """a{b,c}d as abd and acd, nested too; a brace without a match is itself."""
    depth, start, cuts = 0, -1, []
    for i, c in enumerate(pattern):
        if c == "{":
            depth += 1
            if depth == 1:
                start, cuts = i, [i]
        elif c == "," and depth == 1:
            cuts.append(i)
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                cuts.append(i)
                parts = [pattern[a + 1 : b] for a, b in zip(cuts, cuts[1:])]
                return [pattern[:start] + x + rest for p in parts for x in expand_braces(p) for rest in expand_braces(pattern[i + 1 :])]
    return [pattern]


def has_component(path: Column, name: str) -> Column:
    return F.array_contains(F.split(path, "/"), name)


def contains_subpath(path: Column, part: str) -> Column:
    """Whether whole components of a path make up part."""
    return F.concat(F.lit("/"), path, F.lit("/")).contains(f"/{part.strip('/')}/")


def matches_path(path: Column, pattern: str) -> Column:
    """A pattern with a slash is a subpath or the path's end; one without is a component; wildcards are a glob."""
    if any(c in pattern for c in "*?["):
        return matches_glob(path if "/" in pattern else basename(path), pattern)
    return contains_subpath(path, pattern) if "/" in pattern else has_component(path, pattern)


def ignored(path: Column, rules: list[str]) -> Column:
    """Ignore rules: dir/ is a folder, /x a prefix, wildcards a glob, else a component; # is a comment, no negation."""
    out = F.lit(False)
    for rule in (r.strip() for r in rules):
        if rule and not rule.startswith("#"):
            if rule.endswith("/"):
                out = out | F.concat(F.lit("/"), path).contains(f"/{rule.strip('/')}/")
            elif rule.startswith("/"):
                out = out | path.startswith(rule[1:])
            elif any(c in rule for c in "*?["):
                out = out | matches_glob(path, rule) | matches_glob(basename(path), rule)
            else:
                out = out | contains_subpath(path, rule)
    return out


def included(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Included (an empty list includes all) and not excluded; .git never is. A pattern that ends with / is a prefix."""
    one = lambda p: path.startswith(p) if p.endswith("/") else matches_glob(path, p) | matches_glob(basename(path), p)
    some = lambda ps: F.greatest(F.lit(False), F.lit(False), *map(one, ps)) if ps else F.lit(False)
    return (some(include) if include else F.lit(True)) & ~some(exclude) & ~path.startswith(".git")


def is_hidden(path: Column) -> Column:
    name = basename(path)
    return name.startswith(".") & ~name.isin(".", "..")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """The path before the last slash; `.` without one, `/` at the root."""
    return F.when(~path.contains("/"), F.lit(".")).otherwise(F.coalesce(F.nullif(F.regexp_replace(path, "/[^/]*$", ""), F.lit("")), F.lit("/")))


def extension(path: Column) -> Column:
    """With its dot; empty without one or for a hidden name."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1)


def normalize(path: Column) -> Column:
    """Without doubled separators and components of one dot; "." if nothing is left."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    body = F.array_join(parts, "/")
    return F.when(path.startswith("/"), F.concat(F.lit("/"), body)).when(body == "", ".").otherwise(body)


def add_relative_prefix(path: Column) -> Column:
    """./ before a relative path that doesn't begin with ./ or ../ yet."""
    as_is = (path == ".") | (path == "..") | path.startswith("/") | path.startswith("./") | path.startswith("../")
    return F.when(as_is, path).otherwise(F.concat(F.lit("./"), path))


# What listings leave out unless told otherwise.
IGNORED = [".git", ".svn", ".hg", "node_modules", "dist", "build", "target", "__pycache__", "venv", "env", "tmp", "temp", ".zig-cache", "zig-out", "deps", "archive"]
HIDDEN = [".DS_Store", "Thumbs.db"]


def should_hide(name: Column, names: list[str] | None = None) -> Column:
    """Whether a file name is one of the names (HIDDEN if not given)."""
    return name.isin(HIDDEN if names is None else names)


def should_ignore(path: Column, names: list[str] | None = None) -> Column:
    """A path that is . or .., begins with a dot folder, or matches one of the names (IGNORED if not given)."""
    out = path.isin(".", "..") | (path.startswith(".") & ~path.startswith("./") & ~path.startswith("../"))
    for name in IGNORED if names is None else names:
        out = out | matches_path(path, name)
    return out & (path != "")


def join_path(*parts: Column) -> Column:
    return F.regexp_replace(F.concat_ws("/", *parts), "/+", "/")


# Languages by extension.
LANGUAGES = {"typescript": [".ts", ".tsx"], "css": [".css"], "html": [".html", ".htm"], "json": [".json"], "svelte": [".svelte"], "zig": [".zig"], "zon": [".zon"]}


def language(path: Column) -> Column:
    ext, out = F.lower(extension(path)), F
    for name, ends in LANGUAGES.items():
        out = out.when(ext.isin(ends), F.lit(name))
    return out.otherwise(F.lit("unknown"))


SEMVER = r"^v?(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.\-]+))?(?:\+([0-9A-Za-z.\-]+))?$"


def semver(version: Column) -> Column:
    """major, minor, patch, prerelease, build; null if it isn't a version."""
    part = lambda i: F.regexp_extract(version, SEMVER, i)
    number = lambda i: part(i).cast("bigint")
    return F.when(version.rlike(SEMVER), F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch"), part(4).alias("prerelease"), part(5).alias("build")))


def semver_key(version: Column) -> Column:
    """What versions are ordered by: a prerelease before its release, the build left out."""
    v = semver(version)
    return F.struct(v["major"], v["minor"], v["patch"], (v["prerelease"] == "").alias("release"), v["prerelease"])


def is_major_change(old: Column, new: Column) -> Column:
    return semver(old)["major"] != semver(new)["major"]


def clean_version(version: Column) -> Column:
    return F.regexp_replace(F.trim(version), "^v", "")


def dependency_status(declared: Column, installed: Column) -> Column:
    """missing, needs_update or up_to_date."""
    return F.when(installed.isNull(), "missing").when(clean_version(declared) == clean_version(installed), "up_to_date").otherwise("needs_update")


def retryable(error: Column) -> Column:
    """Whether an error is worth another attempt."""
    return F.lower(error).rlike("timeout|network|connection|busy|temporar|try ?again")


def error_class(error: Column) -> Column:
    e = F.lower(error)
    return F.when(e.rlike("notfound|not found|no such"), "not_found").when(e.rlike("access|permission|denied"), "permission").when(e.rlike("memory"), "memory").when(retryable(error), "network").when(e.rlike("parse|syntax|invalid|unexpected"), "syntax").otherwise("other")


def parse_duration_ns(text: Column) -> Column:
    """2s, 500ms, 10us, 3ns, 1m or 1h in nanoseconds; a bare number is in nanoseconds, anything else null."""
    pattern = r"^(\d+)(ns|us|ms|s|m|h)?$"
    unit = F.regexp_extract(text, pattern, 2)
    scale = F.when(unit == "us", 1000).when(unit == "ms", 10**6).when(unit == "s", 10**9).when(unit == "m", 60 * 10**9).when(unit == "h", 3600 * 10**9).otherwise(1)
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1).cast("bigint") * scale.cast("bigint"))
