"""Paths, globs and URLs as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def portable(path: Column) -> Column:
    """Forward slashes, no leading ./"""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")


def is_safe_relative(path: Column) -> Column:
    return ~(path.startswith("/") | path.rlike("^[A-Za-z]:") | F.array_contains(F.split(path, "/"), ".."))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """The last dot and what follows it, empty for names without one or with only a leading one."""
    return F.regexp_extract(basename(path), r"[^.].*?(\.[^.]*)$", 1)


def glob_pattern(glob: str, dialect: str = "catalog") -> str:
    """A regular expression for one glob.

    catalog: ** is any text, so docs/**/x needs both slashes. symbols: **/ is an optional directory and ? is literal.
    task: **/ is an optional directory and ? is one character.
    """
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i) and dialect != "catalog":
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        elif glob[i] == "*":
            out.append("[^/]*")
            i += 1
        elif glob[i] == "?" and dialect != "symbols":
            out.append("[^/]")
            i += 1
        else:
            out.append(re.sub(r"([.+^${}()|\[\]\\?])", r"\\\1", glob[i]))
            i += 1
    return "^" + "".join(out) + "$"


def glob_regex(glob: Column) -> Column:
    """The pattern of a glob that is data: **/ is an optional directory, ** any text, * and ? stay within a name."""
    out = F.regexp_replace(glob, r"([.+^${}()|\[\]\\])", r"\\$1")
    for sign, pattern in (("**/", "\1"), ("**", "\2"), ("*", "[^/]*"), ("?", "[^/]"), ("\1", "(?:.*/)?"), ("\2", ".*")):
        out = F.replace(out, F.lit(sign), F.lit(pattern))
    return F.concat(F.lit("^"), out, F.lit("$"))


def escapes_root(path: Column, target: Column) -> Column:
    """Whether a link's target, absolute or relative to the link's folder, lies outside the tree that path is in."""
    parts = F.split(F.concat_ws("/", dirname(path), target), "/")
    step = lambda at, x: F.when(at < 0, at).when(x.isin("", "."), at).when(x == "..", at - 1).otherwise(at + 1)
    return target.rlike("^(/|[A-Za-z]:)") | (F.aggregate(parts, F.lit(0), step) < 0)


def matches_any(path: Column, globs: list[str], dialect: str = "catalog") -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_pattern(g, dialect))
    return out


def selected(path: Column, includes: list[str], excludes: list[str], dialect: str = "catalog") -> Column:
    """Any include (or none given), and no exclude."""
    return (matches_any(path, includes, dialect) if includes else F.lit(True)) & ~matches_any(path, excludes, dialect)


def relativize(path: Column, source_root: Column, lab_root: Column) -> Column:
    """A path under one of two roots, relative to it; other absolute paths keep their name only."""
    clean = F.replace(F.regexp_replace(F.regexp_replace(F.trim(path), "^['\"]|['\"]$", ""), r"\?.*$", ""), F.lit("\\"), F.lit("/"))
    clean = F.regexp_replace(clean, "^file://", "")

    def under(root: Column) -> Column:
        return (clean == root) | F.startswith(clean, F.concat(root, F.lit("/")))

    def rest(root: Column) -> Column:
        tail = F.regexp_replace(F.substring(clean, F.length(root) + 1, F.length(clean)), "^/", "")
        return F.when(tail == "", ".").otherwise(tail)

    return (F.when(path.isNull() | (path == ""), F.lit(None)).when(under(source_root), rest(source_root)).when(under(lab_root), rest(lab_root))
            .when(clean.rlike("^([A-Za-z]:)?/"), F.concat(F.lit("<external>/"), basename(clean))).otherwise(F.regexp_replace(clean, r"^\./", "")))
