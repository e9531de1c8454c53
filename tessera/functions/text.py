"""Names, tokens, paths and patterns as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BOUNDARY = r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=\p{Nd})(?=\p{L})|(?<=\p{L})(?=\p{Nd})|[^\p{L}\p{Nd}]+"


def normalize_name(name: Column) -> Column:
    return F.lower(F.trim(name))


def tokens(text: Column) -> Column:
    """Sorted distinct lower-case words; camel case, acronyms and digits part words."""
    parts = F.transform(F.split(text, BOUNDARY), lambda x: F.lower(F.translate(x, "Σİ", "σi")))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


def search_terms(text: Column) -> Column:
    """The first 2048 tokens of 3 to 128 bytes."""
    return F.slice(F.filter(tokens(text), lambda t: F.octet_length(t).between(3, 128)), 1, 2048)


def symbol_tokens(display_name: Column, terms: Column) -> Column:
    return F.array_sort(F.array_union(tokens(display_name), terms))


# Infixes of qualified stable names that people leave out.
INFIXES = ["package", "type", "interface", "method", "function", "field", "constant", "variable"]


def human_name(stable_name: Column) -> Column:
    """A stable name without the infixes that say what its parts are."""
    return F.regexp_replace(stable_name, r"\.(?:" + "|".join(INFIXES) + r")\.", ".")


def terminal_name(name: str) -> str:
    head, dot, tail = name.rpartition(".")
    return tail if dot and tail else name


def glob_regex(pattern: str) -> str:
    """An anchored Java regex of a path pattern: * and ? stay within a segment."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        if c == "[" and "]" in pattern[k + 2 :]:
            end = pattern.index("]", k + 2)
            out.append("[" + pattern[k + 1 : end].replace("\\", "\\\\") + "]")
            k = end
        elif c == "\\" and k + 1 < len(pattern):
            k += 1
            out.append(re.escape(pattern[k]))
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c))
        k += 1
    return "^(?s:" + "".join(out) + r")\z"


def matches(value: Column, pattern: str) -> Column:
    """Whether a value is under a `prefix/**` pattern or fits a path pattern."""
    if pattern.endswith("/**"):
        return value.startswith(pattern[:-2])
    return value.rlike(glob_regex(pattern))


def matches_any(value: Column, patterns: list[str]) -> Column:
    """Whether a value fits one of the patterns; all path patterns are one expression."""
    under = [value.startswith(p[:-2]) for p in patterns if p.endswith("/**")]
    fitting = [glob_regex(p) for p in patterns if not p.endswith("/**")]
    out = under + ([value.rlike("|".join(f"(?:{f})" for f in fitting))] if fitting else [])
    return reduce(Column.__or__, out, F.lit(False))


def heading_anchor(title: Column) -> Column:
    """The anchor of a heading: lower case, words joined by hyphens."""
    kept = F.regexp_replace(F.lower(F.trim(title)), r"[^\p{L}\p{Nd}_\- ]", "")
    return F.regexp_replace(kept, " ", "-")


def clean_path(path: Column) -> Column:
    """A path without `.` segments, doubled slashes and resolvable `..`."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    empty = F.array().cast("array<string>")

    def step(acc: Column, x: Column) -> Column:
        up = (x == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != "..")
        return F.when(F.size(acc) == 0, F.array(x)).when(up, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.array_append(acc, x))

    joined = F.concat_ws("/", F.aggregate(parts, empty, step))
    return F.when(path.startswith("/"), F.concat(F.lit("/"), joined)).when(joined == "", ".").otherwise(joined)


def common_segments(a: Column, b: Column) -> Column:
    """The number of equal leading path segments."""
    same = F.zip_with(F.split(a, "/"), F.split(b, "/"), lambda x, y: F.coalesce(x == y, F.lit(False)))
    differs = F.array_position(same, False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(same)).cast("int")


def stable_hash(*parts: Column) -> Column:
    """sha256 of the parts, parted by NUL."""
    return F.sha2(F.concat_ws("\0", *parts), 256)


def byte_column(line: Column, column: Column, unit: str = "utf-8") -> Column:
    """The byte, from 0, of a place in a line that is counted in bytes, in code points
    ("utf-32") or in UTF-16 units; null past the line's end, before its start, or
    within a character."""
    size = F.octet_length(line)
    if unit == "utf-8":
        return F.when((column >= 0) & (column <= size), column)
    if unit == "utf-32":
        return F.when((column >= 0) & (column <= F.length(line)), F.octet_length(F.substr(line, F.lit(1), column.cast("int"))))
    if unit != "utf-16":
        raise ValueError("a place is counted in utf-8, utf-16 or utf-32")
    start = F.struct(F.lit(0).alias("units"), F.lit(0).alias("bytes"))

    def walk(a: Column, c: Column) -> Column:
        width = F.octet_length(c)
        step = F.struct((a["units"] + F.when(width == 4, 2).otherwise(1)).alias("units"), (a["bytes"] + width).alias("bytes"))
        return F.when(a["units"] >= column, a).otherwise(step)

    end = F.aggregate(F.filter(F.split(line, ""), lambda c: c != ""), start, walk)
    return F.when((column >= 0) & (end["units"] == column), end["bytes"])
