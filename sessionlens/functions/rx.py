"""Patterns in RE2 syntax, and their form in Java's.

The engine's patterns keep RE2's meaning: ASCII word boundaries, `\\s` without the vertical tab, `$` only at the
very end, `.` for anything but a newline, and Unicode case folding. `java` writes that out for Spark.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
_BLANK = r"\t\n\f\r "


def java(pattern: str) -> str:
    """An RE2 pattern as Java's regex engine must see it to match the same."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            two = pattern[i : i + 2]
            if two == r"\b" and not inside:
                out.append(edge(pattern, i))
                i += 2
                continue
            out.append({r"\s": _BLANK if inside else f"[{_BLANK}]", r"\S": f"[^{_BLANK}]"}.get(two, two))
            i += 2
            continue
        if inside:
            inside = c != "]"
            out.append(r"\[" if c == "[" else c)
        elif c == "[":
            inside = True
            out.append(c)
            if pattern[i + 1] == "^":
                out.append("^")
                i += 1
        elif pattern.startswith("(?i)", i):
            out.append("(?iu)")
            i += 4
            continue
        elif pattern.startswith("(?m)", i):
            out.append("(?md)")
            i += 4
            continue
        else:
            out.append({"$": r"\z", ".": r"[^\n]"}.get(c, c))
        i += 1
    return "".join(out)


def edge(pattern: str, at: int) -> str:
    """The word boundary at `at`, by one look where a plain word sign stands beside it."""
    after, then = pattern[at + 2 : at + 3], pattern[at + 3 : at + 4]
    if after.isascii() and (after.isalnum() or after == "_") and (not then or then not in "?*{|"):
        return "(?<![A-Za-z0-9_])"
    before, escaped = pattern[at - 1 : at], pattern[at - 2 : at - 1] == "\\"
    if at and before.isascii() and (before.isalnum() or before == "_") and not escaped:
        return "(?![A-Za-z0-9_])"
    return _EDGE


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(java(pattern))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(java(pattern)))
