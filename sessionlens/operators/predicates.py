"""Filters over events and paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import rx
from ..functions.text import base_name, blank_if_null, trimmed


def is_file_edit() -> Column:
    return (F.col("kind") == "tool_call") & F.col("tool").isin(*P.EDIT_TOOLS) & (blank_if_null(F.col("file_path")) != "")


def is_test_file(path: Column) -> Column:
    return rx.matches(path, "|".join(f"(?:{p})" for p in P.TEST_FILES))


def is_real_prompt(text: Column) -> Column:
    """Not blank, and none of the notes that a tool writes in the user's name."""
    t = trimmed(text)
    return (t != "") & ~reduce(Column.__or__, [t.startswith(x) for x in P.NOT_PROMPTS])


def bare_path(path: Column) -> Column:
    return F.regexp_replace(path, r"^\./", "")


def glob_matches(name: Column, pattern: Column) -> Column:
    """A file name against a pattern in which `*` stands for any signs but slashes."""
    literal = F.concat(F.lit(r"^\Q"), F.replace(pattern, F.lit("*"), F.lit(r"\E[^/]*\Q")), F.lit(r"\E\z"))
    return F.when(pattern.contains("*"), F.regexp_like(name, literal)).otherwise(name == pattern)


def path_matches(written: Column, tool_path: Column) -> Column:
    """A path as the user wrote it against the path of a tool call: folder, file name or pattern, or whole trailing parts."""
    up = bare_path(written)
    folder = tool_path.contains(F.concat(F.lit("/"), F.btrim(up, F.lit("/")), F.lit("/")))
    file = glob_matches(base_name(tool_path), up) | (tool_path == up) | tool_path.endswith(F.concat(F.lit("/"), up))
    return F.when((written == "") | (tool_path == ""), False).when(up.endswith("/"), folder).otherwise(file)


def shell_mutates(command: Column, path: Column) -> Column:
    up = F.btrim(bare_path(path), F.lit("/"))
    return (up != "") & command.contains(up) & rx.matches(command, P.MUTATING)


def pass_pressure(text: Column) -> Column:
    return rx.matches(text, P.PASS_PRESSURE)


def language_of(path: Column) -> Column:
    """go, python or typescript by extension; null for other files."""
    ends = lambda *e: reduce(Column.__or__, [path.endswith(x) for x in e])
    return F.when(ends(".go"), "go").when(ends(".py"), "python").when(ends(".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"), "typescript")


def untested_versions(versions: Column) -> Column:
    known = lambda v: reduce(Column.__or__, [(v == t) | v.startswith(t + ".") for t in P.TESTED_VERSIONS])
    return F.filter(versions, lambda v: ~known(v))


def fresh_tokens(usage: Column) -> Column:
    """Tokens that were not read from a cache."""
    return F.coalesce(usage["input"] + usage["output"] + usage["cache_creation"], F.lit(0)).cast("long")


def total_tokens(usage: Column) -> Column:
    return fresh_tokens(usage) + F.coalesce(usage["cache_read"], F.lit(0))


def both_diffs(side: str) -> Column:
    """The old or new text of an edit: its parts joined by newlines where it has parts."""
    parts = F.transform(F.col("edits"), lambda e: blank_if_null(e[side]))
    return F.when(F.coalesce(F.size("edits"), F.lit(0)) > 0, F.array_join(parts, "\n")).otherwise(blank_if_null(F.col(side)))
