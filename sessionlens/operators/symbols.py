"""Symbol tables of working trees, and the calls of edits that they lack."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions import code
from ..functions.text import blank_if_null
from .predicates import both_diffs, is_file_edit, language_of


class Declarations:
    """Table function: a row `(kind, name, position)` for each name that a file of a language declares, as it is found."""

    @staticmethod
    def analyze(text: AnalyzeArgument, language: AnalyzeArgument) -> AnalyzeResult:
        for a in (text, language):
            if not isinstance(a.dataType, T.StringType):
                raise TypeError("text and language are strings")
        return AnalyzeResult(T.StructType().add("kind", T.StringType()).add("name", T.StringType()).add("position", T.IntegerType()))

    def eval(self, text: str | None, language: str | None) -> Iterator[tuple]:
        yield from code.declarations(text or "", language)


def file_declarations(files: DataFrame) -> DataFrame:
    """`cwd, path, language, kind, name, position` of what `files(cwd, path, text)` declare, a row each.

    A Go file that parses has a row of kind package; one that does not has no row. Positions are known for Go only.
    """
    known = files.withColumn("language", language_of(F.col("path"))).where("language IS NOT NULL")
    rows = F.udtf(Declarations)(F.col("text").outer(), F.col("language").outer())
    return known.lateralJoin(rows).select("cwd", "path", "language", "kind", "name", "position")


@F.pandas_udf(T.ArrayType(T.StringType()))
def candidate_names(text: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([code.candidates(t or "", g) for t, g in zip(text, language, strict=True)])


@F.pandas_udf(T.StructType([T.StructField("names", T.ArrayType(T.StringType())), T.StructField("wild", T.BooleanType())]))
def imported_names(text: pd.Series, language: pd.Series) -> pd.DataFrame:
    got = [code.imported(t or "", g) for t, g in zip(text, language, strict=True)]
    return pd.DataFrame({"names": [n for n, _ in got], "wild": [w for _, w in got]})


def symbol_table(files: DataFrame) -> DataFrame:
    """`cwd, language, name` of every declared name of `files(cwd, path, text)`, distinct; a Go file's package is none."""
    return file_declarations(files).where("kind <> 'package'").select("cwd", "language", "name").distinct()


def usable_languages(files: DataFrame, declared: DataFrame) -> DataFrame:
    """`cwd, language` of the languages that a tree can be checked for: any file of one read by patterns, of Go one that parses."""
    read = files.select("cwd", language_of(F.col("path")).alias("language")).where("language <> 'go'")
    return read.unionByName(declared.where("kind = 'package'").select("cwd", "language")).distinct()


def undefined_calls(events: DataFrame, sessions: DataFrame, files: DataFrame) -> DataFrame:
    """Edits with `language`, and `name` of a bare call that the session's tree declares nowhere; `pos` keeps their order.

    Only languages with files in the tree count. Names the edited file imports, as it is now, are known; a file
    that imports everything of a module is passed over.
    """
    edits = events.where(is_file_edit()).withColumn("new", both_diffs("new_string")).withColumn("language", language_of(F.col("file_path")))
    edits = edits.where("new <> '' AND language IS NOT NULL")
    tree = files.withColumn("language", language_of(F.col("path"))).where("language IS NOT NULL")
    declared = file_declarations(files)
    # names leave their texts before any join, and a tree's languages, one key for all its edits, go to where those are
    called = edits.select("session_id", "seq", "language", "file_path", F.posexplode(candidate_names("new", "language")).alias("pos", "name"))
    called = called.join(sessions.where(blank_if_null(F.col("cwd")) != "").select("session_id", "cwd"), "session_id")
    called = called.join(F.broadcast(usable_languages(files, declared)), ["cwd", "language"], "left_semi")
    edited = tree.join(called.select("cwd", F.col("file_path").alias("path")).distinct(), ["cwd", "path"], "left_semi")
    bound = edited.select("cwd", F.col("path").alias("file_path"), imported_names("text", "language").alias("i"))
    called = called.join(bound.where("i.wild").select("cwd", "file_path"), ["cwd", "file_path"], "left_anti")
    called = called.join(bound.select("cwd", "file_path", F.explode("i.names").alias("name")), ["cwd", "file_path", "name"], "left_anti")
    lacking = called.join(declared.where("kind <> 'package'"), ["cwd", "language", "name"], "left_anti")
    return lacking.select("session_id", "seq", "pos", "name", "language").join(events, ["session_id", "seq"])
