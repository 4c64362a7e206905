"""Directives: what the user's prompts fence off, until when, and which tool calls break them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import rx
from ..functions.text import ZERO_TIME, base_name, blank_if_null, trimmed
from ..sources.tables import written
from .predicates import bare_path, is_file_edit, path_matches, shell_mutates


def sorted_side(df: DataFrame) -> DataFrame:
    """The right side of a join by sorted shuffles at every size.

    Logs repeat themselves, so their files are far smaller than their rows: going by file sizes, Spark sends tables to
    the driver for a broadcast that are many times what it takes them for.
    """
    return df.hint("merge")


def known_time(c: Column) -> Column:
    """Unknown times are before all others."""
    return F.coalesce(c, F.to_timestamp(F.lit(ZERO_TIME)))


def split_sentences(text: Column) -> Column:
    return F.split(text, rx.java(P.SENTENCE_END), -1)


def clean_path(path: Column) -> Column:
    """A captured path without quotes and punctuation around it; null unless it has a slash or a dot."""
    bare = F.btrim(path, F.lit(P.PATH_TRIM))
    return F.when(bare.rlike("[/.]"), bare)


def extract_directives(prompts: DataFrame) -> DataFrame:
    """`session_id, seq, ts, n, kind, path, sentence` of `prompts(session_id, seq, ts, text)`, with its other columns; `n` keeps their order.

    In each sentence the fence patterns come first, then the exclusive one; every match counts.
    """
    about = [c for c in prompts.columns if c != "text"]
    rows = prompts.select(*about, F.posexplode(split_sentences(F.col("text"))).alias("s", "sentence"))
    def of(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("sentence", F.lit(rx.java(pattern)), F.lit(1)), lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("path")))

    found = [*(of("fence", p) for p in P.FENCES), of("exclusive", P.EXCLUSIVE)]
    rows = rows.select(*about, "s", "sentence", F.posexplode(F.concat(*found)).alias("m", "d"))
    rows = rows.select(*about, (F.col("s").cast("long") * 100000 + F.col("m")).alias("n"), "d.kind", clean_path(F.col("d.path")).alias("path"), "sentence")
    return rows.where("path IS NOT NULL")


def compaction_sides(events: DataFrame) -> DataFrame:
    """`events` with `pre_compaction`: none before, one later in the session. Both looks are running ones, from either end."""
    squeezed = F.max(F.when(F.col("kind") == "compaction", 1).otherwise(0))
    seen = lambda order: F.coalesce(squeezed.over(Window.partitionBy("session_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return events.withColumn("pre_compaction", (seen(F.asc("seq")) == 0) & (seen(F.desc("seq")) == 1))


def first_after(rows: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """`rows(keys, seq, n, ts)` with `mark`: the first of `marks(keys, seq, ts)` of the same keys that is later in the log and in time; null if none.

    One running pass from the end of each key's rows and marks gives the next mark and the latest time of any. They settle a row
    unless its next mark is not later in time though a further one is; such rows, of logs out of order, alone look at marks by a join.
    """
    both = rows.select(*keys, "seq", "n", known_time(F.col("ts")).alias("at"), F.lit(1).alias("asks")).unionByName(marks.select(*keys, "seq", F.lit(None).cast("long").alias("n"), known_time(F.col("ts")).alias("at"), F.lit(0).alias("asks")))
    later = Window.partitionBy(*keys).orderBy(F.desc("seq"), F.desc("asks")).rowsBetween(Window.unboundedPreceding, -1)
    marked = F.when(F.col("asks") == 0, F.struct("seq", "at"))
    seen = both.withColumns({"next": F.last(marked, ignorenulls=True).over(later), "most": F.max(marked["at"]).over(later)}).where("asks = 1")
    clear = F.when(F.col("next.at") > F.col("at"), F.col("next.seq"))
    open_ = F.coalesce(F.col("most") > F.col("at"), F.lit(False)) & clear.isNull()
    asked = [*keys, "seq", "n"]
    left = seen.where(open_).select(*asked, "at").join(sorted_side(marks.select(*keys, F.col("seq").alias("m_seq"), known_time(F.col("ts")).alias("m_at"))), keys).where("m_seq > seq AND m_at > at")
    return seen.where(~open_).select(*asked, clear.alias("mark")).unionByName(left.groupBy(*asked).agg(F.min("m_seq").alias("mark")))


#: Signs of a path in lower case, and how many of them, one a slash or a dot, look a path up.
_PATH_SIGNS, _GRAM = r"[a-z0-9_~$@.*/-]+", 6


def path_gram(path: Column) -> Column:
    """The signs about a path's first slash or dot: what any text that holds the path holds too."""
    start = F.greatest(F.lit(1), F.least(F.regexp_instr(path, F.lit("[/.]")) - 2, F.length(path) - (_GRAM - 1)))
    return F.substring(path, start, F.lit(_GRAM))


def path_mentions(paths: DataFrame, prompts: DataFrame) -> DataFrame:
    """`session_id, path, seq, ts`: the prompts whose text holds a path of `paths(session_id, path)`, both in lower case.

    An inverted index of prompts: runs of path signs that have a slash or a dot, each once a session, by the short pieces
    of them that a path could be looked up by. A path is looked up by one piece; the run that holds it decides.
    """
    runs = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit(f"({_PATH_SIGNS})"), F.lit(1)), lambda t: t.rlike("[/.]")))
    rows = written(prompts.select("session_id", "seq", "ts", F.explode(runs).alias("run")), "runs")

    def pieces(size: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("run") - (size - 1))), lambda i: F.substring(F.col("run"), i, F.lit(size)))

    grams = F.array_distinct(F.filter(F.concat(*map(pieces, range(1, _GRAM + 1))), lambda g: g.rlike("[/.]")))
    index = rows.select("session_id", "run").distinct().select("session_id", "run", F.explode(grams).alias("gram"))
    asked = paths.select("session_id", "path", path_gram(F.col("path")).alias("gram"))
    found = index.join(sorted_side(asked), ["session_id", "gram"]).where(F.col("run").contains(F.col("path"))).select("session_id", "run", "path")
    return rows.join(sorted_side(found), ["session_id", "run"]).select("session_id", "path", "seq", "ts").distinct()


def superseded(directives: DataFrame, prompts: DataFrame) -> DataFrame:
    """`directives` with `superseded_at` and `superseded_by`: the first later prompt that names the path or reopens it.

    Prompts that reopen and prompts that name a path are found without the directives they end; two as-of searches then
    take the first of either. Work grows with directives and prompts, not with their pairs.
    """
    asks = directives.select("session_id", "seq", "n", "ts", F.lower("path").alias("path"))
    reopening = prompts.where(rx.matches(F.col("text"), P.REOPENING)).select("session_id", "seq", "ts")
    named = written(path_mentions(asks.select("session_id", "path").distinct(), prompts), "mentions")
    ended = first_after(asks, reopening, ["session_id"]).unionByName(first_after(asks, named, ["session_id", "path"]).drop("path"))
    first = ended.groupBy("session_id", "seq", "n").agg(F.min("mark").alias("mark"))
    by = prompts.select("session_id", F.col("seq").alias("mark"), F.col("ts").alias("superseded_at"), F.col("text").alias("superseded_by"))
    return directives.join(sorted_side(first), ["session_id", "seq", "n"], "left").join(sorted_side(by), ["session_id", "mark"], "left").select(*directives.columns, "superseded_at", "superseded_by")


def session_directives(events: DataFrame) -> DataFrame:
    """Directives of a log's prompts and what ends them. Prompts and directives are written once and read as often as the searches ask."""
    prompts = written(compaction_sides(events).where("kind = 'prompt'").select("session_id", "seq", "ts", "text", "pre_compaction"), "prompts")
    return superseded(written(extract_directives(prompts), "directives"), prompts)


def time_bins(calls: DataFrame, most: int) -> DataFrame:
    """`session_id, begins, width, bins` of each session's calls: about `most` of them fall into a bin, if they are spread evenly."""
    at = F.unix_micros("e_ts")
    s = calls.groupBy("session_id").agg(F.min(at).alias("begins"), F.max(at).alias("_ends"), F.ceil(F.count(F.lit(1)) / most).alias("bins"))
    return s.select("session_id", "begins", (F.floor((F.col("_ends") - F.col("begins")) / F.col("bins")) + 1).alias("width"), "bins")


def violations(directives: DataFrame, events: DataFrame, most: int = 4096) -> DataFrame:
    """Directives joined to the tool calls that break them: after the directive, and not after it was superseded.

    A join of intervals: a session's time is cut into bins, a directive stands in each bin that it is in force in, and a call in its
    own one, so each pair meets once. A long session is the work of as many tasks as it has bins. Within a bin a fence on a plain path meets
    edits of files of that name and shell commands that change something; folders, patterns and exclusive directives meet all
    edits. Calls without a time are after nothing.
    """
    calls = events.where("kind = 'tool_call' AND ts IS NOT NULL").select("session_id", "kind", F.col("seq").alias("e_seq"), F.col("ts").alias("e_ts"), "uuid", "tool", "file_path", "command", "new_string", "edits")
    bins = time_bins(calls, most)
    bin_of = lambda micros: F.floor((micros - F.col("begins")) / F.col("width"))
    last = F.col("bins") - 1
    begin = F.greatest(F.lit(0), bin_of(F.unix_micros(known_time(F.col("ts")))))
    end = F.least(last, F.coalesce(bin_of(F.unix_micros("superseded_at")), last))
    held = directives.join(sorted_side(bins), "session_id").where(begin <= end).withColumn("_bin", F.explode(F.sequence(begin, end))).drop("begins", "width", "bins")
    placed = calls.join(sorted_side(bins), "session_id").withColumn("_bin", bin_of(F.unix_micros("e_ts"))).drop("begins", "width", "bins")
    path, target, command = F.col("path"), blank_if_null(F.col("file_path")), blank_if_null(F.col("command"))
    is_fence, up = F.col("directives_kind") == "fence", bare_path(path)
    open_path = up.endswith("/") | up.contains("*")
    any_edit, shell = F.lit("/edit"), F.lit("/shell")  # no file's name has a slash
    held = held.withColumn("_key", F.explode(F.when(~is_fence, F.array(any_edit)).when(open_path, F.array(any_edit, shell)).otherwise(F.array(base_name(up), shell))))
    placed = placed.withColumn("_key", F.explode(F.when(is_file_edit(), F.array(base_name(target), any_edit)).when((F.col("tool") == "Bash") & rx.matches(command, P.MUTATING), F.array(shell))))
    fence = (is_file_edit() & path_matches(path, target)) | ((F.col("tool") == "Bash") & shell_mutates(command, path))
    other = F.col("tool").isin("Edit", "MultiEdit", "NotebookEdit") & (target != "") & ~path_matches(path, target)
    until = F.col("superseded_at")
    during = (F.col("e_ts") > known_time(F.col("ts"))) & (until.isNull() | (F.col("e_ts") <= until))
    return held.join(sorted_side(placed), ["session_id", "_bin", "_key"]).where(during & F.when(is_fence, fence).otherwise(other)).drop("_bin", "_key")


def broken_directives(events: DataFrame) -> DataFrame:
    return violations(session_directives(events).withColumnRenamed("kind", "directives_kind").withColumn("sentence", trimmed(F.col("sentence"))), events)
