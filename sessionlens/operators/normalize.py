"""Decoded lines to events and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_if_null, parse_time, trimmed
from .predicates import is_real_prompt

TOOL_INPUT = """file_path string, notebook_path string, old_string string, new_string string, new_source string, content string, command string,
replace_all boolean, edits array<struct<old_string: string, new_string: string, replace_all: boolean>>"""
USAGE = "struct<input: bigint, output: bigint, cache_creation: bigint, cache_read: bigint>"


def first_filled(name: str) -> Column:
    """The first value in line order that is not empty."""
    c = blank_if_null(F.col(f"line.{name}"))
    return F.coalesce(F.min_by(F.when(c != "", c), F.when(c != "", F.col("line_no"))), F.lit(""))


def name_sessions(decoded: DataFrame) -> DataFrame:
    """Adds `session_id`: the first id that a file's lines give, else the file's name."""
    ids = decoded.groupBy("session_path").agg(first_filled("sessionId").alias("_id"))
    name = F.regexp_replace(F.regexp_extract("session_path", "([^/]*)$", 1), r"\.[^.]*$", "")
    return decoded.join(ids, "session_path").withColumn("session_id", F.when(F.col("_id") == "", name).otherwise(F.col("_id"))).drop("_id")


def classify(decoded: DataFrame) -> DataFrame:
    """Adds `fate`: malformed, sidechain, event, ignored, or unrecognized, by the line's own fields."""
    line = F.col("line")
    kind = blank_if_null(line["type"])
    user = F.when(~line["has_message"], "ignored").when(F.coalesce(line["isCompactSummary"], F.lit(False)), "event").when(F.coalesce(line["isMeta"], F.lit(False)), "ignored").when(line["content"].isin("missing", "other"), "malformed").otherwise("event")
    agent = F.when(~line["has_message"], "ignored").when(line["content"] == "blocks", "event").when(line["content"] == "null", "event").otherwise("malformed")
    system = F.when((line["subtype"] == "compact_boundary") | line["compacts"], "event").otherwise("ignored")
    main = F.when(kind == "user", user).when(kind == "assistant", agent).when(kind == "summary", "event").when(kind == "system", system).otherwise("unrecognized")
    return decoded.withColumn("fate", F.when(line.isNull(), "malformed").when(F.coalesce(line["isSidechain"], F.lit(False)), "sidechain").otherwise(main))


def session_lines(decoded: DataFrame) -> DataFrame:
    """Decoded lines that are not blank, with `session_id` and `fate`."""
    return classify(name_sessions(decoded.where("NOT blank").drop("blank")))


def usage_once(lines: DataFrame) -> DataFrame:
    """`session_id, line_no`: the lines whose usage counts, the first that decodes of each message id (the line's own where empty)."""
    used = lines.where("fate = 'event' AND line.type = 'assistant' AND line.usage IS NOT NULL")
    mid = blank_if_null(F.col("line.message_id"))
    key = F.when(mid == "", blank_if_null(F.col("line.uuid"))).otherwise(mid)
    first = Window.partitionBy("session_id", key).orderBy("line_no")
    return used.withColumn("_n", F.row_number().over(first)).where((F.col("_n") == 1)).select("session_id", "line_no", F.lit(True).alias("counts"))


def flatten(lines: DataFrame) -> DataFrame:
    """Events of classified lines, one row each, numbered by line and block."""
    rows = lines.where("fate = 'event'").join(usage_once(lines), ["session_id", "line_no"], "left")
    line, kind = F.col("line"), F.col("line.type")
    compacts = kind.isin("summary", "system") | (F.coalesce(line["isCompactSummary"], F.lit(False)) & (kind == "user"))
    as_block = lambda t, text: F.struct(F.lit(t).alias("type"), text.alias("text"), *[F.lit(None).cast("string").alias(c) for c in ("id", "name", "input", "tool_use_id")])
    plain = F.when(compacts, F.array(as_block("compaction", F.lit(None).cast("string")))).when(line["content"] == "text", F.array(as_block("text", line["content_text"]))).otherwise(F.coalesce(line["blocks"], F.array().cast(f"array<{'struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string>'}>")))
    kept = F.filter(
        F.transform(plain, lambda b, i: F.struct(i.alias("pos"), b.alias("b"))),
        lambda x: F.when(compacts, True).when(kind == "user", ((x["b"]["type"] == "text") & is_real_prompt(blank_if_null(x["b"]["text"]))) | (x["b"]["type"] == "tool_result")).otherwise(((x["b"]["type"] == "text") & (trimmed(blank_if_null(x["b"]["text"])) != "")) | (x["b"]["type"] == "tool_use")),
    )
    # a line of usage alone still is an event, an empty text
    kept = F.when((F.size(kept) == 0) & F.coalesce("counts", F.lit(False)), F.array(F.struct(F.lit(0).alias("pos"), as_block("text", F.lit("")).alias("b")))).otherwise(kept)
    rows = rows.select("session_id", "session_path", "line_no", "line", "counts", compacts.alias("_compacts"), F.posexplode(kept).alias("nth", "x"))
    b = F.col("x.b")
    rows = rows.withColumn("input", F.from_json(b["input"], TOOL_INPUT))
    call = (b["type"] == "tool_use") & (F.col("line.type") == "assistant")
    event = F.when(F.col("_compacts"), "compaction").when(call, "tool_call").when(b["type"] == "tool_result", "tool_result").when(F.col("line.type") == "user", "prompt").otherwise("assistant_text")
    of_call = lambda c: F.when(call, c)
    i = lambda n: blank_if_null(F.col(f"input.{n}"))
    new = F.when(b["name"] == "Write", i("content")).when((b["name"] == "NotebookEdit") & (i("new_source") != ""), i("new_source")).otherwise(i("new_string"))
    return rows.select(
        "session_id",
        (F.col("line_no").cast("long") * 1_000_000 + F.col("x.pos")).alias("seq"),
        event.alias("kind"),
        parse_time(F.col("line.timestamp")).alias("ts"),
        blank_if_null(F.col("line.uuid")).alias("uuid"),
        blank_if_null(F.col("line.version")).alias("version"),
        F.when(event.isin("prompt", "assistant_text"), blank_if_null(b["text"])).otherwise("").alias("text"),
        of_call(blank_if_null(b["name"])).alias("tool"),
        F.when(call, b["id"]).when(event == "tool_result", b["tool_use_id"]).alias("tool_use_id"),
        of_call(F.when(i("file_path") == "", i("notebook_path")).otherwise(i("file_path"))).alias("file_path"),
        of_call(i("old_string")).alias("old_string"),
        of_call(new).alias("new_string"),
        of_call(F.coalesce("input.replace_all", F.lit(False))).alias("replace_all"),
        of_call(F.col("input.edits")).alias("edits"),
        of_call(F.when(b["name"] == "Bash", i("command")).otherwise("")).alias("command"),
        F.when(F.coalesce("counts", F.lit(False)) & (F.col("nth") == 0), F.col("line.usage")).cast(USAGE).alias("usage"),
    )


def session_rows(lines: DataFrame, events: DataFrame, agent: str = "jsonl") -> DataFrame:
    """A row per session: identity, span, versions, diagnostics and summed usage."""
    version, kind = blank_if_null(F.col("line.version")), blank_if_null(F.col("line.type"))
    odd = lines.where("fate = 'unrecognized'").groupBy("session_id", F.when(kind == "", "(no type)").otherwise(kind).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    odd = odd.groupBy("session_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("t", "n")))).alias("unrecognized"))
    diag = lines.groupBy("session_id").agg(
        F.min("session_path").alias("path"),
        first_filled("cwd").alias("cwd"),
        first_filled("gitBranch").alias("git_branch"),
        F.sort_array(F.collect_set(F.when(version != "", version))).alias("versions"),
        F.count_if(F.col("fate") == "malformed").alias("malformed_lines"),
        F.count_if(F.col("fate") == "sidechain").alias("sidechain_events"),
    )
    sums = [F.coalesce(F.sum(f"usage.{c}"), F.lit(0)).alias(c) for c in ("input", "output", "cache_creation", "cache_read")]
    roll = events.groupBy("session_id").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("events"), F.bool_or(F.col("kind") == "compaction").alias("compacted"), *sums)
    out = diag.join(roll, "session_id", "left").join(odd, "session_id", "left")
    zero = F.lit(0).cast("bigint")
    usage = F.struct(*[F.coalesce(c, zero).alias(c) for c in ("input", "output", "cache_creation", "cache_read")])
    return out.select("session_id", "path", "cwd", "git_branch", F.lit(agent).alias("agent"), "start", "end", "versions", F.coalesce("unrecognized", F.create_map().cast("map<string,bigint>")).alias("unrecognized"), "malformed_lines", "sidechain_events", F.coalesce("compacted", F.lit(False)).alias("compacted"), F.coalesce("events", zero).alias("events"), usage.alias("usage"), F.lit(None).cast("string").alias("error"))
