"""Session logs made from the test tables, for the queries over them. SQL twins of each are in `queries`."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..detectors.base import EVENTS
from ..sources.tables import shared_folder

#: Minutes after this instant are the times of dialogue turns.
BASE = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_events(rows: DataFrame, **cols: Column) -> DataFrame:
    """`rows` as events; columns that are not given are null."""
    shape = rows.sparkSession.createDataFrame([], EVENTS).schema
    return rows.select(*[cols.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in shape])


def usage_of(n: Column) -> Column:
    zero = F.lit(0).cast("bigint")
    return F.struct(n.cast("bigint").alias("input"), zero.alias("output"), zero.alias("cache_creation"), zero.alias("cache_read"))


def edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is an edit: of one of seven files per type, from one of five states to another."""
    e = table(spark, sf_dir, "events")
    state = lambda c: F.concat(F.lit("state number "), c.cast("string"), F.lit(" of the file"))
    id_ = F.col("event_id")
    return as_events(
        e,
        session_id=F.col("user_id").cast("string"),
        seq=F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + id_ % 1000,
        kind=F.lit("tool_call"),
        tool=F.lit("Edit"),
        ts=F.col("ts").cast("timestamp"),
        uuid=id_.cast("string"),
        text=F.lit(""),
        file_path=F.concat(F.lit("/repo/"), "event_type", F.lit("_"), (id_ % 7).cast("string"), F.lit(".go")),
        old_string=state(id_ % 5),
        new_string=state(F.floor(id_ / 5) % 5),
        usage=usage_of(F.floor("value")),
    )


EDITS_SQL = """edits AS (SELECT user_id::varchar AS session_id, epoch_us(ts) * 1000 + event_id % 1000 AS seq, ts, event_id::varchar AS uuid,
  '/repo/' || event_type || '_' || (event_id % 7)::varchar || '.go' AS file_path, 'state number ' || (event_id % 5)::varchar || ' of the file' AS old,
  'state number ' || ((event_id // 5) % 5)::varchar || ' of the file' AS new, floor(value)::bigint AS fresh FROM events)"""


def fenced_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups are prompts that fence a file, errors prompts that reopen it, all else edits."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    said = F.when(kind == "signup", "Do not modify click.yaml. Thanks").when(kind == "error", "Actually, go ahead with click.yaml")
    return as_events(
        e,
        session_id=F.col("user_id").cast("string"),
        seq=F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.col("event_id") % 1000,
        kind=F.when(said.isNull(), "tool_call").otherwise("prompt"),
        tool=F.when(said.isNull(), "Edit"),
        ts=F.col("ts").cast("timestamp"),
        uuid=F.col("event_id").cast("string"),
        text=F.coalesce(said, F.lit("")),
        file_path=F.when(said.isNull(), F.concat(F.lit("/repo/"), kind, F.lit(".yaml"))),
        old_string=F.when(said.isNull(), ""),
        new_string=F.when(said.isNull(), "x"),
    )


FENCED_SQL = """log AS (SELECT user_id::varchar AS session_id, epoch_us(ts) * 1000 + event_id % 1000 AS seq, ts, event_type,
  CASE event_type WHEN 'signup' THEN 'Do not modify click.yaml. Thanks' WHEN 'error' THEN 'Actually, go ahead with click.yaml' END AS text FROM events)"""


def dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations: users' turns are prompts, assistants' texts, others compactions; a minute a turn."""
    c = table(spark, sf_dir, "conversations")
    role = F.col("role")
    return as_events(
        c,
        session_id=F.col("conv_id").cast("string"),
        seq=F.col("turn"),
        kind=F.when(role == "user", "prompt").when(role == "assistant", "assistant_text").otherwise("compaction"),
        ts=F.to_timestamp(F.lit(BASE)) + F.make_dt_interval(mins=F.col("turn").cast("int")),
        uuid=F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")),
        text=F.coalesce("text", F.lit("")),
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as lines of JSON, one log each; systems' turns are of a type that is not known, and each third is cut short."""
    c = table(spark, sf_dir, "conversations")
    message = F.when(F.col("role") == "assistant", F.to_json(F.struct(F.concat_ws(":", F.col("conv_id").cast("string"), F.floor(F.col("turn") / 4).cast("string")).alias("id"), F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content"), F.struct(F.length("text").alias("input_tokens"), (F.col("turn") + 1).alias("output_tokens")).alias("usage")))).otherwise(F.to_json(F.struct(F.col("text").alias("content"))))
    line = F.concat(F.lit('{"type":"'), "role", F.lit('","version":"2.'), (F.col("turn") % 3).cast("string"), F.lit('.7","uuid":"'), F.col("turn").cast("string"), F.lit('","message":'), message, F.when((F.col("role") == "system") & (F.col("conv_id") % 3 == 0), "").otherwise("}"))
    return c.select(F.concat(F.lit("/logs/"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("session_path"), F.col("turn").cast("int").alias("line_no"), line.alias("value"))


def log_files(spark: SparkSession, sf_dir: str) -> str:
    """Conversations as log files in the shared folder, 64 a file, and their folder: prompts, answers with a tool call, results of tools, lines of subagents and summaries, blank lines."""
    c = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    id_, turn, text = F.col("conv_id"), F.col("turn"), F.coalesce("text", F.lit(""))
    log = F.floor(id_ / 64)
    own = lambda *fields: F.to_json(F.struct(*fields))
    block = lambda kind, **cols: F.to_json(F.struct(F.lit(kind).alias("type"), *[v.alias(k) for k, v in cols.items()]))
    edit = own(F.concat(F.lit("/repo/"), turn.cast("string"), F.lit(".py")).alias("file_path"), F.lit("old").alias("old_string"), text.alias("new_string"))
    call = F.concat(F.lit('{"type":"tool_use","id":"t","name":"Edit","input":'), edit, F.lit("}"))
    blocks = lambda *b: F.concat(F.lit('{"content":['), *[x for y in b for x in (y, F.lit(","))][:-1], F.lit("]}"))
    user = F.when(turn % 4 == 2, blocks(block("tool_result", tool_use_id=F.lit("t")), block("text", text=text))).otherwise(own(text.alias("content")))
    message = F.when(F.col("role") == "assistant", blocks(block("text", text=text), call, block("thinking", text=text))).otherwise(user)
    kind = F.when(F.col("role") == "system", "summary").otherwise(F.col("role"))
    line = F.concat(F.lit('{"type":"'), kind, F.lit('","sessionId":"log'), log.cast("string"), F.lit('","uuid":"'), id_.cast("string"), F.lit(":"), turn.cast("string"), F.lit('","isSidechain":'), (id_ % 5 == 4).cast("string"), F.lit(',"message":'), message, F.lit("}"), F.when(turn % 3 == 1, "\n").otherwise(""))
    folder = f"{shared_folder(spark)}/sessionlens-logs-{uuid.uuid4().hex}"
    rows = c.select(log.alias("log"), "conv_id", "turn", line.alias("value")).repartition("log").sortWithinPartitions("log", "conv_id", "turn", "value")
    rows.select("log", "value").write.partitionBy("log").text(folder)
    return folder
