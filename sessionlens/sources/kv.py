"""Chats kept in an embedded key/value database: one SQLite file per workspace, with a JSON side file.

Files are read by Spark as bytes and opened in memory, so they may lie in any store; no lock is taken and
nothing is written.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import CHAT_KEY, COMPOSER_PREFIX
from ..functions.text import trimmed


def read_items(files: DataFrame, keys: tuple[str, ...] = (CHAT_KEY,), prefixes: tuple[str, ...] = (COMPOSER_PREFIX,)) -> DataFrame:
    """`path, key, value` of the wanted items of each database in `files(path, content)`; what is no database gives none."""
    where = " OR ".join(["key = ?"] * len(keys) + ["key LIKE ?"] * len(prefixes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                db = sqlite3.connect(":memory:")
                try:
                    db.deserialize(content)
                    for key, value in db.execute(f"SELECT key, value FROM ItemTable WHERE {where} ORDER BY key", [*keys, *(p + "%" for p in prefixes)]):
                        out.append((path, key, value.decode("utf-8", "replace") if isinstance(value, bytes) else value))
                except sqlite3.Error:
                    continue
                finally:
                    db.close()
            p, k, v = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.string()), pa.array(k, pa.string()), pa.array(v, pa.string())], ["path", "key", "value"])

    return files.select("path", "content").mapInArrow(run, "path string, key string, value string")


def list_workspaces(spark: SparkSession, root: str, cwd: str | None = None) -> DataFrame:
    """`agent, id, path, modified, size` of the databases under `root` whose side file names `cwd` as their folder, newest first."""
    db = spark.read.format("binaryFile").load(f"{root}/*/state.vscdb").select(F.regexp_replace("path", "/[^/]*$", "").alias("dir"), "path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    side = spark.read.text(f"{root}/*/workspace.json", wholetext=True).select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("dir"), F.get_json_object("value", "$.folder").alias("folder"))
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, "^file:/*", "/"), "(?<=.)/+$", "")
    folder = bare(F.try_url_decode(F.replace(F.coalesce(F.try_parse_url("folder", F.lit("PATH")), F.lit("")), F.lit("+"), F.lit("%2B"))))
    rows = db.withColumn("dir", bare(F.col("dir"))).join(side.withColumn("dir", bare(F.col("dir"))).withColumn("folder", folder), "dir")
    if cwd is not None:
        rows = rows.where(F.col("folder") == cwd.rstrip("/"))
    return rows.select(F.lit("kvdb").alias("agent"), F.regexp_extract("dir", "[^/]*$", 0).alias("id"), "path", "modified", "size").orderBy(F.desc("modified"), "path")


def user_turn(raw: Column) -> Column:
    """A turn's raw type token names the user: the string in any letter case, or the number 1."""
    return F.coalesce((F.lower(raw) == '"user"') | (raw == "1"), F.lit(False))


def chat_turns(items: DataFrame) -> DataFrame:
    """`path, kind, ts, text, odd` of all turns in order `n`; `odd` names the type of a bubble that is neither user nor agent."""
    chats = items.where(F.col("key") == CHAT_KEY).select("path", F.from_json("value", "tabs array<struct<bubbles: array<struct<type: string, text: string>>>>").alias("v"))
    bubbles = chats.select("path", F.posexplode("v.tabs").alias("i", "t")).select("path", "i", F.posexplode("t.bubbles").alias("j", "b"))
    kind = F.when(F.col("b.type") == "user", "prompt").when(F.col("b.type") == "ai", "assistant_text")
    a = bubbles.select("path", F.format_string("0:%010d:%010d", "i", "j").alias("n"), kind.alias("kind"), F.lit(None).cast("timestamp").alias("ts"), F.coalesce("b.text", F.lit("")).alias("text"), F.when(kind.isNull(), F.concat(F.lit("bubble:"), F.coalesce("b.type", F.lit("")))).alias("odd"))
    talk = items.where(F.col("key").ilike(COMPOSER_PREFIX + "%")).select("path", "key", F.from_json("value", "conversation array<string>").alias("v"))
    turns = talk.select("path", "key", F.posexplode("v.conversation").alias("j", "t"))
    who = F.get_json_object("t", "$.type")
    typed = F.when(F.regexp_like("t", F.lit(r'"type"\s*:\s*"')), F.concat(F.lit('"'), who, F.lit('"'))).otherwise(who)
    ms = F.get_json_object("t", "$.timingInfo.clientStartTime").try_cast("bigint")
    b = turns.select("path", F.concat_ws(":", F.lit("1"), "key", F.lpad(F.col("j").cast("string"), 10, "0")).alias("n"), F.when(user_turn(typed), "prompt").otherwise("assistant_text").alias("kind"), F.when(ms > 0, F.timestamp_millis(ms)).alias("ts"), F.coalesce(F.get_json_object("t", "$.text"), F.lit("")).alias("text"), F.lit(None).cast("string").alias("odd"))
    return a.unionByName(b)


def chat_events(items: DataFrame) -> DataFrame:
    """`session_id, seq, kind, ts, text` of turns that have text; the file's own path is the session."""
    from pyspark.sql import Window

    rows = chat_turns(items).where("odd IS NULL").where(trimmed(F.col("text")) != "")
    order = Window.partitionBy("path").orderBy("n")
    return rows.select(F.col("path").alias("session_id"), F.row_number().over(order).cast("long").alias("seq"), "kind", "ts", "text")
