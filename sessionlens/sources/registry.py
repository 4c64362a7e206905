"""Sources of sessions by name. A source lists sessions and loads them; new ones register themselves."""

from __future__ import annotations

from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..detectors.base import EVENTS, Frames
from ..operators import normalize
from ..operators.predicates import is_real_prompt
from . import kv, lines


class Source(Protocol):
    name: str
    experimental: bool

    def list(self, spark: SparkSession, root: str, cwd: str | None) -> DataFrame: ...

    def load(self, spark: SparkSession, paths: str | list[str]) -> Frames: ...

    def first_prompts(self, spark: SparkSession, paths: list[str]) -> DataFrame: ...


class JsonLines:
    name, experimental = "jsonl", False

    def list(self, spark: SparkSession, root: str, cwd: str | None = None) -> DataFrame:
        return lines.list_sessions(spark, root, cwd)

    def load(self, spark: SparkSession, paths: str | list[str]) -> Frames:
        decoded = normalize.session_lines(lines.read_decoded(spark, paths))
        events = normalize.flatten(decoded)
        return Frames(events, normalize.session_rows(decoded, events, self.name))

    def first_prompts(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        return lines.first_prompts(lines.read_decoded(spark, paths)).withColumnRenamed("session_path", "path")


class ChatStore:
    name, experimental = "kvdb", True

    def list(self, spark: SparkSession, root: str, cwd: str | None = None) -> DataFrame:
        return kv.list_workspaces(spark, root, cwd)

    def load(self, spark: SparkSession, paths: str | list[str]) -> Frames:
        files = spark.read.format("binaryFile").load(paths)
        items = kv.read_items(files)
        rows = kv.chat_events(items)
        shape = spark.createDataFrame([], EVENTS).schema
        events = rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in shape])
        odd = kv.chat_turns(items).where("odd IS NOT NULL").groupBy("path", "odd").count().groupBy(F.col("path").alias("session_id")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("odd", "count")))).alias("unrecognized"))
        roll = rows.groupBy("session_id").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("events"))
        zero = F.lit(0).cast("bigint")
        usage = F.struct(*[zero.alias(c) for c in ("input", "output", "cache_creation", "cache_read")])
        both = files.select(F.col("path").alias("session_id")).join(roll.join(odd, "session_id", "full").withColumn("_read", F.lit(True)), "session_id", "left")
        error = F.when(F.col("_read").isNull(), "the store holds no chat that can be read")
        sessions = both.select("session_id", F.col("session_id").alias("path"), F.lit("").alias("cwd"), F.lit("").alias("git_branch"), F.lit(self.name).alias("agent"), "start", "end", F.array().cast("array<string>").alias("versions"), F.coalesce("unrecognized", F.create_map().cast("map<string,bigint>")).alias("unrecognized"), zero.alias("malformed_lines"), zero.alias("sidechain_events"), F.lit(False).alias("compacted"), F.coalesce("events", zero).alias("events"), usage.alias("usage"), error.alias("error"))
        return Frames(events, sessions)

    def first_prompts(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        rows = self.load(spark, paths).events.where("kind = 'prompt'").where(is_real_prompt(F.col("text")) | F.lit(True))
        return rows.groupBy(F.col("session_id").alias("path")).agg(F.min_by("text", "seq").alias("first_prompt"))


SOURCES: dict[str, Source] = {}


def register(source: Source) -> None:
    SOURCES[source.name] = source


register(JsonLines())
register(ChatStore())


def list_all(spark: SparkSession, roots: dict[str, str], cwd: str | None = None) -> DataFrame:
    """Sessions of all sources, newest first. A source that cannot be listed is passed over unless none can."""
    found, failures = [], []
    for name, root in roots.items():
        try:
            found.append(SOURCES[name].list(spark, root, cwd))
        except Exception as e:  # a missing root is an analysis error of Spark's
            failures.append(e)
    if not found:
        raise FileNotFoundError(f"no sessions found: {failures}")
    return reduce(DataFrame.unionByName, found).orderBy(F.desc("modified"), "path")


def pick_session(listed: DataFrame, id_: str | None = None, agent: str | None = None) -> DataFrame:
    """The row of the newest session, of an exact id, or of a unique prefix of one. Raises if none or several match."""
    rows = listed if agent is None else listed.where(F.col("agent") == agent)
    if not id_:
        got = rows.orderBy(F.desc("modified"), "path").limit(1)
        if not got.head(1):
            raise LookupError("no session found")
        return got
    exact = rows.where(F.col("id") == id_).limit(1)
    if exact.head(1):
        return exact
    near = rows.where(F.col("id").startswith(id_)).limit(2)
    n = len(near.head(2))
    if n != 1:
        raise LookupError(f"session {id_!r} is ambiguous" if n else f"no session {id_!r}")
    return near


def newest(listed: DataFrame, limit: int = 20) -> DataFrame:
    """The `limit` newest sessions, chosen from the listing before any is read."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    return listed.orderBy(F.desc("modified"), "path").limit(limit)


