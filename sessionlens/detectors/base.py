"""What a detector is, what it gets, and what it gives."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import blank_if_null, trimmed, truncate

EVENTS = """session_id string, seq bigint, kind string, ts timestamp, uuid string, version string, text string, tool string,
tool_use_id string, file_path string, old_string string, new_string string, replace_all boolean,
edits array<struct<old_string: string, new_string: string, replace_all: boolean>>, command string,
usage struct<input: bigint, output: bigint, cache_creation: bigint, cache_read: bigint>"""

EVIDENCE = "array<struct<label: string, ts: timestamp, content: string>>"
FINDINGS = ("session_id", "detector", "severity", "confidence", "ts", "title", "detail", "tokens_est", "evidence", "event_uuids", "emit_key")


@dataclass
class Frames:
    """All sessions at once: `events` (see `EVENTS`), `sessions` (a row each), and `files` (path, text) of their working trees."""

    events: DataFrame
    sessions: DataFrame
    files: DataFrame | None = None


class Detector(Protocol):
    """An extension: a label, and a scan of all sessions that gives `FINDINGS`."""

    name: str

    def scan(self, frames: Frames) -> DataFrame: ...


def findings(df: DataFrame, detector: str) -> DataFrame:
    """`df` as findings of `detector`; severity and confidence are the places of their names in `patterns`."""
    typed = {"severity": "int", "confidence": "int", "tokens_est": "bigint", "evidence": EVIDENCE, "event_uuids": "array<string>", "emit_key": "string"}
    return df.withColumn("detector", F.lit(detector)).select(*[F.col(c).cast(typed[c]).alias(c) if c in typed else F.col(c) for c in FINDINGS])


def evidence(label: Column | str, ts: Column, content: Column) -> Column:
    return F.struct((F.lit(label) if isinstance(label, str) else label).alias("label"), ts.alias("ts"), content.alias("content"))


def edit_excerpt() -> Column:
    """`Tool path: text` of an edit, with the first part of a multi-part one where it has no text of its own."""
    new = blank_if_null(F.col("new_string"))
    text = F.when((new == "") & (F.coalesce(F.size("edits"), F.lit(0)) > 0), blank_if_null(F.try_element_at("edits", F.lit(1))["new_string"])).otherwise(new)
    return F.concat(blank_if_null(F.col("tool")), F.lit(" "), blank_if_null(F.col("file_path")), F.lit(": "), truncate(trimmed(text), 240))


def first_few(rows: DataFrame, keys: list[str], order: str, shown: Column, most: int = 5) -> DataFrame:
    """`few`: what is shown of the first rows of each key, `most` of them. Spark drops the others before it shuffles."""
    ranked = rows.select(*keys, order, shown.alias("_shown")).withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("_nth") <= most)
    return ranked.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_nth", "_shown"))), lambda x: x["_shown"]).alias("few"))


def level(names: tuple[str, ...], name: str) -> int:
    return names.index(name)


SEVERITY = {n: i for i, n in enumerate(P.SEVERITIES)}
CONFIDENCE = {n: i for i, n in enumerate(P.CONFIDENCES)}
