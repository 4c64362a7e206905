"""Rework loops: files that the agent keeps coming back to, or whose edits it takes back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_name, human_tokens, trimmed
from ..operators.episodes import edit_episodes, first_reversals, tokens_between
from ..sources.tables import written
from .base import CONFIDENCE, SEVERITY, Frames, edit_excerpt, evidence, findings, first_few


class Rework:
    name = "rework-loop"

    def __init__(self, episode_threshold: int = 3):
        self.episode_threshold = episode_threshold

    def loops(self, events: DataFrame) -> DataFrame:
        """A row per file that reaches the threshold or is taken back: its episodes, times, ids of edits and tokens, and the edits that are shown."""
        edits = written(edit_episodes(events).select("session_id", "file_path", "seq", "ts", "tool", "uuid", "episode", "starts", "old_string", "new_string", "replace_all", "edits", edit_excerpt().alias("excerpt")), "edits")
        keys = ["session_id", "file_path"]
        files = edits.groupBy(*keys).agg(
            F.max("episode").alias("episodes"),
            F.min_by("ts", "seq").alias("first_ts"),
            F.max_by("ts", "seq").alias("last_ts"),
            F.transform(F.sort_array(F.collect_list(F.when(F.col("starts"), F.struct("seq", "ts")))), lambda x: F.coalesce(F.date_format(x["ts"], "HH:mm"), F.lit("00:00"))).alias("times"),
            F.transform(F.sort_array(F.collect_list(F.struct("seq", "uuid"))), lambda x: x["uuid"]).alias("ids"),
        )
        files = files.join(first_reversals(edits), keys, "left").where((F.col("episodes") >= self.episode_threshold) | F.col("orig_seq").isNotNull())
        files = written(files, "loops")
        one = F.struct("ts", "tool", "excerpt")
        few = first_few(edits, keys, "seq", one)
        pairs = files.where("orig_seq IS NOT NULL").select(*keys, F.explode(F.array("orig_seq", "undo_seq")).alias("seq"), "orig_seq").join(edits, [*keys, "seq"])
        turns = pairs.groupBy(*keys).agg(F.max(F.when(F.col("seq") == F.col("orig_seq"), one)).alias("orig"), F.max(F.when(F.col("seq") != F.col("orig_seq"), one)).alias("undo"))
        spent = tokens_between(events, files.select(*keys, "first_ts", "last_ts"), "file_path")
        return files.join(few, keys).join(turns, keys, "left").join(spent, keys)

    def scan(self, frames: Frames) -> DataFrame:
        rows = self.loops(frames.events)
        swings = F.col("orig_seq").isNotNull()
        clock = lambda c: F.coalesce(F.date_format(c, "HH:mm"), F.lit("00:00"))
        spent = F.when(F.col("tokens_est") > 0, F.concat(F.lit("est. "), human_tokens(F.col("tokens_est")), F.lit(" tokens on repeated work"))).otherwise("")
        turn = F.concat(F.lit("edit at "), clock(F.col("undo.ts")), F.lit(" reverses the edit at "), clock(F.col("orig.ts")), F.lit(" (A→B→A). "), spent)
        pair = F.array(evidence("original edit", F.col("orig.ts"), F.col("orig.excerpt")), evidence("reverting edit", F.col("undo.ts"), F.col("undo.excerpt")))
        shown = F.transform("few", lambda r, i: evidence(F.concat(F.lit("edit "), (i + 1).cast("string"), F.lit(" ("), r["tool"], F.lit(")")), r["ts"], r["excerpt"]))
        title = F.concat(base_name(F.col("file_path")), F.lit(" rewritten "), F.col("episodes").cast("string"), F.lit("× ("), F.array_join("times", ", "), F.lit(")"))
        out = rows.select(
            "session_id",
            F.when(swings, SEVERITY["warning"]).otherwise(SEVERITY["info"]).alias("severity"),
            F.lit(CONFIDENCE["high"]).alias("confidence"),
            F.col("first_ts").alias("ts"),
            title.alias("title"),
            F.when(swings, trimmed(turn)).otherwise(spent).alias("detail"),
            "tokens_est",
            F.when(swings, pair).otherwise(shown).alias("evidence"),
            F.col("ids").alias("event_uuids"),
            F.col("file_path").alias("emit_key"),
        )
        return findings(out, self.name)
