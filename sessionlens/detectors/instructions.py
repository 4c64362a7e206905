"""Instruction violations: tool calls that touch what a directive fences off."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_name, blank_if_null, quoted, truncate
from ..operators.directives import broken_directives, sorted_side
from ..sources.tables import written
from .base import CONFIDENCE, SEVERITY, Frames, edit_excerpt, evidence, findings, first_few


class Instructions:
    name = "instruction-violation"

    def hits(self, events: DataFrame) -> DataFrame:
        """A row per broken directive: its first action, the ids of all, in log order, and the first five as they are shown."""
        shown = F.when(F.col("tool") == "Bash", F.concat(F.lit("Bash: "), truncate(blank_if_null(F.col("command")), 240))).otherwise(edit_excerpt())
        keys = ["session_id", "seq", "n"]
        about = ["directives_kind", "path", "sentence", "ts", "pre_compaction"]
        broken = written(broken_directives(events).select(*keys, *about, "e_seq", "e_ts", "uuid", "tool", "file_path", shown.alias("content")), "broken")
        act = F.struct("e_seq", F.col("e_ts").alias("ts"), "tool", "file_path")
        all_ = broken.groupBy(*keys).agg(*[F.first(c).alias(c) for c in about], F.min_by(act, "e_seq").alias("first"), F.transform(F.sort_array(F.collect_list(F.struct("e_seq", "uuid"))), lambda x: x["uuid"]).alias("ids"))
        return all_.join(sorted_side(first_few(broken, keys, "e_seq", F.struct(F.col("e_ts").alias("ts"), "content"))), keys)

    def scan(self, frames: Frames) -> DataFrame:
        first = F.col("first")
        verb = F.when(first["tool"] == "Write", "overwrote").when(first["tool"] == "Bash", "ran a mutating shell command on").otherwise("edited")
        file = blank_if_null(first["file_path"])
        target = base_name(F.when(file == "", F.col("path")).otherwise(file))
        many = F.when(F.size("ids") > 1, F.concat(F.lit(" ("), F.size("ids").cast("string"), F.lit(" actions)"))).otherwise("")
        late = F.when(F.col("pre_compaction"), " (said before the context was compacted, so less certain)").otherwise("")
        sure = F.when((F.col("directives_kind") == "exclusive") | (first["tool"] == "Bash"), CONFIDENCE["medium"]).otherwise(CONFIDENCE["high"])
        actions = F.transform("few", lambda a: evidence("agent action", a["ts"], a["content"]))
        out = self.hits(frames.events).select(
            "session_id",
            F.lit(SEVERITY["violation"]).alias("severity"),
            F.greatest(F.lit(0), sure - F.col("pre_compaction").cast("int")).alias("confidence"),
            first["ts"].alias("ts"),
            F.concat(F.lit("You said: "), quoted(truncate(F.col("sentence"), 100))).alias("title"),
            F.concat(F.lit("Agent "), verb, F.lit(" "), target, many, late).alias("detail"),
            F.lit(0).alias("tokens_est"),
            F.concat(F.array(evidence("your directive", F.col("ts"), truncate(F.col("sentence"), 400))), actions).alias("evidence"),
            F.col("ids").alias("event_uuids"),
            F.concat(F.lpad(F.col("seq").cast("string"), 20, "0"), F.lpad(F.col("n").cast("string"), 20, "0")).alias("emit_key"),
        )
        return findings(out, self.name)
