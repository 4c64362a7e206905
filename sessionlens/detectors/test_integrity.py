"""Test integrity: edits that weaken tests, and shell commands that delete them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import rx
from ..functions.text import base_name, blank_if_null, truncate
from ..operators.lookback import nearest_before
from ..operators.predicates import both_diffs, is_file_edit, is_test_file, pass_pressure
from ..operators.weakening import reasons
from .base import CONFIDENCE, SEVERITY, Frames, evidence, findings


class TestIntegrity:
    name = "test-integrity"
    __test__ = False

    def weakened(self, events: DataFrame) -> DataFrame:
        """Edits of test files with an old text, with `reasons`; `pressure` is the text of the nearest talk of passing."""
        said = F.col("kind").isin("prompt", "assistant_text") & pass_pressure(blank_if_null(F.col("text")))
        placed = nearest_before(events.withColumn("_said", said), "_said")
        edits = placed.where(is_file_edit() & is_test_file(F.col("file_path"))).withColumns({"old": both_diffs("old_string"), "new": both_diffs("new_string")}).where("old <> ''")
        found = F.explode_outer(F.array(reasons(F.col("old"), F.col("new"))))  # a row each; a plain column would be worked out again in the filter
        edits = edits.withColumn("reasons", found).where(F.size("reasons") > 0)
        texts = events.select("session_id", F.col("seq").alias("near_seq"), F.col("text").alias("pressure"))
        return edits.drop("text").join(texts, ["session_id", "near_seq"], "left")

    def deleted(self, events: DataFrame) -> DataFrame:
        """Shell commands whose first `rm` names a test file."""
        target = F.regexp_extract(blank_if_null(F.col("command")), rx.java(P.REMOVAL), 2)
        return events.where("kind = 'tool_call' AND tool = 'Bash'").withColumn("target", target).where((F.col("target") != "") & is_test_file(F.col("target")))

    def scan(self, frames: Frames) -> DataFrame:
        edits, shell = self.weakened(frames.events), self.deleted(frames.events)
        pressed = F.col("pressure").isNotNull()
        key = F.lpad(F.col("seq").cast("string"), 20, "0").alias("emit_key")
        a = edits.select(
            "session_id",
            F.when(pressed, SEVERITY["violation"]).otherwise(SEVERITY["warning"]).alias("severity"),
            F.lit(CONFIDENCE["high"]).alias("confidence"),
            "ts",
            F.concat(base_name(F.col("file_path")), F.lit(": "), F.array_join("reasons", ", ")).alias("title"),
            F.when(pressed, F.concat(F.lit('near "make the tests pass" context: '), truncate(F.col("pressure"), 120))).otherwise("").alias("detail"),
            F.lit(0).alias("tokens_est"),
            F.array(evidence("removed (old_string)", F.col("ts"), truncate(F.col("old"), 400)), evidence("replacement (new_string)", F.col("ts"), truncate(F.col("new"), 400))).alias("evidence"),
            F.array("uuid").alias("event_uuids"),
            key,
        )
        b = shell.select(
            "session_id",
            F.lit(SEVERITY["violation"]).alias("severity"),
            F.lit(CONFIDENCE["medium"]).alias("confidence"),
            "ts",
            F.concat(base_name(F.col("target")), F.lit(" deleted via shell")).alias("title"),
            F.lit("").alias("detail"),
            F.lit(0).alias("tokens_est"),
            F.array(evidence("bash command", F.col("ts"), truncate(F.col("command"), 400))).alias("evidence"),
            F.array("uuid").alias("event_uuids"),
            key,
        )
        return findings(a.unionByName(b), self.name)
