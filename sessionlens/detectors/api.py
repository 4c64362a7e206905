"""Calls of functions that the repository does not define."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.symbols import undefined_calls
from .base import CONFIDENCE, SEVERITY, Frames, edit_excerpt, evidence, findings


class HallucinatedApi:
    name = "hallucinated-api"

    def scan(self, frames: Frames) -> DataFrame:
        """No findings without the files of the working trees."""
        files = frames.files
        if files is None:
            files = frames.events.sparkSession.createDataFrame([], "cwd string, path string, text string")
        go = F.col("language") == "go"
        exported = F.lit("no declaration of this exported name was found; it may not exist, or be declared elsewhere in the package")
        guessed = F.concat(F.lit("neither declared nor imported by name; "), F.col("language"), F.lit(" files are read by patterns, so check before you trust this"))
        out = undefined_calls(frames.events, frames.sessions, files).select(
            "session_id",
            F.lit(SEVERITY["warning"]).alias("severity"),
            F.when(go, CONFIDENCE["medium"]).otherwise(CONFIDENCE["low"]).alias("confidence"),
            "ts",
            F.concat("name", F.lit("(...) is not defined anywhere in the repo")).alias("title"),
            F.when(go, exported).otherwise(guessed).alias("detail"),
            F.lit(0).alias("tokens_est"),
            F.array(evidence("call site", F.col("ts"), edit_excerpt())).alias("evidence"),
            F.array("uuid").alias("event_uuids"),
            F.concat(F.lpad(F.col("seq").cast("string"), 20, "0"), F.lpad(F.col("pos").cast("string"), 10, "0")).alias("emit_key"),
        )
        return findings(out, self.name)
