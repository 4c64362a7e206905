"""An extension: findings of sessions while their logs still arrive.

Log files stream in; each micro-batch names the sessions it touched, whose logs are read and judged again whole,
since every detector looks back over a session. Results replace the earlier ones of the same sessions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.report import all_findings
from ..sources.registry import SOURCES


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, files_per_trigger: int = 1000) -> StreamingQuery:
    """Write the findings of every log file under `folder` to `out`, partitioned by batch; a later batch's rows of a session stand."""
    names = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).schema("value string").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"))

    def judge(batch: DataFrame, epoch: int) -> None:
        paths = [r["path"] for r in batch.distinct().collect()]  # files_per_trigger names at most
        if paths:
            frames = SOURCES["jsonl"].load(spark, paths)
            all_findings(frames).withColumn("batch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return names.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
