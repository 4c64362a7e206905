"""Exact deduplication by a tree-merge of sorted digest runs. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: A record's identity: SHA-256, and as verification an independent hash and the length.
KEY = ["_digest", "_check", "_len"]


def digest_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One digest record per row, tagged with its run (input partition) and sorted by digest within it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return materialize(
        docs.select(F.col(id_col).alias("_id"), F.unhex(F.sha2(text, 256)).alias("_digest"), F.xxhash64(text).alias("_check"), F.length(text).cast("long").alias("_len"), F.monotonically_increasing_id().alias("_row"), F.spark_partition_id().alias("_run")).sortWithinPartitions(*KEY),
        "runs",
    )


def tree_merge(runs: DataFrame, keep: str = "min", fan_in: int = 16) -> DataFrame:
    """`(_digest, _check, _len, _keep struct(_id,_row), _n)`: runs merge `fan_in` at a time, in rounds, until one is left.

    In every round run r meets the runs that share r div fan_in; equal records of a merged run shrink to one,
    with the identifier to keep and the number of rows. A hot text thus shrinks to one record a run before
    runs meet. The merged run of a round is spread over tasks by digest.
    """
    pick = F.min if keep == "min" else F.max
    level = runs.groupBy("_run", *KEY).agg(pick(F.struct("_id", "_row")).alias("_keep"), F.count(F.lit(1)).alias("_n"))
    left = (runs.agg(F.max("_run")).first()[0] or 0) + 1
    while left > 1:
        level = level.groupBy(F.floor(F.col("_run") / fan_in).cast("int").alias("_run"), *KEY).agg(pick("_keep").alias("_keep"), F.sum("_n").alias("_n"))
        left = -(-left // fan_in)
    return level.select(*KEY, "_keep", "_n")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """Per row: `doc_id, keep_id, group_size, kept, text_sha256`.

    Texts are equal when identical; null counts as empty. `keep` picks the smallest or largest id of a group;
    null ids sort first. Of rows that repeat id and text, one is kept. Empty input gives no rows; other
    columns of `docs` are ignored.
    """
    runs = digest_runs(docs, id_col, text_col)
    out = runs.drop("_run").join(tree_merge(runs, keep), KEY)
    return out.select(F.col("_id").alias("doc_id"), F.col("_keep._id").alias("keep_id"), F.col("_n").alias("group_size"), (F.col("_row") == F.col("_keep._row")).alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """`docs` with one row of each group of equal texts, all columns as they were."""
    stay = exact_dedup(docs, id_col, text_col, keep).where("kept").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_i"), F.col("text_sha256").alias("_h"))
    keyed = docs.withColumn("_i", F.coalesce(F.col(id_col).cast("string"), F.lit(""))).withColumn("_h", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    return keyed.join(stay, ["_i", "_h"], "left_semi").dropDuplicates(["_i", "_h"]).select(*[F.col(f"`{c}`") for c in docs.columns])
