"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space and the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a table of a few numbers that may be broadcast: a few MB.
SMALL = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint folder that a program has set."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if conf:
        return conf.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sessionlens-"))  # one machine: tests and trials
    return shared_dir(spark)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sessionlens-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def counted(df: DataFrame, name: str, of: Column | None = None) -> tuple[DataFrame, int]:
    """`materialize`, and the number of rows, or of those for which `of` holds, seen as they are written: no job reads them again."""
    seen = Observation()
    out = materialize(df.observe(seen, F.count(F.lit(1) if of is None else F.when(of, 1)).alias("n")), name)
    return out, seen.get["n"]


def discard(df: DataFrame) -> None:
    """Delete a table of `materialize` that nothing reads any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_bucket(id_col: str, buckets: int = 5) -> Column:
    """crc32 of the id as text, modulo `buckets`; null ids go as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(buckets)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, longest: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[tuple[str, int]], dict[int, int]]:
    """Texts and labels to fit a classifier on: up to `most` rows of either class, of at most `longest` code points each.

    Rows of the held-out fifth (`id_bucket` 0) never take part. The rows with the smallest hash of the id are
    taken, so the choice hangs neither on order nor on partitions, and what reaches the driver is bounded by
    2 * most * longest. Also gives the number of labelled rows of each class. Null labels and texts take no part.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).alias("_y"))
    known = known.where(id_bucket("_id") != 0)
    totals = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}  # two rows
    takes = [known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(most) for y in (0, 1)]
    ids = F.broadcast(takes[0].unionByName(takes[1]))  # 2 * most rows at most
    rows = docs.where(F.length(text_col) <= longest).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(ids, "_id")
    got = rows.groupBy("_id").agg(F.max("_text").alias("_text"), F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").collect()
    return [(r["_text"], r["_y"]) for r in got], totals
