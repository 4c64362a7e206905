"""Source files of working trees."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import SKIPPED_FOLDERS


def is_scanned(name: str) -> bool:
    """Whether a folder of that name holds sources of its tree; one that starts with a dot does not."""
    return name not in SKIPPED_FOLDERS and (not name.startswith(".") or name == ".")


def list_folder(spark: SparkSession, path: str) -> tuple[list[str], bool]:
    """The folders in a folder, and whether it has files; nothing of one that cannot be listed."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    try:
        found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(hadoop)
    except Exception:  # unreadable, or gone since: such a folder is passed over
        return [], False
    return [f.getPath().toString() for f in found if f.isDirectory()], any(f.isFile() for f in found)


def source_folders(spark: SparkSession, root: str) -> Iterator[str]:
    """Folders with files, level by level; one that is left out is never opened, and so neither is anything below it."""
    level = [root] if is_scanned(root.rstrip("/").rsplit("/", 1)[-1]) else []
    while level:
        after = []
        for path in level:
            below, files = list_folder(spark, path)
            if files:
                yield path
            after += [p for p in below if is_scanned(p.rsplit("/", 1)[-1])]
        level = sorted(after)


def read_sources(spark: SparkSession, root: str) -> DataFrame:
    """`cwd, path, text` of the source files under `root`. Names of folders alone pass the driver; Spark lists and reads their files."""
    bare = root.removeprefix("file://").rstrip("/")
    reader = spark.read.option("pathGlobFilter", "*.{go,py,ts,tsx,js,jsx,mjs,cjs}")
    folders = list(source_folders(spark, root))
    if not folders:
        return spark.createDataFrame([], "cwd string, path string, text string")
    escaped = [f.replace("\\", "\\\\").translate({ord(c): f"\\{c}" for c in "*?[]{}"}) for f in folders]
    files = reader.text(escaped, wholetext=True)
    return files.select(F.lit(bare).alias("cwd"), F.url_decode(F.replace(F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/"), F.lit("+"), F.lit("%2B"))).alias("path"), F.col("value").alias("text"))
