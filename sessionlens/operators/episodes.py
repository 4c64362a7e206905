"""Edits of a file in runs: episodes, reversals, and the tokens spent meanwhile."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ZERO_TIME, blank_if_null, more_similar
from .predicates import fresh_tokens, is_file_edit


def edit_episodes(events: DataFrame) -> DataFrame:
    """File edits with `episode`: it grows by one whenever the file edit before, in the session, was of another file."""
    stream = Window.partitionBy("session_id").orderBy("seq")
    own = Window.partitionBy("session_id", "file_path").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.lag("file_path").over(stream)
    starts = F.when(before.isNull() | (before != F.col("file_path")), 1).otherwise(0)
    return events.where(is_file_edit()).withColumn("_starts", starts).withColumn("episode", F.sum("_starts").over(own)).withColumn("starts", F.col("_starts") == 1).drop("_starts")


def fragments(edits: DataFrame) -> DataFrame:
    """`session_id, file_path, seq, pos, old, new`: an edit's replacements, one row each."""
    one = F.array(F.struct(F.col("old_string"), F.col("new_string"), F.col("replace_all")))
    parts = F.when(F.coalesce(F.size("edits"), F.lit(0)) > 0, F.col("edits")).otherwise(one)
    rows = edits.select("session_id", "file_path", "seq", F.posexplode(parts).alias("pos", "e"))
    return rows.select("session_id", "file_path", "seq", "pos", blank_if_null(F.col("e.old_string")).alias("old"), blank_if_null(F.col("e.new_string")).alias("new"))


def first_reversals(edits: DataFrame, least_bytes: int = 24, alike: float = 0.9) -> DataFrame:
    """`session_id, file_path, orig_seq, undo_seq`: the first later edit of a file that takes back an earlier one.

    It must replace exactly what the earlier one wrote, which is the join key, by what that had replaced, or by
    something like it. Of equal fragments only those of the first two edits can be the earlier side, so a
    fragment repeated very often pairs with few.
    """
    f = fragments(edits)
    again = Window.partitionBy("session_id", "file_path", "old", "new").orderBy("seq")
    earlier = f.withColumn("_nth", F.dense_rank().over(again)).where(F.col("_nth") <= 2).select("session_id", "file_path", F.col("seq").alias("i_seq"), F.col("pos").alias("i_pos"), F.col("old").alias("i_old"), F.col("new").alias("key"))
    later = f.where("old <> ''").select("session_id", "file_path", F.col("seq").alias("j_seq"), F.col("pos").alias("j_pos"), F.col("old").alias("key"), F.col("new").alias("j_new"))
    exact = F.col("j_new") == F.col("i_old")
    near = (F.octet_length("j_new") >= least_bytes) & (F.octet_length("i_old") >= least_bytes) & more_similar(F.col("j_new"), F.col("i_old"), alike)
    pairs = later.join(earlier, ["session_id", "file_path", "key"]).where((F.col("i_seq") < F.col("j_seq")) & (exact | near))
    first = F.min(F.struct("j_seq", "j_pos", "i_seq", "i_pos")).alias("m")
    return pairs.groupBy("session_id", "file_path").agg(first).select("session_id", "file_path", F.col("m.i_seq").alias("orig_seq"), F.col("m.j_seq").alias("undo_seq"))


def tokens_between(events: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """`session_id, <key>, tokens_est`: fresh tokens of the session from `first_ts` to `last_ts` of each row of `spans`, ends included.

    Running sums at both ends are subtracted, in one ordered pass over a session instead of a join by range.
    Events without a time do not count; a span without a first time starts at the beginning.
    """
    zero = F.to_timestamp(F.lit(ZERO_TIME))
    mark = lambda ts, order, **cols: spans.select("session_id", F.col(key), ts.alias("ts"), F.lit(order).alias("o"), F.lit(0).cast("long").alias("fresh"))
    opens, closes = mark(F.coalesce("first_ts", zero), 0), mark(F.coalesce("last_ts", zero), 2)
    used = events.where("usage IS NOT NULL AND ts IS NOT NULL").select("session_id", F.lit(None).cast(spans.schema[key].dataType).alias(key), "ts", F.lit(1).alias("o"), fresh_tokens(F.col("usage")).alias("fresh"))
    run = Window.partitionBy("session_id").orderBy("ts", "o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = opens.unionByName(used).unionByName(closes).withColumn("upto", F.sum("fresh").over(run)).where(F.col("o") != 1)
    at = lambda o: F.max(F.when(F.col("o") == o, F.col("upto")))
    return summed.groupBy("session_id", key).agg(F.greatest(at(2) - at(0), F.lit(0)).alias("tokens_est"))
