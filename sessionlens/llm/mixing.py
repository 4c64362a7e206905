"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, word_count

#: Step of the schedule's points: the golden ratio's fraction.
GOLDEN = 0.6180339887498949


@dataclass
class Mix:
    """The mixture.

    `documents`: doc_id, source, size, source_size, target, taken, first_position, slots, copies (an array of epoch,
    position, words: each pass that takes words of the document, and the schedule's position of its first slot), text_hash.
    `schedule`: position, source_no, rank, block, epoch, words.
    """

    documents: DataFrame
    schedule: DataFrame


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """`(source, source_no, source_size, target)`: `share` of all words by weight, capped at `max_epochs` times a source.

    Sources in code-point order, null last, take the weights in turn. What a capped source cannot take goes to
    the others by weight; sorted by cap over weight, the capped ones are a prefix. One row per source only.
    """
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("source_no", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    s = s.withColumn("w", weight).withColumn("cap", F.col("source_size") * max_epochs).withColumn("total", F.lit(share) * F.sum("source_size").over(everything))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "source_no")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(after)
    s = s.withColumn("capped", F.col("cap") / F.col("w") <= level)
    used, free = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything), F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("w"))).over(everything)
    level = (F.col("total") - used) / free
    return s.select("source", "source_no", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("w") * level).alias("target"))


def running_start(rows: DataFrame, key: str, bucket: Column, order: list[Column], size: str, out: str) -> DataFrame:
    """Adds `out`: the sum of `size` over the rows of the key that come before, without one task per key.

    `bucket` must grow with `order`; a key's rows are summed within buckets, and bucket sums within the key.
    """
    rows = rows.withColumn("_bucket", bucket)
    sums = rows.groupBy(key, "_bucket").agg(F.sum(size).alias("_sum"))
    offset = F.coalesce(F.sum("_sum").over(Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = rows.withColumn("_in", F.sum(size).over(inner) - F.col(size)).withColumn("_nth", F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(*order)))
    return inside.join(sums.select(key, "_bucket", offset.alias("_offset")), [key, "_bucket"]).withColumn(out, F.col("_offset") + F.col("_in")).drop("_offset", "_in")


def slot_schedule(sources: DataFrame, slots: int, cells: int = 1024, chunks: int = 4096) -> DataFrame:
    """`(position, source_no, rank)` of every slot that `sources(source_no, need)` calls for.

    Point t is frac((t+1) * GOLDEN), mapped through the cumulative shares of `need` by a join on `cells` equal
    cells and a range check. A source's surplus ranks are left out; ranks it misses follow at the end.
    """
    spark = sources.sparkSession
    upto = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = sources.where("need > 0").withColumn("hi", F.sum("need").over(upto)).withColumn("lo", F.col("hi") - F.col("need"))
    s = s.withColumn("lo", F.col("lo") / F.lit(float(max(slots, 1)))).withColumn("hi", F.col("hi") / F.lit(float(max(slots, 1))))
    spread = s.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)))))
    at = (F.col("id") + 1).cast("double") * F.lit(GOLDEN)
    points = spark.range(slots).withColumn("at", at - F.floor(at)).withColumn("cell", F.floor(F.col("at") * cells))
    hit = points.join(spread, "cell").where("at >= lo AND at < hi").select("id", "source_no", "need", F.lit(1).alias("one"))
    ranked = running_start(hit, "source_no", F.floor(F.col("id") / max(256, -(-slots // chunks))), [F.col("id")], "one", "rank")
    used = ranked.where("rank < need").select(F.col("id").alias("position"), "source_no", "rank")
    got = used.groupBy("source_no").agg(F.count(F.lit(1)).alias("got"))
    missed = s.join(got, "source_no", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < need")
    missed = missed.withColumn("rank", F.explode(F.sequence(F.col("got").cast("long"), F.col("need").cast("long") - 1)))
    return used.unionByName(missed.select((F.lit(slots) + F.col("rank")).alias("position"), "source_no", "rank"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, max_epochs: int = 2, block: int = 256) -> Mix:
    """Mix whole sources: see `source_targets` for the targets and `slot_schedule` for the order.

    A source's documents, shuffled by md5 of the id, form one stream of words cut into blocks of `block`; slot
    rank r of the source takes block r mod blocks in epoch r div blocks, the last slot only the words that are
    left to the target. What a document gives, and where, is read off the slots that hold its blocks: `taken`
    sums its words in them, repeats counted, and each epoch's first slot places that copy. Null or empty
    texts have size 0, take 0 and have no position; a null source is a source of its own; rows that repeat an id
    count one by one; an empty table gives no rows; other columns are ignored.
    """
    md5 = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    sized = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), md5.alias("_h"), text_hash(text_col).alias("text_hash")), "sizes")
    targets = source_targets(sized, weights, share, max_epochs)
    words = F.floor(F.col("target") + 0.5)
    t = targets.withColumn("blocks", F.ceil(F.col("source_size") / block)).withColumn("words", F.least(words, F.col("source_size") * max_epochs))
    t = t.withColumn("rest", F.when(F.col("source_size") > 0, F.col("words") % F.col("source_size")).otherwise(0))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(0)
    t = materialize(t.withColumn("need", (whole * F.col("blocks") + F.ceil(F.col("rest") / block)).cast("long")), "targets")

    of_source = t.select(F.col("source").alias("_source"), "source_no", "source_size", "target")
    numbered = sized.join(of_source, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    order = [F.col("_h"), F.col("doc_id"), F.col("size"), F.col("text_hash")]
    placed = running_start(numbered, "source_no", F.substring("_h", 1, 3), order, "size", "start")

    slots = t.agg(F.sum("need")).first()[0] or 0
    schedule = slot_schedule(t.select("source_no", "need"), slots).join(t.select("source_no", "need", "blocks", "rest", "source_size"), "source_no")
    schedule = schedule.withColumn("block", F.col("rank") % F.col("blocks")).withColumn("epoch", F.floor(F.col("rank") / F.col("blocks")))
    length = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    last = (F.col("rank") == F.col("need") - 1) & (F.col("rest") > 0)
    schedule = schedule.select("position", "source_no", "rank", "block", "epoch", F.when(last, F.col("rest") - F.col("block") * block).otherwise(length).alias("words"))

    key, kept = ["source_no", "_bucket", "_nth"], ["doc_id", "source", "size", "source_size", "target", "text_hash"]
    empty, some = placed.where("size = 0"), placed.where("size > 0")
    pieces = some.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    lo, hi = F.greatest(F.col("start") - F.col("block") * block, F.lit(0)), F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))
    took = F.greatest(F.least(hi, F.coalesce("words", F.lit(0))) - lo, F.lit(0))
    pieces = pieces.join(schedule.select("source_no", "block", "epoch", "position", "words"), ["source_no", "block"], "left").withColumn("took", took)
    used, of = F.col("took") > 0, lambda e: (F.col("took") > 0) & (F.col("epoch") == e)
    sums = [F.sum("took").cast("long").alias("taken"), F.min(F.when(used, F.col("position"))).alias("first_position"), F.count_if(used).alias("slots")]
    passes = [F.struct(F.lit(e).alias("epoch"), F.min(F.when(of(e), F.col("position"))).alias("position"), F.coalesce(F.sum(F.when(of(e), F.col("took"))), F.lit(0)).cast("long").alias("words")) for e in range(max_epochs)]
    each = pieces.groupBy(*key).agg(*[F.first(c).alias(c) for c in kept], *sums, F.filter(F.array(*passes), lambda x: x["words"] > 0).alias("copies"))
    none = empty.withColumns({"taken": F.lit(0).cast("long"), "first_position": F.lit(None).cast("long"), "slots": F.lit(0).cast("long"), "copies": F.array().cast("array<struct<epoch: int, position: bigint, words: bigint>>")})
    cols = [*kept, "taken", "first_position", "slots", "copies"]
    return Mix(each.select(*cols).unionByName(none.select(*cols)), schedule)


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def apply_mix(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` as mixed, in the schedule's order: each pass over a document is a row, at the position of its first slot.

    The last pass may hold only the first words, which are then joined by one space. A document with nothing
    taken goes, one without words stays as it is, ahead of all others. Rows that share id and text share their copies out in turn. Rows are range partitioned by
    position and sorted, so written files keep the order.
    """
    id_key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    copies = mix.documents.where("taken > 0").groupBy(id_key("doc_id").alias("_k"), F.col("text_hash").alias("_t")).agg(F.array_sort(F.flatten(F.collect_list(F.transform("copies", lambda x: F.struct(x["position"].alias("position"), x["words"].alias("words")))))).alias("_copies"), F.count(F.lit(1)).alias("_n"))
    rows = docs.withColumns({"_k": id_key(id_col), "_t": text_hash(text_col), "_size": word_count(F.col(text_col))}).join(copies, ["_k", "_t"], "left")
    rows = rows.withColumn("_i", F.row_number().over(Window.partitionBy("_k", "_t").orderBy("_k")) - 1)
    stays = F.array(F.struct(F.lit(-1).cast("long").alias("position"), F.lit(0).cast("long").alias("words")))
    own = F.when(F.col("_size") == 0, stays).otherwise(F.filter("_copies", lambda x, i: i % F.col("_n") == F.col("_i")))
    out = rows.withColumn("_c", F.explode(own))
    split = F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    text = F.when(F.col("_c.words") >= F.col("_size"), F.col(text_col)).when(F.col("_size") == 0, F.col(text_col)).otherwise(F.array_join(F.slice(split, F.lit(1), F.col("_c.words").cast("int")), " "))
    out = out.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], F.col("_c.position").alias("_position"))
    return out.repartitionByRange("_position", id_col).sortWithinPartitions("_position", id_col).drop("_position")
