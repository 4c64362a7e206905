"""Filter interaction audit: what five filters remove in every order, from a histogram of failure masks."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

#: Bit i of a mask is set when the filter of letter i fails.
FILTERS = "ABCDE"
#: The signs that filter D looks for.
SIGNS = r"[#\$%&\*\|]"


def text_mask(text: Column) -> Column:
    """The bits A to D of a text: few words, repeated words, capitals, signs."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    fails = [n < 100, 100 * distinct < 80 * n, 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text), text.rlike(SIGNS)]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def mask_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """`(part, mask, n, good, toxic)`: documents of each failure mask, at most 32 a part.

    Bit E needs the smallest id of each text. Texts travel as digests, and rows of one digest shrink to one for each
    part, label and mask with its own smallest id before they meet, so a text that a third of all rows share is no
    task's alone. `_ties` counts the rows that hold that smallest id: they are the only ones of the text that pass E.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_mask(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("_digest"))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    false = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    kind = ["_digest", "part", "mask", "good", "toxic"]
    rows = rows.join(known, "_id", "left").select("_id", *kind[:3], false("good"), false("toxic"))
    by_id = rows.groupBy("_id", *kind).agg(F.count(F.lit(1)).alias("n"))
    nameless = F.sum(F.when(F.col("_id").isNull(), F.col("n")).otherwise(0))
    least = F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", "n")))
    by_text = by_id.groupBy(*kind).agg(F.sum("n").alias("n"), nameless.alias("_nameless"), least.alias("_least"))
    first = F.min("_least._id").over(Window.partitionBy("_digest"))  # a row for each part, label and mask of a text
    ties = F.col("_nameless") + F.when(F.col("_least._id") == first, F.col("_least.n")).otherwise(0)
    by_text = by_text.withColumn("_ties", ties)
    repeat = 1 << FILTERS.index("E")
    both = F.explode(F.array(F.struct(F.col("mask"), F.col("_ties").alias("n")), F.struct((F.col("mask") + repeat).alias("mask"), (F.col("n") - F.col("_ties")).alias("n"))))
    cells = by_text.select("part", "good", "toxic", both.alias("_c")).select("part", "good", "toxic", "_c.mask", "_c.n")
    count = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), count("good"), count("toxic"))


def order_steps() -> list[tuple[str, int, int, int]]:
    """`(filter_order, step, bit, before)` of every step of every order: its filter's bit, and those of the filters before it."""
    out = []
    for order in itertools.permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[i] for i in order), 0
        for step, i in enumerate(order, 1):
            out.append((name, step, 1 << i, before))
            before |= 1 << i
    return out


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Per part, order and step: `kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley`.

    The 600 steps read only a part's cells, 32 at most. Null texts count as empty, a null part as the empty one.
    Rows that repeat an id and its text pass E together; a null id is neither smaller nor larger than another, so
    its row always passes E. Of labels that repeat an id the largest counts. An empty table gives no rows; other columns are ignored.
    """
    cells = mask_cells(docs, labels, id_col, text_col, part_col).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    steps = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("bit"), F.lit(m).alias("before")) for o, s, b, m in order_steps()])
    rows = cells.select("part", "cells", F.explode(steps).alias("_s")).select("part", "cells", "_s.*")
    bit, before = F.col("bit"), F.col("before")

    def total(what: str, holds) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(holds(c["mask"]), c[what]).otherwise(0))

    fails, gone = lambda m: m.bitwiseAND(bit) != 0, lambda m: m.bitwiseAND(before) != 0
    here = lambda m: fails(m) & ~gone(m)
    steps = rows.select(
        "part", "filter_order", "step", "bit",
        total("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"), total("n", here).alias("removed"), total("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        total("n", lambda m: m == bit).alias("unique_fails"), total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")
