"""Prefix tries of conversations: shared prefixes become nodes, with rollups over their subtrees.

A node is known by its smallest member and its depth. Nodes of one path that have the same members form a run, and
tries are built of runs. A run that at most `light` conversations share heads a shard: tasks build its trie as
a level-order unary bitvector (LOUDS) with a label array, and roll it up in reverse level order. What more share is
the upper part; every shard and every upper run hands its sums to the runs above it, along its smallest member's path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

ROOT = bytes(16)
#: Rows of a table that may be broadcast; beyond it joins go by salted keys.
SMALL = 100_000
SALTS = 16
#: Members whose ids one piece of a node's list may hold.
PIECE = 512
RUN = ["m", "n"]


def borrowed(conv: Column, turns: int) -> Column:
    """How many turns conversation `conv` takes from the first of its hundred."""
    return F.crc32(conv.cast("string").cast("binary")) % turns


def rebuilt_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", hundred: int = 100, most: int = 6) -> DataFrame:
    """`(conv, pos, label, cp)` of conversations rebuilt on the first turns of their hundred; a row with pos -1 for each.

    The label is a digest of role and text, `cp` the text's code points. Turns go by number, null first, ties by label.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    label = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("_turn"), label.alias("label"), F.length(text).cast("long").alias("cp"))
    in_order = Window.partitionBy("conv").orderBy(F.col("_turn").asc_nulls_first(), "label")
    own = materialize(rows.withColumn("pos", F.row_number().over(in_order) - 1).select("conv", "pos", "label", "cp"), "turns")
    convs = own.where("pos = 0").select("conv", borrowed(F.col("conv"), most).alias("h"))
    heads = own.where((F.col("conv") % hundred == 0) & (F.col("pos") < most)).withColumnRenamed("conv", "base")  # a few rows a hundred
    taken = convs.withColumn("base", F.col("conv") - F.col("conv") % hundred).join(heads, "base").where("pos < h").select("conv", "pos", "label", "cp")
    kept = own.where(F.col("pos") >= borrowed(F.col("conv"), most))
    starts = convs.select("conv", F.lit(-1).alias("pos"), F.lit(None).cast("binary").alias("label"), F.lit(0).cast("long").alias("cp"))
    return starts.unionByName(taken).unionByName(kept)


def member_nodes(rebuilt: DataFrame) -> DataFrame:
    """`(conv, depth, node, parent, cp, ends)`: the nodes on each conversation's path, by chained digests.

    Tasks read turns in order and keep one digest and one turn at a time, so no conversation is held whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last turn seen; whether its conversation ends is known with the next one
        for b in batches:
            out = []
            for conv, pos, label, cp in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held is not None:
                    out.append((*held, pos < 0))
                held = (conv, 0, ROOT, None, 0) if pos < 0 else (conv, held[1] + 1, hashlib.blake2b(held[2] + label, digest_size=16).digest(), held[2], cp)
            if out:
                yield packed(out)
        if held is not None:
            yield packed([(*held, True)])

    def packed(out: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["conv", "depth", "node", "parent", "cp", "ends"])

    rows = rebuilt.select("conv", "pos", "label", "cp").repartition("conv").sortWithinPartitions("conv", "pos")
    return rows.mapInArrow(run, "conv long, depth int, node binary, parent binary, cp long, ends boolean")


def louds(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Level order of a forest, its LOUDS bits, and where each level starts. `parent` holds row numbers, -1 for roots.

    The bits have a one for each root and a zero, then in level order a one for each child of a node and a zero.
    """
    by_parent = np.argsort(parent, kind="stable")
    first = np.searchsorted(parent[by_parent], np.arange(-1, len(parent) + 1))  # of the children of row i - 1
    order, starts, level = [], [0], by_parent[: first[1]]
    while len(level):
        order.append(level)
        starts.append(starts[-1] + len(level))
        begin, n = first[level + 1], first[level + 2] - first[level + 1]
        level = by_parent[np.repeat(begin - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
    order = np.concatenate(order) if order else np.zeros(0, np.int64)
    degree = np.concatenate(([first[1]], first[order + 2] - first[order + 1]))
    bits = np.ones(degree.sum() + len(degree), np.uint8)
    bits[np.cumsum(degree + 1) - 1] = 0
    return order, bits, np.array(starts)


def rolled_up(bits: np.ndarray, starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of `values` (nodes in level order x columns) over subtrees, level by level from the last."""
    parent = np.cumsum(bits == 0)[bits == 1] - 1  # rank of zeros before the i-th one: its parent, -1 for roots
    total = values.copy()
    for lo, hi in zip(starts[-2:0:-1], starts[:1:-1], strict=True):
        np.add.at(total, parent[lo:hi], total[lo:hi])
    return total


def shard_sums(runs: DataFrame) -> DataFrame:
    """`(m, n, top, leaves, saved, heads)` of light runs: sums over the subtree of each; `heads` marks those without a parent in their shard.

    `runs` has `shard, m, n, pm, pn, top, leaves, saved`. A shard's rows come together and in order of depth; a
    task builds one forest of the shards that a batch completes.
    """

    def forest(b: pa.Table) -> pa.RecordBatch:
        m, n, pm, pn = (b.column(c).to_numpy() for c in ("m", "n", "pm", "pn"))
        number = {k: i for i, k in enumerate(zip(m.tolist(), n.tolist(), strict=True))}
        parent = np.fromiter((number.get(k, -1) for k in zip(pm.tolist(), pn.tolist(), strict=True)), np.int64, len(m))
        order, bits, starts = louds(parent)
        labels = np.stack([m[order], n[order]])  # the label array, in level order
        sums = rolled_up(bits, starts, np.stack([b.column("leaves").to_numpy()[order], b.column("saved").to_numpy()[order]], axis=1))
        return pa.RecordBatch.from_pydict({"m": labels[0], "n": labels[1], "top": b.column("top").to_numpy()[order], "leaves": sums[:, 0], "saved": sums[:, 1], "heads": parent[order] < 0})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for b in batches:
            if not len(b):
                continue
            last = b.column(0)[len(b) - 1].as_py()
            same = np.array([x == last for x in b.column(0).to_pylist()])
            begin = int(np.argmax(same))  # rows before it belong to shards that are complete
            if begin or (kept and kept[-1].column(0)[0].as_py() != last):
                yield forest(pa.Table.from_batches([*kept, b.slice(0, begin)]))
                kept = []
            kept.append(b.slice(begin))
        if kept:
            yield forest(pa.Table.from_batches(kept))

    rows = runs.select("shard", "m", "n", "pm", "pn", "top", "leaves", "saved").repartition("shard").sortWithinPartitions("shard", "top", "m")
    return rows.mapInArrow(run, "m long, n long, top int, leaves long, saved long, heads boolean")


def beside(rows: DataFrame, few: DataFrame, key: str, size: int, spread: str) -> DataFrame:
    """`rows` left-joined to `few`, of `size` rows with distinct keys: broadcast up to `SMALL`, else by salted keys."""
    if size <= SMALL:
        return rows.join(F.broadcast(few), key, "left")
    salted = few.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return rows.withColumn("_salt", F.pmod(F.hash(spread), F.lit(SALTS))).join(salted, [key, "_salt"], "left").drop("_salt")


def end_digests(members: DataFrame) -> DataFrame:
    """`(node, ends_sha256)` of nodes where conversations end: SHA-256 of their ids, ascending, comma-joined.

    Ids meet in pieces of at most `PIECE`, of neighbouring numbers. A node of one piece is hashed as it is; pieces of
    the others pass through one running hash, in order, and none is held with the rest.
    """
    ends = members.where("ends").groupBy("node", F.floor(F.col("conv") / PIECE).alias("at")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    ends = materialize(ends, "ends")
    several = ends.groupBy("node").agg(F.count(F.lit(1)).alias("pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, hashlib.sha256()
        for b in batches:
            out = []
            for of, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if of != node:
                    if node is not None:
                        out.append((node, state.hexdigest()))
                    node, state = of, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pydict({"node": pa.array([x for x, _ in out], pa.binary()), "ends_sha256": pa.array([x for _, x in out], pa.string())})
        if node is not None:
            yield pa.RecordBatch.from_pydict({"node": pa.array([node], pa.binary()), "ends_sha256": [state.hexdigest()]})

    one = ends.join(several.where("pieces = 1"), "node").select("node", F.sha2("ids", 256).alias("ends_sha256"))
    more = ends.join(several.where("pieces > 1"), "node", "left_semi").repartition("node").sortWithinPartitions("node", "at").select("node", "ids")
    return one.unionByName(more.mapInArrow(run, "node binary, ends_sha256 string"))


def conversation_trie(turns: DataFrame, light: int = 2048, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per node of the trie of rebuilt conversations: `conv_id` (smallest member), `depth`, `parent_conv_id`, `n_convs`, `n_children`, `n_leaves`, `saved_tokens`, `ends_sha256`.

    A run of more than `light` members belongs to the upper part. A shard holds at most 2 * light runs, whatever
    the length of its conversations. Null roles and texts are empty; turns with equal numbers go by a digest of role and text,
    so rows that repeat are turns of their own. Rows with a null id are of no conversation. An empty table has
    no trie and gives no rows; other columns are ignored.
    """
    members = materialize(member_nodes(rebuilt_turns(turns, conv_col, turn_col, role_col, text_col)), "members")
    nodes = materialize(members.groupBy("node").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.count(F.lit(1)).alias("n"), F.min("conv").alias("m"), F.min("cp").alias("cp")), "nodes")
    upper = materialize(nodes.where(F.col("n") > light).select("node", F.col("m").alias("um"), F.col("n").alias("un")), "upper")
    n_upper = upper.count()
    on_path = materialize(beside(members.select("conv", "depth", "node"), upper, "node", n_upper, "conv"), "paths")
    above = on_path.where("um IS NOT NULL").groupBy("conv", "um", "un").agg(F.max("depth").alias("bottom"))
    shards = on_path.where("um IS NULL").groupBy("conv").agg(F.min(F.struct("depth", "node")).alias("_s")).select(F.col("conv").alias("m"), F.col("_s.node").alias("shard"))

    # Runs, each with the run above it: parents in the upper part are few, or salted; the others have at most `light` children.
    runs = materialize(nodes.groupBy(*RUN).agg(F.min(F.struct("depth", "parent")).alias("_top"), F.max("depth").alias("bottom"), F.sum("cp").alias("w")).select(*RUN, F.col("_top.depth").alias("top"), F.col("_top.parent").alias("node"), "bottom", "w"), "runs")
    under = beside(runs, upper, "node", n_upper, "m")
    lower = nodes.where(F.col("n") <= light).select("node", F.col("m").alias("pm"), F.col("n").alias("pn"))
    tree = under.where("um IS NOT NULL OR node IS NULL").withColumnsRenamed({"um": "pm", "un": "pn"}).unionByName(under.where("um IS NULL AND node IS NOT NULL").drop("um", "un").join(lower, "node")).drop("node")
    tree = materialize(tree, "tree")
    kids = tree.where("pm IS NOT NULL").groupBy(F.col("pm").alias("m"), F.col("pn").alias("n")).agg(F.count(F.lit(1)).alias("kids"), F.count_if(F.col("n") == 1).alias("single"))
    kids_n = F.coalesce("kids", F.lit(0)).cast("long")
    leaves = F.coalesce("single", F.lit(0)) + F.when(kids_n == 0, 1).otherwise(0)
    shared = materialize(tree.where("n > 1").join(kids, RUN, "left").select(*RUN, "top", "bottom", "pm", "pn", kids_n.alias("kids"), leaves.cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("w")).alias("saved")), "shared")

    light_sums = materialize(shard_sums(shared.where(F.col("n") <= light).join(shards, "m").withColumns({"pm": F.coalesce("pm", F.lit(-1)), "pn": F.coalesce("pn", F.lit(-1))})), "light")
    heavy = shared.where(F.col("n") > light).select(*RUN, "top", "leaves", "saved")
    given = light_sums.where("heads").select(F.col("m").alias("conv"), "top", "leaves", "saved").unionByName(heavy.select(F.col("m").alias("conv"), "top", "leaves", "saved"))
    from_below = given.join(above, "conv").where(F.col("bottom") < F.col("top")).select(F.col("um").alias("m"), F.col("un").alias("n"), "leaves", "saved")
    upper_sums = heavy.select(*RUN, "leaves", "saved").unionByName(from_below).groupBy(*RUN).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    sums = light_sums.select(*RUN, "leaves", "saved").unionByName(upper_sums)

    about = shared.select(*RUN, "kids").join(sums, RUN)
    alone = nodes.where("n = 1").join(tree.where("n = 1").select(*RUN, "top", "bottom", "pm"), RUN)
    zero = F.lit(0).cast("long")
    alone = alone.select("node", "m", "n", "depth", "top", "pm", F.when(F.col("depth") < F.col("bottom"), 1).otherwise(0).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"))
    many = nodes.where("n > 1").join(shared.select(*RUN, "top", "bottom", "pm"), RUN).join(about, RUN)
    before = F.sum((F.col("n") - 1) * F.col("cp")).over(Window.partitionBy(*RUN).orderBy("depth").rowsBetween(Window.unboundedPreceding, -1))
    many = many.select("node", "m", "n", "depth", "top", "pm", F.when(F.col("depth") < F.col("bottom"), 1).otherwise(F.col("kids")).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("saved") - F.coalesce(before, zero)).alias("saved_tokens"))
    out = alone.unionByName(many).join(end_digests(members), "node", "left")
    return out.select(
        F.col("m").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.when(F.col("depth") == F.col("top"), F.col("pm")).otherwise(F.col("m")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
