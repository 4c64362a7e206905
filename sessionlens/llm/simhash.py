"""SimHash near-duplicate detection by the generalised pigeonhole principle.

Bits that correlate share a partition of the fingerprint. Two fingerprints within `radius` bits are within the
threshold of at least one partition whenever the thresholds sum to radius - partitions + 1, so every
fingerprint may choose its own: a dynamic program picks those with the least estimated work. It then probes
the partition values within its thresholds, and what it meets is verified on all 64 bits. A partition value that
many fingerprints share is split by the same principle once more, on the bits that are left.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SMALL, counted, materialize
from .graph import connected_components
from .set_join import shingle_set

BITS = 64
#: Work of one probe, which is shuffled and sorted, in candidates, which are compared where they meet.
PROBE = 30
#: Bytes of a sketch: as many minimum hashes, one byte kept of each.
SKETCH = 256
#: Minimum hashes that give a bit each to a node's short sketch, two long integers; unlike sets differ in half of the bits.
SHORT = 128
#: Beyond `SMALL` rows, joins go by keys salted so often.
SALTS = 16
_DRAW = np.random.default_rng(7).integers(1, 1 << 63, SKETCH + 8, dtype=np.uint64) | np.uint64(1)


def majority(h: np.ndarray) -> tuple[np.ndarray, int]:
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64), len(h)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42, distinct: bool = False) -> int:
    """The 64 majority bits of the XXH64 hashes of a text's word shingles; 0 without words.

    `distinct` takes the set of its words instead, so that neither a line that repeats nor an edit in few places weighs much.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: A-Z only, and ASCII white space
    if not words:
        return 0
    if distinct:
        ones, n = majority(np.array([xxhash.xxh64_intdigest(w, seed) for w in set(words)], np.uint64))
        return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])
    whole, size = b" ".join(words), len(words)
    if size < shingle:
        return xxhash.xxh64_intdigest(whole, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, size) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: size - shingle + 1].tolist()
    ends, digest = ends[shingle - 1 :].tolist(), xxhash.xxh64_intdigest
    ones, n = np.zeros(BITS, np.int64), len(starts)
    for at in range(0, n, 32768):
        ones += majority(np.array([digest(whole[s:e], seed) for s, e in zip(starts[at : at + 32768], ends[at : at + 32768], strict=True)], np.uint64))[0]
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def sketch(text: str | None, shingle: int = 5) -> bytes:
    """Minimum hashes of a text's distinct word shingles: two sketches agree in about the texts' Jaccard similarity.

    Fewer words than a shingle are one shingle; no words give zeros.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return bytes(SKETCH)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(shingle, len(h))
    n = len(h) - size + 1
    mixed = sum((h[i : i + n] * _DRAW[SKETCH + i] for i in range(1, size)), h[:n] * _DRAW[SKETCH])
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _DRAW[0]
    mixed ^= mixed >> np.uint64(32)
    least = np.full(SKETCH, ~np.uint64(0))
    for at in range(0, n, 2048):
        least = np.minimum(least, (mixed[at : at + 2048, None] * _DRAW[None, :SKETCH]).min(axis=0))
    return (least >> np.uint64(24)).astype(np.uint8).tobytes()


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def short_set(shingles: np.ndarray) -> bytes:
    """A set by the upper halves of its hashes, sorted."""
    return np.unique((shingles >> np.uint64(32)).astype(np.uint32)).tobytes()


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, sketched: bool = False) -> DataFrame:
    """`(doc_id, fp)`, fp as a signed long; whole texts, null as empty. `sketched`: fp of distinct words, `sk`, the text's sketch, and `digest`, that of its five-word set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {"doc_id": b.column(0), "fp": pa.array([signed(fingerprint(t.as_py(), shingle, distinct=sketched)) for t in b.column(1)], pa.int64())}
            if sketched:
                out["sk"] = pa.array([sketch(t.as_py()) for t in b.column(1)], pa.binary())
                out["digest"] = pa.array([set_digest(shingle_set(t.as_py(), 5)) for t in b.column(1)], pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long" + ", sk binary, digest binary" * sketched)


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j both set: 64 x 64 counts, summed by Spark over all rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((BITS, BITS), np.int64)
        rows = 0
        for f in frames:
            bits = np.unpackbits(f["fp"].to_numpy(np.int64).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).round().astype(np.int64)
            rows += len(f)
        i, j = np.triu_indices(BITS)
        yield pd.DataFrame({"i": np.append(i, -1), "j": np.append(j, -1), "n": np.append(total[i, j], rows)})

    both, rows = np.zeros((BITS, BITS)), 0
    for r in fps.select("fp").mapInPandas(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():  # 2081 rows
        if r.i < 0:
            rows = r.n
        else:
            both[r.i, r.j] = both[r.j, r.i] = r.n
    return rows, both


def correlated_groups(rows: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of nearly equal width; each group takes in turn the bit that correlates most with it."""
    p = np.diag(both) / max(rows, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(rows, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    width, left, groups = -(-BITS // parts), set(range(BITS)), []
    while left:
        rest = sorted(left)
        group = [rest[int(np.argmax(corr[np.ix_(rest, rest)].sum(axis=1)))]]
        while len(group) < width and (rest := sorted(left - set(group))):
            group.append(rest[int(np.argmax(corr[np.ix_(rest, group)].mean(axis=1)))])
        left -= set(group)
        groups.append(sorted(group))
    return groups


def masks_of(groups: list[list[int]]) -> list[int]:
    return [signed(sum(1 << b for b in g)) for g in groups]


def carried(nodes: DataFrame) -> list[str]:
    """The columns that go with a fingerprint: its node, and a short sketch if the nodes have one."""
    return ["node", "fp", *(c for c in ("lo", "hi") if c in nodes.columns)]


def values(nodes: DataFrame, masks: list[int]) -> DataFrame:
    """`(part, key, node, fp)`, with the short sketch: each fingerprint's value in every partition."""
    keys = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    of = carried(nodes)
    return nodes.select(*of, F.explode(keys).alias("k")).select("k.part", "k.key", *of)


def choose_groups(nodes: DataFrame, rows: int, both: np.ndarray, radius: int, most: int = 5) -> list[list[int]]:
    """The partitions with the least work a fingerprint: probes, `PROBE` each, and the candidates that a probe meets.

    Candidates are measured: the sum of squares of a partition's value counts, over all fingerprints. Wider and
    fewer partitions win as fingerprints become many.
    """
    options = [correlated_groups(rows, both, parts) for parts in range(1 if radius == 0 else 2, min(radius + 1, most) + 1)]
    flat = values(nodes, [m for groups in options for m in masks_of(groups)])
    squares = {r.part: float(r.s) for r in flat.groupBy("part", "key").agg(F.count(F.lit(1)).cast("double").alias("n")).groupBy("part").agg(F.sum(F.col("n") * F.col("n")).alias("s")).collect()}  # a row a partition

    def work(at: int, groups: list[list[int]]) -> float:
        spare, out = radius - len(groups) + 1, 0.0
        for i, g in enumerate(groups):
            t = spare // len(groups) + (i >= len(groups) - spare % len(groups))
            balls = sum(math.comb(len(g), r) for r in range(t + 1))
            out += balls * (PROBE + squares[at + i] / rows)
        return out

    firsts = np.cumsum([0, *map(len, options)]).tolist()
    return min(zip(firsts, options, strict=False), key=lambda x: work(*x))[1]


def threshold_plan(bits: np.ndarray, ones: np.ndarray, rows: int, groups: list[list[int]], radius: int, heavy: list[dict[int, int]], keys: np.ndarray) -> np.ndarray:
    """Thresholds (fingerprints x partitions) with the least work, summing to radius - partitions + 1.

    Work of a threshold t on a partition: its probes, `PROBE` each, plus the fingerprints expected within t bits there. That
    estimate is `rows` times the chance of a distance up to t under the bits' frequencies, and at least the
    measured count of the value itself where it is a heavy one.
    """
    n, parts = len(bits), len(groups)
    cost = np.zeros((n, parts, radius + 2))  # threshold -1 at index 0: partition not probed, no cost
    for g, members in enumerate(groups):
        differ = np.where(bits[:, members] == 1, 1 - ones[members], ones[members])
        chance = np.zeros((n, radius + 1))
        chance[:, 0] = 1
        for b in range(len(members)):
            d = differ[:, b : b + 1]
            chance[:, 1:] = chance[:, 1:] * (1 - d) + chance[:, :-1] * d
            chance[:, 0] *= 1 - d[:, 0]
        near = np.cumsum(chance, axis=1) * rows
        if heavy[g]:
            near = np.maximum(near, np.array([heavy[g].get(k, 0) for k in keys[:, g].tolist()])[:, None])
        balls = np.cumsum([math.comb(len(members), r) for r in range(radius + 1)])
        cost[:, g, 1:] = near + balls * PROBE
    total = radius - parts + 1 + parts  # thresholds shifted by one, so that -1 counts as 0
    best = np.full((n, total + 1), np.inf)
    best[:, 0] = 0
    picked = np.zeros((parts, n, total + 1), np.int8)
    for g in range(parts):
        after = np.full_like(best, np.inf)
        for t in range(min(radius + 1, total) + 1):
            tried = best[:, : total + 1 - t] + cost[:, g, t : t + 1]
            better = tried < after[:, t:]
            after[:, t:] = np.where(better, tried, after[:, t:])
            picked[g][:, t:][better] = t
        best = after
    out, left = np.zeros((n, parts), np.int8), np.full(n, total)
    for g in reversed(range(parts)):
        t = picked[g][np.arange(n), left]
        out[:, g], left = t - 1, left - t
    return out


def probes(nodes: DataFrame, rows: int, both: np.ndarray, groups: list[list[int]], radius: int, heavy: list[dict[int, int]]) -> DataFrame:
    """`(part, key, node, fp)`, with the short sketch: the partition values that each fingerprint has to look up."""
    of_node = carried(nodes)
    ones = np.clip(np.diag(both) / max(rows, 1), 1e-6, 1 - 1e-6)
    masks = np.array([sum(1 << b for b in g) for g in groups], np.uint64)

    def flips(members: list[int], t: int) -> np.ndarray:
        return np.array([sum(1 << b for b in c) for r in range(t + 1) for c in itertools.combinations(members, r)], np.uint64)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[tuple[int, int], np.ndarray] = {}
        for whole in frames:
            for at in range(0, len(whole), 4096):
                fp = whole["fp"].to_numpy(np.int64)[at : at + 4096].view(np.uint64)
                rest = {c: whole[c].to_numpy(np.int64)[at : at + 4096] for c in of_node}
                bits = np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                keys = fp[:, None] & masks[None, :]
                plan = threshold_plan(bits, ones, rows, groups, radius, heavy, keys.view(np.int64))
                for g, members in enumerate(groups):
                    for t in range(radius + 1):
                        of = plan[:, g] == t
                        if of.any():
                            if (g, t) not in made:
                                made[g, t] = flips(members, t)
                            key = (keys[of, g][:, None] ^ made[g, t][None, :]).ravel()
                            yield pd.DataFrame({"part": np.full(len(key), g, np.int32), "key": key.view(np.int64)} | {c: np.repeat(x[of], len(made[g, t])) for c, x in rest.items()})

    return nodes.select(*of_node).mapInPandas(run, "part int, key long, " + ", ".join(f"{c} long" for c in of_node))


def short_sketches(nodes: DataFrame) -> DataFrame:
    """`(node, fp, lo, hi)`: a bit of each of the first `SHORT` minimum hashes of `sk`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = np.frombuffer(b"".join(x[:SHORT] for x in b.column(2).to_pylist()), np.uint8).reshape(-1, SHORT) & 1
            longs = np.packbits(bits, axis=1, bitorder="little").view("<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(longs[:, 0]), pa.array(longs[:, 1])], ["node", "fp", "lo", "hi"])

    return nodes.select("node", "fp", "sk").mapInArrow(run, "node long, fp long, lo long, hi long")


def most_differing(similarity: float) -> int:
    """Bits in which short sketches of sets so far alike may differ: the mean and four deviations."""
    p = (1 - similarity) / 2
    return math.floor(SHORT * p + 4 * math.sqrt(SHORT * p * (1 - p)))


def bits_of(rows: pd.DataFrame, short: bool) -> list[np.ndarray]:
    return [rows[c].to_numpy(np.int64).view(np.uint64) for c in ("fp", *(("lo", "hi") if short else ()))]


def short_differ(x: list[np.ndarray], i: int, y: list[np.ndarray]) -> np.ndarray:
    return np.bitwise_count(x[1][i] ^ y[1]).astype(np.int64) + np.bitwise_count(x[2][i] ^ y[2])


def jaccards(one: bytes, others: list[bytes]) -> np.ndarray:
    """Similarity of a set with each of others; sets are sorted hashes of 32 bits, empty ones equal."""
    x = np.frombuffer(one, np.uint32)
    sizes = np.array([len(o) // 4 for o in others])
    flat = np.frombuffer(b"".join(others), np.uint32)
    if not len(x) or not len(flat):
        return (sizes == len(x)).astype(float)
    hit = np.concatenate(([0], np.cumsum(x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat)))
    ends = np.cumsum(sizes)
    both = hit[ends] - hit[ends - sizes]
    return both / (len(x) + sizes - both)


def forest(left: pd.DataFrame, right: pd.DataFrame, radius: int, differ: int | None = None) -> list[tuple[int, int]]:
    """Links of nodes of `left` with nodes of `right` within `radius` bits, and short sketches within `differ` if asked, but only those that join parts not joined yet."""
    if not len(left) or not len(right):
        return []
    a, b = (bits_of(side, differ is not None) for side in (left, right))
    nodes, of = np.unique(np.concatenate([left["node"].to_numpy(np.int64), right["node"].to_numpy(np.int64)]), return_inverse=True)
    of_left, of_right, part, out = of[: len(left)], of[len(left) :], np.arange(len(nodes)), []
    for i, x in enumerate(a[0]):
        own = part[of_left[i]]
        near = np.flatnonzero((np.bitwise_count(x ^ b[0]) <= radius) & (part[of_right] != own))
        if differ is not None and len(near):
            near = near[short_differ(a, i, [y[near] for y in b]) <= differ]
        if len(near):
            met, first = np.unique(part[of_right[near]], return_index=True)
            out += [(int(nodes[of_left[i]]), int(nodes[of_right[y]])) for y in near[first]]
            part[np.isin(part, met)] = own
    return out


def set_forest(rows: pd.DataFrame, radius: int, differ: int, similarity: float) -> list[tuple[int, int]]:
    """Links between rows of equal `root` whose fingerprints, short sketches and, last, sets are so far alike: only those that join parts not joined yet.

    A row meets the rows before it, nearest sketches first; a set is compared while its part is another.
    """
    out = []
    for g in (rows.iloc[at] for at in rows.groupby("root").indices.values()):
        node, bits, sets, part = g["node"].tolist(), bits_of(g, True), g["set"].tolist(), np.arange(len(g))
        sizes = np.array([len(x) for x in sets], np.int64)
        for i in range(1, len(g)):
            before = [x[:i] for x in bits]
            apart = short_differ(bits, i, before)
            fits = np.minimum(sizes[:i], sizes[i]) >= similarity * np.maximum(sizes[:i], sizes[i]) - 1e-6
            near = np.flatnonzero(fits & (apart <= differ) & (np.bitwise_count(bits[0][i] ^ before[0]) <= radius))
            near, size = near[np.argsort(apart[near], kind="stable")], 4
            while len(near):
                some, near = near[:size], near[size:]
                for j in some[jaccards(sets[i], [sets[j] for j in some]) >= similarity].tolist():
                    if part[j] != part[i]:
                        out.append((node[j], node[i]))
                        part[part == part[j]] = part[i]
                near, size = near[part[near] != part[i]], min(2 * size, 1024)
    return out


def alike(links: DataFrame, nodes: DataFrame, radius: int, similarity: float, sets_of: Callable[[DataFrame], DataFrame], block: int = 2048) -> DataFrame:
    """`(a, b)`, with the components of all links of nodes whose five-word sets are alike; `links` join at least all such nodes.

    The components of `links` hold the wanted ones, and a node is in one of them, so its set is carried once however many pairs
    its group has. Small components share a task; those of over `block` nodes are dealt out in blocks, a task for each two of them.
    """
    root = connected_components(links)
    differ, share = most_differing(similarity), 512
    total = root.count()
    sizes = root.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    rows = root.join(sizes, "root").join(nodes, "node").join(sets_of(root.select("node")), "node").select("root", "node", "fp", "lo", "hi", "set", "blocks")
    none = F.lit(0).cast("long")
    small = rows.where("blocks = 1").select("*", F.pmod(F.xxhash64("root"), F.lit(-(-total // share) or 1)).alias("cell"), none.alias("i"), none.alias("j"))
    own = F.pmod(F.xxhash64("node"), "blocks")
    large = rows.where("blocks > 1").select("*", F.col("root").alias("cell"), own.alias("_own"), F.explode(F.sequence(none, F.col("blocks") - 1)).alias("_other")).where("_own <> _other")
    large = large.select(*rows.columns, "cell", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"))

    def linked(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(set_forest(rows, radius, differ, similarity), columns=["a", "b"], dtype="int64")

    found = small.unionByName(large).groupBy("blocks", "cell", "i", "j").applyInPandas(linked, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def sets_from(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, shingle: int = 5) -> Callable[[DataFrame], DataFrame]:
    """A reader of `(node, set)`, the sets of the nodes asked for, from the texts of one row of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(t.as_py(), shingle) for t in b.column(1)]
            keep = pa.array([set_digest(s) == d.as_py() for s, d in zip(found, b.column(2), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([short_set(s) for s in found], pa.binary())], ["node", "set"]).filter(keep)  # an id may have several texts

    def read(wanted: DataFrame) -> DataFrame:
        ids, many = counted(wanted.join(nodes.select("node", F.col("least").alias("_id"), "digest"), "node"), "wanted")
        ids = F.broadcast(ids) if many <= SMALL else ids
        texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
        found = texts.join(ids, "_id").select("node", "text", "digest")
        return materialize(found.mapInArrow(run, "node long, set binary").dropDuplicates(["node"]), "sets")

    return read


def marked(rows: DataFrame, marks: DataFrame, keys: list[str], size: int) -> DataFrame:
    """`rows` left-joined to `marks`, of `size` rows: broadcast up to `SMALL`, else by salted keys, so a hot key is no task's alone."""
    if size <= SMALL:
        return rows.join(F.broadcast(marks), keys, "left")
    salted = marks.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return rows.withColumn("_salt", F.pmod(F.hash("node"), F.lit(SALTS))).join(salted, [*keys, "_salt"], "left").drop("_salt")


VALUE, CELL = ["part", "key"], ["part", "key", "sub", "subkey"]


def sub_cells(rows: DataFrame, groups: list[list[int]], radius: int) -> DataFrame:
    """`rows` of crowded values once for each slice of the other bits: of radius + 1 slices one at least is equal in a linked pair."""
    slices = []
    for g in groups:
        rest = [b for other in groups if other is not g for b in other]
        slices.append([rest[i :: radius + 1] for i in range(radius + 1)])
    masks = F.array(*[F.array(*[F.lit(m) for m in masks_of(x)]) for x in slices])
    out = rows.drop("sub", "subkey").select("*", F.posexplode(F.element_at(masks, F.col("part") + 1)).alias("sub", "_mask"))
    return out.withColumn("subkey", F.col("fp").bitwiseAND(F.col("_mask"))).drop("_mask")


def near_links(nodes: DataFrame, radius: int = 3, parts: int | None = None, pairs: int = 1 << 14, crowded: int = 2048, block: int = 16384, similarity: float | None = None, sets_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """`(a, b)`: links between nodes that have the components of all links within `radius` bits.

    `nodes` has a distinct `node` for each fingerprint `fp`. With a `similarity`, links must also have five-word sets, of
    `sets_of`, that are so far alike. Short sketches, of `sk`, discard at every place where nodes meet, and sets decide at the end (`alike`),
    so it is the same for the components whether a value is dense. A partition value gives all its verified links unless its members times its probes
    exceed `pairs`, or it has under 16 members. Beyond that it is dense, mostly a group of near copies: a task takes its members and
    probes and gives the links of a spanning forest, fewer than its nodes. Dense values of over `crowded` members are
    first split on the other bits (`sub_cells`) where that shrinks the pairs to compare fourfold, and what has over
    `block` rows is dealt out in blocks, each pair of blocks with a forest of its own. Nothing is lost to the components, and no
    group is listed pair by pair or held by one task.
    """
    if similarity:
        nodes = materialize(short_sketches(nodes), "short")
    of_node, differ = carried(nodes), most_differing(similarity) if similarity else None
    rows, both = bit_counts(nodes)
    empty = nodes.sparkSession.createDataFrame([], "a long, b long")
    if rows < 2:
        return empty
    groups = correlated_groups(rows, both, parts) if parts else choose_groups(nodes, rows, both, radius)
    index = values(nodes, masks_of(groups))
    least, few = max(64, rows // 1000), min(16, pairs)  # at most 1000 heavy values a partition
    counts = materialize(index.groupBy(*VALUE).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= few), "values")
    heavy: list[dict[int, int]] = [{} for _ in groups]
    for r in counts.where(F.col("n") >= least).collect():
        heavy[r.part][r.key] = r.n
    asked = materialize(probes(nodes, rows, both, groups, radius, heavy), "probes")
    sought = asked.groupBy(*VALUE).agg(F.count(F.lit(1)).alias("p")).join(counts, VALUE)  # summed first: a row a value, not a row a probe
    dense, many = counted(sought.where(F.col("n") * F.col("p") > pairs).drop("p"), "dense")

    def verified(p: DataFrame, q: DataFrame, keys: list[str]) -> DataFrame:
        p, q = p.alias("p"), q.alias("q")
        same = [F.col(f"p.{k}") == F.col(f"q.{k}") for k in keys]
        apart = lambda c: F.bit_count(F.col(f"p.{c}").bitwiseXOR(F.col(f"q.{c}")))
        close = (F.col("p.node") < F.col("q.node")) & (apart("fp") <= radius)
        if similarity:
            close &= apart("lo") + apart("hi") <= differ
        return p.join(q, [*same, close]).select(F.col("p.node").alias("a"), F.col("q.node").alias("b")).distinct()

    def decided(links: DataFrame) -> DataFrame:
        return alike(links, nodes, radius, similarity, sets_of) if similarity else links

    if not many:
        return decided(verified(asked, index, VALUE))

    members = marked(index, dense, VALUE, many).where(F.col("n") > crowded).drop("n")
    cells = materialize(sub_cells(members, groups, radius).groupBy(*CELL).agg(F.count(F.lit(1)).alias("m")), "cells")
    squares = cells.groupBy(*VALUE).agg(F.sum(F.col("m").cast("double") * F.col("m")).alias("_after"))
    n = F.col("n").cast("double")
    state = materialize(dense.join(squares, VALUE, "left").select(*VALUE, "n", F.coalesce(F.col("_after") * 4 < n * n, F.lit(False)).alias("split")), "crowded")
    full, full_many = counted(cells.where(F.col("m") * F.col("m") > pairs), "full_cells")

    def kinds(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The rows in light cells, and those in dense ones, with the number of members `m`."""
        whole = {"sub": F.lit(-1), "subkey": F.lit(0).cast("long")}
        cols = [*CELL, *of_node]
        of = marked(rows, state, VALUE, many)
        within = materialize(of.where("n IS NOT NULL").withColumns(whole), "within")  # once, as several joins below read it
        parted = materialize(marked(sub_cells(within.where("split"), groups, radius).select(*cols), full, CELL, full_many), "parted")
        light = of.where("n IS NULL").withColumns(whole).select(*cols).unionByName(parted.where("m IS NULL").select(*cols))
        return light, within.where("NOT split").select(*cols, F.col("n").alias("m")).unionByName(parted.where("m IS NOT NULL").select(*cols, "m"))

    light_p, left = kinds(asked)
    light_q, right = kinds(index)
    links = verified(light_p, light_q, CELL)
    shares, n_cells = counted(left.groupBy(*CELL).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("shares")), "shares")
    of_right = shares.select(*[F.col(c).alias(c) for c in CELL], F.col("shares").alias("blocks"))
    keys = [*CELL, "i", "j"]

    def dealt(rows: DataFrame, own: str, other: str, blocks: Column, others: Column) -> DataFrame:
        """Each row in its own block, once for each block of the other side."""
        rows = rows.withColumn(own, F.pmod(F.xxhash64("node"), blocks.cast("long")).cast("int"))
        one = rows.where(others == 1).withColumn(other, F.lit(0))
        return one.unionByName(rows.where(others > 1).withColumn(other, F.explode(F.sequence(F.lit(0), others.cast("int") - 1)))).select(*keys, *of_node)

    by_size = F.ceil(F.col("m") / block)
    left = dealt(marked(left, shares, CELL, n_cells), "i", "j", F.col("shares"), by_size)
    right = dealt(marked(right, of_right, CELL, n_cells).where("blocks IS NOT NULL"), "j", "i", by_size, F.col("blocks"))

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(forest(a, b, radius, differ), columns=["a", "b"], dtype="int64")

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(pair, "a long, b long")
    return decided(links.unionByName(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct())


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, similarity: float | None = None) -> DataFrame:
    """Per row: `doc_id, fingerprint` (16 lowercase hex digits), `component_id` (smallest doc_id reachable).

    Without a `similarity`, rows with equal fingerprints are one node, and links run between distinct ones. With a
    `similarity`, fingerprints are of distinct words, rows are one node only if their sets of five-word shingles are equal too, and
    a link also needs that Jaccard similarity of those sets. Null or empty texts have fingerprint
    zero and link like any other. Null ids never name a component, and with a `similarity` a node of such rows alone
    has no links, as sets are read by id. Ids repeat as their rows do; an empty table gives no rows; other columns are ignored.
    """
    same = ["fp", "digest"] if similarity else ["fp"]
    rows = materialize(fingerprints(docs, id_col, text_col, shingle, bool(similarity)), "fingerprints")
    one = [F.min("doc_id").alias("least"), *([F.min("sk").alias("sk")] if similarity else [])]
    nodes = materialize(rows.groupBy(*same).agg(*one).withColumn("node", F.monotonically_increasing_id()), "distinct")
    links = materialize(near_links(nodes, radius, similarity=similarity, sets_of=sets_from(docs, nodes, id_col, text_col) if similarity else None), "near")
    named = nodes.join(connected_components(links), "node", "left").select(*same, "least", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_text = named.join(least, "root").select(*same, "component_id")
    return rows.join(by_text, same).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 7, similarity: float = 0.8) -> DataFrame:
    """`docs` with one row of each component of near copies: that with the smallest id; all columns as they were.

    Fingerprints of distinct words propose, as an edit changes few of them; sets of five-word shingles decide.
    Rows with a null id are kept, as nothing names them. Of rows that repeat an id that stays, one is kept.
    """
    components = simhash_components(docs.where(F.col(id_col).isNotNull()), id_col, text_col, radius=radius, similarity=similarity)
    stay = components.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_stay")).distinct()
    named = docs.where(F.col(id_col).isNotNull()).withColumn("_stay", F.col(id_col).cast("long")).join(stay, "_stay", "left_semi").dropDuplicates(["_stay"])
    return named.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where(F.col(id_col).isNull()))
