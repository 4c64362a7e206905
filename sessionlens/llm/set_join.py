"""Jaccard join of word-shingle sets by PartEnum signatures.

Two sets of sizes a and b with a Jaccard similarity of p in a hundred differ in at most (a + b)(100 - p)/(100 + p)
elements. Sizes go into classes, each with the largest such difference K. The domain of shingles is dealt into
(K + 1)/2 partitions, so in one of them two similar sets differ in at most one element; a partition has `pieces` cells, and
of its subsets that leave one cell out, one is then equal. Each subset's content gives a signature. Sets that share one are
candidates; parity sketches, which never differ in more bits than the sets in elements, discard most, and whole sets decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .graph import connected_components

#: Bits of a parity sketch, as 64-bit words.
SKETCH = 16
#: Rounds of candidates by one least signature each, before all signatures are compared.
ROUNDS = 4
#: A signature with more sets than this is compared in blocks, by tasks.
CROWD = 48
BLOCK = 512
#: Rows of a table that may be broadcast.
SMALL = 100_000
_DRAW = np.random.default_rng(11).integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
_M = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ _DRAW[salt]) * _M
    x = (x ^ (x >> np.uint64(29))) * _DRAW[salt]
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, shingle: int = 3) -> np.ndarray:
    """The distinct word shingles of a text as sorted 64-bit hashes; fewer words are one shingle, no words none."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: A-Z only, and ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    known = {w: xxhash.xxh64_intdigest(w, 42) for w in set(words)}
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(shingle, len(h))
    n = len(h) - size + 1
    total = np.full(n, size, np.uint64)
    for i in range(size):  # each word is mixed on its own and by its place: no two of them cancel
        total = mixed(total + h[i : i + n] * _DRAW[i], 3)
    return np.unique(total)


class SizeClasses:
    """Size classes at a similarity of `percent`; `pieces` cells a partition, of which all but one make a signature."""

    def __init__(self, percent: int = 90, step: float = 1.4, pieces: int = 2):
        self.percent, self.step, self.pieces = percent, step, pieces
        self.upper = [1]  # largest size of each class

    def differ(self, both: int) -> int:
        return both * (100 - self.percent) // (100 + self.percent)

    def of(self, size: int) -> int:
        while self.upper[-1] < size:
            last = self.upper[-1]
            same = next(x for x in range(last + 1, last + 200) if x == last + 199 or self.differ(2 * x + 2) > self.differ(2 * last + 2))
            self.upper.append(max(same, int(last * self.step)))  # at least all sizes of the next difference
        return int(np.searchsorted(self.upper, size))

    def signatures(self, sets: np.ndarray) -> np.ndarray:
        """Those of one set, in each class in which a similar set of its size or larger may be."""
        size, out = len(sets), []
        for c in range(self.of(size), self.of(size * 100 // self.percent) + 1):
            k = self.differ(2 * self.upper[c])
            parts, cells = (k + 2) // 2, self.pieces if k else 1
            first, second = (mixed(sets, 4) % np.uint64(parts)).astype(np.int64), (mixed(sets, 5) % np.uint64(cells)).astype(np.int64)
            sums = np.zeros(parts * cells, np.uint64)
            np.add.at(sums, first * cells + second, mixed(sets, 6))
            sums = sums.reshape(parts, cells)
            whole = sums.sum(axis=1, dtype=np.uint64)[:, None]
            content = whole - sums if k else whole  # without one cell: a difference of one element spares one such content
            place = np.arange(content.size, dtype=np.uint64).reshape(content.shape) + np.uint64(c << 32)
            out.append(mixed(content + mixed(place, 7), 8).ravel())
        return np.concatenate(out)


def sketch(sets: np.ndarray) -> np.ndarray:
    """Parities of the elements' hashes: an element more or less changes one bit."""
    bits = np.bincount((mixed(sets, 9) % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")


def features(docs: DataFrame, id_col: str, text_col: str, percent: int, shingle: int) -> DataFrame:
    """`(row, doc_id, h, n, digest, sk, firsts, sigs)` of whole texts: a hash of the text, size and digest of the set, its sketch and signatures."""
    schema = "doc_id long, h long, n long, digest binary, sk array<long>, firsts array<long>, sigs array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = SizeClasses(percent)
        for whole in batches:
            for at in range(0, len(whole), 256):
                b = whole.slice(at, 256)
                out: list[tuple] = []
                for text in b.column(2):
                    s = shingle_set(text.as_py(), shingle)
                    if len(s):
                        sigs = classes.signatures(s)
                        least = [int(sigs[np.argmin(mixed(sigs, 10 + i))].view(np.int64)) for i in range(ROUNDS)]
                        out.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), sketch(s), least, sigs.view(np.int64)))
                    else:
                        out.append((0, b"", [], [], []))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), *(pa.array(list(c), pa.list_(pa.int64())) for c in cols[2:])], ["doc_id", "h", "n", "digest", "sk", "firsts", "sigs"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())


def may_be_similar(a: str, b: str, percent: int) -> Column:
    """Whether sizes and sketches of two sets allow the similarity; a pair that has it always passes."""
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = F.aggregate(F.zip_with(F.col(f"{a}.sk"), F.col(f"{b}.sk"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & (apart * (100 + percent) <= (n_a + n_b) * (100 - percent))


def in_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """`(a, b)` of `rows(sig, m, node, comp, n, sk)` of crowded signatures: pairs of different components that may be similar.

    `m` is the number of a signature's rows. They are dealt into blocks, and a task compares two of them, so none holds a signature whole.
    """

    def pairs(f: pd.DataFrame) -> pd.DataFrame:
        sk, n, comp, node, own = np.stack(f["sk"].to_numpy()).view(np.uint64), f["n"].to_numpy(), f["comp"].to_numpy(), f["node"].to_numpy(), f["own"].to_numpy()
        i, j = int(f["i"].iloc[0]), int(f["j"].iloc[0])
        left, right, out = np.flatnonzero(own == i), np.flatnonzero(own == j), []
        for x in left:
            y = right[(comp[right] != comp[x]) & (100 * np.minimum(n[right], n[x]) >= percent * np.maximum(n[right], n[x]))]
            y = y[node[y] > node[x]] if i == j else y
            y = y[np.bitwise_count(sk[y] ^ sk[x]).sum(axis=1, dtype=np.int64) * (100 + percent) <= (n[y] + n[x]) * (100 - percent)]
            out.append(np.stack([np.minimum(node[y], node[x]), np.maximum(node[y], node[x])], axis=1))
        return pd.DataFrame(np.concatenate(out) if out else np.zeros((0, 2), np.int64), columns=["a", "b"])

    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("node"), blocks.cast("long")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("sig", "node", "comp", "n", "sk", "own", F.least("own", "_o").alias("i"), F.greatest("own", "_o").alias("j"))
    return dealt.groupBy("sig", "i", "j").applyInPandas(pairs, "a long, b long")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int, shingle: int) -> DataFrame:
    """Those of `pairs(a, b)` whose whole sets are similar. Sets are read again, from the texts of the nodes that pairs name."""
    pairs = materialize(pairs.distinct(), "pairs")
    named = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = materialize(named.join(nodes.select("node", "doc_id", "h", "digest"), "node"), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= SMALL else wanted

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(t.as_py(), shingle).tobytes() for t in b.column(1)]
            keep = pa.array([hashlib.blake2b(s, digest_size=16).digest() == d.as_py() for s, d in zip(found, b.column(2), strict=True)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], ["node", "set"]).filter(keep)  # an id may have several texts

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).cast("string").alias("text"))
    read = texts.join(wanted, (texts.h == wanted.h) & texts.doc_id.eqNullSafe(wanted.doc_id)).select("node", "text", "digest")
    whole = materialize(read.mapInArrow(sets, "node long, set binary").dropDuplicates(["node"]), "sets")
    of = lambda end: whole.select(F.col("node").alias(end), F.col("set").alias(f"set_{end}"))
    return materialize(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(similar, "a long, b long"), "links")


def shingle_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 90, shingle: int = 3) -> DataFrame:
    """Per row: `doc_id, n_shingles, component_id` (smallest id reachable by links of `percent` or more, itself included).

    Rows of equal sets are one node. Signatures are compared twice: first each set meets the least of those
    that share one of its `ROUNDS` least signatures, which joins most near copies; then, for all signatures, sets of different
    components meet. A pair within a component would add no component, so none is lost, and a group of
    near copies is not listed pair by pair. Null and empty texts, or texts without words, have no shingle and link with nothing,
    not even with each other. Null ids never name a component. An empty table gives no rows; other columns are ignored.
    """
    rows = materialize(features(docs, id_col, text_col, percent, shingle), "features")
    groups = rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("least"), F.min("row").alias("row"))
    nodes = materialize(groups.join(rows.drop("digest"), "row").withColumnRenamed("row", "node"), "nodes")
    about = nodes.select("node", "n", "sk")

    # First the least signatures.
    firsts = nodes.select("node", "n", "sk", F.posexplode("firsts").alias("round", "sig"))
    centre = firsts.groupBy("round", "sig").agg(F.min(F.struct("node", "n", "sk")).alias("c"), F.count(F.lit(1)).alias("m")).where("m > 1").select("round", "sig", "c.*")
    p, q = centre.alias("p"), firsts.alias("q")
    star = p.join(q, (F.col("p.round") == F.col("q.round")) & (F.col("p.sig") == F.col("q.sig")) & (F.col("p.node") < F.col("q.node")) & may_be_similar("p", "q", percent))
    links = verified(star.select(F.col("p.node").alias("a"), F.col("q.node").alias("b")), nodes, docs, id_col, text_col, percent, shingle)
    joined = connected_components(links)

    # Then all signatures, between the components that are there so far.
    placed = nodes.join(joined, "node", "left").select("node", F.coalesce("root", "node").alias("comp"), F.explode("sigs").alias("sig"))
    met = placed.groupBy("sig").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("sig", "m")
    shared = materialize(placed.join(met, "sig").join(about, "node"), "shared")  # a signature of very many sets is a skewed key, which Spark splits
    few = shared.where(F.col("m") <= CROWD)
    p, q = few.alias("p"), few.alias("q")
    close = p.join(q, (F.col("p.sig") == F.col("q.sig")) & (F.col("p.node") < F.col("q.node")) & (F.col("p.comp") != F.col("q.comp")) & may_be_similar("p", "q", percent))
    candidates = close.select(F.col("p.node").alias("a"), F.col("q.node").alias("b")).unionByName(in_blocks(shared.where(F.col("m") > CROWD), percent))
    links = links.unionByName(verified(candidates, nodes, docs, id_col, text_col, percent, shingle))

    named = nodes.join(connected_components(links), "node", "left").select("digest", "least", F.coalesce("root", "node").alias("root"))
    by_set = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("digest", "component_id")
    return rows.join(by_set, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
