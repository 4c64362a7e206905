"""Packing documents into fixed windows by non-negative least squares over length combinations."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .mixing import running_start

#: Words a task keeps; later ones are tokenized each time, which costs time and no memory.
MAX_WORDS = 600_000
#: Words that are tokenized in one call.
TOGETHER = 256


class WordTokenizer:
    """Token ids of texts, word by word from a bounded cache.

    Sound for tokenizers whose pre-tokenizer parts letters from other signs, never joins text across white
    space and drops that white space, and whose last token of a piece ends in `</w>`.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends = np.zeros(size, bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.ends[i] = piece.endswith("</w>")
        self.words: dict[str, bytes] = {"": b""}
        self.stops = {c: self.one(c) for c in ".,"}

    def one(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.dtype).tobytes()

    def lookup(self, new: set[str]) -> dict[str, bytes]:
        """Ids of words not kept yet. Words of letters are one piece each and go together; a stop after a letter is its own piece."""
        kept, out = self.words, {}
        stopped = [w for w in new if w[-1] in self.stops and w[-2:-1].isalpha()]
        new = new.difference(stopped).union({w[:-1] for w in stopped}.difference(kept))
        letters = sorted(w for w in new if w.isalpha())
        groups = [letters[i : i + TOGETHER] for i in range(0, len(letters), TOGETHER)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.dtype)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(group):
                raw, width = ids.tobytes(), self.dtype.itemsize
                cuts = [0, *(ends * width).tolist()]
                out.update(zip(group, map(raw.__getitem__, map(slice, cuts, cuts[1:])), strict=False))
            else:
                out.update((w, self.one(w)) for w in group)
        rest = sorted(w for w in new if not w.isalpha())
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            out[w] = np.array(e.ids, self.dtype).tobytes()
        for w in stopped:
            out[w] = (kept.get(w[:-1]) or out[w[:-1]]) + self.stops[w[-1]]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for at in range(0, len(texts), 64):
            split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") for t in texts[at : at + 64]]
            words = self.words
            if new := set().union(*split).difference(words):
                found = self.lookup(new)
                if len(words) < MAX_WORDS:
                    words.update(found)
                else:
                    words = {w: words[w] for w in set().union(*split).difference(new)} | found
            out += [np.frombuffer(b"".join(map(words.__getitem__, s)), self.dtype) for s in split]
        return out


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenized(docs: DataFrame, path: str, window: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: its id, number of tokens, CRCs of its full windows, and what is left: length, CRC and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = tokenizer(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                rows = []
                for ids in tok.encode([t or "" for t in b.column(1).to_pylist()]):
                    ids = np.append(ids, tok.dtype.type(end_id))
                    cut = len(ids) // window * window
                    rest = ids[cut:]
                    rows.append((len(ids), [crc(ids[i : i + window]) for i in range(0, cut, window)], len(rest), crc(rest), rest.tobytes()))
                n, crcs, left, left_crc, rest = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(left, pa.int64()), pa.array(left_crc, pa.int64()), pa.array(rest, pa.binary())], ["doc_id", "doc_tokens", "crcs", "left", "left_crc", "rest"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, doc_tokens long, crcs array<long>, left long, left_crc long, rest binary").withColumn("uid", F.monotonically_increasing_id())


def combinations(units: int) -> np.ndarray:
    """All ways to fill `units` by one, two or three lengths, as rows of counts per length (1 to units)."""
    rows = []
    for a in range(units, 0, -1):
        if a == units:
            rows.append((a,))
        for b in range(min(a, units - a), 0, -1):
            if a + b == units:
                rows.append((a, b))
            elif b >= units - a - b:
                rows.append((a, b, units - a - b))
    out = np.zeros((len(rows), units))
    for i, r in enumerate(rows):
        for x in r:
            out[i, x - 1] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray, tol: float = 1e-7) -> np.ndarray:
    """argmin |a x - b| over x >= 0 by the active-set method, on the normal equations."""
    gram, right, x = a.T @ a, a.T @ b, np.zeros(a.shape[1])
    passive = np.zeros(a.shape[1], bool)
    for _ in range(3 * a.shape[0]):
        gain = right - gram @ x
        gain[passive] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= tol * max(1.0, float(np.abs(right).max())):
            break
        passive[best] = True
        while True:
            on = np.flatnonzero(passive)
            z = np.linalg.lstsq(gram[np.ix_(on, on)], right[on], rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[on] = z
                break
            low = z <= 0
            step = float(np.min(x[on][low] / np.maximum(x[on][low] - z[low], 1e-300)))
            x[on] += step * (z - x[on])
            passive[on[x[on] <= 1e-12]] = False
            x[~passive] = 0
            if not passive.any():
                break
    return x


def repeat_counts(histogram: np.ndarray, combos: np.ndarray) -> np.ndarray:
    """Whole repeats of each combination that the histogram can serve: the NNLS solution rounded down, then raised where lengths remain."""
    scale = max(float(histogram.max()), 1.0)
    exact = nnls(combos.T, histogram / scale) * scale
    repeats = np.floor(exact + 1e-9).astype(np.int64)
    left = histogram - combos.T.astype(np.int64) @ repeats
    for c in np.argsort(-(exact - np.floor(exact)), kind="stable"):
        need = combos[c] > 0
        more = int((left[need] // combos[c][need]).min())
        if exact[c] > 0 and more > 0:
            repeats[c] += more
            left = left - more * combos[c].astype(np.int64)
    while (left < 0).any():  # the solution may overshoot a length a little
        short = int(np.argmin(left))
        c = int(np.argmax(np.where(combos[:, short] > 0, repeats, -1)))
        back = min(int(repeats[c]), int(-(left[short] // combos[c, short])))
        repeats[c] -= back
        left = left + back * combos[c].astype(np.int64)
    return repeats


def segments(histogram: np.ndarray, units: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """`(unit, lo, hi, sequence, slot)`: ranks lo to hi of a length go to the sequences from `sequence` on; and the number of sequences."""
    combos = combinations(units)
    repeats = repeat_counts(histogram, combos)
    used, rows, sequences = np.zeros(units, np.int64), [], 0
    for c in np.flatnonzero(repeats):
        slot = 0
        for u in np.flatnonzero(combos[c])[::-1]:
            for _ in range(int(combos[c, u])):
                rows.append((int(u) + 1, int(used[u]), int(used[u] + repeats[c]), sequences, slot))
                used[u] += repeats[c]
                slot += 1
        sequences += int(repeats[c])
    return rows, sequences


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = 2048, units: int = 128, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: `doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, row`.

    `row` numbers the input rows, so that copies of a document, which share its id, can be told apart.

    Full windows of a document stand alone. What is left of each is a length in `units` steps of the window;
    NNLS finds how often each combination of up to three lengths that fills a window repeats, ranks within a
    length pick the documents, and the residual documents follow each other, cut at window ends, so that only
    the last residual sequence and the rounding to steps are padded. Null or empty texts are the end id alone;
    rows that repeat an id are packed one by one; an empty table gives no rows; other columns are ignored. The driver sees the histogram
    (`units` rows), never documents.
    """
    spark, step = docs.sparkSession, window // units
    tok = materialize(tokenized(docs, tokenizer_path, window, end_id, id_col, text_col), "tokens")
    light = tok.where("left > 0").select("uid", "doc_id", "doc_tokens", "left", "left_crc", F.ceil(F.col("left") / step).cast("int").alias("unit"), F.lit(1).alias("one"))
    part = F.shiftright("uid", 33)
    histogram = np.zeros(units, np.int64)
    for r in light.groupBy("unit").count().collect():  # at most `units` rows
        histogram[r["unit"] - 1] = r["count"]
    plan, sequences = segments(histogram, units) if histogram.any() else ([], 0)
    ranked = running_start(light, "unit", part, [F.col("uid")], "one", "rank")
    fits = F.broadcast(spark.createDataFrame(plan, "u int, lo long, hi long, first long, slot int"))  # a few hundred rows
    placed = materialize(ranked.join(fits, (F.col("unit") == F.col("u")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")), "left").select("uid", "doc_id", "doc_tokens", "left", "left_crc", (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "slot", F.lit(1).alias("one")), "placed")

    start = F.col("doc_tokens") - F.col("left")
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    combined = placed.where("sequence_id IS NOT NULL").select("uid", "doc_id", start.alias("start"), F.col("left").alias("length"), F.col("left_crc").alias("ids_crc32"), "doc_tokens", "sequence_id", F.coalesce(F.sum("left").over(before), F.lit(0)).alias("offset"))

    rest = running_start(placed.where("sequence_id IS NULL").select("uid", "doc_id", "doc_tokens", "left", "left_crc", "one"), "one", part, [F.col("uid")], "left", "at")
    rest = rest.withColumn("seq", F.lit(sequences) + F.floor(F.col("at") / window)).withColumn("offset", F.col("at") % window)
    uncut = rest.where(F.col("offset") + F.col("left") <= window).select("uid", "doc_id", start.alias("start"), F.col("left").alias("length"), F.col("left_crc").alias("ids_crc32"), "doc_tokens", F.col("seq").alias("sequence_id"), "offset")
    cut = rest.where(F.col("offset") + F.col("left") > window).select("uid", "seq", "offset").join(tok.select("uid", "doc_id", "doc_tokens", "left", "rest"), "uid").select("uid", "doc_id", "doc_tokens", "left", "rest", "seq", "offset")
    width = np.dtype(tokenizer(tokenizer_path).dtype)

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for uid, doc, n, left, ids, seq, offset in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids, first = np.frombuffer(ids, width), window - offset
                out.append((uid, doc, n - left, first, crc(ids[:first]), n, seq, offset))
                out.append((uid, doc, n - left + first, left - first, crc(ids[first:]), n, seq + 1, 0))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["uid", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    cut = cut.mapInArrow(halves, "uid long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    residual = histogram.copy()
    for u, lo, hi, *_ in plan:
        residual[u - 1] -= hi - lo
    beyond = sequences + int(residual.sum())  # no residual piece is longer than a window, so these ids are free
    full = tok.where(F.size("crcs") > 0).select("uid", "doc_id", "doc_tokens", "crcs", F.size("crcs").alias("n"), F.lit(1).alias("one"))
    full = running_start(full, "one", part, [F.col("uid")], "n", "at").select("uid", "doc_id", "doc_tokens", "at", F.posexplode("crcs").alias("i", "ids_crc32"))
    full = full.select("uid", "doc_id", (F.col("i") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.lit(beyond) + F.col("at") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("sequence_id").cast("long"), F.col("offset").cast("long"), F.col("uid").alias("row")]
    return combined.select(cols).unionByName(uncut.select(cols)).unionByName(cut.select(cols)).unionByName(full.select(cols))
