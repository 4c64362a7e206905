"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its features, and those of the lines before and after it, give the evidence; a
transition matrix ties neighbours. Forward-backward gives each line's chance of being good, and a document's
quality is their mean weighted by line length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_bucket, labelled_sample

#: Features of a line by itself; the chain sees them for the line, the one before and the one after.
OWN = ("length", "words", "upper", "digits", "marks", "bars", "other", "word_length", "repeat_next", "distinct", "same_as_before", "seen_before", "ends_well", "singles", "longest_word")
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(9, 14), 32]] = 1
_CLASS[[*range(65, 91)]] = 2
_CLASS[[*range(48, 58)]] = 3
_CLASS[[ord(c) for c in "#$%&*!?@^~=+<>\\_{}[]"]] = 4
_CLASS[[ord(c) for c in "|/;:()\"'-`"]] = 5
_CLASS[[ord(c) for c in ".,"]] = 6
_CLASS[[*range(128, 256)]] = 7


def line_features(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines x OWN) and weights (UTF-8 bytes, one at least) of one document's lines."""
    raw = [x.encode("utf-8", "replace") for x in lines]
    size = np.array([len(x) for x in raw], np.int64)
    out = np.zeros((len(lines), len(OWN)))
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    starts = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    kinds = _CLASS[data]
    per = np.stack([np.add.reduceat(kinds == k, starts) for k in range(2, 8)], axis=1) / np.maximum(size, 1)[:, None]
    out[:, 0] = np.log1p(size) / 8
    out[:, 2:6] = per[:, :4]
    out[:, 6] = per[:, 5]
    seen: set[bytes] = set()
    before = None
    for i, x in enumerate(raw):
        w = x.split()
        n = len(w)
        if n:
            kinds_of_words = len(set(w))
            out[i, 1] = np.log1p(n) / 8
            out[i, 7] = min(size[i] / n / 16, 4.0)
            out[i, 8] = sum(map(bytes.__eq__, w, w[1:])) / n
            out[i, 9] = kinds_of_words / n
            out[i, 13] = n == 1
            out[i, 14] = min(max(map(len, w)) / 32, 4.0)
            out[i, 12] = x[-1:] in b".!?\"'" and w[-1][-2:] != b"!!"
        out[i, 10] = x == before
        out[i, 11] = x in seen
        seen.add(x)
        before = x
    return out, np.maximum(size, 1)


def widen(own: np.ndarray) -> np.ndarray:
    """Adds low and high cuts of each feature, and those of the neighbouring lines; outside a document all are 0."""
    cut = np.concatenate([own, own > 0.02, own > 0.1, own > 0.3, own > 0.6], axis=1)
    side = np.zeros_like(cut)
    before, after = side.copy(), side
    before[1:], after[:-1] = cut[:-1], cut[1:]
    return np.concatenate([np.ones((len(own), 1)), cut, before, after], axis=1)


def forward_backward(scores: np.ndarray, starts: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals (lines x 2), summed pair marginals by sequence (sequences x 2 x 2) and log partition of each sequence.

    `scores` holds all sequences' lines one after another. Sequences advance together, longest first, so work
    follows the number of lines and the loop the longest sequence.
    """
    order = np.argsort(-sizes, kind="stable")
    at, size = starts[order], sizes[order]
    n, longest = len(at), int(size.max())
    alpha, beta = np.zeros_like(scores), np.zeros_like(scores)
    alpha[at] = scores[at]
    live = [int(np.searchsorted(-size, -t)) for t in range(longest)]  # sequences longer than t
    for t in range(1, longest):
        k = live[t]
        now = at[:k] + t
        a = alpha[now - 1][:, :, None] + trans[None]
        top = a.max(axis=1)
        alpha[now] = scores[now] + top + np.log(np.exp(a - top[:, None, :]).sum(axis=1))
    for t in range(longest - 2, -1, -1):
        k = live[t + 1]
        now = at[:k] + t
        b = trans[None] + (scores[now + 1] + beta[now + 1])[:, None, :]
        top = b.max(axis=2)
        beta[now] = top + np.log(np.exp(b - top[:, :, None]).sum(axis=2))
    last = alpha[at + size - 1]
    top = last.max(axis=1)
    z = top + np.log(np.exp(last - top[:, None]).sum(axis=1))
    per_line = np.repeat(z, size)
    rows = np.concatenate([np.arange(a, a + s) for a, s in zip(at, size, strict=True)])
    z_line = np.zeros(len(scores))
    z_line[rows] = per_line
    marginal = np.exp(alpha + beta - z_line[:, None])
    marginal /= marginal.sum(axis=1, keepdims=True)
    pairs = np.zeros((n, 2, 2))
    inner = np.ones(len(scores), bool)
    inner[at + size - 1] = False
    i = np.flatnonzero(inner)
    if len(i):
        p = np.exp(alpha[i][:, :, None] + trans[None] + (scores[i + 1] + beta[i + 1])[:, None, :] - z_line[i][:, None, None])
        of = np.zeros(len(scores), np.int64)
        of[rows] = np.repeat(order, size)
        np.add.at(pairs, of[i], p)
    out_z = np.zeros(n)
    out_z[order] = z
    return marginal, pairs, out_z


@dataclass
class ChainModel:
    """Evidence for good over bad (`weights`), and `trans[a, b]` for a line of class b after one of class a."""

    weights: np.ndarray
    trans: np.ndarray

    def quality(self, texts: list[str]) -> list[float]:
        """Length-weighted chance of good over a document's lines; an empty text is one empty line."""
        feats, weights, sizes = [], [], []
        for t in texts:
            own, w = line_features(t.split("\n"))
            feats.append(widen(own) @ self.weights)
            weights.append(w)
            sizes.append(len(w))
        good, weight, size = np.concatenate(feats), np.concatenate(weights), np.array(sizes)
        starts = np.concatenate(([0], np.cumsum(size)[:-1]))
        marginal, _, _ = forward_backward(np.stack([np.zeros(len(good)), good], axis=1), starts, size, self.trans)
        return (np.add.reduceat(marginal[:, 1] * weight, starts) / np.add.reduceat(weight, starts)).tolist()


def fit_chain(rows: list[tuple[str, int]], totals: dict[int, int], rounds: int = 120, ridge: float = 1e-3, chunk: int = 48) -> ChainModel:
    """Maximum likelihood with a ridge, by L-BFGS. A document's label stands for all its lines.

    Documents are cut into chains of `chunk` lines for fitting only. Chains weigh so that documents count
    alike and the classes have their shares of `totals`, whatever the sample's own.
    """
    wide = 1 + 3 * 5 * len(OWN)
    counts = {y: sum(1 for _, l in rows if l == y) for y in (0, 1)}
    if not counts[0] or not counts[1]:  # nothing to tell apart: all good, or all bad
        w = np.zeros(wide)
        w[0] = -8.0 if counts[0] else 8.0
        return ChainModel(w, np.zeros((2, 2)))
    share = {y: totals.get(y, counts[y]) / max(sum(totals.values()), 1) * len(rows) / counts[y] for y in (0, 1)}
    blocks, sizes, labels, weight = [], [], [], []
    for text, y in rows:
        x = widen(line_features(text.split("\n"))[0]).astype(np.float32)  # half the driver's memory
        for at in range(0, len(x), chunk):
            part = x[at : at + chunk]
            blocks.append(part)
            sizes.append(len(part))
            labels.append(y)
            weight.append(share[y] / (-(-len(x) // chunk) * len(part)))
    x, size, y, weight = np.concatenate(blocks), np.array(sizes), np.array(labels), np.array(weight)
    blocks.clear()
    starts = np.concatenate(([0], np.cumsum(size)[:-1]))
    y_line, w_line = np.repeat(y, size), np.repeat(weight, size)
    total = float(sum(share[l] for _, l in rows))

    def loss(theta: np.ndarray) -> tuple[float, np.ndarray]:
        w, trans = theta[:wide], theta[wide:].reshape(2, 2)
        good = (x @ w.astype(np.float32)).astype(np.float64)
        marginal, pairs, z = forward_backward(np.stack([np.zeros(len(good)), good], axis=1), starts, size, trans)
        own = np.add.reduceat(np.where(y_line == 1, good, 0.0), starts) + (size - 1) * trans[y, y]
        g_w = (x.T @ (w_line * (marginal[:, 1] - y_line)).astype(np.float32)).astype(np.float64)
        g_t = np.einsum("s,sab->ab", weight, pairs)
        np.add.at(g_t, (y, y), -weight * (size - 1))
        value = float((weight * (z - own)).sum()) / total + ridge * float(theta @ theta) / 2
        return value, np.concatenate([g_w, g_t.ravel()]) / total + ridge * theta

    theta = lbfgs(loss, np.zeros(wide + 4), rounds)
    return ChainModel(theta[:wide], theta[wide:].reshape(2, 2))


def lbfgs(loss, theta: np.ndarray, rounds: int, keep: int = 8) -> np.ndarray:
    """Minimise a smooth function given with its gradient."""
    value, grad = loss(theta)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, back = -grad, []
        for s, g in reversed(steps):
            a = (s @ d) / (s @ g)
            back.append(a)
            d = d - a * g
        if steps:
            s, g = steps[-1]
            d = d * (s @ g) / (g @ g)
        for (s, g), a in zip(steps, reversed(back), strict=True):
            d = d + s * (a - (g @ d) / (s @ g))
        rate = 1.0 if steps else min(1.0, 1.0 / max(float(np.abs(grad).sum()), 1e-12))
        while True:
            after, g_after = loss(theta + rate * d)
            if after <= value + 1e-4 * rate * float(grad @ d) or rate < 1e-6:
                break
            rate /= 2
        s, g = rate * d, g_after - grad
        theta, grad = theta + s, g_after
        if value - after < 1e-7 * max(1.0, abs(value)):
            break
        value = after
        if s @ g > 1e-12:
            steps = [*steps[-keep + 1 :], (s, g)]
    return theta


def score_quality(docs: DataFrame, model: ChainModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with `score` (0 to 1, higher is better) over whole texts; all columns and repeated rows stay.

    A null or empty text is one empty line. A column of `docs` named score is replaced. Memory follows an
    Arrow batch of texts; null ids pass through.
    """
    schema = docs.drop("score").withColumn("score", F.lit(0.0)).schema
    where = docs.drop("score").columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                score = model.quality([t or "" for t in b.column(where).to_pylist()])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64())], [*b.schema.names, "score"])

    return docs.drop("score").mapInArrow(run, schema)


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = 1200, id_col: str = "doc_id", text_col: str = "text") -> ChainModel:
    """Fit on up to `most` labelled documents of either class, none of the held-out fifth."""
    return fit_chain(*labelled_sample(docs, labels, "quality", most, id_col=id_col, text_col=text_col))


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = 1200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: `doc_id, held_out, score, predicted`; see `score_quality` for edge cases."""
    scored = score_quality(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), fit_quality(docs, labels, most, id_col, text_col))
    return scored.select("doc_id", (id_bucket("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = 1200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows whose score is below `threshold`, all columns as they were."""
    own = docs.withColumns({"_body": F.col(text_col).cast("string"), "_all": F.struct(*[F.col(f"`{c}`") for c in docs.columns])}).select("_body", "_all")
    kept = score_quality(own, fit_quality(docs, labels, most, id_col, text_col), text_col="_body").where(F.col("score") >= threshold)
    return kept.select(*[F.col("_all").getField(c).alias(c) for c in docs.columns])
