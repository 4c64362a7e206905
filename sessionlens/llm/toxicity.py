"""Toxicity by a support vector machine on a gap-weighted subsequence string kernel with Nystrom landmarks.

Two strings are alike when they share subsequences of four signs, each occurrence weighing `DECAY` to the
power of the stretch it spans; signs between may be anything, so gaps and inserted signs cost little. A
sentence is a bag of units (its words, and runs of single letters joined); its decision is that of its most
suspicious unit. Labelled sentences fix the bags' signs: all units of clean text are negative, and a positive
bag's witness is chosen by the machine itself.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_bucket, labelled_sample

#: Signs of the kernel's alphabet; 0 stands for signs that are only gaps.
SIGNS = 96
#: Signs put before and after a unit; the lower-case letters are 1 to 26, digits 28 to 37, other letters 38 to 92.
EDGE = (94, 95)
#: Weight of each position a subsequence spans, and the longest span.
DECAY, SPAN = 0.5, 7
#: Units longer than this are scored in pieces that overlap by 2 * SPAN.
PIECE = 48
_SINGLES = re.compile(r"(?<![^ ])[^ ](?: [^ ]){2,}(?![^ ])")
_OFFSETS = list(itertools.combinations(range(1, SPAN), 3))
#: Slots of a machine's table; subsequences share them by hash, a few in a hundred meeting another's.
SLOTS = 1 << 20
#: Units a worker keeps decisions of; beyond that the rest is worked out anew.
MOST_KEPT = 700_000
_KEPT: dict[bytes, dict[str, float]] = {}


def signs(units: list[str], width: int) -> np.ndarray:
    """Codes of the units' signs (units x width), 0 beyond the end."""
    points = np.frombuffer("".join(f"<{u}>".ljust(width, "\0") for u in units).encode("utf-32-le", "replace"), "<u4").reshape(len(units), width).astype(np.int32)
    out = np.where(points >= 128, 38 + points % 55, 0)
    out = np.where((points >= 97) & (points <= 122), points - 96, out)
    out = np.where(points == 60, EDGE[0], np.where(points == 62, EDGE[1], out))
    return np.where((points >= 48) & (points <= 57), points - 20, out)


def subsequences(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Every occurrence of a subsequence in each unit: (units x places) codes, 0 for none, and their weights."""
    width = max(max(map(len, units)) + 2, SPAN)
    s = np.concatenate([signs(units, width), np.zeros((len(units), SPAN), np.int32)], axis=1)
    code, weight, on = [], [], s > 0
    for i, j, k in _OFFSETS:
        sure = on[:, :width] & on[:, i : i + width] & on[:, j : j + width] & on[:, k : k + width]
        value = ((s[:, :width] * SIGNS + s[:, i : i + width]) * SIGNS + s[:, j : j + width]) * SIGNS + s[:, k : k + width]
        code.append(value * sure)
        weight.append(DECAY ** (k + 1))
    codes = np.concatenate(code, axis=1)
    return codes, np.repeat(np.array(weight, np.float32), width)[None, :] * (codes > 0)


def slot(codes: np.ndarray) -> np.ndarray:
    return (codes ^ (codes >> 11) * np.int32(40503)) & np.int32(SLOTS - 1)


def norms(values: np.ndarray) -> np.ndarray:
    """What a unit's features are divided by; a subsequence that occurs again counts again."""
    return np.sqrt(np.maximum(np.einsum("up,up->u", values, values), 1e-12))


def kernel(units: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel of every unit with every landmark; 0 for units without subsequences."""
    lc, lv = subsequences(landmarks)
    lv = lv / norms(lv)[:, None]
    columns = np.unique(lc[lc > 0])
    table = np.zeros((len(columns) + 1, len(landmarks)), np.float32)
    rows, places = np.nonzero(lc)
    np.add.at(table, (np.searchsorted(columns, lc[rows, places]), rows), lv[rows, places])
    out = np.zeros((len(units), len(landmarks)), np.float32)
    for at in range(0, len(units), 256):
        c, v = subsequences(units[at : at + 256])
        v = v / norms(v)[:, None]
        found = np.searchsorted(columns, c)
        found = np.where((c > 0) & (columns[np.minimum(found, len(columns) - 1)] == c), found, len(columns))
        for i in range(len(c)):
            on = found[i] < len(columns)
            out[at + i] = v[i, on] @ table[found[i, on]]
    return out


def units_of(text: str) -> set[str]:
    """The distinct units of a text: lower-cased words, and runs of three or more single letters joined."""
    plain = text.lower().replace(".", " ").replace(",", " ").replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("!", " ")
    words = set(plain.split(" "))
    if any(len(w) == 1 for w in words):
        words.update(m.replace(" ", "") for m in _SINGLES.findall(plain))
    words.discard("")
    return words


def pieces(unit: str) -> list[str]:
    step = PIECE - 2 * SPAN
    return [unit] if len(unit) <= PIECE else [unit[i : i + PIECE] for i in range(0, len(unit) - 2 * SPAN, step)]


@dataclass
class KernelMachine:
    """The machine in primal form: `table[slot(code)]` is the weight of a subsequence, which sums all landmarks' parts."""

    table: np.ndarray
    bias: float
    slope: float = 6.0
    shift: float = 0.0

    def __post_init__(self) -> None:
        self.name = hashlib.sha256(self.table.tobytes() + str(self.bias).encode()).digest()

    @property
    def kept(self) -> dict[str, float]:
        """Decisions this worker has made, for one machine at a time."""
        if self.name not in _KEPT:
            _KEPT.clear()
            _KEPT[self.name] = {}
        return _KEPT[self.name]

    def decide(self, units: Iterable[str]) -> dict[str, float]:
        """Decisions, positive for insults; a unit in pieces has that of its worst piece."""
        parts = [(p, u) for u in units for p in pieces(u)]
        parts.sort(key=lambda x: len(x[0]))
        out: dict[str, float] = {}
        for at in range(0, len(parts), 1024):
            some = parts[at : at + 1024]
            c, v = subsequences([p for p, _ in some])
            f = np.einsum("up,up->u", self.table[slot(c)], v) / norms(v) + self.bias
            for (_, u), x in zip(some, f.tolist(), strict=True):
                if x > out.get(u, -math.inf):
                    out[u] = x
        return out

    def worst(self, texts: list[str]) -> list[float]:
        """The largest decision over each text's units; that of the bias where there are none."""
        bags = [units_of(t) for t in texts]
        kept = self.kept
        new = set().union(*bags).difference(kept)
        found = self.decide(new)
        if len(kept) + len(found) <= MOST_KEPT:
            kept.update(found)
            look = kept
        else:
            look = found | {u: kept[u] for b in bags for u in b if u in kept}
        return [max(map(look.__getitem__, b), default=min(self.bias, -1.0)) for b in bags]

    def score(self, texts: list[str]) -> list[float]:
        x = self.slope * (np.array(self.worst(texts)) - self.shift)
        return (1 / (1 + np.exp(-np.clip(x, -40, 40)))).tolist()


def fit_svm(z: np.ndarray, y: np.ndarray, c: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, by Newton steps over the active rows."""
    x = np.concatenate([z, np.ones((len(z), 1))], axis=1).astype(np.float64)
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w, f = np.zeros(x.shape[1]), np.zeros(len(x))
    loss = float(c.sum())
    for _ in range(rounds):
        active = y * f < 1
        a = x[active] * c[active, None]
        step = np.linalg.solve(ridge + a.T @ x[active], a.T @ y[active]) - w
        f_step, rate, before = x @ step, 1.0, loss
        while rate > 1e-4:
            to = w + rate * step
            loss = float(to @ ridge @ to + (c * np.maximum(0, 1 - y * (f + rate * f_step)) ** 2).sum())
            if loss < before:
                w, f = to, f + rate * f_step
                break
            rate /= 2
        if before - loss < 1e-6 * before:
            break
    return w


def spread(units: list[str], most: int) -> list[str]:
    """Up to `most` units that are far from each other under the kernel, each the farthest from those before."""
    if len(units) <= most:
        return units
    k = kernel(units, units)
    near, out = k[:, 0].copy(), [0]
    while len(out) < most:
        at = int(np.argmin(near))
        out.append(at)
        near = np.maximum(near, k[:, at])
    return [units[i] for i in out]


def sentences(text: str) -> list[str]:
    return [s for s in re.split(r"[.!?\n]+", text) if s.strip()]


def primal(marks: list[str], share: np.ndarray, bias: float) -> KernelMachine:
    """The machine whose decision is the sum of each landmark's kernel times its share, plus the bias."""
    codes, values = subsequences(marks)
    table = np.zeros(SLOTS)
    np.add.at(table, slot(codes).ravel(), (values / norms(values)[:, None] * share[:, None]).ravel())
    table[0] = 0
    return KernelMachine(table.astype(np.float32), bias)


def fit_kernel_machine(rows: list[tuple[str, int]], landmarks: int = 400, negatives: int = 6000, rounds: int = 3, frequent: int = 20_000, ordinary: int = 150_000, witnesses: int = 1200) -> KernelMachine:
    """Fit on labelled texts, sentence by sentence.

    First witnesses are units that positive texts hold too often for chance and clean ones never. Each round
    adds, for positive texts without one, the worst unit of their sentences if the machine calls it an insult,
    and the clean units that it errs on. A quarter of the texts is left out, to place the score's curve.

    `rows` is a bounded sample, and so is what the fit makes of it, whatever the table's size: `landmarks` units span the
    machine's space; of clean units, `negatives` take part from the start and as many are added a round, found among the
    `frequent` commonest and `ordinary` others by hash; landmarks of positive texts are chosen among `witnesses` units, which
    keeps their kernel's square small. Scoring has no such bounds. Without positive or clean rows nothing is an insult.
    """
    tested = [r for r in rows if hash_of(r[0]) % 4 == 0]
    rows = [r for r in rows if hash_of(r[0]) % 4]
    pos, neg = [t for t, y in rows if y], [t for t, y in rows if not y]
    silent = KernelMachine(np.zeros(SLOTS, np.float32), -1.0)
    if not pos:
        return silent
    of_pos, of_neg = Counter(u for t in pos for u in units_of(t)), Counter(u for t in neg for u in units_of(t))
    chance = math.log(max(len(of_pos) + len(of_neg), 2)) / math.log((len(pos) + max(len(neg), 1)) / len(pos))
    clean = [u for u in sorted(of_pos, key=lambda u: (-of_pos[u], u)) if u not in of_neg and len(u) >= 3]
    strong = [u for u in clean if of_pos[u] >= chance] or clean[:10]
    if not strong or not of_neg:
        return silent
    often = sorted(of_neg, key=lambda u: (-of_neg[u], u))[:frequent]
    checked = [*often, *sorted(of_neg, key=hash_of)[:ordinary]]
    plain = [u[:PIECE] for u in dict.fromkeys([*often[: negatives // 2], *sorted(of_neg, key=hash_of)[: negatives // 2]])]
    fixed = set(strong)
    bags = [b for t in pos if not fixed & units_of(t) for b in [{u for s in sentences(t) for u in units_of(s) if u not in of_neg}] if b]
    suspects = {u for b in bags for u in b}
    found, hard = [], []
    for _ in range(rounds):
        marks = spread([u[:PIECE] for u in [*strong, *found][:witnesses]], landmarks // 2)
        marks += (hard or plain)[: landmarks - len(marks)]
        value, vector = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
        root = vector[:, value > 1e-6] / np.sqrt(value[value > 1e-6])
        good = dict.fromkeys(u[:PIECE] for u in [*strong, *found])
        units = [*good, *dict.fromkeys(u for u in [*plain, *hard] if u not in good)]
        y = np.where(np.arange(len(units)) < len(good), 1.0, -1.0)
        cost = np.array([10.0 * (math.sqrt(of_pos[u] + 1) if s > 0 else 1 + math.log1p(of_neg[u])) for u, s in zip(units, y, strict=True)])
        w = fit_svm(kernel(units, marks) @ root, y, cost)
        out = primal(marks, root @ w[:-1], float(w[-1]))
        seen = out.decide(suspects)
        found = sorted({max(b, key=lambda u: (seen[u], u)) for b in bags if max(seen[u] for u in b) > 0})
        wrong = out.decide(checked)
        hard = list(dict.fromkeys([*hard, *(u[:PIECE] for u in sorted((u for u in wrong if wrong[u] > -0.6), key=lambda u: (-wrong[u], u))[:negatives])]))
    worst, label = np.array(out.worst([t for t, _ in tested])), np.array([y for _, y in tested])
    if len(set(label.tolist())) < 2:
        return out
    out.slope, out.shift = platt(worst, label)
    return out


def hash_of(unit: str) -> int:
    return zlib.crc32(unit.encode("utf-8", "replace"))


def platt(x: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Slope and shift of a logistic curve through decisions, by Newton steps with a ridge; the slope stays in 1 to 20; targets keep off 0 and 1 by the number of rows."""
    a, b = 4.0, 0.0
    y = np.where(y == 1, 1 - 1 / (y.sum() + 2), 1 / ((y == 0).sum() + 2))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        g = np.array([(x * (p - y)).sum() + 0.02 * (a - 4), (p - y).sum() + 0.02 * b])
        h = p * (1 - p)
        m = np.array([[(h * x * x).sum() + 0.02, (h * x).sum()], [(h * x).sum(), h.sum() + 0.02]])
        d = np.linalg.solve(m, g)
        step = min(1.0, 2.0 / max(float(np.abs(d).max()), 1e-9))
        a, b = a - step * d[0], b - step * d[1]
        if np.abs(d).max() < 1e-6:
            break
    a = float(np.clip(a, 1.0, 20.0))
    return a, -b / a


def fit_toxicity(docs: DataFrame, labels: DataFrame, most: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> KernelMachine:
    """Fit on up to `most` labelled documents of either class, of at most 20,000 code points each, none of the held-out fifth; `fit_kernel_machine` has the other bounds."""
    return fit_kernel_machine(labelled_sample(docs, labels, "toxic", most, id_col=id_col, text_col=text_col)[0])


def score_toxicity(docs: DataFrame, model: KernelMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: `doc_id, score` (0 to 1, higher is worse), the worst unit of the whole text deciding.

    Null, empty and unit-less texts get the score of no evidence. Repeated rows repeat; null ids pass through;
    other columns are ignored; an empty table gives no rows. Memory follows an Arrow batch and `MOST_KEPT`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score([t or "" for t in b.column(1).to_pylist()]), pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def classify_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, most: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: `doc_id, held_out, score, predicted`.

    A text without units (null, empty, white space only) scores as one whose worst unit is no insult at all: near 0, and never
    1. Repeated rows repeat; null ids pass through and count as empty text in the held-out fifth; other columns are ignored; an
    empty table gives no rows, and without labels every score is low.
    """
    scored = score_toxicity(docs, fit_toxicity(docs, labels, most, id_col, text_col), id_col, text_col)
    return scored.select("doc_id", (id_bucket("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
