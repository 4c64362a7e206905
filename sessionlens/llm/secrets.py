"""Secret scans: all rules in one deterministic automaton, one pass over the bytes."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from re import _constants as op
from re import _parser as sre

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")


def either_case(words: tuple[str, ...]) -> str:
    return "|".join(re.sub(r"[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", w) for w in words)


VALUE = "[A-Za-z0-9+/_.=-]"
ASSIGN = rf"(?:{either_case(KEYWORDS)})[\"']?\x20*[:=]\x20*[\"']?"

#: kind -> (pattern, least length, whether that counts only from the first byte on which a match may end).
#: A match that is too short is used up and dropped. Lengths are checked after the run, so the automaton never counts.
RULES: dict[str, tuple[str, int, bool]] = {
    "assign": (f"{ASSIGN}{VALUE}+", 6, True),
    "access": ("AKIA[A-Z0-9]+", 20, False),
    "hex": ("[0-9a-f]+", 24, False),
    "github": ("gh[pousr]_[A-Za-z0-9]+", 40, False),
    "slack": ("xox[abprs]-[A-Za-z0-9-]+", 15, False),
    "pem": ("-----BEGIN [A-Z ]*PRIVATE KEY-----", 27, False),
}
BASE = ("assign", "access", "hex")
#: Segments longer than this are scanned by themselves, byte by byte; shorter ones advance together.
LONG = 2048


class Nfa:
    """Byte transitions and empty moves of the rules' union, from Python's own parse of each pattern."""

    def __init__(self) -> None:
        self.on: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []
        self.accept: dict[int, int] = {}

    def state(self) -> int:
        self.on.append([])
        self.free.append([])
        return len(self.on) - 1

    def add(self, tree: list, at: int) -> int:
        for kind, x in tree:
            if kind is op.LITERAL:
                at = self.step(at, frozenset([x]))
            elif kind is op.IN:
                chars: set[int] = set()
                for k, v in x:
                    chars |= {v} if k is op.LITERAL else set(range(v[0], v[1] + 1))
                at = self.step(at, frozenset(chars))
            elif kind is op.SUBPATTERN:
                at = self.add(x[-1], at)
            elif kind is op.BRANCH:
                end = self.state()
                for branch in x[1]:
                    self.free[self.add(branch, at)].append(end)
                at = end
            elif kind is op.MAX_REPEAT:
                low, high, inner = x
                for _ in range(low):
                    at = self.add(inner, at)
                if high is op.MAXREPEAT:
                    loop = self.state()
                    self.free[at].append(loop)
                    self.free[self.add(inner, loop)].append(loop)
                    at = loop
                else:
                    end = self.state()
                    for _ in range(high - low):
                        self.free[at].append(end)
                        at = self.add(inner, at)
                    self.free[at].append(end)
                    at = end
            else:
                raise ValueError(f"a rule uses {kind}, which the automaton has no form for")
        return at

    def step(self, at: int, chars: frozenset[int]) -> int:
        if max(chars) > 127:
            raise ValueError("rules are over ASCII bytes")
        to = self.state()
        self.on[at].append((chars, to))
        return to

    def closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


def dfa(nfa: Nfa, start: int, samples: list[int], restart: bool) -> tuple[np.ndarray, np.ndarray]:
    """Moves (states x byte classes) and accepted rules of each state, by subset construction and minimisation; 0 is the start.

    With `restart` a rule may begin at any byte, else only at the first.
    """
    first = nfa.closure({start})
    number, todo, rows = {first: 0}, [first], []
    while todo:
        now, row = todo.pop(0), []
        for b in samples:
            to = nfa.closure({t for s in now for chars, t in nfa.on[s] if b in chars} | ({start} if restart else set()))
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        rows.append(row)
    table = np.array(rows)
    accepts = np.array([sum({nfa.accept[s] for s in states if s in nfa.accept}) for states in number])
    block = np.unique(accepts, return_inverse=True)[1]
    while True:  # states stay together while they accept alike and move to blocks alike
        after = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
        if after.max() == block.max():
            break
        block = after
    names = np.unique(block[np.argsort(block != block[0], kind="stable")], return_index=True)
    order = np.concatenate(([block[0]], [k for k in names[0] if k != block[0]])).astype(int)
    place = np.argsort(order)
    one = np.array([np.flatnonzero(block == k)[0] for k in order])
    return place[block[table[one]]], accepts[one]


class Automaton:
    """All rules as one deterministic automaton over byte classes, in transition arrays.

    `moves[state * width + class_of[byte]]` is the next state of the scan, in which a rule may begin at any byte,
    and `accepts[state]` the rules that match up to here. `rows` is the same automaton begun at one place only,
    `ends` its accepted rules and `live` those it may still come to. A byte that leads every state of the scan back to the start is a
    sync byte: no match contains it, so text splits there.
    """

    def __init__(self, rules: dict[str, tuple[str, int, bool]]):
        if len(rules) > 31:
            raise ValueError("31 rules at most go into one automaton")
        nfa = Nfa()
        start = nfa.state()
        for i, rule in enumerate(rules.values()):
            nfa.accept[nfa.add(list(sre.parse(rule[0])), start)] = 1 << i
        sets = {chars for moves in nfa.on for chars, _ in moves}
        signature = [tuple(b in s for s in sets) for b in range(256)]
        kinds = {s: i for i, s in enumerate(dict.fromkeys(signature))}
        self.class_of = np.array([kinds[s] for s in signature], np.uint8)
        self.classes, self.width = self.class_of.tobytes(), len(kinds)
        samples = [signature.index(s) for s in kinds]

        scan, accepts = dfa(nfa, start, samples, restart=True)
        self.states, self.moves, self.accepts = len(scan), scan.astype(np.int32).ravel(), accepts.astype(np.int32)
        self.sync = ((scan == 0).all(axis=0) & (accepts[0] == 0))[self.class_of]
        self.scan_rows, self.scan_accepts = scan.tolist(), accepts.tolist()

        anchored, ends = dfa(nfa, start, samples, restart=False)
        live = ends.copy()
        while True:
            after = live | np.bitwise_or.reduce(live[anchored], axis=1)
            if (after == live).all():
                break
            live = after
        self.rows, self.ends, self.live = anchored.tolist(), ends.tolist(), live.tolist()
        opens = live[anchored[0]]  # rules that a byte class may begin
        self.begins = [re.compile(b"[" + re.escape(bytes(c for c in range(self.width) if opens[c] >> i & 1)) + b"]") for i in range(len(rules))]
        self.limits = [(least, tail) for _, least, tail in rules.values()]
        self.steady = [(1 << i, least) for i, (_, least, _) in enumerate(rules.values()) if self.at_every_byte(1 << i, anchored, ends, live)]
        self.others = ~sum(bit for bit, _ in self.steady)

    @staticmethod
    def at_every_byte(bit: int, anchored: np.ndarray, ends: np.ndarray, live: np.ndarray) -> bool:
        """Whether a rule that has begun may end at every byte from its first on, so that a match is a run of accepting bytes."""
        on = np.flatnonzero(live & bit)
        to = anchored[on]
        return bool(((live[to] & bit == 0) | (ends[to] & bit != 0)).all())

    def hits(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segments (start, end, rules accepted within) of `data` that hold a match, in one pass. `bounds`: where texts start, and the end.

        Texts are cut at sync bytes. All segments advance together, one byte at a time, longest first; long ones
        are stepped through alone.
        """
        after = np.flatnonzero(self.sync[data]) + 1
        after = after[(after < len(data)) & (data[np.minimum(after, len(data) - 1)] & 0xC0 != 0x80)]  # never within a character
        cuts = np.unique(np.concatenate([bounds, after]))
        start, size = cuts[:-1].astype(np.int64), np.diff(cuts)
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        found = np.zeros(len(start), np.int32)
        lone = int(np.searchsorted(-size, -LONG))  # segments longer than LONG
        for i in range(lone):
            state, seen = 0, 0
            rows, accepts = self.scan_rows, self.scan_accepts
            for c in data[start[i] : start[i] + size[i]].tobytes().translate(self.classes):
                state = rows[state][c]
                seen |= accepts[state]
            found[i] = seen
        kind, state, at = self.class_of[data], np.zeros(len(start) - lone, np.int32), start[lone:]
        falling, own = -size[lone:], found[lone:]
        runs = [np.zeros(len(at), np.int32) for _ in self.steady]
        for t in range(int(size[lone]) if len(at) else 0):
            k = int(np.searchsorted(falling, -t))  # segments longer than t
            now = self.moves[state[:k] * self.width + kind[at[:k] + t]]
            state[:k] = now
            accepts = self.accepts[now]
            own[:k] |= accepts & self.others
            for run, (bit, least) in zip(runs, self.steady, strict=True):  # single letters begin such rules, so too short runs are left out here
                run[:k] = (run[:k] + 1) * ((accepts & bit) != 0)
                own[:k] |= np.where(run[:k] >= least, bit, 0).astype(np.int32)
        hit = np.flatnonzero(found)
        hit = hit[np.argsort(start[hit])]
        return start[hit], start[hit] + size[hit], found[hit]

    def spans(self, segment: bytes, rule: int) -> list[tuple[int, int]]:
        """The rule's leftmost longest matches in a segment that do not overlap, too short ones used up and dropped.

        From each byte that may begin one, the automaton runs until it can no longer come to the rule.
        """
        text, out, bit, at = segment.translate(self.classes), [], 1 << rule, 0
        least, tail = self.limits[rule]
        rows, ends, live, begins = self.rows, self.ends, self.live, self.begins[rule]
        while m := begins.search(text, at):
            i = at = m.start()
            state, first, last = 0, -1, -1
            for i in range(at, len(text)):
                state = rows[state][text[i]]
                if not live[state] & bit:
                    break
                if ends[state] & bit:
                    last = i + 1
                    if first < 0:
                        first = i
            if last < 0:
                at += 1
                continue
            if last - (first if tail else at) >= least:
                out.append((at, last))
            at = last
        return out


@functools.lru_cache(maxsize=4)
def build(rules: tuple[tuple[str, tuple[str, int, bool]], ...]) -> Automaton:
    return Automaton(dict(rules))


def spans_in(data: bytes, segments: list[tuple[int, int, int]], kinds: list[str], auto: Automaton) -> list[tuple[int, str, int]]:
    """`(start, kind, end)` in code points of every match in the segments, of the rules that the scan accepted there."""
    out, chars, upto = [], 0, 0
    for lo, hi, mask in segments:
        chars, upto = chars + len(data[upto:lo].decode("utf-8")), lo
        segment = data[lo:hi]
        for i, kind in enumerate(kinds):
            if mask >> i & 1:
                for s, e in auto.spans(segment, i):
                    at = chars + (s if segment.isascii() else len(segment[:s].decode("utf-8")))
                    out.append((at, kind, at + e - s))  # rules are over ASCII: a byte is a code point
    return out


def scan_secrets(docs: DataFrame, rules: dict[str, tuple[str, int, bool]] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: `doc_id, spans array<struct<start,kind,end>>`, by start, then in the order of `rules`.

    Spans are in code points, end exclusive, over whole texts; per kind they are the leftmost longest matches that do
    not overlap, those too short dropped after they are matched. One pass of the combined automaton finds the
    stretches that hold a match, and runs of it from there the exact ends. Null and empty texts have no spans; null
    ids pass through and ids repeat as rows do; an empty table gives no rows; other columns are ignored. Memory follows an Arrow batch, never a group.
    """
    frozen, kinds = tuple(rules.items()), list(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = build(frozen)
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                raw = [(t or "").encode("utf-8", "replace") for t in b.column(1).to_pylist()]
                bounds = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
                start, end, found = auto.hits(np.frombuffer(b"".join(raw), np.uint8), bounds)
                of = np.searchsorted(bounds, start, side="right") - 1
                segments: dict[int, list[tuple[int, int, int]]] = {}
                for d, lo, hi, mask in zip(of.tolist(), start.tolist(), end.tolist(), found.tolist(), strict=True):
                    segments.setdefault(d, []).append((lo - int(bounds[d]), hi - int(bounds[d]), mask))
                spans = [sorted(spans_in(raw[d], segments[d], kinds, auto), key=lambda s: (s[0], kinds.index(s[1]))) if d in segments else [] for d in range(len(raw))]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[{"start": s, "kind": k, "end": e} for s, k, e in x] for x in spans], kind)], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<start: bigint, kind: string, end: bigint>>")


def secret_digest(found: DataFrame) -> DataFrame:
    """The digest columns of `scan_secrets`: counts of the base kinds, all spans as text, and a hash of the base ones."""
    say = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(say(base), 256).alias("base_sha256"), say(F.col("spans")).alias("spans"))
