"""Main text of web pages by differencing each page with its nearest neighbours by URL.

Pages of a host are ordered by URL path; each is compared with up to two pages before and two after it. A line is
its text and its place (the boxes around it, with their class and id), the lines of two pages are aligned by longest
common subsequence, and what over half of these pages share is the site's frame. Frame lines go, and a box goes whole
when at least half of its lines are frame, so parts that vary a little go with their box. No class or id has a meaning
of its own; only elements that are never text (`nav`, `form`, `script`, ...) and landmark roles are known by name.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Elements whose content is never text.
DROPPED = frozenset("script style noscript template svg math iframe object canvas audio video head title nav footer aside form button select textarea dialog menu".split())
#: Elements that have no end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stay within a line; every other tag parts lines.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that make a box: lines of one box are judged together.
BOX = frozenset("html body div section article main header ul ol dl table details fieldset center".split())
#: Landmark roles whose elements are no text, as their element names.
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar".split())
_TAG = re.compile(r"<(?:!--.*?(?:-->|$)|[!?][^>]*(?:>|$)|(/?)([a-zA-Z][^\s/>]*))", re.S)
#: What follows a tag's name: with quoted values, and, where a quote never closes, up to the next sign that ends a tag.
_REST, _PLAIN_REST = re.compile(r"((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>"), re.compile(r"([^>]*)>")
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title")}
_NAMED = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_SPACE = re.compile(r"[ \t\n\r\f\v\xa0]+")

#: What the tags around a line say: it is in an article or main element, it is no text, or nothing.
MAIN, PART_OF_FRAME, OPEN = 1, 2, 0
#: What the nearest pages say of a line: most share it; most have its box.
SHARED, BOX_REPEATS = 1, 2
#: Pages compared with on either side.
REACH = 2
#: Boxes told apart by their place; those nested deeper count as part of the last one.
DEPTH = 32


def page_lines(page: str) -> list[tuple[int, tuple[int, ...], str]]:
    """`(mark, boxes, text)` of the lines that may be text, in order; boxes from the outermost, by hash of name, class and id. Character references decoded, white space made one space, empty lines left out."""
    out: list[tuple[int, tuple[int, ...], str]] = []
    stack: list[tuple[str, int, tuple[int, ...]]] = []
    opened: Counter[str] = Counter()
    held: list[str] = []
    mark, at, rest = OPEN, 0, _REST
    boxes: tuple[int, ...] = ()

    def end_line() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(held))).strip(" ") if mark != PART_OF_FRAME else ""
        held.clear()
        if text:
            out.append((mark, boxes, text))

    while True:
        m = _TAG.search(page, at)
        attributes = m and m[2] and (rest.match(page, m.end()) or (rest := _PLAIN_REST).match(page, m.end()))  # an open quote is looked for once
        if m is None or (m[2] and not attributes):
            held.append(page[at:])
            break
        held.append(page[at : m.start()])
        at = attributes.end() if attributes else m.end()
        name, said = (m[2] or "").lower(), attributes[1] if attributes else ""
        if not name:
            continue
        if name in INLINE:
            if name in ("br", "img", "wbr"):
                held.append(" " if name == "br" else "")
            continue
        end_line()
        if m[1]:
            while opened[name]:
                top, *outer = stack.pop()
                opened[top] -= 1
                if top == name:
                    mark, boxes = outer
                    break
            continue
        if name in VOID or said.rstrip().endswith("/"):
            continue
        if name in _RAW:
            close = _RAW[name].search(page, at)
            at = close.end() if close else len(page)
            continue
        if stack and (stack[-1][0] == "p" or stack[-1][0] == name == "li"):  # their end tags may be left out
            top, mark, boxes = stack.pop()
            opened[top] -= 1
        stack.append((name, mark, boxes))
        opened[name] += 1
        named = {k.lower(): (a or b or c) for k, a, b, c in _NAMED.findall(said)} if said else {}
        if name in BOX and len(boxes) < DEPTH:
            boxes = (*boxes, xxhash.xxh64_intdigest(f"{name} {named.get('class', '')} {named.get('id', '')}".encode("utf-8", "replace")))
        if name in DROPPED or (name == "header" and mark != MAIN) or named.get("role", "").lower() in ROLES or (said and _HIDDEN.search(said)):
            mark = PART_OF_FRAME
        elif name in ("article", "main") and mark == OPEN:
            mark = MAIN
    end_line()
    return out


def last_row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequence of `a` with every prefix of `b`."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0)))
    return row


def aligned(a: np.ndarray, b: np.ndarray, cells: int = 1 << 20) -> list[int]:
    """Places in `a` of a longest common subsequence with `b`; tables beyond `cells` are halved, so memory stays linear."""
    if not len(a) or not len(b):
        return []
    if len(a) > 1 and len(a) * len(b) > cells:
        half = len(a) // 2
        cut = int(np.argmax(last_row(a[:half], b) + last_row(a[half:][::-1], b[::-1])[::-1]))
        return aligned(a[:half], b[:cut], cells) + [half + i for i in aligned(a[half:], b[cut:], cells)]
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i, x in enumerate(a):
        up = table[i]
        table[i + 1, 1:] = np.maximum.accumulate(np.maximum(up[1:], np.where(b == x, up[:-1] + 1, 0)))
    out, i, j = [], len(a), len(b)
    while i and j:
        if table[i, j] == table[i - 1, j]:
            i -= 1
        elif table[i, j] == table[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append(i)
    return out[::-1]


def shared_lines(own: list[int], other: list[int]) -> np.ndarray:
    """Which lines of `own` a longest common subsequence with `other` holds; equal ends, and lines only one side has, are set aside first."""
    out = np.zeros(len(own), bool)
    lo, hi, end = 0, len(own), len(other)
    while lo < min(hi, end) and own[lo] == other[lo]:
        out[lo] = True
        lo += 1
    while hi > lo and end > lo and own[hi - 1] == other[end - 1]:
        out[hi - 1] = True
        hi, end = hi - 1, end - 1
    common = set(own[lo:hi]) & set(other[lo:end])
    at = [i for i in range(lo, hi) if own[i] in common]
    for i in aligned(np.array([own[i] for i in at], np.uint64), np.array([x for x in other[lo:end] if x in common], np.uint64)):
        out[at[i]] = True
    return out


def url_key(url: str | None) -> tuple[str, str]:
    """Host and path of a URL; null and unreadable ones are empty."""
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").lower(), parts.path
    except ValueError:
        return "", url or ""


def keyed_pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """`k1, k2, page_id, url, html`; rows of one key are equal, so they may share a decision."""
    cols = [F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")]
    return pages.select(F.xxhash64(*cols).alias("k1"), F.xxhash64(F.lit(1), *reversed(cols)).alias("k2"), *cols)


def digests(page: str | None) -> bytes:
    """Of each line, the hash of its place and text, then that of its place alone; all of the first kind come first."""
    lines = page_lines(page or "")
    places = [xxhash.xxh64_intdigest(np.array(boxes, "<u8").tobytes()) for _, boxes, _ in lines]
    return np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "replace"), p) for (_, _, t), p in zip(lines, places, strict=True)] + places, "<u8").tobytes()


def hashed_lines(keyed: DataFrame) -> DataFrame:
    """`k1, k2, host, path, hashes`: what pairing and aligning need of a page, a few bytes a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                keys = [url_key(u) for u in b.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([h for h, _ in keys], pa.string()), pa.array([p for _, p in keys], pa.string()), pa.array([digests(h) for h in b.column(4).to_pylist()], pa.binary())], ["k1", "k2", "host", "path", "hashes"])

    return keyed.mapInArrow(run, "k1 long, k2 long, host string, path string, hashes binary")


def packed_lines(keyed: DataFrame) -> DataFrame:
    """`k1, k2, page_id, url, body`: the lines that may be text with marks and boxes, deflated for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                bodies = [zlib.compress(json.dumps(page_lines(h or ""), ensure_ascii=False).encode("utf-8", "replace"), 1) for h in b.column(4).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(bodies, pa.binary())], ["k1", "k2", "page_id", "url", "body"])

    return keyed.mapInArrow(run, "k1 long, k2 long, page_id long, url string, body binary")


def in_url_order(parsed: DataFrame, tasks: int) -> DataFrame:
    """`seq, k1, k2, host, path, hashes`, numbered from 0 by host, path and key.

    Rows are range partitioned with the key last, so one host or one URL with very many pages spreads over
    tasks; partitions' sizes, one row each, then give the first number of each.
    """
    order = ["host", "path", "k1", "k2"]
    light = parsed.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    placed = materialize(light.withColumn("at", F.monotonically_increasing_id()), "order")
    part, inside = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a partition
    numbers = sorted(sizes)
    first = zip(numbers, accumulate((sizes[p] for p in numbers), initial=0), strict=False)
    starts = F.broadcast(placed.sparkSession.createDataFrame([(int(p), n) for p, n in first], "part long, first long"))
    return placed.withColumn("part", part.cast("long")).join(starts, "part").select((F.col("first") + inside).alias("seq"), "k1", "k2", "host", "path", "hashes")


def verdicts(own: bytes, others: list[bytes]) -> bytes:
    """Of each line of `own`, whether over half of the `others` share it, and whether over half have its box."""
    lines, places = np.frombuffer(own, "<u8").reshape(2, -1)
    shared, repeats = np.zeros(len(lines), np.int64), np.zeros(len(lines), np.int64)
    for other in others:
        theirs, there = np.frombuffer(other, "<u8").reshape(2, -1)
        shared += shared_lines(lines.tolist(), theirs.tolist())
        repeats += np.isin(places, there)
    return (SHARED * (2 * shared > len(others)) + BOX_REPEATS * (2 * repeats > len(others))).astype(np.uint8).tobytes()


def chosen(lines: list[tuple[int, tuple[int, ...], str]], says: bytes) -> list[str]:
    """The lines that are main text, from marks, boxes and what the nearest pages say of each."""
    want = MAIN if any(mark == MAIN for mark, _, _ in lines) else OPEN
    rows = [(tuple(boxes), text, said) for (mark, boxes, text), said in zip(lines, says.ljust(len(lines), b"\0"), strict=False) if mark == want]
    own: Counter[tuple[int, ...]] = Counter()
    for place, text, said in rows:
        own[place] += len(text) if want == MAIN or not said & SHARED else 0
    body = max(own, key=own.__getitem__, default=())  # the first of those with the most
    total, frame = Counter(place for place, _, _ in rows), Counter(place for place, _, said in rows if said & SHARED)
    if not own[body] or want == MAIN and 2 * frame[body] >= total[body]:  # the nearest pages are copies
        return [text for _, text, _ in rows]
    out = []
    for place, text, said in rows:
        around = body[: len(place)] == place
        slot = want == OPEN and said & BOX_REPEATS and total[place] == 1 and place[: len(body)] != body
        if around and (want == MAIN or not said & SHARED) or not around and not slot and 2 * frame[place] < total[place] and (want == MAIN or not said & SHARED):
            out.append(text)
    return out


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tasks: int | None = None) -> DataFrame:
    """Per row: `page_id, url, text, n_chars`; blocks joined by two newlines, in page order.

    Lines that over half of the nearest pages share are frame. Boxes go when at least half of their lines are frame,
    the body and those around it excepted. In a page with an article or main element only lines inside it count, the
    body is the box with the most text, its frame lines stay, as articles quote each other, and no box goes if half of
    the body is frame (copies side by side). In a page without, the body is the box with the most text that is not
    frame; frame lines go, and so do boxes outside the body that most nearest pages have too and that hold one line
    (a slot for an advert); if every line is frame, all stay.
    A page alone on its host keeps all that its elements allow. Null or empty pages give an empty text; null
    URLs are one host; rows that repeat share one pairing; an empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = keyed_pages(pages, id_col, url_col, html_col)
    order = in_url_order(hashed_lines(keyed).distinct(), tasks)
    beside = F.array(*[F.col("seq") + d for d in range(-REACH, REACH + 1) if d])
    near = order.select(F.explode(beside).alias("seq"), F.struct("host", "hashes").alias("page"))
    both = order.join(near.groupBy("seq").agg(F.collect_list("page").alias("near")), "seq", "left")  # 2 * REACH pages at most
    both = both.select("k1", "k2", "hashes", F.transform(F.filter("near", lambda p: p["host"] == F.col("host")), lambda p: p["hashes"]).alias("near"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            says = [verdicts(own, near or []) for own, near in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(says, pa.binary())], ["k1", "k2", "says"])

    says = both.mapInArrow(compare, "k1 long, k2 long, says binary")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            page, url, bodies, said = (c.to_pylist() for c in b.columns)
            texts = ["\n\n".join(chosen(json.loads(zlib.decompress(z)), x or b"")) for z, x in zip(bodies, said, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(page, pa.int64()), pa.array(url, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = packed_lines(keyed).join(says, ["k1", "k2"], "left").select("page_id", "url", "body", "says")
    return rows.mapInArrow(join, "page_id long, url string, text string, n_chars long")
