"""Session logs as lines of JSON: discovery, scan, and strict but tolerant decoding.

Files are read in splits, so a long log is many tasks' work; lines get their numbers from counts over splits. A line
that is not JSON, or has a field of the wrong type, is malformed: counted, never fatal. Only the fields that are used
are looked at. Ordinary lines are decoded by column expressions on variants. A small Arrow function decodes what those
cannot: names in other letter case or twice in an object, escapes that may hide a name or half a character, and what does not parse.
Decoded lines are written once, as all that follows reads them several times.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import project_key
from .tables import written

BLOCK = "struct<type: string, text: string, id: string, name: string, input: string, tool_use_id: string>"
DECODED = f"""struct<type: string, subtype: string, uuid: string, timestamp: string, sessionId: string, cwd: string, gitBranch: string, version: string,
isSidechain: boolean, isMeta: boolean, isCompactSummary: boolean, compacts: boolean, has_message: boolean, message_id: string,
content: string, content_text: string, blocks: array<{BLOCK}>,
usage: struct<input: bigint, output: bigint, cache_creation: bigint, cache_read: bigint>>"""

_LINE = {**dict.fromkeys(("type", "subtype", "uuid", "timestamp", "sessionId", "cwd", "gitBranch", "version"), str), **dict.fromkeys(("isSidechain", "isMeta", "isCompactSummary"), bool)}
_USAGE = {"input_tokens": "input", "output_tokens": "output", "cache_creation_input_tokens": "cache_creation", "cache_read_input_tokens": "cache_read"}
_BLOCK = dict.fromkeys(("type", "text", "id", "name", "tool_use_id"), str)
_USED = {*_LINE, *_USAGE, *_BLOCK, "compactMetadata", "message", "role", "usage", "content", "input"}


class Mismatch(ValueError):
    """A field of the wrong type."""


def _no(name: str) -> None:
    raise Mismatch(name)


def other_case(obj: dict) -> dict:
    """What an object has under names that are not spelled as the used ones are, by lower-cased name; the first counts."""
    odd = obj.keys() - _USED
    return {k.lower(): obj[k] for k in reversed(obj) if k in odd} if odd else {}


def field(obj: dict, other: dict, name: str, kind: type | None):
    """A field by name, or by name in other letter case; null counts as left out. Raises on another type."""
    value = obj[name] if name in obj else other.get(name.lower())
    if value is not None and kind is not None and type(value) is not kind:
        raise Mismatch(name)
    return value


def decode_line(line: str) -> dict | None:
    """The used fields of a line, or None if it is malformed."""
    try:
        obj = json.loads(line, parse_constant=_no)
        if obj is None:
            obj = {}
        if not isinstance(obj, dict):
            return None
        other = other_case(obj)
        out = {k: field(obj, other, k, t) for k, t in _LINE.items()}
        out["compacts"] = "compactMetadata" in obj or "compactmetadata" in other
        message = field(obj, other, "message", dict)
        out["has_message"] = message is not None
        if message is not None:
            other = other_case(message)
            out["message_id"] = field(message, other, "id", str)
            field(message, other, "role", str)
            usage = field(message, other, "usage", dict)
            if usage is not None:
                out["usage"] = {to: field(usage, other_case(usage), name, int) or 0 for name, to in _USAGE.items()}
                if not all(-(1 << 63) <= n < 1 << 63 for n in out["usage"].values()):
                    return None
            out |= decode_content(message, other)
        return out
    except (ValueError, RecursionError):
        return None


def decode_content(message: dict, other: dict) -> dict:
    """What the content is (text, blocks, null, missing or other), and its text or blocks."""
    if "content" not in message and "content" not in other:
        return {"content": "missing"}
    content = field(message, other, "content", None)
    if content is None:
        return {"content": "null"}
    if isinstance(content, str):
        return {"content": "text", "content_text": content}
    try:
        if not isinstance(content, list) or not all(b is None or isinstance(b, dict) for b in content):
            return {"content": "other"}
        blocks = []
        for b in content:
            b = b or {}
            other = other_case(b)
            raw = field(b, other, "input", None)
            blocks.append({k: field(b, other, k, t) for k, t in _BLOCK.items()} | {"input": None if raw is None else json.dumps(raw, ensure_ascii=False)})
        return {"content": "blocks", "blocks": blocks}
    except Mismatch:
        return {"content": "other"}


def well_formed(x):
    """Strings without lone surrogates, each of which becomes U+FFFD."""
    if isinstance(x, str):
        return x.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    if isinstance(x, dict):
        return {k: well_formed(v) for k, v in x.items()}
    return [well_formed(v) for v in x] if isinstance(x, list) else x


#: Ends the object that a line is set into, so that what follows a line's own value shows.
_END = "\u2063end"
_NAMES = "|".join(sorted(_USED))
#: Escapes of letters in names, and of half characters.
_ESCAPES = r"\\u(?:00[4-7]|[dD][89a-fA-F])"


def _part(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _is(v: Column, kind: str) -> Column:
    """A field is of a kind, null or left out."""
    return F.coalesce(F.schema_of_variant(v).isin(kind, "VOID"), F.lit(True))


def _object(v: Column) -> Column:
    return _part(v, "$", "map<string,variant>")


def _is_object(v: Column) -> Column:
    return v.isNull() | F.is_variant_null(v) | _object(v).isNotNull()


def _text(v: Column) -> Column:
    return _part(v, "$", "string")


def decoded_natively(value: Column) -> tuple[Column, Column]:
    """`(odd, line)` of a line's text: whether it must be decoded otherwise, and the struct, null where malformed."""
    whole = F.try_parse_json(F.concat(F.lit('{"v":'), value, F.lit(f',"{_END}":1}}')))
    other_case = F.regexp_count(value, F.lit(f'(?iu)"(?:{_NAMES})"[ \t\r\n]*:')) > F.regexp_count(value, F.lit(f'"(?:{_NAMES})"[ \t\r\n]*:'))
    odd = whole.isNull() | (_part(whole, f"$['{_END}']", "int").isNull()) | other_case | value.rlike(_ESCAPES)
    v = _part(whole, "$.v", "variant")
    top = F.coalesce(_object(v), F.create_map().cast("map<string,variant>"))
    message = top["message"]
    inner = F.coalesce(_object(message), F.create_map().cast("map<string,variant>"))
    content, usage = inner["content"], inner["usage"]
    counts = F.coalesce(_object(usage), F.create_map().cast("map<string,variant>"))
    fits = [_is_object(v), *(_is(top[k], "STRING" if t is str else "BOOLEAN") for k, t in _LINE.items()), _is_object(message), _is(inner["id"], "STRING"), _is(inner["role"], "STRING"), _is_object(usage), *(_is(counts[k], "BIGINT") for k in _USAGE)]
    has_message = message.isNotNull() & ~F.is_variant_null(message)
    blocks = _part(content, "$", "array<variant>")
    of_block = lambda b: F.coalesce(_object(b), F.create_map().cast("map<string,variant>"))
    good_blocks = F.forall(blocks, lambda b: reduce(Column.__and__, (_is(of_block(b)[k], "STRING") for k in _BLOCK), _is_object(b)))
    raw = lambda b: of_block(b)["input"]
    read_blocks = F.transform(blocks, lambda b: F.struct(*[(F.when(~F.is_variant_null(raw(b)), F.to_json(raw(b))) if k == "input" else _text(of_block(b)[k])).alias(k) for k in ("type", "text", "id", "name", "input", "tool_use_id")]))
    is_text = F.schema_of_variant(F.when(blocks.isNull(), content)) == "STRING"
    kind = F.when(content.isNull(), "missing").when(F.is_variant_null(content), "null").when(is_text, "text").when(F.coalesce(good_blocks, F.lit(False)), "blocks").otherwise("other")
    used = F.when(usage.isNotNull() & ~F.is_variant_null(usage), F.struct(*[F.coalesce(_part(counts[k], "$", "bigint"), F.lit(0).cast("bigint")).alias(to) for k, to in _USAGE.items()]))
    line = F.struct(
        *[_part(top[k], "$", "string" if t is str else "boolean").alias(k) for k, t in _LINE.items()],
        top["compactMetadata"].isNotNull().alias("compacts"),
        has_message.alias("has_message"),
        _text(inner["id"]).alias("message_id"),
        F.when(has_message, kind).alias("content"),
        F.when(is_text, _text(content)).alias("content_text"),
        F.when(kind == "blocks", read_blocks).alias("blocks"),
        used.alias("usage"),
    )
    return odd, F.when(reduce(Column.__and__, fits), line).cast(DECODED)


def decode_odd(rows: DataFrame) -> DataFrame:
    """`rows` with `line`, the decoded struct, for `value`; null where malformed."""
    kept = rows.drop("value")
    kind = T.DataType.fromDDL(DECODED)
    schema, arrow = T.StructType([*kept.schema.fields, T.StructField("line", kind)]), to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [decode_line(x) for x in b.column(b.num_columns - 1).to_pylist()]
            try:
                line = pa.array(found, arrow)
            except UnicodeEncodeError:
                line = pa.array(well_formed(found), arrow)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], line], [*b.schema.names[:-1], "line"])

    return rows.select(*kept.columns, "value").mapInArrow(run, schema)


def decode(lines: DataFrame) -> DataFrame:
    """`lines` with `blank`, and `line`, the decoded struct, for `value`; null where malformed or blank. Written once, here."""
    # white space as the scan trims it
    rows = lines.withColumn("value", F.regexp_replace("value", r"^[\s\u0085 ]+|[\s\u0085 ]+$", "")).withColumn("blank", F.col("value") == "")
    odd, line = decoded_natively(F.col("value"))
    odd = ~F.col("blank") & odd
    kept = [c for c in rows.columns if c != "value"]
    first = written(rows.select(*kept, F.when(odd, F.col("value")).alias("odd"), F.when(~F.col("blank") & ~odd, line).alias("line")), "lines")
    out = first.where("odd IS NULL").select(*kept, "line")
    if first.where("odd IS NOT NULL").limit(1).count():
        out = out.unionByName(written(decode_odd(first.where("odd IS NOT NULL").select(*kept, F.col("odd").alias("value"))), "odd_lines"))
    return out


def scan_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """`session_path, block, at, value` of session files, read in splits; `at` counts the rows of a split from some number on."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.col("_metadata.file_path").alias("session_path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def number_lines(rows: DataFrame) -> DataFrame:
    """`line_no` for the `block` and `at` of rows that are written: lines of the splits before, and of its own."""
    splits = rows.groupBy("session_path", "block").agg(F.min("at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("session_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = splits.select("session_path", "block", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))  # a row a split
    return rows.join(starts, ["session_path", "block"]).withColumn("line_no", F.col("at") + F.col("_shift")).drop("block", "at", "_shift")


def read_decoded(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """`session_path, line_no, blank, line` of session files."""
    return number_lines(decode(scan_lines(spark, path)))


def list_sessions(spark: SparkSession, root: str, cwd: str | None = None) -> DataFrame:
    """`agent, id, path, modified, size` of the log files of a working directory, or of all, newest first; contents are not read."""
    key = "*" if cwd is None else spark.range(1).select(project_key(F.lit(cwd)).alias("k")).first()["k"]
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load([f"{root}/{key}/*.jsonl", *existing(spark, f"{root}/{key}/sessions")])
    id_ = F.regexp_extract("path", r"([^/]*)\.jsonl$", 1)
    return rows.select(F.lit("jsonl").alias("agent"), id_.alias("id"), "path", F.col("modificationTime").alias("modified"), F.col("length").alias("size")).orderBy(F.desc("modified"), "path")


def existing(spark: SparkSession, glob: str) -> list[str]:
    """`glob` if anything is there."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(glob)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return [glob] if found is not None and len(found) else []


def first_prompts(decoded: DataFrame, most: int = 200) -> DataFrame:
    """`session_path, first_prompt`: the first real prompt with plain text in a file's first `most` lines, before any blank one."""
    from ..operators.predicates import is_real_prompt

    early = decoded.where(F.col("line_no") < most)
    blank = early.where("blank").groupBy("session_path").agg(F.min("line_no").alias("stop"))
    early = early.join(blank, "session_path", "left").where(F.col("stop").isNull() | (F.col("line_no") < F.col("stop"))).drop("stop")
    prompts = early.where("line.type = 'user' AND line.content = 'text'").where(is_real_prompt(F.col("line.content_text")))
    return prompts.groupBy("session_path").agg(F.min_by("line.content_text", "line_no").alias("first_prompt"))
