"""Scalar functions on text, paths, durations and numbers, as column expressions.

Lengths, cuts and edit distance work on UTF-8 bytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .distance import distances

#: Stands for an unknown time where times are compared.
ZERO_TIME = "0001-01-01 00:00:00"


def blank_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def byte_view(c: Column) -> Column:
    """One character for each byte."""
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def truncate(c: Column, n: int) -> Column:
    """At most `n` bytes, then an ellipsis; a character that is cut becomes U+FFFD."""
    cut = F.expr("1") if n < 0 else F.make_valid_utf8(F.substring(c.cast("binary"), 1, n).cast("string"))
    return F.when(F.octet_length(c) <= n, c).otherwise(F.concat(cut, F.lit("…")))


def similarity(a: Column, b: Column, most: int = 4096) -> Column:
    """1 minus edit distance over the longer length, on the first `most` bytes; 1 if equal, 0 if either is empty. Only those bytes leave the JVM."""
    x, y = F.substring(a.cast("binary"), 1, most), F.substring(b.cast("binary"), 1, most)
    alike = 1 - distances(x, y) / F.greatest(F.length(x), F.length(y))
    return F.when(a == b, F.lit(1.0)).when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(alike)


def more_similar(a: Column, b: Column, than: float, most: int = 4096) -> Column:
    """Whether `similarity` is above `than`. The JVM fills only the band of distances that allow it, and none where the lengths do not."""
    x, y = F.substring(byte_view(a), 1, most), F.substring(byte_view(b), 1, most)
    longer, shorter = F.greatest(F.length(x), F.length(y)), F.least(F.length(x), F.length(y))
    near = F.levenshtein(x, y, int((1 - than) * most) + 1)  # -1 if farther
    within = F.when(1 - (longer - shorter) / longer <= than, F.lit(-1)).otherwise(near)
    return F.when(a == b, F.lit(than < 1)).when((F.length(a) == 0) | (F.length(b) == 0), F.lit(than < 0)).otherwise((within >= 0) & (1 - within / longer > than))


def base_name(path: Column) -> Column:
    """The last part of a path; `.` for an empty one, `/` for slashes only."""
    bare = F.regexp_replace(path, "/+$", "")
    return F.when(path == "", F.lit(".")).when(bare == "", F.lit("/")).otherwise(F.regexp_extract(bare, "[^/]*$", 0))


def human_tokens(n: Column) -> Column:
    """Thousands rounded half to even, with a k; smaller numbers as they are."""
    return F.when(n >= 1000, F.concat(F.bround(n / 1000, 0).cast("long").cast("string"), F.lit("k"))).otherwise(n.cast("string"))


def human_duration(seconds: Column, unknown: str = "unknown duration", minutes: str = " min", hours: str = "h ", rest: str = "m") -> Column:
    whole = F.floor(seconds / 60)
    long = F.concat(F.floor(whole / 60).cast("string"), F.lit(hours), F.lpad((whole % 60).cast("string"), 2, "0"), F.lit(rest))
    return F.when(seconds.isNull() | (seconds <= 0), F.lit(unknown)).when(whole < 60, F.concat(whole.cast("string"), F.lit(minutes))).otherwise(long)


def short_duration(seconds: Column) -> Column:
    return human_duration(seconds, "-", "m", "h", "m")


def human_size(n: Column) -> Column:
    mb, kb = F.format_string("%.1f MB", F.bround(n / 1048576, 1)), F.concat(F.bround(n / 1024, 0).cast("long").cast("string"), F.lit(" KB"))
    return F.when(n >= 1048576, mb).when(n >= 1024, kb).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def one_line(c: Column) -> Column:
    return truncate(F.replace(c, F.lit("\n"), F.lit(" ⏎ ")), 200)


def listing_prompt(c: Column) -> Column:
    return F.replace(truncate(c, 60), F.lit("\n"), F.lit(" "))


#: Signs with an escape of their own in quoted text.
ESCAPES = {"\a": "\\a", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\v": "\\v"}
_UNPRINTED = r"[\p{C}\p{Z}&&[^ ]]"


def quoted(c: Column) -> Column:
    """In double quotes; quotes, backslashes and signs that do not print are escaped, the latter by number where they have no escape of their own."""
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for sign, name in ESCAPES.items():
        out = F.replace(out, F.lit(sign), F.lit(name))

    def numbered(sign: Column) -> Column:
        n = F.ascii(sign)
        digits = lambda size: F.lpad(F.lower(F.hex(n)), size, "0")
        return F.when(~sign.rlike(_UNPRINTED), sign).when(n < 128, F.concat(F.lit("\\x"), digits(2))).when(n < 65536, F.concat(F.lit("\\u"), digits(4))).otherwise(F.concat(F.lit("\\U"), digits(8)))

    out = F.when(out.rlike(_UNPRINTED), F.array_join(F.transform(F.split(out, ""), numbered), "")).otherwise(out)
    return F.concat(F.lit('"'), out, F.lit('"'))


def parse_time(c: Column) -> Column:
    """RFC 3339 with an offset; anything else is null."""
    return F.when(c.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"), F.try_to_timestamp(c))


def trimmed(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"^[\s\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+|[\s\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+$", "")


def project_key(cwd: Column) -> Column:
    """The folder name that stands for a working directory: every sign but letters and digits becomes a dash."""
    return F.regexp_replace(cwd, "[^A-Za-z0-9]", "-")
