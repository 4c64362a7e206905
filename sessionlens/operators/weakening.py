"""How an edit weakens tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import rx


def times(text: Column, pattern: str) -> Column:
    """How often a pattern matches; texts without a word that it needs are not put through the regex engine."""
    holds = reduce(Column.__or__, [text.contains(w) for w in P.NEEDED[pattern]])
    return F.when(text.isNull(), F.lit(None).cast("int")).when(holds, rx.count(text, pattern)).otherwise(0)


def total(text: Column, family: tuple[str, ...]) -> Column:
    return reduce(Column.__add__, [times(text, p) for p in family])


def drop(old: Column, new: Column, family: tuple[str, ...]) -> Column:
    return F.greatest(F.lit(0), total(old, family) - total(new, family))


def reasons(old: Column, new: Column) -> Column:
    """What an edit from `old` to `new` takes from the tests, as phrases in order; empty if nothing. Each count stands once, as Spark works it out where it stands."""
    say = lambda n, words: F.struct(n.alias("n"), F.lit(words).alias("words"))
    counted = [say(drop(old, new, P.DECLARATIONS), " test(s) removed"), say(drop(new, old, P.SKIPS), " skip/disable annotation(s) added"), say(drop(old, new, P.ASSERTIONS), " assertion(s) removed")]
    phrases = F.transform(F.filter(F.array(*counted), lambda c: c["n"] > 0), lambda c: F.concat(c["n"].cast("string"), c["words"]))
    weaker = [F.when((times(old, s) > times(new, s)) & (times(new, w) > times(old, w)), F.lit(f"assertion weakened ({d})")) for s, w, d in P.WEAKENINGS]
    return F.concat(phrases, F.array_compact(F.array(*weaker)))
