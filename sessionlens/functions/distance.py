"""Edit distance on bytes, bit-parallel: a column of the table of distances is two long integers, its steps up and down."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns between two cuts of the bits that shifts push over the end; those bits never reach the ones below.
COLUMNS = 64


def edit_distance(a: bytes, b: bytes) -> int:
    """Fewest insertions, deletions and changes of a byte between `a` and `b`, in memory linear in both.

    Bit i of `up` (`down`) says that the distance grows (shrinks) by one from row i - 1 to row i, rows being bytes of the longer
    side. A column follows from the one before in fifteen operations on whole integers, the sum's carries passing matches
    down, so a step costs as many words as the side has; the last column's steps add up to the distance.
    """
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    found = sorted(set(b))
    marks = np.packbits(np.frombuffer(a, np.uint8) == np.array(found, np.uint8)[:, None], axis=1, bitorder="little")
    places = {c: int.from_bytes(row.tobytes(), "little") << 1 for c, row in zip(found, marks, strict=True)}
    full = (2 << len(a)) - 1
    up, down, below = full - 1, 0, full - 1  # bit 0 is the row of no bytes, which grows by one a column
    for at in range(0, len(b), COLUMNS):
        for same in map(places.__getitem__, b[at : at + COLUMNS]):
            flat = ((same & up) + up ^ up) | same | down
            right = (down | full ^ (flat | up)) << 1
            up, down = (up & flat) << 1 | below ^ (flat | right), right & flat
        up &= full
        down &= full
    return len(b) + up.bit_count() - down.bit_count()


@F.pandas_udf(T.IntegerType())
def distances(a: pd.Series, b: pd.Series) -> pd.Series:
    """`edit_distance` of two binary columns; null if either is."""
    return pd.Series([None if x is None or y is None else edit_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")
