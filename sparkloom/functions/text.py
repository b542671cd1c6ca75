"""Alignment that forgives white space, which needs Python."""

from __future__ import annotations

import re
from itertools import zip_longest

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

GAP = re.compile(r"(\s*)(\S?)")


def aligned(raw: str | None, spanned: str | None, most: int = 4) -> str | None:
    """The start of spanned that covers raw, if the two differ by no more than so many white-space characters; else null.

    Both are read as gaps of white space, each before one other character. In a gap as many characters as can be are paired in
    order; the others count as differences, but not what spanned holds beyond raw's last gap.
    """
    if raw is None or spanned is None:
        return None
    used = off = 0
    for (gap, mark), (other, its) in zip_longest(GAP.findall(raw), GAP.findall(spanned), fillvalue=("", "")):
        paired = 0
        for c in gap:
            paired += other[paired : paired + 1] == c
        off += len(gap) - paired
        if not mark:
            used += paired
            break
        if mark != its:
            return None
        off += len(other) - paired
        used += len(other) + 1
    return spanned[:used] if off <= most else None


@F.pandas_udf(T.StringType())
def aligned_udf(raw: pd.Series, spanned: pd.Series) -> pd.Series:
    return pd.Series([aligned(a, b) for a, b in zip(raw, spanned)], dtype=object)
