"""Segmentation of label sequences and micro-batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def boundaries(labels: list[str], k: int) -> list[int]:
    """Ends of the best split of labels into k contiguous groups.

    A group costs 100 for each label that is not its commonest; a boundary between equal labels costs 8; and
    each group the square of its length's distance from the mean. Ties go to the least start. The counts of each
    group are kept while its start moves back, so a split takes n * n steps for each of the k groups.
    """
    n = len(labels)
    if not 0 < k <= n:
        raise ValueError("cannot split")
    target = n / k
    costs = [[0.0] * (n + 1) for _ in range(n + 1)]
    for e in range(1, n + 1):
        seen: dict[str, int] = {}
        most = 0
        for s in range(e - 1, -1, -1):
            seen[labels[s]] = now = seen.get(labels[s], 0) + 1
            most = max(most, now)
            costs[e][s] = 100.0 * (e - s - most) + (8 if s and labels[s - 1] == labels[s] else 0) + (e - s - target) ** 2
    total: list[float | None] = [0.0] + [None] * n
    chosen = []
    for _ in range(k):
        ends = [min(((t + costs[e][s], s) for s, t in enumerate(total[:e]) if t is not None), default=None) for e in range(n + 1)]
        chosen.append([x and x[1] for x in ends])
        total = [x and x[0] for x in ends]
    out, e = [], n
    for starts in reversed(chosen):
        out.append(e)
        e = starts[e]
    return out[::-1]


def segment_udf(least: int = 2, most: int = 6):
    """Array of group ends for an array of labels: min(most, n) groups, null below least."""

    @F.pandas_udf("array<int>")
    def run(labels: pd.Series) -> pd.Series:
        return labels.map(lambda x: boundaries(list(x), min(most, len(x) // 2 or 1)) if x is not None and len(x) >= least else None)

    return run


def batches(items: list[tuple[int, int]], cells: int, targets: int) -> list[list[int]]:
    """Longest first; a batch is closed by the item that would make it too large, and never opened again.

    items: length and targets of each. A batch of n items of at most length m takes n * m cells. An item that is too large by
    itself is a batch of its own.
    """
    out: list[list[int]] = []
    room = 0
    for k in sorted(range(len(items)), key=lambda k: -items[k][0]):
        # the first item of a batch is its longest
        if not out or (len(out[-1]) + 1) * items[out[-1][0]][0] > cells or items[k][1] > room:
            out.append([])
            room = targets
        out[-1].append(k)
        room -= items[k][1]
    return out


def batched(df: DataFrame, keys: list[str], length: str, targets_of: str, order: str, cells: int, targets: int) -> DataFrame:
    """df with batch, from 0 in each group of keys; a group is one step's items and is packed in one task. Ties go by `order`."""
    kind = T.StructType([*df.schema.fields, T.StructField("batch", T.IntegerType())])

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(order, kind="stable").reset_index(drop=True)
        number = [0] * len(t)
        for n, held in enumerate(batches(list(zip(t[length].tolist(), t[targets_of].tolist(), strict=True)), cells, targets)):
            for k in held:
                number[k] = n
        return t.assign(batch=pd.Series(number, dtype="int32"))

    return df.groupBy(*keys).applyInPandas(run, kind)
