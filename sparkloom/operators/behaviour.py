"""What each turn of a trajectory does, units of turns and groups of units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import shell
from sparkloom.operators.groups import segment_udf


def labels(turns: Column, words: tuple[str, ...] = ("submit_marker",)) -> Column:
    """A label for each turn text.

    finalize: a submission, or a last turn without a command; edit; reproduce_test and inspect_diagnose before the first edit,
    verify_test and verify_inspect after it; reason_plan without a command.
    """
    t = F.transform(F.coalesce(turns, F.array().cast("array<string>")), shell.text_of)
    first = F.array_min(F.filter(F.transform(t, lambda x, i: F.when(F.exists(shell.action_blocks(x), shell.edits), i)), lambda i: i.isNotNull()))

    def label(x: Column, i: Column) -> Column:
        blocks = shell.action_blocks(x)
        late = F.coalesce(first < i, F.lit(False))
        either = lambda after, ahead: F.when(late, F.lit(after)).otherwise(F.lit(ahead))
        done = shell.submits(x, words) | ((i == F.size(t) - 1) & (F.size(blocks) == 0))
        return F.when(done, "finalize").when(F.exists(blocks, shell.edits), "edit").when(F.exists(blocks, shell.runs_tests), either("verify_test", "reproduce_test")).when(F.size(blocks) > 0, either("verify_inspect", "inspect_diagnose")).otherwise("reason_plan")

    return F.transform(t, label)


def units(messages: Column) -> Column:
    """Arrays of messages, one for each assistant message, each with what follows it; what leads goes into the first."""
    at = F.filter(F.transform(messages, lambda m, i: F.when(m["role"] == "assistant", i)), lambda i: i.isNotNull())

    def unit(start: Column, k: Column) -> Column:
        begin = F.when(k == 0, F.lit(0)).otherwise(start)
        return F.slice(messages, (begin + 1).cast("int"), (F.coalesce(F.get(at, k + 1), F.size(messages)) - begin).cast("int"))

    return F.transform(at, unit)


def grouped(df: DataFrame, labels_: str = "labels", units_: str = "units", least: int = 4, most: int = 6) -> DataFrame:
    """df with ends, groups and reason: units in min(most, half of them, rounded down) contiguous groups, null and a reason below `least` units.

    whole tells that the groups, joined, are the units again.
    """
    n = F.size(F.coalesce(F.col(labels_), F.array().cast("array<string>")))
    d = df.withColumn("ends", segment_udf(least, most)(labels_))
    begin = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get("ends", k - 1))
    d = d.withColumn("groups", F.transform("ends", lambda e, k: F.flatten(F.slice(units_, (begin(k) + 1).cast("int"), (e - begin(k)).cast("int")))))
    return d.withColumn("whole", F.flatten("groups") == F.flatten(units_)).withColumn("reason", F.when(n < least, F.lit("too few turns")))


def prefix_rows(df: DataFrame, keys: list[str], context: str, groups: str, learns: str = "loss") -> DataFrame:
    """A row for each group k from 1: keys, k, prefix (context and the groups before k), completion (group k), without groups that train nothing.

    groups: array of arrays of messages with a boolean field `learns`. Each row holds its whole prefix, as a trainer reads it.
    """
    d = df.select(*keys, F.col(context).alias("_c"), F.col(groups).alias("_g"), F.posexplode(groups).alias("_k", "completion"))
    d = d.select(*keys, (F.col("_k") + 1).alias("k"), F.concat("_c", F.flatten(F.slice("_g", F.lit(1), F.col("_k")))).alias("prefix"), "completion")
    return d.where(F.exists("completion", lambda m: (m["role"] == "assistant") & F.coalesce(m[learns], F.lit(False))))
