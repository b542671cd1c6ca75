"""Pairs, best records, tiers, holdouts and splits of graded trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions.coerce import squeezed
from sparkloom.operators.components import components


def preference_pairs(king: DataFrame, challenger: DataFrame, keys: list[str], least_gap: float = 0.1, least_score: float = 0.0) -> DataFrame:
    """A row per pair of sides on the keys, with the preferred side and the reasons against the pair.

    Both have score (null if there is none) and quality_pass.
    """
    side = lambda df, p: df.select(*keys, F.col("score").alias(f"{p}_score"), F.coalesce("quality_pass", F.lit(False)).alias(f"_{p}"))
    d = side(king, "king").join(side(challenger, "challenger"), keys)
    gap = F.col("challenger_score") - F.col("king_score")
    new = F.coalesce(gap > 0, F.lit(False))
    known = F.coalesce(gap != 0, F.lit(False))
    pick = lambda a, b: F.when(known, F.when(new, F.col(a)).otherwise(F.col(b)))
    d = d.select("*", gap.alias("challenger_delta"), F.when(known, F.when(new, "challenger").otherwise("king")).alias("preferred_side"), pick("challenger_score", "king_score").alias("preferred_score"), pick("king_score", "challenger_score").alias("rejected_score"), F.coalesce(pick("_challenger", "_king"), F.lit(False)).alias("preferred_quality_pass"), F.coalesce(pick("_king", "_challenger"), F.lit(False)).alias("rejected_quality_pass"))
    why = lambda test, name: F.when(test, F.lit(name))
    reasons = F.array_compact(F.array(why(~known, "missing_or_tied_scores"), why(known & (F.abs(gap) < least_gap), "delta_below_threshold"), why(known & (F.col("preferred_score") < least_score), "preferred_score_below_threshold"), why(known & ~F.col("preferred_quality_pass"), "preferred_failed_quality_filter")))
    return d.drop("_king", "_challenger").select("*", (F.size(reasons) == 0).alias("eligible"), reasons.alias("rejection_reasons"))


def gap_pairs(left: DataFrame, right: DataFrame, keys: list[str], margin: float, single: bool = True) -> DataFrame:
    """Pairs (keys, left_replica, right_replica, left_score, right_score, gap) whose scores differ by at least margin.

    single: only the pair with the largest gap of each key, the first by replicas of equal ones.
    """
    side = lambda df, p: df.select(*keys, F.col("replica").alias(f"{p}_replica"), F.col("score").alias(f"{p}_score"))
    d = side(left, "left").join(side(right, "right"), keys).withColumn("gap", F.col("left_score") - F.col("right_score")).where(F.abs("gap") >= margin)
    if not single:
        return d
    best = F.struct((-F.abs("gap")).alias("o"), "left_replica", "right_replica", "left_score", "right_score", "gap")
    return d.groupBy(*keys).agg(F.min(best).alias("p")).select(*keys, "p.left_replica", "p.right_replica", "p.left_score", "p.right_score", "p.gap")


def best(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by an order that should have no ties; rows equal in it are taken in no particular order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def best_reference(df: DataFrame, keys: list[str], cues: str = "cues", score: str = "self_score", text: str = "trajectory", score_first: bool = False) -> DataFrame:
    """The best reference of each key by cues, then self score, then the least SHA-256 of its text.

    The score counts only where all references of the key have one. score_first: score before cues.
    """
    all_ = F.min(F.col(score).isNotNull()).over(W.partitionBy(*keys))
    by_score = F.when(all_, F.col(score)).desc_nulls_last()
    by_cues = F.col(cues).desc_nulls_last()
    return best(df, keys, *((by_score, by_cues) if score_first else (by_cues, by_score)), F.sha2(F.coalesce(text, F.lit("")), 256))


def latest_scored(df: DataFrame, keys: list[str], scored: str = "scored", finished: str = "finished_at", run: str = "run_id") -> DataFrame:
    """The row of each key that is scored, else not, and finished last; the greatest run id of equal ones."""
    return best(df, keys, F.coalesce(scored, F.lit(False)).desc(), F.col(finished).desc_nulls_last(), F.col(run).desc_nulls_last())


def dedup_key(sample: Column, index: Column, several: Column) -> Column:
    """A sample and its reference's index; the index of the single form counts as 0."""
    return F.struct(sample.alias("sample_id"), F.when(several, index).otherwise(F.lit(0)).alias("reference_index"))


def top_ranked(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each key, with rank."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def capped(df: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """At most n rows of each key in scan order. The cap is the operator's purpose; filter the survivors first."""
    return top_ranked(df, [key], n, *order).drop("rank")


def round_robin(df: DataFrame, buckets: list[str], n: int, *order: Column) -> DataFrame:
    """n rows, taken in turns from the buckets; `place` from 1. Only n rows of each bucket are looked at."""
    few = top_ranked(df, buckets, n, *order).withColumnRenamed("rank", "_turn")
    place = [F.col("_turn"), *[F.col(b).asc_nulls_first() for b in buckets]]
    few = few.orderBy(*place).limit(n)
    return few.withColumn("place", F.row_number().over(W.orderBy(*place))).drop("_turn")


def greedy_per_task(df: DataFrame, task: str, context: str, origin: str, *order: Column, of_context: int = 3, of_task: int = 6) -> DataFrame:
    """At most of_context rows of a context and of_task of a task; origins take turns, then by order."""
    turn = F.row_number().over(W.partitionBy(task, context, origin).orderBy(*order))
    d = df.withColumn("_a", turn)
    d = d.withColumn("_b", F.row_number().over(W.partitionBy(task, context).orderBy("_a", F.col(origin).asc_nulls_first(), *order))).where(F.col("_b") <= of_context)
    return d.withColumn("_c", F.row_number().over(W.partitionBy(task).orderBy("_a", F.col(origin).asc_nulls_first(), "_b", F.col(context).asc_nulls_first(), *order))).where(F.col("_c") <= of_task).drop("_a", "_b", "_c")


def tiers(df: DataFrame, **tests: Column) -> DataFrame:
    """A row for each tier whose test a row passes, so tiers overlap; rows of none are left out."""
    return df.withColumn("tier", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in tests.items()]))))


def quality_weight(*factors: tuple[Column, float]) -> Column:
    """The product of the factors whose tests hold, 1 without any."""
    out = F.lit(1.0)
    for test, factor in factors:
        out = out * F.when(F.coalesce(test, F.lit(False)), F.lit(factor)).otherwise(F.lit(1.0))
    return out


def identities(sample: Column, task_text: Column, context: Column) -> Column:
    """A sample's coordinate and the hashes of its task's text and its context; null where the task has no text."""
    task = F.lower(squeezed(task_text))
    return F.when(task != "", F.array(F.concat(F.lit("coord:"), F.regexp_replace(sample, "#r\\d+$", "")), F.concat(F.lit("task:"), F.sha2(task, 256)), F.concat(F.lit("context:"), F.sha2(F.coalesce(context, F.lit("")), 256))))


def ready(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that can be held out: two or more replicas, one checklist hash, no error, one context. df: replica, checklist, error, context."""
    one = lambda c: (F.count_distinct(c) == 1) & (F.count(c) == F.count("*"))
    return df.groupBy(*keys).agg((F.count_distinct("replica") >= 2).alias("replicas"), one("checklist").alias("one_checklist"), (F.count("error") == 0).alias("no_error"), one("context").alias("one_context")).select("*", (F.col("replicas") & F.col("one_checklist") & F.col("no_error") & F.col("one_context")).alias("ready"))


def one_context(df: DataFrame, keys: list[str], context: str) -> DataFrame:
    """df without the keys whose rows disagree on the context or lack one."""
    good = df.groupBy(*keys).agg(F.min(context).alias("_a"), F.max(context).alias("_b"), F.count_if(F.col(context).isNull()).alias("_n")).where("_a = _b and _n = 0").select(*keys)
    return df.join(good, keys, "left_semi")


def group_split(df: DataFrame, id_: str, identities_: str, share: float, salt: str = "split") -> DataFrame:
    """df with component and split: rows that share an identity, also by way of others, are all dev or all train.

    The component is the least identity reachable and goes to dev by its hash, for about `share` of the components.
    """
    each = df.select(F.col(id_).alias("_id"), F.explode(identities_).alias("key"))
    first = each.groupBy("_id").agg(F.min("key").alias("least"))
    edges = each.join(first, "_id").select(F.col("least").alias("a"), F.col("key").alias("b"))
    roots = components(edges)
    root = first.join(roots, F.col("least") == F.col("id"), "left").select("_id", F.coalesce("root", "least").alias("component"))
    unit = F.conv(F.substring(F.sha2(F.concat(F.lit(salt + ":"), F.col("component")), 256), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.join(root, df[id_] == root["_id"]).drop("_id").withColumn("split", F.when(unit < share, "dev").otherwise("train"))


def inherited_split(df: DataFrame, id_: str, keys: str, pool: DataFrame) -> DataFrame:
    """df with the split of the first of its keys that the pool (key, split) has, null without any."""
    found = df.select(F.col(id_).alias("_id"), F.posexplode(keys).alias("at", "key")).join(pool, "key").groupBy("_id").agg(F.min_by("split", "at").alias("split"))
    return df.join(found, df[id_] == found["_id"], "left").drop("_id")


def nested(df: DataFrame, sizes: list[int], *order: Column) -> DataFrame:
    """df's first max(sizes) rows with `sets`, the sizes whose leading rows they are among."""
    n = F.row_number().over(W.orderBy(*order))
    few = df.orderBy(*order).limit(max(sizes)).withColumn("_n", n)
    return few.withColumn("sets", F.filter(F.array(*map(F.lit, sizes)), lambda s: F.col("_n") <= s)).drop("_n")


def contract_errors(row_id: Column, prefix: Column, completion: Column) -> Column:
    """What is wrong with a row of prefix and completion messages (role, content, loss)."""
    bad = lambda test, name: F.when(F.coalesce(test, F.lit(True)), F.lit(name))
    role = lambda part, at: F.try_element_at(part, F.lit(at))["role"]
    return F.array_compact(F.array(
        bad(F.trim(row_id) == "", "missing_id"), bad(F.size(prefix) == 0, "empty_prefix"), bad(F.size(completion) == 0, "empty_completion"),
        bad(role(prefix, 1) != "system", "prefix_not_from_system"), bad(role(completion, 1) != "assistant", "completion_not_from_assistant"),
        bad(F.exists(prefix, lambda m: F.coalesce(m["loss"], F.lit(False))), "loss_in_prefix"),
        bad(F.exists(completion, lambda m: F.coalesce(m["loss"], F.lit(False)) != (m["role"] == "assistant")), "loss_mask_differs"),
        bad(F.exists(F.concat(prefix, completion), lambda m: F.trim(F.coalesce(m["content"], F.lit(""))) == ""), "empty_content")))


def disposition(errors: Column, findings: Column, informational: tuple[str, ...] = ("verification_signal",)) -> Column:
    """invalid with an error, review with a finding that is not informational, else eligible."""
    serious = F.filter(findings, lambda f: ~f.isin(*informational))
    return F.when(F.size(errors) > 0, "invalid").when(F.size(serious) > 0, "review").otherwise("eligible")
