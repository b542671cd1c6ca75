"""Reports and statistics over graded runs, pairs, probes and training logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def model_rollup(runs: DataFrame, model: str, score: str, margin: str, **sets: str) -> DataFrame:
    """Per model: run_count, max_score, mean_score, max_margin and each set's sorted distinct values."""
    return runs.groupBy(model).agg(F.count("*").alias("run_count"), F.max(score).alias("max_score"), F.avg(score).alias("mean_score"), F.max(margin).alias("max_margin"), *[F.array_sort(F.collect_set(c)).alias(n) for n, c in sets.items()])


def best_edited(refs: DataFrame, keys: list[str], score: str = "score", edited: str | Column = "edited") -> DataFrame:
    """Per key the best score of a reference with an edit, else of any."""
    test = F.col(edited) if isinstance(edited, str) else edited
    return refs.groupBy(*keys).agg(F.coalesce(F.max(F.when(test, F.col(score))), F.max(score)).alias("best"))


def samples(rows: DataFrame, keys: list[str], score: str, *order: str) -> DataFrame:
    """Per key the number of rows and the first score that is not null in the order."""
    at = F.struct(*order)
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.min_by(score, F.when(F.col(score).isNotNull(), at)).alias("score"))


def alignment_rate(rows: DataFrame, keys: list[str], aligned: str) -> DataFrame:
    """true / (true + false) per key, null where neither occurs."""
    return rows.groupBy(*keys).agg(F.avg(F.col(aligned).cast("int")).alias("rate"), F.count(aligned).alias("known"))


def source_stats(rows: DataFrame, source: str, instance: str, *order: str) -> DataFrame:
    """Per source: distinct instances, those with an edit in any row, blocked rows, family and language of its first row."""
    each = rows.groupBy(source, instance).agg(F.bool_or("has_edit").alias("e"), F.count_if("blocked").alias("b"), F.min(F.struct(*order, "family", "language")).alias("f"))
    return each.groupBy(source).agg(F.count(instance).alias("instances"), F.count_if("e").alias("edited"), F.sum("b").alias("blocked"), F.min("f").alias("f")).select(source, "instances", "edited", "blocked", "f.family", "f.language")


def pooled_instances(tables: list[DataFrame], instance: str) -> DataFrame:
    """One row: how many instances the tables hold together."""
    return reduce(DataFrame.unionByName, [t.select(instance) for t in tables]).agg(F.count_distinct(instance).alias("instances"))


def merge_report(batch: DataFrame, margin: float) -> DataFrame:
    """One row over tasks with a generated score and the king's scores: usable, beaten either way by the margin, ties and means."""
    usable = batch.where(F.col("score").isNotNull() & (F.size("king_scores") > 0))
    ahead, behind = (F.exists("king_scores", test) for test in (lambda k: F.col("score") - k >= margin, lambda k: k - F.col("score") >= margin))
    mean = F.aggregate("king_scores", F.lit(0.0), lambda a, x: a + x) / F.size("king_scores")
    return usable.agg(F.count("*").alias("usable"), F.count_if(ahead).alias("ahead"), F.count_if(behind).alias("behind"), F.count_if(~ahead & ~behind).alias("ties"), F.avg("score").alias("mean"), F.avg(mean).alias("king_mean"))


def rejudge_parity(rows: DataFrame, first: str, second: str) -> DataFrame:
    """One row: how many have both scores, and the mean and greatest absolute difference."""
    d = F.abs(F.col(first) - F.col(second))
    return rows.agg(F.count(d).alias("n"), F.avg(d).alias("mean_abs"), F.max(d).alias("max_abs"))


def tagged_counts(rows: DataFrame, keys: list[str], tags: str) -> DataFrame:
    """How often each tag of an array occurs, per key."""
    return rows.select(*keys, F.explode(tags).alias("tag")).groupBy(*keys, "tag").agg(F.count("*").alias("n"))


def unique_turns(pairs: DataFrame, *key: str) -> DataFrame:
    """Turns once each, however many pairs share them; of rows that differ elsewhere any one."""
    return pairs.dropDuplicates(list(key))


def sizing(rows: DataFrame, tokens: str, per_second: float, split: str = "split") -> DataFrame:
    """Per split: rows, tokens, exact median and 90th percentile by rank, and hours at a throughput."""
    values = rows.groupBy(split, tokens).agg(F.count("*").alias("c"))
    # ranks run over distinct lengths, so a split's rows are counted, not sorted
    below = F.sum("c").over(W.partitionBy(split).orderBy(tokens))
    total = F.sum("c").over(W.partitionBy(split))
    at = lambda q: F.min(F.when(F.col("below") > F.least(F.col("total") - 1, F.floor(F.col("total") * q)), F.col(tokens)))
    return values.select(split, tokens, "c", below.alias("below"), total.alias("total")).groupBy(split).agg(F.sum("c").alias("rows"), F.sum(F.col(tokens) * F.col("c")).alias("tokens"), at(0.5).alias("median"), at(0.9).alias("p90"), (F.sum(F.col(tokens) * F.col("c")) / per_second / 3600).alias("hours"))


def weighted_nll(rows: DataFrame, keys: list[str], nll: str, n: str) -> DataFrame:
    """Per key the mean loss of a token, rows weighted by their tokens."""
    return rows.groupBy(*keys).agg((F.sum(nll) / F.sum(n)).alias("nll"), F.sum(n).alias("tokens"), F.count("*").alias("rows"))


def conditional_means(rows: DataFrame, flag: str, *values: str) -> DataFrame:
    """Means where the flag holds and where it does not; null counts as not."""
    return rows.groupBy(F.coalesce(F.col(flag), F.lit(False)).alias(flag)).agg(F.count("*").alias("n"), *[F.avg(v).alias(v) for v in values])


def two_flags(rows: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """Count, mean and greatest value for each combination of two flags."""
    return rows.groupBy(a, b).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("ceiling"))


def share_per_task(rows: DataFrame, task: str, hit: Column) -> DataFrame:
    """One row: mean, least and greatest share of rows that are hits, over tasks."""
    return rows.groupBy(task).agg(F.avg(hit.cast("int")).alias("s")).agg(F.avg("s").alias("mean"), F.min("s").alias("least"), F.max("s").alias("most"))


def paired_features(pairs: DataFrame, *features: str) -> DataFrame:
    """A row per feature: means of the chosen and rejected sides over rows that have it, and the difference. Columns chosen_f and rejected_f."""
    means = pairs.agg(*[F.avg(f"{s}_{f}").alias(f"{s}_{f}") for f in features for s in ("chosen", "rejected")])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"chosen_{f}").alias("chosen"), F.col(f"rejected_{f}").alias("rejected")) for f in features])
    return means.select(F.inline(rows)).withColumn("difference", F.col("chosen") - F.col("rejected"))


def weight_sum(rows: DataFrame, weight: str) -> DataFrame:
    return rows.agg(F.round(F.sum(weight), 4).alias("weight"))


def unanimous(rows: DataFrame, keys: list[str], value: str, score: str) -> DataFrame:
    """Per key the value all rows share, else unknown, and the score if there is one row only."""
    same = (F.count_distinct(value) == 1) & (F.count(value) == F.count("*"))
    return rows.groupBy(*keys).agg(F.when(same, F.min(value)).otherwise("unknown").alias(value), F.when(F.count("*") == 1, F.min(score)).alias(score))


def probes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: calls, share that are ok, their tokens in order, mean cost and seconds, first error. rows: at, ok, tokens, cost, seconds, error."""
    return rows.groupBy(*keys).agg(F.count("*").alias("calls"), F.avg(F.col("ok").cast("int")).alias("ok_share"), F.array_sort(F.collect_list(F.when(F.col("ok"), F.col("tokens")))).alias("tokens"), F.avg("cost").alias("cost"), F.avg("seconds").alias("seconds"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("at"))).alias("first_error"))


def step_means(logs: DataFrame, step: str, rows: str, *sums: str) -> DataFrame:
    """Per step the sums of all ranks divided by their rows."""
    return logs.groupBy(step).agg(F.sum(rows).alias(rows), *[(F.sum(s) / F.sum(rows)).alias(s) for s in sums])


def behaviour_mix(rows: DataFrame, keys: list[str], turns: str = "kinds") -> DataFrame:
    """Per key: rollouts, those with an edit and a submission, each kind's share of turns, and the median first edit (by rank).

    turns: array with the kind of each turn (see shell.kind).
    """
    first = F.array_position(turns, "edit")
    share = lambda k: F.sum(F.size(F.filter(turns, lambda x: x == k))) / F.nullif(F.sum(F.size(turns)), F.lit(0))
    return rows.groupBy(*keys).agg(F.count("*").alias("rollouts"), F.count_if(first > 0).alias("with_edit"), F.count_if(F.array_contains(turns, "submit")).alias("with_submit"), *[share(k).alias(k) for k in ("submit", "edit", "test", "explore", "no_cmd")], F.median(F.when(first > 0, first)).alias("first_edit"))


def worst(rows: DataFrame, task: str, delta: str, n: int = 10) -> DataFrame:
    """The n tasks with the least sum of deltas, and each one's share of all deficits."""
    by = rows.groupBy(task).agg(F.sum(delta).alias("deficit"))
    total = by.agg(F.sum(F.least("deficit", F.lit(0.0))).alias("total"))
    return by.crossJoin(F.broadcast(total)).orderBy("deficit", task).limit(n).select(task, "deficit", F.when(F.col("deficit") < 0, F.col("deficit") / F.col("total")).otherwise(0.0).alias("share"))


def log_sigmoid(x: Column) -> Column:
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def dpo(pc: Column, pr: Column, rc: Column, rr: Column, nc: Column, nr: Column, beta: float = 0.1, mean: bool = False, norm_tokens: float = 1.0, smoothing: float = 0.0, dpo_weight: float = 1.0, nll_weight: float = 0.0) -> dict[str, Column]:
    """Loss, its argument h, derivatives by the policy's log-probabilities, and metrics of a preference pair.

    p and r: policy and reference; c and r: chosen and rejected; n: tokens. mean: log-ratios per token, scaled by norm_tokens.
    """
    scale = beta * (norm_tokens if mean else 1.0)
    by_c, by_r = (nc, nr) if mean else (F.lit(1.0), F.lit(1.0))
    h = scale * ((pc - rc) / by_c - (pr - rr) / by_r)
    slope = dpo_weight * (smoothing * F.exp(log_sigmoid(h)) - (1 - smoothing) * F.exp(log_sigmoid(-h)))
    return {
        "loss": dpo_weight * (-(1 - smoothing) * log_sigmoid(h) - smoothing * log_sigmoid(-h)) - nll_weight * pc / nc, "h": h,
        "coef_chosen": slope * scale / by_c - nll_weight / nc, "coef_rejected": -slope * scale / by_r,
        "chosen_logratio": (pc - rc) / nc, "rejected_logratio": (pr - rr) / nr, "chosen_nll": -pc / nc, "accuracy": (h > 0).cast("double"),
    }


def drift(values: DataFrame, family: str, lr_squares: float, last_lr_squares: float) -> DataFrame:
    """Per family and, with family null, over all: RMS drift from the start against the noise line, last increment and their cosine.

    values: family, now, initial, previous, a row per element. The noise line is the root of the summed squared learning rates.
    """
    delta, inc = F.col("now") - F.col("initial"), F.col("now") - F.col("previous")
    d = values.rollup(family)
    noise, last = lr_squares ** 0.5, last_lr_squares ** 0.5
    rms = lambda x: F.sqrt(F.sum(x * x) / F.count("*"))
    over = lambda x, line: x / line if line else F.lit(None).cast("double")
    return d.agg(F.grouping(family).alias("whole"), rms(delta).alias("drift_rms"), F.lit(noise).alias("noise_line"), over(rms(delta), noise).alias("drift_over_noise"), rms(inc).alias("increment_rms"), over(rms(inc), last).alias("increment_over_noise"), (F.sum(delta * inc) / F.sqrt(F.greatest(F.lit(1e-30), F.sum(inc * inc) * F.sum(delta * delta)))).alias("increment_cos_total"))


def step0_gate(rows: DataFrame, local: str, reference: str, tokens: str, limit: float) -> DataFrame:
    """One row: summed absolute differences per token, and whether they stay within the limit."""
    d = rows.agg((F.sum(F.abs(F.col(local) - F.col(reference))) / F.sum(tokens)).alias("difference"))
    return d.select("difference", (F.col("difference") <= limit).alias("passes"))


def costs(usage: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of cost and tokens, calls and their cost per task. usage: task, cost, prompt_tokens, completion_tokens."""
    return usage.groupBy(*keys).agg(F.count("*").alias("calls"), F.sum("cost").alias("cost"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), (F.sum("cost") / F.count_distinct("task")).alias("cost_per_task"))


def headroom_gate(value: Column, threshold: Column, least: float = 1.2) -> Column:
    return F.when(threshold > 0, value / threshold >= least)


def grounding(rows: DataFrame, keys: list[str], outcome: str = "outcome") -> DataFrame:
    """Outcomes exact, differs and needs_llm, and exact among those that are not needs_llm, null without any."""
    n = lambda k: F.count_if(F.col(outcome) == k)
    return rows.groupBy(*keys).agg(n("exact").alias("exact"), n("differs").alias("differs"), n("needs_llm").alias("needs_llm"), (n("exact") / F.nullif(n("exact") + n("differs"), F.lit(0))).alias("match_rate"))


def go(drift_over_noise: Column, cosine: Column, dev_accuracy: Column, chosen: Column, rejected: Column, least_drift: float = 1.5, least_cosine: float = 0.2, least_accuracy: float = 0.6) -> Column:
    """go, or the first thing that speaks against it: no_signal, no_direction, dev_accuracy, both_falling."""
    low = lambda c, least: ~F.coalesce(c >= least, F.lit(False))
    return F.when(low(drift_over_noise, least_drift), "no_signal").when(low(cosine, least_cosine), "no_direction").when(low(dev_accuracy, least_accuracy), "dev_accuracy").when((chosen < 0) & (rejected < 0) & (chosen < rejected), "both_falling").otherwise("go")


def liveness(log: DataFrame, keys: list[str], now: Column, stall_seconds: int = 600) -> DataFrame:
    """done, error, nan, stalled or running of each run from its log (at, event, loss); errors before the first step do not count."""
    order = W.partitionBy(*keys).orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    d = log.withColumn("begun", F.max((F.col("event") == "step").cast("int")).over(order))
    d = d.groupBy(*keys).agg(F.max("at").alias("last"), F.bool_or(F.col("event") == "done").alias("done"), F.bool_or((F.col("event") == "error") & (F.col("begun") == 1)).alias("error"), F.bool_or(F.isnan("loss")).alias("nan"))
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    return d.select(*keys, "last", F.when(on("done"), "done").when(on("error"), "error").when(on("nan"), "nan").when(now.cast("long") - F.col("last").cast("long") > stall_seconds, "stalled").otherwise("running").alias("state"))
