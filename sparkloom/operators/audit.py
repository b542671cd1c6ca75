"""Audit of whole trajectories: flags of quality, their evidence and workflow features.

A trajectory is a row with `turns`, the texts of its assistant turns, and `prefix`, the messages before them. Everything is
computed on the row's arrays, so an audit neither shuffles nor leaves the JVM. Null arrays are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import messages, shell
from sparkloom.functions.coerce import excerpt
from sparkloom.operators.claims import COMPLETION_CLAIM, EDIT_CLAIM, REASONS, SENTENCE, TEST_CLAIM

FLAGS = ("malformed_bash", "loop", "broad_search_without_inspect", "unsupported_completion_claim")
#: A loop is a command LOOP_RUN times in a row, or at least LOOP_MOST commands of which half repeat earlier ones.
LOOP_RUN, LOOP_MOST = 4, 8
EVIDENCE = 8


def visible(turn: Column) -> Column:
    """A turn's prose: what follows its thinking, without its action blocks."""
    return F.trim(F.regexp_replace(messages.think_action(turn)[1], shell.ACTION, " "))


def _flat(turns: Column, of) -> Column:
    return F.flatten(F.transform(turns, of))


def commands(turns: Column) -> Column:
    """(turn from 1, command) of all action blocks."""
    return _flat(turns, lambda t, i: F.transform(shell.action_blocks(t), lambda c: F.struct((i + 1).alias("turn"), c.alias("command"))))


def longest_run(values: Column) -> Column:
    """The most equal neighbours in an array."""
    start = F.struct(F.lit(0).alias("most"), F.lit(0).alias("now"), F.lit(None).cast("string").alias("last"))

    def add(a: Column, x: Column) -> Column:
        now = F.when(a["last"].eqNullSafe(x), a["now"] + 1).otherwise(F.lit(1))
        return F.struct(F.greatest(a["most"], now).alias("most"), now.alias("now"), x.alias("last"))

    return F.aggregate(values, start, add, lambda a: a["most"])


def duplicate_ratio(values: Column) -> Column:
    """The share of elements that repeat an earlier one; 0 for an empty array."""
    n = F.size(values)
    return F.when(n > 0, (n - F.size(F.array_distinct(values))) / n).otherwise(F.lit(0.0))


def malformed(turns: Column) -> Column:
    """(turn, reason, excerpt): turns that are blank, have several blocks, an empty one, or prose for a command."""
    one = lambda i, why, text: F.struct((i + 1).alias("turn"), why.alias("reason"), excerpt(text).alias("excerpt"))

    def of(t: Column, i: Column) -> Column:
        blocks = shell.action_blocks(t)
        whole = F.array_compact(F.array(
            F.when(F.trim(t) == "", one(i, F.lit("blank turn"), t)),
            F.when(F.size(blocks) > 1, one(i, F.concat(F.lit("multiple action blocks ("), F.size(blocks).cast("string"), F.lit(")")), t))))
        bad = F.filter(blocks, lambda c: (c == "") | shell.head(c).isin(*shell.PROSE_HEADS))
        return F.concat(whole, F.transform(bad, lambda c: F.when(c == "", one(i, F.lit("empty action block"), c)).otherwise(one(i, F.concat(F.lit("prose-like command head '"), shell.head(c), F.lit("'")), c))))

    return _flat(turns, of)


def _turns_with(turns: Column, test) -> Column:
    """Numbers of the turns with a command for which test holds."""
    return F.filter(F.transform(turns, lambda t, i: F.when(F.exists(shell.action_blocks(t), test), i + 1)), lambda i: i.isNotNull())


def _claims(turns: Column, edit: Column, test: Column, proof: Column) -> Column:
    """(turn, reason, text) of claims that nothing up to their turn supports; edit, test, proof: the first turn with each, null for never."""
    before = lambda first, i: ~F.coalesce(first <= i + 1, F.lit(False))

    def held(t: Column, i: Column, lack: Column, claim: str, why: str) -> Column:
        pieces = F.filter(F.split(visible(t), SENTENCE), lambda p: lack & p.rlike(claim))
        return F.transform(pieces, lambda p: F.struct((i + 1).alias("turn"), F.lit(why).alias("reason"), excerpt(p).alias("text")))

    def of(t: Column, i: Column) -> Column:
        lacks = (before(edit, i), before(test, i), before(edit, i) | before(proof, i))
        return F.concat(*[held(t, i, *x) for x in zip(lacks, (EDIT_CLAIM, TEST_CLAIM, COMPLETION_CLAIM), REASONS, strict=True)])

    return _flat(turns, of)


def audit(df: DataFrame, turns: str = "turns", prefix: str = "prefix") -> DataFrame:
    """df with the four flags, quality_pass, flags, evidence and the counts they rest on."""
    names = df.columns
    texts = F.transform(F.coalesce(F.col(turns), F.array().cast("array<string>")), shell.text_of)
    before = F.transform(F.filter(messages.items(F.col(prefix)), lambda m: m["role"] == "assistant"), lambda m: shell.text_of(m["content"]))
    first = lambda test, t: F.array_min(_turns_with(t, test))
    d = df.withColumn("_t", texts).withColumn("_p", before)
    d = d.select(*names, "_t", "_p", commands(F.col("_t")).alias("_c"), malformed(F.col("_t")).alias("_m"), *[first(test, F.col("_t")).alias(n) for n, test in (("_edit", shell.edits), ("_test", shell.runs_tests), ("_diff", shell.shows_diff), ("_view", shell.inspects))], *[first(test, F.col("_p")).isNotNull().alias(n) for n, test in (("prefix_edited", shell.edits), ("prefix_tested", shell.runs_tests), ("prefix_git_diff", shell.shows_diff), ("prefix_targeted_inspect", shell.inspects))])
    since = lambda own, there: F.when(F.col(there), F.lit(0)).otherwise(F.col(own))
    texts_of = F.transform(F.col("_c"), lambda c: c["command"])
    broad = F.filter("_c", lambda c: shell.searches_broadly(c["command"]))
    views = F.filter("_c", lambda c: shell.inspects(c["command"]))
    d = d.withColumn("_x", texts_of).withColumn("_broad", broad).withColumn("_views", views)
    edit, test = since("_edit", "prefix_edited"), since("_test", "prefix_tested")
    proof = F.least(test, since("_diff", "prefix_git_diff"))
    d = d.withColumn("_u", _claims(F.col("_t"), edit, test, proof)).withColumn("max_consecutive_command_run", longest_run(F.col("_x"))).withColumn("duplicate_command_ratio", duplicate_ratio(F.col("_x")))
    looped = (F.col("max_consecutive_command_run") >= LOOP_RUN) | ((F.size("_x") >= LOOP_MOST) & (F.col("duplicate_command_ratio") >= 0.5))
    first_broad = F.get("_broad", F.lit(0))["turn"]
    unseen = (F.size("_broad") >= 2) & ~F.exists("_views", lambda v: v["turn"] >= first_broad)
    flags = dict(zip(FLAGS, (F.size("_m") > 0, looped, unseen, F.size("_u") > 0), strict=True))
    clipped = lambda c: F.transform(F.slice(c, 1, EVIDENCE), lambda x: F.struct(x["turn"].alias("turn"), excerpt(x["command"]).alias("command")))
    count = lambda c, test: F.size(F.filter(c, test)).cast("long")
    d = d.select("*", *[v.alias(k) for k, v in flags.items()])
    any_flag = F.col(FLAGS[0]) | F.col(FLAGS[1]) | F.col(FLAGS[2]) | F.col(FLAGS[3])
    return d.select(
        *names, *FLAGS, (~any_flag).alias("quality_pass"), F.array_compact(F.array(*[F.when(F.col(f), F.lit(f)) for f in FLAGS])).alias("flags"),
        F.struct(F.slice("_m", 1, EVIDENCE).alias("malformed_bash"), clipped(F.col("_broad")).alias("broad_commands"), clipped(F.col("_views")).alias("targeted_inspect_commands"), F.slice("_u", 1, EVIDENCE).alias("unsupported_completion_claim")).alias("evidence"),
        F.size("_t").cast("long").alias("turn_count"), F.size("_x").cast("long").alias("command_count"), F.size(F.array_distinct("_x")).cast("long").alias("unique_command_count"),
        "duplicate_command_ratio", "max_consecutive_command_run", F.size(F.array_distinct(F.transform("_m", lambda m: m["turn"]))).cast("long").alias("malformed_turn_count"),
        count(F.col("_x"), lambda c: shell.head(c).isin(*shell.PROSE_HEADS)).alias("prose_like_command_count"), count(F.col("_x"), shell.searches).alias("search_count"),
        F.size("_broad").cast("long").alias("broad_search_count"), F.size("_views").cast("long").alias("targeted_inspect_count"),
        F.col("_edit").isNotNull().alias("edited"), F.col("_test").isNotNull().alias("tested"), F.col("_diff").isNotNull().alias("git_diff"),
        (F.col("_edit").isNotNull() & ~F.col("prefix_targeted_inspect") & (F.col("_view").isNull() | (F.col("_edit") < F.col("_view")))).alias("edit_before_inspect"),
        F.size("_u").cast("long").alias("unsupported_claim_count"), F.aggregate(F.transform("_t", lambda t: F.length(visible(t))), F.lit(0), lambda a, x: a + x).cast("long").alias("visible_prose_chars"),
        F.size("_p").cast("long").alias("prefix_turn_count"), "prefix_edited", "prefix_tested", "prefix_git_diff", "prefix_targeted_inspect")


def workflow(df: DataFrame, turns: str = "turns") -> DataFrame:
    """df with inspected_before_edit and verified_after_edit: a view before the first edit, a test or diff after the last one."""
    t = F.transform(F.coalesce(F.col(turns), F.array().cast("array<string>")), shell.text_of)
    edit, look, check = (_turns_with(t, test) for test in (shell.edits, shell.inspects, lambda c: shell.runs_tests(c) | shell.shows_diff(c)))
    none = lambda c: F.coalesce(c, F.lit(False))
    return df.select("*", none(F.array_min(look) < F.array_min(edit)).alias("inspected_before_edit"), none(F.array_max(check) > F.array_max(edit)).alias("verified_after_edit"), F.array_min(edit).alias("first_edit_turn"))


def side_quality(audited: DataFrame, side: str = "side") -> DataFrame:
    """Per side: candidates, passes, pass_rate and the number of candidates with each flag."""
    return audited.groupBy(side).agg(F.count("*").alias("candidates"), F.count_if("quality_pass").alias("passes"), F.avg(F.col("quality_pass").cast("int")).alias("pass_rate"), *[F.count_if(f).alias(f) for f in FLAGS])
