"""Matching of conversation prefixes across exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fingerprint(turns: Column) -> Column:
    """SHA-256 of an array of turns, each with its length before it."""
    return F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(F.length(F.coalesce(t, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(t, F.lit("")))), ""), 256)


def match_prefixes(wanted: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each wanted row with the candidate whose first turns equal its prefix.

    wanted: base, run, prefix (array of strings) and any others. candidates: base, run, replica, turns. Of several, the wanted
    row's own run comes first, then the least replica, then the least run. Adds matched_run and matched_replica, null where nothing
    matches. A null or empty prefix, and a null base, match nothing; a null turn counts as empty.

    Candidates are cut only at lengths that their base asks for, and reduced to the best per run and overall before they meet
    the wanted rows, so equal prefixes never form pairs.
    """
    keyed = wanted.withColumn("_n", F.when(F.size("prefix") > 0, F.size("prefix"))).withColumn("_hash", fingerprint(F.col("prefix")))
    lengths = keyed.where("_n is not null").select("base", "_n").distinct()
    cut = candidates.select("base", "run", "replica", "turns").join(lengths, "base").where(F.size("turns") >= F.col("_n"))
    cut = cut.select("base", "_n", fingerprint(F.slice("turns", F.lit(1), F.col("_n"))).alias("_hash"), "run", "replica")
    at = ["base", "_n", "_hash"]
    own = cut.groupBy(*at, "run").agg(F.min("replica").alias("_own"))
    best = own.groupBy(*at).agg(F.min(F.struct(F.col("_own").alias("replica"), "run")).alias("_best"))
    j = keyed.join(own, [*at, "run"], "left").join(best, at, "left")
    mine = F.col("_own").isNotNull()
    j = j.withColumn("matched_run", F.when(mine, F.col("run")).otherwise(F.col("_best.run"))).withColumn("matched_replica", F.when(mine, F.col("_own")).otherwise(F.col("_best.replica")))
    return j.select(*wanted.columns, "matched_run", "matched_replica")
