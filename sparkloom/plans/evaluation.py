"""Queries of intervals, prefix matches, claims and commands, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions import shell
from sparkloom.functions.text import aligned_udf
from sparkloom.operators.claims import unsupported_claims
from sparkloom.operators.prefixes import match_prefixes
from sparkloom.operators.resampling import CUTS, PER_HASH, bootstrap
from sparkloom.plans.registry import SCORED, query, scored
from sparkloom.sources.tables import table

DRAWS = 2000
_WEIGHT = " + ".join(f"(x >= {c})::INT" for c in CUTS)


@query(f"""WITH t AS (SELECT user_id, event_type, avg(score) AS m FROM ({SCORED}) GROUP BY 1, 2), k AS (SELECT user_id, m AS king FROM t WHERE event_type = 'view'),
j AS (SELECT event_type AS policy, user_id, m - king AS delta FROM t JOIN k USING (user_id) WHERE event_type <> 'view' AND m IS NOT NULL AND king IS NOT NULL),
h AS (SELECT policy, delta, block, sha256(policy || ':' || user_id || ':' || block) AS h FROM j, range({DRAWS // PER_HASH}) b(block)),
u AS (SELECT policy, delta, block, i, ('0x' || substr(h, (8 * i + 1)::BIGINT, 8))::BIGINT AS x FROM h, range({PER_HASH}) r(i)),
d AS (SELECT policy, block, i, sum(({_WEIGHT}) * delta) / sum({_WEIGHT}) AS mean FROM u GROUP BY 1, 2, 3 HAVING sum({_WEIGHT}) > 0),
o AS (SELECT policy, mean, row_number() OVER (PARTITION BY policy ORDER BY mean) - 1 AS k, count(*) OVER (PARTITION BY policy) AS m FROM d)
SELECT policy, round(max(mean) FILTER (k = m // 40), 6) AS low, round(max(mean) FILTER (k = m - 1 - m // 40), 6) AS high FROM o GROUP BY policy""")
def bootstrap_interval(spark, d: str) -> DataFrame:
    t = scored(spark, d).groupBy("user_id", "event_type").agg(F.avg("score").alias("m"))
    king = t.where("event_type = 'view'").select("user_id", F.col("m").alias("king"))
    j = t.where("event_type <> 'view'").join(king, "user_id").select(F.col("event_type").alias("policy"), "user_id", (F.col("m") - F.col("king")).alias("delta"))
    return bootstrap(j, "policy", "user_id", "delta", DRAWS).select("policy", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("""WITH u AS (SELECT user_id AS run, user_id % 10 AS base, list(event_type ORDER BY ts, event_id) AS turns FROM events GROUP BY user_id),
w AS (SELECT run, base, turns[1:2 + run % 2] AS prefix FROM u WHERE run % 4 < 2), c AS (SELECT run, base, run % 7 AS replica, turns FROM u WHERE run % 3 <> 0),
j AS (SELECT w.run, w.base, len(w.prefix) AS n_turns, c.run AS matched_run, c.replica AS matched_replica FROM w LEFT JOIN c ON c.base = w.base AND c.turns[1:len(w.prefix)] = w.prefix)
SELECT run, base, n_turns, matched_run, matched_replica FROM j QUALIFY row_number() OVER (PARTITION BY run ORDER BY (matched_run = run)::INT DESC, matched_replica, matched_run) = 1""")
def prefix_match_best(spark, d: str) -> DataFrame:
    # the first three events are enough for the asked lengths, so no user's whole history is gathered
    e = table(spark, d, "events").withColumn("i", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))).where("i <= 3")
    u = e.groupBy(F.col("user_id").alias("run")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "event_type"))), lambda x: x["event_type"]).alias("turns"))
    u = u.withColumn("base", F.col("run") % 10)
    wanted = u.where("run % 4 < 2").select("run", "base", F.slice("turns", F.lit(1), (2 + F.col("run") % 2).cast("int")).alias("prefix"))
    found = match_prefixes(wanted, u.where("run % 3 <> 0").withColumn("replica", F.col("run") % 7))
    return found.select("run", "base", F.size("prefix").cast("long").alias("n_turns"), "matched_run", "matched_replica")


@query("""WITH u AS (SELECT user_id AS run, user_id % 10 AS base, list(event_type ORDER BY ts, event_id) AS turns FROM events GROUP BY user_id),
w AS (SELECT run, base, turns[1:2 + run % 2] AS prefix FROM u), c AS (SELECT run, base, run % 7 AS replica, turns FROM u),
j AS (SELECT w.run, w.base, len(w.prefix) AS n_turns, c.run AS matched_run, c.replica AS matched_replica FROM w LEFT JOIN c ON c.base = w.base AND c.turns[1:len(w.prefix)] = w.prefix)
SELECT run, base, n_turns, matched_run, matched_replica FROM j QUALIFY row_number() OVER (PARTITION BY run ORDER BY (matched_run = run)::INT DESC, matched_replica, matched_run) = 1""")
def prefix_match_all(spark, d: str) -> DataFrame:
    """Every user's prefix against every user's turns; prefix_match_best asks and offers subsets by id."""
    # the first three events are enough for the asked lengths, so no user's whole history is gathered
    e = table(spark, d, "events").withColumn("i", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))).where("i <= 3")
    u = e.groupBy(F.col("user_id").alias("run")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "event_type"))), lambda x: x["event_type"]).alias("turns"))
    u = u.withColumn("base", F.col("run") % 10)
    wanted = u.select("run", "base", F.slice("turns", F.lit(1), (2 + F.col("run") % 2).cast("int")).alias("prefix"))
    found = match_prefixes(wanted, u.withColumn("replica", F.col("run") % 7))
    return found.select("run", "base", F.size("prefix").cast("long").alias("n_turns"), "matched_run", "matched_replica")


@query("""WITH t AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS turn FROM conversations),
s AS (SELECT conv_id, turn, text, bool_or(coalesce(role_edit, false)) OVER w AS e, bool_or(coalesce(role_test, false)) OVER w AS t FROM (SELECT *, contains(text, 'er') AS role_edit, length(text) > 400 AS role_test FROM t) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
l AS (SELECT conv_id, turn, e, t, unnest(string_split(text, chr(10))) AS part FROM s)
SELECT conv_id, sum((NOT e AND contains(part, 'ou'))::INT)::BIGINT AS edits, sum((NOT t AND contains(part, 'an'))::INT)::BIGINT AS tests, sum((NOT (e AND t) AND contains(part, 'th'))::INT)::BIGINT AS completions FROM l GROUP BY conv_id HAVING edits + tests + completions > 0""")
def claims_before_evidence(spark, d: str) -> DataFrame:
    t = table(spark, d, "conversations").withColumn("turn", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "text")))
    # sentence ends are hidden, so that lines alone are parted, as in the SQL
    t = t.select("conv_id", "turn", F.translate("text", ".!?", ",,,").alias("prose"), F.col("text").contains("er").alias("edited"), (F.length("text") > 400).alias("tested"), F.lit(False).alias("diffed"))
    found = unsupported_claims(t, ["conv_id"], ("ou", "an", "th"))
    kind = lambda s, n: F.count_if(F.col("reason").startswith(s)).alias(n)
    return found.groupBy("conv_id").agg(kind("fix", "edits"), kind("test", "tests"), kind("completion", "completions"))


_COMMANDS = {"click": "cd src && grep -n 'a b' x.py | head -5", "view": "sed -n 1,9p x.py", "purchase": "cat x.py || rm x.py", "error": "cat 'x.py"}


@query("SELECT event_id, event_type IN ('click', 'view') AS reads_only FROM events")
def read_only_commands(spark, d: str) -> DataFrame:
    command = F.lit("cd src")
    for kind, line in _COMMANDS.items():
        command = F.when(F.col("event_type") == kind, F.lit(line)).otherwise(command)
    e = table(spark, d, "events").select("event_id", command.alias("command"))
    return e.select("event_id", shell.reads_only(F.col("command")).alias("reads_only"))


@query("SELECT item_id, trim(text) AS aligned FROM benchmark")
def tolerant_alignment(spark, d: str) -> DataFrame:
    text = F.trim("text")
    raw = F.concat(F.substring_index(text, " ", 2), F.lit("  "), F.expr("substring(trim(text), length(substring_index(trim(text), ' ', 2)) + 2)"))
    return table(spark, d, "benchmark").select("item_id", aligned_udf(raw, F.concat(text, F.lit(" and more"))).alias("aligned"))
