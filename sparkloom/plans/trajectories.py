"""Queries that run the operators on trajectories, pairs, splits and reports over the driver's tables, each with its SQL.

The tables hold no commands, so a user's events stand for the turns of a trajectory, each kind for one real command.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import messages
from sparkloom.operators import audit, behaviour, reports, selection
from sparkloom.plans.registry import query
from sparkloom.sources import runs
from sparkloom.sources.tables import table

TURNS = {"click": "```bash\nsed -n 1,9p a.py\n```", "view": "```bash\ngrep -rn x .\n```", "purchase": "```bash\nsed -i s/a/b/ a.py\n```", "signup": "```bash\npytest -q\n```", "error": "All tests pass."}


def trajectories(spark, d: str) -> DataFrame:
    """A row per user: turns in order of time, and no prefix."""
    text: Column = F.lit(None).cast("string")
    for kind, turn in TURNS.items():
        text = F.when(F.col("event_type") == kind, F.lit(turn)).otherwise(text)
    e = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", text.alias("text")))).alias("e"))
    return e.select("user_id", F.transform("e", lambda x: x["text"]).alias("turns"), F.lit(None).cast(messages.MESSAGES).alias("prefix"))


@query("""WITH t AS (SELECT user_id, event_type AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
c AS (SELECT user_id, k, i, row_number() OVER (PARTITION BY user_id ORDER BY i) - row_number() OVER (PARTITION BY user_id, k ORDER BY i) AS island FROM t WHERE k <> 'error'),
r AS (SELECT user_id, max(n) AS run FROM (SELECT user_id, k, island, count(*) AS n FROM c GROUP BY ALL) GROUP BY 1),
f AS (SELECT user_id, min(i) FILTER (k = 'view') AS v, max(i) FILTER (k = 'click') AS last_c, min(i) FILTER (k = 'click') AS c, min(i) FILTER (k = 'purchase') AS p, min(i) FILTER (k = 'signup') AS s,
  count(*) FILTER (k = 'view') AS nv, count(*) FILTER (k = 'click') AS nc, count(*) FILTER (k <> 'error') AS n, count(DISTINCT k) FILTER (k <> 'error') AS u, count(*) AS turns FROM t GROUP BY 1),
x AS (SELECT user_id, count(*) AS claims FROM t JOIN f USING (user_id) WHERE k = 'error' AND coalesce(s > i, true) GROUP BY 1),
a AS (SELECT user_id, turns, n, u, nv, nc, coalesce(claims, 0) AS claims, coalesce(run, 0) AS run, p IS NOT NULL AS edited, s IS NOT NULL AS tested, p IS NOT NULL AND (c IS NULL OR p < c) AS early,
  coalesce(run, 0) >= 4 OR (n >= 8 AND (n - u) / n >= 0.5) AS loop, nv >= 2 AND NOT coalesce(last_c >= v, false) AS broad FROM f LEFT JOIN r USING (user_id) LEFT JOIN x USING (user_id))
SELECT user_id, false AS malformed_bash, loop, broad AS broad_search_without_inspect, claims > 0 AS unsupported_completion_claim, NOT (loop OR broad OR claims > 0) AS quality_pass, turns AS turn_count, n AS command_count, u AS unique_command_count,
run::BIGINT AS longest_run, nv AS search_count, nv AS broad_search_count, nc AS targeted_inspect_count, edited, tested, early AS edit_before_inspect, claims::BIGINT AS unsupported_claim_count FROM a""")
def trajectory_audit(spark, d: str) -> DataFrame:
    a = audit.audit(trajectories(spark, d))
    return a.select("user_id", *audit.FLAGS, "quality_pass", "turn_count", "command_count", "unique_command_count", F.col("max_consecutive_command_run").cast("long").alias("longest_run"), "search_count", "broad_search_count", "targeted_inspect_count", "edited", "tested", "edit_before_inspect", "unsupported_claim_count")


_LABELS = """t AS (SELECT user_id, event_type AS k, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
f AS (SELECT *, min(CASE WHEN k = 'purchase' THEN i END) OVER (PARTITION BY user_id) AS p FROM t),
l AS (SELECT user_id, i, CASE WHEN k = 'error' THEN CASE WHEN i = n THEN 'finalize' ELSE 'reason_plan' END WHEN k = 'purchase' THEN 'edit' WHEN k = 'signup' THEN CASE WHEN p < i THEN 'verify_test' ELSE 'reproduce_test' END ELSE CASE WHEN p < i THEN 'verify_inspect' ELSE 'inspect_diagnose' END END AS label FROM f)"""


@query(f"WITH {_LABELS} SELECT user_id, label, count(*) AS n FROM l GROUP BY 1, 2")
def behaviour_labels(spark, d: str) -> DataFrame:
    t = trajectories(spark, d).select("user_id", F.explode(behaviour.labels(F.col("turns"))).alias("label"))
    return t.groupBy("user_id", "label").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT user_id, event_type AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT user_id, min(i) FILTER (k = 'purchase') AS e, max(i) FILTER (k = 'purchase') AS last_e, min(i) FILTER (k = 'click') AS c, max(i) FILTER (k = 'signup') AS s FROM t GROUP BY 1)
SELECT user_id, coalesce(c < e, false) AS inspected_before_edit, coalesce(s > last_e, false) AS verified_after_edit, e AS first_edit_turn FROM f""")
def workflow_features(spark, d: str) -> DataFrame:
    w = audit.workflow(trajectories(spark, d))
    return w.select("user_id", "inspected_before_edit", "verified_after_edit", F.col("first_edit_turn").cast("long").alias("first_edit_turn"))


_CANON = "regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[ \\t\\n\\x0B\\f\\r]+$', '')"


@query(f"SELECT conv_id, count(*) AS n, sha256(string_agg(role || ':' || {_CANON}, chr(10) ORDER BY turn, role, text)) AS context FROM conversations GROUP BY 1")
def canonical_contexts(spark, d: str) -> DataFrame:
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    m = messages.canonical(messages.clean(F.col("m")))
    return c.select("conv_id", F.size("m").cast("long").alias("n"), F.sha2(F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "\n"), 256).alias("context"))


@query("""WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS x FROM documents), a AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, x, count(*) AS n FROM l WHERE x <> '' GROUP BY 1, 2) GROUP BY 1),
p AS (SELECT doc_id, substr(text, i::INT + 1, 40) AS x FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 40, 1), 20)) AS i FROM documents WHERE length(text) >= 320)), b AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, x, count(*) AS n FROM p GROUP BY 1, 2) GROUP BY 1)
SELECT doc_id, coalesce(a.n >= 5, false) OR coalesce(b.n >= 8, false) AS degenerate FROM documents LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)""")
def degenerate_texts(spark, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", messages.degenerate(F.col("text")).alias("degenerate"))


@query("""WITH k AS (SELECT user_id, max(value) AS s FROM events WHERE event_type = 'click' GROUP BY 1), c AS (SELECT user_id, max(value) AS s, count(*) % 2 = 0 AS q FROM events WHERE event_type = 'view' GROUP BY 1),
p AS (SELECT user_id, k.s AS ks, c.s AS cs, c.s - k.s AS g, c.s > k.s AS new, c.q AS cq FROM k JOIN c USING (user_id))
SELECT user_id, round(g, 6) AS challenger_delta, CASE WHEN g > 0 THEN 'challenger' WHEN g < 0 THEN 'king' END AS preferred_side, concat_ws(',', CASE WHEN g = 0 THEN 'missing_or_tied_scores' END, CASE WHEN g <> 0 AND abs(g) < 20 THEN 'delta_below_threshold' END, CASE WHEN g <> 0 AND greatest(ks, cs) < 200 THEN 'preferred_score_below_threshold' END, CASE WHEN g > 0 AND NOT cq THEN 'preferred_failed_quality_filter' END) AS reasons FROM p""")
def preference_reasons(spark, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("score"), (F.count("*") % 2 == 0).alias("even"))
    king = e.where("event_type = 'click'").select("user_id", "score", F.lit(True).alias("quality_pass"))
    new = e.where("event_type = 'view'").select("user_id", "score", F.col("even").alias("quality_pass"))
    p = selection.preference_pairs(king, new, ["user_id"], 20, 200)
    return p.select("user_id", F.round("challenger_delta", 6).alias("challenger_delta"), "preferred_side", F.array_join("rejection_reasons", ",").alias("reasons"))


@query("SELECT o_custkey, count(*) AS run_count, max(o_totalprice) AS max_score, round(avg(o_totalprice), 4) AS mean_score, max(o_totalprice) AS max_margin, true AS listed, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') AS priorities FROM orders GROUP BY 1")
def model_rollup(spark, d: str) -> DataFrame:
    r = reports.model_rollup(table(spark, d, "orders"), "o_custkey", "o_totalprice", "o_totalprice", priorities="o_orderpriority")
    return r.select("o_custkey", "run_count", "max_score", F.round("mean_score", 4).alias("mean_score"), "max_margin", F.lit(True).alias("listed"), F.array_join("priorities", ",").alias("priorities"))


@query("""SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 AND count(o_orderstatus) = count(*) THEN min(o_orderstatus) ELSE 'unknown' END AS o_orderstatus, CASE WHEN count(*) = 1 THEN min(o_totalprice) END AS o_totalprice FROM orders GROUP BY 1""")
def unanimous_status(spark, d: str) -> DataFrame:
    return reports.unanimous(table(spark, d, "orders"), ["o_custkey"], "o_orderstatus", "o_totalprice")


@query("""SELECT o_custkey, coalesce(max(o_totalprice) FILTER (o_orderstatus = 'F'), max(o_totalprice)) AS best FROM orders GROUP BY 1""")
def best_edited_reference(spark, d: str) -> DataFrame:
    return reports.best_edited(table(spark, d, "orders"), ["o_custkey"], "o_totalprice", (F.col("o_orderstatus") == "F"))


@query("""WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, count(*) AS rows, sum(n_chars)::BIGINT AS tokens, max(n_chars) FILTER (i = least(n - 1, floor(n * 0.5))) AS median, max(n_chars) FILTER (i = least(n - 1, floor(n * 0.9))) AS p90, round(sum(n_chars) / 24000.0 / 3600, 9) AS hours FROM r GROUP BY 1""")
def sequence_sizing(spark, d: str) -> DataFrame:
    return reports.sizing(table(spark, d, "documents"), "n_chars", 24000.0, "lang").withColumn("hours", F.round("hours", 9))


@query("""WITH b AS (SELECT l_suppkey, sum(l_tax - l_discount) AS x FROM lineitem GROUP BY 1), t AS (SELECT sum(least(x, 0)) AS total FROM b)
SELECT l_suppkey, round(x, 6) AS deficit, round(CASE WHEN x < 0 THEN x / total ELSE 0 END, 6) AS share FROM b, t ORDER BY x, l_suppkey LIMIT 10""")
def worst_ten(spark, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_tax") - F.col("l_discount")).alias("x"))
    return reports.worst(li, "l_suppkey", "x").select("l_suppkey", F.round("deficit", 6).alias("deficit"), F.round("share", 6).alias("share"))


@query("""WITH r AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY sha256(doc_id::VARCHAR), doc_id) AS turn FROM documents)
SELECT doc_id, row_number() OVER (ORDER BY turn, source, lang) AS place FROM r QUALIFY place <= 100""")
def round_robin_pick(spark, d: str) -> DataFrame:
    p = selection.round_robin(table(spark, d, "documents"), ["source", "lang"], 100, F.sha2(F.col("doc_id").cast("string"), 256), F.col("doc_id"))
    return p.select("doc_id", F.col("place").cast("long").alias("place"))


_H = "(0.1 * ((-l_quantity + l_tax * 100) - (-l_discount * 300 + 7)))"


@query(f"""SELECT l_orderkey, l_linenumber, round(sum(-least({_H}, 0) + ln(1 + exp(-abs({_H}))) + 0.2 * l_quantity / (l_linenumber + 1)), 6) AS loss, round(sum({_H}), 6) + 0.0 AS h, round(sum(-0.1 / (1 + exp({_H})) - 0.2 / (l_linenumber + 1)), 6) AS coef_chosen,
round(sum(0.1 / (1 + exp({_H}))), 6) AS coef_rejected, round(sum((-l_quantity + l_tax * 100) / (l_linenumber + 1)), 6) + 0.0 AS chosen_logratio, sum(({_H} > 0)::INT)::DOUBLE AS accuracy FROM lineitem GROUP BY 1, 2""")
def dpo_all_terms(spark, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    t = reports.dpo(-F.col("l_quantity"), -F.col("l_discount") * 300, -F.col("l_tax") * 100, F.lit(-7.0), F.col("l_linenumber") + 1, F.lit(1.0), nll_weight=0.2)
    names = ["loss", "h", "coef_chosen", "coef_rejected", "chosen_logratio"]
    return li.select("l_orderkey", "l_linenumber", *[t[n].alias(n) for n in [*names, "accuracy"]]).groupBy("l_orderkey", "l_linenumber").agg(*[(F.round(F.sum(n), 6) + 0.0).alias(n) for n in names], F.sum("accuracy").alias("accuracy"))


_D, _I = "(embedding[1]::DOUBLE - embedding[2]::DOUBLE)", "(embedding[1]::DOUBLE - embedding[3]::DOUBLE)"


@query(f"""SELECT label, round(sqrt(sum({_D} * {_D}) / count(*)), 5) AS drift_rms, round(sqrt(sum({_D} * {_D}) / count(*)) / 0.5, 5) AS drift_over_noise, round(sqrt(sum({_I} * {_I}) / count(*)) / 0.1, 4) AS increment_over_noise, round(sum({_D} * {_I}) / sqrt(sum({_D} * {_D}) * sum({_I} * {_I})), 5) AS increment_cos_total FROM embeddings GROUP BY GROUPING SETS ((label), ())""")
def drift_report(spark, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("label", *[F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate(("now", "initial", "previous"))])
    r = reports.drift(e, "label", 0.25, 0.01)
    return r.select("label", *[F.round(c, n).alias(c) for c, n in (("drift_rms", 5), ("drift_over_noise", 5), ("increment_over_noise", 4), ("increment_cos_total", 5))])


@query("""SELECT doc_id, unnest(list_filter([CASE WHEN quality = 1 THEN 'weighted' END, CASE WHEN quality = 1 AND toxic = 0 THEN 'strict' END, CASE WHEN toxic = 1 THEN 'review' END], lambda x: x IS NOT NULL)) AS tier FROM labels""")
def overlapping_tiers(spark, d: str) -> DataFrame:
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    return selection.tiers(table(spark, d, "labels"), weighted=q, strict=q & ~t, review=t).select("doc_id", "tier")


@query("""SELECT user_id, count(DISTINCT event_type) >= 2 AS replicas, count(DISTINCT props) = 1 AND count(props) = count(*) AS one_checklist, count(*) FILTER (event_type = 'error') = 0 AS no_error,
count(DISTINCT event_type) >= 2 AND count(DISTINCT props) = 1 AND count(props) = count(*) AND count(*) FILTER (event_type = 'error') = 0 AS ready FROM events GROUP BY 1""")
def holdout_ready(spark, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("replica"), F.col("props").alias("checklist"), F.when(F.col("event_type") == "error", "error").alias("error"), F.lit("c").alias("context"))
    return selection.ready(e, ["user_id"]).drop("one_context")


@query("""WITH k AS (SELECT doc_id, min('d:' || doc_id) OVER (PARTITION BY text) AS component FROM documents)
SELECT doc_id, component, CASE WHEN ('0x' || substr(sha256('split:' || component), 1, 8))::BIGINT / 4294967296.0 < 0.2 THEN 'dev' ELSE 'train' END AS split FROM k""")
def leak_safe_split(spark, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", F.array(F.concat(F.lit("d:"), F.col("doc_id").cast("string")), F.concat(F.lit("t:"), F.sha2("text", 256))).alias("keys"))
    return selection.group_split(t, "doc_id", "keys", 0.2).select("doc_id", "component", "split")


@query("""SELECT user_id, bool_or(value / 500 > 0.5 AND value / 500 < 1) AS high, coalesce(bool_or(least(value / 300, 1) > 0.99 AND least(value / 300, 1) < 1), false) AS graded FROM events GROUP BY 1""")
def graded_scales(spark, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "value", F.least(F.col("value") / 300, F.lit(1.0)).alias("score"))
    high = e.groupBy("user_id").agg(F.bool_or((F.col("value") / 500 > 0.5) & (F.col("value") / 500 < 1)).alias("high"))
    return high.join(runs.graded_runs(e, "user_id", "score"), "user_id")


@query("""WITH c AS (SELECT l_suppkey AS shard, l_linenumber AS row, round(sum(l_discount), 6) AS probability, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS phases, count(*) AS cuts FROM lineitem GROUP BY 1, 2)
SELECT s.n_nationkey::BIGINT AS shard, r.r_regionkey::INT AS row, probability, phases, coalesce(cuts, 0) AS cuts FROM nation s, region r LEFT JOIN c ON c.shard = s.n_nationkey AND c.row = r.r_regionkey""")
def cut_points(spark, d: str) -> DataFrame:
    t = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("shard")).crossJoin(F.broadcast(table(spark, d, "region").select(F.col("r_regionkey").cast("int").alias("row"))))
    c = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("shard"), F.col("l_linenumber").alias("row"), F.col("l_discount").alias("probability"), F.col("l_returnflag").alias("phase"))
    return runs.with_cuts(t, c).withColumn("probability", F.round("probability", 6))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderdate, o_orderkey) AS rank FROM orders) SELECT * FROM r WHERE rank <= 3""")
def top_challengers(spark, d: str) -> DataFrame:
    r = selection.top_ranked(table(spark, d, "orders"), ["o_custkey"], 3, F.col("o_totalprice").desc(), F.col("o_orderdate"), F.col("o_orderkey"))
    return r.select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice) / sum(l_quantity), 4) AS nll, sum(l_quantity) AS tokens, count(*) AS rows FROM lineitem GROUP BY 1, 2""")
def weighted_nll(spark, d: str) -> DataFrame:
    return reports.weighted_nll(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", "l_quantity").withColumn("nll", F.round("nll", 4))


@query("""SELECT 'discount' AS feature, round(avg(l_discount) FILTER (l_returnflag = 'A'), 6) AS chosen, round(avg(l_discount) FILTER (l_returnflag = 'R'), 6) AS rejected, round(avg(l_discount) FILTER (l_returnflag = 'A') - avg(l_discount) FILTER (l_returnflag = 'R'), 6) AS difference FROM lineitem
UNION ALL SELECT 'tax', round(avg(l_tax) FILTER (l_returnflag = 'A'), 6), round(avg(l_tax) FILTER (l_returnflag = 'R'), 6), round(avg(l_tax) FILTER (l_returnflag = 'A') - avg(l_tax) FILTER (l_returnflag = 'R'), 6) FROM lineitem""")
def paired_features(spark, d: str) -> DataFrame:
    side = lambda s, flag, c: F.when(F.col("l_returnflag") == flag, F.col(f"l_{c}")).alias(f"{s}_{c}")
    p = table(spark, d, "lineitem").select(*[side(s, flag, c) for c in ("discount", "tax") for s, flag in (("chosen", "A"), ("rejected", "R"))])
    return reports.paired_features(p, "discount", "tax").select("feature", *[F.round(c, 6).alias(c) for c in ("chosen", "rejected", "difference")])


@query("""SELECT o.o_orderkey FROM orders o WHERE o.o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45)""")
def unused_orders(spark, d: str) -> DataFrame:
    used = table(spark, d, "lineitem").where("l_quantity >= 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(used, "o_orderkey", "left_anti")
