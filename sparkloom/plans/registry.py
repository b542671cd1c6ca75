"""Queries of the reference operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions import coerce
from sparkloom.operators import running
from sparkloom.operators.components import components
from sparkloom.operators.groups import segment_udf
from sparkloom.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


SQZ = "trim(regexp_replace(coalesce({0}, ''), '[ \\t\\r\\n]+', ' ', 'g'))"
SCORED = "SELECT event_id, ts, user_id, event_type, least(value / 500, 1.0) AS score FROM events"


def scored(spark, d: str, *more: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", "ts", "user_id", "event_type", F.least(F.col("value") / 500, F.lit(1.0)).alias("score"), *more)


def duels(means: DataFrame) -> DataFrame:
    """Each user's mean of a kind of event less that of views."""
    king = means.where("event_type = 'view'").select("user_id", F.col("m").alias("king"), F.col("error").alias("king_error"))
    return means.where("event_type <> 'view'").join(king, "user_id").withColumn("delta", F.col("m") - F.col("king"))


@query(f"""WITH b AS (SELECT d.doc_id, d.source, l.quality, l.toxic, sha256(lower({SQZ.format('d.text')})) AS task_key FROM documents d LEFT JOIN labels l USING (doc_id)),
r AS (SELECT *, count(*) OVER (PARTITION BY task_key) AS dup_count, row_number() OVER (PARTITION BY source, task_key ORDER BY coalesce(quality, -1) DESC, doc_id) AS instance_rank FROM b),
t AS (SELECT *, row_number() OVER (PARTITION BY task_key ORDER BY instance_rank, coalesce(quality, -1) DESC, doc_id) AS task_rank FROM r)
SELECT doc_id, source, task_key, dup_count, instance_rank, task_rank, coalesce(quality = 1 AND coalesce(toxic, 0) = 0, false) AND instance_rank = 1 AND task_rank = 1 AS eligible,
CASE WHEN ('0x' || substr(sha256(task_key), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 < 0.1 THEN 'dev' ELSE 'train' END AS split FROM t""")
def catalog_dedup(spark, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    b = docs.join(labels, "doc_id", "left").select("doc_id", "source", "quality", "toxic", F.sha2(F.lower(coerce.squeezed(F.col("text"))), 256).alias("task_key"))
    q = F.coalesce("quality", F.lit(-1))
    b = b.withColumn("dup_count", F.count("*").over(W.partitionBy("task_key")))
    b = b.withColumn("instance_rank", F.row_number().over(W.partitionBy("source", "task_key").orderBy(q.desc(), "doc_id")))
    b = b.withColumn("task_rank", F.row_number().over(W.partitionBy("task_key").orderBy("instance_rank", q.desc(), "doc_id")))
    base = F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False))
    split = F.when(coerce.unit_hash(F.col("task_key")) < 0.1, "dev").otherwise("train")
    return b.select("doc_id", "source", "task_key", "dup_count", "instance_rank", "task_rank", (base & (F.col("instance_rank") == 1) & (F.col("task_rank") == 1)).alias("eligible"), split.alias("split"))


@query("""SELECT d.source, count(*) AS n, count(DISTINCT d.text) AS n_texts, coalesce(sum(l.toxic), 0)::BIGINT AS n_toxic, coalesce(sum((l.quality > 0)::INT), 0)::BIGINT AS n_good, sum((d.n_chars > 2000)::INT)::BIGINT AS n_long
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source""")
def catalog_summary(spark, d: str) -> DataFrame:
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return j.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("text").alias("n_texts"), total("toxic").alias("n_toxic"), total((F.col("quality") > 0).cast("int")).alias("n_good"), total((F.col("n_chars") > 2000).cast("int")).alias("n_long"))


_BAND = "CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 5000 THEN 'middle' ELSE 'long' END"


@query(f"SELECT source, lang, band, count(*) AS n FROM (SELECT *, {_BAND} AS band FROM documents) GROUP BY GROUPING SETS ((source), (lang), (band), ())")
def marginal_counts(spark, d: str) -> DataFrame:
    table(spark, d, "documents").withColumn("band", F.expr(_BAND)).createOrReplaceTempView("marginal_docs")
    return spark.sql("SELECT source, lang, band, count(*) AS n FROM marginal_docs GROUP BY GROUPING SETS ((source), (lang), (band), ())")


_LABEL = "CASE WHEN role <> 'assistant' THEN 'other' WHEN length(text) < 100 THEN 'short' ELSE 'long' END"


@query(f"""WITH t AS (SELECT conv_id, turn, role, {_LABEL} AS label, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, text) AS chars, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS ordinal, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn, text) AS next_turn FROM conversations)
SELECT conv_id, max(chars)::BIGINT AS chars, count(*) FILTER (role = 'assistant') AS n_assistant, min(ordinal) FILTER (label = 'long') AS first_long, coalesce(bool_or(label = 'long'), false) AS any_long, count(next_turn) AS n_followed FROM t GROUP BY conv_id""")
def turn_features(spark, d: str) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy("turn", "text")
    t = table(spark, d, "conversations").withColumn("label", F.expr(_LABEL)).withColumn("chars", F.sum(F.length("text")).over(w))
    t = t.withColumn("ordinal", F.row_number().over(W.partitionBy("conv_id", "role").orderBy("turn", "text"))).withColumn("next_turn", F.lead("turn").over(w))
    return t.groupBy("conv_id").agg(F.max("chars").alias("chars"), F.count_if(F.col("role") == "assistant").alias("n_assistant"), F.min(F.when(F.col("label") == "long", F.col("ordinal"))).alias("first_long"), F.bool_or(F.col("label") == "long").alias("any_long"), F.count("next_turn").alias("n_followed"))


@query("""WITH a AS (SELECT conv_id, lb, count(*) AS c, min(pos) AS p FROM (SELECT conv_id, CASE WHEN length(text) < 100 THEN 'short' ELSE 'long' END AS lb, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS pos FROM conversations) GROUP BY 1, 2)
SELECT conv_id, lb AS dominant, c AS n FROM a QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY c DESC, p) = 1""")
def dominant_behaviour(spark, d: str) -> DataFrame:
    t = table(spark, d, "conversations").withColumn("lb", F.when(F.length("text") < 100, "short").otherwise("long"))
    t = t.withColumn("pos", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "text")))
    a = t.groupBy("conv_id", "lb").agg(F.count("*").alias("c"), F.min("pos").alias("p"))
    return a.groupBy("conv_id").agg(F.max_by("lb", F.struct("c", -F.col("p"))).alias("dominant"), F.max("c").alias("n"))


@query("""WITH l AS (SELECT user_id, event_id, event_type, ts, coalesce((event_type <> lag(event_type) OVER w)::INT, 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM l)
SELECT user_id, max(n) AS longest_run, sum((n > 1)::INT)::BIGINT AS n_runs FROM (SELECT user_id, island, count(*) AS n FROM i GROUP BY 1, 2) GROUP BY user_id""")
def repeat_runs(spark, d: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("new", F.coalesce((F.col("event_type") != F.lag("event_type").over(w)).cast("int"), F.lit(1)))
    runs = e.withColumn("island", F.sum("new").over(w)).groupBy("user_id", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("user_id").agg(F.max("n").alias("longest_run"), F.sum((F.col("n") > 1).cast("int")).alias("n_runs"))


_FLAGS = [("short", "n_chars < 200"), ("symbols", "{0}(text, '[#*$%&|]{{3}}')"), ("repeats", "{0}(text, ' the the ')"), ("long", "n_chars > 20000")]


@query("WITH f AS (SELECT array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c.format('regexp_matches')} THEN '{n}' END" for n, c in _FLAGS) + "], lambda x: x IS NOT NULL), '+') AS flags FROM documents) SELECT flags, count(*) AS n FROM f GROUP BY flags")
def flag_histogram(spark, d: str) -> DataFrame:
    flags = F.array_compact(F.array(*[F.when(F.expr(c.format("regexp_like")), F.lit(n)) for n, c in _FLAGS]))
    return table(spark, d, "documents").groupBy(F.array_join(flags, "+").alias("flags")).agg(F.count("*").alias("n"))


@query(f"""WITH s AS ({SCORED}), p AS (SELECT a.user_id, a.event_id AS chosen, b.event_id AS rejected, a.score - b.score AS margin, row_number() OVER (PARTITION BY a.user_id ORDER BY a.score - b.score DESC, a.event_id, b.event_id) AS rk
FROM s a JOIN s b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'error' AND a.score - b.score >= 0.15)
SELECT user_id, chosen, rejected, margin FROM p WHERE rk = 1""")
def preference_pairs(spark, d: str) -> DataFrame:
    # the largest gap needs each side's extremes only, so no pairs are formed: best against worst, first of equals
    s = scored(spark, d).where(F.col("event_type").isin("purchase", "error"))
    best = F.max_by(F.struct("event_id", "score"), F.when(F.col("event_type") == "purchase", F.struct("score", -F.col("event_id"))))
    worst = F.min_by(F.struct("event_id", "score"), F.when(F.col("event_type") == "error", F.struct("score", "event_id")))
    g = s.groupBy("user_id").agg(best.alias("b"), worst.alias("w"), F.count_if(F.col("event_type") == "purchase").alias("nb"), F.count_if(F.col("event_type") == "error").alias("nw")).where("nb > 0 and nw > 0")
    return g.select("user_id", F.col("b.event_id").alias("chosen"), F.col("w.event_id").alias("rejected"), (F.col("b.score") - F.col("w.score")).alias("margin")).where("margin >= 0.15")


_REPLICA = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax)"


@query(f"""WITH r AS (SELECT l_orderkey, {_REPLICA} AS replica, l_discount AS score FROM lineitem), two AS (SELECT * FROM r WHERE replica <= 2),
g AS (SELECT l_orderkey, max(score) AS best, min(score) AS worst FROM two GROUP BY 1 HAVING count(*) = 2)
SELECT l_orderkey, best, worst, ('0x' || substr(sha256(l_orderkey::VARCHAR), 1, 8))::BIGINT % 1000 < 80 AS is_dev FROM g WHERE best - worst >= 0.045""")
def best_vs_worst(spark, d: str) -> DataFrame:
    r = table(spark, d, "lineitem").select("l_orderkey", F.expr(_REPLICA).alias("replica"), F.col("l_discount").alias("score")).where("replica <= 2")
    g = r.groupBy("l_orderkey").agg(F.max("score").alias("best"), F.min("score").alias("worst"), F.count("*").alias("n")).where("n = 2 and best - worst >= 0.045")
    return g.select("l_orderkey", "best", "worst", (coerce.hash_mod(F.col("l_orderkey").cast("string"), 1000) < 80).alias("is_dev"))


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_row_wins(spark, d: str) -> DataFrame:
    last = F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("r")
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(last).select("user_id", "event_type", "r.event_id", "r.value")


@query("""WITH a AS (SELECT user_id, arg_max(value, (ts, event_id)) AS v FROM events WHERE event_type = 'click' AND event_id % 3 = 0 GROUP BY 1), b AS (SELECT user_id, arg_max(value, (ts, event_id)) AS v FROM events WHERE event_type = 'view' AND event_id % 5 = 0 GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, a.v AS generated, b.v AS scored, coalesce(a.v, b.v) AS source FROM a FULL JOIN b ON a.user_id = b.user_id""")
def full_outer_upsert(spark, d: str) -> DataFrame:
    e = table(spark, d, "events")
    side = lambda t, n, c: e.where((F.col("event_type") == t) & (F.col("event_id") % n == 0)).groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias(c))
    j = side("click", 3, "generated").join(side("view", 5, "scored"), "user_id", "full_outer")
    return j.withColumn("source", F.coalesce("generated", "scored"))


@query("""WITH a AS (SELECT user_id, arg_max(value, (ts, event_id)) AS v FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id, arg_max(value, (ts, event_id)) AS v FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, a.v AS generated, b.v AS scored, coalesce(a.v, b.v) AS source FROM a FULL JOIN b ON a.user_id = b.user_id""")
def full_outer_upsert_all(spark, d: str) -> DataFrame:
    """All clicks and views; full_outer_upsert reads every third and every fifth event id."""
    e = table(spark, d, "events")
    side = lambda t, c: e.where(F.col("event_type") == t).groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias(c))
    return side("click", "generated").join(side("view", "scored"), "user_id", "full_outer").withColumn("source", F.coalesce("generated", "scored"))


@query("SELECT c_custkey, c_nationkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def left_anti_used(spark, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_nationkey").join(o, "c_custkey", "left_anti")


@query("SELECT c_custkey, c_nationkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
def left_semi_wanted(spark, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_nationkey").join(o, "c_custkey", "left_semi")


@query("""WITH l AS (SELECT l_orderkey AS k, max(l_quantity) AS q FROM lineitem GROUP BY 1)
SELECT o.o_orderkey, coalesce(a.q, b.q) AS quantity, a.q IS NULL AS fell_back FROM orders o LEFT JOIN l a ON a.k = o.o_orderkey + 1 LEFT JOIN l b ON b.k = o.o_orderkey""")
def fallback_join(spark, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_quantity").alias("q"))  # noqa: E741
    o = table(spark, d, "orders").select("o_orderkey")
    a, b = l.select((F.col("l_orderkey") - 1).alias("o_orderkey"), F.col("q").alias("a")), l.select(F.col("l_orderkey").alias("o_orderkey"), F.col("q").alias("b"))
    return o.join(a, "o_orderkey", "left").join(b, "o_orderkey", "left").select("o_orderkey", F.coalesce("a", "b").alias("quantity"), F.col("a").isNull().alias("fell_back"))


@query(f"WITH r AS (SELECT l_orderkey, l_tax, l_discount, {_REPLICA} AS k FROM lineitem) SELECT a.l_orderkey, a.k, a.l_tax AS generated, b.l_discount AS score FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.k + 1 = b.k")
def positional_join(spark, d: str) -> DataFrame:
    r = table(spark, d, "lineitem").select("l_orderkey", "l_tax", "l_discount", F.expr(_REPLICA).alias("k"))
    after = F.lead("l_discount").over(W.partitionBy("l_orderkey").orderBy("k"))
    return r.select("l_orderkey", "k", F.col("l_tax").alias("generated"), after.alias("score"), F.lead("k").over(W.partitionBy("l_orderkey").orderBy("k")).alias("n")).where("n is not null").drop("n")


@query("""WITH t AS (SELECT conv_id, turn, string_agg(role || chr(31) || text, chr(30)) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING) AS prefix FROM conversations),
h AS (SELECT conv_id, turn, sha256(prefix) AS prefix_hash FROM t) SELECT prefix_hash, count(DISTINCT conv_id) AS n_convs, min(conv_id) AS first_conv FROM h GROUP BY 1""")
def prefix_hash_join(spark, d: str) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy("turn", "text").rowsBetween(W.unboundedPreceding, 0)
    parts = F.collect_list(F.concat("role", F.lit("\x1f"), "text")).over(w)
    t = table(spark, d, "conversations").select("conv_id", F.sha2(F.array_join(parts, "\x1e"), 256).alias("prefix_hash"))
    return t.groupBy("prefix_hash").agg(F.countDistinct("conv_id").alias("n_convs"), F.min("conv_id").alias("first_conv"))


@query("""WITH s AS (SELECT source, lang, CASE WHEN doc_id % 10 = 0 THEN 'dev' ELSE 'train' END AS split FROM documents), c AS (SELECT split, source, lang, count(*) AS n FROM s GROUP BY ALL), m AS (SELECT split, sum(n * (1 / sqrt(n))) / sum(n) AS mean FROM c GROUP BY 1)
SELECT split, source, lang, n, least(greatest(1 / sqrt(n) / mean, 0.25), 4) AS weight FROM c JOIN m USING (split)""")
def strata_weights(spark, d: str) -> DataFrame:
    s = table(spark, d, "documents").withColumn("split", F.when(F.col("doc_id") % 10 == 0, "dev").otherwise("train"))
    c = s.groupBy("split", "source", "lang").agg(F.count("*").alias("n"))
    w = W.partitionBy("split")
    mean = F.sum(F.col("n") * (1 / F.sqrt("n"))).over(w) / F.sum("n").over(w)
    return c.withColumn("weight", F.least(F.greatest(1 / F.sqrt("n") / mean, F.lit(0.25)), F.lit(4.0)))


@query("SELECT doc_id, source FROM documents ORDER BY sha256(doc_id::VARCHAR || ':' || text) NULLS FIRST, doc_id LIMIT 100")
def bottom_k_hash_sample(spark, d: str) -> DataFrame:
    key = F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "text"), 256)
    return table(spark, d, "documents").orderBy(key, "doc_id").limit(100).select("doc_id", "source")


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256('7:' || doc_id::VARCHAR), doc_id) <= CASE lang WHEN 'en' THEN 65 WHEN 'fr' THEN 15 ELSE 20 END")
def stratified_pick(spark, d: str) -> DataFrame:
    rk = F.row_number().over(W.partitionBy("lang").orderBy(F.sha2(F.concat(F.lit("7:"), F.col("doc_id").cast("string")), 256), "doc_id"))
    quota = F.when(F.col("lang") == "en", 65).when(F.col("lang") == "fr", 15).otherwise(20)
    return table(spark, d, "documents").withColumn("rk", rk).where(F.col("rk") <= quota).select("doc_id", "lang")


@query(f"""WITH t AS (SELECT user_id, event_type, avg(score) AS m FROM ({SCORED}) GROUP BY 1, 2), k AS (SELECT user_id, m AS king FROM t WHERE event_type = 'view'), j AS (SELECT event_type, m - king AS delta FROM t JOIN k USING (user_id) WHERE event_type <> 'view')
SELECT event_type AS policy, count(*) AS n, avg(delta) AS mean_delta, sum((delta > 0.05)::INT)::BIGINT AS wins, sum((abs(delta) <= 0.05)::INT)::BIGINT AS ties, sum((delta < -0.05)::INT)::BIGINT AS losses FROM j GROUP BY 1""")
def duel_summary(spark, d: str) -> DataFrame:
    e = scored(spark, d, "_metadata.file_path", "_metadata.row_index")
    t = e.groupBy("user_id", "event_type").agg(F.avg("score").alias("m"), F.count("score").alias("n"), F.avg(F.abs("score")).alias("size"))
    # two orders of additions differ by less than that in a mean
    t = t.withColumn("error", (F.col("n") + 4) * 2.0**-50 * (F.col("size") + 0.05))
    at_limit = F.abs(F.abs("delta") - 0.05) <= F.col("error") + F.col("king_error")
    j = duels(t).withColumn("at_limit", F.bool_or(at_limit).over(W.partitionBy("user_id")))
    # where a difference meets the limit, means are added in the order of the table, as the SQL's engine does in one thread
    few = e.join(j.where("at_limit").select("user_id").distinct(), "user_id", "left_semi")
    again = running.ordered_means(few, ["user_id", "event_type"], ["file_path", "row_index"], "score").select("user_id", "event_type", F.col("mean").alias("m"), F.lit(0.0).alias("error"))
    j = j.where(~F.col("at_limit")).select("event_type", "delta").unionByName(duels(again).select("event_type", "delta"))
    return j.groupBy(F.col("event_type").alias("policy")).agg(F.count("*").alias("n"), F.avg("delta").alias("mean_delta"), F.count_if(F.col("delta") > 0.05).alias("wins"), F.count_if(F.abs("delta") <= 0.05).alias("ties"), F.count_if(F.col("delta") < -0.05).alias("losses"))


@query("""WITH t AS (SELECT l_returnflag, l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_orderkey) AS x, l_quantity - avg(l_quantity) OVER (PARTITION BY l_orderkey) AS y FROM lineitem)
SELECT l_returnflag, round(corr(x, y), 6) AS r, round(covar_pop(x, y) / var_pop(x), 9) AS slope FROM t GROUP BY 1""")
def within_group_corr(spark, d: str) -> DataFrame:
    w = W.partitionBy("l_orderkey")
    t = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_extendedprice") - F.avg("l_extendedprice").over(w)).alias("x"), (F.col("l_quantity") - F.avg("l_quantity").over(w)).alias("y"))
    return t.groupBy("l_returnflag").agg(F.round(F.corr("x", "y"), 6).alias("r"), F.round(F.covar_pop("x", "y") / F.var_pop("x"), 9).alias("slope"))


@query("""WITH r AS (SELECT l_shipmode, v, row_number() OVER (PARTITION BY l_shipmode ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY l_shipmode) AS n FROM (SELECT l_linestatus AS l_shipmode, l_extendedprice AS v FROM lineitem))
SELECT l_shipmode AS status, n, max(v) FILTER (i = least(n - 1, floor(0.9 * n)::BIGINT)) AS p90_a, max(v) FILTER (i = floor(0.9 * (n - 1))::BIGINT) AS p90_b, max(v) FILTER (i = (9 * n) // 10) AS p90_c, median(v) AS middle FROM r GROUP BY 1, 2""")
def quantiles_three_ways(spark, d: str) -> DataFrame:
    # ranks come from a window, so no array of a group's values is built
    w = W.partitionBy("status")
    r = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("status"), F.col("l_extendedprice").alias("v"))
    r = r.withColumn("i", F.row_number().over(w.orderBy("v")) - 1).withColumn("n", F.count("*").over(w))
    at = lambda e: F.max(F.when(F.col("i") == F.expr(e), F.col("v")))
    return r.groupBy("status", "n").agg(at("least(n - 1, floor(0.9D * n))").alias("p90_a"), at("floor(0.9D * (n - 1))").alias("p90_b"), at("(9 * n) div 10").alias("p90_c"), F.median("v").alias("middle"))


@query(f"""WITH u AS (SELECT user_id, max(score) AS best, min(score) AS worst, avg(score) AS mean FROM ({SCORED}) GROUP BY 1), g AS (SELECT *, CASE WHEN mean >= 0.5 THEN 'A' WHEN best >= 0.85 AND best - worst >= 0.2 THEN 'C1' WHEN best >= 0.85 THEN 'B' ELSE 'C2' END AS grp FROM u)
SELECT grp, count(*) AS n, count(*) / sum(count(*)) OVER () AS share, sum(best - mean) AS headroom, sum((best - worst >= 0.1)::INT)::BIGINT AS m10, sum((best - worst >= 0.4)::INT)::BIGINT AS m40 FROM g GROUP BY grp""")
def pool_groups(spark, d: str) -> DataFrame:
    u = scored(spark, d).groupBy("user_id").agg(F.max("score").alias("best"), F.min("score").alias("worst"), F.avg("score").alias("mean"))
    gap = F.col("best") - F.col("worst")
    u = u.withColumn("grp", F.when(F.col("mean") >= 0.5, "A").when((F.col("best") >= 0.85) & (gap >= 0.2), "C1").when(F.col("best") >= 0.85, "B").otherwise("C2"))
    g = u.groupBy("grp").agg(F.count("*").alias("n"), F.sum(F.col("best") - F.col("mean")).alias("headroom"), F.count_if(gap >= 0.1).alias("m10"), F.count_if(gap >= 0.4).alias("m40"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


@query(f"""WITH u AS (SELECT user_id, min(score) AS king, max(score) AS ref FROM ({SCORED}) GROUP BY 1), g AS (SELECT * FROM (VALUES (0.3), (0.5), (0.7)) a(a), (VALUES (0.8), (0.9)) b(b))
SELECT a::DOUBLE AS a, b::DOUBLE AS b, sum((king <= a AND ref >= b)::INT)::BIGINT AS n FROM u, g GROUP BY ALL""")
def threshold_grid(spark, d: str) -> DataFrame:
    u = scored(spark, d).groupBy("user_id").agg(F.min("score").alias("king"), F.max("score").alias("ref"))
    cells = [(a, b) for a in (0.3, 0.5, 0.7) for b in (0.8, 0.9)]
    counts = u.agg(*[F.count_if((F.col("king") <= a) & (F.col("ref") >= b)).alias(f"c{k}") for k, (a, b) in enumerate(cells)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("n")) for k, (a, b) in enumerate(cells)])
    return counts.select(F.inline(rows))


@query("SELECT event_id, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING) AS mean5 FROM events")
def rolling_mean(spark, d: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return table(spark, d, "events").select("event_id", F.avg("value").over(w).alias("mean5"))


_LR = "CASE WHEN step < 10 THEN 5e-7 * (step + 1) / 10.0 ELSE 5e-8 + (5e-7 - 5e-8) * 0.5 * (1 + cos(pi() * (step - 10) / 90.0)) END"


@query(f"SELECT step, round(({_LR}) * 1e9, 6) AS lr FROM range(100) t(step)")
def lr_schedule(spark, d: str) -> DataFrame:
    warm, floor, top = 10, 5e-8, 5e-7
    s = F.col("id")
    lr = F.when(s < warm, top * (s + 1) / warm).otherwise(floor + (top - floor) * 0.5 * (1 + F.cos(F.pi() * (s - warm) / 90.0)))
    return spark.range(100).select(F.col("id").alias("step"), F.round(lr * 1e9, 6).alias("lr"))


@query("""WITH h AS (SELECT l_orderkey, l_linenumber, l_partkey, 0.1 * ((l_extendedprice / 1000 - l_quantity) - (l_discount * 10 - l_tax * 10)) AS h FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(-h, 0) + ln(1 + exp(-abs(h))), 6) AS loss, h > 0 AS correct FROM h""")
def dpo_terms(spark, d: str) -> DataFrame:
    h = 0.1 * ((F.col("l_extendedprice") / 1000 - F.col("l_quantity")) - (F.col("l_discount") * 10 - F.col("l_tax") * 10))
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", h.alias("h"))
    loss = F.greatest(-F.col("h"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("h")))
    return t.select("l_orderkey", "l_linenumber", "l_partkey", F.round(loss, 6).alias("loss"), (F.col("h") > 0).alias("correct"))


@query("SELECT label, round(sqrt(avg(x * x)), 6) AS rms, count(*) AS n FROM (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label")
def drift_rms(spark, d: str) -> DataFrame:
    x = table(spark, d, "embeddings").select("label", F.explode("embedding").alias("x")).withColumn("x", F.col("x").cast("double"))
    return x.groupBy("label").agg(F.round(F.sqrt(F.avg(F.col("x") * F.col("x"))), 6).alias("rms"), F.count("*").alias("n"))


@query("SELECT sha256(text) AS text_hash, count(*) AS n, min(doc_id) AS first_doc, count(DISTINCT source) AS n_sources FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.countDistinct("source").alias("n_sources")).where("n > 1")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS x, (l_suppkey * 7) % 50 AS y FROM lineitem), b AS (SELECT x, y FROM e WHERE x <> y UNION SELECT y, x FROM e WHERE x <> y),
r(id, root) AS (SELECT x, x FROM b UNION SELECT b.y, r.root FROM r JOIN b ON b.x = r.id) SELECT id, min(root) AS root FROM r GROUP BY id""")
def connected_components(spark, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), ((F.col("l_suppkey") * 7) % 50).alias("b")).distinct()
    return components(e)


@query("""WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT a.conv_id, a.pos AS k, sum(length(b.text))::BIGINT AS prefix_chars, count(*) AS n_messages FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.pos <= a.pos WHERE a.role = 'assistant' GROUP BY 1, 2""")
def prefix_rows(spark, d: str) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy("turn", "text").rowsBetween(W.unboundedPreceding, 0)
    t = table(spark, d, "conversations").select("conv_id", "role", F.count("*").over(w).alias("k"), F.sum(F.length("text")).over(w).alias("prefix_chars"))
    return t.where("role = 'assistant'").select("conv_id", F.col("k").cast("int").alias("k"), "prefix_chars", F.col("k").alias("n_messages"))


@query()
def behaviour_segments(spark, d: str) -> DataFrame:
    t = table(spark, d, "conversations").withColumn("lb", F.when(F.length("text") < 100, "short").otherwise("long"))
    g = t.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text", "lb"))), lambda x: x["lb"]).alias("labels"))
    return g.select("conv_id", "labels", segment_udf()("labels").alias("ends"))


@query(f"""WITH d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), b AS (SELECT DISTINCT lower({SQZ.format('text')}) AS line FROM benchmark)
SELECT doc_id, count(*) AS n_lines FROM d WHERE lower({SQZ.format('line')}) IN (SELECT line FROM b) GROUP BY doc_id""")
def contamination(spark, d: str) -> DataFrame:
    b = table(spark, d, "benchmark").select(F.lower(coerce.squeezed(F.col("text"))).alias("line"))
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.lower(coerce.squeezed(F.col("line"))))
    return lines.join(b, "line", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n_lines"))


#: Words of a benchmark text by which documents that may hold it are found.
ANCHOR = 5


@query(f"""WITH b AS (SELECT DISTINCT lower({SQZ.format('text')}) AS item FROM benchmark), d AS (SELECT doc_id, ' ' || lower({SQZ.format('text')}) || ' ' AS words FROM documents)
SELECT doc_id, count(DISTINCT item) AS n_items FROM d JOIN b ON item <> '' AND contains(words, ' ' || item || ' ') GROUP BY doc_id""")
def contamination_passages(spark, d: str) -> DataFrame:
    """Benchmark texts anywhere in a document, across line breaks too; contamination counts whole lines only."""
    squeezed = F.lower(coerce.squeezed(F.col("text")))
    b = table(spark, d, "benchmark").select(squeezed.alias("item")).where("item <> ''").distinct()
    b = b.withColumn("start", F.substring_index("item", " ", ANCHOR)).withColumn("n", F.size(F.split("start", " ")))
    docs = table(spark, d, "documents").select("doc_id", squeezed.alias("words"))
    # the lengths are ANCHOR rows at most
    starts = docs.crossJoin(F.broadcast(b.select("n").distinct())).withColumn("w", F.split("words", " ")).where("size(w) >= n")
    starts = starts.select("doc_id", "words", F.explode(F.array_distinct(F.expr("transform(sequence(0, size(w) - n), i -> array_join(slice(w, i + 1, n), ' '))"))).alias("start"))
    found = starts.join(b.select("item", "start"), "start").where(F.expr("contains(concat(' ', words, ' '), concat(' ', item, ' '))"))
    return found.groupBy("doc_id").agg(F.countDistinct("item").alias("n_items"))


@query("SELECT event_type, count(props) AS n, count(DISTINCT md5(props)) AS n_distinct, sum((props::JSON IS NOT NULL)::INT)::BIGINT AS n_json FROM events GROUP BY 1")
def json_props(spark, d: str) -> DataFrame:
    ok = F.get_json_object("props", "$").isNotNull()
    return table(spark, d, "events").groupBy("event_type").agg(F.count("props").alias("n"), F.countDistinct(F.md5("props")).alias("n_distinct"), F.count_if(ok).alias("n_json"))


@query("SELECT user_id, sum((event_type = 'click')::INT)::BIGINT AS click, sum((event_type = 'error')::INT)::BIGINT AS error, sum((event_type = 'view')::INT)::BIGINT AS \"view\", count(*) AS total FROM events GROUP BY 1")
def cross_tab(spark, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id")
    kind = lambda t: F.count_if(F.col("event_type") == t).alias(t)
    return e.agg(kind("click"), kind("error"), kind("view"), F.count("*").alias("total"))


@query("""WITH c AS (SELECT event_id, user_id, value, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - value AS spent FROM events) SELECT event_id FROM c WHERE spent < 1000""")
def budget_gate(spark, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "value")
    return running.within(e, "user_id", ["ts", "event_id"], "value", 1000.0).select("event_id")


@query(f"SELECT abs(avg(a.score) - avg(b.score)) AS gap, avg(abs(a.score - b.score)) AS noise, max(abs(a.score - b.score)) AS worst FROM (SELECT user_id, avg(score) AS score FROM ({SCORED}) WHERE event_id % 2 = 0 GROUP BY 1) a JOIN (SELECT user_id, avg(score) AS score FROM ({SCORED}) WHERE event_id % 2 = 1 GROUP BY 1) b USING (user_id)")
def replica_noise(spark, d: str) -> DataFrame:
    half = lambda k, c: F.avg(F.when(F.col("event_id") % 2 == k, F.col("score"))).alias(c)
    u = scored(spark, d).groupBy("user_id").agg(half(0, "a"), half(1, "b")).where("a is not null and b is not null")
    diff = F.abs(F.col("a") - F.col("b"))
    return u.agg(F.abs(F.avg("a") - F.avg("b")).alias("gap"), F.avg(diff).alias("noise"), F.max(diff).alias("worst"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, lower(regexp_replace(regexp_extract(url, '^https?://([^/:?#]+)', 1), '[^A-Za-z0-9]+', '-', 'g')) AS slug, (length(html) + 3) // 4 AS est_tokens FROM pages")
def page_slugs(spark, d: str) -> DataFrame:
    host = F.regexp_extract("url", "^https?://([^/:?#]+)", 1)
    return table(spark, d, "pages").select("page_id", host.alias("host"), F.lower(F.regexp_replace(host, "[^A-Za-z0-9]+", "-")).alias("slug"), coerce.tokens_of_length(F.length("html")).alias("est_tokens"))


@query("""SELECT n.n_name AS nation, r.r_name AS region, count(DISTINCT c.c_custkey) AS customers, count(o.o_orderkey) AS orders, coalesce(round(sum(o.o_totalprice), 2), 0) AS total
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1, 2""")
def manifest_totals(spark, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("k"), F.sum("o_totalprice").alias("p"))
    c = table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_nationkey").agg(F.countDistinct("c_custkey").alias("customers"), F.coalesce(F.sum("k"), F.lit(0)).alias("orders"), F.sum("p").alias("p"))
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    j = n.join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return j.select(F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce(F.round("p", 2), F.lit(0.0)).alias("total"))
