"""Quality rules: text statistics and a learned decision list, as Spark expressions only.

Statistics are DataFrame expressions on whole texts. A decision list is learned by sequential
covering from the statistics of labelled rows: a rule is grown on two thirds of the
rows left, condition by condition, to the threshold conjunction that gains most, and
pruned on the other third by dropping conditions from its end; rules are kept while they are
precise enough, and the rows they cover are taken away. The list is emitted as ordered
conditions of one Spark CASE expression; a row that no rule covers is kept.

At most FIT_ROWS labelled rows, those with the least hash of their id, are collected to fit
the list; everything else covers all rows.

Results: null and empty texts have no words and fail the base rule; repeated rows are judged one by one;
a null id has no label. Without usable labels the list is empty. Columns of df named like a
statistic are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]"
BLANKS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
#: Most labelled rows that are collected to fit the list.
FIT_ROWS = 20_000
#: A rule must have this share of rejects among the rows it covers, on the rows it was grown on and on those it was pruned on.
PRECISION = 0.95
MIN_COVER = 15
MAX_RULES, MAX_CONDITIONS, CUTS = 12, 3, 32
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
STATS = ["n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share"]


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df with COUNTS (long).

    Repeated windows are found in the text's own array: 64-bit hashes of the windows of three words
    are sorted with their places, and equal neighbours are repeats. Arrays are handed on
    through a Generate node, so that none is worked out again for each of its elements.
    """
    names = [c for c in df.columns if c not in COUNTS]
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    # 1: words, lines that have a word, and the text without white space
    one = F.struct(
        F.filter(F.split(t, f"{SPACE}+"), lambda w: w != "").alias("w"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("l"),
        F.translate(t, BLANKS, "").alias("s"),
    )
    df = df.select(*[F.col(f"`{c}`") for c in names], F.inline(F.array(one)).alias("_w", "_l", "_s"))
    n = F.size("_w").cast("long")
    # 2: a window's hash for each word that two others follow
    pairs = F.zip_with("_w", F.expr("slice(_w, 2, greatest(size(_w) - 1, 0))"), lambda a, b: F.xxhash64(a, b))
    hashes = F.zip_with(pairs, F.expr("slice(_w, 3, greatest(size(_w) - 2, 0))"), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
    two = F.struct(
        n.alias("n_words"), F.length("_s").cast("long").alias("word_chars"),
        (F.length("_s") - F.length(F.translate("_s", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 3, F.slice(hashes, 1, F.greatest(n - 2, F.lit(1)).cast("int"))).alias("h"),
    )
    df = df.select(*[F.col(f"`{c}`") for c in names], F.inline(F.array(two)).alias(*COUNTS[:4], "_h"))
    # 3: only texts with an equal pair of windows go on
    has = F.size(F.array_distinct("_h")) < F.size("_h")
    placed = F.when(has, F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("p")))))
    df = df.select(*[F.col(f"`{c}`") for c in names], *COUNTS[:4], F.inline(F.array(F.struct(placed.alias("s")))).alias("_s"))
    twins = F.zip_with("_s", F.expr("slice(_s, 2, greatest(size(_s) - 1, 0))"), lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])))
    places = F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull()))))
    df = df.select(*[F.col(f"`{c}`") for c in names], *COUNTS[:4], F.inline(F.array(F.struct(places.alias("p")))).alias("_p"))
    # 4: words under the windows; each adds the words up to the next window, three at most
    gaps = F.zip_with("_p", F.expr("slice(_p, 2, greatest(size(_p) - 1, 0))"), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    covered = F.coalesce(F.aggregate(gaps, F.lit(0), lambda x, y: x + y), F.lit(0)).cast("long")
    return df.select(*[F.col(f"`{c}`") for c in names], *COUNTS[:4], covered.alias("n_repeat_words"))


def statistics() -> dict[str, Column]:
    """The list's statistics from COUNTS; 0 where nothing is to be divided by."""
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {"n_words": F.col("n_words").cast("double"), "mean_word": per("word_chars", "n_words"), "symbol_share": per("n_symbols", "word_chars"), "dup_line_share": per("n_dup_lines", "n_words"), "repeat_share": per("n_repeat_words", "n_words")}


Condition = tuple[str, str, float]


def _holds(x: dict[str, np.ndarray], rule: list[Condition]) -> np.ndarray:
    held = np.ones(len(next(iter(x.values()))), dtype=bool)
    for name, sign, cut in rule:
        held &= x[name] >= cut if sign == ">=" else x[name] <= cut
    return held


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    """Add the condition with most information gain on the covered rejects until none but rejects are covered."""
    rule: list[Condition] = []
    now = np.ones(len(bad), dtype=bool)
    while len(rule) < MAX_CONDITIONS and now.any() and not bad[now].all():
        p0, n0 = bad[now].sum(), (~bad[now]).sum()
        best, gain = None, 0.0
        for name in x:
            for cut in np.unique(np.quantile(x[name][now], np.linspace(0, 1, CUTS))):
                for sign in (">=", "<="):
                    also = now & _holds(x, [(name, sign, cut)])
                    p, n = bad[also].sum(), (~bad[also]).sum()
                    if p >= MIN_COVER // 3 and (g := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > gain + 1e-9:
                        best, gain = (name, sign, float(cut)), g
        if best is None:
            break
        rule.append(best)
        now &= _holds(x, [best])
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray) -> list[list[Condition]]:
    """The ordered rules; each is a conjunction that rejects."""
    rules: list[list[Condition]] = []
    left = np.ones(len(bad), dtype=bool)
    third = np.arange(len(bad)) % 3 == 0
    while len(rules) < MAX_RULES and bad[left].sum() >= MIN_COVER:
        grow, prune = left & ~third, left & third
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow])
        worth = lambda r, on: (bad[on & _holds(x, r)].sum() + 0.0, max(1, (on & _holds(x, r)).sum()))
        value = lambda r: (2 * worth(r, prune)[0] - worth(r, prune)[1]) / worth(r, prune)[1]
        while len(rule) > 1 and value(rule[:-1]) >= value(rule):
            rule = rule[:-1]
        if not rule or any(p < PRECISION * n for p, n in (worth(rule, grow), worth(rule, prune), worth(rule, left))) or worth(rule, left)[1] < MIN_COVER:
            break
        rules.append(rule)
        left &= ~_holds(x, rule)
    return rules


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS) -> list[list[Condition]]:
    """Learn the list from the labelled rows; label 0 is a reject."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.min(label).alias("_label"))
    some = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text")).join(F.broadcast(some), "_id")
    found = with_statistics(texts, "_text").select("_id", "_label", *(v.alias(k) for k, v in statistics().items())).orderBy(F.xxhash64("_id")).collect()
    if not found:
        return []
    x = {k: np.array([r[k] for r in found], dtype=float) for k in STATS}
    return learn(x, np.array([r["_label"] == 0 for r in found]))


def verdict(rules: list[list[Condition]]) -> Column:
    """An ordered CASE over the statistics: the number of the rule that rejects, or null."""
    of = statistics()
    case = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        test = F.lit(True)
        for name, sign, cut in rule:
            test = test & (of[name] >= F.lit(cut) if sign == ">=" else of[name] <= F.lit(cut))
        case = F.when(test, F.lit(k)).otherwise(case)
    return case


def judge(docs: DataFrame, rules: list[list[Condition]], text: str = "text") -> DataFrame:
    """docs with COUNTS, base_failed, rule (the rejecting rule's number or null) and kept."""
    found = with_statistics(docs, text)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    found = found.withColumn("base_failed", base).withColumn("rule", verdict(rules))
    return found.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that neither the base rule nor the learned list rejects, with docs' columns."""
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("text"))
    return judge(row, fit(docs, labels)).where("kept").select("_row.*")


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rules = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, rules).select("doc_id", *COUNTS, "base_failed", "kept", "rule")
