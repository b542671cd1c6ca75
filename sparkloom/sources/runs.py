"""Run folders, their artifacts and the joins between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numbered_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines as (line_no from 1, row): blank lines are counted and left out, and so is what is no object; bad JSON fails.

    A file is read whole by one task, as only then its lines have numbers; files are read side by side.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("at", "line")).where(F.trim("line") != "")
    kind = F.substring(F.trim("line"), 1, 1)
    parsed = F.from_json("line", schema, {"mode": "FAILFAST"})
    return lines.where(kind == "{").select((F.col("at") + 1).cast("long").alias("line_no"), parsed.alias("row"))


def documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One row per JSON document, with `file`."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).select("*", F.col("_metadata.file_path").alias("file"))


def run_folders(spark: SparkSession, root: str, name: str = "run-metadata.json") -> DataFrame:
    """(run_id, folder) of the folders two levels below root that hold a file of that name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", name).load(f"{root}/*/*").select("path")
    folder = F.regexp_replace("path", "/[^/]+$", "")
    return files.select(F.substring_index(folder, "/", -1).alias("run_id"), folder.alias("folder"))


def matching(paths: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows whose path matches a shell pattern as a whole; * and ? also match slashes."""
    quoted = "".join(".*" if c == "*" else "." if c == "?" else f"\\Q{c}\\E" for c in pattern)
    return paths.where(F.col(path).rlike(f"(?s)^{quoted}$"))


def ready_folders(files: DataFrame, needed: list[str]) -> DataFrame:
    """Folders (run_id) that have all needed artifacts. files: run_id, name."""
    return files.where(F.col("name").isin(*needed)).groupBy("run_id").agg(F.count_distinct("name").alias("n")).where(F.col("n") == len(needed)).select("run_id")


def run_index(dashboards: DataFrame, folders: DataFrame) -> DataFrame:
    """A row per run: metadata of the latest dashboard that lists it, folder of the first root that has it; newest first by finished_at.

    dashboards: run_id, taken_at and metadata columns. folders: run_id, root_order, folder.
    """
    extra = [c for c in dashboards.columns if c not in ("run_id", "taken_at")]
    latest = dashboards.groupBy("run_id").agg(F.max_by(F.struct(*extra), "taken_at").alias("m")).select("run_id", "m.*")
    first = folders.groupBy("run_id").agg(F.min_by("folder", "root_order").alias("folder"))
    return latest.join(first, "run_id").orderBy(F.col("finished_at").desc_nulls_last(), "run_id")


def with_artifacts(runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Runs with generated samples, and their scoring results if there are any. artifacts: run_id, kind, path."""
    of = lambda kind, name: artifacts.where(F.col("kind") == kind).select("run_id", F.col("path").alias(name))
    return runs.join(of("GENERATED_SAMPLES", "generated"), "run_id").join(of("SCORING_RESULTS", "scoring"), "run_id", "left")


def overridden(rollouts: DataFrame, audits: DataFrame, keys: list[str], flags: list[str]) -> DataFrame:
    """rollouts whose flags are those of an audit where one exists."""
    own = audits.select(*keys, *[F.col(f).alias(f"_{f}") for f in flags])
    j = rollouts.join(own, keys, "left")
    return j.select(*[F.coalesce(f"_{c}", c).alias(c) if c in flags else F.col(c) for c in rollouts.columns])


def with_cuts(trajectories: DataFrame, cuts: DataFrame) -> DataFrame:
    """Trajectories with the summed probability and the sorted phases of their cut points on (shard, row). cuts: shard, row, cut, probability, phase."""
    by = cuts.groupBy("shard", "row").agg(F.sum("probability").alias("probability"), F.array_join(F.array_sort(F.collect_set("phase")), ",").alias("phases"), F.count("*").alias("cuts"))
    return trajectories.join(by, ["shard", "row"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(0)))


def unchanged(before: DataFrame, now: DataFrame) -> DataFrame:
    """Shards (path, digest) that are the same in both and not empty."""
    return before.join(now, ["path", "digest"], "left_semi").where(F.coalesce("digest", F.lit("")) != "")


def bad_cuts(cuts: DataFrame, shards: DataFrame, snapshot: str) -> DataFrame:
    """Cut points with the reason why they are refused: another snapshot, an unknown shard, a probability outside [0, 1]."""
    known = shards.select("shard", F.lit(True).alias("_known"))
    why = F.when(~F.col("snapshot").eqNullSafe(F.lit(snapshot)), "snapshot").when(F.col("_known").isNull(), "shard").when(~F.coalesce(F.col("probability").between(0, 1), F.lit(False)), "probability")
    return cuts.join(known, "shard", "left").withColumn("reason", why).drop("_known").where("reason is not null")


def required(df: DataFrame, found: Column, what: str) -> DataFrame:
    """df, whose evaluation fails with a message at the first row where found does not hold."""
    return df.where(F.when(F.coalesce(found, F.lit(False)), True).otherwise(F.raise_error(F.lit(f"missing {what}")).cast("boolean")))


def rounds(generated: DataFrame, results: DataFrame, turns: DataFrame) -> DataFrame:
    """generated, results and the crawled turns by (label, task, replica); a row without one of them fails the read."""
    keys = ["label", "task", "replica"]
    j = generated.join(results.withColumn("_r", F.lit(True)), keys, "left").join(turns.withColumn("_t", F.lit(True)), keys, "left")
    return required(required(j, F.col("_r"), "result"), F.col("_t"), "turns").drop("_r", "_t")


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, whose evaluation fails where a key repeats."""
    n = F.count("*").over(W.partitionBy(*keys))
    return required(df.withColumn("_n", n), F.col("_n") == 1, "uniqueness of " + ", ".join(keys)).drop("_n")


def by_uid(policy: DataFrame, reference: DataFrame, uid: str = "uid") -> DataFrame:
    """policy and reference rows by uid, which may not repeat in either."""
    return unique(policy, [uid]).join(unique(reference, [uid]), uid)


def recovered(wanted: DataFrame, raw: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first raw row of each wanted key; a key without one fails the read."""
    first = raw.join(wanted.select(*keys).distinct(), keys, "left_semi").withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").withColumn("_there", F.lit(True)).drop("_n")
    return required(wanted.join(first, keys, "left"), F.col("_there"), "raw row").drop("_there")


def version_models(members: DataFrame, runs: DataFrame) -> DataFrame:
    """(version, model_uri): reign members, overridden by later coronated runs, the last one winning. runs: version, model_uri, coronated, at."""
    both = members.select("version", "model_uri", F.lit(0).alias("rank"), F.lit(None).cast("timestamp").alias("at")).unionByName(runs.where("coronated").select("version", "model_uri", F.lit(1).alias("rank"), "at"))
    return both.groupBy("version").agg(F.max_by("model_uri", F.struct("rank", "at", "model_uri")).alias("model_uri"))


def graded_runs(rows: DataFrame, run: str = "run_id", score: str = "score") -> DataFrame:
    """(run, graded): whether any score of a run lies strictly between 0.99 and 1, which a binary scale cannot give."""
    return rows.groupBy(run).agg(F.bool_or((F.col(score) > 0.99) & (F.col(score) < 1)).alias("graded"))


def same_inventory(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (side, and the columns) that only one of two inventories has; none if they are equal as multisets."""
    b = b.select(*a.columns)
    return a.exceptAll(b).select(F.lit("first").alias("side"), "*").unionByName(b.exceptAll(a).select(F.lit("second").alias("side"), "*"))


def expected_artifacts(verdicts: DataFrame, run: str = "run_id", artifacts: str = "artifacts") -> DataFrame:
    """(run, kind, uri, name): one row per entry of a JSON map of artifacts, with the file's name; entries without a URI are left out."""
    each = verdicts.select(run, F.explode(F.from_json(artifacts, "map<string,string>")).alias("kind", "uri")).where("uri <> ''")
    return each.withColumn("name", F.substring_index(F.regexp_replace("uri", "[?#].*$", ""), "/", -1))


def selection_reasons(*crawls: DataFrame) -> DataFrame:
    """(run_id, reasons): the sorted union of each run's reasons over crawls."""
    out = crawls[0].select("run_id", "reasons")
    for c in crawls[1:]:
        out = out.unionByName(c.select("run_id", "reasons"))
    return out.groupBy("run_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"))
