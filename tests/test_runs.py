"""Fixtures of run folders, sinks, joins, reports and statistics."""

import datetime
import json
import math

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import reports
from sparkloom.sources import runs, sinks


def frame(spark, kind, *rows):
    return spark.createDataFrame(list(rows), kind)


def test_numbered_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n[1]\n{"a": 2}\r\n')
    assert [(r.line_no, r.row.a) for r in runs.numbered_lines(spark, str(tmp_path), "a long").orderBy("line_no").collect()] == [(1, 1), (4, 2)]
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception, match="MALFORMED|malformed|Malformed"):
        runs.numbered_lines(spark, str(tmp_path), "a long").collect()


def test_folders(spark, tmp_path):
    for d in ("x/r1", "x/r2", "y/r3"):
        (tmp_path / d).mkdir(parents=True)
        (tmp_path / d / "run-metadata.json").write_text(json.dumps({"eval_run_id": d[2:]}, indent=1))
    (tmp_path / "x/r2/run-metadata.json").unlink()
    found = runs.run_folders(spark, str(tmp_path))
    assert sorted(r.run_id for r in found.collect()) == ["r1", "r3"]
    docs = runs.documents(spark, f"{tmp_path}/*/*/run-metadata.json", "eval_run_id string")
    assert sorted(r.eval_run_id for r in docs.collect()) == ["r1", "r3"]
    paths = frame(spark, "p string", ("a/b/c.parquet",), ("a/c.txt",), ("b.parquet",))
    assert [r.p for r in runs.matching(paths, "p", "a*.parquet").collect()] == ["a/b/c.parquet"]
    files = frame(spark, "run_id string, name string", ("r1", "a"), ("r1", "b"), ("r2", "a"), ("r2", "a"))
    assert [r.run_id for r in runs.ready_folders(files, ["a", "b"]).collect()] == ["r1"]


def test_run_index(spark):
    boards = frame(spark, "run_id string, taken_at int, finished_at int, model string", ("r1", 1, 5, "old"), ("r1", 2, 6, "new"), ("r2", 1, 9, "m"), ("r3", 1, None, "n"))
    folders = frame(spark, "run_id string, root_order int, folder string", ("r1", 2, "b"), ("r1", 1, "a"), ("r2", 1, "c"), ("r3", 3, "d"))
    got = [(r.run_id, r.model, r.folder) for r in runs.run_index(boards, folders).collect()]
    assert got == [("r2", "m", "c"), ("r1", "new", "a"), ("r3", "n", "d")]
    artifacts = frame(spark, "run_id string, kind string, path string", ("r1", "GENERATED_SAMPLES", "g"), ("r1", "SCORING_RESULTS", "s"), ("r2", "GENERATED_SAMPLES", "h"))
    got = {r.run_id: (r.generated, r.scoring) for r in runs.with_artifacts(boards.select("run_id").distinct(), artifacts).collect()}
    assert got == {"r1": ("g", "s"), "r2": ("h", None)}
    verdicts = frame(spark, "run_id string, artifacts string", ("r1", '{"A": "s3://b/x/y.jsonl?v=1", "B": ""}'), ("r2", None))
    assert [(r.kind, r.name) for r in runs.expected_artifacts(verdicts).collect()] == [("A", "y.jsonl")]
    reasons = frame(spark, "run_id string, reasons array<string>", ("r1", ["b", "a"]))
    assert runs.selection_reasons(reasons, frame(spark, "run_id string, reasons array<string>", ("r1", ["c", "a"]))).first().reasons == ["a", "b", "c"]


def test_joins(spark):
    left = frame(spark, "id string, loop boolean, x int", ("a", True, 1), ("b", True, 2))
    audits = frame(spark, "id string, loop boolean", ("a", False))
    assert {r.id: (r.loop, r.x) for r in runs.overridden(left, audits, ["id"], ["loop"]).collect()} == {"a": (False, 1), "b": (True, 2)}
    cuts = frame(spark, "shard string, row int, cut int, probability double, phase string, snapshot string", ("s", 1, 3, 0.25, "q", "v"), ("s", 1, 5, 0.5, "p", "v"), ("t", 1, 1, 1.5, "p", "v"), ("u", 1, 1, 0.1, "p", "v"), ("s", 1, 9, 0.1, "p", "w"))
    got = runs.with_cuts(frame(spark, "shard string, row int", ("s", 1), ("s", 2)), cuts.where("snapshot = 'v'")).orderBy("row").collect()
    assert [(r.probability, r.phases, r.cuts) for r in got] == [(0.75, "p,q", 2), (None, None, 0)]
    assert sorted(r.reason for r in runs.bad_cuts(cuts, frame(spark, "shard string", ("s",), ("t",)), "v").collect()) == ["probability", "shard", "snapshot"]
    a, b = frame(spark, "path string, digest string", ("p", "1"), ("q", "2"), ("r", "")), frame(spark, "path string, digest string", ("p", "1"), ("q", "3"), ("r", ""))
    assert [r.path for r in runs.unchanged(a, b).collect()] == ["p"]
    k = "label string, task string, replica int"
    gen = frame(spark, k, ("l", "t", 1), ("l", "t", 2))
    assert runs.rounds(gen, gen, gen).count() == 2
    with pytest.raises(Exception, match="missing turns"):
        runs.rounds(gen, gen, gen.where("replica = 1")).collect()
    uid = frame(spark, "uid int", (1,), (2,))
    assert runs.by_uid(uid, uid).count() == 2
    with pytest.raises(Exception, match="uniqueness"):
        runs.by_uid(uid, uid.union(uid)).collect()
    raw = frame(spark, "s string, i string, at int, v string", ("s", "1", 2, "late"), ("s", "1", 1, "first"), ("s", "9", 1, "other"))
    assert runs.recovered(frame(spark, "s string, i string", ("s", "1")), raw, ["s", "i"], "at").first().v == "first"
    with pytest.raises(Exception, match="missing raw row"):
        runs.recovered(frame(spark, "s string, i string", ("s", "2")), raw, ["s", "i"], "at").collect()
    at = lambda d: datetime.datetime(2026, 1, d)
    got = runs.version_models(frame(spark, "version string, model_uri string", ("v1", "a"), ("v2", "b")), frame(spark, "version string, model_uri string, coronated boolean, at timestamp", ("v2", "c", True, at(1)), ("v2", "d", True, at(2)), ("v1", "z", False, at(3))))
    assert {r.version: r.model_uri for r in got.collect()} == {"v1": "a", "v2": "d"}
    assert {r.run_id: r.graded for r in runs.graded_runs(frame(spark, "run_id string, score double", ("a", 0.995), ("a", 1.0), ("b", 1.0), ("b", 0.0))).collect()} == {"a": True, "b": False}
    inv = frame(spark, "name string, shape string", ("w", "2"), ("x", "3"))
    assert runs.same_inventory(inv, inv).count() == 0 and [r.side for r in runs.same_inventory(inv, inv.where("name = 'w'")).collect()] == ["first"]


def test_sinks(spark, tmp_path):
    df = frame(spark, "a int, payload string", (1, "x"), (2, "y"))
    path = f"{tmp_path}/out"
    sinks.replaced(df, path)
    sinks.replaced(df.where("a = 1"), path)
    assert spark.read.json(path).count() == 1 and len(list(tmp_path.iterdir())) == 1
    sinks.without(df, f"{tmp_path}/bare", "payload")
    assert spark.read.json(f"{tmp_path}/bare").columns == ["a"]
    sums = sinks.checksums(spark, path).collect()
    assert len(sums) >= 1 and all(len(r.sha256) == 64 for r in sums)
    sinks.unchanged_by(spark, path, lambda: None)
    with pytest.raises(ValueError):
        sinks.unchanged_by(spark, path, lambda: df.write.mode("append").json(path))
    sinks.catalog({"cat_t": df}, f"{tmp_path}/cat", {"cat_v": "SELECT a FROM cat_t WHERE a > 1"})
    assert spark.table("cat_v").count() == 1
    df.select("a").coalesce(1).write.json(f"{tmp_path}/rank0")
    assert sinks.merged_logs(spark, [f"{tmp_path}/rank0"], "a int", ["a"]).count() == 2
    with pytest.raises(Exception, match="uniqueness"):
        sinks.merged_logs(spark, [f"{tmp_path}/rank0", f"{tmp_path}/rank0/*.json"], "a int", ["a"]).collect()


def test_reports(spark):
    r = frame(spark, "m string, s double, g double, o string", ("a", 0.5, 0.1, "x"), ("a", 1.0, None, "y"), ("a", None, 0.3, "x"))
    assert tuple(reports.model_rollup(r, "m", "s", "g", origins="o").first()) == ("a", 3, 1.0, 0.75, 0.3, ["x", "y"])
    e = frame(spark, "k string, score double, edited boolean", ("a", 0.9, False), ("a", 0.4, True), ("b", 0.9, False))
    assert {x.k: x.best for x in reports.best_edited(e, ["k"]).collect()} == {"a": 0.4, "b": 0.9}
    assert reports.samples(frame(spark, "k int, at int, s double", (1, 2, 0.7), (1, 1, None), (1, 3, 0.1)), ["k"], "s", "at").first().score == 0.7
    assert reports.alignment_rate(frame(spark, "k int, ok boolean", (1, True), (1, None), (1, False)), ["k"], "ok").first().rate == 0.5
    s = frame(spark, "src string, i string, at int, has_edit boolean, blocked boolean, family string, language string", ("s", "1", 2, True, False, "pr", "py"), ("s", "1", 1, False, True, "lm", "go"), ("s", "2", 3, False, None, "pr", "py"))
    assert tuple(reports.source_stats(s, "src", "i", "at").first()) == ("s", 2, 1, 1, "lm", "go")
    assert reports.pooled_instances([s, s], "i").first().instances == 2
    b = frame(spark, "score double, king_scores array<double>", (0.9, [0.5, 0.9]), (0.5, [0.5]), (0.1, [0.9]), (None, [0.1]), (0.3, []))
    got = reports.merge_report(b, 0.15).first()
    assert (got.usable, got.ahead, got.behind, got.ties, got["mean"]) == (3, 1, 1, 1, 0.5)
    assert tuple(reports.rejudge_parity(frame(spark, "a double, b double", (1.0, 0.5), (0.0, None), (0.25, 0.25)), "a", "b").first()) == (2, 0.25, 0.5)
    z = frame(spark, "split string, n int", *[("train", k) for k in range(1, 11)], ("dev", 7))
    got = {x.split: (x["rows"], x.tokens, x.median, x.p90) for x in reports.sizing(z, "n", 10.0).collect()}
    assert got == {"train": (10, 55, 6, 10), "dev": (1, 7, 7, 7)}
    assert reports.weighted_nll(frame(spark, "k int, nll double, n int", (1, 10.0, 5), (1, 2.0, 1)), ["k"], "nll", "n").first().nll == 2.0
    t = frame(spark, "a boolean, b boolean, v double, task string", (True, True, 1.0, "x"), (True, False, 0.5, "x"), (None, False, 0.0, "y"))
    assert {x.a: x.v for x in reports.conditional_means(t, "a", "v").collect()} == {True: 0.75, False: 0.0}
    assert reports.two_flags(t, "a", "b", "v").count() == 3 and tuple(reports.share_per_task(t, "task", F.col("b")).first()) == (0.25, 0.0, 0.5)
    p = frame(spark, "chosen_x double, rejected_x double", (1.0, 0.5), (3.0, None))
    assert tuple(reports.paired_features(p, "x").first()) == ("x", 2.0, 0.5, 1.5)
    u = frame(spark, "k int, phase string, s double", (1, "p", 0.5), (2, "p", 0.1), (2, "q", 0.1), (3, "p", 0.1), (3, None, 0.2))
    assert {x.k: (x.phase, x.s) for x in reports.unanimous(u, ["k"], "phase", "s").collect()} == {1: ("p", 0.5), 2: ("unknown", None), 3: ("unknown", None)}
    q = frame(spark, "m string, at int, ok boolean, tokens int, cost double, seconds double, error string", ("a", 1, True, 9, 1.0, 2.0, None), ("a", 3, False, None, 0.0, 4.0, "late"), ("a", 2, False, None, 0.0, 3.0, "first"))
    got = reports.probes(q, ["m"]).first()
    assert (got.calls, round(got.ok_share, 3), got.tokens, got.seconds, got.first_error) == (3, 0.333, [9], 3.0, "first")
    assert tuple(reports.step_means(frame(spark, "step int, n int, loss double", (1, 2, 4.0), (1, 2, 2.0)), "step", "n", "loss").first()) == (1, 4, 1.5)
    k = frame(spark, "g string, kinds array<string>", ("a", ["explore", "edit", "submit"]), ("a", ["no_cmd"]))
    got = reports.behaviour_mix(k, ["g"]).first()
    assert (got.rollouts, got.with_edit, got.with_submit, got.explore, got.first_edit) == (2, 1, 1, 0.25, 2.0)
    got = [tuple(x) for x in reports.worst(frame(spark, "t string, d double", ("a", -1.0), ("b", -3.0), ("c", 2.0)), "t", "d", 2).collect()]
    assert got == [("b", -3.0, 0.75), ("a", -1.0, 0.25)]
    assert reports.tagged_counts(frame(spark, "k int, tags array<string>", (1, ["x", "x", "y"])), ["k"], "tags").where("tag = 'x'").first().n == 2
    assert reports.unique_turns(u, "k").count() == 3 and reports.weight_sum(t, "v").first().weight == 1.5


def test_statistics(spark):
    args = [F.lit(float(x)) for x in (-120, -95, -118, -99, 40, 30)]
    sig = lambda x: 1 / (1 + math.exp(-x))
    got = spark.range(1).select(*[c.alias(k) for k, c in reports.dpo(*args, beta=0.1).items()]).first()
    h = 0.1 * ((-120 + 118) - (-95 + 99))
    assert abs(got.h - h) < 1e-12 and abs(got.loss + math.log(sig(h))) < 1e-12 and abs(got.coef_chosen + 0.1 * sig(-h)) < 1e-12 and abs(got.coef_rejected - 0.1 * sig(-h)) < 1e-12 and got.accuracy == 0.0
    how = dict(beta=0.1, mean=True, norm_tokens=32.0, smoothing=0.1, dpo_weight=0.7, nll_weight=0.2)
    base = [-120.0, -95.0, -118.0, -99.0, 40.0, 30.0]
    value = lambda x, k: spark.range(1).select(reports.dpo(*map(F.lit, x), **how)[k]).first()[0]
    for at, name in ((0, "coef_chosen"), (1, "coef_rejected")):
        up, down = list(base), list(base)
        up[at], down[at] = base[at] + 1e-4, base[at] - 1e-4
        assert abs((value(up, "loss") - value(down, "loss")) / 2e-4 - value(base, name)) < 1e-6
    assert math.isfinite(value([-1e5, 0.0, 0.0, -1e5, 1.0, 1.0], "loss"))
    d = frame(spark, "family string, now double, initial double, previous double", ("a", 3.0, 0.0, 2.0), ("b", 4.0, 0.0, 4.0))
    got = {r.family: r for r in reports.drift(d, "family", 4.0, 1.0).collect()}
    assert got["a"].drift_over_noise == 1.5 and got["b"].increment_rms == 0.0 and abs(got[None].drift_rms - math.sqrt(12.5)) < 1e-12 and abs(got[None].increment_cos_total - 3 / 5) < 1e-12
    assert tuple(reports.step0_gate(frame(spark, "a double, b double, n int", (1.0, 1.5, 10), (2.0, 1.5, 10)), "a", "b", "n", 0.05).first()) == (0.05, True)
    c = frame(spark, "m string, task string, cost double, prompt_tokens int, completion_tokens int", ("x", "t", 1.0, 5, 1), ("x", "u", 2.0, 5, 2), ("x", "u", 3.0, 5, 3))
    assert tuple(reports.costs(c, ["m"]).first()) == ("x", 3, 6.0, 15, 6, 3.0)
    assert spark.range(1).select(reports.headroom_gate(F.lit(3.0), F.lit(2.5)), reports.headroom_gate(F.lit(2.9), F.lit(2.5)), reports.headroom_gate(F.lit(1.0), F.lit(0.0))).first()[:] == (True, False, None)
    g = frame(spark, "m string, outcome string", ("x", "exact"), ("x", "differs"), ("x", "needs_llm"), ("y", "needs_llm"))
    assert {r.m: r.match_rate for r in reports.grounding(g, ["m"]).collect()} == {"x": 0.5, "y": None}
    f = lambda *x: reports.go(*[F.lit(v).cast("double") for v in x])
    assert spark.range(1).select(f(2, .5, .7, 1, 0), f(1, .5, .7, 1, 0), f(2, None, .7, 1, 0), f(2, .5, .1, 1, 0), f(2, .5, .7, -2, -1)).first()[:] == ("go", "no_signal", "no_direction", "dev_accuracy", "both_falling")


def test_liveness(spark):
    at = lambda s: datetime.datetime(2026, 1, 1, 0, 0, 0) + datetime.timedelta(seconds=s)
    rows = [("ok", 0, "error", None), ("ok", 1, "step", 0.1), ("ok", 5000, "step", 0.1), ("bad", 0, "step", 0.1), ("bad", 1, "error", None), ("nan", 4999, "step", float("nan")), ("old", 1, "step", 0.1), ("end", 1, "step", 0.1), ("end", 2, "done", None)]
    log = frame(spark, "run string, at timestamp, event string, loss double", *[(r, at(s), e, x) for r, s, e, x in rows])
    got = {r.run: r.state for r in reports.liveness(log, ["run"], F.lit(at(5100))).collect()}
    assert got == {"ok": "running", "bad": "error", "nan": "nan", "old": "stalled", "end": "done"}
