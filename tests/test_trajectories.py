"""Fixtures of the operators on messages, commands, turns, pairs and splits."""

from pyspark.sql import functions as F

from sparkloom.functions import messages as M
from sparkloom.functions import shell
from sparkloom.operators import audit, behaviour, selection

MSGS = "array<struct<role: string, content: string>>"


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def bash(c):
    return f"```bash\n{c}\n```"


def test_commands(spark):
    rows = [
        ("sed -n 1,9p a/b.py", dict(inspects=True, broad=False, edits=False)),
        ("cat > a.py <<'EOF'", dict(inspects=False, broad=False, edits=True)),
        ("grep -rn foo .", dict(inspects=False, broad=True)),
        ("grep foo a.py", dict(inspects=True, broad=False)),
        ("grep foo", dict(inspects=False, broad=True)),
        ("find . -name x", dict(broad=True)),
        ("python -m pytest -q", dict(tests=True, edits=False)),
        ("git diff HEAD~1", dict(diff=True, tests=False)),
        ("sed -i s/a/b/ x.py", dict(edits=True)),
        ("echo hi 2>&1", dict(edits=False)),
        ("echo hi > out.txt", dict(edits=True)),
        ("echo hi > /dev/null", dict(edits=False)),
        ("ls -lR", dict(broad=True)),
    ]
    tests = dict(inspects=shell.inspects, broad=shell.searches_broadly, edits=shell.edits, tests=shell.runs_tests, diff=shell.shows_diff)
    df = spark.createDataFrame([(c,) for c, _ in rows], "c string").select("c", *[f(F.col("c")).alias(k) for k, f in tests.items()])
    got = {r.c: r.asDict() for r in df.collect()}
    for c, want in rows:
        assert {k: got[c][k] for k in want} == want, c


def test_blocks_and_heads(spark):
    text = "x\n```bash\nls  -l\n pwd\n```\ny <run_bash>\ncat a</run_bash> ```python\nz\n``` ```sh\n```"
    assert one(spark, shell.action_blocks(F.lit(text)))[0] == ["ls -l pwd", "cat a", ""]
    heads = [("cd a && cd b && /usr/bin/cat x", "cat"), ("ls", "ls"), ("", ""), ("cd a", "cd"), ("Let me look", "Let")]
    df = spark.createDataFrame(heads, "c string, want string")
    assert df.where(shell.head(F.col("c")) != F.col("want")).count() == 0
    assert one(spark, shell.kind(F.lit(bash("sed -i a b.py"))), shell.kind(F.lit(bash("pytest"))), shell.kind(F.lit(bash("ls"))), shell.kind(F.lit("hm")), shell.kind(F.lit(bash("x submit_marker")))) == ("edit", "test", "explore", "no_cmd", "submit")


def test_paths(spark):
    patch = "diff --git a/src/a.py b/src/a.py\n--- a/src/a.py\n+++ b/src/a.py\ndiff --git a/t/test_b.js b/t/test_b.js\n--- /dev/null\n+++ b/t/test_b.js\n"
    paths = shell.patch_paths(F.lit(patch))
    assert one(spark, paths, shell.source_paths(paths), shell.test_paths(paths)) == (["src/a.py", "t/test_b.js"], ["src/a.py", "t/test_b.js"], ["t/test_b.js"])
    assert one(spark, shell.suffix(F.lit("a/B.PY")), shell.suffix(F.lit("a/b")), shell.basename(F.lit("a/b.c")), shell.relative(F.lit("./../a\\b"))) == (".py", "", "b.c", "a/b")
    assert one(spark, shell.paths_named(F.lit("cat a.py b/c.py a.py")), shell.sub_commands(F.lit("cat <<'X' > f\na; b\nX\nls && pwd | wc")), shell.infra_failed(F.lit("Internal evaluator error")), shell.too_long(F.lit("abc"), 2)) == (["a.py", "b/c.py"], 4, True, True)


def test_messages(spark):
    df = spark.createDataFrame([([("user", "a\r\nb  \n"), ("assistant", None)],), ([("user", "a\r\nb  \n"), ("assistant", "c")],), ([("boss", "x")],), (None,)], f"m {MSGS}")
    got = df.select(M.clean(F.col("m")).alias("m")).select("m", M.canonical(F.col("m")).alias("c")).collect()
    assert [len(r.m) for r in got] == [0, 2, 0, 0] and got[1].c[0].content == "a\nb"
    turns = "array<struct<role: string, content: string, score_target: boolean>>"
    df = spark.createDataFrame([([("user", "u", None), ("assistant", "a", False), ("assistant", "b", True), ("user", "v", None)],), ([("assistant", "a", None)],)], f"t {turns}")
    before, rest = M.split_at_target(F.col("t"))
    got = df.select(before.alias("p"), rest.alias("r")).collect()
    assert [m.content for m in got[0].p] == ["u", "a"] and [m.content for m in got[0].r] == ["b", "v"] and got[1].p is None
    markup = "<|im_start|>system\n s <|im_end|>\n<|im_start|>user\nu<|im_end|>\n<|im_start|>assistant\n"
    got = one(spark, M.parse_markup(F.lit(markup)), M.parse_markup(F.lit("<|im_start|>user\nu<|im_end|>")))
    assert [tuple(m) for m in got[0]] == [("system", "s"), ("user", "u")] and got[1] is None
    arr = F.array(F.lit("a"), F.lit("b"))
    assert one(spark, M.aligned_value(arr, F.lit(1)), M.aligned_value(arr, F.lit(2)), M.aligned_value(arr, F.lit(-1))) == ("b", None, None)
    df = spark.createDataFrame([("", [("user", "x"), ("assistant", "y")]), ("kept", None), (None, None)], f"s string, t {MSGS}")
    assert [r[0] for r in df.select(M.side_text(F.col("s"), F.col("t"))).collect()] == ["y", "kept", ""]


def test_references(spark):
    kind = "s struct<reference_trajectories: array<string>, reference_models: array<string>, reference_self_scores: array<double>, reference_made_edits: array<boolean>, reference_trajectory: string, reference_model: string, model: string, reference_self_score: double, reference_made_edit: boolean>"
    rows = [((["a", " ", "b"], ["m1"], [0.5, 0.1, 0.7], None, "a", "old", None, 0.2, True),), (([" "], None, None, None, "a", None, "mm", 0.2, True),), ((None, None, None, None, "", None, None, None, None),)]
    got = [[tuple(e) for e in r[0]] for r in spark.createDataFrame(rows, kind).select(M.references(F.col("s"))).collect()]
    assert got == [[(1, "a", "m1", 0.5, None), (3, "b", "old", 0.7, None)], [(1, "a", "mm", 0.2, True)], []]


def test_supervision(spark):
    keep = lambda c, n=10, h=False, a="x": M.learns(F.lit(c), F.lit(n), F.lit(h), F.lit(a))
    assert one(spark, keep("t</think>a"), keep(" </think>a"), keep("  "), keep("a", 5000), keep("a", h=True), keep("a", a="Observation: x\n**Decision**: y"), keep("a", a="Decision: x decision: y")) == (True, False, False, False, False, False, True)
    a, b = M.think_action(F.lit("t</think>\na</think> b"))
    c, d = M.think_action(F.lit("t</think>\na</think> b"), last=True)
    assert one(spark, F.trim(a), F.ltrim(F.regexp_replace(b, "^\\s+", "")), F.regexp_replace(c, "\\s+", ""), d, M.think_action(F.lit("x"))[0], M.think_action(F.lit("x"))[1]) == ("t", "a</think> b", "t</think>a", "b", "", "x")
    df = spark.createDataFrame([([("user", "u"), ("assistant", "p")], [("assistant", "q</think>r"), ("user", "o")])], f"p {MSGS}, c {MSGS}").select(M.with_loss(F.col("p"), F.col("c")).alias("m"))
    r = df.select("m", F.transform("m", M.supervised).alias("s"), M.lab_side(F.col("m")).alias("l")).first()
    assert [m.loss for m in r.m] == [False, False, True, False] and r.s == [False, False, True, False] and tuple(r.l[2]) == ("assistant", "r", "q") and r.l[1].thinking is None


def test_rendering(spark):
    m = F.lit(None).cast(MSGS)
    df = spark.createDataFrame([([("system", "s"), ("user", "u "), ("assistant", "t</think>\n\nold"), ("user", "v")],)], f"m {MSGS}")
    got = df.select(M.chat_prompt(F.col("m")), M.document(F.col("m")), M.document(m)).first()
    assert got[0] == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<|im_end|>\n<|im_start|>assistant\nold<|im_end|>\n<|im_start|>user\nv<|im_end|>\n<|im_start|>assistant\n<think>\n"
    assert got[1].startswith("OBSERVATION:\nu ") and got[2] == ""
    cut = df.select(M.cut_after(F.col("m"), 1)).first()[0]
    assert [x.content.strip() for x in cut] == ["s", "u", "old"]


def test_degenerate_texts(spark):
    rows = [("x\n" * 5, True), ("x\n" * 4, False), ("ab" * 200, True), ("\n" * 50, False), ("", False), (None, False), ("".join(chr(97 + i * i % 26) + str(i) for i in range(300)), False)]
    df = spark.createDataFrame(rows, "t string, want boolean")
    assert df.where(M.degenerate(F.col("t")) != F.col("want")).count() == 0
    out, code = M.envelope(F.lit("<returncode>-1</returncode>\n<output>\nhi\n</output>"))
    assert one(spark, out, code, M.envelope(F.lit("x"))[0], M.one_bash_block(F.lit(bash("ls"))), M.one_bash_block(F.lit(bash("ls") + bash("ls"))), M.thought_first(F.lit(" THOUGHT: x"))) == ("hi", -1, "x", True, False, True)
    assert one(spark, M.arguments(F.lit('{"a": "1"}')), M.arguments(F.lit("{bad"))) == ({"a": "1"}, {})


def test_audit(spark):
    rows = [
        ("good", [bash("sed -n 1,9p a.py"), bash("sed -i s/a/b/ a.py"), bash("pytest"), "The bug is fixed. All tests pass."], None),
        ("bad", ["", bash("ls") + bash("pwd"), bash("Let me see"), "The bug is fixed.", bash("")], None),
        ("loop", [bash("ls")] * 4, None),
        ("broad", [bash("grep -rn x ."), bash("find . -name y")], None),
        ("prefix", ["All tests pass. The task is done."], [("assistant", bash("sed -i a b.py && pytest"))]),
        ("none", None, None),
    ]
    got = {r.k: r for r in audit.audit(spark.createDataFrame(rows, f"k string, turns array<string>, prefix {MSGS}")).collect()}
    assert {k: r.flags for k, r in got.items()} == {"good": [], "bad": ["malformed_bash", "unsupported_completion_claim"], "loop": ["loop"], "broad": ["broad_search_without_inspect"], "prefix": [], "none": []}
    assert [(m.turn, m.reason) for m in got["bad"].evidence.malformed_bash] == [(1, "blank turn"), (2, "multiple action blocks (2)"), (3, "prose-like command head 'Let'"), (5, "empty action block")]
    assert [(m.turn, m.reason, m.text) for m in got["bad"].evidence.unsupported_completion_claim] == [(4, "fix claim without prior edit", "The bug is fixed.")]
    g = got["good"]
    assert (g.edited, g.tested, g.git_diff, g.edit_before_inspect, g.command_count, g.quality_pass) == (True, True, False, False, 3, True)
    assert got["loop"].max_consecutive_command_run == 4 and got["loop"].duplicate_command_ratio == 0.75 and got["prefix"].prefix_edited and got["broad"].broad_search_count == 2
    w = {r.k: (r.inspected_before_edit, r.verified_after_edit, r.first_edit_turn) for r in audit.workflow(spark.createDataFrame(rows, f"k string, turns array<string>, prefix {MSGS}")).collect()}
    assert w["good"] == (True, True, 2) and w["none"] == (False, False, None)
    side = audit.side_quality(audit.audit(spark.createDataFrame([(r[0], r[1], r[2]) for r in rows], f"side string, turns array<string>, prefix {MSGS}")).withColumn("side", F.lit("king"))).first()
    assert (side.candidates, side.passes, side.loop) == (6, 3, 1)


def test_behaviour(spark):
    turns = ["plan", bash("pytest"), bash("cat -n a.py"), bash("sed -i a a.py"), bash("pytest"), bash("git diff"), "done"]
    got = one(spark, behaviour.labels(F.array(*map(F.lit, turns))))[0]
    assert got == ["reason_plan", "reproduce_test", "inspect_diagnose", "edit", "verify_test", "verify_inspect", "finalize"]
    rows = [(1, [("user", "o"), *[(r, f"{r}{k}") for k in range(5) for r in ("assistant", "user")]]), (2, [("assistant", "a")]), (3, [])]
    d = spark.createDataFrame(rows, f"id int, m {MSGS}").withColumn("units", behaviour.units(F.col("m")))
    d = d.withColumn("labels", F.transform("units", lambda u, k: F.when(k < 2, "a").otherwise("b")))
    got = {r.id: r for r in behaviour.grouped(d).collect()}
    assert [len(u) for u in got[1].units] == [3, 2, 2, 2, 2] and got[1].ends == [2, 5] and got[1].whole and sum(map(len, got[1].groups)) == 11
    assert got[2].ends is None and got[2].reason == "too few turns" and got[3].units == []
    rows = [(1, [("user", "c")], [[("assistant", "a", True)], [("assistant", "b", False)], [("assistant", "d", True), ("user", "o", False)]])]
    msgs = "array<struct<role: string, content: string, loss: boolean>>"
    d = spark.createDataFrame(rows, f"id int, c {MSGS}, g array<{msgs}>").withColumn("c", F.transform("c", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), F.lit(False).alias("loss"))))
    got = {r.k: ([m.content for m in r.prefix], [m.content for m in r.completion]) for r in behaviour.prefix_rows(d, ["id"], "c", "g").collect()}
    assert got == {1: (["c"], ["a"]), 3: (["c", "a", "b"], ["d", "o"])}


def test_pairs(spark):
    king = spark.createDataFrame([("a", 0.5, True), ("b", 0.5, True), ("c", None, True), ("d", 0.9, False)], "id string, score double, quality_pass boolean")
    new = spark.createDataFrame([("a", 0.9, True), ("b", 0.52, None), ("c", 0.9, True), ("d", 0.1, True)], "id string, score double, quality_pass boolean")
    got = {r.id: (r.preferred_side, r.eligible, r.rejection_reasons) for r in selection.preference_pairs(king, new, ["id"]).collect()}
    assert got == {"a": ("challenger", True, []), "b": ("challenger", False, ["delta_below_threshold", "preferred_failed_quality_filter"]), "c": (None, False, ["missing_or_tied_scores"]), "d": ("king", False, ["preferred_failed_quality_filter"])}
    side = lambda *rows: spark.createDataFrame(list(rows), "id string, replica int, score double")
    a, b = side(("x", 1, 0.9), ("x", 2, 0.9)), side(("x", 1, 0.1), ("x", 2, 0.1), ("x", 3, 0.85))
    assert [tuple(r)[1:3] for r in selection.gap_pairs(a, b, ["id"], 0.2).collect()] == [(1, 1)]
    assert selection.gap_pairs(a, b, ["id"], 0.2, single=False).count() == 4


def test_selection(spark):
    refs = spark.createDataFrame([("a", 1, 0.2, "x"), ("a", 1, 0.9, "y"), ("b", 1, None, "x"), ("b", 1, 0.9, "y"), ("b", 0, 1.0, "z")], "k string, cues int, self_score double, trajectory string")
    got = {r.k: r.trajectory for r in selection.best_reference(refs, ["k"]).collect()}
    assert got["a"] == "y" and got["b"] == min("xy", key=lambda t: __import__("hashlib").sha256(t.encode()).hexdigest())
    assert {r.k: r.trajectory for r in selection.best_reference(refs.where("self_score is not null"), ["k"], score_first=True).collect()} == {"a": "y", "b": "z"}
    runs = spark.createDataFrame([("c", False, 9, "r1"), ("c", True, 5, "r2"), ("c", True, 5, "r3")], "k string, scored boolean, finished_at int, run_id string")
    assert selection.latest_scored(runs, ["k"]).first().run_id == "r3"
    rows = spark.createDataFrame([(t, c, o, i) for t in "t" for c in "pq" for o in "xy" for i in range(4)], "task string, context string, origin string, i int")
    got = [tuple(r) for r in selection.greedy_per_task(rows, "task", "context", "origin", "i").orderBy("context", "i", "origin").collect()]
    assert got == [("t", c, o, i) for c in "pq" for o, i in (("x", 0), ("y", 0), ("x", 1))]
    got = [(r.context, r.origin, r.i) for r in selection.round_robin(rows.drop("task"), ["context", "origin"], 5, F.col("i")).orderBy("place").collect()]
    assert got == [("p", "x", 0), ("p", "y", 0), ("q", "x", 0), ("q", "y", 0), ("p", "x", 1)]
    assert selection.capped(rows, "context", 3, F.col("i"), F.col("origin")).count() == 6
    assert sorted((r.i, r.tier) for r in selection.tiers(rows.where("context = 'p' and origin = 'x'"), low=F.col("i") < 2, even=F.col("i") % 2 == 0).collect()) == [(0, "even"), (0, "low"), (1, "low"), (2, "even")]
    assert one(spark, selection.quality_weight((F.lit(True), 0.5), (F.lit(None).cast("boolean"), 0.1)), selection.dedup_key(F.lit("s"), F.lit(3), F.lit(False))["reference_index"]) == (0.5, 0)
    assert {r.i: r.sets for r in selection.nested(rows.where("context = 'p' and origin = 'x'"), [1, 3], F.col("i")).collect()} == {0: [1, 3], 1: [3], 2: [3]}


def test_holdouts_and_splits(spark):
    rows = [("a", 1, "h", None, "c"), ("a", 2, "h", None, "c"), ("b", 1, "h", None, "c"), ("d", 1, "h", "x", "c"), ("d", 2, "i", None, "e")]
    df = spark.createDataFrame(rows, "k string, replica int, checklist string, error string, context string")
    assert {r.k: r.ready for r in selection.ready(df, ["k"]).collect()} == {"a": True, "b": False, "d": False}
    assert sorted({r.k for r in selection.one_context(df, ["k"], "context").collect()}) == ["a", "b"]
    ids = one(spark, selection.identities(F.lit("s:1:2#r3"), F.lit(" A  b"), F.lit("c")), selection.identities(F.lit("s"), F.lit(" "), F.lit("c")))
    assert ids[0][0] == "coord:s:1:2" and len(ids[0]) == 3 and ids[1] is None
    df = spark.createDataFrame([(i, [f"k{i}", f"k{i + 1}"]) for i in range(5)] + [(10 + i, [f"x{i}"]) for i in range(60)], "id int, keys array<string>")
    got = selection.group_split(df, "id", "keys", 0.5).collect()
    assert len(got) == 65 and {r.component for r in got if r.id < 5} == {"k0"} and len({r.split for r in got if r.id < 5}) == 1 and {r.split for r in got} == {"dev", "train"}
    pool = spark.createDataFrame([("k1", "dev"), ("k2", "train")], "key string, split string")
    assert {r.id: r.split for r in selection.inherited_split(df.where("id < 5"), "id", "keys", pool).collect()} == {0: "dev", 1: "dev", 2: "train", 3: None, 4: None}


def test_contract(spark):
    msgs = "array<struct<role: string, content: string, loss: boolean>>"
    good = ("r", [("system", "s", None), ("user", "u", False)], [("assistant", "a", True), ("user", "o", False)])
    rows = [good, ("", [("user", "u", True)], [("user", " ", True)]), (None, [], [])]
    df = spark.createDataFrame(rows, f"id string, p {msgs}, c {msgs}")
    got = [r[0] for r in df.select(selection.contract_errors(F.col("id"), F.col("p"), F.col("c"))).collect()]
    assert got[0] == [] and got[1] == ["missing_id", "prefix_not_from_system", "completion_not_from_assistant", "loss_in_prefix", "loss_mask_differs", "empty_content"] and {"missing_id", "empty_prefix", "empty_completion"} <= set(got[2])
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert one(spark, selection.disposition(a("e"), a()), selection.disposition(a(), a("near_loop")), selection.disposition(a(), a("verification_signal"))) == ("invalid", "review", "eligible")
