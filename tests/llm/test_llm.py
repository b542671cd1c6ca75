"""Small fixtures against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import bpe, exact, near, packing, paragraphs, quality, recurrent, scoring, substrings, suffixes, tokenfiles, tokens, warc

RND = random.Random(3)
WORDS = ["".join(RND.choice("abcdefgh") for _ in range(RND.randint(2, 7))) for _ in range(400)]
say = lambda n: " ".join(RND.choice(WORDS) for _ in range(n))
BASE = say(200)
PASSAGE = say(120)
near_copy = lambda t: " ".join(w if RND.random() > 0.02 else "zz" for w in t.split())
TEXTS = [None, "", " \n", "one", "ONE", BASE, BASE, BASE.upper(), near_copy(BASE), near_copy(BASE), say(90) + "\n" + PASSAGE + "\n" + say(50), PASSAGE, say(30) + "\n" + PASSAGE, say(6000), "é中'll <|endoftext|> x", "a" * 3000, "the cat sat " * 80, say(60) + "\nx y z\nx y z"]
ROWS = [(i, t, i % 3) for i, t in enumerate(TEXTS)] + [(None, BASE, 1), (None, None, None), (5, BASE, 2)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, ids int").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, ids int")


def key(rows):
    return sorted(rows, key=repr)


def test_encoders():
    for name in (tokens.BYTE_BPE, tokens.WORD_BPE):
        e = tokens.encoder(name)
        odd = [" ", "  ", "\n", "a", "b.", "'s", "é", "中", " ", "\x0b", "<|endoftext|>", "...", ", ", "A", "’", "1"]
        texts = ["".join(RND.choice(odd) for _ in range(RND.randint(0, 40))).encode() for _ in range(800)]
        assert list(e.encode(texts)) == e.whole(texts)
    for t in texts:
        assert bpe.encode_tree(t, leaf=RND.choice((2, 9, 30))).astype("<u4").tobytes() == tokens.encoder().whole([t])[0]


def test_bpe(docs, none):
    lib = tokens.encoder().lib
    got = [(r.doc_id, r.ids, r.decoded) for r in bpe.decode(bpe.encode(docs, leaf=1000)).collect()]
    want = [(d, lib.encode(t or "", add_special_tokens=False).ids, t or "") for d, t, _ in ROWS]
    assert key(got) == key(want)
    assert bpe.decode(bpe.encode(none)).count() == 0


def test_exact(docs, none):
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for d, t, _ in ROWS:
        groups.setdefault(fold(t), []).append(d)
    keep = {t: max((d for d in g if d is not None), default=None) for t, g in groups.items()}
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.keepers(docs, counters=3).collect()]
    assert key(got) == key([(d, keep[fold(t)], len(groups[fold(t)]), d == keep[fold(t)]) for d, t, _ in ROWS])
    left = exact.deduplicate(docs).collect()
    assert key(fold(r.text) for r in left) == key(groups)
    assert exact.keepers(none).count() == 0


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def test_near(docs, none):
    sets = [shingles(t) for _, t, _ in ROWS]
    root = list(range(len(ROWS)))
    for i in range(len(ROWS)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    least = {r: min((ROWS[i][0] for i in range(len(ROWS)) if root[i] == r and ROWS[i][0] is not None), default=None) for r in root}
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in near.rows_of(docs).collect()]
    assert key(got) == key([(d, len(sets[i]), least[root[i]] if sets[i] else d) for i, (d, _, _) in enumerate(ROWS)])
    left = near.deduplicate(docs).collect()
    assert len(left) == len({r for i, r in enumerate(root) if sets[i]}) + sum(not s for s in sets)
    assert near.rows_of(none).count() == 0


@pytest.mark.parametrize("split", [512, 1])
def test_substrings(docs, none, split, monkeypatch):
    monkeypatch.setattr(substrings, "SPLIT", split)
    count = Counter()
    for _, t, _ in ROWS:
        b = (t or "").encode()
        count.update(b[i : i + 400] for i in range(len(b) - 399))
    want = []
    for d, t, _ in ROWS:
        b = (t or "").encode()
        spans = substrings.merged([(i, i + 400) for i in range(len(b) - 399) if count[b[i : i + 400]] > 1])
        kept = substrings.without(b, spans)
        want.append((d, len(b), len(b) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    assert key(tuple(r)[:5] for r in substrings.report(docs).collect()) == key(want)
    assert substrings.remove(docs).columns == docs.columns
    assert substrings.report(none).count() == 0


@pytest.mark.parametrize("split", [512, 2])
def test_substrings_of_two_lengths(spark, split, monkeypatch):
    """Against every window: shared pieces, runs with short periods inside other text, repeated rows, extra columns."""
    monkeypatch.setattr(substrings, "SPLIT", split)
    rnd = random.Random(split)
    pieces = ["".join(rnd.choice("abcdefgh é") for _ in range(rnd.randint(20, 300))) for _ in range(12)] + ["x" * 500, "ab" * 130, "abc " * 50, "x" * 100, "é" * 90]
    texts = ["".join(rnd.choice(pieces) if rnd.random() < 0.5 else "".join(rnd.choice("abcdefgh é") for _ in range(rnd.randint(1, 90))) for _ in range(rnd.randint(0, 9))) for _ in range(60)]
    texts += [texts[3], texts[3], "x" * 4000, "ab" * 2500 + "y" * 100]
    found = substrings.report(spark.createDataFrame([(i, t, 1, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int, anchor int").repartition(3), length=150, passage=70)
    got = {r.doc_id: r for r in found.collect()}
    assert len(got) == len(texts)
    for length in (150, 70):
        count = Counter(b[i : i + length] for b in map(str.encode, texts) for i in range(len(b) - length + 1))
        for d, b in enumerate(map(str.encode, texts)):
            spans = substrings.merged([(i, i + length) for i in range(len(b) - length + 1) if count[b[i : i + length]] > 1])
            kept, r = substrings.without(b, spans), got[d]
            if length == 150:
                assert (r.n_removed, r.n_spans, r.kept_sha256) == (len(b) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()), d
            else:
                assert (r.n_passage_bytes, r.n_passages) == (len(b) - len(kept), len(spans)), d
                assert len(r.text) >= len(kept.decode(errors="ignore"))


def test_substrings_of_a_long_run(spark):
    """A run is entered by a few windows, not by each."""
    (h, p, lo, end), left_out = substrings.anchors(b"ab" * 500_000, (400, 200))
    assert left_out and (end - lo).sum() < 50_000
    df = spark.createDataFrame([(1, "ab" * 500_000), (2, "ba" * 200 + "c"), (3, say(80))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substrings.report(df).collect()} == {1: 1_000_000, 2: 400, 3: 0}


def test_suffix_array():
    for _ in range(500):
        s = [RND.randint(1, RND.choice((1, 2, 5))) for _ in range(RND.randint(0, 30))] + [0]
        assert suffixes.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_paragraphs(docs, none):
    got = {(r.doc_id, r.line): r for r in paragraphs.repeats(docs).collect()}
    assert {(10, 1), (11, 0), (12, 1)} <= set(got) and not got[10, 1].removed and got[11, 0].keep_doc_id == 10 and got[12, 1].removed
    assert not any(d in (13, 14, 0, 1) for d, _ in got)
    assert paragraphs.repeats(none).count() == 0


def test_passages_in_other_lines_and_across_line_breaks(spark):
    rng = random.Random(8)
    new = lambda n: " ".join("%x" % rng.getrandbits(60) for _ in range(n))
    run, other = new(51), new(50).split()
    broken = "\n".join(" ".join(other[i : i + 10]) for i in range(0, 50, 10))
    texts = [new(200) + " " + run + " " + new(150), new(90) + "\n" + new(300) + " " + run, new(7) + "\n" + broken, new(30) + " " + " ".join(other) + " " + new(60), new(400)]
    rows = paragraphs.repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    pairs = {(r.doc_id, r.keep_doc_id, r.removed) for r in rows}
    assert pairs == {(0, 0, False), (1, 0, True), (2, 2, False), (3, 2, True)}
    assert {r.line for r in rows if r.doc_id == 1} == {1}
    for r in rows:
        own, kept = (" ".join(texts[d].split()) for d in (r.doc_id, r.keep_doc_id))
        part = own.split()[r.first_word : r.first_word + r.n_words]
        assert len(part) == r.n_words >= paragraphs.UNIT and " ".join(part) in kept


def test_packing(docs, none):
    got = packing.pack(docs, keep_ids=True).collect()
    by = {}
    for r in got:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in by.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= 1024
    total = sum(r.length for r in got)
    lib = tokens.encoder()
    assert total == sum(len(x) // 4 + 1 for x in lib.encode([(t or "").encode() for _, t, _ in ROWS]))
    lengths = [n for items in by.values() for _, n in items]
    assert len(by) <= len(packing.best_fit(lengths)[2]) + 2
    assert packing.pack(none).count() == 0


def test_token_files(docs, none):
    manifest = tokenfiles.write(docs)
    got = tokenfiles.read(manifest).orderBy("start").collect()
    e = tokens.encoder(tokens.WORD_BPE)
    want = [(d, ids + b"\1\0\0\0") for (d, _, _), ids in zip(ROWS, e.encode([(t or "").encode() for _, t, _ in ROWS]), strict=True)]
    assert key((r.doc_id, bytes(r.ids)) for r in got) == key(want)
    starts = [r.start for r in got]
    assert starts == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    assert {r.doc_id for r in tokenfiles.read(manifest, {3, 13}).collect()} == {3, 13}
    assert tokenfiles.read(tokenfiles.write(none)).count() == 0


def test_token_file_damage(docs):
    uri = tokenfiles.write(docs).orderBy("part").first().uri.removeprefix("file://")
    data = bytearray(open(uri, "rb").read())
    data[12] ^= 255
    open(uri, "wb").write(data)
    with pytest.raises(Exception):
        list(tokenfiles.FrameReader("file://" + uri).documents())


def test_statistics(docs, none):
    rows = quality.with_statistics(docs).collect()
    got = [(r.doc_id, *(r[c] for c in quality.COUNTS)) for r in rows]
    want = []
    for d, t, _ in ROWS:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        over = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.append((d, len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(over)))
    assert key(got) == key(want)
    assert quality.judge(none, []).count() == 0


def test_decision_list():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(3000), "b": rng.random(3000)}
    bad = (x["a"] > 0.9) | ((x["b"] < 0.1) & (x["a"] > 0.5))
    rules = quality.learn(x, bad)
    found = np.any([quality._holds(x, r) for r in rules], axis=0)
    assert (found & bad).sum() > 0.9 * bad.sum() and (found & ~bad).sum() < 0.02 * bad.sum()


def test_scores(docs, none):
    got = {(r.doc_id, r.n_tokens, round(r.base_score, 6)): r for r in scoring.score(docs, top_size=50).collect()}
    out = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    c = Counter()
    for d, t, _ in ROWS:
        if not out(d):
            c.update((t or "").encode().lower().split() + [b""])
    total = sum(c.values())
    for d, t, _ in ROWS:
        w = (t or "").encode().lower().split() + [b""]
        base = sum(np.log10((c[x] + 0.5) / (total + 0.5 * (len(c) + 1))) for x in w)
        r = got[d, len(w), round(base, 6)]
        assert r.held_out == out(d) and r.n_known == sum(c[x] > 0 for x in w) and r.train_tokens == total and np.isfinite(r.score)
    assert scoring.score(none).count() == 0


def test_every_document_is_learned_from(spark):
    head = np.zeros(recurrent.SYMBOLS)
    top = spark.sparkContext.broadcast([(b"", 9), (b"one", 5)])
    for i in range(6):
        alone = spark.createDataFrame([(i, "one two " * 30)], "doc_id long, text string")
        before, after = recurrent.packed(recurrent.initial(head)), recurrent.packed(scoring.train(alone, top, head))
        assert (before != after).any(), i


def test_warc(spark):
    rows = [(1, "http://a.b.com/x?y=1", "hi"), (2, "https://www.c.org", "hi"), (3, None, None), (4, "u v", ""), (None, "http://a.b.com/x?y=1", "hi"), (7, "http://é.fr/ü", "é"), (7, "http://é.fr/ü", "é")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.build_index(warc.write(pages), lines=2)
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.lookup(pages, index, page_id="page_id").collect()}
    assert got == {(1, "response", None, 2), (2, "revisit", 1, 2), (3, "response", None, 0), (4, "revisit", 3, 0), (None, "revisit", 1, 2), (7, "response", None, 2)}
    one = spark.createDataFrame([("https://user@A.b.com:80/x?y=1#z",)], "url string")
    assert {r.page_id for r in warc.lookup(one, index).collect()} == {1, None}
    empty = spark.createDataFrame([], pages.schema)
    assert warc.lookup(empty, warc.build_index(warc.write(empty)), page_id="page_id").count() == 0


def test_substrings_cut_a_code_point(spark):
    # the letters share their last byte, which goes with the passage
    rest = say(100)
    df = spark.createDataFrame([(1, "one é" + rest), (2, "two ĩ" + rest)], "doc_id long, text string")
    found = substrings.remove(df).orderBy("doc_id").collect()
    assert [r.text for r in found] == ["one \ufffd", "two \ufffd"]


def test_recurrent_gradients():
    """Of states and weights against finite differences; probabilities of all symbols sum to one."""
    rng = np.random.default_rng(2)
    p = {k: v.astype(np.float64) for k, v in recurrent.initial(rng.integers(1, 99, recurrent.SYMBOLS)).items()}
    states = rng.normal(0, 0.5, (9, recurrent.HIDDEN))
    targets = rng.integers(0, 200, 9)
    every = recurrent.log_probs(p, np.repeat(states[:1], recurrent.SYMBOLS, axis=0), np.arange(recurrent.SYMBOLS))[0]
    assert abs(np.exp(every).sum() - 1) < 1e-6
    _, back, grads = recurrent.log_probs(p, states, targets, True)
    loss = lambda: -recurrent.log_probs(p, states, targets)[0].sum()
    own, g = grads["word"]
    c, w, h = int(targets[0]) // recurrent.WITHIN, int(targets[0]), 3
    for array, at, want in ((states, (4, 5), back[4, 5]), (p["class"], (c, h), grads["class"][1][c, h]), (p["word"], (w, h), g[list(own).index(c), w % recurrent.WITHIN, h])):
        old, found = array[at], []
        for step in (1e-4, -1e-4):
            array[at] = old + step
            found.append(loss())
        array[at] = old
        assert abs((found[0] - found[1]) / 2e-4 - want) < 1e-3


def test_suffix_stage_passes_texts_that_were_empty(spark):
    import corpus_pipeline

    rows = [(1, None, None), (2, "", 0), (3, PASSAGE, len(PASSAGE)), (4, "one " + PASSAGE, 4 + len(PASSAGE)), (5, "one", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    left = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.suffix_dedup(spark, df, "").collect()}
    assert left == {1: (None, None), 2: ("", 0), 4: ("one ", 4), 5: ("one", 3)}


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    n = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        new = corpus_pipeline.store.table(stage(spark, docs, folder), "stage")
        assert new.columns == docs.columns and 0 < new.count() <= n
        docs, n = new, new.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).select("doc_id").distinct().count() == n


def test_recurrent_score_step_by_step():
    """Whole documents side by side against one symbol at a time, with sums over the whole vocabulary."""
    rng = np.random.default_rng(4)
    p = {k: v.astype(np.float64) for k, v in recurrent.initial(rng.integers(1, 99, recurrent.SYMBOLS)).items()}
    docs = [np.append(rng.integers(0, recurrent.SYMBOLS, n), 7) for n in (0, 3, 90, 200)]
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for d, got in zip(docs, recurrent.score(p, docs, 7), strict=True):
        h, total, last = np.zeros(recurrent.HIDDEN), 0.0, 7
        for x in d.tolist():
            g, u, n = p["embed"][last] @ p["into"] + p["gate"], h @ p["over"], recurrent.HIDDEN
            z, r = sigmoid(g[:n] + u[:n]), sigmoid(g[n : 2 * n] + u[n : 2 * n])
            h = z * h + (1 - z) * np.tanh(g[2 * n :] + r * u[2 * n :])
            classes = np.exp(p["class"] @ h + p["class_bias"])
            words = np.exp((p["word"] @ h + p["word_bias"]).reshape(recurrent.CLASSES, -1))
            share = (words / words.sum(1, keepdims=True) * (classes / classes.sum())[:, None]).ravel()
            assert abs(share.sum() - 1) < 1e-9
            total, last = total + np.log(share[x]), x
        assert abs(total - got) < 1e-3 * max(1, len(d) / 10)


def test_trainer_reads_every_symbol_once(monkeypatch):
    rng = np.random.default_rng(5)
    seen = []
    def window(self, before, targets, held, starts, h):
        seen.extend((int(b), int(t), bool(s)) for b, t, s in zip(before[held], targets[held], starts[held], strict=True))
        self.tokens += int(held.sum())
        return h
    monkeypatch.setattr(recurrent.Trainer, "_window", window)
    docs = [np.append(rng.integers(10, 4000, n), 7) for n in (0, 1, 5, 2500, 40, 7, 999, 1000, 12000, 3)]
    t = recurrent.Trainer(recurrent.initial(np.ones(recurrent.SYMBOLS)), 7, lanes=3)
    for d in docs:
        t.train([d])
    t.finish()
    want = [(int(d[i - 1]) if i else 7, int(x), i % recurrent.SEGMENT == 0) for d in docs for i, x in enumerate(d.tolist())]
    assert sorted(seen) == sorted(want) and t.tokens == len(want)


def test_hosts_that_cannot_be_parsed():
    bad = ["http://[x/", "http://a.b]/c", "//["]
    assert [warc.reversed_host(u) for u in bad] == bad
    assert warc.reversed_host("http://[::1]:80/a") == "[::1])/a" != warc.reversed_host("http://[::2]/a")


def test_packing_goes_on_while_a_group_is_too_large(spark, monkeypatch):
    """Of 60 bins that fill a third each, tasks that take 7 still make about a third."""
    monkeypatch.setattr(packing, "ROUND_BINS", 7)
    df = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("one two three four five").alias("text")).repartition(5)
    size = packing.pack(df).agg(F.max("length")).first()[0] * 3
    rows = packing.pack(df, size=size).collect()
    assert len(rows) == 60 and 20 <= len({r.sequence_id for r in rows}) <= 24
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in by.values():
        placed.sort()
        assert [o for o, _ in placed] == [sum(n for _, n in placed[:k]) for k in range(len(placed))] and sum(n for _, n in placed) <= size


def test_components_of_a_hub(spark):
    from sparkloom.llm import linking

    edges = [(0, i) for i in range(1, 400)] + [(500 + i, 501 + i) for i in range(30)] + [(700, 700)]
    got = dict(linking.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(400)}, **{i: 500 for i in range(500, 531)}}


@pytest.mark.parametrize("seed", range(3))
def test_components_of_chains_and_random_links(spark, seed):
    from sparkloom.llm import linking

    rng = np.random.default_rng(seed)
    chain = rng.permutation(np.arange(100, 130)).tolist()
    edges = [(a, b) for a, b in rng.integers(0, 60, size=(45, 2)).tolist()] + list(zip(chain, chain[1:], strict=False))
    edges += edges[:5] + [(None, 3), (4, None), (200, 200)]
    root = {}
    for a, b in [e for e in edges if None not in e and e[0] != e[1]] * len(edges):
        low = min(root.get(a, a), root.get(b, b))
        root[a] = root[b] = low
    assert dict(linking.components(spark.createDataFrame(edges, "a long, b long")).collect()) == root
    assert linking.components(spark.createDataFrame([], "a long, b long")).collect() == []
