"""Operators that learn: language ID, LM scoring, quality rules."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.llm import language_id, lm_scoring, quality_rules
from foliant.llm.common import lean
from foliant.llm.language_id import Network


def _laid(texts):
    raw = [t.encode() if isinstance(t, str) else t for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw])


def test_gradients_against_differences():
    net = Network.random(["a", "b", "c"], hidden=3, seed=1)
    for name in ("inputs", "hidden", "output", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    data, ends = _laid(["hello wide world", "ab"])
    starts, lengths, text = language_id.windows(data, ends, 10)
    steps, labels = language_id.steps_of(data, starts, lengths, 10), np.array([0, 1, 2])[: len(starts)]
    loss, grads = net.loss_gradients(steps, lengths, labels)
    rng = np.random.default_rng(0)
    for w, g in zip(net.weights(), grads):
        spots = np.argsort(-np.abs(g).ravel())[:4]
        for i in spots:
            keep = w.ravel()[i]
            w.ravel()[i] = keep + 1e-2
            up = net.loss_gradients(steps, lengths, labels)[0]
            w.ravel()[i] = keep - 1e-2
            down = net.loss_gradients(steps, lengths, labels)[0]
            w.ravel()[i] = keep
            assert abs((up - down) / 2e-2 - g.ravel()[i]) < 2e-3 + 0.02 * abs(g.ravel()[i])
    assert loss > 0 and rng is not None


def test_fast_states_equal_states_and_pooling_covers_all_bytes():
    net = Network.random(["a", "b"], seed=2)
    data, ends = _laid(["x" * 47, "", "y" * 200, "héé"])
    starts, lengths, text = language_id.windows(data, ends)
    assert lengths.sum() == len(data) and set(text.tolist()) == {0, 2, 3}
    steps = language_id.steps_of(data, starts, lengths)
    assert np.allclose(net.states(steps), net.fast_states(steps, {}), atol=1e-5)
    p = language_id.pooled(net, data, ends)
    assert np.allclose(p[[0, 2, 3]].sum(axis=1), 1, atol=1e-5) and (p[1] == 0).all()
    one = language_id.pooled(net, *_laid(["y" * 200]))
    assert np.allclose(one[0], p[2], atol=1e-5)


def test_language_id_is_right_on_held_out_documents(spark):
    out = language_id.op4_language_id(spark, "/root/testdata/sf0.01")
    got = {r["doc_id"]: r for r in out.collect()}
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [d for d, r in got.items() if r["held_out"]]
    assert set(held) == {d for d in truth if zlib.crc32(str(d).encode()) % 3 == 1}
    assert np.mean([got[d]["lang_pred"] == truth[d] for d in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_id_on_hard_rows(spark, hard, none):
    net = Network.random(["de", "en"], seed=3)
    got = language_id.predict(hard, net).collect()
    assert len(got) == hard.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add((r["lang_pred"], r["score"]))
    assert all(by[d] == {("und", 0.0)} for d in (4, 5, 6, 11)) and all(x[0] in ("de", "en") for x in by[7] | by[9])
    assert len(by[3]) == 1 and ("und", 0.0) in by[None]  # repeated rows agree
    assert language_id.fitted(none) is None and language_id.predict(none, None).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(hard, None).collect()} == {"und"}
    assert language_id.sample(hard, language_id.learns(hard["doc_id"], 3, 1)).count() > 0


def test_lm_base_scores_against_counts(spark, hard):
    learn = hard.filter("doc_id is null or doc_id <> 8")
    score = _lm(learn)[3]
    c = Counter()
    for r in learn.collect():
        c.update([*(r["text"] or "").encode().lower().split(), None])
    n, v = sum(c.values()), len(c)
    got = score(hard).collect()
    want = []
    for r in hard.collect():
        w = [*(r["text"] or "").encode().lower().split(), None]
        want.append((r["doc_id"], len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 5)))
    assert sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got), key=repr) == sorted(want, key=repr)


def _lm(docs):
    """The model of all ``docs``, its word counts, and what scores other documents by it."""
    marked = lambda d: d.select(F.col("doc_id").cast("long"), "text", F.lit(True).alias("learns"))
    model, counts, rows = lm_scoring.fit(marked(docs))
    return model, counts, rows, lambda d: lm_scoring.score(lm_scoring.encoded(marked(d), model.tree), model, counts)


def test_lm_counts_of_trigrams_and_normalisation(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", None, "", "a a b c", "zzz."] * 3)], "doc_id long, text string").repartition(2)
    model, counts, encoded, _ = _lm(docs)
    own, end, want = model.vocab.own, lm_scoring.END, Counter()
    for r in docs.collect():
        words = lm_scoring.tokens((r["text"] or "").encode())
        s = [end, end, *(own.get(w, lm_scoring.OWN_CLASSES + lm_scoring.shape(w)) for w in words), end]
        want.update(zip(s, s[1:], s[2:]))
    rows = lm_scoring.trigrams(encoded, model.tree).collect()
    k = lm_scoring.CLASSES
    assert {(r["code"] // k // k, r["code"] // k % k, r["code"] % k): r["n"] for r in rows} == dict(want)
    assert np.allclose(np.exp(model.log_class.astype(float)).sum(axis=2), 1, atol=1e-4)
    assert not model.tree.log_rest.any()  # all words are in the vocabulary: unknown ones count 1


def test_lm_scores_token_by_token(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = [f"w{i}{'.' * (i % 3 == 0)}" for i in range(400)]
    texts = [" ".join(words[int(x)] for x in rng.zipf(1.3, 40) % 400) for _ in range(120)]
    monkeypatch.setattr(lm_scoring, "FREQUENT", 150)
    monkeypatch.setattr(lm_scoring.vocabulary, "__defaults__", (150,))
    monkeypatch.setattr(lm_scoring, "GROWTH", 1)
    model, counts, _, score = _lm(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    tree, v, c = model.tree, model.vectors, {bytes(r["word"]): r["c"] for r in counts.collect()}
    assert 0 < len(tree.ids) < len(c) - 1  # some words are rare
    asked = [*texts[:3], "never seen w1 words w399.", ""]
    log = lambda z, i: float(z[i] - np.log(np.exp(z.astype(float)).sum()))
    want = []
    for t in asked:
        tokens = [*t.encode().lower().split(), b""]
        ids = [tree.end, tree.end, *(tree.ids.get(w, len(tree.ids) + lm_scoring.shape(w)) if w else tree.end for w in tokens)]
        total = 0.0
        for w, (a, b, i) in zip(tokens, zip(ids, ids[1:], ids[2:])):
            x = v.before[a] * v.factors[0] + v.before[b] * v.factors[1]
            total += log(model.log_class[tree.cls[a], tree.cls[b]] + v.classes @ x, tree.cls[i])
            for node, scope in zip(tree.node, tree.scope):
                if node[i] >= 0:
                    lo, hi = tree.bounds[scope[i]], tree.bounds[scope[i] + 1]
                    total += log(tree.prior[lo:hi] + v.nodes[lo:hi] @ x, node[i] - lo)
            if w and w not in tree.ids:  # its share of what is left of the class
                total += math.log((c.get(w, 0) + 1) / 10 ** tree.log_rest[i])
        want.append(total / math.log(10))
    got = {r["doc_id"]: r["score"] for r in score(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")).collect()}
    assert all(abs(got[i] - w) < 1e-3 for i, w in enumerate(want))


def test_lm_beats_the_base_on_held_out_documents(spark):
    got = lm_scoring.op2_lm_scoring(spark, "/root/testdata/sf0.01").filter("held_out").toPandas()
    assert (got.score > got.base_score).mean() > 0.95


def test_lm_without_documents(spark, none, hard):
    score = _lm(none)[3]
    assert score(none).count() == 0
    got = score(hard).collect()
    assert {r["n_known"] for r in got} == {0} and {r["train_tokens"] for r in got} == {0}


def test_lm_learns_the_order_of_rarer_words(spark):
    # 110 words are more frequent than the rarer ones, which all have one shape
    common = " ".join(f"f{i:03d}" for i in range(110))
    rarer = [f"rare{i:02d}x" for i in range(40)]
    pairs = [f"{a} {b}" for a, b in zip(rarer[:20], rarer[20:])]
    texts = [common] * 200 + [" ".join(pairs[(i + j * 7) % 20] for j in range(20)) for i in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    model, _, _, score = _lm(docs)
    assert not set(w.encode() for w in rarer) & set(model.vocab.own) and len({lm_scoring.shape(w.encode()) for w in rarer}) == 1
    crossed = [f"{a} {b}" for a, b in zip(rarer[:20], rarer[21:] + rarer[20:21])]
    asked = spark.createDataFrame([(0, " ".join(pairs)), (1, " ".join(crossed))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in score(asked).collect()}
    assert abs(got[0]["base_score"] - got[1]["base_score"]) < 1e-9 and got[0]["score"] > got[1]["score"] + 1


def test_lm_words_are_normalised_after_any_two_others(spark):
    texts = [" ".join(f"w{(i * j) % 300}{'.' * (j % 2)}" for j in range(60)) for i in range(40)]
    model, counts, _, _ = _lm(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    tree = model.tree
    assert len(tree.ids) == counts.count() - 1 and np.abs(model.vectors.nodes).sum() > 0  # all but the end
    every = np.arange(len(tree.cls))
    real = np.r_[every[: tree.end][tree.node[0, : tree.end] >= 0], np.arange(len(model.vocab.own)), tree.end]
    for a, b in ((0, 5), (tree.end, tree.end), (len(tree.ids) - 1, 150), (len(tree.ids), 3)):
        p = 10 ** lm_scoring.log_next(tree, model.vectors, model.log_class, np.full(len(real), a), np.full(len(real), b), real)
        assert abs(p.sum() - 1) < 1e-3


def test_lm_probabilities_of_scores_of_any_size():
    z = np.float32([[200, 100, 0], [85, 81, 0], [-300, -301, -400], [1, 2, 3]])
    want = z.astype(float) - np.logaddexp.reduce(z.astype(float), axis=1)[:, None]
    for rows in (slice(0, 4), slice(0, 1), slice(1, 2), slice(2, 3), slice(3, 4)):
        for at in range(3):
            got = lm_scoring._picked_log(z[rows].copy(), np.full(len(z[rows]), at))
            assert np.allclose(got, want[rows, at], atol=1e-4)


def test_lm_step_equals_sums_over_trigrams(monkeypatch):
    words = {f"{'ab'[i % 2] * (1 + i % 9)}{i:02d}".encode(): 90 - i for i in range(80)}
    vocab = lm_scoring.Vocabulary(words, 5000, 81)
    tree = lm_scoring.Tree.of(vocab, np.full(lm_scoring.CLASSES, 900.0))
    rng, k = np.random.default_rng(5), lm_scoring.CLASSES
    base = rng.normal(0, 1, (k, k, k))
    base = (base - np.logaddexp.reduce(base, axis=2)[:, :, None]).astype(np.float32)
    start = lm_scoring.Vectors.start(tree)
    start.classes, start.nodes = [rng.normal(0, 0.3, x.shape).astype(np.float32) for x in (start.classes, start.nodes)]
    a, b, c = rng.integers(0, len(tree.cls), (3, 300))
    monkeypatch.setattr(lm_scoring, "CELLS", 700)  # many pieces
    monkeypatch.setattr(lm_scoring.Tree, "drawn", lambda self, scopes, n, rng: np.repeat(self.bounds[scopes][:, None], n, 1))
    trainer = lm_scoring.Trainer(tree, start, base, seed=1)
    trainer.step(a, b, c)
    data = lambda s, noise: 1 / (1 + noise * np.exp(-s))
    v, first, count = start, int(tree.bounds[lm_scoring.SHAPES]), lm_scoring.DRAWN
    grads = [np.zeros(x.shape) for x in v.all()]
    for i, j, w in zip(a, b, c):
        x = (v.before[i] * v.factors[0] + v.before[j] * v.factors[1]).astype(float)
        moved = [(2, slice(None), v.classes, tree.cls[w], np.exp(base[tree.cls[i], tree.cls[j]].astype(float)) * lm_scoring.NOISE, lm_scoring.NOISE)]
        if tree.node[0, w] >= 0:
            at = slice(*tree.bounds[tree.scope[0, w] :][:2])
            if at.stop - at.start > 1:
                moved.append((3, at, v.nodes[at], tree.node[0, w] - at.start, np.exp(tree.prior[at].astype(float)) * count, count))
        if tree.node[1, w] >= 0:
            at = slice(*tree.bounds[tree.scope[1, w] :][:2])
            moved.append((3, at, v.nodes[at], tree.node[1, w] - at.start, count * (np.arange(at.stop - at.start) == 0), count))
        d_x = np.zeros(len(x))
        for which, at, q, real, noise, n in moved:
            p = data(q @ x, n)
            d = p * noise
            d[real] += p[real] - 1
            grads[which][at] += d[:, None] * x
            d_x += d @ q
        grads[0][i] += d_x * v.factors[0]
        grads[0][j] += d_x * v.factors[1]
        grads[1] += d_x * np.stack([v.before[i], v.before[j]])
    for which in (0, 1, 2):
        square = lm_scoring.DAMPING + (grads[which] ** 2).mean(axis=1)
        want = v.all()[which] - lm_scoring.WORD_RATE * grads[which] / np.sqrt(square)[:, None]
        assert np.allclose(trainer.vectors.all()[which], want, atol=1e-4)
    square = lm_scoring.DAMPING + (grads[3] ** 2).mean(axis=1)
    assert np.allclose(trainer.squares[3], square, rtol=1e-3, atol=1e-5)
    want = v.nodes - lm_scoring.WORD_RATE * grads[3] / np.sqrt(square)[:, None]
    assert np.allclose(trainer.vectors.nodes, want, atol=1e-4) and 0 < first < len(want)


def test_lm_wide_words_of_the_vocabulary_and_rare_ones(spark, monkeypatch):
    wide, other = "x" * 70, "y" * 70
    texts = [(i, f"{wide} a A", True) for i in range(9)] + [(9, None, True), (10, f"{other} {wide} b.\x0bb. {other}", True)]
    monkeypatch.setattr(lm_scoring.vocabulary, "__defaults__", (2,))
    monkeypatch.setattr(lm_scoring, "GROWTH", 0)
    docs = spark.createDataFrame(texts, "doc_id long, text string, learns boolean").coalesce(1)
    model, _, rows = lm_scoring.fit(docs)
    (name, hashed), known = lm_scoring.narrow([b"b.", other.encode()]), model.tree.ids
    assert set(known) == {b"a", lm_scoring.narrow([wide.encode()])[0]} and hashed != other.encode() and name == b"b."
    v, end = len(known), model.tree.end
    got = {r["doc_id"]: (np.frombuffer(bytes(r["ids"]), np.int32).tolist(), dict(zip(map(bytes, r["rare"]), r["times"]))) for r in rows.collect()}
    w, a = known[lm_scoring.narrow([wide.encode()])[0]], known[b"a"]
    b, y = v + lm_scoring.shape(b"b."), v + lm_scoring.shape(hashed)
    assert got[0] == ([w, a, a, end], {}) and got[9] == ([end], {})
    assert got[10] == ([y, w, b, b, y, end], {hashed: 2, b"b.": 2})


def test_workers_hold_the_memory_of_large_arrays(spark):
    def run(batches):
        import resource

        for b in batches:
            for _ in range(3):
                np.ones(4 << 20, np.uint8)
            before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
            for _ in range(50):
                np.ones(4 << 20, np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before])], ["faults"])

    faults = spark.range(1).coalesce(1).mapInArrow(lean(run, hold=True), "faults long").first()[0]
    assert faults < 2000  # 1024 pages an array


def test_lm_long_words_are_words(spark):
    long, other = "x" * 5000, "x" * 4999 + "y"
    model, counts, _, score = _lm(spark.createDataFrame([(i, f"{long} a") for i in range(30)] + [(30, other)], "doc_id long, text string"))
    assert max(len(bytes(r["word"])) for r in counts.collect()) <= lm_scoring.WIDEST and model.vocab.distinct == 4
    got = {r["doc_id"]: r for r in score(spark.createDataFrame([(0, long), (1, other), (2, long + "z")], "doc_id long, text string")).collect()}
    assert [got[i]["n_known"] for i in range(3)] == [2, 2, 1] and got[0]["base_score"] > got[1]["base_score"] > got[2]["base_score"]


def test_lm_vocabulary_grows_with_the_training_tokens(spark):
    counts = spark.range(5000).select(F.concat(F.lit("w"), "id").cast("binary").alias("word"), F.lit(10).cast("long").alias("c"))
    assert len(lm_scoring.vocabulary(counts, frequent=1000).counts) == int(lm_scoring.GROWTH * 50_000**0.5)


def test_statistics_by_hand():
    data, ends = _laid(["Ab ab\nAB! #x", "", "one"])
    s = dict(zip(quality_rules.STATS, quality_rules.statistics(data, ends)[0]))
    assert s["word_bytes"] == 2.25 and s["distinct_words"] == 0.75 and s["capital_words"] == 0.5 and s["marked_words"] == 0.25
    assert abs(s["upper_rate"] - 3 / 12) < 1e-9 and abs(np.expm1(s["log_lines"]) - 2) < 1e-9 and s["shouted_words"] == 0.25
    assert not quality_rules.statistics(data, ends)[1].any()
    alone = quality_rules.statistics(*_laid(["one"]))[0]
    assert np.allclose(alone, quality_rules.statistics(data, ends)[2])


def test_rules_as_columns_equal_rules_in_numpy(spark, hard):
    rng = np.random.default_rng(0)
    x = rng.random((600, len(quality_rules.STATS)))
    y = ((x[:, 3] > 0.5) & (x[:, 7] < 0.6)).astype(float)
    model = quality_rules.fit(x, y)
    z = np.full(len(x), model.bias)
    for r, w in model.rules:
        z += r.holds(x) * w
    for i, lo, hi, w in model.linear:
        z += np.clip(x[:, i], lo, hi) * w
    score = 1 / (1 + np.exp(-z))
    assert ((score > 0.5) == y).mean() > 0.97
    rows = spark.createDataFrame([tuple(map(float, r)) for r in x], quality_rules.STATS)
    assert np.allclose(sorted(r[0] for r in rows.select(model.column()).collect()), sorted(score))


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = quality_rules.op6_quality_rules(spark, sf).filter("held_out").toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    assert (both.predicted == both.quality).mean() > 0.97
    assert ((both.score >= 0.7) == (both.predicted == 1)).all()


def test_quality_on_hard_rows(spark, hard, none):
    stats = quality_rules.with_statistics(hard)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (2, None), (3, 1), (None, 1)], "doc_id long, quality int")
    model = quality_rules.fitted(stats, labels)
    got = stats.select("doc_id", model.column().alias("s")).collect()
    assert len(got) == hard.count() and all(0 <= r["s"] <= 1 for r in got)
    empty = quality_rules.fitted(stats, labels.limit(0))
    assert {r[0] for r in stats.select(empty.column()).collect()} == {0.5}
    assert quality_rules.with_statistics(none).count() == 0
    assert quality_rules.fit(np.zeros((3, len(quality_rules.STATS))), np.ones(3)).bias == pytest.approx(6)
