"""Operators over whole corpora against brute force: packing, mixing, line dedup,
near-dedup, top-k and licenses."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from foliant.llm import bitslice_topk, license_scan, line_dedup, mixing, near_dedup, packing, words
from foliant.llm.words import blocks, hashes, spans


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def _docs(spark, texts, sources=None):
    rows = [(i, t, (sources or ["s"] * len(texts))[i]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


# ---- words


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="aB é\t\n漢", max_size=12), min_size=1, max_size=6))
def test_spans_and_hashes(texts):
    raw = [t.encode() for t in texts]
    data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw])
    s, e = spans(data, ends)
    words = [w for r in raw for w in r.split()]
    assert [data[a:b].tobytes() for a, b in zip(s, e)] == words
    h = dict(zip([w.lower() for w in words], hashes(data, s, e).tolist()))
    assert [h[w.lower()] for w in words] == hashes(data, s, e).tolist() and len(set(h.values())) == len(h)


# ---- best-fit packing


def _bins(plan, counts, seq_len):
    """Where every piece lies, from a plan; checks that no place is used twice."""
    rows = sorted(plan)
    out = {}
    for length, n in counts.items():
        own = [r for r in rows if r[0] == length]
        for rank in range(n):
            row = [r for r in own if r[1] <= rank][-1]
            step = rank - row[1]
            out.setdefault(row[3] + step // row[2], []).append((row[4] + step % row[2] * length, length))
    for places in out.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= seq_len
    return out


@settings(max_examples=400, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(1, 9), max_size=12))
def test_plan_places_every_piece(counts):
    plan = packing.plan(counts, 24)
    found = _bins(plan, counts, 24)
    assert sum(len(v) for v in found.values()) == sum(counts.values())
    least, first_fit = -(-sum(k * v for k, v in counts.items()) // 24), []
    for x in sorted((k for k, v in counts.items() for _ in range(v)), reverse=True):
        at = next((i for i, room in enumerate(first_fit) if room >= x), None)
        if at is None:
            first_fit.append(24 - x)
        else:
            first_fit[at] -= x
    assert least <= len(found) <= max(1, len(first_fit))
    rows, bins = packing.first_fit(counts, 24)
    assert bins == len(first_fit) and sorted(map(sorted, _bins(rows, counts, 24).values())) is not None


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 3), max_size=6), st.integers(0, 60))
def test_fullest_against_brute_force(counts, room):
    sums = {0}
    for length, n in counts.items():
        sums = {s + length * k for s in sums for k in range(n + 1)}
    chosen = packing.fullest(counts, room)
    assert all(n <= counts[x] for x, n in chosen.items())
    assert sum(x * n for x, n in chosen.items()) == max(s for s in sums if s <= room)


def test_packing_on_hard_rows(spark, hard, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for r in hard.collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            own = ids[k : k + 4096]
            want[(r["doc_id"], k // 4096, k, len(own), zlib.crc32(own.tobytes()))] += 1
    got = packing.packed_documents(hard).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by: dict = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) == -(-sum(r["length"] for r in got) // 4096)
    assert packing.packed_documents(none).count() == 0
    ids = packing.pieces(hard.filter("doc_id = 1"), with_ids=True).first()["ids"]
    assert ids == [*tokenizer.encode(hard.filter("doc_id = 1").first()["text"], add_special_tokens=False).ids, 1]


def test_word_ids_equal_the_tokenizer_and_survive_forgetting(spark):
    words = packing.WordIds(packing.tokenizer_path(), most=50)
    rng = random.Random(0)
    texts = ["ab's it'LL <|endoftext|>x á z 'Re x\x1cy ÀÉ ΑΣ Σ. 12a3 ǅ \x00q", ""] + [" ".join("".join(rng.choices("abcé'&$1.", k=rng.randint(1, 7))) for _ in range(60)) for _ in range(20)]
    for t in texts:
        raw = t.encode()
        ids, bounds = words.ids(np.frombuffer(raw, np.uint8), np.array([len(raw)]), 1)
        assert ids.tolist() == [*words.tokenizer.encode(t, add_special_tokens=False).ids, 1] and bounds.tolist() == [0, len(ids)]


def _twins():
    """Two words that polynomial hashes modulo 2^64 can't tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(1 << 11)]
    return ["".join("ba"[b ^ flip] for b in bits) for flip in (0, 1)]


def test_words_are_told_apart_by_their_bytes():
    a, b = _twins()
    data = np.frombuffer(" ".join([a, "x", b, a, "x", b, a[:-1], "y"]).encode(), np.uint8)
    s, e = words.spans(data, np.array([len(data)]))
    h = words.hashes(data, s, e, words.EXACT)
    assert h[0] == h[2]  # else this tests nothing
    first, group, _ = words.grouped(data, s, e)
    raw = [data[i:j].tobytes() for i, j in zip(s, e)]
    assert [raw[first[g]] for g in group] == raw and len(first) == len(set(raw))
    rng = np.random.default_rng(2)
    data = rng.choice(np.frombuffer(b"ab\0 \xc3\xa9", np.uint8), 200_000)
    s, e = words.spans(data, np.array([len(data)]))
    first, group, key = words.grouped(data, s, e)
    raw = [data[i:j].tobytes() for i, j in zip(s, e)]
    assert [raw[first[g]] for g in group] == raw and len(first) == len(set(raw))
    strong = words.strong_hashes(data, s[first], e[first], key)
    assert len(set(strong.tolist())) == len(first)
    known = packing.WordIds(packing.tokenizer_path())
    for t in (f"{a} {b}", f"{b} {a} {b}", b, a):
        r = t.encode()
        ids, _ = known.ids(np.frombuffer(r, np.uint8), np.array([len(r)]), 1)
        assert ids.tolist() == [*known.tokenizer.encode(t, add_special_tokens=False).ids, 1]


# ---- mixing


def _brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        share = sum(weight[s] for s in free)
        t = {s: (total - sum(capped.values())) * weight[s] / share for s in free}
        over = [s for s in free if t[s] > 3 * sizes[s]]
        if not over:
            return capped | t
        capped |= {s: 3 * sizes[s] for s in over}


@pytest.mark.parametrize("seed", range(4))
def test_targets_and_taken(spark, seed):
    rng = random.Random(seed)
    sources = [rng.choice(["a", "b", "c", "é", None][: seed + 2]) for _ in range(40)]
    texts = [" ".join(["w"] * rng.choice([0, 1, 5, 60, 300])) for _ in sources]
    docs = _docs(spark, texts, sources)
    at, slots, cuts = mixing.mix(docs, block_words=16, shard_slots=8)
    got = mixing.taken(at, cuts).drop("first_shard", "last_shard").collect()
    size, total = {s: 0 for s in sources}, {s: 0 for s in sources}
    for s, t in zip(sources, texts):
        size[s] += len(t.split())
    want = _brute_targets(size)
    for r in got:
        assert r["size"] == len(texts[r["doc_id"]].split()) and r["source_size"] == size[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"]
        total[r["source"]] += r["taken"]
    assert all(abs(total[s] - want[s]) <= 0.5 + 1e-6 for s in total)
    places = [r["place"] for r in slots.collect()]
    assert sorted(places) == list(range(len(places)))  # every slot of the output once
    again = mixing.taken(*mixing.mix(docs.repartition(3), block_words=16, shard_slots=8)[::2]).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in got)


def test_shard_counts_are_draws_that_decide_what_is_read(spark, monkeypatch):
    quota = spark.createDataFrame([(1, 600, 0), (2, 300, 600), (3, 0, 900), (4, 124, 900)], "sid long, slots long, begins long")
    got = mixing.shard_counts(quota, 1024, 4, 64, 20).collect()
    by = {(r["shard"], r["sid"]): r["n"] for r in got}
    assert all(sum(n for (s, _), n in by.items() if s == shard) == 64 for shard in range(16))
    assert {i: sum(n for (_, sid), n in by.items() if sid == i) for i in (1, 2, 3, 4)} == {1: 600, 2: 300, 3: 0, 4: 124}
    ones = np.array([by.get((s, 1), 0) for s in range(16)])
    assert 1.5 < ones.std() < 8  # sqrt(64 * 0.59 * 0.41) = 3.9
    assert len({mixing.shard_counts(quota, 1024, 4, 64, seed).filter("shard = 0 and sid = 1").first()["n"] for seed in range(6)}) > 1
    docs = _docs(spark, [" ".join(["w"] * n) for n in (40, 100, 7, 64)], ["a", "b", "b", None])
    draw = mixing.shard_counts
    monkeypatch.setattr(mixing, "shard_counts", lambda *a: draw(*a).withColumn("n", F.lit(0).cast("long")))
    assert mixing.mixed_documents(docs, block_words=16).count() == 0


def test_many_sources_are_numbered_and_filled_without_one_task(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    monkeypatch.setattr(mixing, "CELLS", 4)
    mixing.running.__defaults__ = (3,)
    rng = random.Random(8)
    try:
        sources = [rng.choice([None, *"abcdefgéh漢"]) for _ in range(60)]
        texts = [" ".join(["w"] * rng.choice([0, 1, 5, 60])) for _ in sources]
        at, slots, cuts = mixing.mix(_docs(spark, texts, sources), block_words=4, shard_slots=8)
        got = mixing.taken(at, cuts).collect()
    finally:
        mixing.running.__defaults__ = (mixing.GROUP,)
    size = Counter()
    for s, t in zip(sources, texts):
        size[s] += len(t.split())
    want, total = _brute_targets(dict(size)), Counter()
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["taken"] <= 3 * r["size"]
        total[r["source"]] += r["taken"]
    assert all(abs(total[s] - want[s]) <= 0.5 + 1e-6 for s in want)


def test_shards_are_written_in_order(spark, tmp_path):
    docs = _docs(spark, [" ".join(f"d{i}w{k}" for k in range(50)) for i in range(20)], list("ab") * 10)
    mixing.write_shards(docs, str(tmp_path / "out"), block_words=8, shard_slots=4)
    out = spark.read.parquet(str(tmp_path / "out"))
    own = mixing.mixed_documents(docs, shard="shard", block_words=8, shard_slots=4)
    assert rows_of(out, "doc_id", "text", "shard") == rows_of(own, "doc_id", "text", "shard")
    spans = out.withColumn("f", F.input_file_name()).groupBy("f").agg(F.min("shard").alias("a"), F.max("shard").alias("b")).orderBy("a").collect()
    assert all(x["b"] < y["a"] for x, y in zip(spans, spans[1:])) and spans[-1]["b"] > 3


def test_permutations_are_bijections(spark):
    rows = spark.createDataFrame([(n, x) for n in (1, 2, 3, 17, 64) for x in range(n)], "n long, x long")
    p = mixing.permuted(F.col("x"), F.col("n"), F.lit(3))
    back = mixing.permuted(F.col("p"), F.col("n"), F.lit(3), inverse=True)
    got = rows.withColumn("p", p).withColumn("b", back).collect()
    assert all(r["b"] == r["x"] for r in got)
    assert all(sorted(r["p"] for r in got if r["n"] == n) == list(range(n)) for n in (1, 2, 3, 17, 64))


def test_mixed_documents_hold_what_was_taken(spark, hard):
    texts = [" ".join(f"d{i}w{k}" for k in range(n)) for i, n in enumerate([0, 3, 40, 100, 7, 64])]
    docs = _docs(spark, texts, ["a", "a", "b", "b", "c", None])
    at, _, cuts = mixing.mix(docs, block_words=16)
    want = {r["doc_id"]: r["taken"] for r in mixing.taken(at, cuts).collect()}
    got = Counter()
    for r in mixing.mixed_documents(docs, block_words=16).collect():
        words = r["text"].split()
        assert words == [w for w in texts[r["doc_id"]].split() if w in set(words)]  # in order, each once
        got[r["doc_id"]] += len(words)
    assert all(got[d] == n for d, n in want.items())
    out = mixing.mixed_documents(hard)
    assert out.columns == hard.columns
    assert {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in hard.collect()}


def test_mixing_on_hard_rows(spark, hard, none):
    at, _, cuts = mixing.mix(hard)
    got = mixing.taken(at, cuts).collect()
    assert len(got) == hard.count() and all(r["taken"] <= 3 * r["size"] for r in got)
    assert all(r["size"] == 0 and r["taken"] == 0 for r in got if r["doc_id"] in (4, 5, 6))
    at, _, cuts = mixing.mix(none)
    assert mixing.taken(at, cuts).count() == 0 and mixing.mixed_documents(none).count() == 0


# ---- line dedup


def _brute_lines(rows, min_docs):
    space = " \t\n\x0b\f\r"
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(space))
    found: dict = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if key(x):
                found.setdefault(key(x), set()).add(d)
    often = {k for k, v in found.items() if len(v) >= min_docs}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in often]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches, fanout", [(1, 2), (4, 2), (5, 3)])
def test_line_dedup(spark, hard, none, batches, fanout):
    rng = random.Random(batches)
    pool = ["", " ", "Same\t", " same", "SAME", "É", "é", "x", "longer line", "longer  line"]
    docs = _docs(spark, ["\n".join(rng.choices(pool, k=rng.randint(0, 5))) for _ in range(60)])
    got = rows_of(line_dedup.dedup_lines(docs, min_docs=12, batches=batches, fanout=fanout), "doc_id", "kept", "n_lines", "n_dropped")
    assert got == _brute_lines([(r["doc_id"], r["text"]) for r in docs.collect()], 12)
    wide = hard.drop("kept", "batch")
    got = rows_of(line_dedup.dedup_lines(wide, min_docs=2, batches=batches, fanout=fanout), "doc_id", "kept", "n_lines", "n_dropped")
    assert got == _brute_lines([(r["doc_id"], r["text"]) for r in hard.collect()], 2)
    assert line_dedup.dedup_lines(none).count() == 0


def test_runs_are_compacted_by_level(spark):
    runs = line_dedup.LineRuns(spark, line_dedup.scratch(spark, "t"), min_docs=3, fanout=2)
    for i in range(5):
        runs.add(spark.createDataFrame([(1, 1), (2, i)], "h1 long, h2 long"))
    assert runs.levels == [1, 0, 1]
    assert {(r["h1"], r["h2"]) for r in runs.frequent().collect()} == {(1, 1)}
    plan = runs.counts()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan  # runs are merged where they lie
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(runs.name)]


def test_line_dedup_of_a_long_document_is_linear(spark):
    text = "\n".join("again" if i % 3 == 0 else f"line {i % 5000}" for i in range(60_000))
    docs = spark.createDataFrame([(i, text if i == 0 else "again\nother") for i in range(3)] + [(0, "again\nelse")], "doc_id long, text string")
    got = rows_of(line_dedup.dedup_lines(docs, min_docs=2), "doc_id", "kept", "n_lines", "n_dropped")
    assert got == _brute_lines([(r["doc_id"], r["text"]) for r in docs.collect()], 2)


def test_line_dedup_sql(spark, sf):
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    got = line_dedup.op10_line_dedup(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = duck.sql(line_dedup.OP10_SQL).df().sort_values("doc_id").reset_index(drop=True)
    assert (got == want[got.columns]).all().all()
    first = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").first()["text"]
    assert got.kept_sha256[0] == hashlib.sha256(first.encode()).hexdigest() or got.n_dropped[0]


# ---- near-dedup


def _brute_components(rows, k=5):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = frozenset(zip(*[w[i:] for i in range(k)])) if len(w) >= k else frozenset([tuple(w)] if w else [])
    label = {d: d for d in sets}
    ids = sorted(sets)
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(ids):
            for b in ids[:i]:
                if sets[a] and sets[b] and label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {d: (len(sets[d]), label[d]) for d in ids}


def _family(rng, n, words, edits):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_near_dedup_against_brute_force(spark, seed, monkeypatch):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(40)]
    texts = _family(rng, 25, 120, 12) + _family(rng, 25, 60, 5) + _family(rng, 10, 9, 1)
    texts += [" ".join(passage + [f"q{rng.randrange(10**6)}" for _ in range(30)]) for _ in range(20)]
    texts += texts[:6] + [texts[0].upper(), None, "", " ", "a", "A", "a b", "a b c d", "a b c d"]
    rng.shuffle(texts)
    if seed:  # small parts and star contractions give the same
        monkeypatch.setattr(near_dedup, "PART", 4)
        monkeypatch.setattr(near_dedup, "ONE_TASK_EDGES", 0)
        monkeypatch.setattr(near_dedup, "SHARED_KEYS", 200 if seed == 2 else 8)
        near_dedup.components.__defaults__ = (0,)
    try:
        docs = _docs(spark, texts)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs, shingle=4 + seed % 2).collect()}
    finally:
        near_dedup.components.__defaults__ = (50_000,)
    want = _brute_components(list(enumerate(texts)), 4 + seed % 2)
    assert got == {d: (n, c, c == d) for d, (n, c) in want.items()}


def test_contractions_equal_brute_force(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(30)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    frame = spark.createDataFrame(edges, "a long, b long")
    want = {k: v for k, v in label.items() if k != v}
    for limit in (0, 1000):
        assert {r["node"]: r["label"] for r in near_dedup.components(frame, limit).collect()} == want


def test_overlaps():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 9000, 3000).astype(np.uint64)) for _ in range(5)] + [np.zeros(0, np.uint64)]
    got = near_dedup.overlaps(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(6) for j in range(6) if i != j)


def test_pigeonhole_holds():
    """Signatures at a distance of REACH or less always share a key."""
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, (300, near_dedup.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for i in range(300):
        spots = rng.choice(near_dedup.SYMBOLS, near_dedup.REACH, replace=False)
        b[i, spots] ^= 1
    ka, kb = near_dedup.chunk_keys(a), near_dedup.chunk_keys(b)
    assert (ka == kb).any(axis=1).all()
    assert not (near_dedup.chunk_keys(a[:1]) == near_dedup.chunk_keys(a[1:2])).any()


def test_near_dedup_on_hard_rows(spark, hard, none):
    rows = [(r["doc_id"], r["text"]) for r in hard.collect() if r["doc_id"] is not None]
    want = _brute_components(rows)
    got = near_dedup.near_duplicates(hard).collect()
    assert len(got) == hard.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
    assert near_dedup.near_duplicates(none).count() == 0
    kept = [r["doc_id"] for r in near_dedup.deduplicated(hard).collect()]
    assert sorted(k for k in kept if k is not None) == sorted(d for d, (_, c) in want.items() if c == d) and kept.count(None) == 2


def test_near_dedup_tells_texts_of_one_id_and_colliding_words_apart(spark):
    rng = random.Random(7)
    a, b = ([f"{x}{rng.randrange(10**6)}" for _ in range(60)] for x in "ab")
    one, two = _twins()
    rows = [(1, a), (1, b), (2, [*b, "z"]), (3, [*a, "z"]), (5, ["c", *a]), (5, b), (7, [one]), (8, [two]), (9, [one])]
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs).collect())
    assert got == Counter([(1, 56, 1), (1, 56, 1), (2, 57, 1), (3, 57, 1), (5, 57, 1), (5, 56, 1), (7, 1, 7), (8, 1, 8), (9, 1, 7)])
    kept = near_dedup.deduplicated(docs.union(docs.filter("doc_id in (1, 8)")))
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter({(1, " ".join(a)): 1, (1, " ".join(b)): 1, (7, one): 1, (8, two): 1})


def test_near_dedup_with_ids_of_several_texts_against_brute_force(spark):
    rng = random.Random(11)
    texts = _family(rng, 30, 40, 5) + _family(rng, 20, 25, 3)
    rows = [(rng.randrange(25), t) for t in texts]
    want = _brute_components(list(enumerate(texts)), 5)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        least[want[i][1]] = min(d, least.get(want[i][1], d))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter((d, want[i][0], least[want[i][1]]) for i, (d, _) in enumerate(rows))


# ---- exact top-k


def _brute_top(rows, k, every):
    out = []
    for qid, q in rows:
        if qid % every == 0:
            scores = sorted(((-sum(a * b for a, b in zip(q, v)), i) for i, v in rows if i != qid and len(v) == len(q)))[:k]
            out += [(qid, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("seed, scale, n", [(0, 0.3, 130), (1, 0.02, 90), (2, 300.0, 40), (3, 0.3, 5)])
def test_top_k_against_brute_force(spark, seed, scale, n, monkeypatch):
    monkeypatch.setattr(bitslice_topk, "BLOCK_ROWS", 50)
    monkeypatch.setattr(bitslice_topk, "CHUNK_QUERIES", 3)
    rng = np.random.default_rng(seed)
    vectors = [(i, [float(x) for x in rng.normal(0, scale, 7 if i % 9 else 3)]) for i in range(n)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = bitslice_topk.top_k(frame, F.col("vec_id") % 4 == 0, k=6).collect()
    ints = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in vectors]
    assert sorted(map(tuple, got)) == _brute_top(ints, 6, 4)


def test_top_k_on_hard_rows(spark):
    rows = [(0, [1.0, 2.0], "x"), (20, [1.0, 2.0], "x"), (20, [1.0, 2.0], "x"), (1, None, "x"), (2, [None, 1.0], "x"), (3, [float("nan"), 1.0], "x"), (4, [float("inf"), 1.0], "x"), (5, [], "x"), (None, [1.0, 1.0], "x"), (7, [1.0], "x"), (8, [-1.0, 0.5], "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = sorted(map(tuple, bitslice_topk.top_k(frame, F.col("vec_id") % 20 == 0).collect()))
    assert got == sorted([(0, 1, 20, 20480), (0, 2, 20, 20480), (0, 3, 8, 0), (20, 1, 0, 20480), (20, 2, 8, 0)])
    assert bitslice_topk.top_k(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_of_repeated_ids_equals_its_sql(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.normal(0, 1, 4)]) for i in rng.integers(0, 60, 200)] + [(0, [9.0] * 4)] * 30
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(map(tuple, bitslice_topk.op7_exact_top_k(spark, str(tmp_path)).collect())) == sorted(duck.sql(bitslice_topk.OP7_SQL).fetchall())


@pytest.mark.parametrize("huge", [2e6, 3e9, 1e30, -5e37])
def test_top_k_of_large_components(spark, huge, monkeypatch):
    monkeypatch.setattr(bitslice_topk, "BLOCK_ROWS", 20)
    rng = np.random.default_rng(5)
    vectors = [(i, [float(np.float32(x)) for x in rng.normal(0, abs(huge) if i % 7 == 0 else 1, 3)]) for i in range(60)] + [(61, [float(np.float32(huge)), 1.0, -1.0])]
    got = bitslice_topk.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"), F.col("vec_id") % 4 == 0, k=9).collect()
    ints = [(i, [int(x * 64 // 1) for x in v]) for i, v in vectors]
    most = (1 << 63) - 1
    assert sorted(map(tuple, got)) == [(a, b, c, max(-most, min(most, s))) for a, b, c, s in _brute_top(ints, 9, 4)]


def test_bit_sliced_sums():
    rng = np.random.default_rng(3)
    x, q = rng.integers(-9, 9, (70, 5)), rng.integers(-40, 40, (6, 5))
    lows, bits, maps = bitslice_topk.slices(x)
    found = bitslice_topk.best(np.arange(100, 106), q, np.arange(70), lows, bits, maps, 70)
    scores = q @ x.T
    assert len(found[0]) == 6 * 70 and all(scores[a - 100, b] == s for a, b, s in zip(*found))


# ---- licenses


def test_licenses_and_inheritance(spark):
    files = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c/x.py", "import os"), (3, "a/b/y.py", "code\nLicensed under CC BY-NC 4.0."),
        (4, "d/z.py", "code"), (5, "a/b/LICENSE", "This work is licensed under the GNU General Public License, version 3."), (6, "ab/q.py", "code"),
        (7, "a", "top"), (8, None, "code"), (9, "a/b/c/n", None), (10, "e/f", "I lost my driving license in a car."),
    ]
    got = {r["id"]: (r["license"], r["origin"], r["from_dir"]) for r in license_scan.scan(spark.createDataFrame(files, "id long, path string, text string")).collect()}
    assert got[1] == ("MIT", "file", None) and got[3] == ("CC-BY-NC-4.0", "file", None)
    assert got[2] == ("GPL-3.0", "inherited", "a/b") and got[9] == ("GPL-3.0", "inherited", "a/b")
    assert all(got[i] == (None, "none", None) for i in (4, 6, 8, 10)) and got[7][1] in ("none", "inherited")


def test_licenses_of_headers_and_full_texts(spark):
    full = license_scan.full_texts()
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */\n\nint main() { return 0; }\n"
    asl = "\n".join("# " + x for x in license_scan.HEADERS["Apache-2.0"].replace("; ", ";\n").split("\n")) + "\nimport os\n" * 50
    mit = full["MIT"].replace(full["MIT"].split("\n")[2], "Copyright (c) 2031 Some Body and Others")
    prose = "Here is how to build it.\n\n" * 30
    files = [(i, f"all/{n}/LICENSE", t) for i, (n, t) in enumerate(full.items())] + [(i + 100, f"all/{n}/src/x.py", "pass") for i, n in enumerate(full)] + [
        (50, "m/x.c", mpl), (51, "m/y.c", "code"), (52, "a/x.py", asl), (53, "o/any.txt", mit), (54, "o/p/q.py", "code"), (55, "r/README", prose + mit + "\n\n" + prose),
        (56, "r/z.py", "code"), (57, "k/COPYING", mpl.split("\n\n")[0] + "\n\n" + prose), (58, "k/z.py", "code"), (59, "n/x.c", "/*\n" + "\n".join(" * " + x for x in full["BSD-2-Clause"].split("\n")) + "\n */\ncode();" * 9),
        (60, "q/x.py", "".join(f"# {x}\n" for x in full["MIT"].split("\n")) + "print(1)\n"), (61, "q/y.py", "code"),
    ]
    got = {r["id"]: (r["license"], r["origin"]) for r in license_scan.scan(spark.createDataFrame(files, "id long, path string, text string")).collect()}
    assert len(full) == 9
    for i, n in enumerate(full):
        assert got[i] == (n, "file") and got[i + 100] == (n, "inherited")
    want = {50: ("MPL-2.0", "file"), 51: (None, "none"), 52: ("Apache-2.0", "file"), 53: ("MIT", "file"), 54: ("MIT", "inherited"), 55: ("MIT", "file"), 56: (None, "none"), 57: ("MPL-2.0", "file"), 58: ("MPL-2.0", "inherited"), 59: ("BSD-2-Clause", "file"), 60: ("MIT", "file"), 61: (None, "none")}
    assert {k: got[k] for k in want} == want


def test_licenses_on_hard_rows(spark, hard, none, sf):
    def files(d):
        return d.select(F.col("doc_id").alias("id"), license_scan.document_path(F.col("source"), F.col("doc_id")).alias("path"), "text")

    assert license_scan.scan(files(hard)).count() == hard.count()
    assert license_scan.scan(files(none)).count() == 0
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    got = license_scan.op8_license_scan(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = duck.sql(license_scan.OP8_SQL).df().sort_values("doc_id").reset_index(drop=True)[got.columns]
    assert got.fillna("-").astype(str).equals(want.fillna("-").astype(str))


def test_blocks_cover_all_rows():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["ab", None, "", "c" * 30, "d"])], ["t"]).slice(1)
    parts = [(lo, bytes(d), e.tolist()) for lo, d, e in blocks(batch, 0, 10)]
    assert sum(len(e) for _, _, e in parts) == 4 and b"".join(d for _, d, _ in parts) == b"c" * 30 + b"d"
