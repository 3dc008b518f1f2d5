"""MinHash near-dedup by a multi-index Hamming join.

Each text gets SYMBOLS b-bit minwise symbols (b = 16). Two signatures' distance is the
number of symbols that differ. The signature is split into CHUNKS chunks; by the
pigeonhole principle, signatures at a distance of at most REACH share a chunk with at
most one wrong symbol, and every chunk is indexed under all its keys with one symbol
left out, so all such pairs meet under a key. At similarity 0.8, one pair in 10^8
meets under no key.

Copies (equal shingle sets) are one class first. Keys that several classes share are
buckets. A bucket never yields its pairs: first every member is compared with the
bucket's smallest member; what the confirmed links connect is one component. Buckets
that hold several components are then compared in full by their signatures, in cells
of bounded size, and return a spanning forest of what is close. The trees are families;
a family's shingle sets meet once, again in cells of bounded size, and return a
spanning forest of the confirmed links. So what is returned stays in proportion to
documents while no link between different texts is lost; a family of F classes is
copied to F / PART cells a class and compared in full.
Components of many edges come from star contractions (Kiveris et al., 2014) on
stored tables.

A shingle is 64 bits chained from its words' hashes, of which those of up to 7 bytes
never collide and others are BLAKE2b; words are told apart by their bytes.

Defined results: a null or empty text, or one without words, has no shingles and
is linked with nothing; a row whose doc_id is null too (component_id null, kept true);
repeated rows are copies; rows that share a doc_id but not a text are documents of
their own, each linked as its text says; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import lean, materialize, table
from .words import LOWER, blocks, grouped, mixed, spans, strong_hashes

#: Words of a shingle: the default, and the most there can be.
SHINGLE, LONGEST = 5, 16
SIMILARITY = (80, 100)
CHUNKS, PER_CHUNK = 14, 5
SYMBOLS = CHUNKS * PER_CHUNK
REACH = 2 * CHUNKS - 1
#: Candidates at a larger signature distance aren't compared in full: at similarity
#: 0.8 one pair in 10^8 lies beyond it.
SCREEN = 35
#: Leaders with which a class is compared before components are first formed, and keys
#: it shares with them at least (28 on average at similarity 0.8). What this leaves
#: apart is compared later, so it decides no link.
LEADERS, SHARED_KEYS = 2, 8
#: Up to so many edges, components are found in one task; beyond, by star contractions.
ONE_TASK_EDGES = 50_000
#: Members of a bucket or family, and shingles of a family, that one part of it holds at
#: most on average; larger ones are compared part by part. Pairs compared at a time.
PART, LOAD, PAIRS = 1024, 1_000_000, 1 << 16

_U = np.uint64
_rng = np.random.default_rng(90)
_STEP = _U(int(_rng.integers(1, 1 << 62)) * 2 + 1)
_SHORT = _rng.integers(1, 1 << 63, LONGEST, dtype=np.uint64)
_XOR = _rng.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64)
_MUL = _rng.integers(1, 1 << 62, SYMBOLS, dtype=np.uint64) * _U(2) + _U(1)


def shingle_sets(data: np.ndarray, ends: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Of texts laid one after the other in ``data`` (UTF-8 bytes; text i ends at
    ``ends[i]``): all their sorted distinct shingle hashes, and where each text's end."""
    docs = len(ends)
    starts_at = np.r_[0, ends[:-1]]
    data = LOWER[data]
    s, e = spans(data, ends)
    first, group, key = grouped(data, s, e)
    word = strong_hashes(data, s[first], e[first], key)[group]

    at = np.searchsorted(s, starts_at)  # each text's first word
    upto = np.r_[at[1:], len(s)]
    n_words = upto - at
    m = len(word)
    g = word.copy()
    for k in range(1, shingle):
        if m > k:
            g[: m - k] = mixed(g[: m - k] * _STEP + word[k:])
    doc = np.repeat(np.arange(docs), n_words)
    keep = np.arange(m) + shingle <= upto[doc]
    for i in np.flatnonzero((n_words > 0) & (n_words < shingle)):  # too short: the whole sequence is one
        own = _SHORT[n_words[i] : n_words[i] + 1]
        for w in word[at[i] : upto[i]]:
            own = mixed(own * _STEP + w)
        g[at[i]] = own[0]
        keep[at[i]] = True
    g, doc = g[keep], doc[keep]
    bounds = np.searchsorted(doc, np.arange(docs + 1))
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        g[lo:hi].sort()
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    g, doc = g[new], doc[new]
    return g, np.searchsorted(doc, np.arange(docs), "right")


def minwise(g: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(texts, SYMBOLS) symbols; texts without shingles have zeros."""
    starts = np.r_[0, ends[:-1]]
    full = ends > starts
    out = np.zeros((len(ends), SYMBOLS), np.uint16)
    if full.any():
        at = starts[full]
        for k in range(SYMBOLS):
            least = np.minimum.reduceat((g ^ _XOR[k]) * _MUL[k], at)
            out[full, k] = mixed(least).astype(np.uint16)
    return out


def chunk_keys(signs: np.ndarray) -> np.ndarray:
    """(texts, CHUNKS * PER_CHUNK) keys: each chunk with each one symbol left out."""
    part = signs.reshape(len(signs), CHUNKS, PER_CHUNK).astype(np.uint64)
    keys = np.empty((len(signs), CHUNKS, PER_CHUNK), np.uint64)
    for gap in range(PER_CHUNK):
        others = [i for i in range(PER_CHUNK) if i != gap]
        exact = part[:, :, others[0]]
        for i in others[1:]:
            exact = (exact << _U(16)) | part[:, :, i]
        keys[:, :, gap] = mixed(exact ^ mixed(np.arange(CHUNKS, dtype=np.uint64) * _U(PER_CHUNK) + _U(gap + 1))[None, :])
    return keys.reshape(len(signs), -1)


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_a, set_b (128 bits of the set's hash; null
    without shingles) and signature of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, data, ends in blocks(b, 1):
                g, upto = shingle_sets(data, ends, shingle)
                n = np.diff(np.r_[0, upto])
                signs = minwise(g, upto)
                sums = []
                for salt in (_XOR[0], _XOR[1]):  # sums of two mixes of all shingles
                    total = np.r_[_U(0), np.cumsum(mixed(g ^ salt), dtype=np.uint64)]
                    sums.append(mixed(total[upto] - total[np.r_[0, upto[:-1]]] + n.astype(np.uint64)).view(np.int64))
                none = n == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, len(ends)), b.column(2).slice(lo, len(ends)), pa.array(n), pa.array(sums[0], mask=none), pa.array(sums[1], mask=none),
                        pa.array([None if x else s.tobytes() for x, s in zip(none, signs)], pa.binary()),
                    ],
                    ["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "signature"],
                )

    schema = "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, signature binary"
    return docs.select(F.col("doc_id").cast("long"), "text", _text_hash()).mapInArrow(lean(run), schema)


def _text_hash() -> Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64("text").alias("text_hash")


def _keys(classes: DataFrame) -> DataFrame:
    """(key, rep): the index of all chunk keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                signs = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
                keys = chunk_keys(signs)
                reps = np.repeat(part.column(0).to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(reps)], ["key", "rep"])

    return classes.select("rep", "signature").mapInArrow(lean(run), "key long, rep long")


def _sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(rep, set): the sorted shingle hashes of the classes that ``wanted`` names, stored."""
    rows = classes.select("rep", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h")).join(wanted.distinct(), "rep", "left_semi")
    rows = materialize(rows, "near-wanted")
    ids = materialize(rows.select("_id").distinct(), "near-ids")  # few enough to be broadcast: then other texts aren't shuffled
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), _text_hash().alias("_h"), "text").join(ids, "_id", "left_semi")
    texts = texts.join(rows, ["_id", "_h"]).select("rep", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, data, ends in blocks(b, 1):
                g, upto = shingle_sets(data, ends, shingle)
                each = [g[s:e].tobytes() for s, e in zip(np.r_[0, upto[:-1]], upto)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(ends)), pa.array(each, pa.binary())], ["rep", "set"])

    return materialize(texts.mapInArrow(lean(run), "rep long, set binary").dropDuplicates(["rep"]), "near-sets")


def alike(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough."""
    num, den = SIMILARITY
    if len(p) > len(q):
        p, q = q, p
    if not len(p) or den * len(p) < num * len(q):
        return False
    both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
    return den * both >= num * (len(p) + len(q) - both)


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough. ``pairs`` is stored."""
    found = _sets(pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))), classes, docs, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    one = found.select(F.col("rep").alias("a"), F.col("set").alias("sa"))
    two = found.select(F.col("rep").alias("b"), F.col("set").alias("sb"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(lean(run), "a long, b long")


def _parts(n: Column) -> Column:
    return F.ceil(n / PART).cast("int")


def _celled(rows: DataFrame, group: str) -> DataFrame:
    """``rows`` with a column ``parts`` dealt to the cells (lo, hi) of their group: a group
    of one part is one cell; of more, every two parts meet in a cell and no cell holds
    more than two. Sorted by cell within partitions."""
    i = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    dealt = rows.withColumn("part", i).withColumn("j", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))))
    dealt = dealt.withColumn("lo", F.least("part", "j")).withColumn("hi", F.greatest("part", "j")).drop("j", "parts")
    return dealt.repartition(group, "lo", "hi").sortWithinPartitions(group, "lo", "hi", "rep")


def _whole_cells(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole cells, with the row bounds of each. The first columns are the key."""
    held: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        keys = np.stack([held.column(i).to_numpy() for i in range(n_keys)], 1)
        new = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        if len(new):
            yield held.slice(0, int(new[-1])), np.r_[0, new]
            held = held.slice(int(new[-1]))
    if held is not None and held.num_rows:
        keys = np.stack([held.column(i).to_numpy() for i in range(n_keys)], 1)
        yield held, np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, held.num_rows]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (smallest node of a tree, node) that connect what the edges (a, b) do."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while True:
        least = np.minimum(low[x], low[y])
        new = low.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        new = new[new]
        if (new == low).all():
            break
        low = new
    moved = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[low[moved]], nodes[moved]


def _close_pairs(bounds: np.ndarray, label: np.ndarray, signs: np.ndarray, part: np.ndarray, apart: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (x, y) of the same cell with different labels and signatures that are close.
    apart: cells of two parts, within which only rows of different parts are compared."""
    ends = np.repeat(bounds[1:], np.diff(bounds))
    mixed_parts = np.repeat(apart, np.diff(bounds))
    n = len(label)
    partners = ends - np.arange(n) - 1
    upto = np.cumsum(partners)
    lo = 0
    while lo < n:
        done = upto[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, done + PAIRS, "right")))
        x = np.repeat(np.arange(lo, hi), partners[lo:hi])
        y = x + 1 + np.arange(len(x)) - np.repeat(upto[lo:hi] - partners[lo:hi] - done, partners[lo:hi])
        ok = (label[x] != label[y]) & ~(mixed_parts[x] & (part[x] == part[y]))
        x, y = x[ok], y[ok]
        for at in range(0, len(x), PAIRS):
            p, q = x[at : at + PAIRS], y[at : at + PAIRS]
            near = (signs[p] != signs[q]).sum(axis=1) <= SCREEN
            if near.any():
                yield p[near], q[near]
        lo = hi


def _signs(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def _candidate_trees(split: DataFrame) -> DataFrame:
    """(a, b): edges that connect the labels which close signatures of a bucket connect.
    ``split``: key, rep, label, n (members of the bucket), signature."""
    cells = _celled(split.withColumn("parts", _parts(F.col("n"))), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in _whole_cells(batches, 3):
            label, part, signs = t.column("label").to_numpy(), t.column("part").to_numpy(), _signs(t.column("signature"))
            apart = t.column("lo").to_numpy()[bounds[:-1]] != t.column("hi").to_numpy()[bounds[:-1]]
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for x, y in _close_pairs(bounds, label, signs, part, apart):
                both = np.unique(np.stack([label[x], label[y]], 1), axis=0)
                a.append(both[:, 0])
                b.append(both[:, 1])
            edges = _forest(np.concatenate(a), np.concatenate(b))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in edges], ["a", "b"])

    return cells.select("key", "lo", "hi", "label", "part", "signature").mapInArrow(lean(run), "a long, b long").distinct()


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """(n, n) sizes of the sets' intersections, by bitmaps over their common members."""
    n, out = len(sets), np.zeros((len(sets), len(sets)), np.int32)
    member = np.concatenate(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    _, at, count = np.unique(member, return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    keep = count[at] > 1
    at, row = shared[at[keep]], row[keep]
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):
        s, e = np.searchsorted(at, (lo, lo + 4096))
        flags = np.zeros((n, 4096), np.uint8)
        flags[row[s:e], at[s:e] - lo] = 1
        bits = np.packbits(flags, axis=1).view(np.uint64)
        some = np.flatnonzero(bits.any(axis=1))
        own = bits[some]
        for i, r in enumerate(some):
            out[r, some] += np.bitwise_count(own & own[i]).sum(axis=1, dtype=np.int32)
    return out


def _linked_trees(families: DataFrame) -> DataFrame:
    """(a, b): edges that connect the labels which confirmed links of a family connect.
    ``families``: family, rep, label, parts, signature, set."""
    cells = _celled(families, "family")
    num, den = SIMILARITY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in _whole_cells(batches, 3):
            label, part, signs = t.column("label").to_numpy(), t.column("part").to_numpy(), _signs(t.column("signature"))
            apart = t.column("lo").to_numpy()[bounds[:-1]] != t.column("hi").to_numpy()[bounds[:-1]]
            sets = [np.frombuffer(s, np.uint64) for s in t.column("set").to_pylist()]
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for g, (s, e) in enumerate(zip(bounds[:-1], bounds[1:])):
                pairs = list(_close_pairs(np.array([0, e - s]), label[s:e], signs[s:e], part[s:e], apart[g : g + 1]))
                if not pairs:
                    continue
                x, y = (np.concatenate(v) + s for v in zip(*pairs))
                if len(x) > 4 * (e - s):
                    both = overlaps(sets[s:e])[x - s, y - s].astype(np.int64)
                    size = np.array([len(v) for v in sets[s:e]], np.int64)
                    ok = (both > 0) & (den * both >= num * (size[x - s] + size[y - s] - both))
                else:
                    ok = np.array([alike(sets[i], sets[j]) for i, j in zip(x, y)], bool)
                a.append(label[x[ok]])
                b.append(label[y[ok]])
            edges = _forest(np.concatenate(a), np.concatenate(b))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in edges], ["a", "b"])

    return cells.select("family", "lo", "hi", "label", "part", "signature", "set").mapInArrow(lean(run), "a long, b long").distinct()


def components(edges: DataFrame, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, label): the smallest node that each node with an edge reaches, where that
    is another one. ``edges`` (a, b).

    Few edges are joined in one task, more by large-star and small-star steps in turn
    until nothing changes.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "near-edges")
    if edges.count() <= one_task:
        return _joined(edges)
    return contracted(edges)


def _joined(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if both:
            label, node = _forest(*(np.concatenate(x) for x in zip(*both)))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(label)], ["node", "label"])

    return edges.coalesce(1).mapInArrow(lean(run), "node long, label long")


def contracted(edges: DataFrame) -> DataFrame:
    """``components`` of distinct edges (u, v) with u > v by star contractions."""
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("_u")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), "m")
        small = large.join(low, F.col("u") == F.col("_u"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low.select(F.col("_u").alias("u"), F.col("m").alias("v"))).distinct()
        edges = materialize(small, "near-edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    return edges.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    named = labels.select(F.col("node").alias("rep"), "label")
    return rows.join(named, "rep", "left").withColumn("label", F.coalesce("label", "rep"))


def _resolved(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, component (a number; null if linked with nothing
    by definition) and component_id of every row of ``docs`` (doc_id, text).

    ``rep`` numbers the classes: ids would mix up the texts of one doc_id."""
    signed = materialize(signatures(docs, shingle), "near-signed")
    linked = signed.filter("n_shingles > 0 and doc_id is not null")
    first = F.min(F.struct("doc_id", "text_hash")).alias("row")
    classes = linked.groupBy("set_a", "set_b").agg(first, F.first("signature").alias("signature"), F.max("n_shingles").alias("n_shingles"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("rep"), "set_a", "set_b", "row.*", "signature", "n_shingles"), "near-classes")
    signs = classes.select("rep", "signature")

    index = _keys(classes)
    shared = index.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("top")).filter("leader <> top").select("key", "leader")
    # stored first: of two plain shuffles Spark can split a key that very many share
    buckets = materialize(index.join(materialize(shared, "near-shared"), "key"), "near-buckets")

    stars = buckets.filter("rep <> leader").groupBy("leader", "rep").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SHARED_KEYS)
    best = stars.groupBy("rep").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "leader"))), 1, LEADERS).alias("l"))
    pairs = materialize(best.select(F.explode("l.leader").alias("a"), F.col("rep").alias("b")), "near-first")
    links = materialize(_confirmed(pairs, classes, docs, shingle), "near-links")
    labels = materialize(components(links), "near-labels")

    marked = materialize(_labelled(buckets.select("key", "rep"), labels), "near-marked")
    counts = marked.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.count(F.lit(1)).alias("n")).filter("l <> h")
    split = marked.join(materialize(counts.select("key", "n"), "near-split"), "key").join(signs, "rep")
    trees = materialize(_candidate_trees(split), "near-trees")
    if trees.isEmpty():
        final = labels
    else:
        family = components(trees).select(F.col("node").alias("label"), F.col("label").alias("family"))
        ids = trees.select(F.col("a").alias("label")).union(trees.select(F.col("b").alias("label"))).distinct()
        family = ids.join(family, "label", "left").withColumn("family", F.coalesce("family", "label"))
        sized = classes.select("rep", F.col("n_shingles").alias("size"))
        members = materialize(_labelled(sized, labels).join(family, "label"), "near-members")
        load = members.groupBy("family").agg(F.greatest(F.ceil(F.sum("size") / LOAD).cast("int"), _parts(F.count(F.lit(1)))).alias("parts"))
        sets = _sets(members.select("rep"), classes, docs, shingle)
        more = _linked_trees(members.join(load, "family").join(signs, "rep").join(sets, "rep"))
        final = materialize(components(links.union(more)), "near-labels")

    named = materialize(_labelled(classes.select("rep", "set_a", "set_b", "doc_id"), final), "near-named")
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "label").select("set_a", "set_b", F.col("label").alias("component"), "component_id")
    out = signed.select("doc_id", "text_hash", "n_shingles", "set_a", "set_b").join(named, ["set_a", "set_b"], "left")
    alone = F.col("doc_id").isNull()
    return out.select(
        "doc_id", "text_hash", "n_shingles", F.when(~alone, F.col("component")).alias("component"),
        F.when(~alone, F.coalesce("component_id", "doc_id")).alias("component_id"),
    )


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text)."""
    found = _resolved(docs, shingle).select("doc_id", "n_shingles", "component_id")
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each group: of the rows with its smallest doc_id the one
    whose text has the smallest hash, once also where it repeats. Rows without a doc_id
    or words stay."""
    found = materialize(_resolved(docs, shingle), "near-found")
    rows = found.filter("component is not null").groupBy("component", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    rows = materialize(rows, "near-rows")
    stays = rows.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("r")).select("r.*")
    gone = materialize(rows.join(stays, ["doc_id", "text_hash"], "left_anti").select(F.col("doc_id").alias("_near_id"), F.col("text_hash").alias("_near_hash")), "near-gone")
    own = [docs["doc_id"].cast("long") == F.col("_near_id"), F.xxhash64(docs["text"]) == F.col("_near_hash")]
    out = docs.join(gone, own, "left_anti")
    again = rows.filter("n > 1").select(F.col("doc_id").alias("_near_id"), F.col("text_hash").alias("_near_hash"))
    if again.isEmpty():
        return out
    marked = out.join(again, own, "left")
    once = marked.filter(F.col("_near_id").isNotNull()).dropDuplicates(["_near_id", "_near_hash"])
    return once.unionByName(marked.filter(F.col("_near_id").isNull())).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4)
