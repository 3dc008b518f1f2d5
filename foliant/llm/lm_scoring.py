"""LM scoring with a log-bilinear neural model trained by noise-contrastive estimation.

Every token belongs to one of a fixed number of classes: the most frequent words are
classes of their own, other words fall into classes by shape, and a text's end is one.
Classes only factorise the model: a shape class is split into groups of words, so that
class, group and word are each normalised exactly over a small set. A base model gives
the next class from the two before it (log-bilinear, from draws of the class trigram
counts), and smoothed frequencies within a class. Over it, every word of a vocabulary
that grows with the training tokens has vectors of its own, and the two words before
shift the log-probabilities of class, group and word. These vectors are trained by
noise-contrastive estimation, the base being the noise, in passes over all trigrams of
all training documents: every partition trains from the same start, and the vectors are
averaged by how often each was met. Words outside the vocabulary share their class's
vector and have their smoothed frequency within what is left of the class.

Word counts cover all training documents and stay distributed: frequent words (a
bounded list) are looked up where texts are read; only rarer words, summed per
document, are shuffled and joined with their counts, which keeps hot words out of the
shuffle.

Defined results: a null or empty text is its end alone; without training documents all
counts are 0 and the classes are equally likely; a null doc_id has the remainder of
an empty text's checksum; repeated rows are scored each; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import fit_in_task, lean, learns, materialize, table

MODULUS, LEFT_OUT = 7, 2
#: Classes only split the work of normalising: 64 of them keep a table of contexts, 64³
#: floats, in a core's cache; the words of a class are told apart by groups and vectors.
OWN_CLASSES = 39
SHAPES = 24
CLASSES = OWN_CLASSES + SHAPES + 1  # and the end
END = CLASSES - 1
#: Words that are looked up without a shuffle: the most frequent of those that make up
#: one in SPARE * FREQUENT tokens or more. Words of over WIDEST bytes are known by a
#: cryptographic hash, so that what is broadcast has a bound.
FREQUENT, SPARE, WIDEST = 30_000, 20, 64
#: The vocabulary has up to GROWTH * sqrt(N) words, FREQUENT at least, and MOST at most: what
#: is broadcast with it, some 300 bytes a word, has that bound. Counts of all words are kept.
GROWTH, MOST = 10, 1_000_000
DIMENSIONS, NOISE, STEPS, BATCH, RATE = 24, 12, 1500, 1024, 0.05
#: Words a counting task holds before it passes their counts on, and words whose class
#: a worker remembers.
HELD = 300_000
#: Word vectors: dimensions, noise words a decision, passes over all trigrams, trigrams a
#: step, rate, and what damps the rate of vectors that were met little.
WIDTH, DRAWN, PASSES, TOGETHER, WORD_RATE, DAMPING = 16, 4, 1, 8192, 0.15, 0.02
#: Bytes of ids a trainer has for each byte of its vectors; groups in which the trainers'
#: vectors are added up before they are averaged.
SHARE, SUMMED = 10, 256
#: Vectors of a row as they are averaged, tokens that are scored at a time, and scores that
#: are held at a time, so that they stay in a core's cache.
SLAB, SCORED, CELLS = 1024, 1 << 18, 1 << 16

#: Twice the class of a last byte: a mark, another ASCII sign, or anything else.
ENDINGS = bytes(0 if chr(b) in ".,;:" else 2 if b < 128 and not chr(b).isalnum() else 4 for b in range(256))


def shape(word: bytes) -> int:
    """The class, of SHAPES, of a word that has none of its own: length, last byte, and
    whether it is all ASCII."""
    n = len(word)
    return (n - 1 >> 2 if n < 13 else 3) * 6 + ENDINGS[word[-1]] + (not word.isascii())


def split(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # for bytes: A-Z, and white space 0x20, 0x09-0x0D


def narrow(words: list[bytes]) -> list[bytes]:
    """The words, those of over WIDEST bytes by their hash."""
    if words and max(map(len, words)) > WIDEST:
        words = [w if len(w) <= WIDEST else b"\xff" + hashlib.sha256(w).digest() + w[-1:] for w in words]  # no text holds 0xFF
    return words


def tokens(text: bytes | None) -> list[bytes]:
    return narrow(split(text))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all rows of ``docs``; the end token is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])

        for b in batches:
            for t in b.column(0).cast(pa.binary()):
                held.update(tokens(t.as_py()))
                held[b""] += 1
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()

    return docs.select("text").mapInArrow(lean(run), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Frequent words, most frequent first: counts by word; the first OWN_CLASSES are
    classes of their own."""

    counts: dict[bytes, int]
    total: int  # N
    distinct: int  # V
    own: dict[bytes, int] = field(default_factory=dict)

    def __post_init__(self):
        self.own = {w: i for i, w in enumerate(list(self.counts)[:OWN_CLASSES])}


def vocabulary(counts: DataFrame, frequent: int = FREQUENT) -> Vocabulary:
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    frequent = min(max(frequent, int(GROWTH * n**0.5)), MOST)
    least = n / (SPARE * frequent)  # so at most SPARE * frequent words are ordered, however many there are
    top = counts.filter((F.col("word") != F.lit(b"")) & (F.col("c") >= least)).orderBy(F.col("c").desc(), "word").limit(frequent).collect()
    return Vocabulary({bytes(r["word"]): r["c"] for r in top}, n, v)


def class_sizes(counts: DataFrame, vocab: Vocabulary) -> np.ndarray:
    """(CLASSES,) sums of c + 1 over the words of each shape class, and 1 for unknown
    words. Frequent words are added on the driver, the others where they lie."""
    shared = counts.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(CLASSES, np.int64)
        for b in batches:
            words, c = b.column(0).to_pylist(), b.column(1).to_numpy()
            k = np.array([OWN_CLASSES + shape(w) if w and w not in shared.value.own else -1 for w in words], np.int64)
            sums += np.bincount(k[k >= 0], c[k >= 0] + 1, CLASSES).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES, dtype=np.int32)), pa.array(sums)], ["k", "n"])

    rows = counts.select("word", "c").mapInArrow(lean(run), "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()  # CLASSES rows
    out = np.ones(CLASSES)
    for r in rows:
        out[r["k"]] += r["n"]
    return out


def trigrams(encoded: DataFrame, tree: "Tree") -> DataFrame:
    """code, n: counts of class trigrams over all rows of ``encoded``; END stands before a
    text too. At most CLASSES^3 rows, however many documents there are."""
    shared = encoded.sparkSession.sparkContext.broadcast(tree.cls)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(CLASSES**3, np.int64)
        for b in batches:
            for _, seq, starts, lengths in _laid(b.column(0), len(shared.value) - 1, SCORED):
                k = shared.value[seq].astype(np.int64)
                code = (k[:-2] * CLASSES + k[1:-1]) * CLASSES + k[2:]
                sums += np.bincount(code[_targets(starts, lengths) - 2], minlength=CLASSES**3)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["code", "n"])

    return encoded.select("ids").mapInArrow(lean(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def dense(codes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The counts as (CLASSES, CLASSES, CLASSES)."""
    out = np.zeros(CLASSES**3, np.int64)
    out[codes] = n
    return out.reshape(CLASSES, CLASSES, CLASSES)


def train(counts: np.ndarray, *, steps: int = STEPS, seed: int = 2) -> np.ndarray:
    """(CLASSES, CLASSES, CLASSES) natural log-probabilities of a class after two others.

    s(c | a, b) = (r[a] * w1 + r[b] * w2) . q[c] + bias[c], fitted by noise-contrastive
    estimation with the classes' frequencies as noise, then normalised exactly.
    """
    k, rng = len(counts), np.random.default_rng(seed)
    cells = np.flatnonzero(counts.ravel())
    if not len(cells):
        return np.full(counts.shape, -np.log(k), np.float32)
    weight = counts.ravel()[cells]
    cumulated = np.cumsum(weight) / weight.sum()
    noise = counts.sum(axis=(0, 1)) + 1.0
    noise /= noise.sum()
    noise_sum, log_noise = np.cumsum(noise), np.log(noise)
    r, q = rng.normal(0, 0.1, (k, DIMENSIONS)), rng.normal(0, 0.1, (k, DIMENSIONS))
    w = np.ones((2, DIMENSIONS)) * 0.5
    ws = [r, q, w, log_noise.copy()]
    first, second = [np.zeros_like(x) for x in ws], [np.zeros_like(x) for x in ws]
    eye = np.eye(k)
    for step in range(1, steps + 1):
        r, q, w, bias = ws
        code = cells[np.searchsorted(cumulated, rng.random(BATCH) * (1 - 1e-12))]
        a, b, c = code // (k * k), code // k % k, code % k
        drawn = np.minimum(np.searchsorted(noise_sum, rng.random((BATCH, NOISE))), k - 1)
        each = np.concatenate([c[:, None], drawn], 1)
        ahead = r[a] * w[0] + r[b] * w[1]
        s = np.einsum("bd,bnd->bn", ahead, q[each], optimize=True) + bias[each]
        p = 1 / (1 + np.exp(-np.clip(s - log_noise[each] - np.log(NOISE), -60, 60)))  # it is data
        d = p.copy()
        d[:, 0] -= 1
        d /= BATCH
        per = np.zeros((BATCH, k))  # the gradient by class
        np.add.at(per, (np.arange(BATCH)[:, None], each), d)
        d_ahead = per @ q
        grads = [eye[a].T @ (d_ahead * w[0]) + eye[b].T @ (d_ahead * w[1]), per.T @ ahead, np.stack([(d_ahead * r[a]).sum(0), (d_ahead * r[b]).sum(0)]), per.sum(0)]
        rate = RATE * (1 - step / (steps + 1))
        for x, g, m, v in zip(ws, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    r, q, w, bias = ws
    ahead = ((r * w[0])[:, None, :] + (r * w[1])[None, :, :]).reshape(k * k, -1)
    s = ahead @ q.T + bias
    s -= s.max(axis=1, keepdims=True)
    s -= np.log(np.exp(s).sum(axis=1, keepdims=True))
    return s.reshape(counts.shape).astype(np.float32)


def _alias(weights: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Walker's alias table of nodes ``first`` on: (share that stays, which one else)."""
    keep, other = weights / weights.sum() * len(weights), np.arange(first, first + len(weights))
    less, more = [i for i, k in enumerate(keep) if k < 1], [i for i, k in enumerate(keep) if k >= 1]
    while less and more:
        i, j = less.pop(), more[-1]
        other[i] = first + j
        keep[j] -= 1 - keep[i]
        if keep[j] < 1:
            less.append(more.pop())
    keep[less + more] = 1
    return keep, other


@dataclass
class Tree:
    """The vocabulary's words, by id: their order in the vocabulary, then what is left of
    each shape class, then the end. Nodes are a class's rest and groups (scope: the class)
    and a group's words (scope: the group); a scope's nodes lie side by side."""

    ids: dict[bytes, int]
    cls: np.ndarray  # (ids,)
    node: np.ndarray  # (2, ids): group or rest, word; -1 for none
    scope: np.ndarray  # (2, ids): the nodes' scopes
    bounds: np.ndarray  # (scopes + 1,)
    prior: np.ndarray  # (nodes,) natural log of the smoothed share within the scope
    keeps: np.ndarray  # (nodes,) and
    others: np.ndarray  # (nodes,): alias tables that draw a scope's nodes by their shares
    log_rest: np.ndarray  # (ids,) log10 of the smoothed size of a rest; 0 for others

    @classmethod
    def of(cls, vocab: Vocabulary, sizes: np.ndarray) -> "Tree":
        words = list(vocab.counts)
        c, v = np.array(list(vocab.counts.values()), np.float64) + 1, len(words)
        n, by = v + SHAPES + 1, [[] for _ in range(SHAPES)]
        for i in range(len(vocab.own), v):
            by[shape(words[i])].append(i)
        of, node, scope = np.full(n, END, np.int32), np.full((2, n), -1, np.int32), np.zeros((2, n), np.int32)
        of[: len(vocab.own)], log_rest = np.arange(len(vocab.own)), np.zeros(n)
        shares, groups = [], []
        for k, own in enumerate(by):
            own = sorted(own, key=words.__getitem__)  # words with the same beginning meet
            width = int(np.ceil(len(own) ** 0.5)) or 1
            parts = [np.array(own[i : i + width]) for i in range(0, len(own), width)]
            rest = max(sizes[OWN_CLASSES + k] - sum(c[p].sum() for p in parts), 1.0)
            at = sum(map(len, shares))
            shares.append(np.array([rest, *[c[p].sum() for p in parts]]))
            of[v + k], node[0, v + k], scope[0, v + k], log_rest[v + k] = OWN_CLASSES + k, at, k, np.log10(rest)
            for g, p in enumerate(parts):
                of[p], node[0, p], scope[0, p], scope[1, p] = OWN_CLASSES + k, at + 1 + g, k, SHAPES + len(groups)
                groups.append(p)
        shares += [c[p] for p in groups]
        bounds = np.r_[0, np.cumsum([len(x) for x in shares])]
        for g, p in enumerate(groups):
            node[1, p] = bounds[SHAPES + g] + np.arange(len(p))
        keeps, others = zip(*(_alias(x, lo) for x, lo in zip(shares, bounds.tolist())))
        prior = np.concatenate([np.log(x / x.sum()) for x in shares]).astype(np.float32)
        return cls({w: i for i, w in enumerate(words)}, of, node, scope, bounds, prior, np.concatenate(keeps), np.concatenate(others), log_rest)

    def drawn(self, scopes: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
        """(scopes, n) nodes drawn from each scope by their shares."""
        first = self.bounds[scopes][:, None]
        u = rng.random((len(scopes), n)) * (self.bounds[scopes + 1][:, None] - first)
        whole = u.astype(np.int64)
        at = first + whole
        return np.where(u - whole < self.keeps.take(at), at, self.others.take(at))

    @property
    def end(self) -> int:
        return len(self.cls) - 1


@dataclass
class Vectors:
    """before: (ids, WIDTH) of words as context, factors (2, WIDTH) of the word two and
    one before; classes (CLASSES, WIDTH) and nodes (nodes, WIDTH) as what follows."""

    before: np.ndarray
    factors: np.ndarray
    classes: np.ndarray
    nodes: np.ndarray

    @classmethod
    def start(cls, tree: Tree, seed: int = 2) -> "Vectors":
        rng = np.random.default_rng(seed)
        zeros = lambda n: np.zeros((n, WIDTH), np.float32)
        return cls(rng.normal(0, 0.5, (len(tree.cls), WIDTH)).astype(np.float32), np.ones((2, WIDTH), np.float32) * np.float32([[0.5], [1]]), zeros(CLASSES), zeros(len(tree.prior)))

    def all(self) -> list[np.ndarray]:
        return [self.before, self.factors, self.classes, self.nodes]

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.before.take(a, axis=0) * self.factors[0] + self.before.take(b, axis=0) * self.factors[1]


def _picked_log(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural log-probability of ``at`` under the scores ``z``, normalised by row."""
    picked = z[np.arange(len(z)), at]
    with np.errstate(over="ignore"):
        total = np.exp(z) @ np.ones(z.shape[1], z.dtype)
    if total.min() > 1e-30 and total.max() < 1e30:
        return picked - np.log(total)
    most = z.max(axis=1)
    return picked - most - np.log(np.exp(z - most[:, None]).sum(axis=1))


def _by_scope(node: np.ndarray, scope: np.ndarray) -> tuple[np.ndarray, list[int], list[int]]:
    """(rows, cuts, scopes): rows that have a node, by scope; cuts between the scopes."""
    rows = np.flatnonzero(node >= 0)
    key = np.sort(scope[rows].astype(np.int64) << 32 | rows)
    rows, own = key & 0xFFFFFFFF, key >> 32
    begins = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    return rows, [*begins.tolist(), len(rows)], own[begins].tolist()


def _pieces(lo: int, hi: int, width: int) -> Iterator[slice]:
    """``lo`` to ``hi`` in pieces of rows that have CELLS scores, ``width`` each."""
    size = max(CELLS // width, 1)
    return (slice(i, min(i + size, hi)) for i in range(lo, hi, size))


def log_next(tree: Tree, vectors: Vectors, log_class: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """log10 of the class, group and word of ids ``c`` after ``a`` and ``b``; of a rest it
    is that of the whole rest. log_class: the base, natural logarithms."""
    x = vectors.ahead(a, b)
    context, to = tree.cls[a] * CLASSES + tree.cls[b], tree.cls[c]
    out, base = np.empty(len(c)), log_class.reshape(CLASSES * CLASSES, CLASSES)
    for own in _pieces(0, len(c), CLASSES):
        z = x[own] @ vectors.classes.T
        z += base.take(context[own], axis=0)
        out[own] = _picked_log(z, to[own])
    for node, scope in zip(tree.node, tree.scope):
        rows, cuts, scopes = _by_scope(node[c], scope[c])
        ahead, at, added = x.take(rows, axis=0), node[c[rows]], np.zeros(len(rows), np.float32)
        for lo, hi, k in zip(cuts, cuts[1:], scopes):
            first, last = int(tree.bounds[k]), int(tree.bounds[k + 1])
            for own in _pieces(lo, hi, last - first) if last - first > 1 else ():
                z = ahead[own] @ vectors.nodes[first:last].T
                z += tree.prior[first:last]
                added[own] = _picked_log(z, at[own] - first)
        out[rows] += added
    return out / np.log(10)


class Trainer:
    """Noise-contrastive estimation with rates by row (AdaGrad)."""

    def __init__(self, tree: Tree, vectors: Vectors, log_class: np.ndarray, seed: int):
        self.tree, self.rng = tree, np.random.default_rng(seed)
        self.vectors = Vectors(*[x.copy() for x in vectors.all()])
        self.noise = (np.exp(log_class) * NOISE / 2).reshape(CLASSES * CLASSES, CLASSES)  # halves, as _twice_data doubles
        self.group_noise = np.exp(tree.prior[: tree.bounds[SHAPES]]) * np.float32(DRAWN / 2)
        self.met = [np.zeros(len(x), np.float32) for x in self.vectors.all()]
        self.squares = [np.full(len(x), DAMPING, np.float32) for x in self.vectors.all()]

    def _move(self, which: int, at: np.ndarray | slice, gradient: np.ndarray, n: np.ndarray | float) -> None:
        """Moves vectors ``at``, each given once; ``gradient`` is overwritten."""
        vectors, squares = self.vectors.all()[which], self.squares[which][at]
        squares = squares + np.einsum("nd,nd->n", gradient, gradient) / np.float32(WIDTH)
        self.squares[which][at] = squares
        gradient *= (np.float32(-WORD_RATE) / np.sqrt(squares))[:, None]
        gradient += vectors[at] if isinstance(at, slice) else vectors.take(at, axis=0)
        vectors[at] = gradient
        self.met[which][at] += n

    def _scatter(self, which: int, at: np.ndarray, gradient: Callable[[np.ndarray], np.ndarray]) -> None:
        """Moves vectors ``at`` by the sums of their rows of ``gradient`` (of given rows)."""
        key = np.sort(at.astype(np.int64) << 32 | np.arange(len(at)))
        order, at = key & 0xFFFFFFFF, key >> 32
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        n = np.diff(np.r_[first, len(at)])
        sums, many = gradient(order[first]), n > 1
        if many.any():  # only these need adding; pairs of floats are added as one complex number
            rows = gradient(order[np.repeat(many, n)]).view(np.complex64)
            sums[many] = np.add.reduceat(rows, np.cumsum(n[many]) - n[many], axis=0).view(np.float32)
        self._move(which, at[first], sums, n)

    def step(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> None:
        """Of classes, and of the groups of a class, the noise's expectation is summed over
        all of them; noise words of a group are drawn."""
        tree, v, n = self.tree, self.vectors, len(c)
        before_a, before_b = v.before.take(a, axis=0), v.before.take(b, axis=0)
        x = before_a * v.factors[0] + before_b * v.factors[1]
        context, to = tree.cls[a] * CLASSES + tree.cls[b], tree.cls[c]
        d_x, d_classes = np.empty_like(x), np.zeros_like(v.classes)
        for own in _pieces(0, n, CLASSES):
            p, at = _twice_data(x[own], v.classes, NOISE), (np.arange(own.stop - own.start), to[own])
            hit = p[at] / 2 - 1
            p *= self.noise.take(context[own], axis=0)
            p[at] += hit
            d_x[own] = p @ v.classes
            d_classes += p.T @ x[own]

        rows, cuts, scopes = _by_scope(tree.node[0][c], tree.scope[0][c])
        ahead, to, groups = x.take(rows, axis=0), tree.node[0][c[rows]], int(tree.bounds[SHAPES])
        back, d_groups, met = np.zeros_like(ahead), np.zeros((groups, WIDTH), np.float32), np.zeros(groups, np.float32)
        for lo, hi, k in zip(cuts, cuts[1:], scopes):
            first, last = int(tree.bounds[k]), int(tree.bounds[k + 1])
            met[first:last] = (hi - lo) / (last - first) if last - first > 1 else 0
            for own in _pieces(lo, hi, last - first) if last - first > 1 else ():
                nodes, at = v.nodes[first:last], (np.arange(own.stop - own.start), to[own] - first)
                p = _twice_data(ahead[own], nodes, DRAWN)
                hit = p[at] / 2 - 1
                p *= self.group_noise[first:last]
                p[at] += hit
                back[own] = p @ nodes
                d_groups[first:last] += p.T @ ahead[own]
        self._move(3, slice(0, groups), d_groups, met)
        d_x[rows] += back

        rows = np.flatnonzero(tree.node[1][c] >= 0)
        if len(rows):
            own, ahead = c[rows], x.take(rows, axis=0)
            each = np.concatenate([tree.node[1][own][:, None], tree.drawn(tree.scope[1][own], DRAWN, self.rng)], 1)
            q = v.nodes.take(each, axis=0)
            d = _is_data(np.einsum("nkd,nd->nk", q, ahead), DRAWN)
            d[:, 0] -= 1
            d_x[rows] += np.einsum("nk,nkd->nd", d, q)
            d = d.ravel()
            self._scatter(3, each.ravel(), lambda order: ahead.take(order // (DRAWN + 1), axis=0) * d[order][:, None])
        d_factors = np.stack([np.einsum("nd,nd->d", d_x, before_a), np.einsum("nd,nd->d", d_x, before_b)])
        both = np.concatenate([d_x * v.factors[0], d_x * v.factors[1]])
        self._scatter(0, np.r_[a, b], lambda order: both.take(order, axis=0))
        self._move(1, slice(None), d_factors, n)
        self._move(2, slice(None), d_classes, n)


def _is_data(scores: np.ndarray, noise: int) -> np.ndarray:
    """The probability of being data and not noise, of ratios of the two in logarithms."""
    np.clip(scores, -30, 30, out=scores)
    np.subtract(np.float32(np.log(noise)), scores, out=scores)
    np.exp(scores, out=scores)
    scores += 1
    return np.reciprocal(scores, out=scores)


def _twice_data(x: np.ndarray, following: np.ndarray, noise: int) -> np.ndarray:
    """Twice _is_data of all products of ``x`` and ``following``: 1 + tanh(s / 2) is twice the
    logistic function, in fewer passes, and takes any s."""
    p = (x * np.float32(0.5)) @ following.T
    p -= np.float32(np.log(noise) / 2)
    np.tanh(p, out=p)
    p += 1
    return p


def encoded(docs: DataFrame, tree: Tree) -> DataFrame:
    """row, the columns of ``docs`` but text, ids (int32, the end's last), and the words
    that aren't in the vocabulary (rare) with how often each occurs (times); stored, so that
    texts are split once for counting classes, training and scoring."""
    keys = [c for c in docs.columns if c != "text"]
    shared = docs.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row = shared.value, TaskContext.get().partitionId() << 33
        v, known, end = len(own.ids), own.ids, own.end
        for b in batches:
            ids, rare, times, ends = [], [], [], [0]
            for t in b.column(0).cast(pa.binary()):
                words = [*split(t.as_py()), b""]  # the end
                found = np.fromiter(map(known.get, words, repeat(-1)), np.int32, len(words))
                found[-1] = end
                unknown = np.flatnonzero(found < 0).tolist()
                if unknown:
                    wide = [words[i] for i in unknown]  # no word of the vocabulary is wide
                    others = narrow(wide)
                    few = Counter(others)
                    at = {w: v + shape(w) for w in few}
                    if others is not wide:
                        at |= {w: known[w] for w in few if w in known}
                        few = {w: n for w, n in few.items() if w not in known}
                    found[unknown] = [at[w] for w in others]
                    rare += few
                    times += few.values()
                ids.append(found.tobytes())
                ends.append(len(rare))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, k)) for x, k in ((rare, pa.binary()), (times, pa.int32()))]
            cols = [pa.array(np.arange(row, row + len(ids))), *b.columns[1:], pa.array(ids, pa.binary()), *lists]
            row += len(ids)
            yield pa.RecordBatch.from_arrays(cols, ["row", *keys, "ids", "rare", "times"])

    schema = "row long, " + "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in keys) + "ids binary, rare array<binary>, times array<int>"
    return materialize(docs.select("text", *keys).mapInArrow(lean(run), schema), "lm-ids")


def _laid(ids: pa.Array, end: int, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, ids with two ends before every text, where each text's tokens start,
    their numbers) of consecutive texts of ``size`` tokens or more."""
    first, parts, held, edge = 0, [], 0, np.array([end, end], np.int32)
    for i, x in enumerate(ids):
        parts.append(np.frombuffer(x.as_buffer(), np.int32))
        held += len(parts[-1])
        if held >= size or i == len(ids) - 1:
            lengths = np.array([len(p) for p in parts])
            seq = np.concatenate([y for p in parts for y in (edge, p)])
            yield first, seq, np.cumsum(lengths + 2) - lengths, lengths
            first, parts, held = i + 1, [], 0


def _targets(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def learn(encoded: DataFrame, tree: Tree, log_class: np.ndarray, passes: int = PASSES) -> Vectors:
    """Vectors trained on all trigrams of all rows of ``encoded``, ``passes`` times.

    Every trainer returns its vectors, so each takes SHARE times their bytes of ids at least,
    if that leaves a trainer for every core: what is shuffled stays a small part of the input."""
    vectors, rows = Vectors.start(tree), encoded.select("ids")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0))).first()[0]
    trainers = max(encoded.sparkSession.sparkContext.defaultParallelism, size // (SHARE * sum(x.nbytes for x in vectors.all())))
    shares = rows.coalesce(trainers)
    for n in range(passes):
        shared = encoded.sparkSession.sparkContext.broadcast((tree, vectors, log_class))

        def run(batches: Iterator[pa.RecordBatch], n: int = n, shared=shared) -> Iterator[pa.RecordBatch]:
            part, trainer = TaskContext.get().partitionId(), None
            for b in batches:
                for _, seq, starts, lengths in _laid(b.column(0), shared.value[0].end, TOGETHER * 8):
                    trainer = trainer or Trainer(*shared.value, seed=part * 1000 + n)
                    at = trainer.rng.permutation(_targets(starts, lengths))
                    for lo in range(0, len(at), TOGETHER):
                        own = at[lo : lo + TOGETHER]
                        trainer.step(seq[own - 2], seq[own - 1], seq[own])
            for which, (x, met) in enumerate(zip(trainer.vectors.all(), trainer.met) if trainer else ()):
                for slab in range(0, len(x), SLAB):
                    m = met[slab : slab + SLAB]
                    if m.any():
                        both = np.concatenate([x[slab : slab + SLAB] * m[:, None], m[:, None]], 1)
                        yield pa.RecordBatch.from_arrays([pa.array([which], pa.int32()), pa.array([slab], pa.int64()), pa.array([part], pa.int32()), pa.array([both.tobytes()], pa.binary())], ["which", "slab", "part", "sums"])

        def added(t: pa.Table) -> pa.Table:
            t = t.sort_by("part")  # so that sums are the same each time
            total = sum(np.frombuffer(x.as_py(), np.float32).astype(np.float64) for x in t.column("sums"))
            return pa.table({"which": t.column("which")[:1], "slab": t.column("slab")[:1], "part": t.column("part")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

        def averaged(t: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x.as_py(), np.float64) for x in t.sort_by("part").column("sums")).reshape(-1, WIDTH + 1)
            mean = (total[:, :-1] / np.maximum(total[:, -1:], 1e-9)).astype(np.float32)
            mean[total[:, -1] == 0] = np.nan
            return pa.table({"which": t.column("which")[:1], "slab": t.column("slab")[:1], "mean": pa.array([mean.tobytes()], pa.binary())})

        schema = "which int, slab long, part int, sums binary"
        rows = shares.mapInArrow(lean(run, hold=True), schema)
        sums = rows.groupBy("which", "slab", F.col("part") % SUMMED).applyInArrow(added, schema)
        new = Vectors(*[x.copy() for x in vectors.all()])
        for r in sums.groupBy("which", "slab").applyInArrow(averaged, "which int, slab long, mean binary").collect():
            mean = np.frombuffer(bytes(r["mean"]), np.float32).reshape(-1, WIDTH)
            met = ~np.isnan(mean[:, 0])
            new.all()[r["which"]][r["slab"] : r["slab"] + SLAB][met] = mean[met]
        vectors = new
        shared.destroy()
    return vectors


@dataclass
class Model:
    vocab: Vocabulary
    log_class: np.ndarray  # base: natural logarithm of a class after two others
    tree: Tree
    vectors: Vectors


def fit(docs: DataFrame) -> tuple[Model, DataFrame, DataFrame]:
    """The model of the rows of ``docs`` (doc_id, text, learns) that it may learn from, their
    stored word counts, and all rows as ``encoded``."""
    counts = materialize(word_counts(docs.filter("learns")), "lm-counts")
    vocab = vocabulary(counts)
    tree = Tree.of(vocab, class_sizes(counts, vocab))
    rows = encoded(docs, tree)
    may_learn = rows.filter("learns")
    log_class = fit_in_task(trigrams(may_learn, tree), lambda t: train(dense(t.column("code").to_numpy(), t.column("n").to_numpy())))
    if log_class is None:
        log_class = train(np.zeros((CLASSES,) * 3, np.int64))
    return Model(vocab, log_class, tree, learn(may_learn, tree, log_class)), counts, rows


def score(rows: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, learns, n_tokens, n_known, base_score, score of all ``rows`` (as ``encoded``)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # the vocabulary with its vectors, and CLASSES^3 floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        tree, v = m.tree, len(m.tree.ids)
        freq = np.zeros(len(tree.cls))  # log10 of smoothed counts; rarer words' are joined
        freq[:v] = np.log10(np.fromiter(m.vocab.counts.values(), np.float64, v) + 1)
        for b in batches:
            n, known, logs, lm = [], [], [], []
            for _, seq, starts, lengths in _laid(b.column(3), tree.end, SCORED):
                at = _targets(starts, lengths)
                c = seq[at]
                each = -tree.log_rest[c] - freq[c]
                for lo in range(0, len(at), SCORED):
                    own = at[lo : lo + SCORED]
                    each[lo : lo + SCORED] += log_next(tree, m.vectors, m.log_class, seq[own - 2], seq[own - 1], seq[own])
                begins = np.cumsum(lengths) - lengths
                n.append(lengths)
                known.append(np.add.reduceat(c < v, begins, dtype=np.int64))
                logs.append(np.add.reduceat(freq[c], begins))
                lm.append(np.add.reduceat(each, begins))
            cols = [pa.array(np.concatenate(x) if x else [], k) for x, k in ((n, pa.int64()), (known, pa.int64()), (logs, pa.float64()), (lm, pa.float64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *cols], ["row", "doc_id", "learns", "n_tokens", "known", "logs", "lm"])

    schema = "row long, doc_id long, learns boolean, n_tokens long, known long, logs double, lm double"
    read = rows.select("row", "doc_id", "learns", "ids").mapInArrow(lean(run, hold=True), schema)
    each = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    hits = each.join(counts.filter(F.col("c") > 0), "word")
    sums = hits.groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more_logs"))
    end = counts.filter(F.col("word") == F.lit(b"")).first()
    c_end = end["c"] if end else 0
    total, distinct = model.vocab.total, model.vocab.distinct
    whole = float(np.log10(total + distinct + 1))
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    return read.join(sums, "row", "left").select(
        "doc_id", "learns", "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0)) + F.lit(int(c_end > 0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (logs + F.lit(float(np.log10(c_end + 1))) - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        (logs + F.col("lm")).alias("score"),
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text", learns(F.col("doc_id"), MODULUS, LEFT_OUT).alias("learns"))
    model, counts, rows = fit(docs)
    out = score(rows, model, counts)
    return out.select("doc_id", (~F.col("learns")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
