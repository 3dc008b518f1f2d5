"""Quality classifier: a sparse rule ensemble over text statistics.

Small regression trees are grown on random parts of the labelled rows; every path from
a root becomes a conjunctive rule over the statistics. A logistic model with a lasso
penalty weighs the rules and the (winsorised, scaled) statistics, which leaves few of
them, and what is left is compiled into one Spark column expression.

The statistics are computed over whole texts in batches. Defined results: a null or
empty text has all-zero statistics and is scored like any other; without labelled rows
every score is 0.5; repeated rows get equal scores; labels that are null or repeat
with different values are ignored or averaged; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import fit_in_task, learns, materialize, table
from .words import SPACE, blocks, hashes, spans

#: Bound of the sample that the ensemble is fitted on (smallest hashes of the ids).
SAMPLE_ROWS = 12_000
TREES, DEPTH, LEAST, CUTS = 60, 3, 20, 32
PENALTY, PASSES = 2e-3, 300
THRESHOLD = 0.7

_U = np.uint64


def _bytes(*spans: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for lo, hi in spans:
        out[lo : hi + 1] = True
    return out


_KINDS = {
    "upper": _bytes((65, 90)), "lower": _bytes((97, 122)), "digit": _bytes((48, 57)), "space": SPACE,
    "stop": _bytes((46, 46)), "comma": _bytes((44, 44)), "bang": _bytes((33, 33), (63, 63)), "bar": _bytes((124, 124)),
    "mark": _bytes((35, 38), (42, 43), (60, 62), (64, 64), (94, 96), (126, 126)), "other": _bytes((128, 255)), "line": _bytes((10, 10)),
}
STATS = [
    *(f"{k}_rate" for k in _KINDS), "log_bytes", "log_words", "log_lines", "word_bytes", "word_spread", "long_words", "short_words",
    "distinct_words", "top_word", "repeated_pairs", "distinct_lines", "line_bytes", "capital_words", "shouted_words", "marked_words", "mean_line_words",
]


def _repeats(hashes: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text the number of distinct hashes and the count of its most frequent one."""
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.r_[at, len(h)])
    top = np.zeros(n, np.int64)
    np.maximum.at(top, t[at], runs)
    return np.bincount(t[at], minlength=n), top


def statistics(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(texts, STATS) of texts laid end to end in ``data``."""
    n, begins = len(ends), np.r_[0, ends[:-1]]
    size = np.maximum(ends - begins, 1).astype(float)

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(flags)]
        return (total[ends] - total[begins]).astype(float)

    cols = [per_text(k[data]) / size for k in _KINDS.values()]
    s, e = spans(data, ends)
    text = np.searchsorted(ends, s, "right")
    count = np.bincount(text, minlength=n)
    words = np.maximum(count, 1).astype(float)
    length = (e - s).astype(float)
    mean = np.bincount(text, length, n) / words
    spread = np.sqrt(np.maximum(np.bincount(text, length * length, n) / words - mean * mean, 0))
    h = hashes(data, s, e)
    distinct, top = _repeats(h, text, n)
    pair = (h[:-1] * _U(3) + h[1:])[text[:-1] == text[1:]] if len(h) > 1 else h[:0]
    pair_text = text[:-1][text[:-1] == text[1:]] if len(h) > 1 else text[:0]
    pairs = np.bincount(pair_text, minlength=n)
    distinct_pairs, _ = _repeats(pair, pair_text, n)
    breaks = np.flatnonzero(data == 10)
    line_s, line_text = np.r_[begins, breaks + 1], np.r_[np.arange(n), np.searchsorted(ends, breaks, "right")]
    after = np.searchsorted(breaks, line_s)
    line_e = np.minimum(np.r_[breaks, len(data)][after], ends[line_text])
    lines = np.maximum(np.bincount(line_text, minlength=n), 1).astype(float)
    distinct_lines, _ = _repeats(hashes(data, line_s, line_e), line_text, n)
    upper = np.r_[0, np.cumsum(_KINDS["upper"][data])]
    lower = np.r_[0, np.cumsum(_KINDS["lower"][data])]
    mark = np.r_[0, np.cumsum(_KINDS["mark"][data])]
    rate = lambda flags: np.bincount(text, flags, n) / words
    cols += [
        np.log1p(ends - begins), np.log1p(count), np.log1p(lines), mean, spread, rate(length > 12), rate(length < 3),
        distinct / words, top / words, 1 - distinct_pairs / np.maximum(pairs, 1), distinct_lines / lines, size / lines,
        rate(_KINDS["upper"][data[s]]), rate((upper[e] > upper[s]) & (lower[e] == lower[s])), rate(mark[e] > mark[s]), count / lines,
    ]
    out = np.stack(cols, 1)
    out[ends == begins] = 0
    return out


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the STATS columns of every row of ``docs`` (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, data, ends in blocks(b, 1):
                values = statistics(data, ends)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(ends)), *(pa.array(v) for v in values.T)], ["doc_id", *STATS])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{s} double" for s in STATS))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is above, bound)."""

    parts: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for i, above, bound in self.parts:
            out &= (x[:, i] > bound) == above
        return out

    def column(self) -> Column:
        out = None
        for i, above, bound in self.parts:
            c = F.col(STATS[i]) > F.lit(bound) if above else F.col(STATS[i]) <= F.lit(bound)
            out = c if out is None else out & c
        return out


def _split(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], of: np.ndarray) -> tuple[float, int, float] | None:
    """The (gain, statistic, bound) that lowers the squared error of y the most."""
    best, total, n = None, y.sum(), len(y)
    for i in of:
        if not len(cuts[i]):
            continue
        at = np.searchsorted(cuts[i], x[:, i])  # x <= cuts[j] for j >= at
        m = np.cumsum(np.bincount(at, minlength=len(cuts[i]) + 1))[:-1]
        left = np.cumsum(np.bincount(at, y, len(cuts[i]) + 1))[:-1]
        ok = (m >= LEAST) & (n - m >= LEAST)
        if ok.any():
            gain = np.where(ok, left**2 / np.maximum(m, 1) + (total - left) ** 2 / np.maximum(n - m, 1), -np.inf) - total**2 / n
            j = int(gain.argmax())
            if best is None or gain[j] > best[0]:
                best = (float(gain[j]), int(i), float(cuts[i][j]))
    return best if best and best[0] > 1e-6 else None


def grow(x: np.ndarray, y: np.ndarray, seed: int = 6) -> list[Rule]:
    """Rules of TREES boosted trees, each grown on half of the rows and a random third
    of the statistics a node."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, i], np.linspace(0.02, 0.98, CUTS))) for i in range(x.shape[1])]
    base = y.mean()
    margin, rules = np.full(len(y), np.log(base / (1 - base))), {}
    for _ in range(TREES):
        part = rng.random(len(y)) < 0.5
        rest = y - 1 / (1 + np.exp(-margin))
        nodes = [((), part)]
        for _ in range(DEPTH):
            below = []
            for path, on in nodes:
                if on.sum() < 2 * LEAST:
                    continue
                found = _split(x[on], rest[on], cuts, rng.choice(x.shape[1], max(2, x.shape[1] // 3), replace=False))
                if found is None:
                    continue
                _, i, bound = found
                for above in (False, True):
                    own = (*path, (i, above, bound))
                    rules[Rule(tuple(sorted(own)))] = None
                    below.append((own, on & ((x[:, i] > bound) == above)))
            nodes = below
        for path, on in nodes:
            if on.any():
                p = 1 / (1 + np.exp(-margin[on]))
                margin[Rule(path).holds(x)] += 0.2 * np.clip(rest[on].sum() / max((p * (1 - p)).sum(), 1e-3), -4, 4)
    return list(rules)


@dataclass
class Ensemble:
    bias: float
    rules: list[tuple[Rule, float]]
    linear: list[tuple[int, float, float, float]]  # statistic, low, high, weight

    def column(self) -> Column:
        """The score as one expression over the STATS columns."""
        z = F.lit(self.bias)
        for rule, weight in self.rules:
            z = z + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        for i, low, high, weight in self.linear:
            z = z + F.least(F.greatest(F.col(STATS[i]), F.lit(low)), F.lit(high)) * F.lit(weight)
        return 1 / (1 + F.exp(-z))


def lasso(a: np.ndarray, y: np.ndarray, penalty: float = PENALTY, passes: int = PASSES) -> tuple[float, np.ndarray]:
    """Bias and weights of least logistic loss plus ``penalty`` times their absolute
    sum, by accelerated proximal gradient steps."""
    n, k = a.shape
    w, bias = np.zeros(k), float(np.log(y.mean() / (1 - y.mean())))
    v = np.ones(k) / k**0.5
    for _ in range(20):  # the largest curvature
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v) + 1e-12
    step = 1 / (0.25 * np.linalg.norm(a @ v) ** 2 / n + 0.25)
    ahead, ahead_bias, t = w.copy(), bias, 1.0
    for _ in range(passes):
        d = (1 / (1 + np.exp(-(a @ ahead + ahead_bias))) - y) / n
        new = ahead - step * (a.T @ d)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_bias = ahead_bias - step * d.sum()
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, ahead_bias = new + (t - 1) / t2 * (new - w), new_bias + (t - 1) / t2 * (new_bias - bias)
        w, bias, t = new, new_bias, t2
    return bias, w


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    if not len(y) or y.min() == y.max():
        return Ensemble(0.0 if not len(y) else (6.0 if y[0] else -6.0), [], [])
    rules = grow(x, y)
    low, high = np.quantile(x, 0.025, axis=0), np.quantile(x, 0.975, axis=0)
    wins = np.clip(x, low, high)
    spread = wins.std(axis=0)
    scale = np.where(spread > 1e-9, 0.4 / np.maximum(spread, 1e-9), 0)
    a = np.concatenate([np.stack([r.holds(x) for r in rules], 1).astype(float) if rules else np.zeros((len(x), 0)), (wins - wins.mean(axis=0)) * scale], 1)
    bias, w = lasso(a, y)
    own, lin = w[: len(rules)], w[len(rules) :]
    bias -= float((lin * scale * wins.mean(axis=0)).sum())
    return Ensemble(
        float(bias), [(r, float(v)) for r, v in zip(rules, own) if v],
        [(i, float(low[i]), float(high[i]), float(lin[i] * scale[i])) for i in range(len(lin)) if lin[i] * scale[i]],
    )


def fitted(stats: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Ensemble:
    """The ensemble fitted to at most ``rows`` labelled rows, by hash of their ids."""
    marks = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("_y"))
    share = min(1.0, 2 * rows / max(1, marks.count()))  # so no task orders more than about twice the sample
    near = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < share * (1 << 32))
    picked = stats.join(near, "doc_id").orderBy(F.xxhash64("doc_id"), *STATS).limit(rows)

    def learn(t: pa.Table) -> Ensemble:
        values = np.stack([t.column(c).to_numpy() for c in [*STATS, "_y"]], 1).astype(float)
        values = values[np.lexsort(values.T)]
        return fit(values[:, :-1], values[:, -1])

    return fit_in_task(picked.select(*STATS, "_y"), learn) or Ensemble(0.0, [], [])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    may_learn = learns(F.col("doc_id"), 4, 2)
    stats = materialize(with_statistics(table(spark, sf_dir, "documents")), "quality-stats")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(may_learn)
    model = fitted(stats.filter(may_learn), labels)
    out = stats.select("doc_id", (~may_learn).alias("held_out"), model.column().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
