"""Language ID by a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes in windows of WINDOW positions, forwards and
backwards, labels every position with a language and pools the positions'
probabilities into the document's. It is trained in numpy by backpropagation through
time on a bounded sample of labelled documents and then labels every window of every
whole text.

A network may also learn noise as a class: then texts whose pooled probability of that
class reaches a limit by length are rejected.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is a
rejected one, with the reject class's score; all other texts get a learned language, and
every language that a labelled row names is learned; an empty table, or one without
labelled rows, gives ``und`` for every row; repeated rows get equal values; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import fit_in_task, lean, learns, table
from .words import blocks

HIDDEN = 8
WINDOW = 48
#: Bound of the training sample: documents a language, windows of a document. Of very many
#: languages each has fewer documents, LEAST_DOCS at least, so that SAMPLE_ROWS suffice.
SAMPLE_DOCS, SAMPLE_WINDOWS, SAMPLE_ROWS, LEAST_DOCS = 400, 4, 100_000, 8
#: How many times the sample is ranked.
SPARE = 4
STEPS, BATCH, RATE, SHORT = 300, 256, 0.02, 0.3
#: Windows that are labelled side by side, fewer if there are over LANE_LANGS languages.
LANES, LANE_LANGS = 2048, 64
UND = "und"
#: Noise that a network with a reject class learns: letters of scripts, by first and last
#: code; a script that stands in a SEEN share of a learned language's windows is no noise.
SCRIPTS = [(0x370, 0x3FF), (0x400, 0x45F), (0x531, 0x586), (0x5D0, 0x5EA), (0x621, 0x64A), (0x904, 0x939), (0xE01, 0xE2E), (0x10D0, 0x10F0), (0x3041, 0x30FE), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3)]
SEEN = 0.3
#: Least mean probability of the reject class that rejects a text of so many bytes or more;
#: shorter ones say too little. Clean short texts of numbers and addresses come to 0.75.
REJECT = [(8, 0.95), (16, 0.9), (256, 0.75), (1024, 0.5)]

_F = np.float32


def sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(np.minimum(x, 80, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


@dataclass
class Network:
    """Weights of both directions (axis 0), in float32. Gates: update, reset, new."""

    langs: list[str]
    inputs: np.ndarray  # (2, 256, 3h): a byte's share of the gates, biases included
    hidden: np.ndarray  # (2, h, 3h)
    output: np.ndarray  # (2, h, langs)
    bias: np.ndarray  # (langs,)

    @classmethod
    def random(cls, langs: list[str], hidden: int = HIDDEN, seed: int = 4) -> "Network":
        rng = np.random.default_rng(seed)
        draw = lambda *s, scale: rng.normal(0, scale, s).astype(_F)
        return cls(langs, draw(2, 256, 3 * hidden, scale=0.5), draw(2, hidden, 3 * hidden, scale=hidden**-0.5), draw(2, hidden, len(langs), scale=hidden**-0.5), np.zeros(len(langs), _F))

    def weights(self) -> list[np.ndarray]:
        return [self.inputs, self.hidden, self.output, self.bias]

    def states(self, steps: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(T, 2, lanes, h) states for bytes ``steps`` (2, lanes, T), each direction in
        its own order. keep: gets what backpropagation needs."""
        _, lanes, length = steps.shape
        h = self.hidden.shape[1]
        out = np.zeros((length + 1, 2, lanes, h), _F)
        rows = np.ascontiguousarray(steps.transpose(2, 0, 1)).astype(np.int64) + np.array([0, 256])[None, :, None]
        gates = self.inputs.reshape(512, -1)
        for t in range(length):
            x = gates[rows[t]]
            r = np.matmul(out[t], self.hidden)
            zr = sigmoid(x[..., : 2 * h] + r[..., : 2 * h])
            z, reset = zr[..., :h], zr[..., h:]
            new = 2 * sigmoid(2 * (x[..., 2 * h :] + reset * r[..., 2 * h :])) - 1
            np.add(new, z * (out[t] - new), out=out[t + 1])
            if keep is not None:
                keep.append((z, reset, new, r[..., 2 * h :]))
        return out

    def fast_states(self, steps: np.ndarray, room: dict) -> np.ndarray:
        """As ``states``, for labelling only. Signs and factors of the gates' functions are
        in the weights, and all arrays are kept in ``room`` from call to call."""
        _, lanes, length = steps.shape
        h = self.hidden.shape[1]
        if room.get("for") != (id(self), lanes, length):
            scale = np.repeat(np.array([-1, -1, -2], _F), h)
            room.update(
                {"for": (id(self), lanes, length), "in": np.ascontiguousarray((self.inputs * scale).reshape(512, -1)), "hid": self.hidden * scale, "out": np.zeros((length + 1, 2, lanes, h), _F)}
                | {k: np.empty((2, lanes, n * h), _F) for k, n in (("x", 3), ("r", 3), ("zr", 2), ("n", 1), ("o", 1))}
            )
        out, x, r, zr, new, old = (room[k] for k in ("out", "x", "r", "zr", "n", "o"))
        rows = np.ascontiguousarray(steps.transpose(2, 0, 1)).astype(np.intp)
        rows[:, 1] += 256
        with np.errstate(over="ignore"):
            for t in range(length):
                np.take(room["in"], rows[t], axis=0, out=x, mode="clip")
                np.matmul(out[t], room["hid"], out=r)
                np.add(x[..., : 2 * h], r[..., : 2 * h], out=zr)
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                np.multiply(zr[..., h:], r[..., 2 * h :], out=new)
                new += x[..., 2 * h :]
                np.exp(new, out=new)
                new += 1
                np.divide(2, new, out=new)
                new -= 1
                np.subtract(out[t], new, out=old)
                old *= zr[..., :h]
                np.add(old, new, out=out[t + 1])
        return out

    def probabilities(self, states: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(T, lanes, langs) of each position; ``states`` as of ``states``."""
        length, lanes = states.shape[0] - 1, states.shape[2]
        ahead = states[1:, 0] @ self.output[0]
        back = states[1:, 1] @ self.output[1]  # at step t: position lengths - 1 - t
        where = lengths[None, :] - 1 - np.arange(length)[:, None]
        if lanes and int(lengths.min()) == length:
            back = back[::-1]
        else:
            back = back[np.maximum(where, 0), np.arange(lanes)[None, :]]
        p = ahead + back + self.bias
        np.exp(p - p.max(axis=2, keepdims=True), out=p)
        p /= p.sum(axis=2, keepdims=True)
        return p

    def loss_gradients(self, steps: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Cross-entropy over all positions and its gradients, through time."""
        keep: list = []
        states = self.states(steps, keep)
        p = self.probabilities(states, lengths)
        length, lanes, n = p.shape
        h = self.hidden.shape[1]
        on = np.arange(length)[:, None] < lengths[None, :]
        total = on.sum()
        picked = np.take_along_axis(p, np.broadcast_to(labels[None, :, None], (length, lanes, 1)), 2)[..., 0]
        loss = float(-(np.log(picked + 1e-9) * on).sum() / total)
        dp = p.copy()
        dp[:, np.arange(lanes), labels] -= 1
        dp *= on[..., None] / total
        where = np.maximum(lengths[None, :] - 1 - np.arange(length)[:, None], 0)
        d_back = np.where(on[..., None], dp[where, np.arange(lanes)[None, :]], 0)
        d_out = np.stack([dp, d_back], 1).astype(_F)  # (T, 2, lanes, langs), by step
        g_output = np.einsum("tdlh,tdln->dhn", states[1:], d_out, optimize=True)
        d_states = np.matmul(d_out, self.output.transpose(0, 2, 1)[None])
        g_inputs, g_hidden = np.zeros((512, 3 * h), _F), np.zeros_like(self.hidden)
        carry = np.zeros((2, lanes, h), _F)
        for t in range(length - 1, -1, -1):
            z, reset, new, rn = keep[t]
            before = states[t]
            d = carry + d_states[t]
            d_new = d * (1 - z) * (1 - new * new)
            d_z = d * (before - new) * z * (1 - z)
            d_r = d_new * rn * reset * (1 - reset)
            d_x = np.concatenate([d_z, d_r, d_new], 2)
            d_h = np.concatenate([d_z, d_r, d_new * reset], 2)
            g_hidden += np.matmul(before.transpose(0, 2, 1), d_h)
            carry = d * z + np.matmul(d_h, self.hidden.transpose(0, 2, 1))
            rows = (steps[:, :, t].astype(np.int64) + np.array([0, 256])[:, None]).ravel()
            hot = np.zeros((512, len(rows)), _F)
            hot[rows, np.arange(len(rows))] = 1
            g_inputs += hot @ d_x.reshape(len(rows), -1)
        return loss, [g_inputs.reshape(2, 256, -1), g_hidden, g_output.astype(_F), dp.sum(axis=(0, 1)).astype(_F)]


def windows(data: np.ndarray, ends: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, text) of the windows that cover all texts in ``data``."""
    begins = np.r_[0, ends[:-1]]
    n = -(-(ends - begins) // width)
    text = np.repeat(np.arange(len(ends)), n)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    starts = begins[text] + nth * width
    return starts, np.minimum(width, ends[text] - starts), text


def steps_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """(2, windows, width) bytes, forwards and backwards; 0 past a window's end."""
    at = np.arange(width)[None, :]
    on = at < lengths[:, None]
    if not len(data):
        return np.zeros((2, len(starts), width), np.uint8)
    ahead = data[np.minimum(starts[:, None] + at, len(data) - 1)]
    back = data[np.maximum(starts[:, None] + lengths[:, None] - 1 - at, 0)]
    return np.stack([np.where(on, ahead, 0), np.where(on, back, 0)]).astype(np.uint8)


def pooled(net: Network, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(texts, langs): the mean probability of all positions of each text."""
    starts, lengths, text = windows(data, ends)
    sums = np.zeros((len(ends), len(net.langs)))
    order = np.argsort(lengths != WINDOW, kind="stable")  # short windows last
    full = int((lengths == WINDOW).sum())
    room: dict = {}
    lanes = max(1, LANES * LANE_LANGS // max(LANE_LANGS, len(net.langs)))
    cuts = [*range(0, full, lanes), *range(full, len(order), lanes)]
    for lo, hi in zip(cuts, [*cuts[1:], len(order)]):
        own = order[lo:hi]
        size = lengths[own]
        p = net.probabilities(net.fast_states(steps_of(data, starts[own], size), room), size)
        if lo >= full:
            p = p * (np.arange(WINDOW)[:, None] < size[None, :])[..., None]
        each = p.sum(axis=0)
        for k in range(sums.shape[1]):
            sums[:, k] += np.bincount(text[own], each[:, k], len(ends))
    n = np.diff(np.r_[0, ends])
    return sums / np.maximum(n, 1)[:, None]


def train(texts: list[bytes], labels: list[str], *, hidden: int = HIDDEN, steps: int = STEPS, seed: int = 4) -> Network:
    """Adam over windows drawn with equal shares of all languages."""
    langs = sorted(set(labels))
    rng = np.random.default_rng(seed)
    net = Network.random(langs, hidden, seed)
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts, lengths, text = windows(data, np.cumsum([len(t) for t in texts]))
    number = {x: i for i, x in enumerate(langs)}
    label = np.array([number[x] for x in labels])[text]
    by = [np.flatnonzero((label == i) & (lengths >= min(8, WINDOW))) for i in range(len(langs))]
    by = [b if len(b) else np.flatnonzero(label == i) for i, b in enumerate(by)]
    by = [b for b in by if len(b)]
    ws = net.weights()
    first, second = [np.zeros_like(w) for w in ws], [np.zeros_like(w) for w in ws]
    for step in range(1, steps + 1):
        own = np.concatenate([rng.choice(b, max(1, BATCH // len(by))) for b in by])
        short = np.minimum(lengths[own], rng.integers(4, WINDOW + 1, len(own)))
        size = np.where(rng.random(len(own)) < SHORT, short, lengths[own])  # short texts must be told apart too
        _, grads = net.loss_gradients(steps_of(data, starts[own], size), size, label[own])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * (1 - step / (steps + 1)) ** 0.5
        for w, g, m, v in zip(ws, grads, first, second):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(_F)
    return net


def noise(texts: list[bytes], labels: list[str], n: int, seed: int = 5) -> list[bytes]:
    """``n`` windows that are in no language: base64, hexadecimals, keyboard noise, digits
    and marks with a letter or two, and letters of scripts that no language of ``texts`` uses."""
    rng = np.random.default_rng(seed)
    by: dict[str, list[set[int]]] = {}
    for t, x in zip(texts, labels):
        by.setdefault(x, []).append(set(map(ord, t.decode("utf-8", "ignore"))))
    unused = [(a, z) for a, z in SCRIPTS if all(sum(any(a <= c <= z for c in t) for t in own) < SEEN * len(own) for own in by.values())]
    lower, digits, marks = "abcdefghijklmnopqrstuvwxyz", "0123456789", "!?.,;:-_/#&%$()[]{}=+*@<>|~^"
    out = []
    for i in range(n):
        kind = i % 6 if unused else i % 5
        if kind == 0:
            t = rng.choice(list(lower + lower.upper() + digits + "+/"), WINDOW)
        elif kind == 1:
            t = rng.choice(list("0123456789abcdef" if i % 2 else "0123456789ABCDEF") + [" "] * int(rng.integers(0, 4)), WINDOW)
        elif kind == 2:
            t = rng.choice(list(lower + ";") + [" "] * int(rng.integers(0, 7)), WINDOW)
        elif kind == 3:
            t = rng.choice(list("asdfghjklqwertyuiop;'") + [" "] * int(rng.integers(0, 4)), WINDOW)
        elif kind == 4:
            t = rng.choice(list(digits + marks) + [" "] * 12, WINDOW)
            t[np.r_[0, rng.integers(0, WINDOW, int(rng.integers(0, 3)))]] = rng.choice(list(lower + lower.upper()))
            t[1] = " " if i % 2 else t[1]
        else:
            a, z = unused[int(rng.integers(len(unused)))]
            t = [chr(c) if rng.random() > 0.12 else " " for c in rng.integers(a, z + 1, WINDOW)]
        out.append("".join(t).encode()[:WINDOW])
    return out


def sample(docs: DataFrame, may_learn: Column) -> DataFrame:
    """lang, cuts: windows, at hashed places, of at most SAMPLE_DOCS documents a language
    (those with the smallest hashes of their ids).

    Languages are counted first, and only documents whose hash falls into the share that
    gives SPARE times the sample are ranked, so that no task ranks more than a sample.
    """
    labelled = may_learn & F.col("lang").isNotNull()
    counts = docs.filter(labelled).groupBy("lang").count().collect()  # a row a language
    each = max(LEAST_DOCS, min(SAMPLE_DOCS, SAMPLE_ROWS // max(1, len(counts))))
    shares = [(r["lang"], min(1.0, SPARE * each / r["count"])) for r in counts]
    shares = F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, _share double"))
    h = F.xxhash64("doc_id")
    in_share = F.pmod(h, F.lit(1 << 32)) < F.col("_share") * (1 << 32)
    n = F.char_length("text")
    cut = [
        F.substring("text", (F.pmod(F.xxhash64(F.lit(i), "doc_id"), F.greatest(n - WINDOW, F.lit(1))) + 1).cast("int"), F.lit(WINDOW))
        for i in range(SAMPLE_WINDOWS)
    ]
    rows = docs.filter(labelled).select("doc_id", "text", "lang").join(shares, "lang").filter(in_share).filter(F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", h.alias("h"), F.array(*cut).alias("cuts"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "cuts"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= each)


def predict(docs: DataFrame, net: Network | None, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` of every row of ``docs``, the predicted language and its score.
    A network with a reject class gives UND, and that class's score, for texts it rejects."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few hundred kB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            absent = b.column(0).is_null().to_numpy(zero_copy_only=False)
            for lo, data, ends in blocks(b, 0):
                begins, n = np.r_[0, ends[:-1]], len(ends)
                known = np.zeros(n, bool)
                for i in np.flatnonzero(~absent[lo : lo + n]) if own is not None else ():
                    known[i] = any(map(str.isalpha, data[begins[i] : ends[i]].tobytes().decode("utf-8", "replace")))
                langs, scores = np.full(n, UND, object), np.zeros(n)
                if known.any():
                    p = pooled(own, data, ends)[known]
                    if UND in own.langs and len(own.langs) > 1:
                        at = own.langs.index(UND)
                        size, limit = (ends - begins)[known], np.full(len(p), 2.0)
                        for least, x in REJECT:
                            limit[size >= least] = x
                        rejects = p[:, at] >= limit
                        p[~rejects, at] = -1
                        p[rejects] *= np.arange(p.shape[1]) == at
                    langs[known] = np.array(own.langs, object)[p.argmax(axis=1)]
                    scores[known] = np.clip(p.max(axis=1), 0, 1)
                cols = [b.column(i).slice(lo, n) for i in range(1, b.num_columns)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(langs, pa.string()), pa.array(scores)], [*keep, *names])

    rows = docs.select(F.col("text").alias("_text"), *[F.col(f"`{c}`") for c in keep])
    schema = StructType([*rows.schema.fields[1:], StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    return rows.mapInArrow(lean(run), schema)


def fitted(docs: DataFrame, reject: bool = False) -> Network | None:
    """The network trained on the sample of ``docs`` (doc_id, text, lang); reject: with
    noise as a class of its own."""

    def fit(t: pa.Table) -> Network:
        rows = sorted(t.select(["lang", "rank", "cuts"]).to_pylist(), key=lambda r: (r["lang"], r["rank"]))
        both = [(c.encode()[:WINDOW], r["lang"]) for r in rows for c in r["cuts"] if c]
        if reject and both:
            both += [(t, UND) for t in noise([t for t, _ in both], [x for _, x in both], SAMPLE_DOCS * SAMPLE_WINDOWS)]
        return train([t for t, _ in both], [x for _, x in both])

    return fit_in_task(sample(docs, learns(F.col("doc_id"), 3, 1)), fit)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, fitted(docs))
    return out.select("doc_id", (~learns(F.col("doc_id"), 3, 1)).alias("held_out"), "lang_pred", "score")
