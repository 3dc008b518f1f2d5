"""Best-fit packing of tokenised documents by minimum bin slack.

Only the histogram of piece lengths (at most ``seq_len`` rows, however large the
corpus) reaches the driver. There, per bin, a bitset subset-sum over the lengths that
are left finds the fullest feasible combination with the longest piece in it; the
combination is taken as often as the counts allow and removed. Pieces then find their
places by length and by rank among the pieces of that length; ranks are counted in
salted groups, so a length that a third of all pieces share is still ranked in
parallel.

Defined results: a null or empty text is one piece that holds the end id alone;
repeated rows are packed each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import lean, materialize, table
from .words import SHORT, blocks, grouped, spans

SEQ_LEN = 4096
END_ID = 1
SALTS = 1024
#: Words and units whose ids a worker remembers at most.
CACHE_WORDS, CACHE_UNITS = 500_000, 50_000

#: The tokenizer's own split of such text, in lower case; words end in line feeds.
_UNITS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|\n|[^ \t\n\r\f\va-z0-9ß-öø-ÿ]+")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _plain(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which words ``_UNITS`` splits as the tokenizer does: of ASCII and Latin-1 letters,
    which its normalizer only lower-cases, letter by letter, and without special tokens."""
    after = np.r_[data[1:], np.uint8(0)]
    pair = (data == 0xC3) & (after >= 0x80) & (after != 0x97) & (after != 0xB7)  # but for the signs of times and division
    bad = (data > 0x7F) & ~pair
    bad[1:] &= ~pair[:-1]
    bad |= (data == ord("<")) & (after == ord("|"))
    total = np.r_[0, np.cumsum(bad)]
    return total[ends] == total[starts]


class WordIds:
    """Ids of texts, word by word. The vocabulary's pre-tokenizer never joins text over
    white space, so a text's ids are those of its words, one after the other. Words met
    before aren't encoded again: they are found by their keys, and the bytes of those that
    a key doesn't hold are compared."""

    def __init__(self, path: str, most: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a word
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.units: dict[str, bytes] = {}
        #: Known words by key: where in ``pool`` their ids and in ``bytes`` their bytes are,
        #: how many of both, and how often met.
        self.keys = np.zeros(0, np.uint64)
        self.at, self.n, self.from_, self.size, self.met = (np.zeros(0, np.int64) for _ in range(5))
        self.pool, self.bytes = np.zeros(0, np.uint32), np.zeros(0, np.uint8)

    def forget(self) -> None:
        """Keeps the half of the words that were met most often."""
        keep = np.sort(np.argpartition(-self.met, self.most // 2)[: self.most // 2])
        moved = []
        for at, n, pool in ((self.at[keep], self.n[keep], self.pool), (self.from_[keep], self.size[keep], self.bytes)):
            new = np.cumsum(n) - n
            moved += [new, n, pool[np.repeat(at - new, n) + np.arange(int(n.sum()))]]
        self.at, self.n, self.pool, self.from_, self.size, self.bytes = moved
        self.keys, self.met = self.keys[keep], self.met[keep] // 2

    def _learn_units(self, units: list[str]) -> None:
        """Units are encoded side by side in one text; an id that ends a word ends one."""
        texts = [" ".join(units[i : i + 1000]) for i in range(0, len(units), 1000)]
        for k, e in enumerate(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            raw, at, own = ids.tobytes(), (np.flatnonzero(self.closes[ids]) * 4 + 4).tolist(), units[1000 * k : 1000 * k + 1000]
            if len(at) != len(own):
                raise ValueError("a unit isn't one word of the tokenizer")
            self.units.update(zip(own, (raw[s:t] for s, t in zip([0, *at], at))))

    def _encode(self, words: list[bytes], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(at, n): where the ids of ``words``, of plain ones through their units, are in
        ``pool``, to which they are added."""
        if len(self.units) > CACHE_UNITS:
            self.units.clear()
        self.units["\n"] = b""
        ones, others = np.flatnonzero(plain), np.flatnonzero(~plain)
        found = _UNITS.findall(b"".join([words[i] + b"\n" for i in ones.tolist()]).decode().lower())
        self._learn_units(list({u for u in found if u not in self.units}))
        pieces = list(map(self.units.__getitem__, found))
        ends = np.flatnonzero(np.fromiter(map("\n".__eq__, found), bool, len(found)))
        rest = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast([words[i].decode() for i in others.tolist()], add_special_tokens=False)]
        n = np.zeros(len(words), np.int64)
        n[ones] = np.diff(np.r_[0, np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))[ends]]) // 4
        n[others] = [len(x) for x in rest]
        at, order = np.empty(len(words), np.int64), np.r_[ones, others]
        at[order] = len(self.pool) + np.cumsum(n[order]) - n[order]
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(pieces), "<u4"), *rest])
        return at, n

    def _known(self, key: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(where, hit, other): the place of each key, whether it is there, and whether it is
        there, or comes twice, for another word."""
        where = np.searchsorted(self.keys, key)
        hit = self.keys[np.minimum(where, len(self.keys) - 1)] == key if len(self.keys) else np.zeros(len(key), bool)
        long, other = np.flatnonzero(hit & (ends - starts > SHORT)), np.zeros(len(key), bool)
        size = (ends - starts)[long]
        same = self.size[where[long]] == size
        own = np.where(same, size, 0)
        upto = np.cumsum(own)
        step = np.arange(int(own.sum()))
        differs = data[np.repeat(starts[long] - upto + own, own) + step] != self.bytes[np.repeat(self.from_[where[long]] - upto + own, own) + step]
        same[np.searchsorted(upto, np.flatnonzero(differs), "right")] = False
        other[long[~same]] = True
        order = np.argsort(key, kind="stable")
        other[order[1:][key[order[1:]] == key[order[:-1]]]] = True
        return where, hit, other

    def ids(self, data: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): the ids of texts laid end to end, ``end_id`` after each; text i
        has those from bounds[i] to bounds[i + 1]."""
        s, e = spans(data, ends)
        first, word, key = grouped(data, s, e)
        if len(self.keys) > self.most:
            self.forget()
        ws, we = s[first], e[first]
        where, hit, other = self._known(key, data, ws, we)
        new = np.flatnonzero(~hit | other)
        at, n = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
        if len(new):
            raw = data.tobytes()
            words = [raw[a:b] for a, b in zip(ws[new].tolist(), we[new].tolist())]
            at[new], n[new] = self._encode(words, _plain(data, ws[new], we[new]))
            kept = ~other[new]  # those whose key is another word's are encoded each time
            learnt = np.argsort(key[new[kept]], kind="stable")
            now = new[kept][learnt]
            size = we[now] - ws[now]
            places = np.searchsorted(self.keys, key[now])
            upto = np.cumsum(size)
            self.from_ = np.insert(self.from_, places, len(self.bytes) + upto - size)
            self.bytes = np.concatenate([self.bytes, data[np.repeat(ws[now] - upto + size, size) + np.arange(int(size.sum()))]])
            self.keys, self.size = np.insert(self.keys, places, key[now]), np.insert(self.size, places, size)
            self.at, self.n, self.met = np.insert(self.at, places, at[now]), np.insert(self.n, places, n[now]), np.insert(self.met, places, 0)
            where = np.searchsorted(self.keys, key)
        old = np.flatnonzero(~other)
        at[old], n[old] = self.at[where[old]], self.n[where[old]]
        self.met[where[old]] += np.bincount(word, minlength=len(key))[old]
        n = n[word]
        upto = np.cumsum(n)
        out = self.pool[np.repeat(at[word] - upto + n, n) + np.arange(int(upto[-1]) if len(upto) else 0)]
        cuts = np.r_[0, upto][np.searchsorted(s, ends)]  # ids before each text's end
        return np.insert(out, cuts, end_id).astype("<u4"), np.r_[0, cuts + np.arange(1, len(ends) + 1)]


@functools.lru_cache(maxsize=2)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, *, path: str | None = None, seq_len: int = SEQ_LEN, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece of every text."""
    path = path or tokenizer_path()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_ids(path)
        for b in batches:
            for lo, data, ends in blocks(b, 1):
                ids, bounds = words.ids(data, ends, end_id)
                n = np.diff(bounds)
                per = -(-n // seq_len)
                of = np.repeat(np.arange(len(n)), per)
                nth = np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)
                begins = bounds[of] + nth * seq_len
                stops = np.minimum(begins + seq_len, bounds[of + 1])
                raw = ids.tobytes()
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(begins.tolist(), stops.tolist())]
                cols = [b.column(0).slice(lo, len(ends)).take(pa.array(of)), *(pa.array(v, t) for v, t in zip((nth, nth * seq_len, stops - begins, crc), kinds[1:]))]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(np.r_[begins, stops[-1:]].astype(np.int32), ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(cut), schema)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The lengths, with how often each, whose sum is the largest that fits ``room``.

    A bitset subset-sum: bit s is set when some choice sums to s. Lengths come longest
    first and counts in powers of two; it stops as soon as the room can be filled.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        left, m = min(counts[length], room // length), 1
        while left > 0:
            m = min(m, left)
            steps.append((length, m, reach))
            reach |= (reach << (length * m)) & mask
            left, m = left - m, m * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, m, before in reversed(steps):
        if not before >> total & 1:
            total -= length * m
            chosen[length] = chosen.get(length, 0) + m
    return chosen


Row = tuple[int, int, int, int, int]


def by_slack(histogram: dict[int, int], seq_len: int = SEQ_LEN) -> tuple[list[Row], int]:
    """The plan by minimum bin slack, and its bins: each holds the longest piece that is
    left and what fills its room the most."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    ranks, rows, bins = dict.fromkeys(counts, 0), [], 0
    longest = sorted(counts)
    while longest:
        first = longest[-1]
        if not counts[first]:
            longest.pop()
            continue
        counts[first] -= 1
        use = fullest(counts, seq_len - first)
        counts[first] += 1
        use[first] = use.get(first, 0) + 1
        times, offset = min(counts[x] // n for x, n in use.items()), 0
        for length, n in sorted(use.items(), reverse=True):
            rows.append((length, ranks[length], n, bins, offset))
            ranks[length] += times * n
            counts[length] -= times * n
            offset += n * length
        bins += times
    return rows, bins


def first_fit(histogram: dict[int, int], seq_len: int = SEQ_LEN) -> tuple[list[Row], int]:
    """The plan by first-fit decreasing, and its bins, which are kept as runs of equal ones."""
    rows, runs, bins = [], [], 0  # runs: (first bin, bins, room), in order
    counts = {k: v for k, v in histogram.items() if v > 0}
    least = min(counts, default=0)
    for length in sorted(counts, reverse=True):
        left, rank, after = counts[length], 0, []
        for first, n, room in [*runs, (bins, left, seq_len)]:
            each = room // length
            if not left or not each:
                after.append((first, n, room))
                continue
            whole, rest = divmod(min(left, each * n), each)
            for at, many, pieces in ((first, whole, each), (first + whole, min(rest, 1), rest)):
                if many:
                    rows.append((length, rank, pieces, at, seq_len - room))
                    rank, left = rank + many * pieces, left - many * pieces
                    after.append((at, many, room - pieces * length))
            used = whole + (rest > 0)
            if first == bins:
                bins += used
            elif used < n:
                after.append((first + used, n - used, room))
        runs = [r for r in after if r[2] >= least and r[0] < bins]
    return rows, bins


def plan(histogram: dict[int, int], seq_len: int = SEQ_LEN) -> list[Row]:
    """(length, first rank, pieces a bin, first bin, offset) for pieces by rank.

    Ranks r from the first rank on, up to the next row of that length, lie in bin
    ``first + (r - first rank) // pieces`` at ``offset + (r - first rank) % pieces * length``.
    Minimum bin slack, unless it takes more bins than must be and first-fit takes fewer.
    """
    rows, bins = by_slack(histogram, seq_len)
    if bins > -(-sum(k * v for k, v in histogram.items()) // seq_len):
        other, fewer = first_fit(histogram, seq_len)
        rows = other if fewer < bins else rows
    return rows


def pack(cut: DataFrame, *, seq_len: int = SEQ_LEN, salts: int = SALTS) -> DataFrame:
    """``cut`` (a stored table of pieces) with sequence_id and offset."""
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most seq_len rows
    rows = np.array(sorted(plan(histogram, seq_len)), np.int64).reshape(-1, 5)
    shared = cut.sparkSession.sparkContext.broadcast(rows)  # a few rows a length

    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    sums = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    ahead = sums.select("length", "_salt", (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_ahead"))
    own = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("_own", own).join(ahead, ["length", "_salt"])
    ranked = ranked.select(*cut.columns, (F.col("_ahead") + F.col("_own")).cast("long").alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = shared.value
        keys = by[:, 0] * (1 << 45) + by[:, 1]
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(n)).to_numpy() for n in ("length", "_rank"))
            row = by[np.searchsorted(keys, length * (1 << 45) + rank, "right") - 1]
            step = rank - row[:, 1]
            named = [pa.array(row[:, 3] + step // row[:, 2]), pa.array(row[:, 4] + step % row[:, 2] * length)]
            keep = [b.column(i) for i, n in enumerate(b.schema.names) if n != "_rank"]
            yield pa.RecordBatch.from_arrays(keep + named, [n for n in b.schema.names if n != "_rank"] + ["sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(lean(place), schema)


def packed_documents(docs: DataFrame, **options) -> DataFrame:
    return pack(materialize(pieces(docs, **options), "pieces"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return packed_documents(table(spark, sf_dir, "documents"))
