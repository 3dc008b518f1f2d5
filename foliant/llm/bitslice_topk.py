"""Exact top-k inner products over a bit-sliced index.

Vectors are quantised to integers, floor(64 * x). A block of rows keeps one bitmap per
bit of each dimension. For a query, the score of all rows of a block is summed by
bitmap arithmetic alone: each set bit of a weight adds the dimension's slices, shifted,
through carry-save adders; negative weights add complements. The k best rows are then
selected from the most significant sum slice downward; rows that tie at the boundary
have equal exact scores and are resolved by the smaller id.

The stated queries meet all rows in a grid: groups of query chunks by groups of row
blocks, joined by cell, so a block is sent to one cell in every GROUP chunks of queries
and a chunk to one in every GROUP blocks. Each cell returns its k best rows a query,
and these are merged by rank.

Slices have as many bits as a block's values need. Vectors whose products could leave
64 bits (wide ones) have blocks and chunks of their own, with Python's integers in
place of machine words around the same bitmaps.

Defined results: rows without an id, with a null vector, an empty one, or one that
holds a null or non-finite component take no part; a query is an id, and where its rows
repeat it is the one with the smallest vector; candidates are all rows with another id,
repeated ones too; vectors meet those of their own length only; a query with fewer than
k candidates gets all; a score beyond 64 bits is ranked exactly and returned as the
nearest long; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import materialize, table

K = 20
SCALE = 64
QUERY_EVERY = 20
BLOCK_ROWS = 8192
CHUNK_QUERIES = 128
#: Blocks, and query chunks, that a cell of the grid holds at most on average.
GROUP = 16
#: Bits of a score that machine words hold, and bytes of one that they don't.
WORD, LONG_BYTES = 58, 272

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def participants(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, dim, x (array<double>), wide and a number of every row that takes part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long"), x.alias("x")).filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0))
    most = F.array_max(F.transform("x", F.abs)) * scale + 1
    wide = most * most * F.size("x") >= float(1 << WORD)
    return rows.filter(fine).select("vec_id", F.size("x").alias("dim"), "x", wide.alias("wide"), F.monotonically_increasing_id().alias("n"))


def quantised(x: np.ndarray, wide: bool, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x): as long, or where ``wide`` as Python's integers."""
    if not wide:
        return np.floor(x * scale).astype(np.int64)
    out = np.empty(x.shape, object)
    out.ravel()[:] = [math.floor(v * scale) if abs(v) < 1e300 else int(v) * scale for v in x.ravel().tolist()]
    return out


def _bit(values: np.ndarray, i: int) -> np.ndarray:
    if values.dtype == object:
        return np.array([v >> i & 1 for v in values.tolist()], np.uint64)
    return (values >> np.uint64(i)) & np.uint64(1)


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    return np.array([int(m).bit_length() for m in values.max(axis=0)], np.int64)


def slices(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lows, bits, bitmaps) of integer rows ``x``: value = low + sum of 2^i * bitmap i."""
    n, dims = x.shape
    lows = x.min(axis=0)
    rest = x - lows
    rest = rest if x.dtype == object else rest.astype(np.uint64)
    bits = _bit_lengths(rest)
    words = -(-n // 64)
    maps = np.zeros((int(bits.sum()), words * 8), np.uint8)
    at = 0
    for d in range(dims):
        for i in range(bits[d]):
            own = np.packbits(_bit(rest[:, d], i).astype(np.uint8), bitorder="little")
            maps[at, : len(own)] = own
            at += 1
    return lows, bits, maps.view(np.uint64)


class _Sum:
    """A bit-sliced sum: bitmaps are added at a weight, three of a weight are reduced
    to one and a carry."""

    def __init__(self):
        self.held: dict[int, list[np.ndarray]] = {}

    def add(self, weight: int, bitmap: np.ndarray) -> None:
        while True:
            own = self.held.setdefault(weight, [])
            own.append(bitmap)
            if len(own) < 3:
                return
            a, b, c = own
            half = a ^ b
            self.held[weight] = [half ^ c]
            weight, bitmap = weight + 1, (a & b) | (half & c)

    def result(self, shape: tuple[int, int]) -> list[np.ndarray]:
        out, weight = [], 0
        while self.held and weight <= max(self.held):
            own = self.held.get(weight, [])
            if len(own) == 2:
                self.held[weight] = [own[0] ^ own[1]]
                self.held.setdefault(weight + 1, []).append(own[0] & own[1])
                if len(self.held[weight + 1]) == 3:
                    third = self.held[weight + 1].pop()
                    self.add(weight + 1, third)
            out.append(self.held[weight][0] if self.held.get(weight) else np.zeros(shape, np.uint64))
            weight += 1
        return out


def scored(q: np.ndarray, bits: np.ndarray, maps: np.ndarray) -> list[np.ndarray]:
    """Sum slices, lowest first, of |q| times the slices (or, below 0, complements)."""
    total, shape, at = _Sum(), (len(q), maps.shape[1]), 0
    size = np.abs(q) if q.dtype == object else np.abs(q).astype(np.uint64)
    lengths = _bit_lengths(size)
    for d in range(q.shape[1]):
        flip = np.where(q[:, d] < 0, _ALL, np.uint64(0))[:, None]
        signed = [maps[at + i][None, :] ^ flip for i in range(bits[d])]
        at += bits[d]
        for j in range(lengths[d]):
            on = np.where(_bit(size[:, d], j) == 1, _ALL, np.uint64(0))[:, None]
            for i, s in enumerate(signed):
                total.add(i + j, s & on)
    return total.result(shape)


def select(sums: list[np.ndarray], valid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the rows that are surely among the k best, and of those that tie."""
    sure, tied = np.zeros_like(valid), valid.copy()
    for s in reversed(sums):
        hit = tied & s
        some = np.bitwise_count(sure | hit).sum(axis=1)[:, None]
        many = some > k
        sure = np.where(many, sure, sure | hit)
        tied = np.where(many, hit, tied & ~s)
    return sure, tied


def _rows(bitmap: np.ndarray) -> np.ndarray:
    return np.unpackbits(bitmap.view(np.uint8), axis=1, bitorder="little")


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, lows: np.ndarray, bits: np.ndarray, maps: np.ndarray, k: int):
    """(query, row id, score) arrays: for each query its k best rows of a block. ``ids``
    ascend, so that among ties the first rows are those of the smaller ids."""
    sums = scored(q, bits, maps)
    n = len(ids)
    valid = np.zeros((len(q), maps.shape[1] * 64), np.uint8)
    valid[:, :n] = 1
    own, upto = np.searchsorted(ids, q_ids), np.searchsorted(ids, q_ids, "right")
    for i in np.flatnonzero(upto > own):
        valid[i, own[i] : upto[i]] = 0
    sure, tied = select(sums, np.packbits(valid, axis=1, bitorder="little").view(np.uint64), k)
    left = k - np.bitwise_count(sure).sum(axis=1).astype(np.int64)
    take = _rows(sure)
    ties = _rows(tied)
    ties &= np.cumsum(ties, axis=1, dtype=np.int64) <= left[:, None]
    qi, row = np.nonzero(take | ties)
    kind = object if q.dtype == object or lows.dtype == object else np.int64
    score = np.zeros(len(qi), kind)
    for w, s in enumerate(sums):
        score += ((s[qi, row >> 6] >> (row & 63).astype(np.uint64)) & np.uint64(1)).astype(kind) << w
    full = (np.ones(len(bits), kind) << bits.astype(kind)) - 1
    base = (q * lows[None, :]).sum(axis=1) + (np.minimum(q, 0) * full[None, :]).sum(axis=1)
    return q_ids[qi], ids[row], score + base[qi]


def _matrix(t: pa.Table, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    ids = t.column("vec_id").to_numpy()
    flat = t.column("x").combine_chunks()
    flat = (flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat).flatten().to_numpy().reshape(-1, dim)
    order = np.argsort(ids, kind="stable")
    return ids[order], quantised(flat[order], t.column("wide")[0].as_py(), scale)


def _packed(values: np.ndarray) -> bytes:
    return pickle.dumps(values.tolist()) if values.dtype == object else np.ascontiguousarray(values).tobytes()


def _unpacked(raw: bytes, wide: bool) -> np.ndarray:
    return np.array(pickle.loads(raw), object) if wide else np.frombuffer(raw, np.int64)


def _dealt(rows: DataFrame, name: str, n: int, seed: int, names: list[str], build) -> DataFrame:
    """One row for each of ``n`` parts of each kind of vector: dim, wide, the part's number
    ``name`` and the binary columns that ``build`` makes of its ids and values."""

    def run(t: pa.Table) -> pa.Table:
        keys = {c: t.column(c).slice(0, 1) for c in ("dim", "wide", name)}
        cells = build(t, t.column("dim")[0].as_py())
        return pa.table(keys | {c: pa.array([v], pa.binary()) for c, v in zip(names, cells)})

    dealt = rows.withColumn(name, F.pmod(F.xxhash64(F.lit(seed), "n"), F.lit(n)).cast("int"))
    return dealt.groupBy("dim", "wide", name).applyInArrow(run, f"dim int, wide boolean, {name} int, " + ", ".join(f"{c} binary" for c in names))


def block_index(rows: DataFrame, n_blocks: int, scale: int = SCALE) -> DataFrame:
    """One row a block: dim, wide, block, ids, lows, bits and bitmaps as binary columns."""

    def build(t: pa.Table, dim: int) -> list[bytes]:
        ids, x = _matrix(t, dim, scale)
        lows, bits, maps = slices(x)
        return [ids.tobytes(), _packed(lows), bits.tobytes(), np.ascontiguousarray(maps).tobytes()]

    return _dealt(rows, "block", n_blocks, 1, ["ids", "lows", "bits", "maps"], build)


def query_chunks(rows: DataFrame, n_chunks: int, scale: int = SCALE) -> DataFrame:
    """One row a chunk of queries: dim, wide, chunk, q_ids and q as binary columns."""

    def build(t: pa.Table, dim: int) -> list[bytes]:
        ids, q = _matrix(t, dim, scale)
        return [ids.tobytes(), _packed(q)]

    return _dealt(rows, "chunk", n_chunks, 7, ["q_ids", "q"], build)


def grid(n_blocks: int, n_chunks: int, cells: int) -> tuple[int, int]:
    """Groups of blocks and of chunks: ``cells`` of them at least, if there can be. Blocks
    are the larger, so their groups are split first, which copies chunks only."""
    down, across = -(-n_blocks // GROUP), -(-n_chunks // GROUP)
    down = min(n_blocks, max(down, -(-cells // across)))
    return down, min(n_chunks, max(across, -(-cells // down)))


def top_k(vectors: DataFrame, is_query, *, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where ``is_query`` its k best others."""
    rows = materialize(participants(vectors, scale), "topk-rows")
    q = F.transform("x", lambda v: F.floor(v * scale).cast("long"))
    asked = rows.filter(is_query).groupBy("vec_id").agg(F.min_by(F.struct("dim", "x", "wide", "n"), F.struct("dim", q)).alias("r")).select("vec_id", "r.*")
    n_blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    n_chunks = max(1, -(-asked.count() // CHUNK_QUERIES))
    down, across = grid(n_blocks, n_chunks, 4 * rows.sparkSession.sparkContext.defaultParallelism)
    blocks = block_index(rows, n_blocks, scale).withColumn("row", F.col("block") % down).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    chunks = query_chunks(asked, n_chunks, scale).withColumn("col", F.col("chunk") % across).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    chunks = chunks.withColumnRenamed("wide", "q_wide")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                dim, q_wide, wide, q_ids, q, ids, lows, bits, maps = (b.column(i)[r].as_py() for i in range(b.num_columns))
                q_ids, ids, bits = (np.frombuffer(c, np.int64) for c in (q_ids, ids, bits))
                maps = np.frombuffer(maps, np.uint64).reshape(int(bits.sum()), -(-len(ids) // 64))
                asked, found, score = best(q_ids, _unpacked(q, q_wide).reshape(-1, dim), ids, _unpacked(lows, wide), bits, maps, k)
                long, most = [None] * len(score), (1 << 63) - 1
                if score.dtype == object:
                    long = [(s + (1 << 8 * LONG_BYTES - 1)).to_bytes(LONG_BYTES, "big") if abs(s) >= most else None for s in score]
                    score = np.array([min(max(s, -most), most) for s in score], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(found), pa.array(score), pa.array(long, pa.binary())], ["query_id", "vec_id", "score", "long"])

    cells = chunks.join(blocks, ["dim", "row", "col"]).select("dim", "q_wide", "wide", "q_ids", "q", "ids", "lows", "bits", "maps")
    found = cells.mapInArrow(run, "query_id long, vec_id long, score long, long binary")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("long").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 best rows of every 20th vector."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), a AS (
  SELECT vec_id, q FROM v WHERE vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY len(q), q) = 1
), c AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum([p[1] * p[2] FOR p IN list_zip(a.q, b.q)]) AS BIGINT) AS score
  FROM a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), r AS (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM c
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
