"""Words of many texts at a time: spans, exact groups and 64-bit hashes in numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled at a time.
BLOCK = 1 << 20

_U = np.uint64
_rng = np.random.default_rng(9)
#: A random number for every byte; FOLDED gives A-Z those of a-z.
EXACT = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
FOLDED = EXACT.copy()
FOLDED[65:91] = EXACT[97:123]
_BASE = int(_rng.integers(1, 1 << 62)) * 2 + 1

#: Bytes with A-Z as a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: ASCII white space: 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Bytes of a word that fit into a key with their number; masks of 0 to 8 bytes.
SHORT = 7
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class _Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, kept for blocks of usual size."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) >= n:
            return self.up[:n], self.down[:n]
        inverse = pow(_BASE, -1, 1 << 64)
        both = [np.multiply.accumulate(np.r_[_U(1), np.full(n - 1, b, np.uint64)]) for b in (_BASE, inverse)]
        if n <= 2 * BLOCK:
            self.up, self.down = both
        return both[0], both[1]


_powers = _Powers()


def blocks(batch: pa.RecordBatch, column: int, size: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, ends) of consecutive texts of about ``size`` bytes each time;
    text i of a block ends at ``ends[i]`` of its bytes. Null texts are empty."""
    texts = batch.column(column).cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo + 1 : hi + 1] - offsets[lo]
        lo = hi


def spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of all words of texts laid end to end; none crosses two texts."""
    space = SPACE[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[np.r_[0, ends]] = True
    first = ~space
    first[1:] &= space[:-1] | begins[1:-1]
    last = ~space
    last[:-1] &= space[1:] | begins[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, byte: np.ndarray = FOLDED) -> np.ndarray:
    """64-bit hashes of the spans: polynomials in the bytes' numbers, finalised. Quick, but
    different long words can be built that collide: ``grouped`` compares the bytes."""
    up, down = _powers.get(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte[data] * up[: len(data)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _lanes(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as one number; zeros follow the end."""
    return np.ndarray((len(data) + 1,), "<u8", np.r_[data, np.zeros(8, np.uint8)], strides=(1,))


def grouped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, group, key): spans of equal bytes are one group; ``first`` has a span of each.
    The key of up to SHORT bytes is these bytes and their number. Longer spans have hashes,
    which only propose groups: their bytes are compared."""
    n, lane = ends - starts, _lanes(data)
    key = lane[starts] & _MASK[np.minimum(n, SHORT)] | (np.minimum(n, 255).astype(np.uint64) << _U(56))
    long = np.flatnonzero(n > SHORT)
    if len(long):
        key[long] = hashes(data, starts[long], ends[long], EXACT) | (_U(255) << _U(56))
    key, first, group = np.unique(key, return_index=True, return_inverse=True)
    i, wrong = long[first[group[long]] != long], []
    r = first[group[i]]
    if len(i) and (n[i].max() > 256 or (n[i] != n[r]).any()):
        wrong += [x for x, y in zip(i.tolist(), r.tolist()) if n[x] != n[y] or n[x] > 256 and (data[starts[x] : ends[x]] != data[starts[y] : ends[y]]).any()]
    on, at = (n[i] == n[r]) & (n[i] <= 256), 0
    while on.any():
        i, r = i[on], r[on]
        differs = (lane[starts[i] + at] ^ lane[starts[r] + at]) & _MASK[np.minimum(n[i] - at, 8)] != 0
        wrong += i[differs].tolist()
        at += 8
        on = ~differs & (n[i] > at)
    for g in sorted({int(group[x]) for x in wrong}):  # one hash, several words
        known: dict[bytes, int] = {}
        for x in np.flatnonzero(group == g).tolist():
            to = known.setdefault(data[starts[x] : ends[x]].tobytes(), len(first) if known else g)
            if to == len(first):
                first, key = np.append(first, x), np.append(key, key[g])
            group[x] = to
    return first, group, key


def strong_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans whose keys ``grouped`` gave. Those of short spans never
    collide; longer ones have 64 bits of BLAKE2b, so none that collide can be built short
    of trying some 2^32."""
    out, long = mixed(key), np.flatnonzero(ends - starts > SHORT)
    raw, digest = data.tobytes(), hashlib.blake2b
    each = [digest(raw[s:e], digest_size=8).digest() for s, e in zip(starts[long].tolist(), ends[long].tolist())]
    out[long] = np.frombuffer(b"".join(each), np.uint64)
    return out
