"""Layout of one layer in a task: chunks to lines, boxes and reading order.

The same steps as relations are in ``foliant.plans.layout``; both agree exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..functions.syntax import code_points
from .interpreter import Chunk

_F = np.float32
LINE_OVERLAP, CHAR_MARGIN, WORD_MARGIN, LINE_MARGIN, BOXES_FLOW = (_F(v) for v in (0.5, 2.0, 0.1, 0.5, 0.5))
MOST_BOXES = 300
#: Lines whose pairs are compared at once; of more, line by line.
MOST_AT_ONCE = 1000
#: Chunks that are compared one by one with the one before; of more, all at once.
FEW_CHUNKS = 16


@dataclass
class Region:
    """A line, a box or a group of boxes."""

    x0: np.float32
    y0: np.float32
    x1: np.float32
    y1: np.float32
    text: bytes
    length: int

    def cover(self, other) -> None:
        self.x0, self.y0 = min(self.x0, other.x0), min(self.y0, other.y0)
        self.x1, self.y1 = max(self.x1, other.x1), max(self.y1, other.y1)


def aligned(a, b) -> bool:
    """Whether chunk b goes on with the line of the chunk a just before it."""
    if int(a.y0) == int(b.y0) and int(a.y1) == int(b.y1):
        return True
    if not (b.y0 <= a.y1 and a.y0 <= b.y1):
        return False
    shared = min(abs(a.y0 - b.y1), abs(a.y1 - b.y0))
    if not min(a.y1 - a.y0, b.y1 - b.y0) * LINE_OVERLAP < shared:
        return False
    touch = b.x0 <= a.x1 and a.x0 <= b.x1
    gap = _F(0) if touch else min(abs(a.x0 - b.x1), abs(a.x1 - b.x0))
    return bool(gap < max((a.x1 - a.x0) / _F(a.length), (b.x1 - b.x0) / _F(b.length)) * CHAR_MARGIN)


def spaced(a, b) -> bool:
    """Whether a space stands between chunks a and b of a line."""
    size = max(b.y1 - b.y0, (b.x1 - b.x0) / _F(code_points(b.text)))
    return bool(a.x1 < b.x0 - size * WORD_MARGIN)


def _lines_at_once(chunks: list[Chunk]) -> list[Region] | None:
    """``lines`` of chunks that all have a length, or None where ``aligned`` or ``spaced``
    would fail or meet numbers that aren't finite."""
    x0, y0, x1, y1 = corners = np.array([(c.x0, c.y0, c.x1, c.y1) for c in chunks], _F).T
    lengths = np.array([c.length for c in chunks])
    points = np.array([code_points(c.text) for c in chunks])
    if not np.isfinite(corners).all() or not points.all():
        return None
    a, b = slice(None, -1), slice(1, None)
    same = (np.trunc(y0[a]) == np.trunc(y0[b])) & (np.trunc(y1[a]) == np.trunc(y1[b]))
    height, size, wide = y1 - y0, (x1 - x0) / lengths.astype(_F), np.maximum(y1 - y0, (x1 - x0) / points.astype(_F))
    least = lambda lo, hi: np.minimum(np.abs(lo[a] - hi[b]), np.abs(hi[a] - lo[b]))
    shared = (y0[b] <= y1[a]) & (y0[a] <= y1[b]) & (np.minimum(height[a], height[b]) * LINE_OVERLAP < least(y0, y1))
    gap = np.where((x0[b] <= x1[a]) & (x0[a] <= x1[b]), _F(0), least(x0, x1))
    goes_on = same | (shared & (gap < np.maximum(size[a], size[b]) * CHAR_MARGIN))
    space = (goes_on & (x1[a] < x0[b] - wide[b] * WORD_MARGIN)).tolist()
    starts = np.flatnonzero(np.concatenate([[True], ~goes_on]))
    cover = [list(f.reduceat(v, starts)) for f, v in ((np.minimum, x0), (np.minimum, y0), (np.maximum, x1), (np.maximum, y1))]
    pieces = [chunks[0].text, *[b" " + c.text if s else c.text for c, s in zip(chunks[1:], space)]]
    ends = [*starts[1:].tolist(), len(chunks)]
    return [Region(*c, b"".join(pieces[i:j]), n) for *c, i, j, n in zip(*cover, starts.tolist(), ends, np.add.reduceat(lengths, starts).tolist())]


def lines(chunks: list[Chunk]) -> list[Region]:
    shown = [c for c in chunks if c.length]
    if len(shown) > FEW_CHUNKS and (found := _lines_at_once(shown)) is not None:
        return found
    out: list[Region] = []
    last = None
    for c in shown:
        if last is not None and aligned(last, c):
            own = out[-1]
            own.text += (b" " if spaced(last, c) else b"") + c.text
            own.length += c.length
            own.cover(c)
        else:
            out.append(Region(c.x0, c.y0, c.x1, c.y1, c.text, c.length))
        last = c
    return out


def flat(r: Region) -> bool:
    return bool(r.x1 - r.x0 <= 0 or r.y1 - r.y0 <= 0)


def joined_flat(regions: list[Region]) -> list[Region]:
    """Each region without extent takes in all that follow it up to the next one."""
    out: list[Region] = []
    open_flat = False
    for r in regions:
        if open_flat and not flat(r):
            own = out[-1]
            own.text += r.text
            own.length += r.length
            own.cover(r)
        else:
            out.append(Region(r.x0, r.y0, r.x1, r.y1, r.text, r.length))
            open_flat = flat(r)
    return [r for r in out if r.length]


def neighbours(box: np.ndarray, members: np.ndarray) -> np.ndarray:
    """(members, rows): which rows of ``box`` (x0, y0, x1, y1) are next to the members, which
    are places in it or boxes of their own."""
    x0, y0, x1, y1 = box.T
    mx0, my0, mx1, my1 = (members if members.ndim == 2 else box[members]).T[:, :, None]
    height, own = y1 - y0, my1 - my0
    d = LINE_MARGIN * np.maximum(height, own)
    return (
        (np.abs(height - own) < d) & (mx1 > x0) & (mx0 < x1) & (my0 < y1 + d) & (my1 > y0 - d)
        & ((np.abs(x0 - mx0) < d) | (np.abs(x1 - mx1) < d))
    )


def _corners(regions: list[Region]) -> np.ndarray:
    return np.array([(r.x0, r.y0, r.x1, r.y1) for r in regions], _F).reshape(-1, 4)


def components(regions: list[Region]) -> list[list[int]]:
    """Lines next to one another, from each first line outwards, breadth first."""
    corners, free = _corners(regions), np.ones(len(regions), bool)
    n, out = len(regions), []
    few = 0 < n <= MOST_AT_ONCE
    if few:
        rows, near = neighbours(corners, np.arange(n)).nonzero()
        ends, near = np.searchsorted(rows, np.arange(n + 1)).tolist(), near.tolist()
        free = [True] * n
    for seed in range(len(regions)):
        if not free[seed]:
            continue
        free[seed] = False
        members = [seed]
        for i in members:
            if few:
                for k in near[ends[i] : ends[i + 1]]:
                    if free[k]:
                        free[k] = False
                        members.append(k)
                continue
            found = np.flatnonzero(free & neighbours(corners, np.array([i]))[0])
            free[found] = False
            members += found.tolist()
        out.append(members)
    return out


def boxes(regions: list[Region]) -> list[Region]:
    out = []
    for members in components(regions):
        own = list(zip(members, (regions[i] for i in members)))
        if any(flat(r) for _, r in own):
            own = list(enumerate(joined_flat([r for _, r in own])))
        own.sort(key=lambda p: (-p[1].y1, p[1].x0, p[0]))
        box = Region(own[0][1].x0, own[0][1].y0, own[0][1].x1, own[0][1].y1, b"", 1)
        for _, r in own:
            box.text += r.text + b"\n"
            box.length += r.length
            box.cover(r)
        out.append(box)
    return joined_flat(out)


def reading_order(regions: list[Region]) -> list[int]:
    """Boxes in reading order: the two that leave the least empty area in their union
    are joined first, later if another box lies between; the upper left one leads.

    Pairs are entries of a matrix, at the row of the box that was there first or has grown;
    of equal areas the pair that was made first counts."""
    n = len(regions)
    if n > MOST_BOXES or n < 2:
        return list(range(n))
    box = _corners(regions).T * _F([[1], [1], [-1], [-1]])  # all four corners grow downwards; of what is gone: nan
    alive = np.ones(n, bool)
    order = [[i] for i in range(n)]
    keys = (_F(1) - BOXES_FLOW) * box[0] - (_F(1) + BOXES_FLOW) * (box[1] - box[3])
    areas = (box[2] + box[0]) * (box[3] + box[1])
    union = np.minimum(box[:, :, None], box[:, None, :])
    waste = (union[2] + union[0]) * (union[3] + union[1]) - areas[:, None] - areas[None, :]
    now, later = np.where(np.triu(np.ones((n, n), bool), 1), waste, np.inf), None  # pairs not looked at yet, and put off
    made, count = np.arange(n * n).reshape(n, n), n * n  # when a pair was made
    at = now.argmin(1)
    best = [now, now[np.arange(n), at], at], None  # a matrix, of every row the least entry and its place
    for _ in range(n - 1):
        while True:
            m, values, _ = best[0]
            i = int(values.argmin())
            if values[i] == np.inf and later is not None:
                m, values, _ = best[1]
                i = int(values.argmin())
            low = values[i]
            if low == np.inf:  # areas beyond single precision
                return next(order[i] for i in range(n) if alive[i])
            own = (values == low).nonzero()[0]
            r, c = (m[own] == low).nonzero()
            if len(r):
                first_made = made[own[r], c].argmin() if len(r) > 1 else 0
                i, j = int(own[r[first_made]]), int(c[first_made])
            else:  # not a number
                j = int(m[i].argmin())
            a, b = box[:, i], box[:, j]
            cover = np.minimum(a, b)
            if m is later:
                break
            inside = (box >= cover[:, None]).all(0).nonzero()[0]
            if len(inside) < 3:
                break
            of = box[:, inside]
            if not ((of != a[:, None]).any(0) & (of != b[:, None]).any(0)).any():
                break
            if later is None:
                later = np.full((n, n), np.inf, _F)
                best = best[0], [later, later[0].copy(), np.zeros(n, np.int64)]
            later[i, j], now[i, j] = low, np.inf
            at = now[i].argmin()
            values[i], best[0][2][i] = now[i, at], at
            at = later[i].argmin()
            best[1][1][i], best[1][2][i] = later[i, at], at
        first, second = (i, j) if keys[i] <= keys[j] else (j, i)
        order[first] += order[second]
        alive[second] = False
        box[:, first], box[:, second] = cover, np.nan
        keys[first] = (_F(1) - BOXES_FLOW) * cover[0] - (_F(1) + BOXES_FLOW) * (cover[1] - cover[3])
        areas[first] = (cover[2] + cover[0]) * (cover[3] + cover[1])
        wide = np.minimum(box, cover[:, None])
        row = (wide[2] + wide[0]) * (wide[3] + wide[1]) - areas[first] - areas
        row[~alive] = row[first] = np.inf
        for m, values, places in best if later is not None else best[:1]:
            m[first] = row if m is now else np.inf
            m[second] = m[:, first] = m[:, second] = np.inf
            stale = (places == first) | (places == second)
            stale[first] = stale[second] = True
            stale = stale.nonzero()[0]
            places[stale] = at = m[stale].argmin(1)
            values[stale] = m[stale, at]
        made[first] = np.arange(count, count + n)
        count += n
    return next(order[i] for i in range(n) if alive[i])


def render(chunks: list[Chunk]) -> bytes:
    found = boxes(lines(chunks))
    return b"".join(found[i].text for i in reading_order(found))
