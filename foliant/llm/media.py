"""Media columns: AVI motion-JPEG with lossless intra frames, and shot detection.

A payload of 8-bit samples becomes grey frames of 16 x 12 samples. Each frame is a
JPEG image of the lossless process (SOF3, predictor 1) with a restart marker after
every line; frames lie in the ``movi`` list of an AVI file and are listed in its
``idx1`` index. Reading goes by that index: headers are parsed, lines are the restart
intervals, and all lines of all frames at hand are decoded side by side, one sample
of each line at a time. Frames of the baseline process (SOF0; one component, or three
with any sampling, with the standard Huffman tables if they have none) are decoded one
by one, block by block.

Shots: 16-bin histograms of successive frames' brightness are compared; a frame opens a
shot when its difference passes a floor and the mean of the last differences that opened
none by a multiple of their deviation. Each shot is one timed clip.

Defined results: a null or empty text is one frame of spaces; repeated rows give equal
values; texts of any length are stored whole; a media cell that is null, isn't such a
file or is damaged gives null features, no clips and, unless it is null, an error;
an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table

WIDTH, HEIGHT = 16, 12
FRAME = WIDTH * HEIGHT
FPS = 25
BINS = 16
#: Shots: frames looked back on, deviations above their mean, least difference (of 1).
LOOK_BACK, DEVIATIONS, FLOOR = 8, 3.0, 0.25
#: Payload bytes that are encoded or decoded at a time.
BLOCK = 1 << 20

#: What reading a damaged file can raise.
ERRORS = (ValueError, IndexError, KeyError, OverflowError, MemoryError, struct.error)

#: Code lengths of the difference categories 0 to 8.
_LENGTHS = (4, 4, 4, 3, 3, 3, 3, 3, 4)


def canonical(symbols: list[int], per_length: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a JPEG Huffman table: codes count up, length by length."""
    out, code, at = [], 0, 0
    for length, n in enumerate(per_length, 1):
        for s in symbols[at : at + n]:
            out.append((s, code, length))
            code += 1
        at, code = at + n, code << 1
    return out


_SYMBOLS = sorted(range(9), key=lambda s: (_LENGTHS[s], s))
_PER_LENGTH = [sum(x == n for x in _LENGTHS) for n in range(1, 17)]
_CODES = canonical(_SYMBOLS, _PER_LENGTH)


def _encoder() -> tuple[np.ndarray, np.ndarray]:
    """By difference + 255: the code with its extra bits, and the bits in all."""
    bits, size = np.zeros(511, np.int64), np.zeros(511, np.int64)
    by = {s: (c, n) for s, c, n in _CODES}
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code, n = by[s]
        extra = d if d >= 0 else d + (1 << s) - 1
        bits[d + 255], size[d + 255] = code << s | extra, n + s
    return bits, size


_BITS, _SIZE = _encoder()


def jpeg_header(width: int = WIDTH, height: int = HEIGHT) -> bytes:
    dht = bytes([0]) + bytes(_PER_LENGTH) + bytes(_SYMBOLS)
    sof = struct.pack(">BHHBBBB", 8, height, width, 1, 1, 0x11, 0)
    sos = bytes([1, 1, 0, 1, 0, 0])  # one component, table 0, predictor 1
    part = lambda marker, body: b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body
    return b"\xff\xd8" + part(0xC4, dht) + part(0xC3, sof) + part(0xDD, struct.pack(">H", width)) + part(0xDA, sos)


def _avi_head(frames: int, movi: int) -> bytes:
    """Everything before the frames' chunks. movi: bytes of these chunks."""
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body
    avih = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, frames, 0, 1, 0, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, frames, 0, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    strl = chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + strl)
    size = 4 + len(hdrl) + 12 + movi + 8 + 16 * frames
    return b"RIFF" + struct.pack("<I", size) + b"AVI " + hdrl + b"LIST" + struct.pack("<I", movi + 4) + b"movi"


def padded(text: bytes) -> bytes:
    return text + b" " * (-len(text) % FRAME or (FRAME if not text else 0))


def encode_frames(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends): the JPEG images of consecutive frames, laid end to end."""
    lines = samples.reshape(-1, WIDTH).astype(np.int64)
    diff = np.diff(lines, axis=1, prepend=128).ravel() + 255
    bits, size = _BITS[diff], _SIZE[diff]
    per_line = size.reshape(-1, WIDTH).sum(axis=1)
    n_bytes = (per_line + 7) >> 3
    first = np.cumsum(n_bytes) - n_bytes
    inside = np.cumsum(size) - size
    inside -= np.repeat(inside[::WIDTH], WIDTH)
    at = np.repeat(first * 8, WIDTH) + inside
    total = int(n_bytes.sum())
    aligned = bits << (24 - size - (at & 7))
    raw = np.zeros(total + 3, np.float64)
    for k, shift in enumerate((16, 8, 0)):
        raw += np.bincount((at >> 3) + k, (aligned >> shift) & 255, total + 3)
    raw = raw[:total].astype(np.uint8)
    raw[first + n_bytes - 1] |= ((1 << (-per_line & 7)) - 1).astype(np.uint8)  # lines end in ones

    head = np.frombuffer(jpeg_header(), np.uint8)
    ff = raw == 255
    stuffed = np.r_[0, np.cumsum(ff)]
    line_bytes = n_bytes + stuffed[first + n_bytes] - stuffed[first]
    n_frames = len(lines) // HEIGHT
    opens = np.zeros(len(lines), np.int64)
    opens[::HEIGHT] = len(head)
    ends = np.cumsum(opens + line_bytes + 2)
    starts = ends - 2 - line_bytes
    out = np.zeros(int(ends[-1]), np.uint8)
    where = np.arange(total) + np.repeat(starts - first, n_bytes) + (stuffed[:-1] - np.repeat(stuffed[first], n_bytes))
    out[where] = raw  # a 255 is followed by a 0
    out[ends - 2] = 255
    mark = 0xD0 + (np.arange(len(lines)) % HEIGHT % 8)
    mark[HEIGHT - 1 :: HEIGHT] = 0xD9
    out[ends - 1] = mark
    out[(starts[::HEIGHT] - len(head))[:, None] + np.arange(len(head))] = head
    assert len(ends) == n_frames * HEIGHT
    return out, ends[HEIGHT - 1 :: HEIGHT]


def avi_files(payloads: list[bytes]) -> list[bytes]:
    """An AVI file of each payload (a positive multiple of FRAME bytes)."""
    data, ends = encode_frames(np.frombuffer(b"".join(payloads), np.uint8))
    raw, files, at, lo = data.tobytes(), [], 0, 0
    for p in payloads:
        n = len(p) // FRAME
        upto = ends[at : at + n]
        begin = np.r_[lo, upto[:-1]]
        size = upto - begin
        chunk = size + (size & 1) + 8
        offset = 4 + np.cumsum(chunk) - chunk
        parts = [_avi_head(n, int(chunk.sum()))]
        for b, s in zip(begin.tolist(), size.tolist()):
            parts += (b"00dc", s.to_bytes(4, "little"), raw[b : b + s], b"\0" * (s & 1))
        index = np.empty((n, 4), "<u4")
        index[:, 0], index[:, 1], index[:, 2], index[:, 3] = int.from_bytes(b"00dc", "little"), 0x10, offset, size
        parts += (b"idx1", struct.pack("<I", 16 * n), index.tobytes())
        files.append(b"".join(parts))
        at, lo = at + n, int(upto[-1])
    return files


@dataclass
class Avi:
    width: int
    height: int
    seconds_a_frame: float
    starts: np.ndarray  # of each frame's image in the file
    sizes: np.ndarray


def parse_avi(data: bytes) -> Avi | None:
    """The file's video frames as its index lists them; without an index, as the chunks
    of ``movi`` follow. None if it isn't an AVI file with motion JPEG."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        return None
    width = height = 0
    pace, codec, movi, index = 0.0, b"", None, None
    at = 12
    stack = [(at, len(data))]
    while stack:
        at, end = stack.pop()
        while at + 8 <= end:
            name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            body = at + 8
            if name == b"LIST":
                kind = data[body : body + 4]
                if kind == b"movi":
                    movi = (body, min(body + size, end))
                else:
                    stack.append((body + size + (size & 1), end))
                    at, end = body + 4, min(body + size, end)
                    continue
            elif name == b"avih":
                pace = int.from_bytes(data[body : body + 4], "little") / 1e6
            elif name == b"strf" and not codec:
                width, height = struct.unpack_from("<ii", data, body + 4)
                codec = data[body + 16 : body + 20]
            elif name == b"idx1":
                index = np.frombuffer(data, "<u4", size // 16 * 4, body).reshape(-1, 4)
            at = body + size + (size & 1)
    if movi is None or codec.upper() not in (b"MJPG", b"LJPG"):
        return None
    if index is not None:
        video = index[(index[:, 0] >> 16) == int.from_bytes(b"dc", "little")]
        starts, sizes = video[:, 2].astype(np.int64), video[:, 3].astype(np.int64)
        base = movi[0] if len(starts) and data[movi[0] + starts[0] : movi[0] + starts[0] + 4] == b"00dc" else 0
        return Avi(width, abs(height), pace, starts + base + 8, sizes)
    starts_, sizes_, at = [], [], movi[0] + 4
    while at + 8 <= movi[1]:
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at + 2 : at + 4] == b"dc":
            starts_.append(at + 8)
            sizes_.append(size)
        at += 8 + size + (size & 1)
    return Avi(width, abs(height), pace, np.array(starts_, np.int64), np.array(sizes_, np.int64))


# The published standard Huffman tables for baseline frames that bring none,
# by table class and number: codes of each length, and the first symbols. The symbols that
# follow are all others (run of up to 15, size of 1 to 10), in ascending order.
_STANDARD = {
    0x00: ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], "000102030405060708090a0b"),
    0x01: ([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0], "000102030405060708090a0b"),
    0x10: ([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125], "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282"),
    0x11: ([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119], "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f1"),
}


@functools.cache
def standard_tables() -> dict[int, list[tuple[int, int, int]]]:
    out = {}
    for k, (per, head) in _STANDARD.items():
        symbols = list(bytes.fromhex(head))
        if k & 0x10:
            symbols += [r << 4 | s for r in range(16) for s in range(1, 11) if r << 4 | s not in symbols]
        out[k] = canonical(symbols, per)
    return out


@dataclass
class Image:
    process: int  # the SOF marker's low byte
    width: int
    height: int
    interval: int
    huffman: dict[int, list[tuple[int, int, int]]]
    quant: dict[int, np.ndarray]
    frame: bytes
    scan: bytes
    length: int  # of all headers


def parse_jpeg(data: bytes) -> Image:
    """The headers of an image up to its first scan."""
    huffman, quant, frame, interval, at = {}, {}, b"", 0, 2
    process = width = height = 0
    while True:
        if data[at] != 0xFF:
            raise ValueError("no marker")
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        if marker == 0xC4:
            while body:
                per = list(body[1:17])
                huffman[body[0]] = canonical(list(body[17 : 17 + sum(per)]), per)
                body = body[17 + sum(per) :]
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int64)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        elif marker in (0xC0, 0xC1, 0xC3):
            process, frame = marker & 15, body
            height, width = struct.unpack_from(">HH", body, 1)
        elif marker == 0xDA:
            return Image(process, width, height, interval, huffman, quant, frame, body, at + 2 + size)
        elif 0xC2 <= marker <= 0xCF:
            raise ValueError(f"process {marker:02x} isn't supported")
        at += 2 + size


def _lookup(codes: list[tuple[int, int, int]]) -> np.ndarray:
    """By the next 16 bits: difference * 32 + bits used (0: no such code)."""
    out = np.zeros(1 << 16, np.int32)
    for s, code, n in codes:
        if n + s <= 16 and s <= 8:
            for extra in range(1 << s):
                d = extra if not s or extra >> (s - 1) else extra - (1 << s) + 1
                lo = (code << s | extra) << (16 - n - s)
                out[lo : lo + (1 << (16 - n - s))] = d * 32 + n + s
    return out


def decode_lossless(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, image: Image) -> np.ndarray:
    """(frames, height, width) samples of frames whose scans lie at begins..ends of
    ``data`` and whose headers equal those of ``image``: one line a restart interval."""
    if image.interval != image.width or image.scan[3] != 1 or image.frame[5] != 1:
        raise ValueError("only one component, predictor 1 and a restart after each line are supported")
    n = ends - begins
    keep = np.repeat(begins - (np.cumsum(n) - n), n) + np.arange(n.sum())
    scan = data[keep]
    nxt = np.r_[scan[1:], np.uint8(0)]
    ff = scan == 255
    is_mark = ff & (nxt >= 0xD0) & (nxt <= 0xD9)
    stuffing = np.r_[False, ff[:-1]] & (scan == 0)
    closing = np.r_[False, is_mark[:-1]]
    drop = stuffing | is_mark | closing
    kept = np.cumsum(~drop)
    clean = np.r_[scan[~drop], np.zeros(8, np.uint8)].astype(np.uint32)
    after = np.flatnonzero(closing)  # each line ends in a marker
    first = np.r_[0, kept[after[:-1]]] if len(after) else np.zeros(0, np.int64)
    if len(first) != image.height * len(begins):
        raise ValueError("lines are missing")
    window = (clean[:-3] << 24) | (clean[1:-2] << 16) | (clean[2:-1] << 8) | clean[3:]
    codes = _lookup(image.huffman[image.scan[2] >> 4])
    pos = first.astype(np.int64) * 8
    last = np.full(len(pos), 128, np.int32)
    out = np.empty((image.width, len(pos)), np.uint8)
    for x in range(image.width):
        got = codes[(window[pos >> 3] << (pos & 7).astype(np.uint32)) >> 16]
        pos += got & 31
        last += got >> 5
        out[x] = last
    return np.ascontiguousarray(out.T).reshape(len(begins), image.height, image.width)


def _zigzag() -> np.ndarray:
    """Places (row * 8 + column) in the order of a JPEG block's coefficients."""
    return np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8)))


@functools.lru_cache(maxsize=64)
def _symbols(codes: tuple[tuple[int, int, int], ...]) -> list[int]:
    """By the next 16 bits: symbol * 32 + bits used (0: no such code)."""
    out = np.zeros(1 << 16, np.int32)
    for s, code, n in codes:
        out[code << (16 - n) : (code + 1) << (16 - n)] = s * 32 + n
    return out.tolist()


def _coefficients(part: bytes, units: list[tuple[int, list[int], list[int]]], most: int) -> list[tuple[int, int, int]]:
    """(block of the interval, place in zigzag order, value) of all coefficients of one
    restart interval. units: (component, DC and AC symbols) of the blocks of an MCU."""
    out, block, at, held, bits = [], 0, 0, 0, 0
    last = [0] * 256
    for _ in range(most):
        if at >= len(part) + 8:
            raise ValueError("a frame ends early")
        for component, dc, ac in units:
            k = 0
            while k < 64:
                while bits < 32:
                    held = (held << 8 | (part[at] if at < len(part) else 0)) & 0xFFFFFFFFFF
                    at, bits = at + 1, bits + 8
                got = (ac if k else dc)[held >> (bits - 16) & 0xFFFF]
                if not got:
                    raise ValueError("no such code")
                symbol, bits = got >> 5, bits - (got & 31)
                size = symbol & 15
                if k and not size and symbol != 0xF0:
                    break
                k += symbol >> 4 if k else 0
                if size:
                    bits -= size
                    v = held >> bits & ((1 << size) - 1)
                    v = v if v >> (size - 1) else v - (1 << size) + 1
                    if k:
                        out.append((block, k, v))
                    else:
                        last[component] += v
                if not k:
                    out.append((block, 0, last[component]))
                k += 1
            block += 1
    return out


def decode_baseline(data: bytes, image: Image) -> np.ndarray:
    """(height, width) samples of a one-component baseline image, or (height, width, 3)
    red, green and blue ones: Huffman, dequantise, inverse cosine transform."""
    parts = [image.frame[6 + 3 * i : 9 + 3 * i] for i in range(image.frame[5])]
    used = image.scan[0]
    if len(parts) not in (1, 3) or used != len(parts):
        raise ValueError("only one or three components, in one scan, are supported")
    end = data.rfind(b"\xff\xd9")
    scan = data[image.length : end if end >= image.length else len(data)]
    huffman = standard_tables() | image.huffman
    by_id = {image.scan[1 + 2 * i]: image.scan[2 + 2 * i] for i in range(used)}
    grain = [(p[1] >> 4, p[1] & 15) if used > 1 else (1, 1) for p in parts]
    if any(not 1 <= v <= 4 for g in grain for v in g):
        raise ValueError("a wrong sampling factor")
    wide, high = max(h for h, _ in grain), max(v for _, v in grain)
    across, down = -(-image.width // (8 * wide)), -(-image.height // (8 * high))
    units, spots = [], []
    for c, (p, (h, v)) in enumerate(zip(parts, grain)):
        tables = by_id[p[0]]
        dc, ac = (_symbols(tuple(huffman[k])) for k in (tables >> 4, 16 | tables & 15))
        units += [(c, dc, ac)] * (h * v)
        spots += [(c, y, x) for y in range(v) for x in range(h)]
    total, at, begin = across * down, 0, 0
    if total * len(units) * 2 > len(scan) * 8:
        raise ValueError("a frame ends early")
    blocks = np.zeros((total * len(units), 64))
    order = _zigzag()
    while begin < total:  # restart intervals
        hit = at
        while (hit := scan.find(b"\xff", hit)) >= 0 and not 0xD0 <= scan[hit + 1 : hit + 2][0] <= 0xD7:
            hit += 2
        part = scan[at : hit if hit >= 0 else len(scan)].replace(b"\xff\x00", b"\xff")
        n = min(image.interval or total, total - begin)
        found = np.array(_coefficients(part, units, n), np.int64).reshape(-1, 3)
        blocks[begin * len(units) + found[:, 0], order[found[:, 1]]] = found[:, 2]
        begin, at = begin + n, hit + 2
        if hit < 0 and begin < total:
            raise ValueError("a frame ends early")
    u = np.arange(8)
    base = np.cos((2 * u[:, None] + 1) * u[None, :] * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)[None, :]
    blocks, planes = blocks.reshape(total, len(units), 64), []
    for c, (p, (h, v)) in enumerate(zip(parts, grain)):
        quant = np.zeros(64)
        quant[order] = image.quant[p[2]]
        own = blocks[:, [i for i, spot in enumerate(spots) if spot[0] == c]] * quant
        pixels = base @ own.reshape(-1, 8, 8) @ base.T + 128
        grid = pixels.reshape(down, across, v, h, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(down * v * 8, across * h * 8)
        planes.append(grid.repeat(high // v, 0).repeat(wide // h, 1)[: image.height, : image.width])
    if len({p.shape for p in planes}) > 1:
        raise ValueError("a wrong sampling factor")
    if len(planes) == 3:
        y, blue, red = planes[0], planes[1] - 128, planes[2] - 128
        planes = [np.stack([y + 1.402 * red, y - 0.344136 * blue - 0.714136 * red, y + 1.772 * blue], 2)]
    return np.clip(np.rint(planes[0]), 0, 255).astype(np.uint8)


def _frames(data: np.ndarray, avi: Avi) -> np.ndarray:
    """The frames of one file, one by one."""
    own = []
    for b, size in zip(avi.starts.tolist(), avi.sizes.tolist()):
        raw = data[b : b + size]
        image = parse_jpeg(raw.tobytes())
        if image.process == 3:
            own.append(decode_lossless(raw, np.array([image.length]), np.array([len(raw)]), image)[0])
        else:
            own.append(decode_baseline(raw.tobytes(), image))
    return np.stack(own) if own else np.zeros((0, 1, 1), np.uint8)


def read_frames(files: list[bytes]) -> tuple[list[Avi | None], list[np.ndarray], list[str | None]]:
    """Per file its index, its decoded frames (frames, height, width, perhaps 3) and what is
    wrong with it; a file that can't be read has no index. Lossless frames with equal
    headers are decoded together, over all files."""
    found: list[Avi | None] = []
    errors: list[str | None] = []
    for f in files:
        avi, error = None, "not an AVI file with motion JPEG"
        try:
            avi = parse_avi(f)
            if avi is not None and len(avi.starts) and (int(avi.starts.min()) < 0 or int((avi.starts + avi.sizes).max()) > len(f)):
                avi, error = None, "a frame lies outside the file"
        except ERRORS as e:
            error = f"{type(e).__name__}: {e}"
        found.append(avi)
        errors.append(None if avi is not None else error)
    data = np.frombuffer(b"".join(files), np.uint8)
    base = np.cumsum([0] + [len(f) for f in files])[:-1]
    parts = [np.zeros((0, 1, 1), np.uint8)] * len(files)
    whole = [i for i, a in enumerate(found) if a is not None and len(a.starts)]
    if not whole:
        return found, parts, errors
    begins = np.concatenate([found[i].starts + base[i] for i in whole])
    ends = begins + np.concatenate([found[i].sizes for i in whole])
    counts = [len(found[i].starts) for i in whole]
    try:
        model = parse_jpeg(data[begins[0] : ends[0]].tobytes())
        head = data[begins[0] : begins[0] + model.length]
        alike = model.process == 3 and int((ends - begins).min()) > model.length
        if alike and bool((data[begins[:, None] + np.arange(model.length)] == head).all()):
            frames = decode_lossless(data, begins + model.length, ends, model)
            for i, p in zip(whole, np.split(frames, np.cumsum(counts)[:-1])):
                parts[i] = p
            return found, parts, errors
    except ERRORS:
        pass  # one of them is damaged: each for itself
    for i in whole:
        try:
            parts[i] = _frames(data[base[i] : base[i] + len(files[i])], found[i])
        except ERRORS as e:
            found[i], errors[i] = None, f"{type(e).__name__}: {e}"
    return found, parts, errors


def shot_starts(frames: np.ndarray) -> np.ndarray:
    """The frames that open a shot, frame 0 among them."""
    n = len(frames)
    if n == 0:
        return np.zeros(0, np.int64)
    if frames.ndim == 4:  # brightness of colours
        frames = (frames @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)
    flat = frames.reshape(n, -1)
    level = np.arange(n)[:, None] * BINS + (flat.astype(np.int64) * BINS >> 8)
    hist = np.bincount(level.ravel(), minlength=n * BINS).reshape(n, BINS)
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1) / (2 * flat.shape[1])
    calm: deque[float] = deque(maxlen=LOOK_BACK)  # the last differences that open no shot
    cuts, seen, values = [0], 0, diff.tolist()
    for i in np.flatnonzero(diff > FLOOR).tolist():
        calm.extend(values[max(seen, i - LOOK_BACK) : i])
        seen, m = i + 1, max(len(calm), 1)
        mean = sum(calm) / m
        spread = (sum((v - mean) ** 2 for v in calm) / m) ** 0.5
        if values[i] > mean + DEVIATIONS * spread:
            cuts.append(i + 1)
        else:
            calm.append(values[i])
    return np.array(cuts, np.int64)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: every whole text as an AVI file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1).cast(pa.binary()).to_pylist()
            lo, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t or b"")
                if size >= BLOCK or i + 1 == len(texts):
                    own = [t or b"" for t in texts[lo : i + 1]]
                    files = avi_files([padded(t) for t in own])
                    yield pa.RecordBatch.from_arrays([ids.slice(lo, len(own)), pa.array([len(t) for t in own], pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])
                    lo, size = i + 1, 0

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _read(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes | None], list[Avi | None], list[np.ndarray], list[str | None]]]:
    cells, lo, size = batch.column(column).to_pylist(), 0, 0
    for i, c in enumerate(cells):
        size += len(c or b"")
        if size >= 2 * BLOCK or i + 1 == len(cells):
            own = cells[lo : i + 1]
            yield lo, own, *read_frames([c or b"" for c in own])
            lo, size = i + 1, 0


def features(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what reading ``media`` gives: payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, feature (frames, shots and their starts), clips
    (start_s and end_s of each shot) and error."""
    clip = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips", "error"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), clip, pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, cells, found, frames, errors in _read(b, 2):
                cols: list[list] = [[] for _ in names[2:]]
                for c, a, f, error in zip(cells, found, frames, errors):
                    row = [None] * 7 + [error if c is not None else None]
                    if a is not None:
                        payload, cuts = f.tobytes(), shot_starts(f)
                        times = [{"start_s": s * a.seconds_a_frame, "end_s": e * a.seconds_a_frame} for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(f)])]
                        row = [
                            len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(c), hashlib.sha256(c).hexdigest(),
                            f"{a.width}x{a.height} frames={len(f)} shots={len(cuts)} starts={','.join(map(str, cuts))}", times, None,
                        ]
                    for col, v in zip(cols, row):
                        col.append(v)
                own = [b.column(0).slice(lo, len(cells)), b.column(1).slice(lo, len(cells))]
                yield pa.RecordBatch.from_arrays(own + [pa.array(c, k) for c, k in zip(cols, kinds[2:])], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips array<struct<start_s:double,end_s:double>>, error string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def clips(media: DataFrame) -> DataFrame:
    """doc_id, clip, first_frame, last_frame, start_s, end_s: one row a detected shot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, found, frames, _ in _read(b, 1):
                rows = []
                for doc, a, f in zip(b.column(0).slice(lo, len(found)).to_pylist(), found, frames):
                    cuts = shot_starts(f) if a is not None else np.zeros(0, np.int64)
                    for i, (s, e) in enumerate(zip(cuts.tolist(), np.r_[cuts[1:], len(f)].tolist())):
                        rows.append((doc, i, s, e - 1, s * a.seconds_a_frame, e * a.seconds_a_frame))
                cols = list(zip(*rows)) or [()] * 6
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "clip", "first_frame", "last_frame", "start_s", "end_s"])

    schema = "doc_id long, clip int, first_frame long, last_frame long, start_s double, end_s double"
    return media.select(F.col("doc_id").cast("long"), "media").mapInArrow(run, schema)


def op1_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as an AVI file and read back: hashes, sizes and timed clips."""
    return features(store(table(spark, sf_dir, "documents")))
