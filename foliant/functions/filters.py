"""Stream filters: Flate, LZW, ASCII85, ASCIIHex and the predictors."""

from __future__ import annotations

import zlib

import numpy as np

from .syntax import ARRAY, DICTIONARY, NAME, Dictionary, Malformed, array, dictionary, unsigned

_A85_BLANK = b"\n\r\t \0\f\b\x7f"
_HEX_BLANK = b"\0\t\n\f\r "


def flate(data: bytes) -> bytes:
    """Inflated bytes; of truncated data, what could be read."""
    try:
        return zlib.decompressobj().decompress(data)
    except zlib.error as e:
        raise Malformed(f"inflate: {e}") from e


#: Codes of an LZW run that are cut out of the bits at a time.
_RUN = 4096


def _code_widths(start: int, n: int) -> np.ndarray:
    """Bits of ``n`` codes from the one ``start`` places after a clear on. The table has 258
    entries and from the second code on one more each; codes grow one early."""
    entries = 258 + np.maximum(np.arange(start, start + n) - 1, 0)
    return 9 + (entries + 1 >= 512).astype(np.int64) + (entries + 1 >= 1024) + (entries + 1 >= 2048)


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, which grow one code early; 256 clears, 257 ends."""
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    raw, bits = np.frombuffer(data + bytes(3), np.uint8).astype(np.int64), len(data) * 8
    out: list[bytes] = []
    at = run = 0
    table, last = list(first), None
    while True:
        width = _code_widths(run, _RUN)
        ends = at + np.cumsum(width)
        n = int(np.searchsorted(ends, bits, "right"))
        begins = (ends - width)[:n]
        byte = begins >> 3
        window = raw[byte] << 16 | raw[byte + 1] << 8 | raw[byte + 2]
        codes = window >> (24 - (begins & 7) - width[:n]) & ((1 << width[:n]) - 1)
        special = np.flatnonzero((codes == 256) | (codes == 257))
        stop = int(special[0]) if len(special) else n
        known, push, grow = codes[:stop].tolist(), out.append, table.append
        if last is None and known:
            if known[0] >= len(table):
                raise Malformed("an LZW code is out of range")
            last = table[known.pop(0)]
            push(last)
        for code in known:
            try:
                entry = table[code]
            except IndexError:
                if code != len(table):
                    raise Malformed("an LZW code is out of range") from None
                entry = last + last[:1]
            push(entry)
            grow(last + entry[:1])
            last = entry
        if len(special):
            if codes[stop] == 257:
                return b"".join(out)
            at, run, table, last = int(ends[stop]), 0, list(first), None
        elif n < _RUN:
            return b"".join(out)
        else:
            at, run = int(ends[-1]), run + n


def lzw_encode(data: bytes) -> bytes:
    """LZW codes that ``lzw`` reads."""
    codes, widths, known, width, size, own = [256], [9], {}, 9, 258, -1
    for byte in data:
        if own < 0:
            own = byte
            continue
        longer = known.get(own << 8 | byte)
        if longer is not None:
            own = longer
            continue
        codes.append(own)
        widths.append(width)
        known[own << 8 | byte], size, own = size, size + 1, byte
        if size >= 1 << width and width < 12:
            width += 1
        if size >= 4094:
            codes.append(256)
            widths.append(width)
            known, width, size = {}, 9, 258
    if own >= 0:
        codes.append(own)
        widths.append(width)
        if size + 1 >= 1 << width and width < 12:
            width += 1
    codes.append(257)
    widths.append(width)
    w = np.array(widths)[:, None]
    place = np.arange(12)[None, :]
    ones = (np.array(codes)[:, None] >> np.maximum(w - 1 - place, 0)) & 1
    return np.packbits(ones[place < w].astype(np.uint8)).tobytes()


def up_rows(data: bytes, columns: int) -> bytes:
    """PNG rows of ``columns`` bytes, each as its difference from the one above."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, columns)
    up = np.diff(rows, axis=0, prepend=np.zeros((1, columns), np.uint8))
    return np.concatenate([np.full((len(rows), 1), 2, np.uint8), up], 1).tobytes()


def ascii85(data: bytes, compat: bool = True) -> bytes:
    """Base-85 groups up to ``~>``. A last group of under five digits is lost, unless
    not ``compat``."""
    out, group = bytearray(), []
    at = 0
    for at, c in enumerate(data):
        if c == 0x7E:
            if data[at + 1 : at + 2] not in (b"", b">"):
                raise Malformed("~ isn't followed by >")
            break
        if c in _A85_BLANK:
            continue
        if c == 0x7A:
            if group:
                raise Malformed("z inside a group")
            out += bytes(4)
        elif 0x21 <= c <= 0x75:
            group.append(c - 0x21)
            if len(group) == 5:
                value = 0
                for digit in group:
                    value = value * 85 + digit
                out += (value & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
        else:
            raise Malformed("not a base-85 digit")
    if group and not compat:
        value = 0
        for digit in group + [84] * (5 - len(group)):
            value = value * 85 + digit
        out += (value & 0xFFFFFFFF).to_bytes(4, "big")[: len(group) - 1]
    return bytes(out)


def ascii_hex(data: bytes) -> bytes:
    """Hex digits up to ``>``; a last odd digit is a byte's high half."""
    digits = data.partition(b">")[0].translate(None, _HEX_BLANK)
    if digits.strip(b"0123456789abcdefABCDEF"):
        raise Malformed("not a hex digit")
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def _number(params: Dictionary, key: bytes, default: int) -> int:
    return unsigned(params[key][1]) if key in params else default


def predict(data: bytes, params: Dictionary, compat: bool = True) -> bytes:
    """Undoes a predictor. Paeth rows and TIFF rows of other than 8 bits raise; a last
    row that isn't whole is lost. ``compat`` averages bytes as signed numbers."""
    predictor, colors = _number(params, b"/Predictor", 1), _number(params, b"/Colors", 1)
    depth, columns = _number(params, b"/BitsPerComponent", 8), _number(params, b"/Columns", 1)
    if predictor == 1:
        return data
    step, size = (depth * colors) >> 3, (columns * colors * depth) >> 3
    if size <= 0:
        raise Malformed("rows of no bytes")
    tagged = predictor >= 10
    if predictor == 2 and depth != 8:
        raise Malformed("the TIFF predictor needs 8 bits")
    if predictor == 2:
        rows = np.frombuffer(data, np.uint8, len(data) // size * size).reshape(-1, size).copy()
        for i in range(step):
            rows[:, i::step] = np.cumsum(rows[:, i::step], axis=1, dtype=np.uint8)
        return rows.tobytes()
    row, out = np.zeros(size, np.uint8), []
    for at in range(0, len(data), size + tagged):
        own = np.frombuffer(data[at + tagged : at + tagged + size], np.uint8)
        if len(own) < size:
            if tagged and data[at] in (4, 5) and len(own):
                raise Malformed("this predictor isn't supported")
            break
        kind = data[at] if tagged else -1
        if kind == 0:
            row = own
        elif kind == 1:
            row = own.copy()
            for i in range(step):
                row[i::step] = np.cumsum(own[i::step], dtype=np.uint8)
        elif kind == 2:
            row = row + own
        elif kind == 3:
            new = [0] * size
            above = row.astype(np.int8 if compat else np.int64).tolist()
            for i in range(size):
                left = new[i - step] if i >= step else 0
                if compat and left > 127:
                    left -= 256
                new[i] = ((left + above[i]) >> 1) + int(own[i]) & 255
            row = np.array(new, np.uint8)
        elif kind in (4, 5):
            raise Malformed("this predictor isn't supported")
        out.append(row.tobytes())
    return b"".join(out)


_FILTERS = {b"/FlateDecode": (flate, True), b"/LZWDecode": (lzw, True), b"/ASCII85Decode": (ascii85, False), b"/ASCIIHexDecode": (ascii_hex, False)}


def filter_names(props: Dictionary) -> list[bytes]:
    kind, raw = props[b"/Filter"]
    if kind == NAME:
        return [raw]
    if kind != ARRAY:
        raise Malformed("/Filter is neither a name nor an array")
    return [r for _, r in array(raw)]


def filter_params(props: Dictionary, n: int) -> list[Dictionary]:
    if b"/DecodeParms" not in props:
        return [{}] * n
    kind, raw = props[b"/DecodeParms"]
    if kind == DICTIONARY:
        return [dictionary(raw)]
    if kind != ARRAY:
        raise Malformed("/DecodeParms is neither a dictionary nor an array")
    found = [dictionary(r) for k, r in array(raw) if k == DICTIONARY]
    if not found:
        raise Malformed("/DecodeParms has no dictionary")
    return found


def decode(content: bytes, props: Dictionary, compat: bool = True) -> bytes:
    """``content`` through its filters, in order. Every filter needs its parameters."""
    if b"/Filter" not in props:
        return content
    names = filter_names(props)
    params = filter_params(props, len(names))
    if len(names) != len(params):
        if compat:
            raise Malformed("filters and their parameters differ in number")
        params = (params + [{}] * len(names))[: len(names)]
    for name, own in zip(names, params):
        if name not in _FILTERS:
            raise Malformed(f"unknown filter {name!r}")
        run, predicted = _FILTERS[name]
        content = run(content)
        if predicted and own:
            content = predict(content, own, compat)
    return content
