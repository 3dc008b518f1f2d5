"""Maps from codes to text: ToUnicode CMaps and TrueType ``cmap`` tables."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

from .syntax import Malformed, read, skip, token, unsigned

_TOKEN = re.compile(rb"<([^>]*)>|\[([^\]]*)\]")
_WORD = re.compile(rb"%[^\n]*|[^ \t\n\r]+")
_START, _FIRST_DIGIT = re.compile(rb"[<\[]"), re.compile(rb"\d[^ \t\n]*")
#: A code and its text, both plain hex.
_PLAIN = re.compile(rb"<((?:[0-9a-fA-F]{2})++)>[ \t\r\n]*+<((?:[0-9a-fA-F]{2})++)>")
_HEX_RUN = re.compile(rb"[0-9a-fA-F][^ \t]*")
#: Codes longer than this aren't legal.
LONGEST = 4


@dataclass
class CharMap:
    """Text by code. ``sizes``: the code lengths to try, in order."""

    text: dict[bytes, bytes] = field(default_factory=dict)
    sizes: list[int] = field(default_factory=list)
    vertical: bool = False

    def add(self, code: bytes, text: bytes) -> None:
        if len(code) > LONGEST:
            raise Malformed("a code of more than four bytes")
        self.text.setdefault(code, text)

    def next(self, raw: bytes, at: int) -> tuple[bytes, bytes] | None:
        """(code, text) of the next code that is known, or None."""
        for n in self.sizes:
            if len(raw) - at < n:
                break
            code = raw[at : at + n]
            if code in self.text:
                return code, self.text[code]
        return None


def number_bytes(n: int) -> bytes:
    """Big-endian bytes of a number, two at least."""
    return n.to_bytes(max(2, (n.bit_length() + 7) // 8), "big")


def _utf8(utf16: bytes) -> bytes:
    return utf16.decode("utf-16-be", "ignore").encode()


def _hex_bytes(body: bytes) -> bytes:
    if len(body) % 2 == 0 and body.isalnum():
        try:
            return bytes.fromhex(body.decode("ascii"))
        except ValueError:
            pass  # the digits may be hex up to some place, which the loop finds
    out = b""
    for run in _HEX_RUN.findall(body):
        for i in range(0, len(run), 2):
            try:
                out += bytes([int(run[i : i + 2], 16)])
            except ValueError as e:
                raise Malformed("not hex") from e
    return out


def _next(buf: bytes, at: int) -> tuple[str, bytes, int]:
    """(kind, body, end) of the next hex string or array, or else number."""
    m = _START.search(buf, at)
    if m:
        m = _TOKEN.match(buf, m.start())
        if not m:
            raise Malformed("a token isn't closed")
        kind, body = ("hex", m[1]) if m[1] is not None else ("array", m[2])
        end = m.end() - 1
    else:
        m = _FIRST_DIGIT.search(buf, at)
        if not m:
            raise Malformed("no number")
        kind, body, end = "number", m.group(), m.end()
    if not body:
        raise Malformed("an empty token")
    return kind, body, end


def _bytes_of(kind: str, body: bytes) -> bytes:
    if kind == "array":
        raise Malformed("an array in place of a string")
    if kind == "number":
        return number_bytes(unsigned(body))
    out = _hex_bytes(body)
    if not _HEX_RUN.search(body):
        raise Malformed("no hex digits")
    return out


def _codes(first: bytes, last: bytes):
    """Codes from first to last, which count up as numbers and keep first's width."""
    n, end, width = int.from_bytes(first, "big"), int.from_bytes(last, "big"), len(first)
    while n <= end:
        yield n.to_bytes(max(width, (n.bit_length() + 7) // 8), "big")
        n += 1


def _range(buf: bytes, at: int, out: CharMap, sizes: set[int]) -> int:
    kind, body, at = _next(buf, at)
    first = _bytes_of(kind, body)
    kind, body, at = _next(buf, at)
    last = _bytes_of(kind, body)
    kind, body, at = _next(buf, at)
    if not first:
        raise Malformed("an empty code")
    if kind == "array":
        inner = 0
        for code in _codes(first, last):
            k, b, inner = _next(body, inner)
            out.add(code, _utf8(_bytes_of(k, b)))
            sizes.add(len(code))
    else:
        text = _bytes_of(kind, body)
        if not text:
            raise Malformed("a range has no text")
        for step, code in enumerate(_codes(first, last)):
            byte = text[-1] + step
            out.add(code, _utf8(text[:-1] + bytes([byte])))
            sizes.add(len(code))
            if byte == 255:
                break
    return at + 1


def _char(buf: bytes, at: int, out: CharMap, sizes: set[int]) -> int:
    if m := _PLAIN.match(buf, at):
        code = bytes.fromhex(m[1].decode())
        out.add(code, _utf8(bytes.fromhex(m[2].decode())))
        sizes.add(len(code))
        return m.end()
    pair = []
    for _ in range(2):
        try:
            kind, body, at = _next(buf, at)
            pair.append(_bytes_of(kind, body))
        except Malformed:
            pair.append(None)
    if None not in pair:
        out.add(pair[0], _utf8(pair[1]))
        sizes.add(len(pair[0]))
    return at + 1


def to_unicode(stream: bytes) -> CharMap:
    """A ToUnicode CMap: its bfchar and bfrange sections and its writing mode. Shorter
    codes are tried first."""
    out, sizes, state, at = CharMap(), set(), None, 0
    states = {b"beginbfchar": _char, b"beginbfrange": _range, b"endbfchar": None, b"endbfrange": None, b"/WMode": "mode"}
    while m := _WORD.search(stream, at):
        word, at = m.group(), m.end()
        if word in states:
            state = states[word]
        elif state == "mode":
            _, raw, at = read(stream, m.start())
            out.vertical, state = unsigned(raw) == 1, None
        elif state is not None and not word.startswith(b"%"):
            at = state(stream, m.start(), out, sizes)
        if at > len(stream) - 2:
            break
    out.sizes = sorted(sizes - {0})
    return out


def type1(stream: bytes) -> CharMap:
    """The clear text of a Type 1 font is read up to its encrypted part, but its codes
    have no length that is tried, so every byte falls back to the font's encoding."""
    at = skip(stream, 0, strict=False)
    last = b""
    while at < len(stream):
        word, at = token(stream, at)
        if word == b"eexec" and last == b"currentfile":
            break
        last, at = word, skip(stream, at, strict=False)
    return CharMap(sizes=[0] * (LONGEST + 1))


class _Reader:
    def __init__(self, data: bytes):
        self.data = data

    def get(self, layout: str, at: int) -> tuple[int, ...]:
        try:
            return struct.unpack_from(">" + layout, self.data, at)
        except struct.error as e:
            raise Malformed("the font ends early") from e


def _raw(code: int) -> bytes:
    """A character's code as its bytes, without leading zeros."""
    return code.to_bytes((code.bit_length() + 7) // 8, "big")


def _segments(r: _Reader, at: int, out: CharMap) -> None:
    n = r.get("H", at + 6)[0] // 2
    ends, starts = r.get(f"{n}H", at + 14), r.get(f"{n}H", at + 16 + 2 * n)
    deltas, offsets = r.get(f"{n}h", at + 16 + 4 * n), r.get(f"{n}H", at + 16 + 6 * n)
    base = at + 16 + 6 * n
    for first, last, delta, offset in zip(starts, ends, deltas, offsets):
        if last == 0xFFFF:
            continue
        for i, c in enumerate(range(first, last + 1)):
            glyph = r.get("H", base + offset + 2 * i)[0] + delta if offset else c + delta
            out.text.setdefault(number_bytes(glyph & 0xFFFFFFFF), _raw(c))


def truetype(stream: bytes) -> CharMap:
    """Codes of all subtables of a TrueType font's ``cmap``: glyph numbers as codes.

    The text is the character's raw bytes. Only formats 0, 4 and 6 make codes (of two
    bytes) that are tried.
    """
    r = _Reader(stream)
    tables = r.get("H", 4)[0]
    at = next((12 + 16 * i for i in range(tables) if stream[12 + 16 * i : 16 + 16 * i] == b"cmap"), None)
    out = CharMap()
    if at is None:
        return out
    table = r.get("I", at + 8)[0]
    two = False
    for i in range(r.get("H", table + 2)[0]):
        sub = table + r.get("I", table + 4 + 8 * i + 4)[0]
        form = r.get("H", sub)[0]
        if form == 0:
            two = True
            for c, g in enumerate(r.get("256B", sub + 6)):
                out.text.setdefault(bytes([g]), _utf8(number_bytes(c)))
        elif form == 2:
            keys = r.get("256H", sub + 6)
            lead = {k // 8: c for c, k in enumerate(keys)}
            for h in range(max(keys) // 8 + 1):
                here = sub + 518 + 8 * h
                first, count, delta, offset = r.get("HHhH", here)
                for j in range(count):
                    glyph = r.get("H", here + 6 + offset)[0]
                    glyph = (glyph + delta) & 0xFFFF if glyph else 0
                    out.text.setdefault(number_bytes(glyph), _raw((first + (lead.get(h, 0) << 8) & 0xFFFF) + j))
        elif form == 4:
            two = True
            _segments(r, sub, out)
        elif form == 6:
            two = True
            first, count = r.get("HH", sub + 6)
            for i, g in enumerate(r.get(f"{count}H", sub + 10)):
                out.text.setdefault(number_bytes(g), _utf8(number_bytes(i + first)))
        elif form == 12:
            for first, last, glyph in (r.get("III", sub + 16 + 12 * k) for k in range(r.get("I", sub + 12)[0])):
                if last - first > 0x10FFFF:
                    raise Malformed("a group of too many characters")
                for c in range(first, last + 1):
                    out.text.setdefault(number_bytes((c + glyph) & 0xFFFFFFFF), _raw(c))
    # Lengths of zero, which only the empty code would match, take the other places.
    out.sizes = [2] + [0] * LONGEST if two else [0] * (LONGEST + 1)
    return out


__all__ = ["CharMap", "number_bytes", "to_unicode", "truetype", "type1"]
