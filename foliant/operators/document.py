"""A document's object graph: cross references, recovery, object streams, streams."""

from __future__ import annotations

import re

from ..functions.crypto import IDENTITY, Decryption
from ..functions.filters import decode
from ..functions.syntax import (
    ARRAY, DICTIONARY, REFERENCE, VALUE, Dictionary, Malformed, Object, array, array_end, dictionary, dictionary_end, find, kind_at, read, skip, unsigned,
)

_DIGITS = re.compile(rb"\d+")
_SECTION_END = (b"\r\nstartxref\r\n", b"\nstartxref\n", b"\rstartxref\r")
_XREF = re.compile(rb"xref\s")
_OBJECT = re.compile(rb"\d+?\s+?\d+?\s+?obj\s")
_ENTRY = re.compile(rb"(\d{10}) .{5} ([nf])[\r\n ]", re.S)
_ENTRY_BYTES = 19
#: Dictionaries that are remembered once they are parsed; those of a larger file are parsed anew.
MOST_REMEMBERED = 4096
_SUBSECTION = re.compile(rb"[^\r\t\n ]*[\r\t\n ]+(\d+)[\r\t\n ]+")
_NUMBER = re.compile(rb"(\d+)[ \r\n\t]")
_GENERATION = re.compile(rb"\S+[ \r\t\n]\D*(\d+)[ \r\t\n]")


def number_at(buf: bytes, at: int) -> tuple[int, int]:
    m = _DIGITS.search(buf, at)
    if not m:
        raise Malformed("no number")
    return int(m.group()), m.end()


def xref_pointer(buf: bytes) -> int:
    """What the last ``startxref`` points to. Without one the document can't be read."""
    at = buf.rfind(b"startxref")
    if at < 0:
        raise Malformed("no startxref")
    at = skip(buf, at + 9)
    m = _DIGITS.match(buf, at)
    if not m or m.end() >= len(buf):
        raise Malformed("startxref has no number")
    if int(m.group()) >= len(buf):
        raise Malformed("startxref points past the end")
    return int(m.group())


def nearest_xref(buf: bytes, at: int) -> int | None:
    """Where the ``xref`` nearest to ``at`` is, that word and a blank, or one before it
    between blanks; the latter if both are as near."""
    ahead = _XREF.search(buf, at)
    behind, end = None, at + 1
    while (i := buf.rfind(b"xref", 0, end)) > 0:
        if i + 4 <= at and buf[i - 1 : i].isspace() and buf[i + 4 : i + 5].isspace():
            behind = i - 1
            break
        end = i + 3
    if ahead is None or behind is None:
        return behind if ahead is None else ahead.start()
    return ahead.start() if ahead.start() - at < at - behind else behind


def sections(buf: bytes, at: int, keyword: bytes) -> list[tuple[int, int]]:
    """(start, end) of cross-reference sections, newest first, along /Prev."""
    out: list[tuple[int, int]] = []
    seen = {at}
    while True:
        end = next((e for e in (buf.find(s, at) for s in _SECTION_END) if e >= 0), None)
        if end is None:
            raise Malformed("a section has no startxref")
        out.append((at, end))
        trailer = dictionary(buf, find(buf, keyword, at) + (len(keyword) if keyword == b"trailer" else 0))
        if b"/Prev" not in trailer:
            return out
        kind, raw = trailer[b"/Prev"]
        if kind != VALUE:
            raise Malformed("/Prev isn't a number")
        at = unsigned(raw)
        if at in seen:
            return out
        seen.add(at)


def table_offsets(buf: bytes, at: int) -> list[int]:
    """Offsets of the entries in use of a classic table."""
    out, at = [], find(buf, b"xref", at) + 4
    while True:
        at = skip(buf, at)
        if buf.startswith(b"trailer", at):
            return out
        m = _SUBSECTION.match(buf, at)
        if not m:
            raise Malformed("a subsection has no count")
        at = m.end()
        for _ in range(int(m[1])):
            entry = _ENTRY.match(buf, at)
            if not entry:
                at = skip(buf, at)
                entry = _ENTRY.match(buf, at)
            if not entry:
                raise Malformed("a damaged table entry")
            if entry[2] == b"n":
                out.append(int(entry[1]))
            at += _ENTRY_BYTES


def widths(props: Dictionary) -> list[int]:
    """The three field widths of a cross-reference stream."""
    kind, raw = props.get(b"/W", (0, b""))
    if kind != ARRAY:
        raise Malformed("/W isn't an array")
    out = [unsigned(n) for n in _DIGITS.findall(raw)]
    if len(out) != 3 or max(out) > 8:
        raise Malformed("/W needs three widths of up to 8 bytes")
    return out


def entry_count(props: Dictionary) -> int:
    if b"/Index" not in props:
        kind, raw = props[b"/Size"]
        if kind != VALUE:
            raise Malformed("/Size isn't a number")
        return unsigned(raw)
    kind, raw = props[b"/Index"]
    pairs = array(raw) if kind == ARRAY else []
    if not pairs:
        raise Malformed("/Index isn't an array of numbers")
    counts = pairs[1::2]
    if any(k != VALUE for k, _ in counts):
        raise Malformed("/Index holds other than numbers")
    return sum(unsigned(r) for _, r in counts)


def entries(stream: bytes, props: Dictionary) -> list[tuple[int, int, int]]:
    """(type, field 2, field 3) rows of a cross-reference stream. A field without width
    is 0, or 1 if it is the type."""
    w = widths(props)
    size, n = sum(w), entry_count(props)
    if size * n > len(stream):
        raise Malformed("the stream has too few entries")
    cuts = (0, w[0], w[0] + w[1], size)
    out = []
    for at in range(0, size * n, size) if size else [0] * n:
        a, b, c = (int.from_bytes(stream[at + s : at + e], "big") for s, e in zip(cuts, cuts[1:]))
        out.append((a if w[0] else 1, b, c))
    return out


def stream_bytes(buf: bytes, at: int, size: int) -> bytes:
    at = find(buf, b"stream", at) + 6
    at += buf[at : at + 1] == b"\r"
    at += buf[at : at + 1] == b"\n"
    return buf[at : at + size]


def stream_offsets(buf: bytes, at: int, compat: bool = True) -> list[int]:
    at = find(buf, b"<<", at)
    end = dictionary_end(buf, at)
    props = dictionary(buf[at:end])
    kind, raw = props.get(b"/Length", (0, b""))
    if kind != VALUE:
        raise Malformed("a cross-reference stream has no direct /Length")
    content = decode(stream_bytes(buf, end, unsigned(raw)), props, compat)
    return [offset for kind, offset, _ in entries(content, props) if kind == 1]


class Document:
    """The objects of one file, by number."""

    def __init__(self, buf: bytes, compat: bool = True):
        self.buf, self.compat = buf, compat
        self.recovered = False
        at = skip(buf, xref_pointer(buf))
        near = nearest_xref(buf, at)
        near = near if near is None else skip(buf, near)
        first_dictionary = buf.find(b"<<", at)
        if near is None and first_dictionary < 0:
            raise Malformed("no cross references")
        self.classic = near is not None and (first_dictionary < 0 or near < first_dictionary)
        self.damaged = self.classic and near != at
        self.at = near if self.classic else at
        self.sections = sections(buf, self.at, b"trailer" if self.classic else b"<<")
        self.offsets = self._scan() if self.damaged else self._indexed()
        self.options = self._encryption()
        self.decryption = Decryption(self.options)
        self.packed: dict[int, Object] = {}
        self.parsed: dict[int, tuple[bytes, int, Dictionary]] = {}  # an object's spelling, where it ends, its entries
        for number in sorted(self.offsets):
            self._unpack(number)

    def _indexed(self) -> dict[int, int]:
        """First definition wins, newest section first. If the index can't be read, the
        file is scanned."""
        try:
            found = []
            for start, _ in self.sections:
                at = skip(self.buf, start)
                found += table_offsets(self.buf, at) if self.buf.startswith(b"xref", at) else stream_offsets(self.buf, at, self.compat)
            if any(o >= len(self.buf) for o in found):
                raise Malformed("an offset past the end")
            out: dict[int, int] = {}
            for offset in found:
                out.setdefault(self._object_number(offset), offset)
            return out
        except (Malformed, KeyError):
            return self._scan()

    def _object_number(self, offset: int) -> int:
        m = _NUMBER.match(self.buf, offset)
        if not m:
            first = _DIGITS.search(self.buf, skip(self.buf, offset))
            m = _NUMBER.match(self.buf, first.start()) if first else None
        if not m:
            raise Malformed("no object at an offset")
        return int(m[1])

    def _scan(self) -> dict[int, int]:
        """Objects by their own headers; of one that is defined twice, the earliest."""
        self.recovered = True
        out: dict[int, int] = {}
        for m in _OBJECT.finditer(self.buf):
            out.setdefault(int(_DIGITS.match(m.group()).group()), m.start())
        return out

    def _encryption(self) -> Dictionary:
        start, end = self.sections[0]
        at = self.buf.find(b"/Encrypt", start)
        if not 0 <= at < end:
            return {}
        kind, at = kind_at(self.buf, at + 8)
        if kind == DICTIONARY:
            out = dictionary(self.buf, at)
        elif kind == REFERENCE:
            kind, raw = self._direct(number_at(self.buf, at)[0])
            if kind != DICTIONARY:
                raise Malformed("/Encrypt isn't a dictionary")
            out = dictionary(raw)
        else:
            raise Malformed("/Encrypt has a wrong type")
        at = find(self.buf, b"/ID", start)
        opens = find(self.buf, b"[", at)
        if at >= end or opens >= end:
            raise Malformed("an encrypted document needs /ID")
        out.setdefault(b"/ID", (ARRAY, self.buf[opens : array_end(self.buf, opens)]))
        return out

    def _direct(self, number: int) -> Object:
        at = find(self.buf, b"obj", self.offsets[number]) + 3
        kind, raw, _ = read(self.buf, at)
        return kind, raw

    def _unpack(self, number: int) -> None:
        """Objects of an object stream; streams of smaller numbers come first."""
        buf, offset = self.buf, self.offsets[number]
        at = skip(buf, offset)
        m = _GENERATION.match(buf, at)
        if not m:
            raise Malformed("an object has no generation")
        plain = at == offset  # no comment that a search from the offset on could find something in
        kind, at = kind_at(buf, find(buf, b"obj", at) + 3)
        if kind != DICTIONARY:
            return
        end = dictionary_end(buf, at)
        raw = buf[at:end]
        props = dictionary(raw)
        if plain and len(self.parsed) < MOST_REMEMBERED and buf.find(b"<<", offset) == at:
            self.parsed[number] = raw, end, props
        if props.get(b"/Type", (0, b""))[1] != b"/ObjStm":
            return
        content = self.decryption(number, int(m[1]), stream_bytes(buf, end, self.length(props, packed=False)))
        content = decode(content, props, self.compat)
        pairs, at = [], 0
        for _ in range(unsigned(props[b"/N"][1])):
            inner, at = number_at(content, at)
            offset, at = number_at(content, at)
            pairs.append((inner, offset))
        first = unsigned(props[b"/First"][1])
        for inner, offset in pairs:
            kind, raw, _ = read(content, first + offset)
            self.packed.setdefault(inner, (kind, raw))

    def __contains__(self, number: int) -> bool:
        return number in self.offsets or number in self.packed

    def get(self, number: int) -> Object:
        """An object by number: one of its own place in the file before one that is
        packed, whatever their age."""
        if number in self.parsed:
            return DICTIONARY, self.parsed[number][0]
        return self._direct(number) if number in self.offsets else self.packed[number]

    def entries(self, number: int, raw: bytes) -> Dictionary:
        """One level of the dictionary that ``get`` found; not to be changed."""
        return self.parsed[number][2] if number in self.parsed else dictionary(raw)

    def resolve(self, value: Object, kind: int | None = None) -> Object:
        if value[0] == REFERENCE:
            value = self.get(number_at(value[1], 0)[0])
        if kind is not None and value[0] != kind:
            raise Malformed("an object of a wrong type")
        return value

    def dictionary(self, value: Object) -> Dictionary:
        return dictionary(self.resolve(value, DICTIONARY)[1])

    def array(self, value: Object) -> list[Object]:
        return array(self.resolve(value, ARRAY)[1])

    def length(self, props: Dictionary, packed: bool = True) -> int:
        kind, raw = props[b"/Length"]
        if kind == REFERENCE:
            number = number_at(raw, 0)[0]
            kind, raw = self.get(number) if packed else self._direct(number)
        if kind != VALUE:
            raise Malformed("/Length isn't a number")
        return unsigned(raw)

    def stream(self, number: int, generation: int) -> bytes:
        """A stream's decrypted and decoded bytes. It must lie in the file itself."""
        kind, raw = self.get(number)
        if kind != DICTIONARY:
            raise Malformed("a stream has no dictionary")
        props = self.entries(number, raw)
        at = self.parsed[number][1] if number in self.parsed else dictionary_end(self.buf, find(self.buf, b"<<", self.offsets[number]))
        content = self.decryption(number, generation, stream_bytes(self.buf, at, self.length(props)))
        return decode(content, props, self.compat) if content else b""

    def trailer(self) -> Dictionary:
        at = self.at
        if self.buf.startswith(b"xref", at):
            at = find(self.buf, b"trailer", at) + 7
        return dictionary(self.buf, at)

    def pages_root(self) -> int:
        kind, raw = self.trailer()[b"/Root"]
        if kind != REFERENCE:
            raise Malformed("/Root isn't a reference")
        kind, raw = self.get(number_at(raw, 0)[0])
        if kind != DICTIONARY:
            raise Malformed("the root isn't a dictionary")
        kind, raw = dictionary(raw)[b"/Pages"]
        if kind != REFERENCE:
            raise Malformed("/Pages isn't a reference")
        return number_at(raw, 0)[0]

    @property
    def encryption(self) -> str | None:
        return self.decryption.method if self.options and self.decryption.method != IDENTITY else None
