"""Fonts of a resource dictionary: metrics, and text from string bytes."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ..functions import charmaps, encodings, glyphs
from ..functions.syntax import ARRAY, DICTIONARY, NAME, REFERENCE, VALUE, Dictionary, Malformed, Object, array, code_points, dictionary, real, reference, unsigned
from .document import Document

_F = np.float32
_BASES = {b"/StandardEncoding": encodings.STANDARD, b"/MacRomanEncoding": encodings.MAC, b"/MacExpertEncoding": encodings.EXPERT, b"/WinAnsiEncoding": encodings.WIN}
_THOUSANDTH = _F(0.001)
#: Codes of a string that are looked up one by one; those of longer ones in arrays.
FEW_CODES = 24


def float_of(props: Dictionary, key: bytes, default: float) -> np.float32:
    return real(props[key][1]) if key in props else _F(default)


def summed(values: np.ndarray) -> np.float32:
    """The sum from left to right, each step rounded."""
    return np.cumsum(values, dtype=_F)[-1] if len(values) else _F(0)


@dataclass
class Font:
    """What showing text needs to know of one font."""

    props: Dictionary
    widths: dict[int, float] = field(default_factory=dict)
    default_width: np.float32 = _F(0)
    ascent: np.float32 = _F(0)
    descent: np.float32 = _F(0)
    height: np.float32 = _F(0)
    scale: tuple[np.float32, np.float32] = (_THOUSANDTH, _THOUSANDTH)
    bytes_width: np.ndarray | None = None
    code_width: dict[int, np.float32] = field(default_factory=dict)
    decoder: "Decoder | None" = None

    @property
    def subtype(self) -> bytes:
        return self.props[b"/Subtype"][1]

    @property
    def base(self) -> str:
        return self.props.get(b"/BaseFont", (0, b""))[1].decode("latin-1").removeprefix("/")

    def width(self, code: int) -> np.float32:
        return _F(self.widths.get(code, self.default_width)) * self.scale[0]

    def width_of(self, codes) -> np.float32:
        """The widths' sum, added one by one in single precision."""
        if isinstance(codes, bytes) and len(codes) > FEW_CODES:
            if self.bytes_width is None:
                self.bytes_width = np.array([self.width(c) for c in range(256)], _F)
            return summed(self.bytes_width[np.frombuffer(codes, np.uint8)])
        known = self.code_width
        for c in set(codes).difference(known):
            known[c] = self.width(c)
        return summed(np.array([known[c] for c in codes], _F))


def _cid_widths(doc: Document, value: Object) -> dict[int, float]:
    """``c [w ...]`` and ``first last w`` runs; of a code that repeats, the smallest."""
    items = [doc.resolve(v) for v in doc.array(value)]
    out: dict[int, float] = {}
    at = 0
    while at < len(items):
        if at + 1 >= len(items):
            raise Malformed("/W ends early")
        first, (kind, raw) = unsigned(items[at][1]), items[at + 1]
        if kind == ARRAY:
            pairs, at = [(first + i, real(r)) for i, (_, r) in enumerate(array(raw))], at + 2
        elif kind == VALUE:
            if at + 2 >= len(items):
                raise Malformed("/W ends early")
            last, w = unsigned(raw), real(items[at + 2][1])
            if last - first > 0x10FFFF:
                raise Malformed("/W has too long a run")
            pairs, at = [(c, w) for c in range(first, last + 1)], at + 3
        else:
            raise Malformed("/W holds other than numbers and arrays")
        for code, w in pairs:
            out[code] = min(w, out.get(code, w))
    return out


def load_font(doc: Document, value: Object) -> Font:
    """A font with its metrics. A composite font takes what it lacks from its one
    descendant."""
    props = doc.dictionary(value)
    subtype = props[b"/Subtype"][1]
    font = Font(props)
    if subtype == b"/Type3":
        kind, raw = props[b"/FontMatrix"]
        numbers = array(raw) if kind == ARRAY else []
        if len(numbers) != 6 or any(k != VALUE for k, _ in numbers):
            raise Malformed("/FontMatrix isn't six numbers")
        a, b, c, d, _, _ = (real(r) for _, r in numbers)
        font.scale = (a + c, b + d)
    if subtype == b"/Type0":
        inner = doc.array(props[b"/DescendantFonts"])
        if len(inner) != 1:
            raise Malformed("a composite font needs one descendant")
        font.props = props = doc.dictionary(inner[0]) | props
    described = doc.dictionary(props[b"/FontDescriptor"]) if b"/FontDescriptor" in props else {}
    core = encodings.core_font(font.base, doc.compat)
    if subtype in (b"/CIDFontType0", b"/CIDFontType2", b"/Type0"):
        font.default_width = float_of(props, b"/DW", 1000)
        if b"/W" in props:
            font.widths = _cid_widths(doc, props[b"/W"])
        elif core:
            font.widths = core[0]
    else:
        first = unsigned(props[b"/FirstChar"][1]) if b"/FirstChar" in props else 0
        font.default_width = float_of(described, b"/MissingWidth", 0)
        if b"/Widths" in props:
            font.widths = {first + i: real(doc.resolve(v)[1]) for i, v in enumerate(doc.array(props[b"/Widths"]))}
        elif core:
            font.widths = core[0]
    box = doc.array(props[b"/FontBBox"]) if subtype == b"/Type3" and b"/FontBBox" in props else None
    metrics = core[1] if core else (0, 0, 0)
    font.height = _F(metrics[2])
    if b"/FontBBox" in described:
        corners = doc.array(described[b"/FontBBox"])
        font.height = real(corners[3][1]) - real(corners[1][1])
    for name, corner, index, known in (("descent", b"/Descent", 1, metrics[1]), ("ascent", b"/Ascent", 3, metrics[0])):
        if corner in described:
            metric = real(described[corner][1])
        elif box is not None:
            metric = real(box[index][1])
        else:
            metric = _F(known)
        setattr(font, name, metric)
    return font


class Fonts:
    """The fonts of one resource dictionary, the current one and the text rise."""

    def __init__(self, doc: Document, props: Dictionary | None = None):
        self.fonts = {name: load_font(doc, value) for name, value in (props or {}).items()}
        self.current, self.rise = b"", _F(0)

    def copy(self) -> "Fonts":
        out = Fonts.__new__(Fonts)
        out.fonts, out.current, out.rise = self.fonts, self.current, self.rise
        return out

    @property
    def font(self) -> Font:
        if self.current not in self.fonts:
            raise Malformed(f"no font {self.current!r}")
        return self.fonts[self.current]


class Decoder:
    """Bytes of shown strings to UTF-8, with their width in text space."""

    def __init__(self, doc: Document, props: Dictionary, cache: dict[int, charmaps.CharMap]):
        self.compat, self.known_font, self.known = doc.compat, None, {}
        self.points = self.wide = None  # by two-byte code: its one character (0: not known yet), its width
        encoding = doc.resolve(props[b"/Encoding"]) if b"/Encoding" in props else None
        if encoding and encoding[0] not in (DICTIONARY, NAME):
            raise Malformed("/Encoding has a wrong type")
        self.name, self.differences = "", None
        if encoding and encoding[0] == NAME:
            self.name = encoding[1].decode("latin-1")
        elif encoding:
            own = dictionary(encoding[1])
            if b"/Differences" in own:
                self.differences = self._differences(doc, own)
            else:
                self.name = own.get(b"/BaseEncoding", (0, b""))[1].decode("latin-1")
        known = _BASES.get(self.name.encode("latin-1"))
        if known == encodings.STANDARD and self.compat:
            known = None  # this name is read as two-byte codes
        stem = self.name.removeprefix("/")
        self.table = encodings.single_byte(known or encodings.STANDARD, self.compat)
        self.single = known is not None or not self.name
        self.two_bytes = not self.single and stem not in encodings.charsets()
        self.codec = None if self.single else "utf-16-be" if self.two_bytes else encodings.charsets()[stem]
        self.map = self._map(doc, props, cache)
        self.vertical = encodings.is_vertical(stem) or (self.map is not None and self.map.vertical)

    def _differences(self, doc: Document, own: Dictionary) -> dict[int, str]:
        base = own.get(b"/BaseEncoding", (0, b"/StandardEncoding"))[1]
        if base not in _BASES:
            raise Malformed(f"unknown base encoding {base!r}")
        table = dict(encodings.single_byte(_BASES[base], self.compat))
        items = doc.array(own[b"/Differences"])
        start = next((i for i, (k, _) in enumerate(items) if k == VALUE), len(items))
        code = 0
        for kind, raw in (doc.resolve(v) for v in items[start:]):
            if kind == VALUE:
                code = unsigned(raw)
            elif kind == NAME:
                text = glyphs.glyph(raw[1:].decode("latin-1"))
                if text is not None:
                    table[code] = text
                code += 1
            else:
                raise Malformed("/Differences holds other than codes and names")
        return table

    def _map(self, doc: Document, props: Dictionary, cache: dict[int, charmaps.CharMap]) -> charmaps.CharMap | None:
        def loaded(value: Object, build) -> charmaps.CharMap:
            number, generation = reference(value[1])
            if number not in cache:
                cache[number] = build(doc.stream(number, generation))
            return cache[number]

        if b"/ToUnicode" in props:
            kind = props[b"/ToUnicode"][0]
            if kind == NAME:
                return None
            if kind != REFERENCE:
                raise Malformed("/ToUnicode has a wrong type")
            return loaded(props[b"/ToUnicode"], charmaps.to_unicode)
        if b"/FontDescriptor" not in props:
            return None
        described = doc.dictionary(props[b"/FontDescriptor"])
        if b"/FontFile" in described and b"/Encoding" not in props:
            return loaded(described[b"/FontFile"], charmaps.type1)
        if b"/FontFile2" in described:
            return loaded(described[b"/FontFile2"], charmaps.truetype)
        return None

    @property
    def source(self) -> str:
        if self.map is not None:
            return "map"
        return "differences" if self.differences is not None else "encoding"

    def text(self, raw: bytes, font: Font) -> tuple[bytes, int, np.float32]:
        """(UTF-8, length that character spacing counts, width)."""
        if self.map is not None:
            return self._mapped(raw, font)
        if self.differences is not None:
            shown = [c for c in raw if self.differences.get(c)]
            return "".join(self.differences[c] for c in shown).encode(), len(raw), font.width_of(bytes(shown))
        if self.single:
            return "".join(self.table.get(c, "") for c in raw).encode(), len(raw), font.width_of(raw)
        if self.codec is None:
            return raw, len(raw), font.width_of(raw)
        try:
            text = encodings.decoded(raw, self.codec).encode("utf-8", "ignore")
        except LookupError as e:
            raise Malformed(f"charset {self.codec} isn't available") from e
        codes = [int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw), 2)] if self.two_bytes else raw
        return text, len(raw), font.width_of(codes)

    def texts(self, raws: list[bytes], font: Font) -> list[tuple[bytes, int, np.float32]]:
        """``text`` of many strings."""
        sizes = [len(r) // 2 for r in raws]
        found = self._looked_up(b"".join(raws), font) if self.map is not None and not any(len(r) % 2 for r in raws) else None
        if found is None:
            return [self.text(r, font) for r in raws]
        text, wide = found
        ends = np.cumsum(sizes)
        begins = ends - sizes
        if max(sizes) > FEW_CODES:
            widths = [summed(wide[a:z]) for a, z in zip(begins.tolist(), ends.tolist())]
        else:
            widths, many = np.zeros(len(raws), _F), np.array(sizes)
            for k in range(max(sizes)):  # widths are added from left to right, as those of one string are
                own = np.flatnonzero(k < many)
                widths[own] = widths[own] + wide[begins[own] + k]
        return [(text[a:z].encode(), n, w) for a, z, n, w in zip(begins.tolist(), ends.tolist(), sizes, widths)]

    def _use(self, font: Font) -> None:
        """Forgets what is known of codes, if it is of another font."""
        if self.known_font is not font:
            self.known_font, self.known, self.points = font, {}, None

    def _looked_up(self, raw: bytes, font: Font) -> tuple[str, np.ndarray] | None:
        """Text and widths of ``raw``, if codes of two bytes are tried first and each is known
        and stands for one character."""
        if not raw or not self.map.sizes or self.map.sizes[0] != 2:
            return None
        self._use(font)
        if self.points is None:
            most = max((int.from_bytes(c, "big") for c in self.map.text if len(c) == 2), default=0)
            self.points, self.wide = np.zeros(most + 1, "<u4"), np.zeros(most + 1, _F)
        codes = np.frombuffer(raw, ">u2")
        if codes.max() >= len(self.points):
            return None
        points = self.points[codes]
        if not points.all():
            for c in set(codes[points == 0].tolist()):
                try:
                    text = self.map.text.get(c.to_bytes(2, "big"), b"").decode()
                except UnicodeDecodeError:
                    return None
                if len(text) != 1 or text == "\0":
                    return None
                self.points[c], self.wide[c] = ord(text), font.width(c)
            points = self.points[codes]
        return points.tobytes().decode("utf-32-le"), self.wide[codes]

    def _even(self, raw: bytes, font: Font) -> tuple[bytes, int, np.float32] | None:
        """What ``_mapped`` gives where all codes have the length that is tried first and all are
        known."""
        n = self.map.sizes[0]
        if n == 2 and len(raw) > 2 * FEW_CODES and (found := self._looked_up(raw, font)):
            return found[0].encode(), len(found[0]), summed(found[1])
        self._use(font)
        known, codes = self.known, [raw[i : i + n] for i in range(0, len(raw), n)]
        for code in set(codes).difference(known):
            text = self.map.text.get(code)
            if not text:
                return None
            known[code] = text, code_points(text), font.width(int.from_bytes(code, "big"))
        found = [known[c] for c in codes]
        return b"".join([f[0] for f in found]), sum([f[1] for f in found]), summed(np.array([f[2] for f in found], _F))

    def _mapped(self, raw: bytes, font: Font) -> tuple[bytes, int, np.float32]:
        n = self.map.sizes[0] if self.map.sizes else 0
        if n and len(raw) % n == 0 and (even := self._even(raw, font)):
            return even
        table = self.table if self.differences is None else self.differences
        out, length, width, at = [], 0, _F(0), 0
        while at < len(raw):
            hit = self.map.next(raw, at)
            if hit and hit[1]:
                code, text = hit
                width = width + font.width(int.from_bytes(code, "big"))
                length += code_points(text)
                out.append(text)
                at += len(code)
                continue
            if hit:
                at += len(hit[0])
                if at >= len(raw):
                    break
            if raw[at] in table:
                out.append(table[raw[at]].encode())
                width = width + font.width(raw[at])
                length += 1
            at += 1
        return b"".join(out), length, width
