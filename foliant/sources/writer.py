"""A small PDF writer: documents to read back in queries and tests."""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct
import zlib
from collections.abc import Callable

import numpy as np

from ..functions.filters import lzw_encode, up_rows

#: Fixed value: the published padding of passwords.
PADDING = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


class PdfWriter:
    """Collects objects; ``finish`` lays them out with a table or a stream of cross
    references, optionally with objects packed into an object stream."""

    def __init__(self, encrypt: Callable[[int, bytes], bytes] | None = None):
        self.objects: dict[int, bytes] = {}
        self.next = 1
        self.encrypt = encrypt

    def reserve(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, body: bytes, number: int | None = None) -> int:
        number = self.reserve() if number is None else number
        self.objects[number] = body
        return number

    def stream(self, data: bytes, props: bytes = b"", number: int | None = None, flate: bool = False) -> int:
        number = self.reserve() if number is None else number
        if flate:
            data, props = zlib.compress(data), props + b" /Filter /FlateDecode"
        if self.encrypt:
            data = self.encrypt(number, data)
        return self.add(b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(data), props and b" " + props, data), number)

    def pack(self, numbers: list[int], flate: bool = True) -> int:
        """Moves objects into an object stream."""
        bodies = [self.objects.pop(n) for n in numbers]
        places = itertools.accumulate((len(b) + 1 for b in bodies), initial=0)
        head = b"".join([b"%d %d " % p for p in zip(numbers, places)])
        return self.stream(head + b"\n".join(bodies) + b"\n", b"/Type /ObjStm /N %d /First %d" % (len(numbers), len(head)), flate=flate)

    def finish(self, root: int, *, xref: str = "table", extra: bytes = b"", shift: int = 0) -> bytes:
        """The file. shift: by how much the pointer to the cross references is wrong."""
        parts, places, at = [b"%PDF-1.7\n"], {}, 9
        for n in sorted(self.objects):
            places[n] = at
            parts.append(b"%d 0 obj\n%s\nendobj\n" % (n, self.objects[n]))
            at += len(parts[-1])
        if xref == "table":
            parts.append(b"xref\n0 %d\n0000000000 65535 f \n" % self.next)
            parts += [b"%010d 00000 %s \n" % (places.get(n, 0), b"n" if n in places else b"f") for n in range(1, self.next)]
            parts.append(b"trailer\n<< /Size %d /Root %d 0 R %s >>" % (self.next, root, extra))
        else:
            wide = 2 if at < 1 << 16 else 4
            entry = lambda kind, offset, third: bytes([kind]) + offset.to_bytes(wide, "big") + bytes([third])
            rows = [entry(0, 0, 255), *(entry(int(n in places), places.get(n, 0), 0) for n in range(1, self.next)), entry(1, at, 0)]
            data = zlib.compress(up_rows(b"".join(rows), wide + 2))  # rows as differences from the one above
            sizes = (self.next + 1, wide, self.next + 1, root, extra, wide + 2)
            props = b"/Type /XRef /Size %d /W [1 %d 1] /Index [0 %d] /Root %d 0 R %s /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns %d >>" % sizes
            parts.append(b"%d 0 obj\n<< /Length %d %s >>\nstream\n%s\nendstream\nendobj" % (self.next, len(data), props, data))
        return b"".join([*parts, b"\nstartxref\n%d\n%%%%EOF\n" % (at + shift)])


def revised(buf: bytes, objects: dict[int, bytes], root: int) -> bytes:
    """``buf`` with a second revision, whose ``objects`` replace those of the first."""
    pointer, out, places = int(buf.split(b"startxref")[-1].split()[0]), buf, {}
    for n, body in sorted(objects.items()):
        places[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    at = len(out)
    out += b"xref\n" + b"".join(b"%d 1\n%010d 00000 n \n" % p for p in places.items())
    return out + b"trailer\n<< /Root %d 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF\n" % (root, pointer, at)


def keystream(key: bytes):
    """RC4's bytes, written apart from the engine's own cipher so that each checks the other."""
    state = list(range(256))
    j = 0
    for i, k in zip(range(256), itertools.cycle(key)):
        j = (j + state[i] + k) % 256
        state[i], state[j] = state[j], state[i]
    j = 0
    for i in itertools.chain(range(1, 256), itertools.cycle(range(256))):
        here = state[i]
        j = (j + here) % 256
        state[i] = there = state[j]
        state[j] = here
        yield state[(here + there) % 256]


def rc4_encrypt(key: bytes, data: bytes) -> bytes:
    stream = bytes(itertools.islice(keystream(key), len(data)))
    return (int.from_bytes(data, "little") ^ int.from_bytes(stream, "little")).to_bytes(len(data), "little")


OWNER, IDENT, PERMISSIONS = b"o" * 32, b"identity", -4


def file_key(revision: int, size: int) -> bytes:
    """The key of a file with OWNER, IDENT, PERMISSIONS and no password."""
    key = hashlib.md5(PADDING + OWNER + (PERMISSIONS & 0xFFFFFFFF).to_bytes(4, "little") + IDENT).digest()
    for _ in range(50 if revision > 2 else 0):
        key = hashlib.md5(key[:size]).digest()
    return key[:size]


def object_key(key: bytes, number: int, aes: bool = False) -> bytes:
    return hashlib.md5(key + number.to_bytes(3, "little") + b"\0\0" + b"sAlT" * aes).digest()[: min(len(key) + 5, 16)]


def encrypt_entry(revision: int, size: int, aes: bool = False) -> bytes:
    level = b" /CF << /StdCF << /CFM /AESV2 >> >>" if aes else b""
    return b"/Encrypt << /R %d /Length %d /O <%s> /P %d%s >> /ID [<%s> <00>]" % (revision, size * 8, OWNER.hex().encode(), PERMISSIONS, level, IDENT.hex().encode())


#: Encryption by name: revision, bytes of the key.
CIPHERS = {"rc4-40": (2, 5), "rc4-128": (3, 16)}


def png_rows(data: bytes, columns: int) -> bytes:
    """Rows of ``columns`` bytes by the four PNG predictors that can be read, in turn."""
    out, above = b"", bytes(columns)
    for n, at in enumerate(range(0, len(data), columns)):
        row, kind = data[at : at + columns], n % 4
        left = b"\0" + row[:-1]
        if kind == 0:
            coded = row
        elif kind == 1:
            coded = bytes((a - b) & 255 for a, b in zip(row, left))
        elif kind == 2:
            coded = bytes((a - b) & 255 for a, b in zip(row, above))
        else:  # averages of bytes as signed numbers, rounded down
            sign = lambda v: v - 256 if v > 127 else v
            coded = bytes((a - (sign(b) + sign(c) >> 1)) & 255 for a, b, c in zip(row, left, above))
        out, above = out + bytes([kind]) + coded, row
    return out


def tiff_rows(data: bytes, columns: int) -> bytes:
    own = np.frombuffer(data, np.uint8)
    out = np.diff(own, prepend=own[:0] if not len(own) else np.uint8(0))
    out[::columns] = own[::columns]
    return out.tobytes()


#: Ways to store a stream, by name: (filters, parameters, what the data goes through).
STORED = {
    "hex": (b"/Filter [/ASCIIHexDecode /FlateDecode]", lambda d: zlib.compress(d).hex().encode() + b">"),
    "lzw": (b"/Filter /LZWDecode /DecodeParms << /Predictor 2 /Columns 8 >>", lambda d: lzw_encode(tiff_rows(d + b" " * (-len(d) % 8), 8))),
    "ascii85": (b"/Filter [/ASCII85Decode /FlateDecode] /DecodeParms [<< >> << /Predictor 15 /Columns 16 >>]", lambda d: _base85(zlib.compress(png_rows(d + b" " * (-len(d) % 16), 16)))),
}


def _base85(data: bytes) -> bytes:
    return base64.a85encode(data + b"\0" * (-len(data) % 4)) + b"~>"  # a short last group would be lost


def escaped(raw: bytes) -> bytes:
    return b"(" + raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r") + b")"


def simple_pdf(contents: list[bytes], *, font: bytes = b"/Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding", page: bytes = b"/MediaBox [0 0 612 792]", xref: str = "table", flate: bool = False, pack: bool = False) -> bytes:
    """One page for each content stream, with one font F1."""
    w = PdfWriter()
    tree, face = w.reserve(), w.add(b"<< %s >>" % font)
    kids = []
    for c in contents:
        body = w.stream(c, flate=flate)
        kids.append(w.add(b"<< /Type /Page /Parent %d 0 R %s /Resources << /Font << /F1 %d 0 R >> >> /Contents %d 0 R >>" % (tree, page, face, body)))
    w.add(b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids)), tree)
    root = w.add(b"<< /Type /Catalog /Pages %d 0 R >>" % tree)
    if pack:
        w.pack([face, *kids, tree, root])
    return w.finish(root, xref=xref)


LINES_A_PAGE = 50
LEADING = 14
SIZE = 10


def _literal(raw: bytes) -> bytes:
    """``raw`` as a literal string that needs all that one can hold: escapes, octal numbers
    of one to three digits, balanced parentheses, a continued line."""
    names = {10: b"\\n", 13: b"\\r", 9: b"\\t", 8: b"\\b", 12: b"\\f", 40: b"\\(", 41: b"\\)", 92: b"\\\\"}
    spelled = [names.get(b, bytes([b]) if 32 <= b < 127 and not 48 <= b < 58 else b"\\%03o" % b) for b in range(256)]
    return b"(%s)" % b"".join(map(spelled.__getitem__, raw))


def _face(w: PdfWriter, number: dict[str, int], kind: str) -> tuple[int, Callable[[str], bytes]]:
    """A font of that kind that numbers the characters, and how a line is spelled."""
    codes = {ord(c): n for c, n in number.items()}
    two = lambda line: line.translate(codes).encode("utf-16-be", "surrogatepass")
    one = lambda line: line.translate(codes).encode("latin-1")
    utf16 = lambda c: c.encode("utf-16-be", "surrogatepass").hex().encode()
    flate = w.encrypt is None
    if kind == "differences":  # one byte a character, named by its code, /Widths
        names = b" ".join(b"/u%06X" % ord(c) if ord(c) > 0xFFFF else b"/uni%04X" % ord(c) for c in number)
        return w.add(b"<< /Type /Font /Subtype /Type1 /BaseFont /Any /Encoding << /Differences [1 %s] >> /FirstChar 1 /Widths [%s] >>" % (names, b"600 " * len(number))), one
    if kind == "utf16":  # a predefined charset
        inner = w.add(b"<< /Type /Font /Subtype /CIDFontType0 /BaseFont /Any /DW 600 >>")
        return w.add(b"<< /Type /Font /Subtype /Type0 /BaseFont /Any /Encoding /UniGB-UTF16-H /DescendantFonts [%d 0 R] >>" % inner), lambda line: line.encode("utf-16-be", "surrogatepass")
    if kind == "segments":  # a cmap table of segments of one character, whose texts are raw bytes
        chars = sorted((ord(c), n) for c, n in number.items())
        n = len(chars) + 1
        ends, deltas = [c for c, _ in chars] + [0xFFFF], [g - c for c, g in chars] + [1]
        sub = struct.pack(">7H", 4, 16 + 8 * n, 0, 2 * n, 0, 0, 0) + struct.pack(f">{n}HH{n}H{n}h{n}H", *ends, 0, *ends, *deltas, *[0] * n)
        table = struct.pack(">HHHHI", 0, 1, 3, 1, 12) + sub
        file = w.stream(struct.pack(">IHHHH", 0x10000, 1, 0, 0, 0) + b"cmap" + struct.pack(">III", 0, 28, len(table)) + table, flate=flate)
        return w.add(b"<< /Type /Font /Subtype /TrueType /BaseFont /Any /FontDescriptor << /FontFile2 %d 0 R /MissingWidth 600 >> >>" % file), two
    if kind == "truetype":  # a cmap table whose subtables are a character each
        subs = [struct.pack(">HHHHHH", 6, 12, 0, ord(c), 1, n) for c, n in number.items()]
        head = struct.pack(">HH", 0, len(subs)) + b"".join(struct.pack(">HHI", 3, 1, 4 + 8 * len(subs) + 12 * i) for i in range(len(subs)))
        table = head + b"".join(subs)
        file = w.stream(struct.pack(">IHHHH", 0x10000, 1, 0, 0, 0) + b"cmap" + struct.pack(">III", 0, 28, len(table)) + table, flate=flate)
        return w.add(b"<< /Type /Font /Subtype /TrueType /BaseFont /Any /FontDescriptor << /FontFile2 %d 0 R /MissingWidth 600 >> >>" % file), two
    pairs = [b"<%04x> <%s>" % (i, utf16(c)) for c, i in number.items()]
    if kind == "ranges":  # runs of ten codes with an array of texts, and runs of one
        runs = [list(number.items())[i : i + 11] for i in range(0, len(number), 11)]
        pairs = [x for r in runs for x in (b"<%04x> <%04x> [%s]" % (r[0][1], r[min(len(r), 10) - 1][1], b" ".join(b"<%s>" % utf16(c) for c, _ in r[:10])), *(b"<%04x> <%04x> <%s>" % (n, n, utf16(c)) for c, n in r[10:]))]
    if kind == "type3":
        pairs = [b"<%02x> <%s>" % (i, utf16(c)) for c, i in number.items()]
    section = b"bfrange" if kind == "ranges" else b"bfchar"
    parts = (pairs[i : i + 100] for i in range(0, len(pairs), 100))
    cmap = b"% a map\nbegincmap\n" + b"".join(b"%d begin%s\n%s\nend%s\n" % (len(p), section, b"\n".join(p), section) for p in parts) + b"endcmap\nend\n"
    to_unicode = w.stream(cmap, flate=flate)
    if kind == "type3":
        return w.add(b"<< /Type /Font /Subtype /Type3 /FontMatrix [0.001 0 0 0.001 0 0] /FontBBox [0 -200 600 800] /FirstChar 1 /Widths [%s] /ToUnicode %d 0 R >>" % (b"600 " * len(number), to_unicode)), one
    widths = b"/W [1 [600 600] 3 %d 600]" % max(3, len(number)) if kind == "ranges" else b"/DW 600"
    inner = w.add(b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Any %s >>" % widths)
    return w.add(b"<< /Type /Font /Subtype /Type0 /BaseFont /Any /Encoding /Identity-H /DescendantFonts [%d 0 R] /ToUnicode %d 0 R >>" % (inner, to_unicode)), two


def _shown(lines: list[bytes | None], show: str, spell: Callable[[bytes], bytes], unit: int) -> bytes:
    """A page's lines (codes, or None for empty ones) by one way of showing text."""
    top = 36 + LEADING * len(lines)
    cut = lambda raw: [raw[i : i + 4 * unit] for i in range(0, len(raw), 4 * unit)]
    if show == "matrix":  # each line in a text object of its own, moved by matrices, with images between
        out = []
        for i, raw in enumerate(lines):
            if raw is not None:
                out.append(b"q 2 0 0 2 10 %d cm .5 0 0 .5 -5 0 cm BT /F1 %d Tf 0 Tc 0 Tw 100 Tz 0 Ts 1 0 0 1 31 0 Tm %s Tj ET Q BI /W 1 /H 1 ID (xEI[ EI " % (top - LEADING * i, SIZE, spell(raw)))
        return b"\n".join(out) + b"\n"
    first = top + LEADING if show in ("quote", "quotes") else top
    body = [b"BT /F1 %d Tf %s36 %d Td" % (SIZE, b"" if show == "move" else b"%d TL " % LEADING, first)]
    for raw in lines:
        if show == "array":
            body.append(b"[%s] TJ" % b" -3 4 ".join(map(spell, cut(raw))) if raw else b"")
            body.append(b"T*")
        elif show == "lead":
            body.append(b"%s Tj" % spell(raw) if raw else b"")
            body.append(b"0 -%d TD" % LEADING)
        elif show in ("quote", "quotes"):
            body.append((b"%s '" if show == "quote" else b"0 0 %s \"") % spell(raw) if raw else b"T*")
        else:
            body.append(b"%s Tj" % spell(raw) if raw else b"")
            body.append(b"0 -%d Td" % LEADING)
    return b"\n".join([*body, b"ET "])


def text_pdf(
    text: str, lines_a_page: int = LINES_A_PAGE, flate: bool = True, *, font: str = "composite", show: str = "move", literal: bool = False, wrap: str = "page", store: str = "",
    xref: str = "table", pack: bool = False, shift: int = 0, revise: bool = False, cipher: str = "",
) -> bytes:
    """``text`` as pages of one string a line. A font numbers the text's characters and maps
    the numbers back, so any text survives, in whatever way it is written.

    font: composite, ranges, differences, utf16, truetype, segments, type3. show: move, lead, array,
    quote, quotes, matrix. wrap: page, form, annotation. store: of STORED. cipher: of CIPHERS.
    shift: by how much the pointer to the cross references is wrong. revise: pages are blank
    at first and get their content in a second revision."""
    w = PdfWriter()
    if cipher:
        revision, size = CIPHERS[cipher]
        key = file_key(revision, size)
        w.encrypt, flate = lambda number, data: rc4_encrypt(object_key(key, number), data), False
    number = {c: i + 1 for i, c in enumerate(dict.fromkeys(text.replace("\n", "")))}
    if font in ("differences", "type3") and len(number) > 255 or font == "truetype" and any(ord(c) > 0xFFFF for c in number) or font == "segments" and not text.isascii():
        font = "composite"  # more characters than such a font can hold
    face, spelled = _face(w, number, font)
    unit = 1 if font in ("differences", "type3") else 2
    spell = _literal if literal else lambda raw: b"<%s>" % raw.hex().encode()
    tree = w.reserve()
    lines = text.split("\n")
    kids, late = [], {}
    fonts = b"/Font << /F1 %d 0 R >>" % face
    for at in range(0, len(lines), lines_a_page):
        body = _shown([spelled(x) if x else None for x in lines[at : at + lines_a_page]], show, spell, unit)
        extra, resources = b"", fonts
        if store:
            filters, run = STORED[store]
            content = w.stream(run(body), filters)
        elif wrap == "form":
            inner = w.stream(body, b"/Subtype /Form /BBox [0 0 612 792] /Resources << %s >>" % fonts, flate=flate)
            outer = w.stream(b"q /Y Do Q ", b"/Subtype /Form /BBox [0 0 612 792] /Resources << /XObject << /Y %d 0 R >> >>" % inner, flate=flate)
            resources = fonts + b" /XObject << /X %d 0 R >>" % outer
            content = w.stream(b"q 1 0 0 1 0 0 cm /X Do Q ", flate=flate)
        elif wrap == "annotation":
            shown = w.add(b"<< /Subtype /Widget /AP << /N %d 0 R >> >>" % w.stream(body, flate=flate))
            extra = b" /Annots %d 0 R" % w.add(b"[%d 0 R]" % shown)
            content = w.stream(b" ", flate=flate)
        else:
            content = w.stream(body, flate=flate)
            if revise:
                late[content], w.objects[content] = w.objects[content], b"<< /Length 1 >>\nstream\n \nendstream"
        kids.append(w.add(b"<< /Type /Page /Parent %d 0 R /MediaBox [0 0 612 792] /Resources << %s >> /Contents %d 0 R%s >>" % (tree, resources, content, extra)))
    w.add(b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids)), tree)
    root = w.add(b"<< /Type /Catalog /Pages %d 0 R >>" % tree)
    if pack:
        w.pack([face, *kids, tree, root])
    buf = w.finish(root, xref=xref, shift=shift, extra=encrypt_entry(*CIPHERS[cipher]) if cipher else b"")
    return revised(buf, late, root) if revise else buf
