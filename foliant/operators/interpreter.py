"""Pages and their content: the page tree, 21 content operators, positioned chunks."""

from __future__ import annotations

import re
from binascii import unhexlify
from dataclasses import dataclass, field

import numpy as np

from ..functions.geometry import IDENTITY, Matrix, moved, page_matrix, point, product
from ..functions.syntax import (
    ARRAY, DICTIONARY, REFERENCE, STRING, VALUE, Dictionary, Malformed, Object, array, array_end, code_points, dictionary, dictionary_end,
    real, reference, references, skip, string_end, text_string, token, unsigned,
)
from .document import Document
from .fonts import Decoder, Fonts

_F = np.float32
MOST_NESTED = 30
#: Strings of an array that are placed one by one; of more, all at once.
FEW_STRINGS = 8
#: An array of whole hex strings and numbers, and its items.
_SHOWN = re.compile(rb"\[(?:[\r\n \t]*+(?:<(?:[0-9a-fA-F]{2})*+>|[+-]?[0-9.]++(?=[\r\n \t<\]])))*+[\r\n \t]*+\]")
_SHOWN_ITEM = re.compile(rb"<([^>]*)>|([^\r\n \t<\[\]]+)")
#: A token behind blanks, if it isn't a comment and can't open an operand.
_WORD = re.compile(rb"[\r\n \t]*+([^ \r\n\t%(<\[][^ \r\n\t/\[(<]*+)")


@dataclass
class Chunk:
    """A shown string where it lies on the page."""

    x0: np.float32
    y0: np.float32
    x1: np.float32
    y1: np.float32
    text: bytes
    length: int
    font: bytes = b""


@dataclass
class Scope:
    """What names in a content stream mean: of a page, or of a form within one."""

    props: Dictionary
    fonts: Fonts
    objects: Dictionary = field(default_factory=dict)
    decoders: dict[bytes, Decoder] = field(default_factory=dict)
    forms: dict[bytes, tuple["Scope", bytes, Matrix]] = field(default_factory=dict)


@dataclass
class Page:
    number: int
    box: tuple[np.float32, ...]
    rotate: int
    scope: Scope

    @property
    def matrix(self) -> Matrix:
        return page_matrix(self.rotate, self.box)


class Pages:
    """A document's pages in order, with what they inherit."""

    def __init__(self, doc: Document):
        self.doc, self.pages, self.maps = doc, [], {}
        self.boxes: dict[Object, tuple[np.float32, ...]] = {}
        self.known: dict[Object, Fonts | None] = {}  # by what /Resources says; None: it has no fonts
        kind, raw = doc.get(doc.pages_root())
        if kind != DICTIONARY:
            raise Malformed("the page tree isn't a dictionary")
        root = dictionary(raw)
        if root.get(b"/Type", (0, b""))[1] != b"/Pages":
            raise Malformed("the page tree's type isn't /Pages")
        self._visit(root, self.fonts(root, Fonts(doc)), self._box(root, None), self._rotate(root, 0), set())

    def fonts(self, props: Dictionary, inherited: Fonts) -> Fonts:
        """Fonts of a dictionary's resources. Resources without fonts hide inherited ones."""
        if b"/Resources" not in props:
            return inherited.copy()
        own = props[b"/Resources"]
        if own not in self.known:
            resources = self.doc.dictionary(own)
            self.known[own] = Fonts(self.doc, self.doc.dictionary(resources[b"/Font"])) if b"/Font" in resources else None
        found = self.known[own]
        if found is None:
            return Fonts(self.doc) if self.doc.compat else inherited.copy()
        return found.copy()

    def _box(self, props: Dictionary, inherited):
        if b"/MediaBox" not in props:
            return inherited
        own = props[b"/MediaBox"]
        if own not in self.boxes:
            numbers = array(self.doc.resolve(own)[1]) if own[0] in (ARRAY, REFERENCE) else []
            if len(numbers) != 4:
                raise Malformed("/MediaBox isn't four numbers")
            self.boxes[own] = tuple(real(r) for _, r in numbers)
        return self.boxes[own]

    @staticmethod
    def _rotate(props: Dictionary, inherited: int) -> int:
        if b"/Rotate" not in props:
            return inherited
        turn = unsigned(props[b"/Rotate"][1])
        if turn % 90:
            raise Malformed("/Rotate isn't a multiple of 90")
        return turn

    def _visit(self, props: Dictionary, fonts: Fonts, box, rotate: int, seen: set[int]) -> None:
        """Depth first. A node that is listed again is left out, which ends cycles."""
        if props.get(b"/Type", (0, b""))[1] != b"/Pages":
            return
        kind, raw = props[b"/Kids"]
        if kind != ARRAY:
            raise Malformed("/Kids isn't an array")
        for number, _ in references(raw):
            if number in seen:
                continue
            seen.add(number)
            kind, own_raw = self.doc.get(number)
            if kind != DICTIONARY:
                raise Malformed("a page isn't a dictionary")
            own = self.doc.entries(number, own_raw)
            here = self.fonts(own, fonts), self._box(own, box), self._rotate(own, rotate)
            if own[b"/Type"][1] != b"/Page":
                self._visit(own, *here, seen)
                continue
            if here[1] is None:
                raise Malformed("a page has no /MediaBox")
            self.pages.append(Page(number, here[1], here[2], Scope(own, here[0])))

    def contents(self, page: Page) -> list[tuple[int, int]]:
        if b"/Contents" not in page.scope.props:
            return []
        kind, raw = page.scope.props[b"/Contents"]
        if kind not in (ARRAY, REFERENCE):
            raise Malformed("/Contents has a wrong type")
        return references(raw) if kind == ARRAY else [reference(raw)]

    def annotations(self, page: Page) -> list[tuple[int, int]]:
        """Appearance streams of annotations that are listed by reference."""
        kind, raw = page.scope.props.get(b"/Annots", (0, b""))
        if kind != REFERENCE or reference(raw)[0] not in self.doc:
            return []
        out = []
        for value in array(self.doc.get(reference(raw)[0])[1]):
            appearance = self._loose(value).get(b"/AP")
            normal = self._loose(appearance).get(b"/N", (0, b"")) if appearance else (0, b"")
            if normal[0] == REFERENCE:
                out.append(reference(normal[1]))
        return out

    def _loose(self, value: Object) -> Dictionary:
        return dictionary(value[1] if value[0] == DICTIONARY else self.doc.get(reference(value[1])[0])[1])

    def _gather(self, number: int, generation: int, seen: set[int]) -> bytes:
        kind, raw = self.doc.get(number)
        if kind != ARRAY:
            return self.doc.stream(number, generation)
        parts = []
        for inner in references(raw):
            if inner[0] not in seen:
                seen.add(inner[0])
                parts.append(self._gather(*inner, seen))
        return b"".join(parts)

    def layers(self, page: Page, ids: list[tuple[int, int]], seen: set[int], log: list | None = None) -> list[list[Chunk]]:
        """Chunks of the streams ``ids``, read as one: of the page, then of each form."""
        if not ids:
            return [[]]
        content = b""
        for number, generation in ids:
            kind, raw = self.doc.get(number)
            if kind == DICTIONARY:
                page.scope.fonts = self.fonts(self.doc.entries(number, raw), page.scope.fonts)
            content += self._gather(number, generation, seen)
        return Interpreter(self, page.scope, page.matrix, log).run(content)

    def form(self, scope: Scope, name: bytes) -> tuple[Scope, bytes, Matrix] | None:
        """The form XObject of that name: its scope, content and matrix."""
        if not scope.objects:
            if b"/Resources" not in scope.props:
                return None
            resources = self.doc.dictionary(scope.props[b"/Resources"])
            if b"/XObject" not in resources:
                return None
            scope.objects = self.doc.dictionary(resources[b"/XObject"])
        if name not in scope.objects:
            return None
        if name not in scope.forms:
            props = self.doc.dictionary(scope.objects[name])
            if props[b"/Subtype"][1] != b"/Form" or b"/BBox" not in props:
                return None
            inner = Scope(dict(props), self.fonts(props, scope.fonts))
            content = self.doc.stream(*reference(scope.objects[name][1]))
            if b"/Resources" not in props:
                inner.props[b"/Resources"] = scope.props[b"/Resources"]
                inner.objects = scope.objects
            key = b"Matrix" if self.doc.compat else b"/Matrix"  # the former is never there
            matrix = tuple(real(r) for _, r in array(props[key][1])) if key in props else IDENTITY
            if len(matrix) != 6:
                raise Malformed("a form's matrix isn't six numbers")
            scope.forms[name] = inner, content, matrix
        return scope.forms[name]


class Interpreter:
    """Runs one content stream. Operands pile up on a stack that is never cleared."""

    def __init__(self, pages: Pages, scope: Scope, matrix: Matrix, log: list | None = None, nested: int = 0):
        self.pages, self.scope, self.ctm, self.log, self.nested = pages, scope, matrix, log, nested
        self.stack: list[Object] = []
        self.saved: list[Matrix] = []
        self.tm, self.x, self.y = IDENTITY, _F(0), _F(0)
        self.size, self.stretch, self.char_space, self.word_space, self.leading = _F(1), _F(1), _F(0), _F(0), _F(0)
        self.inside = False
        self.decoder: Decoder | None = None
        self.out: list[list[Chunk]] = [[]]
        self.content, self.at = b"", 0

    def run(self, content: bytes) -> list[list[Chunk]]:
        if self.nested > MOST_NESTED:
            return []
        self.content = content
        at, size, push = 0, len(content), self.stack.append
        while True:
            m = _WORD.match(content, at)
            if m:
                word, self.at = m[1], m.end()
            else:
                self.at = skip(content, at, strict=False)
                if self.at >= size:
                    return self.out
                if self.inside and self._operand():
                    at = self.at
                    continue
                word, self.at = token(content, self.at)
            operator = _OPERATORS.get(word)
            if operator is None:
                push((VALUE, word))
            else:
                if self.log is not None:
                    self.log.append((word, list(self.stack[-6:])))
                if not operator[1] or self.inside:
                    operator[0](self)
            at = self.at

    def _operand(self) -> bool:
        first = self.content[self.at : self.at + 1]
        if first == b"<" and self.content[self.at + 1 : self.at + 2] == b"<":
            kind, end = DICTIONARY, dictionary_end(self.content, self.at)
        elif first in (b"(", b"<"):
            kind, end = STRING, string_end(self.content, self.at)
        elif first == b"[":
            kind, end = ARRAY, array_end(self.content, self.at)
        else:
            return False
        self.stack.append((kind, self.content[self.at : end]))
        self.at = end
        return True

    def pop(self) -> bytes:
        if not self.stack:
            raise Malformed("an operator lacks operands")
        return self.stack.pop()[1]

    def number(self) -> np.float32:
        return real(self.pop())

    def matrix(self) -> Matrix:
        return tuple(reversed([self.number() for _ in range(6)]))

    def line(self, x: np.float32, y: np.float32) -> None:
        self.tm, self.x, self.y = moved(self.tm, x, y), _F(0), _F(0)

    def show(self, raw: bytes, kern: np.float32 = _F(0)) -> None:
        """Places a string's text and moves the pen. Text that leaves its baseline is
        dropped, though the pen moves."""
        fonts = self.scope.fonts
        font = fonts.font
        text, length, width = self.decoder.text(raw, font)
        if kern != 0:
            self.x = _F(float(self.x) - float(kern * self.size * self.stretch) * 0.001)
        low = font.descent * font.scale[1] * self.size + fonts.rise * self.size
        advance = width * self.size * self.stretch
        m = product(self.tm, self.ctm)
        start = moved(m, self.x, self.y)
        if length > 1:
            self.x = self.x + self.char_space * self.stretch * _F(length - 1)
        for _ in range(text.count(b" ")):
            self.x = self.x + self.word_space * self.stretch
        end = moved(m, self.x, self.y)
        self.x = self.x + advance
        if m[5] != start[5]:
            return
        xa, ya = point(start, _F(0), low)
        xb, yb = point(end, advance, low + self.size)
        self.out[0].append(Chunk(min(xa, xb), min(ya, yb), max(xa, xb), max(ya, yb), text, code_points(text), fonts.current))

    def show_all(self, raws: list[bytes], kerns: list[np.float32]) -> None:
        """``show`` of many strings, each after its kern: the same steps, in the same precision."""
        fonts, m = self.scope.fonts, product(self.tm, self.ctm)
        font = fonts.font
        shown = self.decoder.texts(raws, font)
        low = font.descent * font.scale[1] * self.size + fonts.rise * self.size
        advance = np.array([w for _, _, w in shown], _F) * self.size * self.stretch
        back = ((np.array(kerns, _F) * self.size * self.stretch).astype("f8") * 0.001).tolist()
        between, word, x = self.char_space * self.stretch, self.word_space * self.stretch, self.x
        starts, ends = [], []
        for (text, length, _), kern, left, step in zip(shown, kerns, back, advance):
            if kern != 0:
                x = _F(float(x) - left)
            starts.append(x)
            if length > 1:
                x = x + between * _F(length - 1)
            for _ in range(text.count(b" ")):
                x = x + word
            ends.append(x)
            x = x + step
        self.x = x
        start, end = ([e * m[0] + self.y * m[2] + m[4], e * m[1] + self.y * m[3] + m[5]] for e in (np.array(starts, _F), np.array(ends, _F)))
        kept = (m[5] == start[1]).tolist()
        xa, ya = point((*m[:4], *start), _F(0), low)
        xb, yb = point((*m[:4], *end), advance, low + self.size)
        corners = zip(*[list(c) for c in (np.where(xb < xa, xb, xa), np.where(yb < ya, yb, ya), np.where(xb > xa, xb, xa), np.where(yb > ya, yb, ya))])
        self.out[0] += [Chunk(*c, text, code_points(text), fonts.current) for c, (text, _, _), k in zip(corners, shown, kept) if k]

    @property
    def shows(self) -> bool:
        return self.decoder is not None

    def op_font(self) -> None:
        self.size = self.number()
        name = self.pop()
        scope = self.scope
        scope.fonts.current = name
        if name not in scope.decoders:
            font = scope.fonts.font
            if font.decoder is None:
                font.decoder = Decoder(self.pages.doc, font.props, self.pages.maps)
            scope.decoders[name] = font.decoder
        self.decoder = scope.decoders[name]

    def op_show(self) -> None:
        if self.shows and not self.decoder.vertical:
            self.show(text_string(self.pop()))

    def op_show_array(self) -> None:
        if not self.shows or self.decoder.vertical:
            return
        own, kern, raws, kerns = self.pop(), _F(0), [], []
        if _SHOWN.fullmatch(own):
            for string, number in _SHOWN_ITEM.findall(own):
                if number:
                    kern = real(number)
                else:
                    raws.append(unhexlify(string))
                    kerns.append(kern)
                    kern = _F(0)
        else:
            raws, kerns = self._strings(own)
        if len(raws) > FEW_STRINGS:
            self.show_all(raws, kerns)
        else:
            for raw, kern in zip(raws, kerns):
                self.show(raw, kern)

    @staticmethod
    def _strings(own: bytes) -> tuple[list[bytes], list[np.float32]]:
        """An array's strings, and the number before each."""
        kern, raws, kerns = _F(0), [], []
        for kind, raw in array(own):
            if kind == VALUE:
                kern = real(raw)
            elif kind == STRING:
                raws.append(text_string(raw))
                kerns.append(kern)
                kern = _F(0)
            else:
                raise Malformed("TJ takes strings and numbers")
        return raws, kerns

    def op_next_show(self) -> None:
        if self.shows:
            self.op_next()
            self.show(text_string(self.pop()))

    def op_spaced_show(self) -> None:
        if self.shows:
            raw = self.pop()
            self.char_space, self.word_space = self.number(), self.number()
            self.op_next()
            self.show(raw if self.pages.doc.compat else text_string(raw))

    def op_next(self) -> None:
        self.line(_F(0), -self.leading)

    def op_move(self) -> None:
        y, x = self.number(), self.number()
        self.line(x, y)

    def op_move_leading(self) -> None:
        y, x = self.number(), self.number()
        self.line(x, y)
        self.leading = -y

    def op_matrix(self) -> None:
        self.tm, self.x, self.y = self.matrix(), _F(0), _F(0)

    def op_begin(self) -> None:
        self.tm, self.x, self.y, self.inside = IDENTITY, _F(0), _F(0), True

    def op_end(self) -> None:
        self.inside = False

    def op_concat(self) -> None:
        try:
            self.ctm = product(self.matrix(), self.ctm)
        except Malformed:
            pass

    def op_save(self) -> None:
        self.saved.append(self.ctm)

    def op_restore(self) -> None:
        if self.saved:
            self.ctm = self.saved.pop()

    def op_leading(self) -> None:
        self.leading = self.number()

    def op_char_space(self) -> None:
        self.char_space = self.number()

    def op_word_space(self) -> None:
        self.word_space = self.number()

    def op_stretch(self) -> None:
        self.stretch = self.number() / _F(100)

    def op_rise(self) -> None:
        self.scope.fonts.rise = self.number()

    def op_draw(self) -> None:
        found = self.pages.form(self.scope, self.pop())
        if found:
            scope, content, matrix = found
            self.out += Interpreter(self.pages, scope, product(matrix, self.ctm), self.log, self.nested + 1).run(content)

    def op_image(self) -> None:
        """Skips an inline image: up to EI before a blank."""
        while True:
            at = self.content.find(b"EI", self.at)
            self.at = len(self.content) if at < 0 else at + 2
            if self.at >= len(self.content) or self.content[self.at : self.at + 1] in (b"\r", b"\n", b" ", b"\t"):
                return


#: Operators: (method, whether it needs a text object).
_OPERATORS = {
    b"BT": (Interpreter.op_begin, False), b"ET": (Interpreter.op_end, False), b"Tf": (Interpreter.op_font, False), b"Tj": (Interpreter.op_show, True),
    b"TJ": (Interpreter.op_show_array, True), b"'": (Interpreter.op_next_show, True), b'"': (Interpreter.op_spaced_show, True), b"Td": (Interpreter.op_move, True),
    b"TD": (Interpreter.op_move_leading, True), b"T*": (Interpreter.op_next, True), b"Tm": (Interpreter.op_matrix, True), b"TL": (Interpreter.op_leading, True),
    b"Tc": (Interpreter.op_char_space, True), b"Tw": (Interpreter.op_word_space, True), b"Tz": (Interpreter.op_stretch, True), b"Ts": (Interpreter.op_rise, True),
    b"cm": (Interpreter.op_concat, False), b"q": (Interpreter.op_save, False), b"Q": (Interpreter.op_restore, False), b"Do": (Interpreter.op_draw, False),
    b"BI": (Interpreter.op_image, False),
}
