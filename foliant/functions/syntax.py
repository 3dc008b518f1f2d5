"""PDF syntax: objects as tagged slices of bytes.

An object is ``(kind, raw)``: a kind code and the slice that spells it. Slices are
parsed one level at a time, when they are needed. Everything here is pure and works on
``bytes``; a slice that can't be read raises ``Malformed``.
"""

from __future__ import annotations

import binascii
import codecs
import functools
import re

import numpy as np

DICTIONARY, ARRAY, STRING, VALUE, REFERENCE, NAME = range(1, 7)

Object = tuple[int, bytes]
Dictionary = dict[bytes, Object]


class Malformed(ValueError):
    """Bytes that don't follow the syntax an operator needs."""


_BLANK = re.compile(rb"(?:[\r\n \t]+|%[^\r\n]*(?=[\r\n]))*")
_NAME_END = re.compile(rb"[\r\t\n /\](<>]")
_KEY_END = re.compile(rb"[\r\t\n /<\[(]")
_VALUE_END = re.compile(rb"[\r\t\n /\]\[(<>]")
_REFERENCE = re.compile(rb"(\d+)[\n\t\r ]+(\d+)[\n\t\r ]+R")
_ROUND = re.compile(rb"\\.|[()]", re.S)
_ANGLE = re.compile(rb"\\.|[<>]", re.S)
_IN_DICTIONARY = re.compile(rb"<<|>>|[(<]")
_IN_ARRAY = re.compile(rb"[(<\[\]]")
_TOKEN_END = re.compile(rb"[ \r\n\t/\[(<]")
_ESCAPE = re.compile(rb"\\(\d{1,3}|.|\Z)", re.S)
_REAL = re.compile(rb"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)")
_PAIR = re.compile(rb"(\d+)[ \r\n\t]\D*?(\d+)[ \r\n\t]")
# What most objects look like. Each pattern takes exactly what the functions below would; where
# none matches (comments, deeper nesting, damage), these read on from the same place.
_FLAT_STRING = rb"\((?:[^()\\]++|(?s:\\.))*+\)|<[^<>\\]*+>"
_FLAT_ARRAY = rb"\[[^(<\[\]]*+(?:(?:" + _FLAT_STRING + rb")[^(<\[\]]*+)*+\]"
_FLAT_DICTIONARY = rb"<<[^<>(]*+(?:<<[^<>(]*+>>[^<>(]*+)*+>>"
_REFERRED = rb"\d++[\n\t\r ]++\d++[\n\t\r ]++R"
_KINDS = (_REFERRED, rb"/[^\r\t\n /\](<>]*+", rb"[^\r\n \t%%/\[(<%s][^\r\t\n /\]\[(<>]*+", _FLAT_ARRAY, _FLAT_STRING, _FLAT_DICTIONARY)
_SIMPLE = lambda no: b"|".join(b"(%s)" % (k % no if b"%s" in k else k) for k in _KINDS)
_ENTRY = re.compile(rb"[\r\n \t]*+(/[^\r\t\n /<\[(]*+)[\r\n \t]*+(?:" + _SIMPLE(b"") + rb")")
_ITEM = re.compile(rb"[\r\n \t]*+(?:" + _SIMPLE(rb"\]") + rb")")
_KIND_OF = (REFERENCE, NAME, VALUE, ARRAY, STRING, DICTIONARY)
_FLAT_STRING, _FLAT_ARRAY, _FLAT_DICTIONARY = (re.compile(p) for p in (_FLAT_STRING, _FLAT_ARRAY, _FLAT_DICTIONARY))
#: An escape that Python's own bytes don't have, or read in another way.
_ODD_ESCAPE = re.compile(rb"\\(?![nrtbf()]|[0-7]{1,2}(?!\d)|[0-3][0-7]{2})")
_FIRST_DIGIT = re.compile(rb"\d")
_UNSIGNED, _SIGNED = re.compile(rb"\+?\d{1,20}"), re.compile(rb"[+-]?\d{1,19}")
_CONTINUED = bytes(range(0x80, 0xC0))
_NAMED = {ord("n"): b"\n", ord("r"): b"\r", ord("t"): b"\t", ord("b"): b"\b", ord("f"): b"\f"}


def skip(buf: bytes, at: int, strict: bool = True) -> int:
    """Past blanks and comments. At the end: an error if strict, else ``len(buf)``."""
    if at < len(buf) and buf[at] > 0x25:
        return at
    end = _BLANK.match(buf, at).end() if at <= len(buf) else len(buf)
    if end >= len(buf) or buf[end] == 0x25:
        if strict:
            raise Malformed("nothing follows blanks or a comment")
        return len(buf)
    return end


def find(buf: bytes, what: bytes, at: int = 0) -> int:
    hit = buf.find(what, at)
    if hit < 0:
        raise Malformed(f"no {what!r} after {at}")
    return hit


def _until(pattern: re.Pattern, buf: bytes, at: int) -> int:
    m = pattern.search(buf, at)
    return m.start() if m else len(buf)


def string_end(buf: bytes, at: int) -> int:
    """The end of the balanced string that opens at ``at`` with ( or <."""
    if flat := _FLAT_STRING.match(buf, at):
        return flat.end()
    opens, depth = buf[at : at + 1], 0
    if opens not in (b"(", b"<"):
        raise Malformed("a string starts with ( or <")
    for m in (_ROUND if opens == b"(" else _ANGLE).finditer(buf, at):
        t = m.group()
        if len(t) == 1:
            depth += 1 if t == opens else -1
            if not depth:
                return m.end()
    raise Malformed("a string isn't closed")


def dictionary_end(buf: bytes, at: int) -> int:
    """The end of the balanced << >> that opens at ``at``; strings inside are skipped."""
    if flat := _FLAT_DICTIONARY.match(buf, at):
        return flat.end()
    depth, at = 1, at + 2
    while m := _IN_DICTIONARY.search(buf, at):
        t, at = m.group(), m.end()
        if t == b"<<":
            depth += 1
        elif t == b">>":
            depth -= 1
            if not depth:
                return at
        else:
            at = string_end(buf, m.start())
    raise Malformed("a dictionary isn't closed")


def array_end(buf: bytes, at: int) -> int:
    if flat := _FLAT_ARRAY.match(buf, at):
        return flat.end()
    depth, at = 1, at + 1
    while m := _IN_ARRAY.search(buf, at):
        t, at = m.group(), m.end()
        if t == b"[":
            depth += 1
        elif t == b"]":
            depth -= 1
            if not depth:
                return at
        elif buf[m.start() : m.start() + 2] == b"<<":
            at = dictionary_end(buf, m.start())
        else:
            at = string_end(buf, m.start())
    raise Malformed("an array isn't closed")


def kind_at(buf: bytes, at: int) -> tuple[int, int]:
    """(kind, start) of the next object."""
    at = skip(buf, at)
    if at + 1 == len(buf):
        raise Malformed("not enough data for an object")
    first = buf[at : at + 1]
    if first == b"<":
        return (DICTIONARY if buf[at + 1 : at + 2] == b"<" else STRING), at
    known = {b"[": ARRAY, b"(": STRING, b"/": NAME}.get(first)
    return known or (REFERENCE if _REFERENCE.match(buf, at) else VALUE), at


def read(buf: bytes, at: int) -> tuple[int, bytes, int]:
    """(kind, raw, end) of the next object."""
    kind, at = kind_at(buf, at)
    if kind == DICTIONARY:
        end = dictionary_end(buf, at)
    elif kind == ARRAY:
        end = array_end(buf, at)
    elif kind == STRING:
        end = string_end(buf, at)
    elif kind == REFERENCE:
        end = _REFERENCE.match(buf, at).end()
    else:
        end = _until(_NAME_END if kind == NAME else _VALUE_END, buf, at + 1)
    return kind, buf[at:end], end


def dictionary(buf: bytes, at: int = 0) -> Dictionary:
    """One level of the next dictionary; of a key that repeats, the first value."""
    at = find(buf, b"<<", at) + 2
    out: Dictionary = {}
    while True:
        m = _ENTRY.match(buf, at)
        if m and m.end() < len(buf):
            i, at = m.lastindex, m.end()
            out.setdefault(m[1], (_KIND_OF[i - 2], m[i]))
            continue
        at = skip(buf, at)
        if buf[at : at + 2] == b">>":
            return out
        if buf[at : at + 1] != b"/":
            raise Malformed("a key isn't a name")
        end = _KEY_END.search(buf, at + 1)
        if not end:
            raise Malformed("a key has no value")
        kind, raw, after = read(buf, end.start())
        out.setdefault(buf[at : end.start()], (kind, raw))
        at = after


def array(buf: bytes, at: int = 0) -> list[Object]:
    at = find(buf, b"[", at) + 1
    out: list[Object] = []
    while True:
        m = _ITEM.match(buf, at)
        if m and m.end() < len(buf):
            i, at = m.lastindex, m.end()
            out.append((_KIND_OF[i - 1], m[i]))
            continue
        at = skip(buf, at)
        if buf[at : at + 1] == b"]":
            return out
        kind, raw, at = read(buf, at)
        out.append((kind, raw))


def references(raw: bytes) -> list[tuple[int, int]]:
    """(id, generation) of all ``n g R`` in an array."""
    out, at = [], 0
    while m := _FIRST_DIGIT.search(raw, at):
        pair = _PAIR.match(raw, m.start())
        if not pair:
            raise Malformed("not a reference")
        out.append((int(pair[1]), int(pair[2])))
        at = find(raw, b"R", pair.end())
    return out


def reference(raw: bytes) -> tuple[int, int]:
    m = _PAIR.match(raw)
    if not m:
        raise Malformed(f"not a reference: {raw!r}")
    return int(m[1]), int(m[2])


def unsigned(raw: bytes) -> int:
    if not _UNSIGNED.fullmatch(raw) or int(raw) >= 1 << 64:
        raise Malformed(f"{raw!r} isn't an unsigned number")
    return int(raw)


def signed(raw: bytes) -> int:
    if not _SIGNED.fullmatch(raw):
        raise Malformed(f"{raw!r} isn't a number")
    return int(raw)


@functools.lru_cache(1 << 14)
def real(raw: bytes) -> np.float32:
    """The number that ``raw`` starts with, in single precision."""
    m = _REAL.match(raw)
    if not m:
        raise Malformed(f"{raw!r} doesn't start with a number")
    return np.float32(float(m[1]))


def hex_string(raw: bytes) -> bytes:
    """Bytes of <...>. A last odd digit is a byte of its own, as its low half."""
    digits = raw[1:-1].translate(None, b"\n\r ")
    if len(digits) % 2:
        digits = digits[:-1] + b"0" + digits[-1:]
    try:
        return binascii.unhexlify(digits)
    except binascii.Error as e:
        raise Malformed("not a hex string") from e


def _escaped(m: re.Match) -> bytes:
    code = m[1]
    if not code:
        return b"\0"  # a backslash before the closing parenthesis
    if code.isdigit():
        if code.strip(b"01234567") or int(code, 8) > 255:
            raise Malformed(f"\\{code.decode()} isn't an octal byte")
        return bytes([int(code, 8)])
    return _NAMED.get(code[0], code)


def text_string(raw: bytes) -> bytes:
    """Bytes of a literal or hex string."""
    if raw[:1] == b"<":
        return hex_string(raw)
    body = raw[1:-1]
    if b"\\" not in body:
        return body
    if b"\\\\" in body or _ODD_ESCAPE.search(body):
        return _ESCAPE.sub(_escaped, body)
    return codecs.escape_decode(body.replace(b"\\(", b"(").replace(b"\\)", b")"))[0]


def token(buf: bytes, at: int) -> tuple[bytes, int]:
    """(token, end): bytes up to the next blank or one of / [ ( <."""
    end = _until(_TOKEN_END, buf, at + 1)
    return buf[at:end], end


def code_points(text: bytes) -> int:
    return len(text) if text.isascii() else len(text.translate(None, _CONTINUED))
