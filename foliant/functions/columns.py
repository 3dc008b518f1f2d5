"""Scalar operators of PDF syntax as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hex_string(c: Column) -> Column:
    """Bytes of a hex string without its brackets; a last odd digit is a byte's low half."""
    d = F.regexp_replace(c, "[\n\r ]", "")
    even = F.length(d) - F.length(d) % 2
    return F.when(F.length(d) % 2 == 0, F.unhex(d)).otherwise(F.concat(F.unhex(F.substring(d, F.lit(1), even)), F.unhex(F.concat(F.lit("0"), F.substring(d, even + 1, F.lit(1))))))


def ascii_hex(c: Column) -> Column:
    """ASCIIHex data up to >; a last odd digit is a byte's high half."""
    d = F.regexp_replace(F.regexp_replace(c, "(?s)>.*", ""), "[\\x00\t\n\f\r ]", "")
    return F.unhex(F.when(F.length(d) % 2 == 0, d).otherwise(F.concat(d, F.lit("0"))))


def object_kind(c: Column) -> Column:
    """The kind code of the object that text starts with."""
    t = F.regexp_replace(c, "^(?:[\r\n \t]+|%[^\r\n]*(?=[\r\n]))*", "")
    return (
        F.when(t.startswith("["), 2).when(t.startswith("("), 3).when(t.startswith("<<"), 1).when(t.startswith("<"), 3).when(t.startswith("/"), 6)
        .when(t.rlike(r"^\d+[\n\t\r ]+\d+[\n\t\r ]+R"), 5).otherwise(4)
    )


def unsigned(c: Column) -> Column:
    """A strict unsigned number, or null."""
    return F.when(c.rlike(r"^\+?\d+$"), c.try_cast("decimal(20,0)"))


def tokens(c: Column) -> Column:
    """Content-stream tokens: a token ends at a blank or before one of / [ ( <."""
    return F.regexp_extract_all(c, F.lit(r"[^ \r\n\t][^ \r\n\t/\[(<]*"), F.lit(0))


def utf8_length(c: Column) -> Column:
    return F.char_length(c)


def text_width(codes: Column, widths: Column, default: Column, scale: Column) -> Column:
    """The sum of a font's widths (a map by code) over an array of codes."""
    return F.aggregate(codes, F.lit(0.0), lambda acc, c: acc + F.coalesce(F.try_element_at(widths, c), default) * scale)


def point(m: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def product(m: list[Column], n: list[Column]) -> list[Column]:
    """The map m, then n."""
    return [
        n[0] * m[0] + n[2] * m[1], n[1] * m[0] + n[3] * m[1], n[0] * m[2] + n[2] * m[3], n[1] * m[2] + n[3] * m[3],
        n[0] * m[4] + n[2] * m[5] + n[4], n[1] * m[4] + n[3] * m[5] + n[5],
    ]


def code_range(first: Column, last: Column, text: Column) -> Column:
    """A bfrange to a character: (code, character) pairs up to a last byte of 255."""
    room = F.lit(255) - text % 256
    return F.transform(F.sequence(F.lit(0), F.least(last - first, room)), lambda i: F.struct((first + i).alias("code"), (text + i).alias("unicode")))
