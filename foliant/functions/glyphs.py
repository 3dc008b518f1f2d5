"""Text of glyph names.

Most names spell Unicode's own names, run together, and are built from these by rule; what
follows no rule is listed as fixed values. A published list (lines ``name;HHHH HHHH``) can
be given in addition, as a parameter: its names come first.
"""

from __future__ import annotations

import functools
import re
import unicodedata

from pyspark.sql import SparkSession

# Glyph names that follow no rule below.
_NAMES = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(",
    "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "colon": ":", "semicolon": ";", "less": "<",
    "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_",
    "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~", "exclamdown": "¡", "cent": "¢", "sterling": "£", "currency": "¤", "yen": "¥",
    "brokenbar": "¦", "section": "§", "dieresis": "¨", "copyright": "©", "ordfeminine": "ª", "guillemotleft": "«", "logicalnot": "¬", "registered": "®",
    "macron": "¯", "degree": "°", "plusminus": "±", "twosuperior": "²", "threesuperior": "³", "acute": "´", "mu": "µ", "paragraph": "¶", "periodcentered": "·",
    "cedilla": "¸", "onesuperior": "¹", "ordmasculine": "º", "guillemotright": "»", "onequarter": "¼", "onehalf": "½", "threequarters": "¾", "questiondown": "¿",
    "AE": "Æ", "ae": "æ", "Eth": "Ð", "eth": "ð", "Oslash": "Ø", "oslash": "ø", "Thorn": "Þ", "thorn": "þ", "germandbls": "ß", "multiply": "×", "divide": "÷",
    "OE": "Œ", "oe": "œ", "Lslash": "Ł", "lslash": "ł", "dotlessi": "ı", "florin": "ƒ", "circumflex": "ˆ", "caron": "ˇ", "breve": "˘", "dotaccent": "˙",
    "ring": "˚", "ogonek": "˛", "tilde": "˜", "hungarumlaut": "˝", "endash": "–", "emdash": "—", "quoteleft": "‘", "quoteright": "’", "quotesinglbase": "‚",
    "quotedblleft": "“", "quotedblright": "”", "quotedblbase": "„", "dagger": "†", "daggerdbl": "‡", "bullet": "•", "ellipsis": "…", "perthousand": "‰",
    "guilsinglleft": "‹", "guilsinglright": "›", "fraction": "⁄", "Euro": "€", "trademark": "™", "minus": "−", "fi": "ﬁ", "fl": "ﬂ", "ff": "ﬀ", "ffi": "ﬃ",
    "ffl": "ﬄ", "infinity": "∞", "integral": "∫", "lozenge": "◊", "notequal": "≠", "lessequal": "≤", "greaterequal": "≥", "partialdiff": "∂", "summation": "∑",
    "product": "∏", "radical": "√", "approxequal": "≈", "Delta": "∆", "Omega": "Ω", "nbspace": " ", "sfthyphen": "­", "Dcroat": "Đ", "dcroat": "đ",
    "Hbar": "Ħ", "hbar": "ħ", "Tbar": "Ŧ", "tbar": "ŧ", "Eng": "Ŋ", "eng": "ŋ", "IJ": "Ĳ", "ij": "ĳ", "kgreenlandic": "ĸ", "longs": "ſ", "arrowleft": "←",
    "arrowup": "↑", "arrowright": "→", "arrowdown": "↓", "element": "∈", "emptyset": "∅", "universal": "∀", "existential": "∃", "proportional": "∝",
    "angle": "∠", "logicaland": "∧", "logicalor": "∨", "intersection": "∩", "union": "∪", "therefore": "∴", "similar": "∼", "congruent": "≅", "equivalence": "≡",
    "propersubset": "⊂", "propersuperset": "⊃", "notsubset": "⊄", "reflexsubset": "⊆", "reflexsuperset": "⊇", "circleplus": "⊕", "circlemultiply": "⊗",
    "perpendicular": "⊥", "dotmath": "⋅", "gradient": "∇", "aleph": "ℵ", "weierstrass": "℘", "Ifraktur": "ℑ", "Rfraktur": "ℜ", "spade": "♠", "club": "♣",
    "heart": "♥", "diamond": "♦", "arrowboth": "↔", "sigma1": "ς", "theta1": "ϑ", "phi1": "ϕ", "omega1": "ϖ", "Upsilon1": "ϒ", "Lambda": "Λ", "lambda": "λ", "nsuperior": "ⁿ",
}
# Cyrillic letters whose names aren't Unicode's.
_CYRILLIC = {"E": 0x404, "I": 0x406, "Ii": 0x418, "Iishort": 0x419, "Ereversed": 0x42D, "Yeri": 0x42B, "IA": 0x42F, "IU": 0x42E, "Ge": 0x413, "Kha": 0x425, "Uk": 0x478, "Ushort": 0x40E, "Gheupturn": 0x490}
# Names of the private area, by first code.
_PRIVATE = {
    0xF6BE: ["dotlessj", "LL", "ll", "Scedilla", "scedilla", "commaaccent", "afii10063", "afii10064", "afii10192", "afii10831", "afii10832", "Acute", "Caron", "Dieresis", "DieresisAcute", "DieresisGrave", "Grave", "Hungarumlaut", "Macron", "cyrBreve", "cyrFlex", "dblGrave", "cyrbreve", "cyrflex", "dblgrave", "dieresisacute", "dieresisgrave", "copyrightserif", "registerserif", "trademarkserif", "onefitted", "rupiah", "threequartersemdash", "centinferior", "centsuperior", "commainferior", "commasuperior", "dollarinferior", "dollarsuperior", "hypheninferior", "hyphensuperior", "periodinferior", "periodsuperior", "asuperior", "bsuperior", "dsuperior", "esuperior", "isuperior", "lsuperior", "msuperior", "osuperior", "rsuperior", "ssuperior", "tsuperior", "Brevesmall", "Caronsmall", "Circumflexsmall", "Dotaccentsmall", "Hungarumlautsmall", "Lslashsmall", "OEsmall", "Ogoneksmall", "Ringsmall", "Scaronsmall", "Tildesmall", "Zcaronsmall"],
    0xF8E5: ["radicalex", "arrowvertex", "arrowhorizex", "registersans", "copyrightsans", "trademarksans", "parenlefttp", "parenleftex", "parenleftbt", "bracketlefttp", "bracketleftex", "bracketleftbt", "bracelefttp", "braceleftmid", "braceleftbt", "braceex", "integralex", "parenrighttp", "parenrightex", "parenrightbt", "bracketrighttp", "bracketrightex", "bracketrightbt", "bracerighttp", "bracerightmid", "bracerightbt", "apple"],
}
# Box drawing by number, and what Arabic, Hebrew and Cyrillic numbers mean,
# as (first number, first code, how many) and as single ones.
_BOXES = {
    1: 0x250C, 2: 0x2514, 3: 0x2510, 4: 0x2518, 5: 0x253C, 6: 0x252C, 7: 0x2534, 8: 0x251C, 9: 0x2524, 10: 0x2500, 11: 0x2502, 19: 0x2561, 20: 0x2562, 21: 0x2556, 22: 0x2555,
    23: 0x2563, 24: 0x2551, 25: 0x2557, 26: 0x255D, 27: 0x255C, 28: 0x255B, 36: 0x255E, 37: 0x255F, 38: 0x255A, 39: 0x2554, 40: 0x2569, 41: 0x2566, 42: 0x2560, 43: 0x2550,
    44: 0x256C, 45: 0x2567, 46: 0x2568, 47: 0x2564, 48: 0x2565, 49: 0x2559, 50: 0x2558, 51: 0x2552, 52: 0x2553, 53: 0x256B, 54: 0x256A,
}
_NUMBERED = [(10017, 0x410, 6), (10023, 0x401, 1), (10024, 0x416, 26), (10050, 0x490, 1), (10051, 0x402, 11), (10062, 0x40E, 1), (10065, 0x430, 6), (10071, 0x451, 1), (10072, 0x436, 26), (10098, 0x491, 1), (10099, 0x452, 11), (10110, 0x45E, 1), (10145, 0x40F, 1), (57392, 0x660, 10), (57409, 0x621, 26), (57440, 0x640, 19), (57664, 0x5D0, 27), (57716, 0x5F0, 3)]
_SINGLE = {
    10146: 0x462, 10147: 0x472, 10148: 0x474, 10193: 0x45F, 10194: 0x463, 10195: 0x473, 10196: 0x475, 10846: 0x4D9, 57381: 0x66A, 57388: 0x60C, 57403: 0x61B, 57407: 0x61F, 57470: 0x647, 57505: 0x6A4, 57506: 0x67E, 57507: 0x686, 57508: 0x698,
    57509: 0x6AF, 57511: 0x679, 57512: 0x688, 57513: 0x691, 57514: 0x6BA, 57519: 0x6D2, 57534: 0x6D5, 57636: 0x20AA, 57645: 0x5BE, 57658: 0x5C3, 57694: 0xFB2A, 57695: 0xFB2B, 57700: 0xFB4B, 57705: 0xFB35, 57723: 0xFB1F, 57793: 0x5B4, 57794: 0x5B5,
    57795: 0x5B6, 57796: 0x5BB, 57797: 0x5B8, 57798: 0x5B7, 57799: 0x5B0, 57800: 0x5B2, 57801: 0x5B1, 57802: 0x5B3, 57803: 0x5C2, 57804: 0x5C1, 57806: 0x5B9, 57807: 0x5BC, 57839: 0x5BD, 57841: 0x5BF, 57842: 0x5C0, 57929: 0x2BC,
    61248: 0x2105, 61289: 0x2113, 61352: 0x2116, 61573: 0x202C, 61574: 0x202D, 61575: 0x202E, 61664: 0x200C, 299: 0x200E, 300: 0x200F, 301: 0x200D, 208: 0x2015, 8941: 0x20A4,
}

_ACCENTS = {
    "grave": 0x300, "acute": 0x301, "circumflex": 0x302, "tilde": 0x303, "macron": 0x304, "breve": 0x306, "dotaccent": 0x307, "dieresis": 0x308, "ring": 0x30A,
    "hungarumlaut": 0x30B, "caron": 0x30C, "cedilla": 0x327, "commaaccent": 0x327, "ogonek": 0x328, "tonos": 0x301, "dot": 0x307, "dotbelow": 0x323, "hookabove": 0x309,
    "horn": 0x31B, "dblgrave": 0x30F, "invertedbreve": 0x311, "linebelow": 0x331, "circumflexbelow": 0x32D, "tildebelow": 0x330, "dieresisbelow": 0x324, "ringbelow": 0x325,
    "brevebelow": 0x32E,
}
#: Script: how names end, the first word of Unicode's, its codes.
_SCRIPTS = [
    ("cyrillic", "CYRILLIC", [(0x400, 0x4FF)]), ("armenian", "ARMENIAN", [(0x531, 0x58A), (0xFB13, 0xFB17)]), ("hebrew", "HEBREW", [(0x591, 0x5F4), (0xFB1D, 0xFB4F)]),
    ("arabic", "ARABIC", [(0x60C, 0x6D5), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC)]), ("persian", "EXTENDED", [(0x6F0, 0x6F9)]), ("deva", "DEVANAGARI", [(0x901, 0x970)]), ("bengali", "BENGALI", [(0x981, 0x9FB)]),
    ("gurmukhi", "GURMUKHI", [(0xA01, 0xA74)]), ("gujarati", "GUJARATI", [(0xA81, 0xAE6)]), ("thai", "THAI", [(0xE01, 0xE5B)]), ("hiragana", "HIRAGANA", [(0x3041, 0x309E)]),
    ("katakana", "KATAKANA", [(0x30A1, 0x30FE)]), ("bopomofo", "BOPOMOFO", [(0x3105, 0x312C)]), ("korean", "HANGUL", [(0x3131, 0x318E)]), ("greek", "GREEK", [(0x370, 0x3FF)]),
    ("coptic", "COPTIC", [(0x3E2, 0x3EF)]), ("katakanahalfwidth", "HALFWIDTH", [(0xFF65, 0xFF9F)]),
]
_DROPPED = {"LETTER", "CAPITAL", "CHARACTER", "DIGIT", "SIGN", "POINT", "ACCENT", "PUNCTUATION", "MARK", "LIGATURE", "WITH", "SYMBOL", "KATAKANA", "ARABIC-INDIC", "AND"}
_DIGITS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
_VOWEL_SIGNS = {"gurmukhi": "matra"}


def _lookup(name: str) -> str | None:
    try:
        return unicodedata.lookup(name)
    except KeyError:
        return None


def _joined(words: list[str]) -> str:
    return "".join(words).replace("-", "").lower()


def _orders(words: list[str]) -> list[list[str]]:
    """The words as they are, and with the first one last (``SHORT E``: eshort)."""
    return [words, words[1:] + words[:1]] if len(words) > 1 else [words]


@functools.cache
def _spelled() -> dict[str, str]:
    """Names that spell Unicode's."""
    out: dict[str, str] = {}
    for suffix, first, ranges in _SCRIPTS:
        for code in (c for lo, hi in ranges for c in range(lo, hi + 1)):
            words = unicodedata.name(chr(code), "").split()
            if not words or not words[0].startswith(first):
                continue
            words, tail = [w.replace("DIAERESIS", "DIERESIS") for w in words[1:]], ""
            capital = "CAPITAL" in words
            if words[-1] == "FORM":
                words, tail = words[:-2], words[-2].lower()
            if words[:2] == ["VOWEL", "SIGN"]:
                words, tail = words[2:], _VOWEL_SIGNS.get(suffix, "vowelsign")
            elif words[:2] == ["CURRENCY", "NUMERATOR"]:
                words, tail = words[2:], "numerator"
            case = {"SMALL"} if first in ("CYRILLIC", "ARMENIAN", "GREEK", "COPTIC") else set()
            words = [w for w in words if w not in _DROPPED | case]
            for order in _orders(words):
                name = _joined(order) + tail
                if name:
                    out.setdefault((name[0].upper() if capital else name[0]) + name[1:] + suffix, chr(code))
                    if suffix == "hebrew":
                        out.setdefault(name, chr(code))
    for name, code in _CYRILLIC.items():
        small = code + (0x50 if code < 0x410 else 0x20 if code < 0x430 else 1)
        out[f"{name}cyrillic"], out[f"{name.lower()}cyrillic"] = chr(code), chr(small)
    signs = {t: n for n, t in _NAMES.items()}
    for code in range(0xFE50, 0xFE6C):  # small forms
        base = signs.get(unicodedata.normalize("NFKC", chr(code)))
        if base and base not in ("exclam", "question", "ampersand"):
            out[f"{base}small"] = chr(code)
    for code in range(0xFE30, 0xFE45):  # vertical forms
        base = signs.get(unicodedata.normalize("NFKC", chr(code)))
        if base:
            out[f"{base}vertical"] = chr(code)
    for code in range(0x3371, 0x33DF):  # squared units
        plain = unicodedata.normalize("NFKC", chr(code)).replace("2", "squared").replace("3", "cubed").replace("μ", "mu")
        out.setdefault(f"{plain}square", chr(code))
        out.setdefault(f"{plain.lower()}square", chr(code))
    for code in range(0x3300, 0x3358):
        words = unicodedata.name(chr(code), "").split()
        if words[:1] == ["SQUARE"]:
            out.setdefault(f"{_joined(words[1:])}square", chr(code))
    for lo, hi, first, end in ((0x300, 0x345, "COMBINING", "cmb"), (0x2B0, 0x2FF, "MODIFIER LETTER", "mod")):
        for code in range(lo, hi):
            name = unicodedata.name(chr(code), "")
            if name.startswith(first):
                words = [w for w in name.removeprefix(first).split() if w not in ("ACCENT", "LETTER", "DIACRITIC")]
                for order in _orders(words):
                    out.setdefault(_joined(order) + end, chr(code))
    for code in range(0x2B0, 0x2E4):
        words = unicodedata.name(chr(code), "").split()
        if words[:3] == ["MODIFIER", "LETTER", "SMALL"]:
            for order in _orders(words[3:]):
                out.setdefault(f"{_joined(order)}superior", chr(code))
    for lo, hi, pattern in ((0x3200, 0x3244, r"PARENTHESIZED (HANGUL|IDEOGRAPH) (.*)"), (0x3260, 0x32B1, r"CIRCLED (HANGUL|IDEOGRAPH) (.*)")):
        for code in range(lo, hi):
            m = re.fullmatch(pattern, unicodedata.name(chr(code), ""))
            if m:
                end = "paren" if lo == 0x3200 else "circle"
                word = _joined(m[2].split())
                for name in (f"{word}{end}korean",) if m[1] == "HANGUL" else (f"{word}ideographic{end}", f"ideographic{word}{end}", f"ideograph{word}{end}"):
                    out.setdefault(name, chr(code))
    for first, names in _PRIVATE.items():
        out |= {n: chr(first + i) for i, n in enumerate(names) if n not in ("Scedilla", "scedilla")}
    out |= {f"SF{n:02d}0000": chr(c) for n, c in _BOXES.items()}
    for first, code, n in _NUMBERED:
        out |= {f"afii{first + i}": chr(code + i) for i in range(n)}
    return out | {f"afii{n:05d}" if n > 999 else f"afii{n}": chr(c) for n, c in _SINGLE.items()} | {"afii00208": "―", "afii08941": "₤"}


def _by_word(name: str) -> str | None:
    """Letters and numbers whose names end in what is done to them."""
    for suffix, pattern in (
        ("roman", "{}ROMAN NUMERAL {}"), ("circle", "CIRCLED DIGIT {1}"), ("circle", "CIRCLED NUMBER {1}"), ("paren", "PARENTHESIZED DIGIT {1}"), ("paren", "PARENTHESIZED NUMBER {1}"),
        ("period", "DIGIT {1} FULL STOP"), ("period", "NUMBER {1} FULL STOP"), ("circleinversesansserif", "DINGBAT NEGATIVE CIRCLED SANS-SERIF DIGIT {1}"),
        ("superior", "SUPERSCRIPT {1}"), ("inferior", "SUBSCRIPT {1}"),
    ):
        base = name.removesuffix(suffix)
        if base != name and len(base) > 2:
            small = "SMALL " if suffix == "roman" and base[0].islower() else ""
            if found := _lookup(pattern.format(small, base.upper()) if "{1}" not in pattern else pattern.format(small, base.upper())):
                return found
    letter = name[:1]
    case = "CAPITAL" if letter.isupper() else "SMALL"
    for suffix in ("hook", "stroke", "tail", "curl", "topbar", "retroflexhook", "middletilde", "slash"):
        if name == letter + suffix and letter.isalpha() and (found := _lookup(f"LATIN {case} LETTER {letter.upper()} WITH {suffix.replace('retroflexhook', 'retroflex hook').replace('middletilde', 'middle tilde').upper()}")):
            return found
    for suffix in ("turned", "open", "reversed", "inverted"):
        if name == letter + suffix and letter.isalpha() and (found := _lookup(f"LATIN {case} LETTER {suffix.upper()} {letter.upper()}")):
            return found
    return None


def glyph_list(lines: list[str]) -> dict[str, str]:
    """Text by name, of the lines of a published list."""
    pairs = (x.strip().split(";")[:2] for x in lines if ";" in x and not x.startswith("#"))
    return {n: "".join(chr(int(h, 16)) for h in codes.split()) for n, codes in pairs}


def read_glyph_list(spark: SparkSession, path: str) -> dict[str, str]:
    return glyph_list([r["value"] for r in spark.read.text(path).collect()])  # a few thousand lines


_given: dict[str, str] = {}


def use(names: dict[str, str] | None) -> None:
    """Has names of a published list come first, in this process."""
    if names and names != _given:
        _given.clear()
        _given.update(names)
        glyph.cache_clear()


@functools.lru_cache(maxsize=1 << 14)
def glyph(name: str) -> str | None:
    """The text of a glyph name (without /), or None if it is unknown."""
    if name in _given:
        return _given[name]
    if name == ".notdef":
        return ""
    if name in _NAMES:
        return _NAMES[name]
    if len(name) == 1 and name.isascii():
        return name
    if name in _DIGITS:
        return str(_DIGITS.index(name))
    spelled = _spelled()
    if name in spelled:
        return spelled[name]
    for prefix in ("uni", "u"):
        code = name[len(prefix) :]
        if name.startswith(prefix) and 4 <= len(code) <= 6 and not code.strip("0123456789ABCDEF"):
            return chr(int(code, 16)) if int(code, 16) < 0x110000 else None
    base = name.removesuffix("small")
    if base != name and (t := glyph(base[:1].lower() + base[1:] if base not in ("AE", "OE") else base)) and len(t) == 1 and ord(t) < 256:  # the private area's
        return chr(0xF700 + ord(t.lower()))
    base = name.removesuffix("oldstyle")
    if base != name and base in _DIGITS:
        return chr(0xF730 + _DIGITS.index(base))
    if base != name and base in ("dollar", "cent"):
        return chr(0xF700 + ord(_NAMES[base]))
    for suffix, first in (("circle", 0x24D0), ("paren", 0x249C)):
        base = name.removesuffix(suffix)
        if base != name and len(base) == 1 and base.isalpha() and (base.islower() or suffix == "circle"):
            return chr(first + ord(base) - ord("a")) if base.islower() else chr(0x24B6 + ord(base) - ord("A"))
    base = name.removesuffix("monospace")
    if base != name and (t := glyph(base)) and len(t) == 1 and "!" <= t <= "~":
        return chr(ord(t) + 0xFEE0)
    if name in ("Scommaaccent", "scommaaccent"):
        return chr(0x218 + name[0].islower())
    for suffix, mark in _ACCENTS.items():
        base = name.removesuffix(suffix)
        if base != name and base:
            letter = "ı" if base == "dotlessi" else base if len(base) == 1 else glyph(base)
            composed = unicodedata.normalize("NFC", letter + chr(mark)) if letter else ""
            if len(composed) == 1:
                return composed
    if found := _by_word(name):
        return found
    for old, new in (("altone", ""), ("low", ""), ("hack", ""), ("wide", ""), ("narrow", ""), ("quarter", ""), ("cirkle", "circle"), ("comb", "cmb")):
        if old in name and (shorter := name.replace(old, new)) and shorter != name and (t := glyph(shorter)):
            return t
    if (shorter := re.sub("[0-9][0-9a-f]{1,2}$", "", name)) in spelled and ("ְ" <= spelled[shorter][0] <= "ּ"):
        return spelled[shorter]  # points by number
    if name[1:].islower() and (found := _lookup(f"GREEK {'CAPITAL' if name[:1].isupper() else 'SMALL'} LETTER {name.upper()}")):
        return found
    return None
