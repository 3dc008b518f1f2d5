"""Single-byte encodings, multi-byte charsets and core font widths.

Most tables are built from Python's codecs; what these can't give is listed as fixed values. ``compat`` keeps the known deviations from the published
encodings, listed apart.
"""

from __future__ import annotations

import functools
import unicodedata

STANDARD, WIN, MAC, EXPERT = "standard", "win", "mac", "expert"

# The upper half of the published StandardEncoding, by code.
_STANDARD_UPPER = {
    161: "¡", 162: "¢", 163: "£", 164: "⁄", 165: "¥", 166: "ƒ", 167: "§", 168: "¤", 169: "'", 170: "“", 171: "«", 172: "‹", 173: "›", 174: "ﬁ", 175: "ﬂ",
    177: "–", 178: "†", 179: "‡", 180: "·", 182: "¶", 183: "•", 184: "‚", 185: "„", 186: "”", 187: "»", 188: "…", 189: "‰", 191: "¿",
    193: "`", 194: "´", 195: "ˆ", 196: "˜", 197: "¯", 198: "˘", 199: "˙", 200: "¨", 202: "˚", 203: "¸", 205: "˝", 206: "˛", 207: "ˇ", 208: "—",
    225: "Æ", 227: "ª", 232: "Ł", 233: "Ø", 234: "Œ", 235: "º", 241: "æ", 245: "ı", 248: "ł", 249: "ø", 250: "œ", 251: "ß",
}

# MacExpertEncoding by code, where it isn't a digit, a letter or an
# accented small capital.
_EXPERT = {
    32: " ", 33: "", 34: "", 35: "", 36: "", 37: "", 38: "", 39: "", 40: "⁽", 41: "⁾", 42: "..", 43: ".",
    45: "-", 46: ".", 47: "⁄", 58: ":", 59: ";", 61: "", 63: "", 68: "", 71: "¼", 72: "½", 73: "¾", 74: "⅛", 75: "⅜", 76: "⅝", 77: "⅞",
    78: "⅓", 79: "⅔", 86: "ff", 87: "fi", 88: "fl", 89: "ffi", 90: "ffl", 91: "₍", 93: "₎", 94: "", 95: "", 96: "", 123: "₡", 124: "",
    125: "", 126: "", 129: "", 130: "", 161: "⁸", 162: "₄", 163: "₃", 164: "₆", 165: "₈", 166: "⁷", 167: "", 169: "", 170: "₃",
    172: "", 174: "", 175: "", 176: "₅", 178: "", 179: "", 180: "", 182: "", 185: "", 187: "₉", 188: "₀",
    189: "", 190: "", 191: "", 192: "", 193: "₁", 194: "", 201: "", 207: "", 208: "‒", 209: "", 214: "",
    216: "", 228: "", 229: "", 230: "", 233: "", 234: "", 235: "", 241: "", 242: "", 243: "",
    244: "", 245: "", 246: "ⁿ", 247: "", 248: "", 249: "", 250: "", 251: "",
}

# Where ``compat`` departs from the published encodings.
_DEVIATIONS = {
    STANDARD: {38: "%"},
    WIN: {34: "@", 44: ""},
    MAC: {44: "", 219: "€¹"},
    EXPERT: {44: ""},
}


@functools.cache
def single_byte(name: str, compat: bool = True) -> dict[int, str]:
    """Text by code of one of the four base encodings."""
    if name == STANDARD:
        out = {c: chr(c) for c in range(32, 127)} | {39: "’", 96: "‘"} | _STANDARD_UPPER
    elif name == WIN:
        out = {c: bytes([c]).decode("cp1252", "replace") for c in range(32, 256)}
        out = {c: "•" if t in ("�", "\x7f") else t for c, t in out.items()} | {160: " ", 173: "-"}
    elif name == MAC:
        out = {c: bytes([c]).decode("mac_roman") for c in range(32, 256) if c != 127} | {202: " "}
    else:
        # small capitals lie at the lower-case letters; superior digits from 1 to 8, then 0
        out = {48 + i: str(i) for i in range(10)} | {97 + i: chr(65 + i) for i in range(26)} | {218 + i: str(1 + i) for i in range(8)} | {226: "0"}
        # accented small capitals lie where MacRoman has the accented letters
        out |= {c: chr(0xF700 + ord(bytes([c]).decode("mac_roman"))) for c in range(135, 160)}
        out |= _EXPERT | {44: "" if False else ","}
    return out | (_DEVIATIONS[name] if compat else {})


#: Charsets by what the name of a predefined character map says: (pieces, codec).
#: None: the bytes are UTF-8. Absent codecs make an error.
_UNICODE = {"UCS2": "utf-16-be", "UTF8": None, "UTF16": "utf-16-be", "UTF32": "utf-32-be"}
_MAPS = {
    "gbk": ("GBK-EUC-H", "GBK-EUC_V", "GBKp-EUC-H", "GBKp-EUC-V"),
    "gb18030": ("GBK2K-H", "GBK2K-V"),
    "gb2312": ("GB-EUC", "GBpc-EUC", "GBT-EUC", "GBTpc-EUC"),
    "iso2022_cn": ("GB", "GBT", "CNS1", "CNS2"),
    "euc_tw": ("CNS-EUC",),
    "big5": ("B5", "B5pc", "ETen-B5", "ETenms-B5", "ETHK-B5", "HKdla-B5", "HKdlb-B5", "HKgccs-B5", "HKm314-B5", "HKm471-B5", "HKscs-B5"),
    "iso2022_jp": ("", "Add", "Ext", "NWP", "78"),
    "shift_jis": ("RKSJ", "83pv-RKSJ", "Add-RKSJ", "Ext-RKSJ", "90pv-RKSJ", "90ms-RKSJ", "90msp-RKSJ", "78-RKSJ", "78ms-RKSJ"),
    "euc_jp": ("EUC", "78-EUC", "Hojo-EUC"),
    "iso2022_jp_1": ("Hojo",),
    "iso2022_kr": ("KSC",),
    "euc_kr": ("KSC-EUC", "KSCpv-EUC"),
    "cp949": ("KSCms-EUC", "KSCms-EUC-HW", "KSC-Johab"),
}
_COLLECTIONS = {
    "UniCNS": ("UCS2", "UTF8", "UTF16", "UTF32"), "UniGB": ("UCS2", "UTF8", "UTF16", "UTF32"), "UniJIS": ("UCS2", "UCS2-HW", "UTF8", "UTF16", "UTF32"),
    "UniJIS2004": ("UTF8", "UTF16", "UTF32"), "UniJISX0213": ("UTF32",), "UniJISX02132004": ("UTF32",), "UniAKR": ("UTF8", "UTF16", "UTF32"),
    "UniKS": ("UCS2", "UTF8", "UTF16", "UTF32"), "UniHojo": ("UCS2", "UTF8", "UTF16", "UTF32"),
}


@functools.cache
def charsets() -> dict[str, str | None]:
    """Codec by name of predefined character map."""
    out: dict[str, str | None] = {}
    for codec, stems in _MAPS.items():
        for stem in stems:
            if stem.endswith(("-H", "_V", "-V")):
                out[stem] = codec
            else:
                out |= {f"{stem}-{d}".lstrip("-"): codec for d in "HV"}
    for stem, forms in _COLLECTIONS.items():
        out |= {f"{stem}-{form}-{d}": _UNICODE[form.split("-")[0]] for form in forms for d in "HV"}
    return out


def is_vertical(name: str) -> bool:
    """Whether text in this character map runs downwards."""
    return name == "Identity-V" or name in charsets() and name.endswith("V")


def _iso2022_cn(raw: bytes) -> str:
    """ASCII, and GB 2312 between shifts after its designation; other sets' characters, for
    which there is no table, are left out."""
    out, at, shifted, known = [], 0, False, False
    while at < len(raw):
        if raw[at] == 0x1B and len(raw) - at > 3:
            known, at = raw[at + 1 : at + 4] == b"$)A", at + 4
        elif raw[at] in (0x0E, 0x0F):
            shifted, at = raw[at] == 0x0E, at + 1
        elif shifted:
            out.append(bytes(b | 0x80 for b in raw[at : at + 2]).decode("gb2312", "ignore") if known else "")
            at += 2
        else:
            shifted = shifted and raw[at] not in b"\r\n"
            out.append(chr(raw[at]) if raw[at] < 0x80 else "")
            at += 1
    return "".join(out)


def decoded(raw: bytes, codec: str) -> str:
    """Text of ``raw``; bytes that don't decode are left out."""
    return _iso2022_cn(raw) if codec == "iso2022_cn" else raw.decode(codec, "ignore")


# Widths of codes 32 to 126 in the core fonts.
_HELVETICA = [278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556, 1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556, 333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584]
_HELVETICA_BOLD = [278, 333, 474, 556, 556, 889, 722, 238, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 333, 333, 584, 584, 584, 611, 975, 722, 722, 722, 722, 667, 611, 778, 722, 278, 556, 722, 611, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 333, 278, 333, 584, 556, 333, 556, 611, 556, 611, 556, 333, 611, 611, 278, 278, 556, 278, 889, 611, 611, 611, 611, 389, 556, 333, 611, 556, 778, 556, 556, 500, 389, 280, 389, 584]
_TIMES = [250, 333, 408, 500, 500, 833, 778, 180, 333, 333, 500, 564, 250, 333, 250, 278, 500, 500, 500, 500, 500, 500, 500, 500, 500, 500, 278, 278, 564, 564, 564, 444, 921, 722, 667, 667, 722, 611, 556, 722, 722, 333, 389, 722, 611, 889, 722, 722, 556, 722, 667, 556, 611, 722, 722, 944, 722, 722, 611, 333, 278, 333, 469, 500, 333, 444, 500, 444, 500, 444, 333, 500, 500, 278, 278, 500, 278, 778, 500, 500, 500, 500, 333, 389, 278, 500, 500, 722, 500, 500, 444, 480, 200, 480, 541]
_TIMES_BOLD = [250, 333, 555, 500, 500, 1000, 833, 278, 333, 333, 500, 570, 250, 333, 250, 278, 500, 500, 500, 500, 500, 500, 500, 500, 500, 500, 333, 333, 570, 570, 570, 500, 930, 722, 667, 722, 722, 667, 611, 778, 778, 389, 500, 778, 667, 944, 722, 778, 611, 778, 722, 556, 667, 722, 722, 1000, 722, 722, 667, 333, 278, 333, 581, 500, 333, 500, 556, 444, 556, 444, 333, 500, 556, 278, 333, 556, 278, 833, 556, 500, 556, 556, 444, 389, 333, 556, 500, 722, 500, 500, 444, 394, 220, 394, 520]
_TIMES_ITALIC = [250, 333, 420, 500, 500, 833, 778, 214, 333, 333, 500, 675, 250, 333, 250, 278, 500, 500, 500, 500, 500, 500, 500, 500, 500, 500, 333, 333, 675, 675, 675, 500, 920, 611, 611, 667, 722, 611, 611, 722, 722, 333, 444, 667, 556, 833, 667, 722, 611, 722, 611, 500, 556, 722, 611, 833, 611, 556, 556, 389, 278, 389, 422, 500, 333, 500, 500, 444, 500, 444, 278, 500, 500, 278, 278, 444, 278, 722, 500, 500, 500, 500, 389, 389, 278, 500, 444, 667, 444, 444, 389, 400, 275, 400, 541]
_TIMES_BOLD_ITALIC = [250, 389, 555, 500, 500, 833, 778, 278, 333, 333, 500, 570, 250, 333, 250, 278, 500, 500, 500, 500, 500, 500, 500, 500, 500, 500, 333, 333, 570, 570, 570, 500, 832, 667, 667, 667, 722, 667, 667, 722, 778, 389, 500, 667, 611, 889, 722, 722, 611, 722, 667, 556, 611, 722, 667, 889, 667, 611, 611, 333, 278, 333, 570, 500, 333, 500, 500, 444, 500, 444, 333, 500, 556, 278, 278, 500, 278, 778, 556, 500, 500, 500, 389, 389, 278, 556, 444, 667, 500, 444, 389, 348, 220, 348, 570]
# Widths of codes 0xA1 to 0xBF (0: none), then of letters that aren't as
# wide as a base letter.
_HELVETICA_UPPER = [333, 556, 556, 556, 556, 260, 556, 333, 737, 370, 556, 584, 0, 737, 333, 400, 584, 333, 333, 333, 556, 537, 278, 333, 333, 365, 556, 834, 834, 834, 611]
_HELVETICA_BOLD_UPPER = [333, 556, 556, 556, 556, 280, 556, 333, 737, 370, 556, 584, 0, 737, 333, 400, 584, 333, 333, 333, 611, 556, 278, 333, 333, 365, 556, 834, 834, 834, 611]
_TIMES_UPPER = [333, 500, 500, 500, 500, 200, 500, 333, 760, 276, 500, 564, 0, 760, 333, 400, 564, 300, 300, 333, 500, 453, 250, 333, 300, 310, 500, 750, 750, 750, 444]
_TIMES_BOLD_UPPER = [333, 500, 500, 500, 500, 220, 500, 333, 747, 300, 500, 570, 0, 747, 333, 400, 570, 300, 300, 333, 556, 540, 250, 333, 300, 330, 500, 750, 750, 750, 500]
_TIMES_ITALIC_UPPER = [389, 500, 500, 500, 500, 275, 500, 333, 760, 276, 500, 675, 0, 760, 333, 400, 675, 300, 300, 333, 500, 523, 250, 333, 300, 310, 500, 750, 750, 750, 500]
_TIMES_BOLD_ITALIC_UPPER = [389, 500, 500, 500, 500, 220, 500, 333, 747, 266, 500, 606, 0, 747, 333, 400, 570, 300, 300, 333, 576, 500, 250, 333, 300, 300, 500, 750, 750, 750, 500]
_HELVETICA_OTHER = {"Æ": 1000, "Ð": 722, "×": 584, "Ø": 778, "Þ": 667, "ß": 611, "æ": 889, "ì": 278, "í": 278, "î": 278, "ï": 278, "ð": 556, "÷": 584, "ø": 611, "þ": 556}
_HELVETICA_BOLD_OTHER = {"Æ": 1000, "Ð": 722, "×": 584, "Ø": 778, "Þ": 667, "ß": 611, "æ": 889, "ð": 611, "÷": 584, "ø": 611, "þ": 611}
_TIMES_OTHER = {"Æ": 889, "Ð": 722, "×": 564, "Ø": 722, "Þ": 556, "ß": 500, "æ": 667, "ð": 500, "÷": 564, "ø": 500, "þ": 500}
_TIMES_BOLD_OTHER = {"Æ": 1000, "Ð": 722, "×": 570, "Ø": 778, "Þ": 611, "ß": 556, "æ": 722, "ð": 500, "÷": 570, "ø": 500, "þ": 556}
_TIMES_ITALIC_OTHER = {"Æ": 889, "Ð": 722, "×": 675, "Ø": 722, "Þ": 611, "ß": 500, "æ": 667, "ð": 500, "÷": 675, "ø": 500, "þ": 500}
_TIMES_BOLD_ITALIC_OTHER = {"Æ": 944, "Ð": 722, "×": 570, "Ø": 722, "Þ": 611, "ß": 500, "æ": 722, "ð": 500, "÷": 570, "ø": 500, "þ": 500}
# The codes above 255 of the text faces; accented letters are as wide as their
# base letters, but for those of _SPECIAL. Spacing accents are 333 wide.
_EXTENDED = [(0x100, 0x107), (0x10C, 0x113), (0x116, 0x11B), (0x11E, 0x11F), (0x122, 0x123), (0x12A, 0x12B), (0x12E, 0x131), (0x136, 0x137), (0x139, 0x13E), (0x141, 0x148), (0x14C, 0x14D), (0x150, 0x15B), (0x15E, 0x165), (0x16A, 0x16B), (0x16E, 0x173), (0x178, 0x17E), (0x192, 0x192), (0x218, 0x219), (0x2C6, 0x2C7), (0x2D8, 0x2DD)]
_SPECIAL = [0x10F, 0x110, 0x111, 0x131, 0x13D, 0x13E, 0x141, 0x142, 0x152, 0x153, 0x165, 0x192]
_SIGNS = [0x2013, 0x2014, 0x2018, 0x2019, 0x201A, 0x201C, 0x201D, 0x201E, 0x2020, 0x2021, 0x2022, 0x2026, 0x2030, 0x2039, 0x203A, 0x2044, 0x2122, 0x2202, 0x2206, 0x2211, 0x2212, 0x221A, 0x2260, 0x2264, 0x2265, 0x25CA, 0xF6C3, 0xFB01, 0xFB02]
# Widths of the codes of _SPECIAL and _SIGNS, by face.
_BEYOND = {
    "Helvetica": ([643, 722, 556, 278, 556, 299, 556, 222, 1000, 944, 317, 556], [556, 1000, 222, 222, 222, 333, 333, 333, 556, 556, 350, 1000, 1000, 333, 333, 167, 1000, 476, 612, 600, 584, 453, 549, 549, 549, 471, 250, 500, 500]),
    "Helvetica-Bold": ([743, 722, 611, 278, 611, 400, 611, 278, 1000, 944, 389, 556], [556, 1000, 278, 278, 278, 500, 500, 500, 556, 556, 350, 1000, 1000, 333, 333, 167, 1000, 494, 612, 600, 584, 549, 549, 549, 549, 494, 250, 611, 611]),
    "Times-Roman": ([588, 722, 500, 278, 611, 344, 611, 278, 889, 722, 326, 500], [500, 1000, 333, 333, 333, 444, 444, 444, 500, 500, 350, 1000, 1000, 333, 333, 167, 980, 476, 612, 600, 564, 453, 549, 549, 549, 471, 250, 556, 556]),
    "Times-Bold": ([672, 722, 556, 278, 667, 394, 667, 278, 1000, 722, 416, 500], [500, 1000, 333, 333, 333, 500, 500, 500, 500, 500, 350, 1000, 1000, 333, 333, 167, 1000, 494, 612, 600, 570, 549, 549, 549, 549, 494, 250, 556, 556]),
    "Times-Italic": ([544, 722, 500, 278, 611, 300, 556, 278, 944, 667, 300, 500], [500, 889, 333, 333, 333, 556, 556, 556, 500, 500, 350, 889, 1000, 333, 333, 167, 980, 476, 612, 600, 675, 453, 549, 549, 549, 471, 250, 500, 500]),
    "Times-BoldItalic": ([608, 722, 500, 278, 611, 382, 611, 278, 944, 722, 366, 500], [500, 1000, 333, 333, 333, 500, 500, 500, 500, 500, 350, 1000, 1000, 333, 333, 167, 1000, 494, 612, 600, 606, 549, 549, 549, 549, 494, 250, 556, 556]),
}
# Widths of Symbol, by code.
_SYMBOL = {
    32: 250, 33: 333, 35: 500, 37: 833, 38: 778, 40: 333, 41: 333, 43: 549, 44: 250, 46: 250, 47: 278, 48: 500, 49: 500, 50: 500, 51: 500, 52: 500, 53: 500, 54: 500,
    55: 500, 56: 500, 57: 500, 58: 278, 59: 278, 60: 549, 61: 549, 62: 549, 63: 444, 91: 333, 93: 333, 95: 500, 123: 480, 124: 200, 125: 480, 172: 713, 176: 400, 177: 549,
    181: 576, 215: 549, 247: 549, 0x192: 500,
    0x391: 722, 0x392: 667, 0x393: 603, 0x395: 611, 0x396: 611, 0x397: 722, 0x398: 741, 0x399: 333, 0x39A: 722, 0x39B: 686, 0x39C: 889, 0x39D: 722, 0x39E: 645, 0x39F: 722,
    0x3A0: 768, 0x3A1: 556, 0x3A3: 592, 0x3A4: 611, 0x3A5: 690, 0x3A6: 763, 0x3A7: 722, 0x3A8: 795, 0x3B1: 631, 0x3B2: 549, 0x3B3: 411, 0x3B4: 494, 0x3B5: 439, 0x3B6: 494,
    0x3B7: 603, 0x3B8: 521, 0x3B9: 329, 0x3BA: 549, 0x3BB: 549, 0x3BD: 521, 0x3BE: 493, 0x3BF: 549, 0x3C0: 549, 0x3C1: 549, 0x3C2: 439, 0x3C3: 603, 0x3C4: 439, 0x3C5: 576,
    0x3C6: 521, 0x3C7: 549, 0x3C8: 686, 0x3C9: 686, 0x3D1: 631, 0x3D2: 620, 0x3D5: 603, 0x3D6: 713, 0x2022: 460, 0x2026: 1000, 0x2032: 247, 0x2033: 411, 0x2044: 167,
    0x20AC: 750, 0x2111: 686, 0x2118: 987, 0x211C: 795, 0x2126: 768, 0x2135: 823, 0x2190: 987, 0x2191: 603, 0x2192: 987, 0x2193: 603, 0x2194: 1042, 0x21B5: 658, 0x21D0: 987,
    0x21D1: 603, 0x21D2: 987, 0x21D3: 603, 0x21D4: 1042, 0x2200: 713, 0x2202: 494, 0x2203: 549, 0x2205: 823, 0x2206: 612, 0x2207: 713, 0x2208: 713, 0x2209: 713, 0x220B: 439,
    0x220F: 823, 0x2211: 713, 0x2212: 549, 0x2217: 500, 0x221A: 549, 0x221D: 713, 0x221E: 713, 0x2220: 768, 0x2227: 603, 0x2228: 603, 0x2229: 768, 0x222A: 768, 0x222B: 274,
    0x2234: 863, 0x223C: 549, 0x2245: 549, 0x2248: 549, 0x2260: 549, 0x2261: 549, 0x2264: 549, 0x2265: 549, 0x2282: 713, 0x2283: 713, 0x2284: 713, 0x2286: 713, 0x2287: 713,
    0x2295: 768, 0x2297: 768, 0x22A5: 658, 0x22C5: 250, 0x2320: 686, 0x2321: 686, 0x2329: 329, 0x232A: 329, 0x25CA: 494, 0x2660: 753, 0x2663: 753, 0x2665: 753, 0x2666: 753,
    0xF6D9: 790, 0xF6DA: 790, 0xF6DB: 890, 0xF8E5: 500, 0xF8E6: 603, 0xF8E7: 1000, 0xF8E8: 790, 0xF8E9: 790, 0xF8EA: 786, 0xF8EB: 384, 0xF8EC: 384, 0xF8ED: 384, 0xF8EE: 384,
    0xF8EF: 384, 0xF8F0: 384, 0xF8F1: 494, 0xF8F2: 494, 0xF8F3: 494, 0xF8F4: 494, 0xF8F5: 686, 0xF8F6: 384, 0xF8F7: 384, 0xF8F8: 384, 0xF8F9: 384, 0xF8FA: 384, 0xF8FB: 384,
    0xF8FC: 494, 0xF8FD: 494, 0xF8FE: 494, 0xF8FF: 790,
}
# Widths of ZapfDingbats, of codes 1 to 79, 81 to 112, 117 to 119 and 160 to
# 206; those of 120 to 159 are 788.
_DINGBATS = [
    (1, [974, 961, 980, 719, 789, 494, 552, 537, 577, 692, 960, 939, 549, 855, 911, 933, 945, 974, 755, 846, 762, 761, 571, 677, 763, 760, 759, 754, 786, 788, 788, 790, 793, 794, 816, 823, 789, 841, 823, 833, 816, 831, 923, 744, 723, 749, 790, 792, 695, 776, 768, 792, 759, 707, 708, 682, 701, 826, 815, 789, 789, 707, 687, 696, 689, 786, 787, 713, 791, 785, 791, 873, 761, 762, 759, 892, 892, 788, 784]),
    (81, [438, 138, 277, 415, 509, 410, 234, 234, 390, 390, 276, 276, 317, 317, 334, 334, 392, 392, 668, 668, 732, 544, 544, 910, 911, 667, 760, 760, 626, 694, 595, 776]),
    (117, [690, 791, 790]),
    (160, [894, 838, 924, 1016, 458, 924, 918, 927, 928, 928, 834, 873, 828, 924, 917, 930, 931, 463, 883, 836, 867, 696, 874, 760, 946, 865, 967, 831, 873, 927, 970, 918, 748, 836, 771, 888, 748, 771, 888, 867, 696, 874, 974, 762, 759, 509, 410]),
]
_H, _HB = (_HELVETICA, _HELVETICA_UPPER, _HELVETICA_OTHER), (_HELVETICA_BOLD, _HELVETICA_BOLD_UPPER, _HELVETICA_BOLD_OTHER)
_FACES = {
    "Helvetica": _H, "Helvetica-Oblique": _H, "Helvetica-Bold": _HB, "Helvetica-BoldOblique": _HB, "Times-Roman": (_TIMES, _TIMES_UPPER, _TIMES_OTHER),
    "Times-Bold": (_TIMES_BOLD, _TIMES_BOLD_UPPER, _TIMES_BOLD_OTHER), "Times-Italic": (_TIMES_ITALIC, _TIMES_ITALIC_UPPER, _TIMES_ITALIC_OTHER),
    "Times-BoldItalic": (_TIMES_BOLD_ITALIC, _TIMES_BOLD_ITALIC_UPPER, _TIMES_BOLD_ITALIC_OTHER),
}
#: Fixed values: (ascent, descent, height) of the core fonts.
_METRICS = {
    "Courier": (627, -194, 1052), "Courier-Bold": (627, -194, 1060), "Courier-BoldOblique": (627, -194, 1060), "Courier-Oblique": (627, -194, 1052),
    "Helvetica": (718, -207, 1156), "Helvetica-Bold": (718, -207, 1190), "Helvetica-BoldOblique": (718, -207, 1190), "Helvetica-Oblique": (718, -207, 1156),
    "Symbol": (0, 0, 1303), "Times-Bold": (683, -217, 1153), "Times-BoldItalic": (683, -217, 1139), "Times-Italic": (683, -217, 1100),
    "Times-Roman": (683, -217, 1116), "ZapfDingbats": (0, 0, 963),
}


@functools.cache
def core_font(name: str, compat: bool = True) -> tuple[dict[int, float], tuple[int, int, int]] | None:
    """(widths, (ascent, descent, height)) of one of the 14 core fonts. Accented letters
    are as wide as their base letters. ``compat``: Courier has no space."""
    if name not in _METRICS:
        return None
    extended = [c for a, z in _EXTENDED for c in range(a, z + 1)]
    if name in _FACES:
        row, upper, other = _FACES[name]
        widths = {32 + i: float(w) for i, w in enumerate(row)} | {0xA1 + i: float(w) for i, w in enumerate(upper) if w}
        for code in [*range(0xC0, 0x100), *extended]:
            base = ord(unicodedata.normalize("NFD", chr(code))[0])
            if base < 127:
                widths[code] = widths[base]
        special, signs = _BEYOND[name.replace("Oblique", "").rstrip("-") if name.startswith("Helvetica") else name]
        widths |= {ord(c): float(w) for c, w in other.items()} | {c: 333.0 for c in extended if c > 0x2C0}
        widths |= {c: float(w) for c, w in [*zip(_SPECIAL, special), *zip(_SIGNS, signs)]}
    elif name.startswith("Courier"):
        widths = {c: 600.0 for c in [*range(32, 127), *range(0xA1, 0x100), *extended, *_SIGNS] if c != 0xAD}
        if compat and name == "Courier":
            del widths[32]
    elif name == "Symbol":
        widths = {c: float(w) for c, w in _SYMBOL.items()}
    else:
        widths = {c: 788.0 for c in range(120, 160)} | {first + i: float(w) for first, row in _DINGBATS for i, w in enumerate(row)}
    return widths, _METRICS[name]
