"""Documents made by the writer: structure, content, text, encryption, errors."""

import hashlib
import struct

import numpy as np
import pytest

from foliant.functions.crypto import PADDING, rc4
from foliant.functions.syntax import Malformed
from foliant.operators.document import Document
from foliant.operators.interpreter import Pages
from foliant.operators.layout import render
from foliant.plans.extract import read_document
from foliant.sources.writer import PdfWriter, simple_pdf, text_pdf

PLAIN = b"/Type /Font /Subtype /Type1 /BaseFont /Helvetica"
HELLO = b"BT /F1 12 Tf 72 700 Td (Hello World) Tj ET "


def text(buf, **options):
    return b"".join(p["text_bytes"] for p in read_document(buf, ("page_text",), **options)["page_text"]).decode("utf-8", "replace")


def shown(content, **options):
    doc = Document(simple_pdf([content], font=PLAIN), **options)
    tree = Pages(doc)
    page = tree.pages[0]
    return tree.layers(page, tree.contents(page), set())


@pytest.mark.parametrize("options", [{}, {"flate": True}, {"xref": "stream"}, {"xref": "stream", "flate": True, "pack": True}])
def test_structures(options):
    assert text(simple_pdf([HELLO], **options)) == "Hello World\n"


def test_two_revisions_newest_wins():
    old = simple_pdf([HELLO])
    at = old.rindex(b"BT")
    number = int(old[: old.rindex(b" 0 obj", 0, at)].split()[-1])
    pointer = int(old.split(b"startxref")[-1].split()[0])
    body = b"BT /F1 12 Tf 72 700 Td (Newer) Tj ET "
    new = old + b"%d 0 obj\n<< /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (number, len(body), body)
    xref = len(new)
    new += b"xref\n%d 1\n%010d 00000 n \ntrailer\n<< /Root 5 0 R /Prev %d >>" % (number, len(old), pointer)
    root = int(old.split(b"/Root ")[1].split()[0])
    new = new.replace(b"/Root 5 0 R /Prev", b"/Root %d 0 R /Prev" % root) + b"\nstartxref\n%d\n%%%%EOF\n" % xref
    assert text(new) == "Newer\n"
    assert read_document(new, ())["recovered"] is False


def test_damaged_pointer_recovers_earliest_definition():
    buf = simple_pdf([HELLO])
    head, tail = buf.split(b"xref\n0", 1)
    later = head[head.rindex(b" 0 obj", 0, head.index(b"BT")) - 1 :].replace(b"Hello World", b"Later World").split(b"endobj")[0] + b"endobj\n"
    before = head + later + b"xref\n0" + tail[: tail.rindex(b"startxref")]
    broken = before + b"startxref\n%d\n%%%%EOF\n" % (before.rindex(b"xref\n0") + 5)
    meta = read_document(broken, ("page_text",))
    assert meta["is_damaged"] and meta["recovered"]
    assert meta["page_text"][0]["text"] == "Hello World\n"


def test_no_startxref_is_an_error():
    with pytest.raises(Malformed):
        Document(simple_pdf([HELLO]).replace(b"startxref", b"startxxxx"))


def test_kids_cycle_and_repeated_page():
    w = PdfWriter()
    tree, face = w.reserve(), w.add(b"<< %s >>" % PLAIN)
    body = w.stream(HELLO)
    page = w.add(b"<< /Type /Page /MediaBox [0 0 9 9] /Resources << /Font << /F1 %d 0 R >> >> /Contents %d 0 R >>" % (face, body))
    w.add(b"<< /Type /Pages /Kids [%d 0 R %d 0 R %d 0 R] >>" % (page, page, tree), tree)
    buf = w.finish(w.add(b"<< /Type /Catalog /Pages %d 0 R >>" % tree))
    assert read_document(buf, ())["n_pages"] == 1


def test_line_operators():
    assert text(simple_pdf([b"BT /F1 10 Tf 14 TL 50 700 Td (a) Tj T* (b) Tj (c) ' 0 -14 Td (d) Tj 0 -14 TD (e) Tj T* (f) Tj ET "])) == "a\nb\nc\nd\ne\nf\n"


def test_kerning_spaces_and_last_number_counts():
    assert text(simple_pdf([b"BT /F1 10 Tf 50 700 Td [(ab) -600 (cd) 0 (ef)] TJ ET "])) == "ab cdef\n"
    near, far = (shown(b"BT /F1 10 Tf [(a) %s (b)] TJ ET " % k)[0][1].x0 for k in (b"-1000", b"500 -1000"))
    assert near == far


def test_double_quote_shows_the_raw_string():
    content = b"BT /F1 10 Tf 14 TL 50 700 Td 1 2 (a\\)b) \" ET "
    assert shown(content)[0][0].text == b"(a\\)b)"
    assert shown(content, compat=False)[0][0].text == b"a)b"


def test_spacing_moves_the_pen():
    f = np.float32
    a = shown(b"BT /F1 10 Tf (ab) Tj (c) Tj ET ")[0][1]
    b = shown(b"BT /F1 10 Tf 2 Tc 3 Tw 50 Tz (ab) Tj (c) Tj ET ")[0][1]
    assert abs(a.x0 - 11.12) < 1e-5 and abs(b.x0 - (11.12 / 2 + 1)) < 1e-5
    assert shown(b"BT /F1 10 Tf 2 Ts (a) Tj ET ")[0][0].y0 == shown(b"BT /F1 10 Tf (a) Tj ET ")[0][0].y0 + f(20)


def test_matrices_and_rotated_text():
    assert shown(b"q 1 0 0 1 100 0 cm BT /F1 10 Tf (a) Tj ET Q BT /F1 10 Tf (b) Tj ET ")[0][0].x0 == 100
    runs = shown(b"BT /F1 10 Tf 0 1 -1 0 50 50 Tm (up) Tj (more) Tj ET ")[0]
    assert [c.text for c in runs] == [b"up"]  # only the first string after Tm survives


def test_page_rotation():
    buf = simple_pdf([HELLO], page=b"/Rotate 180 /MediaBox [0 0 612 792]")
    assert read_document(buf, ("pages",))["pages"][0]["ctm"] == [-1, 0, 0, -1, 612, 792]
    with pytest.raises(Malformed):
        read_document(simple_pdf([HELLO], page=b"/Rotate 45 /MediaBox [0 0 612 792]"), ())


def _form_pdf(form_content, page_content, props=b"", annots=b""):
    w = PdfWriter()
    tree, face = w.reserve(), w.add(b"<< %s >>" % PLAIN)
    form = w.reserve()
    res = b"/Resources << /Font << /F1 %d 0 R >> /XObject << /X %d 0 R >> >>" % (face, form)
    w.stream(form_content, b"/Subtype /Form /BBox [0 0 9 9] " + props, form)
    body = w.stream(page_content)
    page = w.reserve()
    extra = b""
    if annots:
        stream = w.stream(annots)
        one = w.add(b"<< /AP << /N %d 0 R >> >>" % stream)
        extra = b"/Annots %d 0 R" % w.add(b"[%d 0 R]" % one)
    w.add(b"<< /Type /Page /MediaBox [0 0 612 792] %s /Contents %d 0 R %s >>" % (res, body, extra), page)
    w.add(b"<< /Type /Pages /Kids [%d 0 R] >>" % page, tree)
    return w.finish(w.add(b"<< /Type /Catalog /Pages %d 0 R >>" % tree))


def test_forms_are_layers_and_their_matrix_is_ignored():
    buf = _form_pdf(b"BT /F1 10 Tf 10 10 Td (form) Tj ET ", b"/X Do BT /F1 10 Tf 10 700 Td (page) Tj ET ", b"/Matrix [1 0 0 1 500 0]")
    assert text(buf) == "page\nform\n"
    x = lambda **o: read_document(buf, ("chunks",), **o)["chunks"][1]["x0"]
    assert x() == 10 and x(compat=False) == 510


def test_a_form_that_draws_itself_ends():
    assert text(_form_pdf(b"BT /F1 10 Tf (f) Tj ET /X Do ", b"/X Do ")).count("f") == 30


def test_inline_images_are_skipped_and_annotations_appended():
    assert text(simple_pdf([b"BI /W 1 ID xx(EIx EI " + HELLO])) == "Hello World\n"
    assert text(_form_pdf(b" ", b"BT /F1 10 Tf 10 700 Td (page) Tj ET ", annots=b"BT /F1 10 Tf (note) Tj ET ")) == "page\nnote\n"
    broken = _form_pdf(b" ", b"BT /F1 10 Tf 10 700 Td (page) Tj ET ", annots=b"BT /F9 10 Tf (note) Tj ET ")
    got = read_document(broken, ("page_text",))
    assert got["n_annot_errors"] == 1 and got["page_text"][0]["text"] == "page\n"


def test_content_streams_fuse_at_the_seam():
    w = PdfWriter()
    tree, face = w.reserve(), w.add(b"<< %s >>" % PLAIN)
    a, b = w.stream(b"BT /F1 10 Tf (x) T"), w.stream(b"j ET ")
    page = w.add(b"<< /Type /Page /MediaBox [0 0 9 9] /Resources << /Font << /F1 %d 0 R >> >> /Contents [%d 0 R %d 0 R] >>" % (face, a, b))
    w.add(b"<< /Type /Pages /Kids [%d 0 R] >>" % page, tree)
    assert text(w.finish(w.add(b"<< /Type /Catalog /Pages %d 0 R >>" % tree))) == "x\n"


def test_encodings_in_documents():
    win = PLAIN + b" /Encoding /WinAnsiEncoding"
    raw = b'BT /F1 10 Tf 10 700 Td (a, "b") Tj ET '
    assert text(simple_pdf([raw], font=win)) == "a @b@\n"
    assert text(simple_pdf([raw], font=win), compat=False) == 'a, "b"\n'
    standard = PLAIN + b" /Encoding /StandardEncoding"
    two = b"BT /F1 10 Tf 10 700 Td <00410042> Tj ET "
    assert text(simple_pdf([two], font=standard)) == "AB\n"
    diff = PLAIN + b" /Encoding << /Differences [65 /eacute /nosuch /Euro] >>"
    assert text(simple_pdf([b"BT /F1 10 Tf 10 700 Td (ABCD) Tj ET "], font=diff)) == "éB€D\n"
    kanji = b"/Type /Font /Subtype /Type0 /BaseFont /K /Encoding /90ms-RKSJ-H /DescendantFonts [<< /Type /Font /Subtype /CIDFontType0 >>]"
    assert text(simple_pdf([b"BT /F1 10 Tf 10 700 Td <" + "漢字".encode("shift_jis").hex().encode() + b"> Tj ET "], font=kanji)) == "漢字\n"
    assert text(simple_pdf([two], font=kanji.replace(b"90ms-RKSJ-H", b"Identity-V"))) == ""


def test_cid_widths_and_type3():
    cid = b"/Type /Font /Subtype /Type0 /BaseFont /K /Encoding /Identity-H /DescendantFonts [<< /Type /Font /Subtype /CIDFontType2 /W [65 [100 200] 70 72 300] >>]"
    row = read_document(simple_pdf([HELLO], font=cid), ("fonts",))["fonts"][0]
    assert dict(row["widths"]) == {65: 100, 66: 200, 70: 300, 71: 300, 72: 300} and row["default_width"] == 1000
    t3 = b"/Type /Font /Subtype /Type3 /FontMatrix [0.01 0 0 0.01 0 0] /FontBBox [0 -20 100 80] /FirstChar 65 /Widths [50]"
    row = read_document(simple_pdf([b"BT /F1 10 Tf (A) Tj ET "], font=t3), ("fonts", "chunks"))
    assert row["fonts"][0]["descent"] == -20 and abs(row["chunks"][0]["x1"] - 5) < 1e-5


def _truetype(form):
    if form == 4:
        sub = struct.pack(">HHHHHHH", 4, 0, 0, 4, 0, 0, 0) + struct.pack(">HHHHHhhHH", 66, 0xFFFF, 0, 65, 0xFFFF, -60, 0, 0, 0)
    elif form == 6:
        sub = struct.pack(">HHHHH", 6, 0, 0, 65, 2) + struct.pack(">HH", 5, 6)
    else:
        sub = struct.pack(">HHIIIIII", 12, 0, 0, 0, 1, 65, 66, 5 - 65 & 0xFFFFFFFF)
    table = struct.pack(">HHHHI", 0, 1, 3, 1, 12) + sub
    return struct.pack(">IHHHH", 0x10000, 1, 0, 0, 0) + b"cmap" + struct.pack(">III", 0, 28, len(table)) + table


@pytest.mark.parametrize("form, expected", [(4, "AB"), (6, "AB"), (12, "")])
def test_truetype_maps(form, expected):
    w = PdfWriter()
    tree = w.reserve()
    file = w.stream(_truetype(form))
    face = w.add(b"<< /Type /Font /Subtype /TrueType /BaseFont /T /FontDescriptor << /FontFile2 %d 0 R >> >>" % file)
    body = w.stream(b"BT /F1 10 Tf 10 700 Td <00050006> Tj ET ")
    page = w.add(b"<< /Type /Page /MediaBox [0 0 9 9] /Resources << /Font << /F1 %d 0 R >> >> /Contents %d 0 R >>" % (face, body))
    w.add(b"<< /Type /Pages /Kids [%d 0 R] >>" % page, tree)
    assert text(w.finish(w.add(b"<< /Type /Catalog /Pages %d 0 R >>" % tree))).strip() == expected


def _encrypted(method, content=HELLO):
    revision, size = {"rc4-40": (2, 5), "rc4-128": (3, 16), "aes": (4, 16)}[method]
    owner, ident, permissions = b"o" * 32, b"identity", 0xFFFFFFFC
    seed = PADDING + owner + permissions.to_bytes(4, "little") + ident
    key = hashlib.md5(seed).digest()
    for _ in range(50 if revision > 2 else 0):
        key = hashlib.md5(key[:size]).digest()
    key = key[:size]
    w = PdfWriter()
    tree, face = w.reserve(), w.add(b"<< %s >>" % PLAIN)
    n = w.reserve()
    own = hashlib.md5(key + n.to_bytes(3, "little") + b"\0\0" + b"sAlT" * (method == "aes")).digest()[: min(size + 5, 16)]
    if method == "aes":
        import subprocess

        iv = bytes(range(16))
        data = iv + subprocess.run(["openssl", "enc", "-aes-128-cbc", "-K", own.hex(), "-iv", iv.hex()], input=content, capture_output=True, check=True).stdout
    else:
        data = rc4(own, content)
    w.stream(data, number=n)
    page = w.add(b"<< /Type /Page /MediaBox [0 0 9 9] /Resources << /Font << /F1 %d 0 R >> >> /Contents %d 0 R >>" % (face, n))
    w.add(b"<< /Type /Pages /Kids [%d 0 R] >>" % page, tree)
    level = b"/CF << /StdCF << /CFM /AESV2 >> >>" if method == "aes" else b""
    entry = b"/Encrypt << /R %d /Length %d /O <%s> /P -4 %s >> /ID [<%s> <00>]" % (revision, size * 8, owner.hex().encode(), level, ident.hex().encode())
    return w.finish(w.add(b"<< /Type /Catalog /Pages %d 0 R >>" % tree), extra=entry)


@pytest.mark.parametrize("method", ["rc4-40", "rc4-128", "aes"])
def test_decryption(method):
    assert text(_encrypted(method)) == "Hello World\n"


def test_unsupported_encryption_is_an_error():
    for change in ((b"/R 4", b"/R 6"), (b"/Length 128", b"/Lengthx 128"), (b"/AESV2", b"/None")):
        with pytest.raises(Malformed):
            text(_encrypted("aes").replace(*change))


def test_error_rows_and_partial():
    bad = simple_pdf([HELLO, b"BT /F9 1 Tf (x) Tj ET "])
    with pytest.raises(Malformed):
        text(bad)
    got = read_document(bad, ("page_text",), partial=True)
    assert got["n_page_errors"] == 1 and got["page_text"][0]["text"] == "Hello World\n"


def test_any_text_survives_the_writer():
    t = "a, \"b\"\n\nçà 漢字 𝄞 (x)\\\n  two  "
    assert text(text_pdf(t)) == "".join(x + "\n" for x in t.split("\n") if x)


def test_render_is_empty_without_chunks():
    assert render([]) == b""


def test_mutated_documents_raise_known_errors_only():
    import random

    from foliant.plans.extract import ERRORS

    rng = random.Random(0)
    samples = [simple_pdf([HELLO]), simple_pdf([HELLO], xref="stream", flate=True, pack=True), text_pdf("ab\ncd"), _encrypted("aes"), _form_pdf(HELLO, b"/X Do " + HELLO, annots=HELLO)]
    want = ("objects", "pages", "fonts", "content_ops", "chunks", "page_text")
    for _ in range(1500):
        buf = bytearray(rng.choice(samples))
        for _ in range(rng.randint(1, 5)):
            at = rng.randrange(len(buf))
            if rng.random() < 0.6:
                buf[at] = rng.randrange(256)
            else:
                buf[at : at + rng.randint(0, 6)] = bytes(rng.choice(b"<>[]()/0123456789 R\n") for _ in range(rng.randint(0, 6)))
        try:
            read_document(bytes(buf), want, compat=rng.random() < 0.7, partial=rng.random() < 0.3)
        except ERRORS:
            pass
