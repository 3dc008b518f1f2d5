import hashlib
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st

from foliant.llm import media


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=900), min_size=1, max_size=4))
def test_frames_are_lossless(texts):
    payloads = [media.padded(t) for t in texts]
    assert all(len(p) % 192 == 0 and p for p in payloads)
    found, frames, _ = media.read_frames(media.avi_files(payloads))
    assert [f.tobytes() for f in frames] == payloads
    assert all(len(a.starts) == len(p) // 192 and a.width == 16 for a, p in zip(found, payloads))


def test_index_and_chunks_agree():
    data = media.avi_files([bytes(range(192)) * 3])[0]
    plain = data[: data.index(b"idx1")]  # without an index the chunks are walked
    a, b = media.parse_avi(data), media.parse_avi(plain)
    assert a.starts.tolist() == b.starts.tolist() and a.sizes.tolist() == b.sizes.tolist()
    assert abs(a.seconds_a_frame - 0.04) < 1e-9
    for bad in (b"", b"RIFF", b"RIFF\0\0\0\0WAVE", b"x" * 100):
        assert media.parse_avi(bad) is None


def _baseline(pixels):
    """A one-block grey baseline image with unit quantisation and long codes."""
    import struct

    u = np.arange(8)
    base = np.cos((2 * u[:, None] + 1) * u[None, :] * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    coefficients = np.rint(base.T @ (pixels.astype(float) - 128) @ base).astype(int).ravel()[media._zigzag()]
    symbols = [r << 4 | s for r in range(16) for s in range(11) if s or r in (0, 15)]
    per = [0] * 16
    per[7], per[8] = 0, len(symbols)  # nine bits each
    codes = {s: (c, n) for s, c, n in media.canonical(symbols, per)}
    bits = ""

    def put(symbol, value):
        nonlocal bits
        code, n = codes[symbol]
        size = symbol & 15
        bits += format(code, f"0{n}b") + (format(value if value >= 0 else value + (1 << size) - 1, f"0{size}b") if size else "")

    put(abs(coefficients[0]).__int__().bit_length(), int(coefficients[0]))
    run = 0
    for c in coefficients[1:].tolist():
        if not c:
            run += 1
            continue
        while run > 15:
            put(0xF0, 0)
            run -= 16
        put(run << 4 | abs(c).bit_length(), c)
        run = 0
    if run:
        put(0, 0)
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
    part = lambda m, body: b"\xff" + bytes([m]) + struct.pack(">H", len(body) + 2) + body
    tables = b"".join(bytes([k]) + bytes(per) + bytes(symbols) for k in (0, 16))
    return b"\xff\xd8" + part(0xDB, bytes([0]) + bytes([1] * 64)) + part(0xC4, tables) + part(0xC0, struct.pack(">BHHBBBB", 8, 8, 8, 1, 1, 0x11, 0)) + part(0xDA, bytes([1, 1, 0, 0, 63, 0])) + scan + b"\xff\xd9"


def test_baseline_frames():
    pixels = np.random.default_rng(0).integers(0, 256, (8, 8))
    raw = _baseline(pixels)
    got = media.decode_baseline(raw, media.parse_jpeg(raw)).astype(int)
    assert np.abs(got - pixels).max() <= 2


def _colour(ycc, sampling=(2, 2), interval=0):
    """A three-component baseline image without tables of its own; unit quantisation."""
    import struct

    h, v = sampling
    high, wide = ycc.shape[:2]
    u = np.arange(8)
    base = np.cos((2 * u[:, None] + 1) * u[None, :] * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    codes = {k: {s: (c, n) for s, c, n in t} for k, t in media.standard_tables().items()}
    planes = [ycc[:, :, 0], *(ycc[::v, ::h, k] for k in (1, 2))]
    bits, last, out, n = "", [0, 0, 0], [], 0

    def block(c, y, x):
        nonlocal bits
        pixels = planes[c][y * 8 : y * 8 + 8, x * 8 : x * 8 + 8].astype(float) - 128
        got = np.rint(base.T @ pixels @ base).astype(int).ravel()[media._zigzag()].tolist()
        todo, run = [(0, got[0] - last[c], 0)], 0
        last[c] = got[0]
        for value in got[1:]:
            if value:
                todo += [(1, 0, 0xF0)] * (run // 16) + [(1, value, run % 16 << 4)]
                run = 0
            else:
                run += 1
        todo += [(1, 0, 0)] * bool(run)
        for kind, value, symbol in todo:
            size = abs(value).bit_length()
            code, length = codes[kind << 4 | (c > 0)][symbol | size]
            bits += format(code, f"0{length}b") + (format(value if value >= 0 else value + (1 << size) - 1, f"0{size}b") if size else "")

    def close():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        out.append(int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0"))
        bits = ""

    for my in range(high // (8 * v)):
        for mx in range(wide // (8 * h)):
            if interval and n and n % interval == 0:
                close()
                out.append(bytes([255, 0xD0 + (n // interval - 1) % 8]))
                last[:] = [0, 0, 0]
            for y in range(v):
                for x in range(h):
                    block(0, my * v + y, mx * h + x)
            block(1, my, mx)
            block(2, my, mx)
            n += 1
    close()
    part = lambda m, body: b"\xff" + bytes([m]) + struct.pack(">H", len(body) + 2) + body
    sof = struct.pack(">BHHB", 8, high, wide, 3) + bytes([1, h << 4 | v, 0, 2, 0x11, 0, 3, 0x11, 0])
    restart = part(0xDD, struct.pack(">H", interval)) if interval else b""
    return b"\xff\xd8" + part(0xDB, bytes([0]) + bytes([1] * 64)) + part(0xC0, sof) + restart + part(0xDA, bytes([3, 1, 0, 2, 0x11, 3, 0x11, 0, 63, 0])) + b"".join(out) + b"\xff\xd9"


def _avi(images, width, height):
    """Frames of any kind in the container that ``avi_files`` writes."""
    whole = media.avi_files([bytes(192)])[0]
    head = whole[: whole.index(b"movi") - 8].replace(np.array([16, 12], "<u4").tobytes(), np.array([width, height], "<u4").tobytes())
    movi = b"".join(b"00dc" + len(i).to_bytes(4, "little") + i + b"\0" * (len(i) & 1) for i in images)
    return head + b"LIST" + (len(movi) + 4).to_bytes(4, "little") + b"movi" + movi


def test_colour_frames_without_tables():
    smooth = np.add.outer(np.arange(32) * 3, np.arange(48) * 2)[:, :, None] // np.array([1, 2, 3]) + np.array([10, 90, 100])
    for sampling, interval in (((1, 1), 0), ((2, 1), 2), ((2, 2), 0), ((2, 2), 3)):
        raw = _colour(smooth, sampling, interval)
        got = media.decode_baseline(raw, media.parse_jpeg(raw)).astype(int)
        y, b, r = smooth[:, :, 0], smooth[:, :, 1] - 128, smooth[:, :, 2] - 128
        want = np.clip(np.stack([y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b], 2), 0, 255)
        assert got.shape == (32, 48, 3) and np.abs(got - want).max() < (4 if sampling == (1, 1) else 9)


def test_damaged_cells_are_rows_with_an_error(spark):
    good = media.avi_files([bytes(range(192)) * 2])[0]
    colour = [_colour(np.full((16, 16, 3), level)) for level in (30, 30, 200)]
    outside = bytearray(good)
    outside[-8:-4] = (1 << 30).to_bytes(4, "little")  # of the last index entry
    at = good.index(b"\xff\xc4")
    cells = [good, _avi(colour, 16, 16), good[: len(good) // 2], bytes(outside), good[:at] + b"\0" + good[at + 1 :], good[: good.index(b"movi") + 40], b"abc", None]
    frame = spark.createDataFrame([(i, 1, c) for i, c in enumerate(cells)], "doc_id long, n_bytes long, media binary").coalesce(1)
    got = {r["doc_id"]: r for r in media.features(frame).collect()}
    assert got[0]["payload_bytes"] == 384 and got[0]["error"] is None
    assert got[1]["payload_bytes"] == 3 * 16 * 16 * 3 and len(got[1]["clips"]) == 2 and abs(got[1]["clips"][1]["start_s"] - 0.08) < 1e-9
    assert all(got[i]["payload_sha256"] is None and got[i]["error"] for i in range(2, 7))
    assert got[7]["payload_sha256"] is None and got[7]["error"] is None
    assert {r["doc_id"] for r in media.clips(frame).collect()} == {0, 1}
    rng = np.random.default_rng(0)
    for _ in range(300):  # nothing else is raised
        raw = bytearray(cells[int(rng.integers(2))])
        for _ in range(int(rng.integers(1, 6))):
            raw[int(rng.integers(len(raw)))] = int(rng.integers(256))
        media.read_frames([bytes(raw), good])


def test_cuts_close_to_one_another():
    dark, light = np.full((1, 12, 16), 10, np.uint8), np.full((1, 12, 16), 200, np.uint8)
    frames = np.concatenate([dark, light, light, light, dark, dark, light] + [light] * 9)
    assert media.shot_starts(frames).tolist() == [0, 1, 4, 6]


def test_shots():
    dark, light = np.full((20, 12, 16), 10, np.uint8), np.full((20, 12, 16), 200, np.uint8)
    frames = np.concatenate([dark, light, dark])
    assert media.shot_starts(frames).tolist() == [0, 20, 40]
    assert media.shot_starts(dark).tolist() == [0]
    assert media.shot_starts(frames[:0]).tolist() == []


def test_operator_on_hard_rows(spark, hard, none):
    stored = media.store(hard)
    got = media.features(stored).collect()
    assert len(got) == hard.count()
    want = {}
    for r in hard.collect():
        raw = (r["text"] or "").encode()
        p = raw + b" " * ((-len(raw) % 192) or (192 if not raw else 0))
        want.setdefault(r["doc_id"], set()).add((len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    for r in got:
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) in want[r["doc_id"]]
    assert media.features(media.store(none)).count() == 0
    clips = media.clips(stored).filter("doc_id = 7").orderBy("clip").collect()
    assert clips[0]["first_frame"] == 0 and all(a["last_frame"] + 1 == b["first_frame"] for a, b in zip(clips, clips[1:]))
    broken = spark.createDataFrame([(1, 3, b"abc"), (2, 0, None)], "doc_id long, n_bytes long, media binary")
    assert [r["payload_sha256"] for r in media.features(broken).collect()] == [None, None]
    assert media.clips(broken).count() == 0
