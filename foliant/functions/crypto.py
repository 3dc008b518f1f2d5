"""Decryption of streams with the empty user password: RC4 and AES-128 in CBC mode."""

from __future__ import annotations

import hashlib

import numpy as np

from .syntax import STRING, Dictionary, Malformed, array, dictionary, signed, text_string, unsigned

#: Fixed value: the padding of passwords.
PADDING = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")

RC4, AES, IDENTITY = "rc4", "aes", "identity"


def rc4(key: bytes, data: bytes) -> bytes:
    box, j = list(range(256)), 0
    for i in range(256):
        j = (j + box[i] + key[i % len(key)]) & 255
        box[i], box[j] = box[j], box[i]
    stream, j, size = bytearray(), 0, len(data)
    push = stream.append
    for lo in range(0, size, 256):  # a turn of the first index
        for i in range(lo + 1, min(lo + 256, size) + 1):
            i &= 255
            a = box[i]
            j = (j + a) & 255
            box[i] = b = box[j]
            box[j] = a
            push(box[(a + b) & 255])
    return (np.frombuffer(data, np.uint8) ^ np.frombuffer(stream, np.uint8)).tobytes()


def _times(a: int, b: int) -> int:
    """A product in the field of 256 elements."""
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a = (a << 1) ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


def _substitution() -> np.ndarray:
    box = np.zeros(256, np.uint8)
    for x in range(256):
        inverse = next((y for y in range(256) if _times(x, y) == 1), 0)
        bits = 0x63
        for shift in range(5):
            bits ^= (inverse << shift | inverse >> (8 - shift)) & 255
        box[x] = bits
    return box


class _Aes:
    """The inverse cipher on many blocks at a time."""

    box = unbox = None

    def __init__(self, key: bytes):
        cls = type(self)
        if cls.box is None:
            cls.box = _substitution()
            cls.unbox = np.argsort(cls.box).astype(np.uint8)
            cls.by = {m: np.array([_times(x, m) for x in range(256)], np.uint8) for m in (9, 11, 13, 14)}
        words, n = [list(key[i : i + 4]) for i in range(0, len(key), 4)], len(key) // 4
        constant = 1
        for i in range(n, 4 * (n + 7)):
            w = list(words[-1])
            if i % n == 0:
                w = [int(cls.box[b]) for b in w[1:] + w[:1]]
                w[0] ^= constant
                constant = _times(constant, 2)
            elif n > 6 and i % n == 4:
                w = [int(cls.box[b]) for b in w]
            words.append([a ^ b for a, b in zip(words[-n], w)])
        self.rounds = np.array(words, np.uint8).reshape(-1, 16)
        self.shift = np.array([(i - 4 * (i % 4)) % 16 for i in range(16)])

    def decrypt(self, blocks: np.ndarray) -> np.ndarray:
        s = blocks ^ self.rounds[-1]
        for k in range(len(self.rounds) - 2, -1, -1):
            s = self.unbox[s[:, self.shift]] ^ self.rounds[k]
            if k:
                c = s.reshape(-1, 4, 4)
                a = [c[:, :, i] for i in range(4)]
                s = np.stack([self.by[14][a[i]] ^ self.by[11][a[(i + 1) % 4]] ^ self.by[13][a[(i + 2) % 4]] ^ self.by[9][a[(i + 3) % 4]] for i in range(4)], 2).reshape(-1, 16)
        return s


def aes_cbc(key: bytes, data: bytes) -> bytes:
    """``data`` is the initial vector and the ciphertext; the padding is taken off."""
    if len(key) not in (16, 32):
        raise Malformed(f"an AES key of {len(key)} bytes")
    if len(data) < 32 or len(data) % 16:
        raise Malformed("AES data isn't whole blocks")
    blocks = np.frombuffer(data, np.uint8).reshape(-1, 16)
    plain = (_Aes(key).decrypt(blocks[1:]) ^ blocks[:-1]).tobytes()
    n = plain[-1]
    if not 1 <= n <= 16 or plain[-n:] != bytes([n]) * n:
        raise Malformed("wrong AES padding")
    return plain[:-n]


def algorithm(options: Dictionary) -> str:
    revision = unsigned(options[b"/R"][1])
    if revision in (2, 3):
        return RC4
    if revision != 4:
        raise Malformed(f"encryption revision {revision} isn't supported")
    level: Dictionary = options
    for key in (b"/CF", b"/StdCF"):
        if key not in level:
            return IDENTITY
        level = dictionary(level[key][1])
    method = level.get(b"/CFM", (0, None))[1]
    known = {None: IDENTITY, b"/V2": RC4, b"/AESV2": AES}
    if method not in known:
        raise Malformed(f"unknown method {method!r}")
    return known[method]


def document_key(options: Dictionary) -> bytes:
    size = unsigned(options[b"/Length"][1]) // 8 if b"/Length" in options else 5
    owner = text_string(options[b"/O"][1])
    first = next((r for k, r in array(options[b"/ID"][1]) if k == STRING), b"<>")
    seed = PADDING + (owner + PADDING)[:32] + (signed(options[b"/P"][1]) & 0xFFFFFFFF).to_bytes(4, "little") + text_string(first)
    metadata = options.get(b"/EncryptMetadata", (0, b"true"))[1]
    if metadata not in (b"true", b"false"):
        raise Malformed("/EncryptMetadata isn't a boolean")
    digest = hashlib.md5(seed + b"\xff" * 4 * (metadata == b"false")).digest()
    if unsigned(options[b"/R"][1]) in (3, 4):
        for _ in range(50):
            digest = hashlib.md5(digest[:size]).digest()
    return digest[:size]


class Decryption:
    """Decrypts streams of one document; the document's key is derived once."""

    def __init__(self, options: Dictionary):
        self.method = algorithm(options) if options else IDENTITY
        self.key = document_key(options) if self.method != IDENTITY else b""

    def __call__(self, number: int, generation: int, data: bytes) -> bytes:
        if self.method == IDENTITY:
            return data
        salted = self.key + (number & 0xFFFFFF).to_bytes(3, "little") + (generation & 0xFFFF).to_bytes(2, "little")
        own = hashlib.md5(salted + b"sAlT" * (self.method == AES)).digest()[: min(len(self.key) + 5, 16)]
        return rc4(own, data) if self.method == RC4 else aes_cbc(own, data)
