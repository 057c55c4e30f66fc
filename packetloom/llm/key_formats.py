"""Do decoded bytes have the structure of a secret? Nested lengths of key encodings, headers of signed tokens."""

from __future__ import annotations

import base64
import binascii
import json
from collections.abc import Callable

INTEGER, BIT_STRING, OCTET_STRING, OBJECT, SEQUENCE = 0x02, 0x03, 0x04, 0x06, 0x30
#: Signature bytes of token algorithms; the RSA ones are at least this long.
SIGNATURE_BYTES = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "EdDSA": 64}
RSA_ALGORITHMS = {"RS256", "RS384", "RS512", "PS256", "PS384", "PS512"}
OPENSSH_MAGIC = b"openssh-key-v1\0"
#: A private key has at most so many elements, and with them at most so many bytes (RSA of 16,384 bits has under 10,000).
MOST_ELEMENTS, MOST_KEY_BYTES = 16, 1 << 16


class Malformed(ValueError):
    pass


def elements(data: bytes) -> list[tuple[int, bytes]]:
    """The (tag, content) elements that fill `data` exactly, with definite, shortest lengths."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data) or data[at] & 0x1F == 0x1F:
            raise Malformed
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            count = size & 0x7F
            if not 1 <= count <= 4 or at + count > len(data):
                raise Malformed
            size, at = int.from_bytes(data[at:at + count], "big"), at + count
            if size < 0x80 or size < 1 << 8 * (count - 1):
                raise Malformed
        if at + size > len(data):
            raise Malformed
        out.append((tag, data[at:at + size]))
        at += size
    return out


def _sequence(data: bytes) -> list[tuple[int, bytes]]:
    parts = elements(data)
    if len(parts) != 1 or parts[0][0] != SEQUENCE:
        raise Malformed
    return elements(parts[0][1])


def _private_key(data: bytes) -> str | None:
    parts = _sequence(data)
    tags = [t for t, _ in parts]
    numbers = [int.from_bytes(v, "big") for t, v in parts if t == INTEGER]
    if tags == [INTEGER] * 9 and numbers[0] == 0 and numbers[1] == numbers[4] * numbers[5] and numbers[1] > 1 << 500:
        return "rsa"
    if tags == [INTEGER] * 6 and numbers[0] == 0 and numbers[1] > 1 << 500 and 0 < numbers[5] < numbers[2]:
        return "dsa"
    if tags[:2] == [INTEGER, OCTET_STRING] and numbers == [1] and len(parts) <= 4 \
            and 16 <= len(parts[1][1]) <= 66 and all(t in (0xA0, 0xA1) for t in tags[2:]):
        for _, inner in parts[2:]:
            elements(inner)
        return "ec"
    if tags[:3] == [INTEGER, SEQUENCE, OCTET_STRING] and numbers[0] in (0, 1) \
            and all(t in (0xA0, 0xA1, 0x81) for t in tags[3:]):
        if elements(parts[1][1])[0][0] != OBJECT:
            return None
        inner = parts[2][1]
        held = elements(inner)
        if len(held) == 1 and held[0][0] == OCTET_STRING and len(held[0][1]) in (32, 56, 57):
            return "pkcs8"
        if len(held) == 1 and held[0][0] == INTEGER and len(held[0][1]) >= 16:
            return "pkcs8"
        return "pkcs8" if _private_key(inner) else None
    if tags == [SEQUENCE, OCTET_STRING] and len(parts[1][1]) >= 32:
        scheme = elements(parts[0][1])
        if scheme and scheme[0][0] == OBJECT and len(scheme) == 2 and scheme[1][0] == SEQUENCE \
                and elements(scheme[1][1]):
            return "pkcs8_encrypted"
    return None


def private_key(data: bytes) -> str | None:
    """The kind of private key whose DER encoding these bytes are, all lengths nested exactly."""
    try:
        return _private_key(data) if data[:1] == b"\x30" else None
    except (Malformed, IndexError):
        return None


def _strings(data: bytes, at: int, count: int) -> tuple[list[bytes], int]:
    out = []
    for _ in range(count):
        size = int.from_bytes(data[at:at + 4], "big")
        if at + 4 + size > len(data):
            raise Malformed
        out.append(data[at + 4:at + 4 + size])
        at += 4 + size
    return out, at


def openssh_key(data: bytes) -> str | None:
    """An OpenSSH private key: magic, cipher, key derivation, and length-prefixed keys that fill it."""
    if not data.startswith(OPENSSH_MAGIC):
        return None
    try:
        (cipher, derivation, _), at = _strings(data, len(OPENSSH_MAGIC), 3)
        keys = int.from_bytes(data[at:at + 4], "big")
        if not cipher or not derivation or not 1 <= keys <= 16:
            return None
        parts, at = _strings(data, at + 4, keys + 1)
        (kind,), _ = _strings(parts[0], 0, 1)
        return "openssh" if at == len(data) and kind and parts[-1] else None
    except Malformed:
        return None


def _header(read: Callable[[int, int], bytes], at: int) -> tuple[int, int, int]:
    """Tag, start of the content and end of the DER element that starts at `at`."""
    head = read(at, 6)
    if len(head) < 2 or head[0] & 0x1F == 0x1F:
        raise Malformed
    size, count = head[1], 0
    if size & 0x80:
        count = size & 0x7F
        if not 1 <= count <= 4 or len(head) < 2 + count:
            raise Malformed
        size = int.from_bytes(head[2:2 + count], "big")
    return head[0], at + 2 + count, at + 2 + count + size


def _der_size(read: Callable[[int, int], bytes]) -> int:
    """The size of a sequence that a known number of elements fill exactly, by their headers alone."""
    tag, at, end = _header(read, 0)
    tags = []
    while at < end and tag == SEQUENCE:
        inner, _, at = _header(read, at)
        tags.append(inner)
        if len(tags) > MOST_ELEMENTS or at > end:
            raise Malformed
    if tag != SEQUENCE or not tags or tags[0] not in (INTEGER, SEQUENCE):
        raise Malformed
    return end


def _openssh_size(read: Callable[[int, int], bytes]) -> int:
    def number(at: int) -> int:
        held = read(at, 4)
        if len(held) < 4:
            raise Malformed
        return int.from_bytes(held, "big")

    at = len(OPENSSH_MAGIC)
    for _ in range(3):
        at += 4 + number(at)
    keys, at = number(at), at + 4
    if not 1 <= keys <= MOST_ELEMENTS:
        raise Malformed
    for _ in range(keys + 1):
        at += 4 + number(at)
    return at


def key_size(read: Callable[[int, int], bytes]) -> int | None:
    """How many bytes the DER or OpenSSH private key has that `read` (offset, count) starts with; None if there is
    none. Only headers are read, however much they announce."""
    try:
        return _openssh_size(read) if read(0, len(OPENSSH_MAGIC)) == OPENSSH_MAGIC else _der_size(read)
    except Malformed:
        return None


def decoded(text: bytes) -> bytes | None:
    """Base64 in either alphabet, padded or not."""
    text = text.rstrip(b"=").translate(bytes.maketrans(b"-_", b"+/"))
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + b"=" * (-len(text) % 4), validate=True)
    except binascii.Error:
        return None


def key_blob(data: bytes | None) -> str | None:
    return (private_key(data) or openssh_key(data)) if data else None


def signed_token(header: bytes, payload: bytes, signature: bytes) -> str | None:
    """A signed token's algorithm, if header and payload are JSON objects and the signature has its size."""
    try:
        said, held = json.loads(decoded(header) or b""), json.loads(decoded(payload) or b"")
    except (ValueError, RecursionError):
        return None
    if not isinstance(said, dict) or not isinstance(held, dict) or not isinstance(said.get("alg"), str):
        return None
    size, algorithm = len(decoded(signature) or b""), said["alg"]
    fits = size >= 128 if algorithm in RSA_ALGORITHMS else size == SIGNATURE_BYTES.get(algorithm, -1)
    return algorithm if size and fits else None
