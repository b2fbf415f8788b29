"""Keccak-256 (the original padding): one by one for signatures while a plan is built, many at once for headers and transactions."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_RATE = 136
_MASK = (1 << 64) - 1


def _rotate(x: int, n: int) -> int:
    n %= 64
    return ((x << n) | (x >> (64 - n))) & _MASK


def _permute(lanes: list[list[int]]) -> list[list[int]]:
    feedback = 1
    for _ in range(24):
        columns = [lanes[x][0] ^ lanes[x][1] ^ lanes[x][2] ^ lanes[x][3] ^ lanes[x][4] for x in range(5)]
        mix = [columns[(x - 1) % 5] ^ _rotate(columns[(x + 1) % 5], 1) for x in range(5)]
        lanes = [[lanes[x][y] ^ mix[x] for y in range(5)] for x in range(5)]
        x, y, current = 1, 0, lanes[1][0]
        for t in range(24):
            x, y = y, (2 * x + 3 * y) % 5
            current, lanes[x][y] = lanes[x][y], _rotate(current, (t + 1) * (t + 2) // 2)
        lanes = [[lanes[x][y] ^ (~lanes[(x + 1) % 5][y] & lanes[(x + 2) % 5][y]) for y in range(5)] for x in range(5)]
        for j in range(7):
            feedback = ((feedback << 1) ^ ((feedback >> 7) * 0x71)) & 0xFF
            if feedback & 2:
                lanes[0][0] ^= 1 << ((1 << j) - 1)
    return lanes


def keccak256(data: bytes) -> bytes:
    padded = bytearray(data + b"\x01" + b"\x00" * (-(len(data) + 1) % _RATE))
    padded[-1] |= 0x80
    lanes = [[0] * 5 for _ in range(5)]
    for start in range(0, len(padded), _RATE):
        for k in range(_RATE // 8):
            lanes[k % 5][k // 5] ^= int.from_bytes(padded[start + 8 * k : start + 8 * k + 8], "little")
        lanes = _permute(lanes)
    return b"".join(lanes[k % 5][k // 5].to_bytes(8, "little") for k in range(4))


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    n %= 64
    return x if n == 0 else (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _permute_all(lanes: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    """As _permute, with an array of one lane of every message in place of each lane."""
    feedback = 1
    for _ in range(24):
        columns = [lanes[x][0] ^ lanes[x][1] ^ lanes[x][2] ^ lanes[x][3] ^ lanes[x][4] for x in range(5)]
        mix = [columns[(x - 1) % 5] ^ _turn(columns[(x + 1) % 5], 1) for x in range(5)]
        lanes = [[lanes[x][y] ^ mix[x] for y in range(5)] for x in range(5)]
        x, y, current = 1, 0, lanes[1][0]
        for t in range(24):
            x, y = y, (2 * x + 3 * y) % 5
            current, lanes[x][y] = lanes[x][y], _turn(current, (t + 1) * (t + 2) // 2)
        lanes = [[lanes[x][y] ^ (~lanes[(x + 1) % 5][y] & lanes[(x + 2) % 5][y]) for y in range(5)] for x in range(5)]
        for j in range(7):
            feedback = ((feedback << 1) ^ ((feedback >> 7) * 0x71)) & 0xFF
            if feedback & 2:
                lanes[0][0] = lanes[0][0] ^ np.uint64(1 << ((1 << j) - 1))
    return lanes


def keccak256_all(messages: list[bytes]) -> list[bytes]:
    """The hash of each message; those of as many blocks of the sponge are hashed together."""
    out: list[bytes] = [b""] * len(messages)
    by_blocks: dict[int, list[int]] = {}
    for k, message in enumerate(messages):
        by_blocks.setdefault(len(message) // _RATE + 1, []).append(k)
    for blocks, which in by_blocks.items():
        raw = np.zeros((len(which), blocks * _RATE), np.uint8)
        for row, k in enumerate(which):
            raw[row, : len(messages[k])] = np.frombuffer(messages[k], np.uint8)
            raw[row, len(messages[k])] = 1
        raw[:, -1] |= 0x80
        words = np.ascontiguousarray(raw).view("<u8")
        lanes = [[np.zeros(len(which), np.uint64) for _ in range(5)] for _ in range(5)]
        for block in range(blocks):
            for k in range(_RATE // 8):
                lanes[k % 5][k // 5] = lanes[k % 5][k // 5] ^ words[:, block * (_RATE // 8) + k]
            lanes = _permute_all(lanes)
        digests = np.stack([lanes[k][0] for k in range(4)], axis=1).astype("<u8")
        for row, k in enumerate(which):
            out[k] = digests[row].tobytes()
    return out


@lru_cache(maxsize=4096)
def selector(method: str) -> bytes:
    """The first four bytes of a method signature's hash; fetchers ask for the same few with every call."""
    return keccak256(method.encode())[:4]


def address(text: str) -> bytes:
    """Parse `0x` and 40 hex digits; the EIP-55 checksum is mandatory."""
    if not text.startswith("0x") or len(text) != 42:
        raise ValueError(f"address {text!r}: expected 0x and 40 hex digits")
    try:
        raw = bytes.fromhex(text[2:])
    except ValueError as error:
        raise ValueError(f"address {text!r}: {error}") from None
    if checksummed(raw) != text:
        raise ValueError(f"address {text!r}: not checksummed, expected {checksummed(raw)}")
    return raw


def checksummed(raw: bytes) -> str:
    digits = raw.hex()
    digest = keccak256(digits.encode()).hex()
    return "0x" + "".join(c.upper() if int(h, 16) >= 8 else c for c, h in zip(digits, digest, strict=False))
