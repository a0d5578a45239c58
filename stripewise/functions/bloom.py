"""Bloom filters of ORC row groups and their hashes."""

from __future__ import annotations

import struct
from decimal import Decimal

import numpy as np

_M = (1 << 64) - 1
# Fixed values of the public hash functions: murmur3's multipliers and seed, and the filter's default number of hashes.
SEED = 104729
C1, C2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
ADDED = 0x52DCE729
MIX1, MIX2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
HASHES = 3


def _turn(x: int, n: int) -> int:
    return (x << n | x >> (64 - n)) & _M


def murmur3_64(data: bytes, seed: int = SEED) -> int:
    """The 64-bit murmur3 of ORC, unsigned."""
    h, whole = seed, len(data) // 8 * 8
    for (k,) in struct.iter_unpack("<Q", data[:whole]):
        h = (_turn(h ^ _turn(k * C1 & _M, 31) * C2 & _M, 27) * 5 + ADDED) & _M
    if len(data) > whole:
        h ^= _turn(int.from_bytes(data[whole:], "little") * C1 & _M, 31) * C2 & _M
    h ^= len(data)
    for m in (MIX1, MIX2):
        h = (h ^ h >> 33) * m & _M
    return h ^ h >> 33


def hash_long(x: int) -> int:
    """Thomas Wang's hash of a 64-bit integer with signed shifts, unsigned."""

    def signed(v: int) -> int:
        v &= _M
        return v - (1 << 64) if v >> 63 else v

    x = signed(~x + (x << 21))
    x = signed(x ^ x >> 24)
    x = signed(x * 265)
    x = signed(x ^ x >> 14)
    x = signed(x * 21)
    x = signed(x ^ x >> 28)
    return (x + (x << 31)) & _M


def hash_value(value, kind: str) -> int | None:
    """The hash of a value as a column of this ORC kind stores it; None where filters say nothing about it."""
    if kind in ("byte", "short", "int", "long", "date"):
        return hash_long(int(value))
    if kind in ("float", "double"):
        x = np.float64(np.float32(value)) if kind == "float" else np.float64(value)
        return hash_long(int(np.array(x + 0.0).view(np.int64)))
    if kind in ("string", "varchar", "char"):
        return murmur3_64(value if isinstance(value, bytes) else str(value).encode())
    if kind == "binary":
        return murmur3_64(bytes(value))
    if kind == "decimal":
        text = format(Decimal(str(value)), "f")
        text = text.rstrip("0").rstrip(".") if "." in text else text
        return murmur3_64((text or "0").encode())
    return None


class BloomFilter:
    """A filter of n_bits bits, held as 64-bit words."""

    def __init__(self, n_bits: int, n_hashes: int = HASHES, words: list[int] | None = None):
        self.words = list(words) if words is not None else [0] * max(1, -(-n_bits // 64))
        self.n_hashes = n_hashes

    @classmethod
    def from_message(cls, message: dict) -> BloomFilter:
        """A filter as a file has it; one without words says nothing and rules nothing out."""
        words = message["words"] or [w for (w,) in struct.iter_unpack("<Q", message["bytes"] or b"")]
        return cls(64 * len(words), message["hashes"] or HASHES, words)

    @property
    def n_bits(self) -> int:
        return 64 * len(self.words)

    def _places(self, h: int):
        def int32(v: int) -> int:
            v &= 0xFFFFFFFF
            return v - (1 << 32) if v >> 31 else v

        low, high = int32(h), int32(h >> 32)
        for k in range(1, self.n_hashes + 1):
            both = int32(low + k * high)
            yield (~both if both < 0 else both) % self.n_bits

    def add_hash(self, h: int) -> None:
        for p in self._places(h):
            self.words[p >> 6] |= 1 << (p & 63)

    def test_hash(self, h: int) -> bool:
        return not self.words or all(self.words[p >> 6] >> (p & 63) & 1 for p in self._places(h))

    def add(self, value, kind: str = "string") -> None:
        h = hash_value(value, kind)
        if h is not None:
            self.add_hash(h)

    def might_contain(self, value, kind: str = "string") -> bool:
        """False: surely not there. True: perhaps, or filters say nothing about this kind."""
        if kind in ("float", "double") and value == 0:  # writers keep the sign of zero
            return any(self.test_hash(hash_long(bits)) for bits in (0, -(1 << 63)))
        h = hash_value(value, kind)
        return h is None or self.test_hash(h)
