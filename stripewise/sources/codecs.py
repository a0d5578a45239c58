"""Compression of metadata sections: chunks with a three-byte header. Data streams are left to Spark's reader."""

from __future__ import annotations

import zlib

import pyarrow as pa

from ..errors import OrcFormatError

# Fixed values of the format: numbers of codecs.
NAMES = {0: "none", 1: "zlib", 2: "snappy", 3: "lzo", 4: "lz4", 5: "zstd"}


def _lz4_block(data: bytes) -> bytes:
    """An LZ4 block whose length when unpacked is unknown."""
    out, at = bytearray(), 0

    def length(n: int) -> int:
        nonlocal at
        if n == 15:
            while True:
                n += data[at]
                at += 1
                if data[at - 1] != 255:
                    break
        return n

    while at < len(data):
        token = data[at]
        at += 1
        n = length(token >> 4)
        out += data[at : at + n]
        at += n
        if at >= len(data):
            break
        back = int.from_bytes(data[at : at + 2], "little")
        at += 2
        n = length(token & 15) + 4
        _matched(out, back, n)
    return bytes(out)


def _matched(out: bytearray, back: int, n: int) -> None:
    start = len(out) - back
    if start < 0:
        raise OrcFormatError("OutOfSpec", "a match begins before the data")
    for k in range(n):  # a match can overlap what it makes
        out.append(out[start + k])


def _lzo_block(data: bytes) -> bytes:
    """An LZO1X block, by the public description of its instructions: each is a match, a run of literals, or the end."""
    out, at = bytearray(), 0
    after = 0  # literals that followed the last instruction; 4 for a run

    def take() -> int:
        nonlocal at
        at += 1
        return data[at - 1]

    def long(n: int, most: int) -> int:
        """A length in some bits, or if these are zero in zero bytes (255 each) and one more."""
        if n:
            return n
        n = most
        while (b := take()) == 0:
            n += 255
        return n + b

    def literals(n: int) -> None:
        nonlocal at
        out.extend(data[at : at + n])
        at += n

    if data and data[0] > 17:
        n = take() - 17
        literals(n)
        after = min(n, 4)
    while True:
        b = take()
        if b < 16 and after == 0:
            literals(3 + long(b, 15))
            after = 4
            continue
        if b >= 64:
            n, back, after = (b >> 5) + 1, (take() << 3) + (b >> 2 & 7) + 1, b & 3
        elif b >= 16:
            far = b < 32
            n = 2 + (long(b & 7, 7) if far else long(b & 31, 31))
            tail = take() | take() << 8
            back, after = (tail >> 2) + (16384 + ((b & 8) << 11) if far else 1), tail & 3
            if far and back == 16384:
                return bytes(out)
        else:
            n, back, after = (3, (take() << 2) + (b >> 2) + 2049, b & 3) if after == 4 else (2, (take() << 2) + (b >> 2) + 1, b & 3)
        _matched(out, back, n)
        literals(after)


def _chunk(codec: str, data: bytes) -> bytes:
    if codec == "zlib":
        return zlib.decompress(data, -15)
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    if codec == "snappy":
        size = shift = 0
        for b in data:
            size |= (b & 127) << shift
            shift += 7
            if b < 128:
                break
        return pa.Codec("snappy").decompress(data, size, asbytes=True)
    if codec in ("lz4", "lzo"):
        try:
            return _lz4_block(data) if codec == "lz4" else _lzo_block(data)
        except IndexError as e:
            raise OrcFormatError("OutOfSpec", "a compressed chunk is cut off") from e
    raise OrcFormatError("Unsupported", f"metadata compressed with {codec}")


def unpack(codec: str, data: bytes) -> bytes:
    """A compressed section, whole."""
    if codec == "none":
        return data
    out, at = [], 0
    while at + 3 <= len(data):
        head = int.from_bytes(data[at : at + 3], "little")
        part = data[at + 3 : at + 3 + (head >> 1)]
        if len(part) < head >> 1:
            raise OrcFormatError("OutOfSpec", "a compressed chunk is cut off")
        out.append(bytes(part) if head & 1 else _chunk(codec, bytes(part)))
        at += 3 + (head >> 1)
    return b"".join(out)
