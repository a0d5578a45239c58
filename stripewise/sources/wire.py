"""Messages of the ORC format (public specification), read from their wire form.

A message is described by a table from field number to (name, kind); kinds ending in * are lists. Absent fields are
None, so readers can tell them from zero.
"""

from __future__ import annotations

import struct

# Fixed values of the format: field numbers, names and kinds.
POSTSCRIPT = {1: ("footer_length", "uint"), 2: ("compression", "uint"), 3: ("block_size", "uint"), 4: ("version", "uint*"), 5: ("metadata_length", "uint"), 6: ("writer_version", "uint"), 8000: ("magic", "text")}
INT_STATS = {1: ("min", "sint"), 2: ("max", "sint"), 3: ("sum", "sint")}
DOUBLE_STATS = {1: ("min", "double"), 2: ("max", "double"), 3: ("sum", "double")}
STRING_STATS = {1: ("min", "text"), 2: ("max", "text"), 3: ("sum", "sint"), 4: ("lower", "text"), 5: ("upper", "text")}
BUCKET_STATS = {1: ("counts", "uint*")}
DECIMAL_STATS = {1: ("min", "text"), 2: ("max", "text"), 3: ("sum", "text")}
DATE_STATS = {1: ("min", "sint"), 2: ("max", "sint")}
BINARY_STATS = {1: ("sum", "sint")}
TIMESTAMP_STATS = {1: ("min", "sint"), 2: ("max", "sint"), 3: ("min_utc", "sint"), 4: ("max_utc", "sint"), 5: ("min_nanos", "int"), 6: ("max_nanos", "int")}
COLLECTION_STATS = {1: ("min", "uint"), 2: ("max", "uint"), 3: ("sum", "uint")}
COLUMN_STATS = {
    1: ("n_values", "uint"), 2: ("integer", INT_STATS), 3: ("double", DOUBLE_STATS), 4: ("string", STRING_STATS), 5: ("bucket", BUCKET_STATS),
    6: ("decimal", DECIMAL_STATS), 7: ("date", DATE_STATS), 8: ("binary", BINARY_STATS), 9: ("timestamp", TIMESTAMP_STATS), 10: ("has_null", "bool"),
    11: ("bytes_on_disk", "uint"), 12: ("collection", COLLECTION_STATS),
}
TYPE = {1: ("kind", "uint"), 2: ("subtypes", "uint*"), 3: ("field_names", "text*"), 4: ("length", "uint"), 5: ("precision", "uint"), 6: ("scale", "uint")}
STRIPE = {1: ("offset", "uint"), 2: ("index_length", "uint"), 3: ("data_length", "uint"), 4: ("footer_length", "uint"), 5: ("rows", "uint")}
ITEM = {1: ("name", "text"), 2: ("value", "bytes")}
FOOTER = {1: ("header_length", "uint"), 2: ("content_length", "uint"), 3: ("stripes", [STRIPE]), 4: ("types", [TYPE]), 5: ("metadata", [ITEM]), 6: ("rows", "uint"), 7: ("statistics", [COLUMN_STATS]), 8: ("stride", "uint")}
METADATA = {1: ("stripes", [{1: ("columns", [COLUMN_STATS])}])}
STRIPE_FOOTER = {1: ("streams", [{1: ("kind", "uint"), 2: ("column", "uint"), 3: ("length", "uint")}]), 2: ("columns", [{1: ("kind", "uint"), 2: ("dictionary_size", "uint")}]), 3: ("timezone", "text")}
ROW_INDEX = {1: ("entries", [{1: ("positions", "uint*"), 2: ("statistics", COLUMN_STATS)}])}
BLOOM_INDEX = {1: ("filters", [{1: ("hashes", "uint"), 2: ("words", "fixed*"), 3: ("bytes", "bytes")}])}


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        at += 1
        out |= (b & 127) << shift
        if b < 128:
            return out, at
        shift += 7


def _scalar(kind: str, x: int):
    if kind == "sint":
        return (x >> 1) ^ -(x & 1)
    if kind == "int":
        return x - (1 << 64) if x >> 63 else x
    return bool(x) if kind == "bool" else x


def decode(data, spec: dict) -> dict:
    """The fields of a message, by name; unknown ones are skipped."""
    data = memoryview(data)
    out = {name: [] if isinstance(kind, list) or (isinstance(kind, str) and kind[-1] == "*") else None for name, kind in spec.values()}
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        wire = tag & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire == 1:
            value, at = data[at : at + 8], at + 8
        elif wire == 5:
            value, at = data[at : at + 4], at + 4
        elif wire == 2:
            n, at = _varint(data, at)
            if at + n > len(data):
                raise ValueError("a field ends outside its message")
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"wire type {wire} is unknown")
        if tag >> 3 not in spec:
            continue
        name, kind = spec[tag >> 3]
        if isinstance(kind, dict):
            out[name] = decode(value, kind)
        elif isinstance(kind, list):
            out[name].append(decode(value, kind[0]))
        elif kind == "double":
            out[name] = struct.unpack("<d", value)[0]
        elif kind == "bytes":
            out[name] = bytes(value)
        elif kind.rstrip("*") == "text":
            text = bytes(value).decode("utf-8", "replace")
            out[name] = out[name] + [text] if kind[-1] == "*" else text
        elif kind == "fixed*":
            out[name] += struct.unpack(f"<{len(value) // 8}Q", value)
        elif kind == "uint*" and wire == 2:
            k = 0
            while k < len(value):
                x, k = _varint(value, k)
                out[name].append(x)
        elif kind[-1] == "*":
            out[name].append(value)
        else:
            out[name] = _scalar(kind, value)
    return out
