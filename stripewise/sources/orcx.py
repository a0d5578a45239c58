"""A Python data source for what Spark's own ORC reader does not do: row positions, ranges of rows and bytes, union and
instant columns, nanoseconds, strict precision, columns renamed by position.

A partition is one stripe, the selected rows of one, or some small ones of a file. Use ``stripewise.sources.scan``; the format's name is "orcx".
"""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import orc
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..errors import OrcFormatError
from ..functions.types import OrcType, to_spark
from ..operators.selection import RowSelection
from .metadata import OrcFile

POSITION, FILE = "row_index", "file_path"


@dataclass
class StripePart(InputPartition):
    """Rows to read of a stripe: a selection of its own rows, and the position of its first row."""

    path: str
    stripe: int
    first_row: int
    rows: int
    selection: RowSelection

    def packed(self) -> list:
        """For JSON."""
        return [self.path, self.stripe, self.first_row, self.rows, base64.b64encode(self.selection.to_bytes()).decode()]

    @classmethod
    def unpacked(cls, x: list) -> StripePart:
        return cls(*x[:4], RowSelection.from_bytes(base64.b64decode(x[4])))


@dataclass
class StripeGroup(InputPartition):
    """Parts of one file that a task reads one after the other."""

    parts: tuple[StripePart, ...]


#: Rows up to which stripes of a file are read by one task.
ROWS = 1 << 16


def grouped(parts: list[StripePart]) -> list[StripeGroup]:
    out, held, n = [], [], 0
    for p in parts:
        rows = p.selection.selected_row_count
        if held and (p.path != held[-1].path or n + rows > ROWS):
            out.append(StripeGroup(tuple(held)))
            held, n = [], 0
        held.append(p)
        n += rows
    return [*out, StripeGroup(tuple(held))]


def output_schema(root: OrcType, columns: list[str], timestamps: str, renamed: list[str] | None = None, position: bool = True, path: bool = False) -> StructType:
    """Columns in file order with their new names, and the positions' column where asked for."""
    of = dict(zip(root.names, renamed or root.names, strict=True))
    fields = [StructField(of[n], to_spark(c, timestamps)) for n, c in zip(root.names, root.children, strict=True) if n in columns]
    extra = [StructField(POSITION, LongType(), False)] * position + [StructField(FILE, StringType(), False)] * path
    return StructType([*fields, *extra])


def _integers(array: pa.Array, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Values (zero where null) of a timestamp array as integers of its unit, and its nulls."""
    return np.asarray(array.cast(pa.timestamp(unit)).cast(pa.int64()).fill_null(0)), np.asarray(array.is_null())


def converted(array: pa.Array, t: OrcType, timestamps: str, strict: bool) -> pa.Array:
    """An array as Spark takes it: timestamps in the unit asked for, unions as structs, text without dictionary."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if pa.types.is_dictionary(array.type):
        array = array.dictionary_decode()
    if t.kind in ("timestamp", "timestamp_instant"):
        nanos, null = _integers(array, "ns")
        if timestamps == "nanos":
            return pa.array(nanos, pa.int64(), mask=null)
        if timestamps == "decimal":
            wide = np.stack([nanos, nanos >> 63], axis=1)  # 128 bits, the lower ones first
            return pa.Array.from_buffers(pa.decimal128(38, 9), len(nanos), [pa.array(~null).buffers()[1], pa.py_buffer(np.ascontiguousarray(wide))])
        if strict and (nanos[~null] % 1000).any():
            raise OrcFormatError("TimestampPrecision", "a timestamp has nanoseconds that microseconds cannot hold")
        micros = pa.array(nanos // 1000, pa.int64(), mask=null)
        return micros.cast(pa.timestamp("us", "UTC" if t.kind == "timestamp_instant" else None))
    if t.kind == "union":
        tags = np.asarray(array.type_codes)
        fields = [converted(array.field(k), c, timestamps, strict) for k, c in enumerate(t.children)]
        if isinstance(array.type, pa.DenseUnionType):
            at = np.asarray(array.offsets)
            fields = [f.take(pa.array(np.where(tags == k, at, 0), mask=tags != k)) for k, f in enumerate(fields)]
        else:
            fields = [f.take(pa.array(np.arange(len(tags)), mask=tags != k)) for k, f in enumerate(fields)]
        return pa.StructArray.from_arrays([pa.array(tags, pa.int8()), *fields], names=["tag", *(f"_union_{k}" for k in range(len(fields)))])
    if t.kind == "struct":
        parts = [converted(array.field(k), c, timestamps, strict) for k, c in enumerate(t.children)]
        return pa.StructArray.from_arrays(parts, names=t.names, mask=array.is_null())
    if t.kind == "list":
        offsets = pa.array(np.asarray(array.offsets), mask=np.r_[np.asarray(array.is_null()), False]) if array.null_count else array.offsets
        return pa.ListArray.from_arrays(offsets, converted(array.values, t.children[0], timestamps, strict))
    if t.kind == "map":
        offsets = pa.array(np.asarray(array.offsets), mask=np.r_[np.asarray(array.is_null()), False]) if array.null_count else array.offsets
        return pa.MapArray.from_arrays(offsets, converted(array.keys, t.children[0], timestamps, strict), converted(array.items, t.children[1], timestamps, strict))
    return array


def _as_columns(struct: StructType) -> list[str]:
    return [f.name for f in struct.fields]


class OrcxReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.fields = schema
        self.columns = json.loads(options["columns"])
        self.timestamps = options.get("timestamps", "micros")
        self.strict = options.get("strict", "false") == "true"
        self.position, self.path = options.get("position", "true") == "true", options.get("file", "false") == "true"
        self.batch = int(options.get("batch", "8192"))
        self.parts = [StripePart.unpacked(x) for x in json.loads(options["parts"])]

    def partitions(self):
        return grouped(self.parts)

    def read(self, group: StripeGroup):
        file = OrcFile(group.parts[0].path) if group.parts else None
        for part in group.parts:
            yield from self._stripe(file, part)

    def _stripe(self, file: OrcFile, part: StripePart):
        types = {n: c for n, c in zip(file.schema.names, file.schema.children, strict=True)}
        names = [f.name for f in self.fields]
        at = part.selection.positions
        data = None
        if self.columns:
            with file.source.open() as handle:
                data = orc.ORCFile(handle).read_stripe(part.stripe, columns=self.columns)
            # nested columns share their values among rows, so a stripe is converted once and then sliced
            data = {c: converted(data.column(data.schema.get_field_index(c)), types[c], self.timestamps, self.strict) for c in self.columns}
            if at.size and at[-1] - at[0] >= at.size:
                data = {c: x.take(pa.array(at)) for c, x in data.items()}
            elif at.size:
                data = {c: x.slice(int(at[0]), at.size) for c, x in data.items()}
        for low in range(0, at.size, self.batch):
            n = min(self.batch, at.size - low)
            arrays = [data[c].slice(low, n) for c in self.columns]
            if self.position:
                arrays.append(pa.array(part.first_row + at[low : low + n], pa.int64()))
            if self.path:
                arrays.append(pa.array([part.path] * n, pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=names)


class OrcxSource(DataSource):
    """Options: parts and columns (JSON, made by scan), timestamps, strict, position, file, batch; the schema is given by scan."""

    @classmethod
    def name(cls):
        return "orcx"

    def schema(self):
        return StructType.fromJson(json.loads(self.options["schema"]))

    def reader(self, schema):
        return OrcxReader(schema, dict(self.options))
