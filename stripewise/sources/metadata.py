"""What an ORC file says about itself: footer, stripes, statistics, row indexes, Bloom filters, streams.

``OrcFile`` reads one file with a few small reads of its tail. The functions below give DataFrames over many files:
Spark lists the files, and executors parse the tails, so the driver sees neither.
"""

from __future__ import annotations

import json
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ColumnNotFound, OrcFormatError
from ..functions.bloom import BloomFilter
from ..functions.types import OrcType, tree
from . import wire
from .bytesource import source
from .codecs import NAMES, unpack

#: Bytes of the first read of a tail.
TAIL = 16 * 1024
#: Rows of a row group where the file does not say.
STRIDE = 10_000
# Fixed values of the format: kinds of streams and encodings by number.
STREAMS = {0: "PRESENT", 1: "DATA", 2: "LENGTH", 3: "DICTIONARY_DATA", 4: "DICTIONARY_COUNT", 5: "SECONDARY", 6: "ROW_INDEX", 7: "BLOOM_FILTER", 8: "BLOOM_FILTER_UTF8", 9: "ENCRYPTED_INDEX", 10: "ENCRYPTED_DATA"}
ENCODINGS = {0: "DIRECT", 1: "DICTIONARY", 2: "DIRECT_V2", 3: "DICTIONARY_V2"}


class Stripe:
    """One stripe: where it is, and on demand its footer and indexes."""

    def __init__(self, file: OrcFile, number: int, info: dict):
        self.file, self.number = file, number
        self.offset, self.index_length, self.data_length, self.footer_length, self.rows = (info[k] or 0 for k in ("offset", "index_length", "data_length", "footer_length", "rows"))

    @cached_property
    def footer(self) -> dict:
        return self.file.message(self.offset + self.index_length + self.data_length, self.footer_length, wire.STRIPE_FOOTER)

    @property
    def timezone(self) -> str | None:
        return self.footer["timezone"]

    @property
    def statistics(self) -> list[dict]:
        return self.file.stripe_statistics[self.number]["columns"] if self.number < len(self.file.stripe_statistics) else []

    def streams(self) -> list[dict]:
        """column, kind, length and offset of each stream, in file order."""
        out, at = [], self.offset
        for s in self.footer["streams"]:
            out.append({"column": s["column"] or 0, "kind": STREAMS.get(s["kind"] or 0, str(s["kind"])), "length": s["length"] or 0, "offset": at})
            at += s["length"] or 0
        return out

    def encodings(self) -> list[dict]:
        return [{"column": k, "kind": ENCODINGS.get(c["kind"] or 0, str(c["kind"])), "dictionary_size": c["dictionary_size"]} for k, c in enumerate(self.footer["columns"])]

    @property
    def row_groups(self) -> list[tuple[int, int]]:
        """First and last (exclusive) row of each group, within the stripe."""
        n = self.file.stride or STRIDE
        return [(k, min(k + n, self.rows)) for k in range(0, self.rows, n)]

    def _section(self, column: int, kinds: tuple[str, ...], spec: dict) -> dict | None:
        found = {s["kind"]: s for s in self.streams() if s["column"] == column and s["kind"] in kinds}
        s = next((found[k] for k in kinds if k in found), None)
        return self.file.message(s["offset"], s["length"], spec) if s else None

    def row_index(self, column: int) -> list[dict] | None:
        """statistics and positions of each row group of a column; None without an index."""
        found = self._section(column, ("ROW_INDEX",), wire.ROW_INDEX)
        return found["entries"] if found else None

    def blooms(self, column: int) -> list[BloomFilter] | None:
        """The Bloom filter of each row group of a column; None without."""
        found = self._section(column, ("BLOOM_FILTER_UTF8", "BLOOM_FILTER"), wire.BLOOM_INDEX)
        return [BloomFilter.from_message(f) for f in found["filters"]] if found else None


class OrcFile:
    """The metadata of one file: a path, a URI, bytes or a byte source."""

    def __init__(self, of):
        self.source = source(of)
        size = len(self.source)
        if not size:
            raise OrcFormatError("EmptyFile", f"{self.source.name} has no bytes")
        n = min(size, TAIL)
        tail = self.source.read(size - n, n)
        length = tail[-1]
        if length + 1 > len(tail):
            raise OrcFormatError("OutOfSpec", "the postscript is longer than the file")
        try:
            self.postscript = wire.decode(tail[-1 - length : -1], wire.POSTSCRIPT)
        except (ValueError, IndexError) as e:
            raise OrcFormatError("DecodeProto", "the postscript cannot be read") from e
        if self.postscript["magic"] != "ORC":
            raise OrcFormatError("OutOfSpec", f"{self.source.name} is no ORC file")
        if self.postscript["footer_length"] is None or self.postscript["metadata_length"] is None:
            raise OrcFormatError("OutOfSpec", "the postscript has no length of footer or metadata")
        self.codec = NAMES.get(self.postscript["compression"] or 0, "unknown")
        need = 1 + length + self.postscript["footer_length"] + self.postscript["metadata_length"]
        if need > size:
            raise OrcFormatError("OutOfSpec", "footer and metadata are longer than the file")
        if need > n:
            tail = self.source.read(size - need, need)
        end = len(tail) - 1 - length
        start = end - self.postscript["footer_length"]
        try:
            self.footer = wire.decode(unpack(self.codec, tail[start:end]), wire.FOOTER)
            self._metadata = wire.decode(unpack(self.codec, tail[start - self.postscript["metadata_length"] : start]), wire.METADATA)
        except (ValueError, IndexError) as e:
            raise e if isinstance(e, OrcFormatError) else OrcFormatError("DecodeProto", "the footer cannot be read") from e
        self.stripe_statistics = self._metadata["stripes"]
        if self.stripe_statistics and len(self.stripe_statistics) != len(self.footer["stripes"]):
            raise OrcFormatError("OutOfSpec", "statistics are not of as many stripes as there are")

    def message(self, offset: int, length: int, spec: dict) -> dict:
        return wire.decode(unpack(self.codec, self.source.read(offset, length)), spec)

    @property
    def rows(self) -> int:
        return self.footer["rows"] or 0

    @property
    def stride(self) -> int | None:
        """Rows of a row group; None where indexes are off."""
        return self.footer["stride"] or None

    @property
    def version(self) -> str:
        return ".".join(map(str, self.postscript["version"] or [0, 11]))

    @property
    def block_size(self) -> int | None:
        return self.postscript["block_size"]

    @cached_property
    def schema(self) -> OrcType:
        return tree(self.footer["types"])

    @property
    def statistics(self) -> list[dict]:
        """Statistics of each column by id, over the file."""
        return self.footer["statistics"]

    @cached_property
    def stripes(self) -> list[Stripe]:
        return [Stripe(self, k, s) for k, s in enumerate(self.footer["stripes"])]

    @property
    def user_metadata(self) -> dict[str, bytes]:
        return {x["name"]: x["value"] or b"" for x in self.footer["metadata"]}

    def column(self, name: str) -> OrcType:
        """A top-level column by its exact name."""
        found = self.schema.child(name)
        if found is None:
            raise ColumnNotFound(name, self.schema.names)
        return found


def described(stats: dict) -> dict:
    """Statistics as flat values, minimum, maximum and sum as text: kind, n_values, has_null, min, max, sum, exact_min, exact_max.
    What a file does not say is None."""
    out = {"kind": None, "n_values": stats["n_values"], "has_null": stats["has_null"], "min": None, "max": None, "sum": None, "exact_min": None, "exact_max": None}
    for kind in ("integer", "double", "string", "bucket", "decimal", "date", "binary", "timestamp", "collection"):
        if (s := stats[kind]) is None:
            continue
        out["kind"] = kind
        if kind == "bucket":
            out["sum"] = s["counts"][0] if s["counts"] else None
        elif kind == "string":
            out |= {"min": s["min"] if s["min"] is not None else s["lower"], "max": s["max"] if s["max"] is not None else s["upper"], "sum": s["sum"], "exact_min": s["min"] is not None, "exact_max": s["max"] is not None}
        elif kind == "timestamp":
            out |= {"min": s["min_utc"] if s["min_utc"] is not None else s["min"], "max": s["max_utc"] if s["max_utc"] is not None else s["max"]}
        else:
            out |= {k: s.get(k) for k in ("min", "max", "sum")}
    return out | {k: None if out[k] is None else str(out[k]) for k in ("min", "max", "sum")}


_STATS = "kind string, n_values bigint, has_null boolean, min string, max string, sum string, exact_min boolean, exact_max boolean"


def _name_of(file: OrcFile, id_: int) -> str | None:
    return next((n for n, c in zip(file.schema.names, file.schema.children, strict=True) if c.id == id_), None)


def _files(file: OrcFile) -> list[dict]:
    user = {k: v.decode("utf-8", "replace") for k, v in file.user_metadata.items()}
    return [{"rows": file.rows, "compression": file.codec, "block_size": file.block_size, "version": file.version, "stride": file.stride, "n_stripes": len(file.stripes), "schema": "\n".join(file.schema.lines()), "user_metadata": json.dumps(user)}]


def _stripes(file: OrcFile) -> list[dict]:
    first, out = 0, []
    for s in file.stripes:
        out.append({"stripe": s.number, "offset": s.offset, "index_length": s.index_length, "data_length": s.data_length, "footer_length": s.footer_length, "rows": s.rows, "first_row": first, "timezone": s.timezone})
        first += s.rows
    return out


def _columns(file: OrcFile) -> list[dict]:
    out = [{"stripe": None, "column_id": k, "name": _name_of(file, k)} | described(s) for k, s in enumerate(file.statistics)]
    return out + [{"stripe": s.number, "column_id": k, "name": _name_of(file, k)} | described(x) for s in file.stripes for k, x in enumerate(s.statistics)]


def _row_groups(file: OrcFile) -> list[dict]:
    out, first = [], 0
    for s in file.stripes:
        for name, c in zip(file.schema.names, file.schema.children, strict=True):
            entries = s.row_index(c.id)
            for k, ((a, b), e) in enumerate(zip(s.row_groups, entries or [], strict=False)):
                out.append({"stripe": s.number, "column_id": c.id, "name": name, "row_group": k, "first_row": first + a, "end_row": first + b} | described(e["statistics"]))
        first += s.rows
    return out


def _streams(file: OrcFile) -> list[dict]:
    return [{"stripe": s.number} | x for s in file.stripes for x in s.streams()]


def _encodings(file: OrcFile) -> list[dict]:
    return [{"stripe": s.number} | x for s in file.stripes for x in s.encodings()]


def _blooms(file: OrcFile) -> list[dict]:
    out = []
    for s in file.stripes:
        for name, c in zip(file.schema.names, file.schema.children, strict=True):
            for k, b in enumerate(s.blooms(c.id) or []):
                out.append({"stripe": s.number, "column_id": c.id, "name": name, "row_group": k, "n_hashes": b.n_hashes, "n_bits": b.n_bits})
    return out


_TABLES = {
    "files": (_files, "rows bigint, compression string, block_size bigint, version string, stride bigint, n_stripes bigint, schema string, user_metadata string"),
    "stripes": (_stripes, "stripe bigint, offset bigint, index_length bigint, data_length bigint, footer_length bigint, rows bigint, first_row bigint, timezone string"),
    "column_statistics": (_columns, f"stripe bigint, column_id bigint, name string, {_STATS}"),
    "row_groups": (_row_groups, f"stripe bigint, column_id bigint, name string, row_group bigint, first_row bigint, end_row bigint, {_STATS}"),
    "streams": (_streams, "stripe bigint, column bigint, kind string, length bigint, offset bigint"),
    "encodings": (_encodings, "stripe bigint, column bigint, kind string, dictionary_size bigint"),
    "blooms": (_blooms, "stripe bigint, column_id bigint, name string, row_group bigint, n_hashes bigint, n_bits bigint"),
}


def listed(spark: SparkSession, path: str, pattern: str = "*.orc") -> DataFrame:
    """path and length of each ORC file below path; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length")


def metadata(spark: SparkSession, path: str, table: str = "files") -> DataFrame:
    """A table of metadata over all files below path, whatever their names, a row's first column its file: files, stripes,
    column_statistics (stripe null: of the whole file), row_groups, streams, encodings or blooms."""
    parse, columns = _TABLES[table]
    schema = f"path string, {columns}"
    names = [c.strip().split()[0] for c in columns.split(",")]

    def run(batches):
        for batch in batches:
            for p in batch.column(0).to_pylist():
                rows = parse(OrcFile(p))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(rows), pa.string()), *(pa.array([r[n] for r in rows], kinds[n]) for n in names)], names=["path", *names])

    arrow = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    kinds = {c.strip().split()[0]: arrow[c.strip().split()[1]] for c in columns.split(",")}
    return listed(spark, path, "*").where("length > 0").select("path").mapInArrow(run, schema)  # the files that scan() reads


def starts(spark: SparkSession, path: str) -> DataFrame:
    """path, rows_before and stripes_before of each file: the rows and stripes of the files before it in the order of their names."""
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    return metadata(spark, path, "files").select("path", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for n, c in (("rows_before", "rows"), ("stripes_before", "n_stripes"))])


def might_contain(spark: SparkSession, path: str, column: str, values: list) -> DataFrame:
    """path, stripe, row_group, first_row (of the group in its file), value (as text) and might_contain: what the Bloom filters of a column say about some values, of
    each row group of all files below path. True where a group has no filter. Executors read the filters."""

    def run(batches):
        for batch in batches:
            for p in batch.column(0).to_pylist():
                file = OrcFile(p)
                kind = file.column(column)
                first = 0
                for s in file.stripes:
                    groups = s.row_groups
                    filters = s.blooms(kind.id) or [None] * len(groups)
                    rows = [(k, str(v), f is None or f.might_contain(v, kind.kind)) for k, f in enumerate(filters) for v in values]
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(rows)), pa.array([s.number] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([first + groups[r[0]][0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])], names=["path", "stripe", "row_group", "first_row", "value", "might_contain"])
                    first += s.rows

    return listed(spark, path, "*").where("length > 0").select("path").mapInArrow(run, "path string, stripe bigint, row_group bigint, first_row bigint, value string, might_contain boolean")


def row_count(spark: SparkSession, path: str) -> DataFrame:
    """n, the rows of all files below path, from their footers alone."""
    return metadata(spark, path, "files").agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("n"))
