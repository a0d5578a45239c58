"""Reading ORC: Spark's own reader where it can do what is asked, the "orcx" source otherwise."""

from __future__ import annotations

import json
from collections.abc import Iterable
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import OrcFormatError
from ..operators.predicate import Predicate, prune_stripe
from ..operators.projection import Projection
from ..operators.selection import RowSelection
from .bytesource import MemorySource
from .metadata import OrcFile, listed
from .orcx import OrcxReader, OrcxSource, StripeGroup, StripePart, grouped, output_schema

BATCH = 8192


def paths_of(spark: SparkSession, path: str | Iterable[str]) -> list[str]:
    """The files of one or more paths, sorted, from Spark's own listing on the driver; no job runs."""
    given = [path] if isinstance(path, str) else list(path)
    return sorted(f for p in given for f in listed(spark, p, "*").inputFiles())


def first_schema(spark: SparkSession, path: str | Iterable[str]):
    """The ORC type tree of the first file of a path that has rows; None without one, or where its codec is one that only Spark reads."""
    for f in paths_of(spark, path):
        try:
            return OrcFile(f).schema
        except OrcFormatError as e:
            if e.kind == "Unsupported":
                return None
            if e.kind != "EmptyFile":
                raise
    return None


def native(spark: SparkSession, path, columns: Iterable[str] | None = None, predicate: Predicate | None = None) -> DataFrame:
    """Spark's own vectorized scan: pruned columns, pushed filters, splits by stripe."""
    df = spark.read.orc(path if isinstance(path, str) else list(path))
    if predicate is not None:
        df = df.where(predicate.condition())
    if columns is None:
        return df
    wanted = set(columns)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in wanted])


def planned(file: OrcFile, byte_range: tuple[int, int] | None = None, selection: RowSelection | None = None, predicate: Predicate | None = None, before: int = 0) -> list[StripePart]:
    """The stripes of a file, with the ranges of their rows that are read.

    byte_range keeps stripes whose first byte is in [start, end). A selection counts rows of the whole file; rows it does not
    reach are left out. A predicate drops row groups that cannot match. All three together mean all of them. Positions start at ``before``."""
    out, first = [], 0
    for s in file.stripes:
        rows = RowSelection.select_all(s.rows)
        if selection is not None:
            rows = rows.intersection(selection.window(first, first + s.rows))
        if byte_range is not None and not byte_range[0] <= s.offset < byte_range[1]:
            rows = RowSelection.skip_all(s.rows)
        if predicate is not None and rows.selects_any:
            rows = rows.intersection(RowSelection.from_row_groups(prune_stripe(predicate, s), file.stride or s.rows or 1, s.rows))
        if rows.selects_any:
            out.append(StripePart(file.source.name, s.number, before + first, s.rows, rows))
        first += s.rows
    return out


#: Files up to which the driver reads the tails itself.
FEW = 8


def _spread(spark: SparkSession, files: list[str]) -> int:
    return max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism))


def starts_of(spark: SparkSession, files: list[str]) -> list[int]:
    """For each file the rows of those before it, and the rows of all; of many files executors read the tails."""
    if len(files) <= FEW:
        rows = [OrcFile(f).rows for f in files]
    else:

        def count(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([OrcFile(f).rows for f in batch.column(1).to_pylist()], pa.int64())], names=["k", "rows"])

        named = spark.createDataFrame(list(enumerate(files)), "k bigint, path string").repartition(_spread(spark, files))
        rows = [r.rows for r in sorted(named.mapInArrow(count, "k bigint, rows bigint").collect())]
    return [0, *accumulate(rows)]


def total_rows(spark: SparkSession, path: str | Iterable[str]) -> int:
    """The rows of all files, from their tails: those that a selection counts."""
    return starts_of(spark, paths_of(spark, path))[-1]


def _far(spark: SparkSession, files: list[tuple[str, int, bytes | None]], schema: StructType, options: dict, byte_range, predicate) -> DataFrame:
    """A scan of many files, each with the position of its first row and the selection of its rows: executors read the tails,
    plan the stripes and read them; nothing of it comes to the driver."""
    reader = OrcxReader(schema, options | {"parts": "[]"})

    def plan(batches):
        for batch in batches:
            for f, before, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = planned(OrcFile(f), byte_range, None if rows is None else RowSelection.from_bytes(rows), predicate, before)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([json.dumps([p.packed() for p in g.parts]) for g in grouped(found)], pa.string())], names=["parts"])

    def read(batches):
        for batch in batches:
            for parts in batch.column(0).to_pylist():
                yield from reader.read(StripeGroup(tuple(map(StripePart.unpacked, json.loads(parts)))))

    tasks = _spread(spark, [f for f, *_ in files])
    parts = spark.createDataFrame(files, "path string, before bigint, selection binary").repartition(tasks).mapInArrow(plan, "parts string")
    return parts.repartition(max(4 * spark.sparkContext.defaultParallelism, len(files))).mapInArrow(read, schema)


def scan(
    spark: SparkSession,
    path: str | Iterable[str],
    columns: Iterable[str] | None = None,
    ids: Iterable[int] | None = None,
    missing: str = "error",
    names: list[str] | None = None,
    schema: StructType | None = None,
    byte_range: tuple[int, int] | None = None,
    selection: RowSelection | None = None,
    predicate: Predicate | None = None,
    prune_only: bool = False,
    timestamps: str = "micros",
    strict: bool = False,
    row_index: bool = False,
    file_path: bool = False,
    batch_size: int = BATCH,
    across: bool = False,
) -> DataFrame:
    """A scan of the ORC files at a path.

    columns, ids   top-level columns by name or pre-order id, in file order; ``missing`` says what unknown ones do (error, ignore)
    names          new names of all columns of the file, by position
    schema         new names and types of all columns of the file, by position; values are cast, and what doesn't fit raises
    byte_range     stripes whose first byte lies in [start, end)
    selection      rows by position; of several files as if they were one, in the order of their names
    predicate      exact; with prune_only whole row groups that may match are returned and rows are not filtered
    timestamps     micros, nanos (bigint) or decimal (decimal(38,9) seconds); ``strict`` raises where micros lose digits
    row_index, file_path   add columns with a row's position in its file, and the file; with ``across`` its position in all files as if they were one

    Without positions, special types or names this is Spark's own reader."""
    if timestamps not in ("micros", "nanos", "decimal"):
        raise ValueError(f"timestamps cannot be {timestamps}")
    if schema is not None:
        names = [f.name for f in schema.fields]
    special = byte_range is not None or selection is not None or prune_only or row_index or file_path or names or strict or timestamps != "micros" or ids is not None
    if not special:
        root = first_schema(spark, path)
        if root is None or not root.needs_custom_reader():
            if columns is not None and root is not None:
                columns = Projection.by_name(root, columns, missing).names(root)
            return native(spark, path, columns, predicate)
    files = paths_of(spark, path)
    if not files:
        raise FileNotFoundError(str(path))
    first = OrcFile(files[0])
    root = first.schema
    chosen = Projection.all() if columns is None and ids is None else Projection.by_id(root, ids, missing) if ids is not None else Projection.by_name(root, columns, missing)
    wanted = chosen.names(root)
    need = wanted
    if predicate is not None and not prune_only:
        need = [n for n in root.names if n in wanted or n in predicate.columns()]
    read = output_schema(root, need, timestamps, None, row_index or not need, file_path)
    options = {"schema": read.json(), "columns": json.dumps(need), "timestamps": timestamps, "strict": str(strict).lower(), "position": str(row_index or not need).lower(), "file": str(file_path).lower(), "batch": str(batch_size)}
    starts = starts_of(spark, files) if across or selection is not None and len(files) > 1 else None
    before = starts if across else [0] * len(files)
    own: list[RowSelection | None] = [selection] * len(files)
    if selection is not None and len(files) > 1:
        own = [selection.window(a, b) for a, b in pairwise(starts)]
    if len(files) > FEW:
        chosen_files = [(f, k, None if rows is None else rows.to_bytes()) for f, k, rows in zip(files, before, own, strict=False) if rows is None or rows.selects_any]
        df = _far(spark, chosen_files, read, options, byte_range, predicate)
    else:
        parts = [p for f, k, rows in zip(files, before, own, strict=False) for p in planned(OrcFile(f), byte_range, rows, predicate, k)]
        spark.dataSource.register(OrcxSource)
        df = spark.read.format("orcx").options(**options, parts=json.dumps([p.packed() for p in parts])).load()
    if predicate is not None and not prune_only:
        df = df.where(predicate.condition())
    new = dict(zip(root.names, names, strict=True)) if names else {}
    types = dict(zip(root.names, [f.dataType for f in schema.fields], strict=True)) if schema is not None else {}
    extra = ["row_index"] * row_index + ["file_path"] * file_path
    return df.select(*[(F.col(f"`{n}`").cast(types[n]) if n in types else F.col(f"`{n}`")).alias(new.get(n, n)) for n in wanted], *extra)


def from_bytes(spark: SparkSession, data: bytes) -> DataFrame:
    """A DataFrame of an ORC file in memory, such as one read from standard input. Of a size that the driver can hold."""
    import io

    from pyarrow import orc

    OrcFile(MemorySource(data))  # raises what is wrong with it
    return spark.createDataFrame(orc.ORCFile(io.BytesIO(data)).read())


def stripe_ranges(path: str) -> list[tuple[int, int]]:
    """The byte range of each stripe of a file."""
    return [(s.offset, s.offset + s.index_length + s.data_length + s.footer_length) for s in OrcFile(path).stripes]
