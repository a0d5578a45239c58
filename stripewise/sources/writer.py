"""Writing ORC with Spark's writer."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import OrcFormatError

# Codecs that the writer knows.
CODECS = ("none", "snappy", "zlib", "lzo", "zstd", "lz4")


def _in_files(df: DataFrame, scratch: str, file_rows: int, sort_by: list[str], unit: int) -> DataFrame:
    """df in partitions of at most file_rows rows, about equally many and a multiple of ``unit`` in each but the last, sorted over
    all. A task holds one of them, however many rows there are."""
    n = df.count()
    files = max(1, -(-n // file_rows))
    if files == 1:
        return df.coalesce(1).sortWithinPartitions(*sort_by)
    spark = df.sparkSession
    # stored, as another run would find other bounds; then rows know their place, and go to the file that it belongs to
    df.repartitionByRange(files, *sort_by).sortWithinPartitions(*sort_by).withColumn("__at", F.monotonically_increasing_id()).write.parquet(scratch)
    ranges = spark.read.parquet(scratch).withColumn("__range", F.shiftright("__at", 33))
    before, starts = 0, []
    for r in ranges.groupBy("__range").count().orderBy("__range").collect():
        starts.append((r["__range"], before))
        before += r["count"]
    per = -(-n // (files * unit)) * unit
    place = F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = ranges.join(F.broadcast(spark.createDataFrame(starts, "__range bigint, __start bigint")), "__range")
    dealt = placed.withColumn("__file", (place / F.lit(per)).cast("int")).repartitionById(-(-n // per), F.col("__file"))
    return dealt.sortWithinPartitions("__at").select(*[f"`{c}`" for c in df.columns])


def write(
    df: DataFrame,
    path: str,
    compression: str = "zstd",
    stripe_bytes: int | None = None,
    stripe_rows: int | None = None,
    check_rows: int | None = None,
    stride: int | None = None,
    bloom_columns: Iterable[str] = (),
    bloom_fpp: float = 0.01,
    batch_rows: int | None = None,
    schema: StructType | None = None,
    single_file: bool = False,
    file_rows: int | None = None,
    sort_by: Iterable[str] = (),
    mode: str = "errorifexists",
    partition_by: Iterable[str] = (),
) -> None:
    """Write df below path.

    stripe_bytes and stride set the sizes of stripes and row groups (stride 0: no indexes); stripe_rows flushes a stripe
    after so many rows, whatever its bytes (to the batch of batch_rows in which they are reached); check_rows says after how many rows the writer
    looks whether a stripe is full, where its 5000 are too many. bloom_columns are the columns with Bloom
    filters. With ``schema`` df must have just these columns and types. sort_by sorts within each file, which makes
    row-group indexes selective. single_file is for small tables only; with file_rows, a multiple of the stride, there are as few files of so many
    rows at most as can be, sorted over all by sort_by as by their names, and the row groups of all but the last are full, provided that
    stripes are, for which batch_rows must divide into the stride. TIMESTAMP_NTZ columns are stored as ORC bigint
    (microseconds); Spark restores them, other readers see integers."""
    if compression not in CODECS:
        raise OrcFormatError("Unsupported", f"no codec {compression}")
    if schema is not None and [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in schema]:
        raise OrcFormatError("MismatchedSchema", f"{df.schema.simpleString()} is not {schema.simpleString()}")
    scratch = None
    if file_rows:
        if not (sort_by := list(sort_by)) or file_rows % (unit := stride or 10_000):
            raise ValueError("file_rows needs sort_by and is a multiple of the stride")
        scratch = f"{path.rstrip('/')}-ranges-{uuid.uuid4().hex}"
        df = _in_files(df, scratch, file_rows, sort_by, unit)
    elif single_file:
        df = df.coalesce(1)
    if sort_by and not file_rows:
        df = df.sortWithinPartitions(*sort_by)
    out = df.write.mode(mode).option("compression", compression)
    if stripe_bytes:
        out = out.option("orc.stripe.size", stripe_bytes)
    if stripe_rows:
        out = out.option("orc.stripe.row.count", stripe_rows)
    if check_rows:
        out = out.option("orc.rows.between.memory.checks", check_rows)
    if stride is not None:
        out = out.option("orc.row.index.stride", stride).option("orc.create.index", str(stride > 0).lower())
    if bloom := list(bloom_columns):
        out = out.option("orc.bloom.filter.columns", ",".join(bloom)).option("orc.bloom.filter.fpp", bloom_fpp)
    if by := list(partition_by):
        out = out.partitionBy(*by)
    conf, key = df.sparkSession.conf, "spark.sql.orc.columnarWriterBatchSize"
    before = conf.get(key)
    if batch_rows:
        conf.set(key, str(batch_rows))
    try:
        out.orc(path)
    finally:
        conf.set(key, before)
        if scratch:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(scratch)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
