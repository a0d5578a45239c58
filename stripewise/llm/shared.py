"""What the corpus operators have in common: the shared folder, stored tables, keys of rows and texts."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset in a local session
    (as in tests) one temporary folder of this process; on a cluster that is an error, as executors would not see each other's files."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="stripewise-"))
    return _OWN[0]


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def passing_shuffles(spark: SparkSession):
    """Shuffle files of what is written or first planned within go when it ends; else they stay until the driver's JVM happens to
    collect its garbage, and those of all steps of an operator add up."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df in the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with passing_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``stored`` made, when no other table still reads them."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sliced(batches, rows: int = 1000):
    """The rows of Arrow batches in smaller ones, so that what a worker makes of a batch of texts stays small."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def released(run):
    """A function over batches, after which a worker, which may wait for its next task for long, gives free memory back."""

    @functools.wraps(run)
    def around(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library has no such function
                ctypes.CDLL(None).malloc_trim(0)

    return around


def text_key(text):
    """16 bytes that stand for a text; null counts as the empty text."""
    return F.unhex(F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8")))


def row_key(*columns):
    """16 bytes that stand for the values of some columns of a row, nulls told apart from empty strings."""
    parts = [F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n")) for c in columns]
    sized = [F.concat(F.char_length(p).cast("string"), F.lit(":"), p) for p in parts]
    return F.unhex(F.md5(F.encode(F.concat(*sized), "UTF-8")))


def column(name: str):
    """The column of that very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole(df: DataFrame, columns: list[str] | None = None):
    """Columns of df (all where None) as one struct, in which no name can clash with an operator's own."""
    return F.struct(*[column(c).alias(f"c{k}") for k, c in enumerate(df.columns if columns is None else columns)])


def unpacked(columns: list[str], row: str = "row") -> list:
    """The columns of a struct that ``whole`` made."""
    return [F.col(row).getField(f"c{k}").alias(c) for k, c in enumerate(columns)]


def keep_rows(df: DataFrame, key, keep: DataFrame) -> DataFrame:
    """Rows of df whose key (an expression) is in keep(key); of rows with equal keys one stays.

    Rows that share a key are equal in all columns that the key covers. ``keep`` has a column ``n``, the
    number of rows with the key: only where it is above one are rows compared."""
    there = df.select(whole(df).alias("row"), key.alias("key")).join(keep.select("key", "n"), "key")
    once = there.where("n = 1").select("row")
    again = there.where("n > 1").groupBy("key").agg(F.first("row").alias("row")).select("row")
    return once.unionByName(again).select(*unpacked(df.columns))
