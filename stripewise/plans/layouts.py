"""ORC copies of the given tables, written once for each layout and kept in the working folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyarrow import fs, orc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_dir
from ..sources.writer import write

_MADE: dict[tuple, str] = {}


def _same(df: DataFrame) -> DataFrame:
    return df


def _nullable(df: DataFrame) -> DataFrame:
    """part with a column that is null in every seventh size."""
    return df.withColumn("p_mark", F.expr("nullif(p_size % 7, 0)"))


def _flat(df: DataFrame) -> DataFrame:
    """All flat types from orders."""
    return df.select(
        F.col("o_orderkey").alias("i64"),
        F.col("o_orderkey").cast("int").alias("i32"),
        (F.col("o_orderkey") % 30000).cast("smallint").alias("i16"),
        (F.col("o_orderkey") % 100).cast("tinyint").alias("i8"),
        F.col("o_totalprice").alias("f64"),
        (F.col("o_orderkey") % 1000 / 4).cast("float").alias("f32"),
        (F.col("o_orderkey") % 2 == 0).alias("flag"),
        F.col("o_orderpriority").alias("text"),
        F.encode("o_orderstatus", "UTF-8").alias("bytes"),
        F.col("o_orderdate").cast("date").alias("day"),
        (F.col("o_orderkey") % 100000).cast("decimal(15,5)").alias("dec"),
    )


def _nested(df: DataFrame) -> DataFrame:
    """events with a struct, an array, a map and an array of structs."""
    return df.select(
        "event_id",
        F.struct(F.col("user_id").alias("a"), F.col("event_type").alias("b")).alias("s"),
        F.array("event_id", "user_id").alias("l"),
        F.map_from_arrays(F.array(F.lit("u"), F.lit("e")), F.array("user_id", "event_id")).alias("m"),
        F.array(F.struct(F.col("value").alias("v"), F.col("event_type").alias("t"))).alias("ls"),
    )


def _typed(df: DataFrame) -> DataFrame:
    """A column of each type that indexes and statistics know, from orders; doubles of every third thousand have a NaN, one tenth of zeros is negative."""
    k = F.col("o_orderkey")
    return df.select(
        k.alias("k"),
        F.format_string("key-%08d", k).alias("str"),
        F.date_add(F.lit("2020-01-01").cast("date"), (k / 10).cast("int")).alias("day"),
        F.timestamp_micros(F.lit(1_600_000_000_000_000) + k * 1_001_003).alias("ts"),
        (k * F.lit(0.25)).cast("decimal(15,2)").alias("dec"),
        (F.floor(k / 4000) % 2 == 0).alias("flag"),
        F.when((F.floor(k / 1000) % 3 == 1) & (k % 500 == 7), F.lit(float("nan"))).otherwise(k / 2).alias("dbl"),
        F.when(k % 10 == 3, F.lit(-0.0)).otherwise(k.cast("double") + 1).alias("zero"),
        F.encode(F.repeat(F.lit("b"), (k % 5).cast("int")), "UTF-8").alias("bytes"),
        (k.cast("float") / 4).cast("float").alias("flt"),
    )


def _scattered(df: DataFrame) -> DataFrame:
    """orders with keys that every row group has from all over, so that bounds tell nothing."""
    return df.withColumn("place", (F.col("o_orderkey") * 7919) % 10007)


#: Rows of a file at most, where files are sorted by key over all; with stripes of full row groups, so that groups count on from file to file.
ORDERED = {"file_rows": 500_000}
GROUPS = ORDERED | {"stride": 1000, "batch_rows": 1000}

#: Name: (what to derive from the table, how to write it).
LAYOUTS: dict[str, tuple[Callable[[DataFrame], DataFrame], dict]] = {
    "plain": (_same, {}),
    "indexed": (_same, GROUPS),
    "striped": (_same, ORDERED | {"stride": 1000, "stripe_bytes": 4 << 10, "check_rows": 500}),
    "nullable": (_nullable, GROUPS),
    "bloomed": (_same, GROUPS | {"bloom": True}),
    "flat": (_flat, {}),
    "flat_striped": (_flat, ORDERED | {"stripe_bytes": 32 << 10}),
    "nested": (_nested, {}),
    "by_rows": (_same, ORDERED | {"stripe_rows": 1000, "check_rows": 500, "batch_rows": 500, "stride": 1000}),
    "batched": (_same, {"batch_rows": 100, "declared": True}),
    "typed": (_typed, GROUPS),
    "typed_bloomed": (_typed, GROUPS | {"bloom": True}),
    "scattered": (_scattered, GROUPS | {"bloom": True, "bloom_fpp": 1e-7}),
    **{f"codec_{c}": (_same, {"compression": c}) for c in ("none", "snappy", "zlib", "lzo", "zstd", "lz4")},
}


def orc_of(spark: SparkSession, sf_dir: str, table: str, layout: str = "plain", key: str | None = None) -> str:
    """The path of a table in a layout, files sorted by key (names of columns) over all where the layout says so; written on first use."""
    name = (spark.sparkContext.applicationId, sf_dir, table, layout)
    if name not in _MADE:
        derive, options = LAYOUTS[layout]
        options = dict(options)
        df = derive(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if options.pop("bloom", False):
            options["bloom_columns"] = [f.name for f in df.schema if not f.dataType.simpleString().startswith(("array", "map", "struct"))]
        if options.pop("declared", False):
            options["schema"] = df.schema
        path = f"{work_dir(spark)}/orc-{table}-{layout}-{uuid.uuid4().hex}"
        write(df, path, sort_by=key.split(", ") if key and "file_rows" in options else [], **options)
        _MADE[name] = path
    return _MADE[name]


def arrow_file(spark: SparkSession, sf_dir: str) -> str:
    """nation's few rows with a union of numbers and names and an instant in nanoseconds, which Spark cannot write."""
    name = (spark.sparkContext.applicationId, sf_dir, "nation", "arrow")
    if name not in _MADE:
        rows = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()
        tags = pa.array([r.n_nationkey % 2 for r in rows], pa.int8())
        union = pa.UnionArray.from_sparse(tags, [pa.array([r.n_regionkey for r in rows], pa.int64()), pa.array([r.n_name for r in rows])])
        at = pa.array([1_000_000_007 * r.n_nationkey + 123_456_789 for r in rows], pa.int64()).cast(pa.timestamp("ns", "UTC"))
        folder = f"{work_dir(spark)}/orc-arrow-{uuid.uuid4().hex}"
        system, base = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
        system.create_dir(base, recursive=True)
        with system.open_output_stream(f"{base}/nation.orc") as out:
            orc.write_table(pa.table({"id": pa.array([r.n_nationkey for r in rows], pa.int64()), "u": union, "instant": at}), out)
        _MADE[name] = folder
    return _MADE[name]
