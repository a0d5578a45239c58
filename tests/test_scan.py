import datetime as dt
from decimal import Decimal

import pyarrow as pa
import pytest
from pyarrow import orc
from pyspark.sql import functions as F

from stripewise.errors import ColumnNotFound, OrcFormatError
from stripewise.functions.types import to_spark
from stripewise.operators.projection import Projection
from stripewise.operators.selection import RowSelection
from stripewise.sources.metadata import OrcFile
from stripewise.operators.predicate import Predicate as P
from stripewise.sources.scan import from_bytes, paths_of, planned, scan, stripe_ranges
from stripewise.sources.writer import write


@pytest.fixture(scope="module")
def striped(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("orc") / "t")
    df = spark.range(60000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"), F.struct(F.col("id").alias("a"), F.lit("x").alias("b")).alias("s"))
    write(df, path, single_file=True, stride=1000, stripe_bytes=256 << 10, sort_by=["id"])
    return path


def test_positions_and_ranges(spark, striped):
    file = OrcFile(paths_of(spark, striped)[0])
    assert len(file.stripes) > 2 and file.rows == 60000
    got = scan(spark, striped, ["id"], row_index=True)
    assert got.where("id != row_index").count() == 0 and got.count() == 60000
    cut = file.stripes[1].offset
    low, high = scan(spark, striped, ["id"], byte_range=(0, cut)), scan(spark, striped, ["id"], byte_range=(cut, 1 << 40))
    assert low.count() == file.stripes[0].rows and low.count() + high.count() == 60000
    assert scan(spark, striped, byte_range=(1, 2)).count() == 0
    assert stripe_ranges(paths_of(spark, striped)[0])[0][0] == 3


def test_selection_across_stripes(spark, striped):
    file = OrcFile(paths_of(spark, striped)[0])
    edge = file.stripes[0].rows
    s = RowSelection([(edge - 5, edge + 5)], edge + 100)
    assert sorted(r.id for r in scan(spark, striped, ["id"], selection=s).collect()) == list(range(edge - 5, edge + 5))
    assert [p.stripe for p in planned(file, selection=s)] == [0, 1]


def test_projection(spark, striped):
    assert scan(spark, striped, ["text", "id"]).columns == ["id", "text"]
    assert scan(spark, striped, ids=[3, 1]).columns == ["id", "s"]
    with pytest.raises(ColumnNotFound):
        scan(spark, striped, ["ID"])
    assert scan(spark, striped, ["ID", "text"], missing="ignore").columns == ["text"]
    assert scan(spark, striped, ["none"], missing="ignore").count() == 60000
    root = OrcFile(paths_of(spark, striped)[0]).schema
    assert root.ids() == [0, 1, 2, 3, 4, 5] and root.contains(5)
    assert Projection.by_id(root, [3, 4, 9]).includes(root, 5) and not Projection.by_id(root, [1]).includes(root, 4)
    assert Projection.all().names(root) == ["id", "text", "s"]


def test_names_by_position(spark, striped):
    df = scan(spark, striped, ["id", "s"], names=["n", "t", "u"])
    assert df.columns == ["n", "u"] and df.where("n != u.a").count() == 0


@pytest.fixture(scope="module")
def foreign(tmp_path_factory):
    """A file with unions, instants and nanoseconds, which Spark's own reader refuses."""
    path = str(tmp_path_factory.mktemp("orc") / "foreign.orc")
    union = pa.UnionArray.from_sparse(pa.array([0, 1, 0], pa.int8()), [pa.array([1, None, 3], pa.int64()), pa.array(["a", "b", "c"])])
    at = pa.array([1_700_000_000_123_456_000, None, 5_000], pa.timestamp("ns"))
    table = pa.table({"id": pa.array([1, 2, 3], pa.int64()), "u": union, "at": at, "inst": at.cast(pa.timestamp("ns", "UTC")), "l": pa.array([[1, 2], None, []], pa.list_(pa.int32())), "m": pa.array([[("k", 1)], None, []], pa.map_(pa.string(), pa.int64())), "st": pa.array([{"x": 1.5}, None, {"x": None}], pa.struct([("x", pa.float64())]))})
    orc.write_table(table, path)
    return path


def test_foreign_types(spark, foreign):
    assert OrcFile(foreign).schema.needs_custom_reader()
    rows = sorted(scan(spark, foreign).collect(), key=lambda r: r.id)
    assert [(r.u.tag, r.u._union_0, r.u._union_1) for r in rows] == [(0, 1, None), (1, None, "b"), (0, 3, None)]
    assert [r["at"] for r in rows] == [dt.datetime(2023, 11, 14, 22, 13, 20, 123456), None, dt.datetime(1970, 1, 1, 0, 0, 0, 5)]
    assert [r.l for r in rows] == [[1, 2], None, []] and [r.m for r in rows] == [{"k": 1}, None, {}] and [r.st and r.st.x for r in rows] == [1.5, None, None]
    assert dict(scan(spark, foreign).dtypes)["inst"] == "timestamp" and dict(scan(spark, foreign).dtypes)["at"] == "timestamp_ntz"


def test_timestamp_precision(spark, tmp_path):
    path = str(tmp_path / "n.orc")
    orc.write_table(pa.table({"at": pa.array([1_000_000_001, -5, None], pa.timestamp("ns"))}), path)
    assert [r[0] for r in scan(spark, path, timestamps="nanos").collect()][0] == 1_000_000_001
    assert scan(spark, path, timestamps="decimal").collect()[0][0] == Decimal("1.000000001")
    assert scan(spark, path).count() == 3
    with pytest.raises(Exception, match="TimestampPrecision"):
        scan(spark, path, strict=True).collect()


def test_schema_in_spark(foreign):
    root = OrcFile(foreign).schema
    assert to_spark(root.child("u")).simpleString() == "struct<tag:tinyint,_union_0:bigint,_union_1:string>"
    assert to_spark(root.child("at"), "decimal").simpleString() == "decimal(38,9)"
    assert root.lines()[0] == "ROOT" and "  inst TIMESTAMP INSTANT" in root.lines()


def test_bytes_in_memory(spark, foreign, tmp_path):
    path = str(tmp_path / "m.orc")
    orc.write_table(pa.table({"a": [1, 2]}), path)
    data = open(path, "rb").read()
    assert sorted(r.a for r in from_bytes(spark, data).collect()) == [1, 2]
    for bad, kind in ((b"", "EmptyFile"), (b"nonsense", "OutOfSpec"), (data[:-1], None)):
        with pytest.raises(OrcFormatError) as e:
            OrcFile(bad)
        assert kind is None or e.value.kind == kind


def test_all_types_and_codecs(spark, tmp_path):
    df = spark.sql("""SELECT * FROM VALUES (true, 1Y, 2S, 3, 4L, 1.5F, 2.5D, 1.25BD, X'00ff', 'a大', date'1582-10-15'), (false, -128Y, -32768S, -2147483648, -9223372036854775808L, float('inf'), double('-inf'), -9.99BD, X'', '', date'9999-12-31'),
      (null, null, null, null, null, null, null, null, null, null, null) AS t(b, i8, i16, i32, i64, f, d, dec, bin, s, day)""")
    for codec in ("none", "snappy", "zlib", "lzo", "zstd", "lz4"):
        path = str(tmp_path / codec)
        write(df, path, compression=codec)
        assert scan(spark, path).exceptAll(df).count() == 0 and scan(spark, path).count() == 3
        if codec != "lzo":
            assert scan(spark, path, row_index=True).drop("row_index").exceptAll(df).count() == 0
        assert OrcFile(paths_of(spark, path)[0]).codec == codec


def test_metadata_of_all_codecs(spark, tmp_path):
    """Footers, indexes and statistics are the same whatever they are packed with."""
    df = spark.range(9000).selectExpr("id", *[f"id * {k} AS number_{k}" for k in range(25)], *[f"concat('some text ', id % {k + 2}) AS text_{k}" for k in range(15)])
    want = None
    for codec in ("none", "snappy", "zlib", "lzo", "zstd", "lz4"):
        path = str(tmp_path / codec)
        write(df, path, compression=codec, single_file=True, sort_by=["id"], stride=1000, bloom_columns=["id"])
        file = OrcFile(paths_of(spark, path)[0])
        got = [file.rows, file.schema.lines(), file.statistics, [[s.rows, s.row_index(1)[3]["statistics"], s.row_index(40)[1]["statistics"], s.encodings(), [b.words for b in s.blooms(1)]] for s in file.stripes]]
        drop = lambda x: {k: drop(v) for k, v in x.items() if k != "bytes_on_disk"} if isinstance(x, dict) else [drop(v) for v in x] if isinstance(x, list) else x
        want = want or drop(got)
        assert drop(got) == want, codec


def test_many_files(spark, tmp_path):
    path = str(tmp_path / "many")
    write(spark.range(100).repartition(12), path)
    got = scan(spark, path, row_index=True, file_path=True)
    assert got.count() == 100 and got.select("file_path").distinct().count() == 12
    assert sorted(r.row_index for r in got.where("file_path = '" + got.first().file_path + "'").collect())[0] == 0
    kept = scan(spark, path, predicate=P.lt("id", 10), prune_only=True)
    assert 10 <= kept.count() <= 100 and kept.where("id < 10").count() == 10


def test_many_files_of_foreign_types(spark, foreign, tmp_path):
    import shutil

    for k in range(10):
        shutil.copy(foreign, tmp_path / f"{k}.orc")
    rows = scan(spark, str(tmp_path), timestamps="nanos").collect()
    assert len(rows) == 30 and {(r.id, r.u.tag, r.inst) for r in rows} == {(r.id, r.u.tag, r.inst) for r in scan(spark, foreign, timestamps="nanos").collect()}
    assert sorted(map(str, scan(spark, str(tmp_path), ["l", "m", "st", "at", "inst"]).collect())) == sorted(10 * list(map(str, scan(spark, foreign, ["l", "m", "st", "at", "inst"]).collect())))


def test_writer_checks(spark, tmp_path):
    df = spark.range(3)
    with pytest.raises(OrcFormatError):
        write(df, str(tmp_path / "a"), schema=spark.sql("select 1 as x").schema)
    with pytest.raises(OrcFormatError):
        write(df, str(tmp_path / "b"), compression="brotli")
    write(df, str(tmp_path / "c"), schema=df.schema, stride=0)
    assert scan(spark, str(tmp_path / "c"), row_index=True).count() == 3


def test_streaming(spark, tmp_path):
    from stripewise.streaming.orc_stream import stream

    write(spark.range(10), str(tmp_path / "in"))
    q = stream(spark, str(tmp_path / "in"), max_files=1).writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("arrived").count() == 10


def test_files_of_bounded_rows_in_order(spark, tmp_path):
    """Files of so many rows at most, sorted over all, of full row groups, whatever the order of the rows before; read by position as one."""
    df = spark.range(25_300).select((F.col("id") * 7919 % 25_300).alias("id")).repartition(7)
    path = str(tmp_path / "t")
    write(df, path, file_rows=4000, sort_by=["id"], stride=1000, batch_rows=1000, stripe_bytes=4 << 10, check_rows=1000)
    files = [OrcFile(f) for f in paths_of(spark, path)]
    assert len(files) == 7 and all(f.rows == 4000 for f in files[:-1]) and sum(f.rows for f in files) == 25_300
    assert all(s.rows % 1000 == 0 for f in files[:-1] for s in f.stripes)
    assert scan(spark, path, row_index=True, across=True).where("id = row_index").count() == 25_300
    some = RowSelection([(0, 5), (3999, 4001), (24_000, 25_300)], 25_300)
    assert sorted(r.id for r in scan(spark, path, selection=some).collect()) == some.positions.tolist()
    assert [x.name for x in tmp_path.iterdir()] == ["t"]
    many = str(tmp_path / "many")
    write(df, many, file_rows=2000, sort_by=["id"], stride=1000, batch_rows=1000)
    every = RowSelection.from_filters([[k % 3 == 0 for k in range(25_300)]])
    assert len(paths_of(spark, many)) == 13
    got = scan(spark, many, selection=every, row_index=True, across=True).collect()
    assert sorted(r.id for r in got) == every.positions.tolist() and all(r.id == r.row_index for r in got)
    assert scan(spark, many, selection=RowSelection.skip_all(25_300)).count() == 0
    with pytest.raises(ValueError):
        write(df, str(tmp_path / "u"), file_rows=1500, sort_by=["id"], stride=1000)
