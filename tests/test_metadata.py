import pytest
from pyspark.sql import functions as F

from stripewise.functions.bloom import BloomFilter, hash_long, hash_value, murmur3_64
from stripewise.sources.metadata import OrcFile, metadata, row_count
from stripewise.sources.scan import paths_of
from stripewise.sources.writer import write


@pytest.fixture(scope="module")
def orders(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("orc") / "o")
    df = spark.read.parquet(f"{sf}/orders.parquet").withColumn("o_totalprice", F.expr("if(o_orderkey % 5 = 0, null, o_totalprice)")).withColumn("dec", F.col("o_totalprice").cast("decimal(12,2)")).withColumn("list", F.array("o_orderkey", "o_custkey"))
    write(df, path, single_file=True, stride=1000, sort_by=["o_orderkey"], bloom_columns=["o_orderkey", "o_orderpriority", "o_totalprice", "dec"])
    return path


def test_statistics_are_those_of_the_data(spark, orders):
    df = spark.read.orc(orders)
    stats = {r["name"]: r for r in metadata(spark, orders, "column_statistics").where("stripe is null").collect()}
    for c in ("o_orderkey", "o_custkey", "o_totalprice", "dec", "o_orderpriority"):
        want = df.agg(F.min(c).cast("string"), F.max(c).cast("string"), F.count(c)).first()
        got = stats[c]
        same = (lambda a, b: float(a) == float(b)) if c in ("o_totalprice", "dec") else (lambda a, b: a == b)
        assert same(got["min"], want[0]) and same(got["max"], want[1]) and got["n_values"] == want[2]
        assert got["has_null"] == (c in ("o_totalprice", "dec"))
    assert stats["list"]["kind"] == "collection"
    assert row_count(spark, orders).first().n == df.count()


def test_row_groups_and_stripes(spark, orders):
    rows = metadata(spark, orders, "row_groups").where("name = 'o_orderkey'").orderBy("first_row").collect()
    assert [(r.first_row, r.end_row) for r in rows] == [(k, min(k + 1000, 1500)) for k in range(0, 1500, 1000)]
    assert sum(r.rows for r in metadata(spark, orders, "stripes").collect()) == 1500
    streams = metadata(spark, orders, "streams").orderBy("offset").collect()
    assert all(a.offset + a.length == b.offset for a, b in zip(streams, streams[1:], strict=False) if a.stripe == b.stripe)
    assert metadata(spark, orders, "encodings").count() == 10
    assert metadata(spark, orders, "files").first().stride == 1000


def test_blooms_of_spark_contain_what_is_there(spark, orders):
    file = OrcFile(paths_of(spark, orders)[0])
    rows = spark.read.orc(orders).orderBy("o_orderkey").collect()
    for name in ("o_orderkey", "o_orderpriority", "o_totalprice", "dec"):
        c = file.column(name)
        filters = file.stripes[0].blooms(c.id)
        for k, f in enumerate(filters):
            values = [r[name] for r in rows[1000 * k : 1000 * k + 1000] if r[name] is not None]
            assert all(f.might_contain(v, c.kind) for v in values)
    keys = file.stripes[0].blooms(file.column("o_orderkey").id)
    assert sum(keys[0].might_contain(10**9 + k, "long") for k in range(1000)) < 60
    assert metadata(spark, orders, "blooms").count() == 4 * 2


def test_hashes():
    assert murmur3_64(b"") != murmur3_64(b"\0") and 0 <= murmur3_64(b"abc" * 5) < 1 << 64
    assert hash_long(0) != hash_long(1) and hash_value(True, "boolean") is None
    assert hash_value("1.10", "decimal") == hash_value("1.1", "decimal") and hash_value(-0.0, "double") == hash_value(0.0, "double")
    f = BloomFilter(1000, 5)
    f.add("x")
    f.add(7, "long")
    assert f.might_contain("x") and f.might_contain(7, "long") and not f.might_contain("y") and f.n_bits == 1024


def test_files_of_any_name(spark, orders, tmp_path):
    import shutil

    (file,) = paths_of(spark, orders)
    shutil.copy(file.removeprefix("file://"), tmp_path / "part-0")
    (tmp_path / "empty").touch()
    assert row_count(spark, str(tmp_path)).first().n == spark.read.orc(str(tmp_path)).count() > 0
    assert metadata(spark, str(tmp_path), "stripes").count() == metadata(spark, orders, "stripes").count()
