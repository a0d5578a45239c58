"""The library's registered queries, and SQL that gives the same from the tables they come from."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import to_spark
from ..operators import export
from ..operators.predicate import Predicate as P
from ..operators.predicate import prune_stripe
from ..operators.selection import RowSelection, Selector
from ..session import work_dir
from ..sources.metadata import OrcFile, listed, metadata, might_contain, row_count, starts
from ..sources.scan import first_schema, from_bytes, paths_of, scan, total_rows
from .layouts import arrow_file, orc_of

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns of orders behind a filter that reaches the ORC scan."""
    return scan(spark, orc_of(spark, sf_dir, "orders", "indexed", "o_orderkey"), ["o_orderkey", "o_totalprice"], predicate=P.gt("o_orderkey", 1000))


def _orders(spark, sf_dir, layout="indexed"):
    return orc_of(spark, sf_dir, "orders", layout, "o_orderkey")


def _part(spark, sf_dir, layout="nullable"):
    return orc_of(spark, sf_dir, "part", layout, "p_partkey")


# scans


@query("SELECT * FROM orders")
def orc_scan_full(spark, sf_dir):
    return scan(spark, _orders(spark, sf_dir, "plain"))


@query("SELECT o_orderkey, o_totalprice FROM orders")
def orc_scan_projection(spark, sf_dir):
    return scan(spark, _orders(spark, sf_dir, "plain"), ["o_totalprice", "o_orderkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders")
def orc_scan_projection_by_id(spark, sf_dir):
    return scan(spark, _orders(spark, sf_dir, "plain"), ids=[4, 1, 99], missing="ignore")


@query("SELECT count(*) AS n FROM orders")
def orc_scan_empty_projection(spark, sf_dir):
    return scan(spark, _orders(spark, sf_dir, "plain"), ["nothing"], missing="ignore").agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id AS a, event_type AS b, event_id AS l0, user_id AS l1, user_id AS mu, event_id AS me, value AS v, event_type AS t FROM events")
def orc_scan_nested(spark, sf_dir):
    df = scan(spark, orc_of(spark, sf_dir, "events", "nested"))
    return df.select("event_id", "s.a", "s.b", F.col("l")[0].alias("l0"), F.col("l")[1].alias("l1"), F.col("m")["u"].alias("mu"), F.col("m")["e"].alias("me"), F.col("ls")[0]["v"].alias("v"), F.col("ls")[0]["t"].alias("t"))


@query("SELECT event_id, user_id AS a, event_type AS b, event_id AS l0, user_id AS mu, value AS v FROM events")
def orcx_scan_nested(spark, sf_dir):
    df = scan(spark, orc_of(spark, sf_dir, "events", "nested"), row_index=True)
    return df.select("event_id", "s.a", "s.b", F.col("l")[0].alias("l0"), F.col("m")["u"].alias("mu"), F.col("ls")[0]["v"].alias("v"))


@query("SELECT r_regionkey AS k, r_name AS label FROM region")
def orc_scan_schema_override(spark, sf_dir):
    return scan(spark, orc_of(spark, sf_dir, "region", "indexed", "r_regionkey"), names=["k", "label"])


@query("SELECT o_orderkey, o_totalprice, 2 AS halves FROM orders")
def orc_scan_byte_range(spark, sf_dir):
    path = _orders(spark, sf_dir, "striped")
    size = listed(spark, path, "*").agg(F.max("length")).first()[0]
    halves = [scan(spark, path, ["o_orderkey", "o_totalprice"], byte_range=r) for r in ((0, size // 2), (size // 2, size))]
    return halves[0].unionByName(halves[1]).withColumn("halves", F.lit(sum(not h.isEmpty() for h in halves)))


@query("SELECT count(*) AS n FROM orders")
def orc_row_count(spark, sf_dir):
    return row_count(spark, _orders(spark, sf_dir, "plain"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index FROM orders")
def orc_row_index(spark, sf_dir):
    return scan(spark, _orders(spark, sf_dir, "striped"), ["o_orderkey"], row_index=True, across=True)


@query("SELECT o_orderkey, o_totalprice FROM orders")
def orcx_batch_size(spark, sf_dir):
    return scan(spark, _orders(spark, sf_dir, "striped"), ["o_orderkey", "o_totalprice"], row_index=True, batch_size=77).drop("row_index")


@query("SELECT r_regionkey::BIGINT AS k, r_name AS label FROM region")
def orc_scan_schema_cast(spark, sf_dir):
    return scan(spark, orc_of(spark, sf_dir, "region", "indexed", "r_regionkey"), schema=T.StructType([T.StructField("k", T.LongType()), T.StructField("label", T.StringType())]))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def orc_from_bytes(spark, sf_dir):
    at = OrcFile(paths_of(spark, orc_of(spark, sf_dir, "nation", "indexed", "n_nationkey"))[0]).source
    return from_bytes(spark, at.read(0, len(at)))


_TYPED = """WITH t AS (SELECT o_orderkey AS k, printf('key-%08d', o_orderkey) AS str, DATE '2020-01-01' + (o_orderkey // 10)::INT AS day, 1600000000000000 + o_orderkey * 1001003 AS us,
(o_orderkey * 0.25)::DECIMAL(15,2) AS dec, (o_orderkey // 4000) % 2 = 0 AS flag, CASE WHEN (o_orderkey // 1000) % 3 = 1 AND o_orderkey % 500 = 7 THEN 'NaN'::DOUBLE ELSE o_orderkey / 2 END AS dbl,
CASE WHEN o_orderkey % 10 = 3 THEN 0.0 ELSE o_orderkey + 1.0 END::DOUBLE AS zero, (o_orderkey / 4)::FLOAT AS flt, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS grp FROM orders)
"""


def _typed(spark, sf_dir, layout="typed"):
    return orc_of(spark, sf_dir, "orders", layout, "k")


@query(_TYPED + "SELECT k, us * 1000 AS ts FROM t")
def ts_nanos(spark, sf_dir):
    return scan(spark, _typed(spark, sf_dir), ["k", "ts"], timestamps="nanos")


@query(_TYPED + "SELECT k, us AS ts FROM t")
def ts_micros(spark, sf_dir):
    return scan(spark, _typed(spark, sf_dir), ["k", "ts"], row_index=True, strict=True).select("k", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))


@query(_TYPED + "SELECT k, printf('%d.%06d000', us // 1000000, us % 1000000) AS seconds FROM t")
def ts_decimal(spark, sf_dir):
    return scan(spark, _typed(spark, sf_dir), ["k", "ts"], timestamps="decimal").select("k", F.col("ts").cast("string").alias("seconds"))


@query("SELECT n_nationkey AS id, n_nationkey % 2 AS tag, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey END AS number, CASE WHEN n_nationkey % 2 = 1 THEN n_name END AS text, 1000000007 * n_nationkey::BIGINT + 123456789 AS instant FROM nation")
def orcx_unions_and_instants(spark, sf_dir):
    return scan(spark, arrow_file(spark, sf_dir), timestamps="nanos").select("id", F.col("u.tag").cast("int").alias("tag"), F.col("u._union_0").alias("number"), F.col("u._union_1").alias("text"), "instant")


@query("SELECT * FROM (VALUES (1, 'i64', 'bigint'), (2, 'i32', 'int'), (3, 'i16', 'smallint'), (4, 'i8', 'tinyint'), (5, 'f64', 'double'), (6, 'f32', 'float'), (7, 'flag', 'boolean'), (8, 'text', 'string'), (9, 'bytes', 'binary'), (10, 'day', 'date'), (11, 'dec', 'decimal(15,5)')) t(id, name, type)")
def orc_types(spark, sf_dir):
    root = first_schema(spark, _orders(spark, sf_dir, "flat"))
    return spark.createDataFrame([(c.id, n, to_spark(c).simpleString()) for n, c in zip(root.names, root.children, strict=True)], "id int, name string, type string")


# writing

_FLAT_SQL = """SELECT o_orderkey AS i64, o_orderkey::INT AS i32, (o_orderkey % 30000)::SMALLINT AS i16, (o_orderkey % 100)::TINYINT AS i8,
o_totalprice AS f64, (o_orderkey % 1000 / 4.0)::FLOAT AS f32, o_orderkey % 2 = 0 AS flag, o_orderpriority AS text, hex(encode(o_orderstatus)) AS bytes,
o_orderdate::DATE::VARCHAR AS day, (o_orderkey % 100000)::DECIMAL(15,5)::VARCHAR AS dec FROM orders"""


def _readable(df):
    """Bytes, days and decimals as text, which every engine compares alike."""
    return df.withColumns({"bytes": F.hex("bytes"), "day": F.col("day").cast("string"), "dec": F.col("dec").cast("string")})


@query(_FLAT_SQL)
def orc_write_roundtrip(spark, sf_dir):
    return _readable(scan(spark, _orders(spark, sf_dir, "flat")))


@query(_FLAT_SQL)
def orc_write_small_stripes(spark, sf_dir):
    return _readable(scan(spark, orc_of(spark, sf_dir, "orders", "flat_striped", "i64")))


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def orc_write_batches(spark, sf_dir):
    """Written in batches of 100 rows against a declared schema."""
    return scan(spark, _orders(spark, sf_dir, "batched"), ["o_orderkey", "o_orderstatus"])


@query("SELECT c AS codec, n_nationkey, n_name, n_regionkey FROM nation, (VALUES ('none'), ('snappy'), ('zlib'), ('lzo'), ('zstd'), ('lz4')) t(c)")
def orc_codecs(spark, sf_dir):
    out = None
    for c in ("none", "snappy", "zlib", "lzo", "zstd", "lz4"):
        df = scan(spark, orc_of(spark, sf_dir, "nation", f"codec_{c}")).select(F.lit(c).alias("codec"), "*")
        out = df if out is None else out.unionByName(df)
    return out


@query("SELECT c AS compression, count(*) AS n, max(n_nationkey)::VARCHAR AS high, max(n_name) AS last FROM nation, (VALUES ('none'), ('snappy'), ('zlib'), ('lzo'), ('zstd'), ('lz4')) t(c) GROUP BY c")
def metadata_codecs(spark, sf_dir):
    """Footers and statistics, whatever they are packed with."""
    paths = [orc_of(spark, sf_dir, "nation", f"codec_{c}") for c in ("none", "snappy", "zlib", "lzo", "zstd", "lz4")]
    files = reduce(lambda a, b: a.unionByName(b), [metadata(spark, p, "files").select("path", "compression", F.col("rows").alias("n")) for p in paths])
    stats = reduce(lambda a, b: a.unionByName(b), [metadata(spark, p, "column_statistics").where("stripe is null") for p in paths])
    high = stats.groupBy("path").agg(F.max(F.when(F.col("name") == "n_nationkey", F.col("max"))).alias("high"), F.max(F.when(F.col("name") == "n_name", F.col("max"))).alias("last"))
    return files.join(high, "path").drop("path")


# exact predicates


def _predicate(name: str, make: Callable[[], P], where: str) -> None:
    def run(spark, sf_dir):
        return scan(spark, _part(spark, sf_dir), ["p_partkey", "p_size", "p_mark"], predicate=make())

    run.__name__ = name
    query(f"SELECT p_partkey, p_size, p_mark FROM (SELECT *, nullif(p_size % 7, 0) AS p_mark FROM part) WHERE {where}")(run)


_predicate("pred_eq", lambda: P.eq("p_size", 5), "p_size = 5")
_predicate("pred_ne", lambda: P.ne("p_mark", 3), "p_mark <> 3")
_predicate("pred_lt", lambda: P.lt("p_size", 10), "p_size < 10")
_predicate("pred_lte", lambda: P.lte("p_size", 10), "p_size <= 10")
_predicate("pred_gt", lambda: P.gt("p_retailprice", 950.0), "p_retailprice > 950")
_predicate("pred_gte", lambda: P.gte("p_brand", "Brand#3"), "p_brand >= 'Brand#3'")
_predicate("pred_is_null", lambda: P.is_null("p_mark"), "p_mark IS NULL")
_predicate("pred_is_not_null", lambda: P.is_not_null("p_mark"), "p_mark IS NOT NULL")
_predicate("pred_and", lambda: P.all_of(P.gt("p_size", 10), P.lt("p_size", 20), P.is_not_null("p_mark")), "p_size > 10 AND p_size < 20 AND p_mark IS NOT NULL")
_predicate("pred_or", lambda: P.any_of(P.eq("p_size", 1), P.gt("p_size", 45)), "p_size = 1 OR p_size > 45")
_predicate("pred_not", lambda: P.negation(P.any_of(P.lt("p_size", 10), P.negation(P.is_null("p_mark")))), "NOT (p_size < 10 OR NOT (p_mark IS NULL))")


@query(_TYPED + "SELECT k, how FROM t, (VALUES ('native'), ('positions'), ('selection')) h(how) WHERE isnan(dbl)")
def pred_nan(spark, sf_dir):
    """NaN is above all numbers, in every way of scanning."""
    path, p = _typed(spark, sf_dir), P.gt("dbl", 1e9)
    n = total_rows(spark, path)
    ways = {"native": {}, "positions": {"row_index": True}, "selection": {"selection": RowSelection.select_all(n)}}
    return _ways(spark, path, p, ways)


@query(_TYPED + "SELECT k, how FROM t, (VALUES ('native'), ('positions')) h(how) WHERE zero = 0")
def pred_negative_zero(spark, sf_dir):
    """-0.0 equals 0.0, whatever a Bloom filter holds."""
    return _ways(spark, _typed(spark, sf_dir, "typed_bloomed"), P.eq("zero", 0.0), {"native": {}, "positions": {"row_index": True}})


def _ways(spark, path, predicate, ways):
    found = [scan(spark, path, ["k"], predicate=predicate, **options).select("k", F.lit(how).alias("how")) for how, options in ways.items()]
    return reduce(lambda a, b: a.unionByName(b), found)


# pruning: whole row groups of 1000 rows

_GROUPS = "WITH g AS (SELECT *, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS grp FROM orders), s AS (SELECT grp, min(o_orderkey) AS a, max(o_orderkey) AS b, min(o_totalprice) AS c, max(o_totalprice) AS d FROM g GROUP BY grp) SELECT o_orderkey, o_totalprice FROM g JOIN s USING (grp) WHERE "


@query(_GROUPS + "b > 12500 AND c < 2000 OR a <= 3000 AND b >= 3000")
def prune_row_groups(spark, sf_dir):
    p = P.any_of(P.all_of(P.gt("o_orderkey", 12500), P.lt("o_totalprice", 2000.0)), P.eq("o_orderkey", 3000))
    return scan(spark, _orders(spark, sf_dir), ["o_orderkey", "o_totalprice"], predicate=p, prune_only=True)


def _prune(name: str, make: Callable[[], P], having: str) -> None:
    """Whole row groups of the typed file whose statistics, as SQL over the group, may match."""

    def run(spark, sf_dir):
        return scan(spark, _typed(spark, sf_dir), ["k"], predicate=make(), prune_only=True)

    run.__name__ = name
    query(_TYPED + f"SELECT k FROM t WHERE grp IN (SELECT grp FROM t GROUP BY grp HAVING {having})")(run)


_prune("prune_string", lambda: P.gt("str", "key-00009500"), "max(str) > 'key-00009500'")
_prune("prune_date", lambda: P.lt("day", 18414), "min(day) < DATE '2020-06-01'")
_prune("prune_timestamp", lambda: P.gte("ts", 1_600_010_000_000), "max(us) // 1000 + 1 >= 1600010000000")
_prune("prune_decimal", lambda: P.lte("dec", 1000), "min(dec) <= 1000")
_prune("prune_boolean", lambda: P.eq("flag", False), "bool_or(NOT flag)")
_prune("prune_float", lambda: P.lt("flt", 1500.0), "min(flt) < 1500")
_prune("prune_nan", lambda: P.gt("dbl", 1e9), "bool_or(isnan(dbl))")
_prune("prune_not_equal", lambda: P.ne("flag", True), "bool_or(NOT flag)")

_SCATTERED = "WITH g AS (SELECT *, (row_number() OVER (ORDER BY o_orderkey * 7919 % 10007, o_orderkey) - 1) // 1000 AS grp FROM orders) "


def _scattered(spark, sf_dir):
    return orc_of(spark, sf_dir, "orders", "scattered", "place, o_orderkey")


@query(_SCATTERED + "SELECT o_orderkey, o_totalprice FROM g WHERE grp IN (SELECT grp FROM g WHERE o_orderkey = 4321)")
def bloom_prune(spark, sf_dir):
    """Bounds keep every group here; only the filters tell."""
    return scan(spark, _scattered(spark, sf_dir), ["o_orderkey", "o_totalprice"], predicate=P.eq("o_orderkey", 4321), prune_only=True)


@query(_SCATTERED + """SELECT grp::BIGINT AS row_group, v::VARCHAR AS value, bool_or(o_orderkey = v) AS might_contain FROM g, (VALUES (17), (4321), (9876), (123456789), (-5)) t(v) GROUP BY grp, v
UNION ALL SELECT grp::BIGINT, v, bool_or(o_orderpriority = v) FROM g, (VALUES ('1-URGENT'), ('none'), ('')) t(v) GROUP BY grp, v""")
def bloom_might_contain(spark, sf_dir):
    path = _scattered(spark, sf_dir)
    found = might_contain(spark, path, "o_orderkey", [17, 4321, 9876, 123456789, -5]).unionByName(might_contain(spark, path, "o_orderpriority", ["1-URGENT", "none", ""]))
    return _placed(spark, path, found).select("row_group", "value", "might_contain")


def _placed(spark, path, df):
    """df with row groups of 1000 rows counted over all files and stripes, which all but the last have whole ones, and first_row too."""
    there = df.join(F.broadcast(starts(spark, path)), "path").withColumn("first_row", F.col("first_row") + F.col("rows_before"))
    return there.withColumn("row_group", F.expr("first_row div 1000"))


# selections by position

_ROWS = "SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders) WHERE "


def _selected(spark, sf_dir, selection):
    return scan(spark, _orders(spark, sf_dir, "striped"), ["o_orderkey", "o_totalprice"], selection=selection)


def _rows(spark, sf_dir) -> int:
    return total_rows(spark, _orders(spark, sf_dir, "striped"))


@query(_ROWS + "rn BETWEEN 100 AND 149 OR rn BETWEEN 900 AND 1299")
def rowsel_skip_select(spark, sf_dir):
    return _selected(spark, sf_dir, RowSelection.from_selectors([Selector.skip_rows(100), Selector.select(50), Selector.skip_rows(750), Selector.select(400)]))


@query(_ROWS + "rn < 10 OR rn BETWEEN 500 AND 599 OR rn BETWEEN 1400 AND 1499")
def rowsel_ranges(spark, sf_dir):
    return _selected(spark, sf_dir, RowSelection.from_consecutive_ranges([(0, 10), (500, 600), (1400, 1500)], _rows(spark, sf_dir)))


@query(_ROWS + "rn % 3 = 0")
def rowsel_from_filters(spark, sf_dir):
    n = _rows(spark, sf_dir)
    return _selected(spark, sf_dir, RowSelection.from_filters(np.arange(k, min(k + 100_000, n)) % 3 == 0 for k in range(0, n, 100_000)))


@query(_ROWS + "rn BETWEEN 250 AND 299 OR rn BETWEEN 600 AND 649")
def rowsel_and_then(spark, sf_dir):
    first = RowSelection([(200, 300), (600, 800)], _rows(spark, sf_dir))
    return _selected(spark, sf_dir, first.and_then(RowSelection([(50, 150)], first.selected_row_count)))


@query(_ROWS + "rn BETWEEN 1000 AND 1099 AND o_orderkey <> 0")
def rowsel_with_predicate(spark, sf_dir):
    return scan(spark, _orders(spark, sf_dir, "striped"), ["o_orderkey", "o_totalprice"], selection=RowSelection([(1000, 1100)], _rows(spark, sf_dir)), predicate=P.ne("o_orderkey", 0))


@query(_GROUPS.replace("SELECT o_orderkey, o_totalprice FROM g", "SELECT (SELECT count(*) FROM orders) AS row_count, count(*) AS selected, (SELECT count(*) FROM orders) - count(*) AS skipped, count(*) > 0 AS any_selected FROM g") + "b > 12500")
def rowsel_counts(spark, sf_dir):
    def count(batches):
        for batch in batches:
            for f in map(OrcFile, batch.column(0).to_pylist()):
                parts = [RowSelection.from_row_groups(prune_stripe(P.gt("o_orderkey", 12500), x), f.stride, x.rows) for x in f.stripes]
                counts = (sum(x.row_count for x in parts), sum(x.selected_row_count for x in parts), sum(x.skipped_row_count for x in parts), any(x.selects_any for x in parts))
                yield pa.RecordBatch.from_pylist([dict(zip(("row_count", "selected", "skipped", "any_selected"), counts, strict=True))])

    files = listed(spark, _orders(spark, sf_dir), "*").where("length > 0").select("path")
    counted = files.mapInArrow(count, "row_count bigint, selected bigint, skipped bigint, any_selected boolean")
    return counted.agg(*[F.sum(c).alias(c) for c in ("row_count", "selected", "skipped")], F.bool_or("any_selected").alias("any_selected"))


@query("SELECT o_orderkey, CASE WHEN rn < 700 THEN 'first' ELSE 'rest' END AS part FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders) WHERE rn BETWEEN 600 AND 799 OR rn BETWEEN 900 AND 949")
def rowsel_split(spark, sf_dir):
    n = _rows(spark, sf_dir)
    first, rest = RowSelection([(600, 800), (900, 950)], n).split_off(700)
    moved = RowSelection.from_selectors([Selector.skip_rows(700), *rest.selectors])
    return _selected(spark, sf_dir, first).select("o_orderkey", F.lit("first").alias("part")).unionByName(_selected(spark, sf_dir, moved).select("o_orderkey", F.lit("rest").alias("part")))


@query(_ROWS + "rn BETWEEN 350 AND 399")
def rowsel_intersection(spark, sf_dir):
    n = _rows(spark, sf_dir)
    both = RowSelection([(100, 400)], n).intersection(RowSelection([(350, 900)], n)).intersection(RowSelection.select_all(n))
    return _selected(spark, sf_dir, both)


@query(_ROWS + "false")
def rowsel_skip_all(spark, sf_dir):
    return _selected(spark, sf_dir, RowSelection.skip_all(_rows(spark, sf_dir)))


# metadata against the data it describes


@query("""SELECT 'o_orderkey' AS name, count(o_orderkey) AS n_values, min(o_orderkey)::VARCHAR AS min, max(o_orderkey)::VARCHAR AS max, sum(o_orderkey)::VARCHAR AS sum FROM orders
UNION ALL SELECT 'o_custkey', count(o_custkey), min(o_custkey)::VARCHAR, max(o_custkey)::VARCHAR, sum(o_custkey)::VARCHAR FROM orders
UNION ALL SELECT 'o_orderstatus', count(o_orderstatus), min(o_orderstatus), max(o_orderstatus), sum(octet_length(encode(o_orderstatus)))::VARCHAR FROM orders
UNION ALL SELECT 'o_orderpriority', count(o_orderpriority), min(o_orderpriority), max(o_orderpriority), sum(octet_length(encode(o_orderpriority)))::VARCHAR FROM orders""")
def stats_file_columns(spark, sf_dir):
    df = metadata(spark, _orders(spark, sf_dir), "column_statistics").where("stripe is null")
    whole = F.col("kind") == "integer"
    least, most = (F.when(whole, f(F.col(c).try_cast("bigint")).cast("string")).otherwise(f(c)) for f, c in ((F.min, "min"), (F.max, "max")))
    files = df.where(F.col("name").isin("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")).groupBy("name", "kind")
    return files.agg(F.sum("n_values").alias("n_values"), least.alias("min"), most.alias("max"), F.sum(F.col("sum").cast("decimal(28,0)")).cast("string").alias("sum")).drop("kind")


@query("SELECT count(p_mark) AS n_values, bool_or(p_mark IS NULL) AS has_null, min(p_mark)::VARCHAR AS min, max(p_mark)::VARCHAR AS max FROM (SELECT nullif(p_size % 7, 0) AS p_mark FROM part)")
def stats_nulls(spark, sf_dir):
    df = metadata(spark, _part(spark, sf_dir), "column_statistics").where("stripe is null and name = 'p_mark'")
    least, most = (f(F.col(c).cast("bigint")).cast("string").alias(c) for f, c in ((F.min, "min"), (F.max, "max")))
    return df.agg(F.sum("n_values").alias("n_values"), F.bool_or("has_null").alias("has_null"), least, most)


@query("SELECT count(*) AS n_values, min(o_orderkey)::VARCHAR AS min, max(o_orderkey)::VARCHAR AS max FROM orders")
def stats_stripe_columns(spark, sf_dir):
    df = metadata(spark, _orders(spark, sf_dir, "striped"), "column_statistics").where("stripe is not null and name = 'o_orderkey'")
    return df.agg(F.sum("n_values").cast("bigint").alias("n_values"), F.min(F.col("min").cast("bigint")).cast("string").alias("min"), F.max(F.col("max").cast("bigint")).cast("string").alias("max"))


@query("""WITH g AS (SELECT *, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS row_group FROM orders)
SELECT row_group::BIGINT AS row_group, count(*) AS n_values, min(o_orderkey)::VARCHAR AS min, max(o_orderkey)::VARCHAR AS max FROM g GROUP BY row_group""")
def row_group_stats(spark, sf_dir):
    path = _orders(spark, sf_dir)
    return _placed(spark, path, metadata(spark, path, "row_groups").where("name = 'o_orderkey'")).select("row_group", "n_values", "min", "max")


@query("""SELECT 'bytes' AS name, 'binary' AS kind, count(*) AS n_values, NULL::DOUBLE AS min, NULL::DOUBLE AS max, sum(o_orderkey % 5)::DOUBLE AS sum FROM orders
UNION ALL """ + _TYPED.replace("WITH t AS (", "SELECT * FROM (WITH t AS (") + """SELECT 'dec', 'decimal', count(*), min(dec)::DOUBLE, max(dec)::DOUBLE, sum(dec)::DOUBLE FROM t
UNION ALL SELECT 'flt', 'double', count(*), min(flt), max(flt), sum(flt::DOUBLE) FROM t
UNION ALL SELECT 'day', 'date', count(*), min(day) - DATE '1970-01-01', max(day) - DATE '1970-01-01', NULL FROM t
UNION ALL SELECT 'flag', 'bucket', count(*), NULL, NULL, count(*) FILTER (flag) FROM t
UNION ALL SELECT 'ts', 'timestamp', count(*), min(us) // 1000, max(us) // 1000, NULL FROM t)""")
def stats_typed(spark, sf_dir):
    df = metadata(spark, _typed(spark, sf_dir), "column_statistics").where("stripe is null").where(F.col("name").isin("bytes", "dec", "flt", "day", "flag", "ts"))
    return df.groupBy("name", "kind").agg(F.sum("n_values").alias("n_values"), *[f(F.col(c).cast("double")).alias(c) for f, c in ((F.min, "min"), (F.max, "max"), (F.sum, "sum"))])


@query("SELECT count(*)::BIGINT AS n_rows, max(o_orderkey)::VARCHAR AS last, true AS several, true AS in_order FROM orders")
def stripes(spark, sf_dir):
    """Stripes follow each other without gaps, and the last one's statistics have the largest key."""
    path = _orders(spark, sf_dir, "striped")
    last = metadata(spark, path, "column_statistics").where("name = 'o_orderkey' and stripe is not null").select("path", "stripe", F.col("max").alias("high"))
    before = Window.partitionBy("path").orderBy("stripe")
    rows = metadata(spark, path, "stripes").join(last, ["path", "stripe"]).withColumn("want", F.coalesce(F.lag(F.col("first_row") + F.col("rows")).over(before), F.lit(0)))
    return rows.agg(F.sum("rows").cast("bigint").alias("n_rows"), F.max_by("high", F.struct("path", "stripe")).alias("last"), (F.count("*") > 1).alias("several"), F.bool_and(F.col("want") == F.col("first_row")).alias("in_order"))


@query("""SELECT ((rn - 1) // 1000)::BIGINT AS stripe, count(*) AS rows, (min(rn) - 1)::BIGINT AS first_row, min(o_orderkey)::VARCHAR AS min, max(o_orderkey)::VARCHAR AS max
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) GROUP BY (rn - 1) // 1000""")
def stripes_flushed(spark, sf_dir):
    """Stripes of 1000 rows each, flushed by count, with their own statistics."""
    path = _orders(spark, sf_dir, "by_rows")
    keys = metadata(spark, path, "column_statistics").where("name = 'o_orderkey' and stripe is not null").select("path", "stripe", "min", "max")
    there = metadata(spark, path, "stripes").join(keys, ["path", "stripe"]).join(F.broadcast(starts(spark, path)), "path")
    return there.select((F.col("stripe") + F.col("stripes_before")).alias("stripe"), "rows", (F.col("first_row") + F.col("rows_before")).alias("first_row"), "min", "max")


@query("SELECT 'ROW_INDEX' AS kind, count(*) + 1 AS n, true AS fills FROM (DESCRIBE orders) UNION ALL SELECT 'BLOOM_FILTER_UTF8', count(*), true FROM (DESCRIBE orders)")
def layout(spark, sf_dir):
    """An index for each column and the root, a filter for each column, and together they fill the index section; the same in every stripe."""
    path = _orders(spark, sf_dir, "bloomed")
    kinds = metadata(spark, path, "streams").where(F.col("kind").isin("ROW_INDEX", "BLOOM_FILTER_UTF8")).groupBy("path", "stripe", "kind").agg(F.count("*").alias("n"), F.sum("length").alias("length"))
    whole = kinds.groupBy("path", "stripe").agg(F.sum("length").alias("all"))
    there = kinds.join(whole, ["path", "stripe"]).join(metadata(spark, path, "stripes").select("path", "stripe", "index_length"), ["path", "stripe"])
    return there.select("kind", "n", (F.col("all") == F.col("index_length")).alias("fills")).distinct()


@query("SELECT 'o_orderstatus' AS name, 'DICTIONARY_V2' AS kind, count(DISTINCT o_orderstatus) AS dictionary_size FROM orders UNION ALL SELECT 'o_orderpriority', 'DICTIONARY_V2', count(DISTINCT o_orderpriority) FROM orders UNION ALL SELECT 'o_orderkey', 'DIRECT_V2', NULL UNION ALL SELECT 'o_totalprice', 'DIRECT', NULL")
def encodings(spark, sf_dir):
    path = _orders(spark, sf_dir)
    root = first_schema(spark, path)
    names = F.create_map(*[F.lit(x) for n, c in zip(root.names, root.children, strict=True) for x in (c.id, n)])
    df = metadata(spark, path, "encodings").withColumn("name", names[F.col("column").cast("int")])
    return df.where(F.col("name").isin("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")).groupBy("name", "kind").agg(F.max(F.when(F.col("kind").startswith("DICT"), F.col("dictionary_size"))).alias("dictionary_size"))


@query("SELECT count(*) AS n, 'zstd' AS compression, 1000::BIGINT AS stride FROM orders")
def file_info(spark, sf_dir):
    return metadata(spark, _orders(spark, sf_dir), "files").groupBy("compression", "stride").agg(F.sum("rows").alias("n")).select("n", "compression", "stride")


# exports, read back


@query("SELECT n_nationkey, n_name FROM nation")
def export_columns(spark, sf_dir):
    out = f"{work_dir(spark)}/export-csv-{abs(hash(sf_dir))}"
    export.write(scan(spark, orc_of(spark, sf_dir, "nation"), ["n_name", "n_nationkey"]), out, "csv", mode="overwrite")
    return spark.read.schema("n_nationkey int, n_name string").option("header", True).csv(out)


@query("SELECT p_partkey, p_mark FROM (SELECT *, nullif(p_size % 7, 0) AS p_mark FROM part)")
def export_json(spark, sf_dir):
    out = f"{work_dir(spark)}/export-json-{abs(hash(sf_dir))}"
    export.write(scan(spark, _part(spark, sf_dir), ["p_partkey", "p_mark"]), out, "json", mode="overwrite")
    return spark.read.schema("p_partkey bigint, p_mark int").json(out)


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 25")
def export_limit(spark, sf_dir):
    """The export of the command line with two columns and a limit."""
    file = OrcFile(paths_of(spark, _orders(spark, sf_dir, "striped"))[0])
    head, *rows = [x.split(",") for x in export.lines(file, "csv", ["o_orderkey", "o_orderpriority"], limit=25, batch_size=10)]
    return spark.createDataFrame([(int(a), b) for a, b in rows], f"{head[0]} bigint, {head[1]} string")


# the command line, its output read back


def _said(spark, path: str, *args: str) -> list[str]:
    """What the command line says of the first file."""
    from .. import cli

    out: list[str] = []
    file = paths_of(spark, path)[0]
    if cli.main([a if a != "FILE" else file for a in args], out.append):
        raise RuntimeError(f"the command line failed: {args}")
    return out


def _told(spark, path: str, schema: str, read: Callable[[list[str]], list[tuple]], *args: str) -> DataFrame:
    """path, and the columns of schema that read makes of what the command line says of each file; it runs where the file is read."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        from .. import cli

        for batch in batches:
            for file in batch.column(0).to_pylist():
                out: list[str] = []
                if cli.main([a if a != "FILE" else file for a in args], out.append):
                    raise RuntimeError(f"the command line failed: {args}")
                rows = read(out)
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows), pa.string()), *(pa.array([r[k] for r in rows]) for k in range(len(names)))], names=["path", *names])

    return listed(spark, path, "*").where("length > 0").select("path").mapInArrow(run, f"path string, {schema}")


@query("SELECT count(*) AS n, count(*) AS in_stripes, true AS several FROM orders")
def cli_info(spark, sf_dir):
    def read(out):
        lines = [x.strip() for x in out]
        rows = [int(x.removeprefix("rows: ")) for x in lines if x.startswith("rows: ")]
        return [(next(int(x.removeprefix("Rows: ")) for x in lines if x.startswith("Rows: ")), sum(rows), len(rows))]

    files = _told(spark, _orders(spark, sf_dir, "striped"), "n bigint, in_stripes bigint, stripes bigint", read, "info", "-v", "FILE")
    return files.agg(F.sum("n").alias("n"), F.sum("in_stripes").alias("in_stripes"), (F.sum("stripes") > 1).alias("several"))


@query("""SELECT 'Data type' AS name, 'Integer' AS value UNION ALL SELECT 'Minimum', min(o_orderkey)::VARCHAR FROM orders UNION ALL SELECT 'Maximum', max(o_orderkey)::VARCHAR FROM orders
UNION ALL SELECT 'Sum', sum(o_orderkey)::VARCHAR FROM orders UNION ALL SELECT 'Num values', count(o_orderkey)::VARCHAR FROM orders UNION ALL SELECT 'Has nulls', 'false'""")
def cli_stats(spark, sf_dir):
    def read(lines):
        own = lines[lines.index("## Column 1") + 1 :]
        return [tuple(x.removeprefix("* ").replace("Data type ", "Data type: ").split(": ")) for x in own[: own.index("")]]

    number = F.col("value").try_cast("decimal(28,0)")
    how = {"Minimum": F.min(number), "Maximum": F.max(number), "Sum": F.sum(number), "Num values": F.sum(number)}
    merged = F.max("value")  # the type, and true of nulls where a file has any
    for name, f in how.items():
        merged = F.when(F.col("name") == name, f.cast("string")).otherwise(merged)
    return _told(spark, _orders(spark, sf_dir), "name string, value string", read, "stats", "FILE").groupBy("name").agg(merged.alias("value"))


@query("SELECT count(*) AS n, (SELECT count(DISTINCT o_orderpriority) FROM orders)::BIGINT AS dictionary_size, (SELECT count(*) FROM (DESCRIBE orders)) + 1 AS n_columns FROM orders")
def cli_layout(spark, sf_dir):
    column = first_schema(spark, _orders(spark, sf_dir)).child("o_orderpriority").id

    def read(lines):
        stripes = json.loads("\n".join(lines))["stripes"]
        return [(sum(x["rows"] for x in stripes), max(x["encodings"][column]["dictionary_size"] for x in stripes), len(stripes[0]["encodings"]))]

    files = _told(spark, _orders(spark, sf_dir), "n bigint, dictionary_size bigint, n_columns bigint", read, "layout", "FILE")
    return files.groupBy("n_columns").agg(F.sum("n").alias("n"), F.max("dictionary_size").alias("dictionary_size")).select("n", "dictionary_size", "n_columns")


@query(_GROUPS.replace("SELECT o_orderkey, o_totalprice FROM g", "SELECT grp::BIGINT AS row_group, (grp * 1000)::BIGINT AS low, (grp * 1000 + count(*))::BIGINT AS high, count(*) AS n_values, min(o_orderkey) AS min, max(o_orderkey) AS max FROM g") + "true GROUP BY grp")
def cli_index(spark, sf_dir):
    stripe, group = re.compile(r"Stripe \d+: .* total_rows=(\d+)"), re.compile(r"  Row group \d+ rows \[(\d+),(\d+)\) -> values=(\d+), min=(\d+), max=(\d+)")

    def read(lines):
        found, first, rows = [], 0, 0
        for x in lines:
            if m := stripe.fullmatch(x):
                first, rows = first + rows, int(m[1])
            elif m := group.fullmatch(x):
                low, high, *rest = map(int, m.groups())
                found.append((first + low, high - low, *rest))
        return found

    path = _orders(spark, sf_dir)
    groups = _told(spark, path, "first_row bigint, n bigint, n_values bigint, min bigint, max bigint", read, "index", "FILE", "o_orderkey")
    return _placed(spark, path, groups).select("row_group", F.col("first_row").alias("low"), (F.col("first_row") + F.col("n")).alias("high"), "n_values", "min", "max")


@query(_SCATTERED + "SELECT grp::BIGINT AS row_group, bool_or(o_orderkey = 4321) AS might_contain FROM g GROUP BY grp")
def cli_bloom(spark, sf_dir):
    pattern = re.compile(r"    Row group \d+: .* might_contain\(\"4321\"\) = (true|false)")

    def read(lines):
        found = [m[1] == "true" for x in lines if (m := pattern.fullmatch(x))]
        return [(1000 * k, x) for k, x in enumerate(found)]  # groups of 1000 rows, whatever their stripe

    path = _scattered(spark, sf_dir)
    return _placed(spark, path, _told(spark, path, "first_row bigint, might_contain boolean", read, "bloom", "FILE", "-c", "o_orderkey", "-t", "4321")).select("row_group", "might_contain")


@query("SELECT p_partkey, p_mark FROM (SELECT p_partkey, nullif(p_size % 7, 0) AS p_mark FROM part ORDER BY p_partkey LIMIT 40)")
def cli_export_json(spark, sf_dir):
    rows = map(json.loads, _said(spark, _part(spark, sf_dir), "export", "-f", "json", "-c", "p_partkey,p_mark", "-n", "40", "--batch-size", "7", "FILE"))
    return spark.createDataFrame([(r["p_partkey"], r.get("p_mark")) for r in rows], "p_partkey bigint, p_mark int")


@query(f"SELECT '{pyspark.__version__}' AS written_by, '0.12' AS version, 1::BIGINT AS n_stripes, (SELECT count(*) FROM (DESCRIBE nation)) + 1 AS n_lines")
def file_user_metadata(spark, sf_dir):
    """What Spark's writer leaves in a file, its version, and a line of schema for the root and each column."""
    df = metadata(spark, orc_of(spark, sf_dir, "nation", "indexed", "n_nationkey"), "files")
    return df.select(F.get_json_object("user_metadata", "$['org.apache.spark.version']").alias("written_by"), "version", "n_stripes", F.size(F.split("schema", "\n")).cast("bigint").alias("n_lines"))


@query("SELECT event_id, user_id FROM events WHERE event_id < 1000")
def orc_stream(spark, sf_dir):
    from ..streaming.orc_stream import stream

    path = orc_of(spark, sf_dir, "events", "indexed", "event_id")
    name = f"orc_stream_{abs(hash(path))}"
    q = stream(spark, path, predicate=P.lt("event_id", 1000)).select("event_id", "user_id").writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
