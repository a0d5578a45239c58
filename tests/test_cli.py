import io
import json
import sys

import pyarrow as pa
import pytest
from pyarrow import orc

from stripewise import cli


@pytest.fixture(scope="module")
def file(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("orc") / "c.orc")
    import datetime as dt
    from decimal import Decimal

    table = pa.table({"a": pa.array([1.0, 8.25, None], pa.float32()), "b": pa.array([True, False, None]), "s": ["x", 'q"u,o', None], "at": pa.array([dt.datetime(2019, 11, 5, 6, 7, 8, 90_000), dt.datetime(2016, 2, 29, 23, 58, 59, 123456), dt.datetime(2024, 10, 10)], pa.timestamp("ns")), "d": pa.array([dt.date(1999, 12, 31), None, dt.date(2024, 10, 10)]), "raw": [b"1", b"2", b"3"], "dec": pa.array([Decimal("1.50"), None, Decimal("2.00")], pa.decimal128(10, 2))})
    orc.write_table(table, path)
    return path


def run(*args):
    out = []
    return cli.main(list(args), out.append), out


def test_info(file):
    code, out = run("info", file)
    assert code == 0 and out[0] == f"File: {file}" and "Rows: 3" in out and "ROOT" in out and "  dec DECIMAL(10, 2)" in out and "  at TIMESTAMP" in out
    assert run("info", "-r", file, file)[1] == [f"{file}: 3"] * 2
    assert "---" in run("info", file, file)[1] and any("writer timezone" in x for x in run("info", "-v", file)[1])


def test_export_csv(file):
    assert run("export", file)[1] == ["a,b,s,at,d,dec", "1.0,true,x,2019-11-05T06:07:08.090,1999-12-31,1.50", '8.25,false,"q""u,o",2016-02-29T23:58:59.123456,,', ",,,2024-10-10T00:00:00,2024-10-10,2.00"]
    assert run("export", file, "-c", "s,a", "-n", "1")[1] == ["a,s", "1.0,x"]


def test_export_json(file, tmp_path):
    out = run("export", file, "-f", "json")[1]
    assert out[0] == '{"a":1.0,"b":true,"s":"x","at":"2019-11-05T06:07:08.090","d":"1999-12-31"}' and out[2] == '{"at":"2024-10-10T00:00:00","d":"2024-10-10"}'
    assert run("export", file, "-f", "json", "-o", str(tmp_path / "o"), "--batch-size", "1")[0] == 0
    assert (tmp_path / "o").read_text().splitlines() == out


def test_errors(file, capsys):
    assert run("export", file, "-c", "nope")[0] == 1
    assert "not found" in capsys.readouterr().err
    assert run("index", file, "nope")[0] == 1 and run("bloom", file, "-c", "nope")[0] == 1 and run("info", file + "x")[0] == 1 and run("export", file, "-n", "0")[0] == 1


def test_stdin(file, monkeypatch):
    monkeypatch.setattr(sys, "stdin", io.TextIOWrapper(io.BytesIO(open(file, "rb").read())))
    assert len(run("export", "-")[1]) == 4


def test_stats_layout_index_bloom(file, spark, tmp_path):
    out = run("stats", file)[1]
    assert "## Column 1" in out and "* Data type Double" in out and "* Minimum: 1" in out and "* True count: 1" in out and "* Minimum UTC: 2016-02-29 23:58:59.123" in out
    whole = json.loads("\n".join(run("layout", file)[1]))
    assert whole["rows"] == 3 and whole["stripes"][0]["streams"][0]["offset"] == 3
    assert run("bloom", file)[1][-1] == "No bloom filters found"
    from stripewise.sources.scan import paths_of
    from stripewise.sources.writer import write

    write(spark.range(2500), str(tmp_path / "i"), single_file=True, stride=1000, bloom_columns=["id"], sort_by=["id"])
    path = paths_of(spark, str(tmp_path / "i"))[0]
    assert run("index", path, "id")[1][3:] == ["Stripe 0: rows_per_group=1000 total_rows=2500", "  Row group 0 rows [0,1000) -> values=1000, min=0, max=999", "  Row group 1 rows [1000,2000) -> values=1000, min=1000, max=1999", "  Row group 2 rows [2000,2500) -> values=500, min=2000, max=2499"]
    assert run("bloom", path)[1][4].startswith("  Column 1 (id): 3 row groups")
    tested = run("bloom", path, "-c", "id", "-t", "1500")[1]
    assert tested[-2].endswith('might_contain("1500") = true') and sum(x.endswith("= true") for x in tested) <= 2
