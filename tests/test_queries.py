"""Every registered query of the library against its SQL, and the entry point without the corpus operators."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from stripewise.plans import layouts, registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def values(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    cell = lambda v: "null" if v is None or v is pd.NaT or v != v else str(float(v)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)
    return sorted("|".join(map(cell, r)) for r in df.astype(object).where(df.notna(), None).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, duck, name):
    got = registry.queries()[name](spark, sf).toPandas()
    if name in registry.oracle_sql():
        want = duck.sql(registry.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert values(got) == values(want)
    else:
        assert len(got)


@pytest.mark.parametrize(("name", "rows"), [*((n, 3000) for n in sorted(registry.oracle_sql())), *((n, 1000) for n in ("bloom_might_contain", "cli_bloom", "cli_index", "orc_row_index", "pred_nan", "row_group_stats", "rowsel_and_then", "rowsel_from_filters", "rowsel_skip_all", "ts_decimal"))])
def test_query_over_several_files_and_stripes(spark, monkeypatch, name, rows):
    """The same where tables take several files (few, and more than the driver plans for) of several stripes."""
    sf = "/root/testdata/sf0.01"
    small = {"stripe_bytes": 4 << 10, "check_rows": 1000}
    monkeypatch.setattr(layouts, "_MADE", _SEVERAL.setdefault(rows, {}))
    monkeypatch.setattr(layouts, "LAYOUTS", {k: (f, (o if "stripe_bytes" in o or "stripe_rows" in o else o | small) | {"file_rows": rows if "stride" in o else 10_000} if "file_rows" in o else o) for k, (f, o) in layouts.LAYOUTS.items()})
    got = registry.queries()[name](spark, sf).toPandas()
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = c.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and values(got) == values(want)


_SEVERAL: dict[int, dict] = {}


def test_entry(spark, sf):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_library_does_not_need_the_corpus_operators(tmp_path):
    root = Path(__file__).resolve().parent.parent
    import shutil

    shutil.copytree(root / "stripewise", tmp_path / "stripewise", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q)); assert 'orc_scan_full' in q and not any(x.startswith('op') and x[2].isdigit() for x in q)"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
