import importlib.util

import pytest

import __spark_entry__ as entry

SMALLEST = "/root/testdata/sf0.001"


def test_names_agree_and_import_needs_no_session():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "p1_found" in entry.queries() and "p5_found" in entry.queries()


def test_nothing_in_the_core_imports_the_optional_subpackage():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "parcelwright"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "parcelwright.llm" not in path.read_text(), path


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) >= 0 and entry.entry(spark).columns == ["code", "overlap", "cx", "cy"]


@pytest.mark.skipif(importlib.util.find_spec("duckdb") is None, reason="needs duckdb")
@pytest.mark.parametrize("name", ["p1_found", "ring_measures", "nearest_stones", "box_overlaps", "latest_states", "session_headers"])
def test_queries_equal_their_oracle(spark, name):
    import glob
    import os

    import duckdb

    db = duckdb.connect()
    for file in glob.glob(f"{SMALLEST}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    got, want = entry.queries()[name](spark, SMALLEST), db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    plain = lambda v: round(float(v), 6) + 0.0 if isinstance(v, float) else v
    rows = lambda many: sorted((tuple(plain(v) for v in r) for r in many), key=str)
    assert rows(tuple(r) for r in got.select(*columns).collect()) == rows(want.fetchall())
