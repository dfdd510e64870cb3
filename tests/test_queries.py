"""Every registered query with SQL equals DuckDB's answer on the same files."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry

FILES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("op")}


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}".replace("-0.000000", "0.000000")
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return f"{v}.000000"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(list(v)) if isinstance(v, (list, tuple)) else str(v)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for f in FILES:
        con.execute(f"create view {f} as select * from '{sf_dir}/{f}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(ORACLES[name])
    want = table([d[0] for d in cursor.description], cursor.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(k for k in entry.queries() if k not in entry.oracle_sql() and not k.startswith("op") and k != "pipeline"))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert len(entry.queries()[name](spark, sf_dir).columns) > 0
    assert entry.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name, table, row, key", [("x2_repair_mojibake", "segments", ["asset_id", "seq"], ["asset_id", "seq"]), ("a9_audio_features", "events", ["user_id"], ["asset_id"]), ("a10_pitch_features", "events", ["user_id"], ["asset_id"])])
def test_no_row_of_the_table_is_left_out(spark, sf_dir, name, table, row, key):
    from touchline import fixtures

    rows = fixtures.table(spark, sf_dir, table).select(*row).collect()
    found = entry.queries()[name](spark, sf_dir).select(*key).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, rows))
