"""Operator 5: equal wordings meet, other texts don't, and the query equals SQL."""

import duckdb
import pytest

from touchline.llm import licenses


@pytest.fixture(scope="module")
def rows():
    mit = "Copyright (c) 2020 A. Person\nAll rights reserved.\n" + licenses.MIT.upper().replace("SUBLICENSE", "sub-licence").replace('"', "'")
    return [
        (1, mit), (1, mit), (2, None), (3, ""), (4, licenses.MIT + " And more."), (None, "  released under the  MIT licence!!  "),
        (5, "Some prose.\nLicensed under CC BY-NC 4.0.\nMore\nLicensed under CC BY-NC 4.0\n(c) 2001\nReleased under the MIT License."), (6, "license " * 20000),
        (7, "© 1999 X\n© 2000 Y\n" + licenses.ZLIB),
    ]


def test_rows(spark, rows):
    got = licenses.scan_licenses(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, digest string"))
    assert got.columns == ["doc_id", "digest", "license_id", "notice_ids", "n_notices"]
    got = got.collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].license_id == "MIT" and by[2].license_id is None and by[3].digest == by[2].digest and by[4].license_id is None
    assert by[None].license_id == "MIT" and by[None].n_notices == 1
    assert (by[5].license_id, by[5].notice_ids, by[5].n_notices) == (None, "CC-BY-NC-4.0,MIT", 3)
    assert by[6].n_notices == 0 and by[7].license_id == "Zlib"
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_native(spark, sf_dir):
    plan = licenses.scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "ExistingRDD" not in plan


def test_query_equals_sql(spark, sf_dir, rows):
    def both(df, source):
        con = duckdb.connect()
        con.register("documents", df.toPandas()) if source is None else con.execute(f"create view documents as select * from '{source}'")
        key = lambda r: tuple(map(str, r))
        got = sorted(map(tuple, licenses.scan_licenses(df).collect()), key=key)
        assert got == sorted(con.execute(licenses.sql()).fetchall(), key=key)

    both(spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{sf_dir}/documents.parquet")
    both(spark.createDataFrame([r for r in rows if r[0]], "doc_id long, text string"), None)
