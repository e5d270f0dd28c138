"""Slugs and answers are made of whole texts."""

import duckdb
import pytest

from lectern.plans import catalog


@pytest.mark.parametrize(("name", "want"), [("slug", "ab_" * 99 + "ab"), ("json_response", "Ab- " * 100)])
def test_whole_text(spark, tmp_path, name, want):
    docs = [(1, "Ab- " * 100), (2, "!?"), (3, None), (4, 'quo"te\\ \n\t é ' * 30)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = dict(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect()))
    assert got == dict(con.execute(catalog.ORACLE_SQL[name]).fetchall()) and got[1] == want
