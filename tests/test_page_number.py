"""The printed page number of a page, and page maps that count on from it."""

import duckdb
import pytest

from lectern.operators import structure
from lectern.plans import catalog

PAGES = [
    ("Text here.\n\n42", 42),
    ("No numbers at the edges here.", None),
    ("\n".join(["a", "b", "c", "7", "d", "e", "f"]), None),
    ("\n \n a\n\t12 \nb", 12),
    ("1\n2\n3\n4\n5\n6\n7", 1),
    ("a\nb\nc\nd\n5\n6\n7", 5),
    ("12345\n0007", 7),
    ("7\r\ntext", 7),
    ("۴۲\ntext", 42),
    ("page 3\n3.\niv", None),
    ("", None),
    (None, None),
]


def test_find_page_number(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(PAGES)], "k int, text string")
    got = dict(map(tuple, rows.select("k", structure.find_page_number(F.col("text"))).collect()))
    assert got == {k: n for k, (_, n) in enumerate(PAGES)}


@pytest.mark.parametrize("name", ["printed_page_number", "page_map_printed"])
def test_queries_over_pages_with_numbers(spark, tmp_path, name):
    docs = [(k, t, "s" if k < 9 else "u") for k, (t, _) in enumerate(PAGES)] + [(1000, "x", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.execute(catalog.ORACLE_SQL[name]).fetchall(), key=str)
    got = sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect()), key=str)
    assert got == want and any(r[-1] is not None for r in got)
