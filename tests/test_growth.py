"""What a query moves and works out over larger tables: figures of plans, and results that must stay the same."""

import re
import tracemalloc

import duckdb
import numpy
import pyarrow
import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import assembly, cleaning, layout, retrieval, structure
from lectern.plans import catalog, layouts, strings  # noqa: F401 - they register their queries
from lectern.sources import tables


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_sections_are_cut_once(spark):
    pages = spark.createDataFrame([("b", i, f"Unit {i}: X\nOne two three. Four five six.\nSeven eight.") for i in range(1, 6)] + [("b", 6, None), ("b", 7, "and nine. Ten eleven twelve.")], "book string, page long, text string")
    books = pages.select("book").distinct().select("book", *[F.lit("x").alias(c) for c in assembly.META])
    confidence = pages.select("book", "page", F.col("page").cast("double").alias("confidence"))
    made = assembly.assemble(assembly.curriculum(cleaning.page_lines(pages)), structure.page_map(pages.withColumn("anchor", F.lit(None).cast("int"))), confidence, books, 4, 6, 8, 12)
    # the search text alone is left to Python when the chunks are read
    assert len(re.findall(r"\+- ArrowEvalPython|:- ArrowEvalPython", plan(made))) == 1
    last = [tuple(r) for r in made.where("unit = 'Unit 5' and kind = 'child'").orderBy("seq").select("text_clean", "pdf_page_start", "pdf_page_end", "ocr_confidence").collect()]
    assert last == [("One two three. Four five six.", 5, 5, 5.0), ("Four five six. Seven eight.", 5, 5, 5.0), ("Seven eight. and nine.", 5, 7, 6.0), ("and nine. Ten eleven twelve.", 7, 7, 7.0)]


@pytest.mark.parametrize("name", ["calibration_sweep", "calibrate_threshold", "eval_metrics", "eval_per_category"])
def test_halves_of_a_hundredth(spark, tmp_path, name):
    docs = [(k, "x", 25 * k) for k in range(210)]
    spark.createDataFrame(docs, "doc_id long, text string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = catalog.QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in got.columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_scores_are_worked_out_once(spark):
    d = spark.createDataFrame([("a b",)], "text string").repartition(2)
    made = plan(d.select(T.compare_quality(T.quality_score(F.col("text")), T.quality_score(F.upper("text")), F.lit(50.0)).alias("m")))
    # the words of each of the two texts
    assert made.count("regexp_extract_all(") == 2


@pytest.mark.parametrize("name", ["merge_regions", "line_regions", "banded_lines", "region_texts", "band_paragraphs"])
def test_words_stay_with_their_page(spark, name):
    made = plan(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))
    # counts of regions a page may be dealt out, words and texts may not
    assert made.count("Exchange") == (name == "region_texts") and "collect_list" not in made
    assert "Join" not in made


def test_word_rows_and_arrays_give_the_same(spark):
    rows = [(1, 3, 0, 0, 1, 5, 9, 3, 2, "50", "c"), (1, 0, 1, 0, 0, 0, 0, 4, 2, "10", " a "), (1, 1, 1, 0, 0, 4, 1, 4, 2, "x", "b"), (1, 2, 1, 0, 0, 9, 1, 4, 2, "30", "  "), (2, 0, None, 0, 0, 1, 2, 3, 4, None, "z")]
    words = spark.createDataFrame(rows, "page long, pos int, block_num int, par_num int, line_num int, left int, top int, width int, height int, conf string, text string")
    got = [tuple(r) for r in layout.line_regions(words).orderBy("page", "ordinal").collect()]
    assert got == [(1, 0, "a b", 0, 0, 8, 3, 10.0), (1, 1, "c", 5, 9, 3, 2, 50.0), (2, 0, "z", 1, 2, 3, 4, 0.0)]
    bands = layout.banded_lines(words, spark.createDataFrame([(1, 10), (2, 4)], "page long, height int"))
    assert [tuple(r) for r in bands.orderBy("page", "ordinal").collect()] == [(1, "body", 0, 1, 0, "b"), (1, "body", 1, 0, 0, "c"), (2, "body", 0, None, 0, "z")]
    assert [tuple(r) for r in layout.band_paragraphs(bands).orderBy("page").collect()][-1] == (2, 1, "z")


def test_only_postings_asked_for_are_stored(spark, monkeypatch):
    kept, real = [], tables.stored
    monkeypatch.setattr(tables, "stored", lambda df, name: kept.append(real(df, name)) or kept[-1])
    texts = spark.createDataFrame([(1, "a b b c"), (2, "c d"), (3, ""), (4, None)], "id long, text string")
    got = retrieval.bm25_topk(texts, spark.createDataFrame([(0, "B x")], "q long, text string")).collect()
    assert [(r["q"], r["id"]) for r in got] == [(0, 1)]
    assert sorted((r["term"], r["id"], r["tf"], r["dl"]) for r in kept[0].collect()) == [("", 1, 1, 4), ("", 2, 1, 2), ("", 3, 1, 0), ("", 4, 1, 0), ("b", 1, 2, 4)]


def test_lists_of_a_trace_are_made_once(spark):
    assert "MapInArrow" not in plan(catalog.QUERIES["retrieval_trace"](spark, "/root/testdata/sf0.001"))


def test_tokens_are_counted_before_the_join(spark):
    made = plan(catalog.QUERIES["gate_context"](spark, "/root/testdata/sf0.001"))
    assert made.index("length(") > made.index("Join ")


def test_distances_are_held_in_parts():
    rng = numpy.random.default_rng(0)
    queries, rows = rng.normal(size=(4096, 8)), rng.normal(size=(1024, 8))
    batch = pyarrow.RecordBatch.from_arrays([pyarrow.array(range(1024)), pyarrow.array(rows.tolist())], ["vec_id", "embedding"])
    tracemalloc.start()
    got = pyarrow.Table.from_batches(retrieval._nearest(numpy.arange(4096), queries, None, 5, "l2", pyarrow.int64())([batch]))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 50
    want = numpy.sort(numpy.sqrt(((queries[:, None] - rows[None]) ** 2).sum(2)), axis=1)[:, :5]
    assert numpy.allclose(numpy.array(got["distance"]).reshape(4096, 5), want, atol=1e-6)


def test_lines_are_dealt_no_more_once_listed(spark):
    made = plan(catalog.QUERIES["clean_pages"](spark, "/root/testdata/sf0.001"))
    # neither windows over lines nor lists of parts and blocks
    assert "Window" not in made and made.count("collect_list(struct(") <= 4
    pages = spark.createDataFrame([("b", 1, "a-\nb\n\na\n\n|x|\n|y|\nUnit 1\nz"), ("b", 2, None)], "book string, page long, text string")
    got = {r["page"]: (r["clean_text"], r["removed"], r["printed"]) for r in cleaning.clean_pages(pages).collect()}
    assert got == {1: ("ab\n\na\n\n|x|\n|y|\nUnit 1\nz", 0, None), 2: ("", 0, None)}


def test_slugs_are_worked_out_once(spark):
    d = spark.createDataFrame([("a b",)], "text string").repartition(2)
    assert plan(d.select(T.slug(F.col("text")).alias("s"))).count("regexp_replace(") == 1
