"""The engine's own operators: literals, edge cases, and parity with SQL."""

import pandas
import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import chunking, cleaning, evaluation, retrieval, structure
from lectern.plans import catalog
from lectern.sources import tables

SF = "/root/testdata/sf0.001"


def values(spark, column, inputs):
    rows = spark.createDataFrame(list(enumerate(inputs)), "i int, x string")
    return [r.v for r in rows.select("i", column(F.col("x")).alias("v")).orderBy("i").collect()]


def test_text_functions(spark):
    assert values(spark, T.norm_line, ["  A \t b ", ""]) == ["a b", ""]
    assert values(spark, T.word_count, ["don't stop", "", "a-b c_d"]) == [2, 0, 3]
    assert values(spark, T.slug, ["Hello, World!", "!!"]) == ["hello_world", "x"]
    assert values(spark, T.sentences, ["One. Two! Three", " "]) == [["One.", "Two!", "Three"], []]
    assert values(spark, T.is_noise, ["***", "ab", "a*******", ""]) == [True, False, True, False]
    assert values(spark, T.is_pure_number, ["12", "12345", "XIV", "mix it"]) == [True, False, True, False]
    assert values(spark, T.heading_level, ["Unit 3: Birds", "Lesson 2", "Topic: Nests", "Exercise 1", "Some Title Here", "a plain sentence."]) == ["unit", "chapter", "topic", "exercise", "heading", None]
    assert values(spark, T.query_language, ["kya hai", "where is the nest", "the na nest", "ن"]) == ["roman_urdu", "english", "roman_urdu", "urdu"]
    assert values(spark, lambda x: T.truncate(x, 8), ["short", "a longer text"]) == ["short", "a lon..."]
    assert values(spark, T.estimate_tokens, ["", "x" * 40]) == [1, 10]
    assert values(spark, T.strip_markdown, ["**a** _b_ `c`"]) == ["a b c"]
    assert values(spark, T.json_response, ['{"message":{"content":"a"}}', '{"choices":[{"message":{"content":"b"}}]}', '{"content":"c"}', "{}"]) == ["a", "b", "c", ""]
    assert values(spark, lambda x: T.format_duration(x.cast("long")), ["3723", "0", "-4", "60"]) == ["1h 2m 3s", "0s", "0s", "1m"]
    found = {k: values(spark, lambda x, c=k: T.inferred_filters(x)[c], ["grade 5 Science unit 3", "lesson 4 of the green book"]) for k in ("grade", "unit", "chapter", "topic", "subject")}
    assert found == {"grade": ["5", None], "unit": ["Unit 3", None], "chapter": [None, "Lesson 4"], "topic": [None, None], "subject": ["Science", None]}
    assert values(spark, lambda x: T.inferred_filters(x, ["Red", "Green Book", "Book"])["book"], ["lesson 4 of the green book", "none"]) == ["Green Book", None]


def test_cleaning(spark):
    pages = spark.createDataFrame([("b", i, f"Running head\nhard wrapped in-\nside {'abcde'[i]}\n***\n{i}") for i in range(5)] + [("c", 9, None)], "book string, page long, text string")
    assert [(r.book, r.norm, r.hits) for r in cleaning.edge_artifacts(pages).collect() if r.norm == "running head"] == [("b", "running head", 5)]
    assert {r.norm for r in cleaning.repeated_lines(pages).collect()} == {"running head", "hard wrapped in-", "***"}
    got = {r.page: (r.clean_text, r.removed) for r in cleaning.clean_pages(pages.where("page < 2")).collect()}
    # the page number counts as an artifact too
    assert got[0] == ("side a", 4)
    assert cleaning.clean_pages(pages.where("book = 'c'")).first().clean_text == ""
    assert cleaning.clean_pages(pages.limit(0)).collect() == []


def test_structure(spark):
    pages = spark.createDataFrame([("b", i, {3: 1, 6: 10}.get(i)) for i in range(1, 9)], "book string, page int, anchor int")
    assert [r.printed for r in structure.page_map(pages).orderBy("page").collect()] == [-1, 0, 1, 2, 3, 10, 11, 12]
    lines = spark.createDataFrame([("b", 1, i, x) for i, x in enumerate(["intro text.", "Unit 1: Birds", "chapter 2 nests", "prose here.", "Unit 2: Fish", "more."])], "book string, page int, line_no int, line string")
    got = structure.sections(lines).orderBy("line_no").collect()
    assert [r.section for r in got] == [0, 1, 2, 2, 3, 3] and got[0].title == "Front matter"
    assert [r.chapter for r in got] == [None, None, "chapter 2 nests", "chapter 2 nests", None, None]


def plain_children(c, least, most, overlap):
    out, s = [], 0
    while s < len(c):
        e, w = s, 0
        while e < len(c) and (w == 0 or w + c[e] <= most):
            w += c[e]
            e += 1
        if w < least and e < len(c):
            w += c[e]
            e += 1
        out.append((s, e, w))
        if e >= len(c):
            break
        s = max(e - overlap, s + 1)
    return out


def test_child_chunks(spark):
    import random

    rng = random.Random(0)
    docs = [(i, [rng.randint(0, 50) for _ in range(rng.randint(0, 60))]) for i in range(80)]
    for overlap in (1, 3):
        got = chunking.child_chunks(spark.createDataFrame(docs, "doc_id long, counts array<int>"), 60, 120, overlap).collect()
        made = {}
        for r in sorted(got, key=lambda r: (r.doc_id, r.seq)):
            made.setdefault(r.doc_id, []).append((r.start, r.end, r.words))
        assert made == {i: plain_children(c, 60, 120, overlap) for i, c in docs if c}


def test_retrieval(spark):
    a, b = (spark.createDataFrame(x, "q long, id string, rank int") for x in ([(0, "a", 1), (0, "b", 2)], [(0, "b", 1), (0, "c", 2)]))
    fused = retrieval.fuse((a, 1), (b, 1)).orderBy("rank").collect()
    assert [r.id for r in fused] == ["b", "a", "c"] and fused[0].score == pytest.approx(1 / 62 + 1 / 61, abs=1e-9)
    blocks = spark.createDataFrame([(0, i, 0.9 - i / 10, i, "x" * 100) for i in range(6)], "q long, id long, score double, rank int, text string")
    assert retrieval.gate(blocks, None, 5, 50).count() == 2 and retrieval.gate(blocks, None, 5, 1).count() == 1 and retrieval.gate(blocks, 0.95).count() == 0
    vectors = spark.createDataFrame([(i, [float(i % 3), float(i)]) for i in range(30)], "vec_id long, embedding array<float>")
    got = retrieval.vector_topk(vectors, spark.createDataFrame([(5, [2.0, 5.0])], "q long, embedding array<float>"), 3).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [5, 4, 6] and got[0].distance == 0
    assert retrieval.vector_topk(vectors, vectors.limit(0).withColumnRenamed("vec_id", "q")).collect() == []
    texts = spark.createDataFrame([(1, "the nest of a bird"), (2, "a river"), (3, None)], "id long, text string")
    assert [r.id for r in retrieval.bm25_topk(texts, spark.createDataFrame([(0, "Nests nest")], "q long, text string")).collect()] == [1]


def test_evaluation(spark):
    rows = [("answerable", "answer", 0.9, False, True, True, False), ("ocr_typo", "answer", 0.4, False, True, False, False), ("unrelated", "decline", 0.5, False, False, True, True), ("unrelated", "decline", 0.1, True, True, False, False)]
    results = spark.createDataFrame(rows, "category string, expected string, top_score double, declined boolean, correct boolean, grounded boolean, watermark_leak boolean")
    m = evaluation.metrics(results).first()
    assert (m.total, m.hit_rate, m.decline_accuracy, m.false_decline_rate, m.overall_accuracy) == (4, 1.0, 0.5, 0.0, 0.75)
    assert (m.groundedness, m.watermark_leak_rate) == (0.5, 0.25)
    assert evaluation.metrics(results.limit(0)).first().hit_rate is None
    c = evaluation.calibrate(results).first()
    assert (c.threshold, c.accuracy, c.false_declines) == (0.4, 0.75, 0)


def test_sources(spark, tmp_path):
    (tmp_path / "book").mkdir()
    (tmp_path / "book" / "page_0007.txt").write_text(" seven \n")
    (tmp_path / "book" / "page_0008.txt").write_text("  \n")
    assert [tuple(r) for r in tables.read_page_texts(spark, str(tmp_path)).collect()] == [("book", 7, "seven")]
    (tmp_path / "good.json").write_text('{"id":"1","category":"unrelated","question":"q","expected":"decline"}\n')
    assert tables.read_eval_set(spark, str(tmp_path / "good.json")).count() == 1
    (tmp_path / "bad.json").write_text('{"id":"1","category":"other","question":"q","expected":"decline"}\n')
    with pytest.raises(Exception, match="line 1: unknown category other"):
        tables.read_eval_set(spark, str(tmp_path / "bad.json")).collect()


def test_stream(spark):
    from lectern.streaming.pages import stream_clean

    query = stream_clean(spark, f"{SF}/documents.parquet*", "doc_id long, text string").writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("cleaned").count() == spark.read.parquet(f"{SF}/documents.parquet").count()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "embeddings", "conversations", "pages", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_sql_parity(spark, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLE_SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)

    def plain(df):
        show = lambda v: "None" if pandas.isna(v) else repr(round(float(v), 6)) if hasattr(v, "dtype") or isinstance(v, int | float) else repr(v)
        return sorted(tuple(show(v) for v in row) for row in df[columns].astype(object).values.tolist())

    assert plain(ours) == plain(theirs)
