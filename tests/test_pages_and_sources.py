"""Cleaning with protected structures, layout merging, sources and settings."""

import json
import random

import pytest

from lectern.operators import chunking, cleaning, layout
from lectern.sources import tables


def cleaned(spark, texts, **options):
    pages = spark.createDataFrame([("b", i, t) for i, t in enumerate(texts)], "book string, page long, text string")
    return {r["page"]: r for r in cleaning.clean_pages(pages, **options).collect()}


def test_paragraphs_tables_and_headings(spark):
    page = "Head\nChapter 1 Water\nRain falls and wa-\nter runs  down.\nIt stops.\n\nName  Age\nAnn   5\nBob | 6\n\n*** ---\nSAMPLE\nSAMPLE\nSAMPLE\nExercise 2\nExercise 2\nExercise 2\n12"
    got = cleaned(spark, [page, "Head\nother text here", "Head\r\nlast\r\rone", None], keywords=["Not for"])
    assert got[0]["clean_text"] == "Chapter 1 Water\nRain falls and water runs down. It stops.\n\nName  Age\nAnn   5\nBob | 6\n\nExercise 2\nExercise 2\nExercise 2"
    assert (got[0]["removed"], got[0]["printed"]) == (2, 12)
    assert got[1]["clean_text"] == "other text here" and got[2]["clean_text"] == "last\n\none" and got[3]["clean_text"] == ""


def test_stamps_and_tables(spark):
    rows = "\n".join(f"a{i}  b{i}" for i in range(13))
    stamp = "D O  N O T\nx  y\nz  w"
    got = cleaned(spark, [rows, stamp, "one  row\nprose here", "Downloaded by x on 2020-01-01\ntext"], keywords=["d o  n o t"], patterns=["downloaded by \\S+", "(bad"])
    # 12 rows make a table; the one left is prose
    assert got[0]["clean_text"] == "\n".join(f"a{i}  b{i}" for i in range(12)) + "\na12 b12"
    assert got[1]["clean_text"] == "x  y\nz  w" and got[2]["clean_text"] == "one row prose here" and got[3]["clean_text"] == "text"


def test_style(spark):
    spans = lambda text, size=10.0, color=0: [{"text": " ", "size": 50.0, "color": 1}, {"text": text, "size": size, "color": color}]
    rows = [("b", 1, 0.0, spans("body text line")), ("b", 1, 0.0, spans("another body line")), ("b", 1, 0.7, spans("turned")), ("b", 1, 0.0, spans("HUGE", 30.0)), ("b", 1, 0.0, spans("faint", 10.0, 0xF0F0F0))]
    lines = spark.createDataFrame(rows, "book string, page long, dir_y double, spans array<struct<text:string,size:double,color:int>>")
    assert sorted(r["norm"] for r in cleaning.styled_lines(lines).collect()) == ["faint", "huge", "turned"]


def test_merge_is_greedy_and_uses_a_block_once(spark):
    regions = spark.createDataFrame([(1, 0, 0, 0, 100, 20, "scan one"), (1, 1, 0, 20, 100, 20, "scan two"), (1, 2, 0, 300, 100, 20, "scan low"), (2, 0, 0, 0, 10, 10, "alone")], "page long, ordinal long, x long, y long, w long, h long, text string")
    blocks = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.5, 0.2, "the layer has this"), (1, 1, 0.0, 0.9, 0.5, 1.0, "left over block here"), (1, 2, 0.0, 0.7, 0.5, 0.8, "too short"), (3, 0, 0.0, 0.0, 1.0, 1.0, "only a layer block")], "page long, ordinal long, x0 double, y0 double, x1 double, y1 double, text string")
    sizes = spark.createDataFrame([(1, 200.0, 400.0), (2, 10.0, 10.0), (3, 10.0, 10.0)], "page long, width double, height double")
    got = {r["page"]: r["text"] for r in layout.merge_best(regions, blocks, sizes).collect()}
    assert got == {1: "the layer has this\nscan two\nscan low\nleft over block here", 2: "alone", 3: "only a layer block"}


def test_chunk_walks_by_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        counts = [rng.randint(0, 30) for _ in range(rng.randint(1, 25))]
        for make, options in ((chunking._child_step, (20, 40, 1)), (chunking._topic_step, (20, 40, 1)), (chunking._share_step, (30, 50, 0.2))):
            spans = chunking._walk(counts, make(counts, *options))
            assert spans[0]["start"] == 0 and spans[-1]["end"] == len(counts)
            for a, b in zip(spans, spans[1:], strict=False):
                assert a["start"] < b["start"] <= a["end"] <= b["end"]
            assert all(s["words"] == sum(counts[s["start"] : s["end"]]) == s["w1"] - s["w0"] for s in spans)
        tails = chunking._tail_spans(counts, 40, 0.2)
        assert tails[-1]["end"] == len(counts) and all(s["words"] >= 40 for s in tails[:-1])


def test_sources(spark, tmp_path):
    folder = tmp_path / "pdf"
    (folder / "sub").mkdir(parents=True)
    (folder / "b.pdf").write_bytes(b"2")
    (folder / "sub" / "a.PDF").write_bytes(b"1")
    (folder / "x.txt").write_text("no")
    assert [r["book"] for r in tables.read_pdfs(spark, str(folder)).collect()] == ["b", "a"]
    with pytest.raises(ValueError, match="not a PDF"):
        tables.read_pdfs(spark, str(folder / "x.txt"))
    with pytest.raises(ValueError, match="several"):
        tables.only_pdf(spark, str(folder))
    assert tables.only_pdf(spark, str(folder / "sub")).endswith("a.PDF")
    pages = spark.createDataFrame([("raw", "b", 1, "one\n\ntwo"), ("clean", "b", 1, "one two"), ("raw", "b", 2, None)], "kind string, book string, page int, text string")
    tables.write_page_records(pages, f"{tmp_path}/pages")
    assert sorted(tuple(r) for r in tables.read_page_records(spark, f"{tmp_path}/pages").collect()) == [("clean", "b", 1, "one two"), ("raw", "b", 1, "one\n\ntwo"), ("raw", "b", 2, "")]
    assert (tmp_path / "pages/kind=raw/book=b/file=page_0001").is_dir()
    assert tables.write_manifest(pages.where("kind = 'raw'"), f"{tmp_path}/manifest") == 1
    assert [r["page"] for r in tables.page_dump(pages, "b", 2, 3).collect()] == [2]
    texts = tmp_path / "texts"
    texts.mkdir()
    (texts / "book_page_0002.txt").write_text("First one. " * 30 + "\n\nSecond part.")
    (texts / "book_page_0001.txt").write_text(" \n")
    got = tables.read_page_chunks(spark, str(texts)).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in got] == list(range(len(got))) and got[-1]["text"] == "Second part." and got[0]["page"] == 2 and got[0]["lang"] == "en"


def test_evaluation_sets_and_settings(spark, tmp_path):
    good = {"id": "1", "category": "unrelated", "question": "why", "expected": "decline"}
    path = tmp_path / "e.jsonl"
    path.write_text(json.dumps(good) + "\n\n" + json.dumps(good | {"id": "2"}))
    assert tables.read_eval_set(spark, str(path)).count() == 2
    for change, text in (({"category": "odd"}, "line 3: unknown category odd"), ({"question": ""}, "line 3: id and question"), ({"expected": "x"}, "line 3: expected")):
        path.write_text(json.dumps(good) + "\n\n" + json.dumps(good | change))
        with pytest.raises(Exception, match=text):
            tables.read_eval_set(spark, str(path)).collect()
    corpus = tmp_path / "c.json"
    corpus.write_text(json.dumps([{"page_content": "a", "metadata": {"k": "v"}}, {"page_content": "b", "metadata": {}}]))
    docs = tables.read_corpus(spark, str(corpus))
    assert sorted((r["page_content"], r["metadata"].get("k")) for r in docs.collect()) == [("a", "v"), ("b", None)]
    tables.write_corpus(docs, f"{tmp_path}/corpus")
    assert spark.read.json(f"{tmp_path}/corpus").count() == 2
    books = tmp_path / "books.json"
    books.write_text(json.dumps({"books": [{"book": "Green", "grade": 5}, {"book": "Red", "language": "urdu"}]}))
    assert [(r["book"], r["grade"], r["language"]) for r in tables.read_curriculum(spark, str(books)).orderBy("ordinal").collect()] == [("Green", "5", "english"), ("Red", "", "urdu")]
    settings = tmp_path / "s.yaml"
    settings.write_text("a: 1 # kept\n  relevance_threshold: 0.5\nrelevance_threshold: 0.6\n")
    assert tables.write_threshold(str(settings), 0.03) and settings.read_text() == "a: 1 # kept\n  relevance_threshold: 0.03   # calibrated\nrelevance_threshold: 0.6\n"
    assert not tables.write_threshold(f"{tmp_path}/none", 1)
