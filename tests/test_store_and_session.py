"""Store, searches with filters, whole question sessions, answers and evaluation on a small book."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import prompts
from lectern.operators import assembly, cleaning, evaluation, retrieval, session, structure
from lectern.operators.store import CHILD_COLUMNS, Store, predicate, resolve

LINES = [
    "Unit 1: Birds\nChapter 2 - Nests\nBirds build nests in trees. They use twigs and grass.\n4",
    "Unit 1: Birds\nTopic: Eggs\nThe eggs are warm. Parents sit on the eggs for days.\nLicense stamp",
    "Unit 02\nWater is a liquid. Rivers carry water to the sea.",
]


@pytest.fixture(scope="module")
def chunks(spark):
    pages = spark.createDataFrame([("b", i + 1, t) for i, t in enumerate(LINES)], "book string, page long, text string")
    page_map = structure.page_map(pages.withColumn("anchor", structure.find_page_number(F.col("text"))))
    books = spark.createDataFrame([("b", "board", "5", "Science", "1", "english")], "book string, " + ", ".join(f"{c} string" for c in assembly.META))
    parsed = assembly.curriculum(cleaning.page_lines(pages), ["license"])
    conf = spark.createDataFrame([("b", 1, 90.0), ("b", 3, 50.0)], "book string, page long, confidence double")
    return assembly.assemble(parsed, page_map, conf, books, 4, 8, 10, 16, version="v1").cache()


@pytest.fixture(scope="module")
def store(spark, chunks, tmp_path_factory):
    made = Store.create(spark, "file://" + str(tmp_path_factory.mktemp("store")))
    parents, children = assembly.split_kinds(chunks)
    made.add_parents(parents)
    vectors = children.select("chunk_id", F.when(F.col("unit") == "Unit 1", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("vector"))
    made.add_children(children, vectors)
    made.build_indexes()
    return made


def test_chunks_have_text_pages_and_ids(chunks):
    rows = chunks.where("kind = 'child'").orderBy("pdf_page_start", "seq").collect()
    assert [r["text_clean"] for r in rows][:2] == ["Birds build nests in trees.", "They use twigs and grass."] or rows[0]["text_clean"].startswith("Birds build nests")
    first = rows[0]
    assert (first["unit"], first["chapter"], first["topic"], first["page_start"], first["pdf_page_start"]) == ("Unit 1", "Chapter 2", "", 4, 1)
    assert first["embed_text"].startswith("Unit: Unit 1 · Chapter: Chapter 2 — Birds")
    assert first["parent_id"] == "unit_01_chapter_02_parent_000"
    eggs = [r for r in rows if r["topic"] == "Eggs"]
    assert eggs and {(r["chapter"], r["page_start"], r["ocr_confidence"]) for r in eggs} == {("Chapter 2", 5, 0.0)}
    water = [r for r in rows if r["unit"] == "Unit 2"]
    assert water and water[0]["chapter"] == "" and water[0]["parent_id"].startswith("unit_02_parent_")
    assert not any("License" in r["text_clean"] for r in rows)
    parents = {r["parent_id"]: r["text_clean"] for r in chunks.where("kind = 'parent'").collect()}
    for p, text in parents.items():
        mine = sorted((r["seq"], r["text_clean"]) for r in rows if r["parent_id"] == p)
        assert text == "\n".join(t for _, t in mine)


def test_store_rules(spark, store, chunks, tmp_path):
    assert set(store.table("children").columns) == set(CHILD_COLUMNS)
    assert store.stats()["children"] == chunks.where("kind = 'child'").count()
    assert Store.is_valid(spark, store.path) and resolve(spark, None, ["file:///none", store.path]) == store.path
    assert resolve(spark, "here", []) == "here"
    empty = Store.create(spark, f"file://{tmp_path}/s")
    assert empty.stats() == {"parents": 0, "children": 0}
    with pytest.raises(FileNotFoundError, match="children"):
        Store.open(spark, empty.path)
    with pytest.raises(RuntimeError, match="missing"):
        empty.build_indexes()
    children = assembly.split_kinds(chunks)[1]
    with pytest.raises(Exception, match="differ"):
        empty.add_children(children, children.limit(1).select("chunk_id", F.array(F.lit(1.0)).alias("vector")))
    vectors = children.select("chunk_id", F.array(F.lit(1.0)).alias("vector"))
    other = Store.create(spark, f"file://{tmp_path}/t")
    other.add_children(children, vectors)
    other.upsert_children(children.limit(2), vectors.join(children.limit(2).select("chunk_id"), "chunk_id"))
    assert other.stats()["children"] == children.count()
    assert store.weak_vectors().count() == 0 and store.sample(2).count() == 2
    other.reset()
    assert other.tables() == set()


def test_filters(spark, store):
    rows = store.table("children")
    assert rows.where(predicate(None)).count() == rows.count()
    assert rows.where(predicate({"unit": "Unit 2", "grade": 5})).count() == rows.where("unit = 'Unit 2'").count()
    assert rows.where(predicate({"unit": ["Unit 1", "Unit 2"]})).count() == rows.count()
    assert rows.where(predicate({"unit": "it's"})).count() == 0
    query = spark.createDataFrame([(1, "water sea", [1.0, 0.0])], "q long, text string, embedding array<double>")
    ids = {r["chunk_id"] for r in rows.where("unit = 'Unit 2'").collect()}
    assert {r["id"] for r in store.search_vector(query, {"unit": "Unit 2"}).collect()} == ids
    assert {r["id"] for r in store.search_text(query, {"unit": "Unit 2"}).collect()} <= ids
    assert store.search_text(query, {"unit": "Unit 1"}).count() == 0
    assert {r["id"] for r in store.hybrid(query, None, 3).collect()}


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_nearest_by_brute_force(spark, metric):
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 5)), 2)
    x[10:20] = x[0]
    rows = spark.createDataFrame([(f"n{i:03d}", v.tolist(), str(i % 3)) for i, v in enumerate(x)], "vec_id string, embedding array<double>, key string").repartition(3)
    asked = spark.createDataFrame([(i, x[i].tolist(), None if i else "1") for i in range(4)], "q long, embedding array<double>, key string")
    got = {}
    for r in retrieval.vector_topk(rows, asked, 7, metric, "key").orderBy("rank").collect():
        got.setdefault(r["q"], []).append((r["distance"], r["vec_id"]))
    for i in range(4):
        inner = x @ x[i]
        d = {"l2": np.sqrt(((x - x[i]) ** 2).sum(1)), "ip": -inner, "cosine": 1 - inner / np.sqrt((x**2).sum(1) * (x[i] ** 2).sum())}[metric]
        want = sorted((round(float(v), 6), f"n{k:03d}") for k, v in enumerate(d) if i or k % 3 == 1)[:7]
        assert [b for _, b in got[i]] == [b for _, b in want]
        assert np.allclose([a for a, _ in got[i]], [a for a, _ in want])


def test_session(spark, store):
    asked = spark.createDataFrame([(1, "Where do birds build nests?", [1.0, 0.0], "answerable", "answer"), (2, "lesson 9 water", [0.0, 1.0], "unrelated", "decline")], "q long, text string, embedding array<double>, category string, expected string")
    model = lambda prompts_: prompts_.where("q = 1").select("q", F.lit(" In trees (page 4). ").alias("reply"))
    answered, found = session.answer(store, asked, model=model)
    trace = {r["q"]: r for r in found.trace.collect()}
    # no chunk has chapter Lesson 9, so both searches run without the filter
    assert trace[2]["fallback"] and trace[2]["filters"] == "chapter = Lesson 9" and not trace[1]["fallback"]
    assert trace[1]["bm25_hits"] > 0 and trace[1]["gated"] >= 1
    top = found.blocks.where("q = 1 and place = 1").first()
    assert "nests" in top["child_text"] and top["parent_text"] and top["text"].startswith(top["child_text"])
    answered = {r["q"]: r for r in answered.collect()}
    assert answered[1]["answer"] == "In trees (page 4)." and not answered[1]["declined"] and answered[1]["sources"][0]["page_start"] == 4
    assert answered[2]["answer"] == prompts.LLM_ERROR and answered[2]["error"]
    results = session.evaluate(store, asked, session.Settings(threshold=0.9), model, ["trees"]).cache()
    rows = {r["q"]: r for r in results.collect()}
    assert rows[1]["top_score"] > 0 and rows[1]["declined"] and not rows[1]["correct"] and rows[2]["correct"] and rows[1]["watermark_leak"]
    assert evaluation.metrics(results).first()["decline_accuracy"] == 1.0
    assert {r["category"]: r["n"] for r in evaluation.by_category(results).collect()} == {c: int(c in ("answerable", "unrelated")) for c in evaluation.CATEGORIES}


def test_ask(store):
    text = session.ask(store, "Where do birds build nests?", [1.0, 0.0], model=lambda p: p.select("q", F.lit("Trees.").alias("reply")), debug=True)
    assert "verdict: success" in text and "Trees." in text and "  - page 4" in text
    assert session.ask(store, " ", [1.0, 0.0]) == prompts.NO_QUESTION


def test_running_heads_and_demoted_headings(spark):
    lines = spark.createDataFrame([("b", 1, i, x) for i, x in enumerate(["intro", "Unit 3", "text one", "Unit 03", "Part Of Plant", "Chapter iv", "more", "Unit 4", "Chapter iv", "end"])], "book string, page long, line_no int, line string")
    rows = assembly.curriculum(lines, ignored=["part of"]).orderBy("line_no").collect()
    got = [(r["line"], r["section"], r["unit"], r["chapter"]) for r in rows if r["level"] is None]
    assert got == [("intro", 0, "", ""), ("text one", 1, "Unit 3", ""), ("Part Of Plant", 1, "Unit 3", ""), ("more", 2, "Unit 3", "Chapter iv"), ("end", 4, "Unit 4", "Chapter iv")]
    assert rows[0]["section_title"] == "Front matter"


def test_tfidf_vectors(spark):
    texts = spark.createDataFrame([(1, "cat dog cat"), (2, "cat dog"), (3, "sun moon star"), (4, "")], "id long, text string")
    for grams in (None, (2, 4)):
        v = {r["id"]: r["embedding"] for r in retrieval.svd_vectors(texts, 2, 64, grams).collect()}
        near = lambda a, b, v=v: sum((x - y) ** 2 for x, y in zip(v[a], v[b], strict=True))
        assert near(1, 2) < near(1, 3) and len(v[4]) == 2
