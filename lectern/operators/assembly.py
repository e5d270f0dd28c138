"""From cleaned pages to sections, and from sections to child and parent chunks with text, pages and ids."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as T
from . import chunking
from .cleaning import is_stamp

LEVELS = ("unit", "chapter", "topic")
#: what a book's entry in the curriculum says about it
META = ("board", "grade", "subject", "edition", "language")


def curriculum(lines: DataFrame, keywords: list[str] = (), ignored: list[str] = ()) -> DataFrame:
    """book, page, line_no, line -> book, page, line_no, line, level, section, and the section's level, title, unit, chapter, topic with their numbers.

    Every heading begins a section; what comes before any is section 0, Front matter. A
    unit, chapter or topic that names the current one again is a running head and goes. A
    new unit clears chapter and topic, a new chapter the topic. Lines with a keyword go;
    headings with an ignored one are text.
    """
    held = lines.select("book", "page", "line_no", T.strip(F.col("line")).alias("line")).where("line <> ''").where(~is_stamp(F.col("line"), keywords))
    held = held.withColumn("h", L.heading(F.col("line")))
    held = held.withColumn("h", F.when(~is_stamp(F.coalesce(F.col("h.title"), F.lit("")), ignored), F.col("h")))
    held = held.withColumn("level", F.col("h.level")).withColumn("name", L.canonical(F.col("h.level"), F.col("h.number"), F.col("h.title")))
    order = ["page", "line_no"]
    upto = lambda *keys: Window.partitionBy("book", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    keys: list[str] = []
    for level in LEVELS:
        # a repeat never changes what is current, so the heading before tells
        same = F.lag("name").over(Window.partitionBy("book", *keys, "level").orderBy(*order)) == F.col("name")
        held = held.withColumn("echo", (F.col("level") == level) & F.coalesce(same, F.lit(False))).where("not coalesce(echo, false)").drop("echo")
        held = held.withColumn(f"{level}_seq", F.count(F.when(F.col("level") == level, 1)).over(upto()))
        keys.append(f"{level}_seq")
    held = held.withColumn("section", F.count("level").over(upto()))
    for n, level in enumerate(LEVELS):
        last = lambda x, n=n, level=level: F.coalesce(F.last(F.when(F.col("level") == level, x), True).over(upto(*keys[:n])), F.lit(""))
        held = held.withColumn(level, last(F.col("name"))).withColumn(f"{level}_no", last(F.col("h.number")))
    front = F.struct(F.lit("heading").alias("level"), F.lit("").alias("number"), F.lit("Front matter").alias("title"))
    held = held.withColumn("of", F.coalesce(F.last("h", True).over(upto()), front))
    return held.select("book", *order, "line", "level", "section", F.col("of.level").alias("section_level"), F.col("of.title").alias("section_title"), *[x for level in LEVELS for x in (level, f"{level}_no")])


def _pieces(kind: str, least: int, most: int, overlap: int, parent_least: int, parent_most: int):
    """A section's children from the words of its sentences, and of its lines with their pages; none where the two differ in words."""

    def children(counts: list, pages: list, words: list) -> list[dict]:
        upto = list(accumulate(words))
        if sum(counts) != upto[-1]:
            return []
        spans = chunking.child_spans(counts, least, most, overlap)
        parents = chunking.number_parents([x["words"] for x in spans], parent_least, parent_most)
        page = lambda word: pages[bisect_right(upto, word)]
        return [{"seq": k, "parent": p, "start": x["start"], "n": x["end"] - x["start"], "pdf_start": page(x["w0"]), "pdf_end": page(x["w1"] - 1)} for k, (x, p) in enumerate(zip(spans, parents, strict=True)) if x["words"]]

    def run(counts: pd.Series, pages: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([children(*(x.tolist() for x in row)) for row in zip(counts, pages, words, strict=True)], counts.index, object)

    return F.pandas_udf(run, f"array<struct<seq:int,parent:int,start:int,n:int,pdf_start:{kind},pdf_end:{kind}>>")


def assemble(parsed: DataFrame, page_map: DataFrame, confidence: DataFrame, books: DataFrame, least: int = 60, most: int = 120, parent_least: int = 180, parent_most: int = 300, overlap: int = 1, version: str = "") -> DataFrame:
    """Chunks of curriculum()'s sections, kind child or parent, with all that the store keeps.

    page_map: book, page, printed; confidence: book, page, confidence; books: book and META.
    Sections without text, or whose sentences and lines differ in words, have no chunks.
    """
    from ..sources.tables import stored

    key = ["book", "section"]
    body = parsed.where("level is null")
    context = ["section_level", "section_title", *[x for level in LEVELS for x in (level, f"{level}_no")]]
    line = F.struct("page", "line_no", "line", T.word_count(F.col("line")).cast("int").alias("n"))
    listed = body.groupBy(*key).agg(F.sort_array(F.collect_list(line)).alias("l"), *[F.first(c).alias(c) for c in context])
    cut = listed.withColumn("s", T.sentences(F.array_join(F.transform("l", lambda x: x["line"]), "\n")))
    counts = F.transform("s", lambda x: T.word_count(x).cast("int"))
    made = _pieces(parsed.schema["page"].dataType.simpleString(), least, most, overlap, parent_least, parent_most)(counts, F.col("l.page"), F.col("l.n"))
    spans = cut.select(*key, *context, "s", made.alias("x"))
    places = F.transform("x", lambda x: F.struct(*[x[c].alias(c) for c in ("seq", "parent", "pdf_start", "pdf_end")]))
    texts = F.transform("x", lambda x: F.array_join(F.slice("s", x["start"] + 1, x["n"]), " "))
    # texts are cut once; what is looked up by page or counted goes by the keys of the pieces alone
    sections = stored(spans.select(*key, *context, places.alias("places"), texts.alias("texts")), "sections")
    child = sections.select(*key, F.posexplode("places").alias("at", "x")).select(*key, "at", "x.*")
    # confidence of a span: the sum over its pages, missing ones count 0
    each = child.select(*key, "seq", F.explode(F.sequence("pdf_start", "pdf_end")).alias("page")).join(confidence, ["book", "page"], "left")
    mean = each.groupBy(*key, "seq").agg(F.round(F.sum(F.coalesce("confidence", F.lit(0.0))) / F.count("*"), 3).alias("ocr_confidence"))
    child = child.join(mean, [*key, "seq"])
    parent = child.groupBy(*key, "parent").agg(F.min("at").alias("at"), F.count("*").cast("int").alias("n"), F.min("pdf_start").alias("pdf_start"), F.max("pdf_end").alias("pdf_end"), (F.round(F.sum(F.round(F.col("ocr_confidence") * 1000).cast("long")) / F.count("*")) / 1000).alias("ocr_confidence"))
    parent = parent.withColumn("parent_index", F.row_number().over(Window.partitionBy("book").orderBy("section", "parent")) - 1)
    named = L.parent_id([(x, F.col(x), F.col(f"{x}_no")) for x in LEVELS], F.col("parent_index"))
    parent = parent.join(sections.select(*key, *context), key).withColumn("parent_id", named)
    child = child.withColumn("n", F.lit(1)).join(parent.select(*key, "parent", "parent_id"), [*key, "parent"])
    columns = [*key, "at", "n", "pdf_start", "pdf_end", "ocr_confidence", "parent_id"]
    both = child.select(F.lit("child").alias("kind"), "seq", *columns).unionByName(parent.select(F.lit("parent").alias("kind"), F.lit(0).alias("seq"), *columns))
    for end in ("start", "end"):
        known = page_map.select("book", F.col("page").alias(f"pdf_{end}"), F.col("printed").alias(f"printed_{end}"))
        both = both.join(known, ["book", f"pdf_{end}"], "left").withColumn(f"page_{end}", F.coalesce(f"printed_{end}", f"pdf_{end}")).drop(f"printed_{end}")
    both = both.groupBy(*key).agg(F.collect_list(F.struct(*[c for c in both.columns if c not in key])).alias("pieces")).join(books.select("book", *META), "book", "left")
    # the text goes into the piece, so that no row carries all texts of its section
    piece = F.transform("pieces", lambda x: F.struct(x.alias("x"), F.array_join(F.slice("texts", x["at"] + 1, x["n"]), "\n").alias("text")))
    both = sections.select(*key, *context, "texts").join(both, key).select(*key, *context, *META, F.explode(piece).alias("x"))
    both = both.select(*key, *context, *META, "x.x.*", "x.text")
    both = both.withColumn("chunk_id", T.chunk_id(F.col("book"), F.col("page_start"), F.col("text"))).withColumn("text_lexical", L.lexical_text(F.col("text")))
    embed = F.when(F.col("kind") == "child", L.embed_text(F.col("unit"), F.col("chapter"), F.col("topic"), F.col("text"))).otherwise("")
    return both.select("chunk_id", "parent_id", "kind", F.col("text").alias("text_clean"), "text_lexical", embed.alias("embed_text"), "page_start", "page_end", F.col("pdf_start").alias("pdf_page_start"), F.col("pdf_end").alias("pdf_page_end"), "book", *META, *LEVELS, "section_level", "section_title", "ocr_confidence", F.lit(version).alias("pipeline_version"), "seq")


def split_kinds(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parents and children."""
    return chunks.where("kind = 'parent'").drop("kind"), chunks.where("kind = 'child'").drop("kind")
