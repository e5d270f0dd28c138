"""Book structure: sections, inherited context, page numbers, and book lookup."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

MOST_BOOKS = 100_000
#: line ends as Python's splitlines() has them, and white space as its strip() has it
LINE_ENDS = r"[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"
BLANK = r"[\t-\r\x1C-\x20\x{85}\p{Z}]"
NOT_BLANK = r"[^\t-\r\x1C-\x20\x{85}\p{Z}]"
#: decimal digits of any script, and those of ASCII in their place
DIGITS = "".join(chr(c) for c in range(128, 0x10000) if unicodedata.category(chr(c)) == "Nd")
ASCII_DIGITS = "".join(str(unicodedata.digit(c)) for c in DIGITS)


def find_page_number(text: Column, window: int = 3) -> Column:
    """The first line of one to four digits only among the first, then the last non-blank lines, as a number; null without one."""
    # only the edges are trimmed
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), LINE_ENDS), lambda x: x.rlike(NOT_BLANK))
    edges = T.let(lines, lambda x: F.concat(F.slice(x, 1, window), F.slice(x, F.greatest(F.size(x) - (window - 1), F.lit(1)), F.lit(window))))
    trimmed = F.transform(edges, lambda x: F.regexp_replace(x, rf"^{BLANK}+|{BLANK}+$", ""))
    return F.translate(F.get(F.filter(trimmed, lambda x: x.rlike(r"^\p{Nd}{1,4}$")), F.lit(0)), DIGITS, ASCII_DIGITS).cast("int")


def sections(lines: DataFrame) -> DataFrame:
    """book, page, line_no, line -> each line with its level, section number (0: front matter) and inherited title.

    A new unit clears the chapter; both are carried forward by windows in reading order.
    """
    order = Window.partitionBy("book").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    held = lines.withColumn("line", T.strip(F.col("line"))).where("line <> ''").withColumn("level", T.heading_level(F.col("line")))
    held = held.withColumn("section", F.count("level").over(order)).withColumn("unit_no", F.count(F.when(F.col("level") == "unit", 1)).over(order))
    chapter = Window.partitionBy("book", "unit_no").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("unit", F.last(F.when(F.col("level") == "unit", F.col("line")), True).over(order))
    held = held.withColumn("chapter", F.last(F.when(F.col("level") == "chapter", F.col("line")), True).over(chapter))
    return held.withColumn("title", F.coalesce(F.last(F.when(F.col("level").isNotNull(), F.col("line")), True).over(order), F.lit("Front matter")))


def page_map(pages: DataFrame) -> DataFrame:
    """book, page, anchor (a printed number or null) -> printed: counted on from the anchor before, else back from the first after."""
    order = Window.partitionBy("book").orderBy("page")
    known = F.when(F.col("anchor").isNotNull(), F.struct("page", "anchor"))
    near = F.coalesce(F.last(known, True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.first(known, True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    found = pages.select("book", "page", near.alias("near"))
    return found.where("near is not null").select("book", "page", (F.col("near.anchor") + F.col("page") - F.col("near.page")).alias("printed"))


def match_books(stems: DataFrame, books: DataFrame) -> DataFrame:
    """stem -> the first book (by ordinal) whose name equals, holds or is held by it, in any case.

    books is the curriculum, a declared list of at most MOST_BOOKS, which is sent to all
    tasks; more are an error, as every stem is held against every book.
    """
    if books.count() > MOST_BOOKS:
        raise ValueError(f"a curriculum has at most {MOST_BOOKS} books")
    a, b = F.lower("stem"), F.lower("book")
    pairs = stems.join(F.broadcast(books), a.contains(b) | b.contains(a))
    return pairs.groupBy("stem").agg(F.min_by("book", "ordinal").alias("book"))
