"""Page cleaning: repeated lines of a book found by aggregation, then taken out of its pages."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def page_lines(pages: DataFrame) -> DataFrame:
    """book, page, line_no, line, norm from book, page, text; every line keeps its place."""
    lines = pages.select("book", "page", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    return lines.withColumn("norm", T.norm_line(F.col("line")))


def _threshold(pages: DataFrame, frequency: float) -> DataFrame:
    counts = pages.groupBy("book").agg(F.count("*").alias("n"))
    return counts.where("n >= 2").select("book", F.greatest(F.lit(2), F.ceil(F.col("n") * frequency)).alias("least"))


def edge_artifacts(pages: DataFrame, frequency: float = 0.7, window: int = 3) -> DataFrame:
    """Running heads and feet: lines often among a page's first or last non-blank ones; counted by position."""
    norms = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), T.norm_line), lambda x: x != "")
    ends = T.let(norms, lambda x: F.filter(x, lambda _, i: (i < window) | (i >= F.size(x) - window)))
    edge = pages.select("book", F.explode(ends).alias("norm")).where(~T.is_pure_number(F.col("norm")))
    counts = edge.groupBy("book", "norm").agg(F.count("*").alias("hits"))
    return counts.join(_threshold(pages, frequency), "book").where("hits >= least").select("book", "norm", "hits")


def repeated_lines(pages: DataFrame, frequency: float = 0.5) -> DataFrame:
    """Lines on many pages of a book, wherever they stand; once a page at most."""
    lines = page_lines(pages).where("norm <> ''").where(~T.is_pure_number(F.col("norm")))
    counts = lines.select("book", "page", "norm").distinct().groupBy("book", "norm").agg(F.count("*").alias("hits"))
    return counts.join(_threshold(pages, frequency), "book").where("hits >= least").select("book", "norm", "hits")


def valid_patterns(patterns: list[str]) -> list[str]:
    """The patterns that Java can compile, case-insensitive; others are left out."""
    from pyspark.sql import SparkSession

    java = SparkSession.active().sparkContext._jvm.java.util.regex.Pattern
    out = []
    for p in patterns:
        try:
            java.compile(p, java.CASE_INSENSITIVE)
        except Exception:  # noqa: BLE001 - whatever Java objects to
            continue
        out.append(f"(?i){p}")
    return out


def is_stamp(line: Column, keywords: list[str] = (), patterns: list[str] = ()) -> Column:
    """Whether a line holds one of the keywords, in any case, or matches one of the patterns."""
    hit: Column = F.lit(False)
    for k in keywords:
        if k:
            hit = hit | F.lower(line).contains(k.lower())
    for p in valid_patterns(list(patterns)):
        hit = hit | line.rlike(p)
    return hit


def keyword_lines(pages: DataFrame, keywords: list[str] = (), patterns: list[str] = ()) -> DataFrame:
    """book, page, norm of lines with a keyword or pattern: printed stamps and the like, one hit is enough."""
    lines = page_lines(pages).where("norm <> ''")
    return lines.where(is_stamp(T.strip(F.col("line")), keywords, patterns)).select("book", "page", "norm").distinct()


def styled_lines(lines: DataFrame, rotation: float = 0.05, ratio: float = 1.6, light: float = 200) -> DataFrame:
    """book, page, text, norm, rotated, size_ratio, too_light of lines set unlike the body: rotated, oversized or near white.

    lines: book, page, dir_y, spans (array of struct(text, size, color)). The body's size
    is the median of level lines of 8 characters or more.
    """
    from ..functions.labels import light_color

    text = T.strip(F.array_join(F.transform("spans", lambda x: F.coalesce(x["text"], F.lit(""))), ""))
    held = F.filter("spans", lambda x: T.strip(F.coalesce(x["text"], F.lit(""))) != "")
    sizes = F.transform(held, lambda x: F.coalesce(x["size"].cast("double"), F.lit(0.0)))
    size = F.when(F.size(held) > 0, F.aggregate(sizes, F.lit(0.0), lambda a, b: a + b) / F.size(held)).otherwise(0.0)
    d = lines.select("book", "page", text.alias("text"), size.alias("size"), F.coalesce(F.get(held, F.lit(0))["color"].cast("int"), F.lit(0)).alias("color"), (F.abs(F.col("dir_y")) > rotation).alias("rotated")).where("text <> ''")
    level = F.when(~F.col("rotated") & (F.length("text") >= 8) & (F.col("size") > 0), F.col("size"))
    d = d.withColumn("body", F.coalesce(F.median(level).over(Window.partitionBy("book", "page")), F.lit(0.0)))
    of = F.when(F.col("body") > 0, F.col("size") / F.col("body")).otherwise(1.0)
    d = d.withColumn("size_ratio", F.round(of, 2)).withColumn("too_light", light_color(F.col("color"), light)).where(F.col("rotated") | ((F.col("body") > 0) & (of >= ratio)) | F.col("too_light"))
    return d.select("book", "page", "text", T.norm_line(F.col("text")).alias("norm"), "rotated", "size_ratio", "too_light")


def boilerplate(edges: DataFrame, pages: DataFrame, share: float = 0.4) -> DataFrame:
    """norm, hits of head and foot lines (book, page, line) on many pages: digits count as one, least is rounded down, 2 at least."""
    norm = F.regexp_replace(F.regexp_replace(F.lower(T.strip(F.col("line"))), "[0-9]+", "#"), rf"{T.WHITE}+", " ")
    counts = edges.select("book", "page", norm.alias("norm")).where("norm <> ''").distinct().groupBy("book", "norm").agg(F.count("*").alias("hits"))
    least = pages.groupBy("book").agg(F.greatest(F.lit(2), F.floor(F.count("*") * share)).alias("least"))
    return counts.join(least, "book").where("hits >= least").select("book", "norm", "hits")


def in_page_repeats(pages: DataFrame, least: int = 3) -> DataFrame:
    lines = page_lines(pages).where("norm <> ''").where(~T.is_heading_like(F.col("norm")))
    return lines.groupBy("book", "page", "norm").agg(F.count("*").alias("hits")).where(F.col("hits") >= least)


def artifacts(pages: DataFrame, edge: float = 0.7, anywhere: float = 0.5) -> DataFrame:
    """Union of the detectors that look at whole books: book, norm."""
    return edge_artifacts(pages, edge).select("book", "norm").union(repeated_lines(pages, anywhere).select("book", "norm")).distinct()


def page_artifacts(pages: DataFrame, keywords: list[str] = (), patterns: list[str] = (), styled: DataFrame | None = None) -> DataFrame:
    """Union of the detectors that look at one page: book, page, norm of stamps, of styled lines, and of the printed page number."""
    from .structure import find_page_number

    number = pages.select("book", "page", find_page_number(F.col("text")).cast("string").alias("norm")).where("norm is not null")
    found = keyword_lines(pages, keywords, patterns).union(number)
    return (found.union(styled.select("book", "page", "norm")) if styled is not None else found).distinct()


def remove_artifacts(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Lines that stay: no artifact, no noise; headings stay unless they are artifacts."""
    lines = page_lines(pages).join(found.select("book", "norm"), ["book", "norm"], "left_anti")
    return lines.where(~T.is_noise(F.col("line")) | T.is_heading_like(F.col("norm")))


def join_lines(lines: Column) -> Column:
    """Wrapped lines as one paragraph; a hyphen at a line's end joins without a blank."""
    flat = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, rf"{T.WHITE}+", " ")))
    last = F.size(lines) - 1
    return F.array_join(F.transform(flat, lambda x, i: F.when(i == last, x).when(x.endswith("-"), F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(F.concat(x, F.lit(" ")))), "")


def structure_codes(lines: Column) -> Column:
    """One character for each of a page's lines, an array of struct(table, artifact, heading, blank): t table row, h heading, else a dash.

    A table is two or more neighbouring rows, at most 12; an artifact never begins one and
    is no heading. The fold carries only the rows left and the characters.
    """
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("left"))
    beside = F.transform(lines, lambda x, i: F.struct(x["table"].alias("table"), x["artifact"].alias("artifact"), x["heading"].alias("heading"), F.coalesce(F.get(lines, i + 1)["table"], F.lit(False)).alias("next")))

    def step(s: Column, x: Column) -> Column:
        on = x["table"] & (s["left"] > 0)
        begins = ~on & x["table"] & ~x["artifact"] & x["next"]
        code = F.when(on | begins, "t").when(x["heading"] & ~x["artifact"], "h").otherwise("-")
        return F.struct(F.concat(s["out"], code).alias("out"), F.when(on, s["left"] - 1).when(begins, 11).otherwise(0).alias("left"))

    return F.aggregate(beside, state, step, lambda s: s["out"])


def _listed_lines(pages: DataFrame, book_found: DataFrame, page_found: DataFrame) -> DataFrame:
    """book, page, lines (an array, in order) and codes (a character for each) of every page."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n")
    lines = page_lines(pages.select("book", "page", text.alias("text")))
    lines = lines.join(book_found.select("book", "norm", F.lit(1).alias("b")), ["book", "norm"], "left").join(page_found.select("book", "page", "norm", F.lit(1).alias("p")), ["book", "page", "norm"], "left")
    x = T.strip(F.col("line"))
    row = F.struct("line_no", x.alias("line"), "norm", (F.col("b").isNotNull() | F.col("p").isNotNull()).alias("artifact"), ((x != "") & T.is_table_line(x)).alias("table"), T.is_heading_like(x).alias("heading"), T.is_noise(x).alias("noise"))
    # one page's lines
    listed = lines.groupBy("book", "page").agg(F.sort_array(F.collect_list(row)).alias("lines"))
    return listed.withColumn("codes", structure_codes(F.col("lines")))


def typed_lines(pages: DataFrame, book_found: DataFrame, page_found: DataFrame) -> DataFrame:
    """book, page, line_no, line (trimmed), norm, artifact, code of every line."""
    listed = _listed_lines(pages, book_found, page_found).withColumn("codes", F.split("codes", ""))
    return listed.select("book", "page", F.inline(F.arrays_zip("lines", "codes"))).select("book", "page", "lines.line_no", "lines.line", "lines.norm", "lines.artifact", F.col("codes").alias("code"))


_BLANKS = re.compile(T.WHITE + "+")
#: pages that a Python call has as objects at once
PAGE_PART = 64


def _joined(lines: list[str]) -> str:
    """join_lines() of a list."""
    flat = [_BLANKS.sub(" ", x).strip(" ") for x in lines]
    return "".join(x[:-1] if x.endswith("-") else x + " " for x in flat[:-1]) + flat[-1]


def _clean_text(lines: list[dict], codes: str, repeat: int) -> str:
    plain = lambda x, code: x["line"] != "" and code == "-"
    kept = [(x, code) for x, code in zip(lines, codes, strict=True) if x["line"] == "" or code != "-" or (not x["artifact"] and (x["heading"] or not x["noise"]))]
    again = Counter(x["norm"] for x, code in kept if plain(x, code))
    blocks: list[list] = [[]]
    for x, code in kept:
        if plain(x, code) and again[x["norm"]] >= repeat and not x["heading"]:
            continue
        parts = blocks[-1]
        if x["line"] == "":
            blocks.append([])
        elif code == "-" and parts and parts[-1][0] == "-":
            parts[-1][1].append(x["line"])
        else:
            # a protected line is a part of its own
            parts.append((code, [x["line"]]))
    return "\n\n".join("\n".join(_joined(x) if code == "-" else x[0] for code, x in parts) for parts in blocks if parts)


def _clean(repeat: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PAGE_PART):
                part = batch.slice(at, PAGE_PART)
                rows = part.select(["lines", "codes"]).to_pylist()
                texts = [_clean_text(r["lines"] or [], r["codes"] or "", repeat) for r in rows]
                removed = [len({x["norm"] for x in r["lines"] or [] if x["artifact"] and x["line"] != ""}) for r in rows]
                yield pa.RecordBatch.from_arrays([part["book"], part["page"], pa.array(texts, pa.string()), pa.array(removed, pa.int64()), part["printed"]], ["book", "page", "clean_text", "removed", "printed"])

    return run


def clean_pages(pages: DataFrame, edge: float = 0.7, anywhere: float = 0.5, keywords: list[str] = (), patterns: list[str] = (), styled: DataFrame | None = None, repeat: int = 3) -> DataFrame:
    """book, page, clean_text, removed (different artifact lines), printed (page number): a row a page.

    Tables and headings stay as they are, also in number; artifacts, noise and lines met
    `repeat` times on the page go; wrapped lines are joined within paragraphs, which blank
    lines part. A page's lines are put together in one Python call, as each depends on
    those before.
    """
    from .structure import find_page_number

    listed = _listed_lines(pages, artifacts(pages, edge, anywhere), page_artifacts(pages, keywords, patterns, styled))
    number = pages.select("book", "page", find_page_number(F.col("text")).alias("printed"))
    # sorted by page by the join, lines with their texts stay where they were listed
    both = number.join(listed, ["book", "page"], "left").select("book", "page", "printed", F.transform("lines", lambda x: x.dropFields("line_no", "table")).alias("lines"), "codes")
    return both.mapInArrow(_clean(repeat), f"book string, page {pages.schema['page'].dataType.simpleString()}, clean_text string, removed long, printed int")


def corrections(words: DataFrame, known: DataFrame) -> DataFrame:
    """word, fixed: for each unknown word the first known one within one edit.

    Two words within one edit share the word itself or one of its forms with a letter
    left out, so they meet in an equi-join on these forms; no pair is made beyond it.
    """
    forms = lambda x: F.array_distinct(F.concat(F.array(x), F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))))
    left = words.join(known.select(F.col("known").alias("word")), "word", "left_anti").select("word", F.explode(forms(F.col("word"))).alias("form"))
    right = known.select("known", F.explode(forms(F.col("known"))).alias("form"))
    near = left.join(right, "form").where((F.levenshtein("word", "known", 1) >= 0) & (F.col("word") != F.col("known")))
    return near.groupBy("word").agg(F.min("known").alias("fixed"))
