"""Relations of page layout: text-layer lines and blocks, scanned word rows, and the choice between the two.

Word rows are what a scanner emits: page, pos (order of emission), block_num, par_num,
line_num, left, top, width, height, conf, text. Recognition itself is out of scope.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def median_positive(x: str) -> Column:
    """The median of the values above 0, the mean of the middle two if even in number; 0 without any."""
    return F.coalesce(F.median(F.when(F.col(x) > 0, F.col(x).cast("double"))), F.lit(0.0))


def _paged(words: DataFrame) -> DataFrame:
    """page and its words as an array; pages that have it already stay where they are."""
    if "words" in words.columns:
        return words
    return words.groupBy("page").agg(F.collect_list(F.struct(*[c for c in words.columns if c != "page"])).alias("words"))


def runs(rows: Column, *keys: str) -> Column:
    """The sorted rows, an array of structs, as arrays of neighbours that are alike in keys."""

    def cut(s: Column) -> Column:
        new = lambda x, i: (i == 0) | reduce(lambda a, b: a | b, [~x[k].eqNullSafe(F.get(s, i - 1)[k]) for k in keys])
        starts = F.array_compact(F.transform(s, lambda x, i: F.when(new(x, i), i)))
        return T.let(starts, lambda at: F.transform(at, lambda a, k: F.slice(s, a + 1, F.coalesce(F.get(at, k + 1), F.size(s)) - a)))

    return T.let(rows, cut)


def _held(words: Column, *fields: str) -> Column:
    """block_num, par_num, line_num, pos, word, conf and fields of the words that aren't blank, sorted."""
    row = lambda w: F.struct(*[w[c].alias(c) for c in ("block_num", "par_num", "line_num", "pos")], T.strip(F.coalesce(w["text"], F.lit(""))).alias("word"), F.coalesce(w["conf"].try_cast("double"), F.lit(-1.0)).alias("conf"), *[w[c].alias(c) for c in fields])
    return F.array_sort(F.filter(F.transform(words, row), lambda w: w["word"] != ""))


def _text(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: w["word"]), " ")


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def page_regions(words: Column, least: int = 1) -> Column:
    """line_regions() of one page's array of words, in order."""

    def region(r: Column) -> Column:
        of = lambda f: F.transform(r, f)
        conf = F.transform(F.filter(r, lambda w: w["conf"] >= 0), lambda w: w["conf"])
        mean = T.let(conf, lambda c: F.when(F.size(c) > 0, F.round(_total(c) / F.size(c), 3)).otherwise(0.0))
        return F.struct(r[0]["pos"].alias("first"), _text(r).alias("text"), F.array_min(of(lambda w: w["left"])).alias("x"), F.array_min(of(lambda w: w["top"])).alias("y"), F.array_max(of(lambda w: w["left"] + w["width"])).alias("x2"), F.array_max(of(lambda w: w["top"] + w["height"])).alias("y2"), mean.alias("confidence"))

    lines = F.filter(runs(_held(words, "left", "top", "width", "height"), "block_num", "par_num", "line_num"), lambda r: F.size(r) >= least)
    ordered = F.array_sort(F.transform(lines, region))
    return F.transform(ordered, lambda r, i: F.struct(i.alias("ordinal"), r["text"].alias("text"), r["x"].alias("x"), r["y"].alias("y"), (r["x2"] - r["x"]).alias("w"), (r["y2"] - r["y"]).alias("h"), r["confidence"].alias("confidence")))


def line_regions(words: DataFrame, least: int = 1) -> DataFrame:
    """page, ordinal, text, x, y, w, h, confidence: words of one block, paragraph and line, in the order in which lines first appear.

    words: word rows, or pages with an array of them (page, words), which aren't moved.
    Confidences below 0 don't count; lines of fewer than `least` words go.
    """
    return _paged(words).select("page", F.inline(page_regions(F.col("words"), least)))


def region_texts(regions: DataFrame, least: int = 1) -> DataFrame:
    """Regions with at least so many words; texts trimmed."""
    return regions.withColumn("text", T.strip(F.col("text"))).where(T.word_count(F.col("text")) >= least)


def page_confidence(pages: DataFrame, regions: DataFrame) -> DataFrame:
    """page, confidence: the mean over a page's regions, 0 without any."""
    # in thousandths, so that the order of sums doesn't matter
    mean = regions.groupBy("page").agg((F.round(F.sum(F.round(F.col("confidence") * 1000).cast("long")) / F.count("*")) / 1000).alias("confidence"))
    return pages.select("page").distinct().join(mean, "page", "left").select("page", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def page_bands(words: Column, height: Column, band: float = 0.08, least_confidence: float = 20) -> Column:
    """banded_lines() of one page's array of words, in order."""
    held = F.filter(_held(words, "top"), lambda w: (w["conf"] < 0) | (w["conf"] >= least_confidence))
    line = lambda r: F.struct(r[0]["top"].alias("top"), r[0]["pos"].alias("first"), r[0]["block_num"].alias("block_num"), r[0]["par_num"].alias("par_num"), _text(r).alias("text"))
    kind = lambda at: F.when(at <= band, "header").when(at >= 1 - band, "footer").otherwise("body")
    ordered = F.array_sort(F.transform(runs(held, "block_num", "par_num", "line_num"), line))
    return F.transform(ordered, lambda r, i: F.struct(kind(r["top"] / height).alias("kind"), i.alias("ordinal"), r["block_num"].alias("block_num"), r["par_num"].alias("par_num"), r["text"].alias("text")))


def banded_lines(words: DataFrame, heights: DataFrame | None = None, band: float = 0.08, least_confidence: float = 20) -> DataFrame:
    """page, kind (header, body, footer), ordinal, block_num, par_num, text: lines by their place on a page of that height; words of low confidence go first.

    words: word rows with heights (page, height), or pages with an array of them (page,
    words, height), which aren't moved.
    """
    pages = _paged(words)
    if heights is not None:
        pages = pages.join(heights.select("page", "height"), "page")
    return pages.select("page", F.inline(page_bands(F.col("words"), F.col("height"), band, least_confidence)))


def page_paragraphs(lines: Column) -> Column:
    """band_paragraphs() of one page's lines in order."""
    body = F.filter(lines, lambda r: r["kind"] == "body")
    joined = lambda r: F.array_join(F.transform(r, lambda x: x["text"]), " ")
    return F.transform(runs(body, "block_num", "par_num"), lambda r, i: F.struct((i + 1).cast("long").alias("paragraph"), joined(r).alias("text")))


def band_paragraphs(lines: DataFrame) -> DataFrame:
    """page, paragraph, text: neighbouring body lines of one block and paragraph, joined by blanks.

    lines: of banded_lines(), or pages with an array of them (page, lines), which aren't moved.
    """
    if "lines" not in lines.columns:
        row = F.struct("ordinal", "kind", "block_num", "par_num", "text")
        lines = lines.groupBy("page").agg(F.sort_array(F.collect_list(row)).alias("lines"))
    return lines.select("page", F.inline(page_paragraphs(F.col("lines"))))


def reading_order(boxes: Column, row: int = 24) -> Column:
    """Boxes (x, y, ...) by rows of 24, then from left to right."""
    keyed = F.transform(boxes, lambda b: F.struct(F.floor(b["y"] / row).alias("row"), b["x"].alias("x"), b.alias("box")))
    return F.transform(F.array_sort(keyed), lambda b: b["box"])


def overlap_ratio(a: Column, b: Column) -> Column:
    """What part of box a (x0, y0, x1, y1) lies in box b."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    return side("x0", "x1") * side("y0", "y1") / F.greatest(F.lit(1e-9), (a["x1"] - a["x0"]) * (a["y1"] - a["y0"]))


# ---------------------------------------------------------------- the text layer
def line_text(spans: Column) -> Column:
    return T.strip(F.array_join(F.transform(spans, lambda s: F.coalesce(s["text"], F.lit(""))), ""))


def line_size(spans: Column) -> Column:
    """The mean size of the spans that hold text; 0 without any."""
    held = F.filter(spans, lambda s: T.strip(F.coalesce(s["text"], F.lit(""))) != "")
    return F.when(F.size(held) > 0, F.aggregate(F.transform(held, lambda s: s["size"].cast("double")), F.lit(0.0), lambda a, b: a + b) / F.size(held)).otherwise(0.0)


def line_color(spans: Column) -> Column:
    """The colour of the first span that holds text; 0 without any."""
    held = F.filter(spans, lambda s: T.strip(F.coalesce(s["text"], F.lit(""))) != "")
    return F.coalesce(F.get(held, F.lit(0))["color"].cast("int"), F.lit(0))


def layer_text(lines: Column, excluded: Column) -> Column:
    """A page's text from its lines without the excluded ones (normalised); null where nothing is left."""
    kept = F.filter(F.transform(lines, T.strip), lambda x: (x != "") & ~F.array_contains(excluded, T.norm_line(x)))
    return F.nullif(F.array_join(kept, "\n"), F.lit(""))


def layer_blocks(blocks: Column, excluded: Column, width: Column, height: Column) -> Column:
    """Blocks (x0, y0, x1, y1, lines) in parts of the page, with the text of the lines that stay; blocks without any go, and so do all on a page without area."""
    kept = F.transform(blocks, lambda b: F.struct((b["x0"] / width).alias("x0"), (b["y0"] / height).alias("y0"), (b["x1"] / width).alias("x1"), (b["y1"] / height).alias("y1"), layer_text(b["lines"], excluded).alias("text")))
    return F.when((width > 0) & (height > 0), F.filter(kept, lambda b: b["text"].isNotNull())).otherwise(F.filter(kept, lambda b: F.lit(False)))


def scan_pages(lines: DataFrame, styled: DataFrame) -> DataFrame:
    """book, page, raw_text from text-layer lines (book, page, line_no, text), without the lines that styled_lines() found."""
    found = styled.groupBy("book", "page").agg(F.collect_set("norm").alias("out"))
    listed = lines.groupBy("book", "page").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]).alias("lines"))
    out = F.coalesce("out", F.array().cast("array<string>"))
    return listed.join(found, ["book", "page"], "left").select("book", "page", F.coalesce(layer_text(F.col("lines"), out), F.lit("")).alias("raw_text"), F.size(out).alias("removed"))


# ---------------------------------------------------------------- regions against blocks
#: pages that a Python call has as objects at once
MERGE_PAGES = 64


def _merge(least: int, threshold: float):
    """Greedy by regions in reading order: each takes the free block that covers most of it."""

    def page(r: dict) -> str:
        regions, blocks = r["regions"], r["blocks"]
        used, pieces = [b["n"] < least for b in blocks], []
        for region in regions:
            best, most = -1, threshold
            x0, y0, x1, y1 = region["x0"], region["y0"], region["x1"], region["y1"]
            area = max(1e-9, (x1 - x0) * (y1 - y0))
            for i, b in enumerate(blocks):
                if used[i] or b["y0"] >= y1 or b["y1"] <= y0:
                    continue
                share = max(0.0, min(x1, b["x1"]) - max(x0, b["x0"])) * (min(y1, b["y1"]) - max(y0, b["y0"])) / area
                if share > most:
                    best, most = i, share
            if best >= 0:
                used[best] = True
            pieces.append((y0, (blocks[best] if best >= 0 else region)["text"].strip()))
        middle = lambda b: (b["y0"] + b["y1"]) / 2 if regions else 0.0
        pieces += [(middle(b), b["text"].strip()) for i, b in enumerate(blocks) if not used[i]]
        pieces.sort(key=lambda p: p[0])
        return "\n".join(t for _, t in pieces if t)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, MERGE_PAGES):
                part = batch.slice(at, MERGE_PAGES)
                texts = [page(r) for r in part.select(["regions", "blocks"]).to_pylist()]
                yield pa.RecordBatch.from_arrays([part["page"].cast(pa.int64()), pa.array(texts, pa.string())], ["page", "text"])

    return run


def merge_pages(pages: DataFrame, least: int = 3, threshold: float = 0.15) -> DataFrame:
    """merge_best() of pages with their arrays: page, regions (ordinal, x, y, w, h, text), blocks (x0, y0, x1, y1, text), width, height. They aren't moved."""
    w, h = F.col("width"), F.col("height")
    region = lambda r: F.struct((r["x"] / w).alias("x0"), (r["y"] / h).alias("y0"), ((r["x"] + r["w"]) / w).alias("x1"), ((r["y"] + r["h"]) / h).alias("y1"), r["text"].alias("text"))
    block = lambda b: F.struct(*[b[c].cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], b["text"].alias("text"), T.word_count(b["text"]).alias("n"))
    return pages.select("page", F.transform("regions", region).alias("regions"), F.transform("blocks", block).alias("blocks")).mapInArrow(_merge(least, threshold), "page long, text string")


def merge_best(regions: DataFrame, blocks: DataFrame, sizes: DataFrame, least: int = 3, threshold: float = 0.15) -> DataFrame:
    """page, text: for each region (page, ordinal, x, y, w, h, text) the text-layer block that covers over `threshold` of it, else its own text; blocks left over too.

    blocks: page, ordinal, x0, y0, x1, y1 (parts of the page), text; sizes: page, width,
    height. A block is used once; blocks under `least` words never. Pieces stand by their
    upper edge (left-over blocks by their middle). Each step depends on the one before, so
    a page is one Python call over its own boxes.
    """
    listed = lambda d, name: d.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("ordinal", *[c for c in d.columns if c not in ("page", "ordinal")]))).alias(name))
    r, b = listed(regions.select("page", "ordinal", "x", "y", "w", "h", "text").join(sizes.select("page"), "page"), "regions"), listed(blocks.select("page", "ordinal", "x0", "y0", "x1", "y1", "text"), "blocks")
    empty = lambda name, d: F.coalesce(name, F.array().cast(d.schema[name].dataType)).alias(name)
    both = r.join(b, "page", "full").select("page", empty("regions", r), empty("blocks", b))
    return merge_pages(both.join(sizes.select("page", "width", "height"), "page", "left"), least, threshold)
