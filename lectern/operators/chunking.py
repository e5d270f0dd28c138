"""Chunking: sentence windows with overlap, parents over children, fixed windows, links.

A chunker is a greedy walk over the word counts of a section's sentences, one step a
sentence; it runs over Arrow batches, as no built-in function carries a list that grows
without copying it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

_SPAN = "array<struct<start:int,end:int,words:int,w0:int,w1:int>>"


def _walk(counts, step) -> list[dict]:
    """Spans by step(start) -> (end, next start); w0 and w1 are the words before a span's begin and end."""
    before, out, start = [0], [], 0
    for c in counts:
        before.append(before[-1] + int(c))
    while start < len(counts):
        end, following = step(start)
        out.append({"start": start, "end": end, "words": before[end] - before[start], "w0": before[start], "w1": before[end]})
        if end >= len(counts):
            break
        start = following
    return out


def _child_step(counts, least: int, most: int, overlap: int):
    def step(start: int) -> tuple[int, int]:
        end, words = start, 0
        while end < len(counts) and (words == 0 or words + counts[end] <= most):
            words += counts[end]
            end += 1
        if words < least and end < len(counts):
            end += 1
        return end, max(end - overlap, start + 1)

    return step


def child_spans(counts: list, least: int, most: int, overlap: int) -> list[dict]:
    """What sentence_windows() makes of one list."""
    return _walk(counts, _child_step(counts, least, most, overlap))


def _topic_step(counts, least: int, most: int, overlap: int):
    def step(start: int) -> tuple[int, int]:
        end, words = start, 0
        while end < len(counts) and (end == start or words + counts[end] <= most) and not (end > start and words >= least):
            words += counts[end]
            end += 1
        return end, max(end - overlap, start + 1)

    return step


def _share_back(counts, start: int, end: int, wanted: float) -> int:
    """How many sentences from the end make up the wanted words; one at least."""
    back = words = 0
    for k in range(end - 1, start - 1, -1):
        words += counts[k]
        back += 1
        if words >= wanted:
            break
    return back


def _share_step(counts, least: int, most: int, share: float):
    """Filled up to least words, over most only by the first sentence; the next begins with the last share of the words."""

    def step(start: int) -> tuple[int, int]:
        end, words = start, 0
        while end < len(counts) and (end == start or words + counts[end] <= most):
            words += counts[end]
            end += 1
            if words >= least:
                break
        return end, max(start + 1, end - _share_back(counts, start, end, words * share))

    return step


def _spans(make, *options) -> Column:
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda c: _walk(c, make(c, *options)))

    return F.pandas_udf(run, _SPAN)


def sentence_windows(counts: Column, least: int, most: int, overlap: int, greedy: bool = True) -> Column:
    """Spans over an array of word counts.

    greedy: fill up to most, and take one more sentence if under least (child chunks);
    else stop as soon as least is reached (topic chunks).
    """
    return _spans(_child_step if greedy else _topic_step, least, most, overlap)(counts)


def share_windows(counts: Column, least: int = 250, most: int = 350, share: float = 0.2) -> Column:
    """Spans of least to most words; each begins with the last share of the words of the one before."""
    return _spans(_share_step, least, most, share)(counts)


def _tail_spans(counts, target: int, share: float) -> list[dict]:
    before, out, start, words = [0], [], 0, 0
    for c in counts:
        before.append(before[-1] + int(c))
    span = lambda a, z: {"start": a, "end": z, "words": before[z] - before[a], "w0": before[a], "w1": before[z]}
    for end, c in enumerate(counts, 1):
        words += int(c)
        if words >= target:
            out.append(span(start, end))
            start = end - _share_back(counts, start, end, int(words * share))
            words = before[end] - before[start]
    if start < len(counts):
        out.append(span(start, len(counts)))
    return out


def tail_windows(counts: Column, target: int = 300, share: float = 0.2) -> Column:
    """Spans that end when target words are reached; the last share of them begins the next, and what remains is a span too."""

    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda c: _tail_spans(c, target, share))

    return F.pandas_udf(run, _SPAN)(counts)


def number_parents(words: list, least: int, most: int) -> list[int]:
    """What parent_numbers() makes of one list."""
    out, parent, total = [], 0, 0
    for n, w in enumerate(words):
        if n and total + w > most and total >= least:
            parent, total = parent + 1, 0
        total += w
        out.append(parent)
    return out


def parent_numbers(words: Column, least: int = 180, most: int = 300) -> Column:
    """The parent of each child from the children's words: a parent closes when a child would overfill it and it has enough."""

    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda c: number_parents(c, least, most))

    return F.pandas_udf(run, "array<int>")(words)


def heading_of(sentences: Column, chunk: Column) -> Column:
    """The heading of the first of the sentences, an array of struct(text, heading), that the chunk holds."""
    return F.get(F.filter(sentences, lambda s: chunk.contains(s["text"])), F.lit(0))["heading"]


def child_chunks(sentences: DataFrame, least: int = 60, most: int = 120, overlap: int = 1) -> DataFrame:
    """doc_id, counts (words of each sentence) -> doc_id, seq, start, end, words."""
    spans = sentences.select("doc_id", F.posexplode(sentence_windows(F.col("counts"), least, most, overlap)).alias("seq", "span"))
    return spans.select("doc_id", "seq", "span.start", "span.end", "span.words")


def topic_chunks(sentences: DataFrame, least: int = 40, most: int = 90, overlap: int = 1) -> DataFrame:
    spans = sentences.select("doc_id", "part", F.posexplode(sentence_windows(F.col("counts"), least, most, overlap, greedy=False)).alias("seq", "span"))
    return spans.select("doc_id", "part", "seq", "span.start", "span.end", "span.words")


def parent_groups(children: DataFrame, least: int = 180, most: int = 300) -> DataFrame:
    """doc_id, seq, words -> with parent."""
    lists = children.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "words"))).alias("c"))
    lists = lists.withColumn("p", parent_numbers(F.transform("c", lambda x: x["words"].cast("int")), least, most))
    return lists.select("doc_id", F.inline(F.arrays_zip("c", "p"))).select("doc_id", "c.seq", "c.words", F.col("p").alias("parent"))


def fixed_windows(texts: DataFrame, size: int = 400, overlap: int = 60, least: int = 25) -> DataFrame:
    """doc_id, text -> windows of size words, each overlap words into the one before; short tails go."""
    words = texts.select("doc_id", F.filter(F.split("text", rf"{T.WHITE}+"), lambda x: x != "").alias("w")).where("size(w) > 0")
    starts = words.select("doc_id", "w", F.posexplode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(size - overlap))).alias("seq", "start"))
    out = starts.select("doc_id", "seq", "start", F.slice("w", F.col("start") + 1, F.lit(size)).alias("part"))
    return out.where(F.size("part") >= least).select("doc_id", "seq", "start", F.size("part").alias("words"), F.md5(F.array_join("part", " ")).alias("digest"))


def chunk_links(chunks: DataFrame) -> DataFrame:
    """Neighbours of each chunk in its document."""
    order = Window.partitionBy("doc_id").orderBy("seq")
    return chunks.select("doc_id", "seq", F.lag("seq").over(order).alias("previous"), F.lead("seq").over(order).alias("next"))
