"""Line dedup: a suffix array over line-ID sequences by prefix doubling; later copies of repeated runs go.

A text is a sequence of lines that hold a word; a line's ID is a 128-bit hash. Round k
ranks the suffixes by their first 2**k lines: by the ranks that round k - 1 gave to the
suffix and to the one 2**(k-1) lines on. Ranks are order-preserving: each round sorts its
distinct pairs by range. Suffixes of one rank are an interval of the suffix array whose
longest common prefix is at least 2**k lines; only intervals of several suffixes go on,
and rounds end when there is none, after log2 of the longest repeated run.

The earliest suffix of an interval (by doc_id, text digest, line) is the source of the
others. A suffix's run is what it shares with its source in the last interval where it has
an earlier one. The exact length is the longest common prefix, read from the ranks of the
rounds from the largest power of two to the smallest; a run that goes on from the line
before, with the source's line before, is part of that longer run. What is left are
the maximal runs. A run counts if it has `min_lines` lines (a power of two); a line of
`min_words` words or more counts alone. All lines of later copies are deleted.

Only DataFrame functions run. Frequent lines are counted map-side; the table that names
an interval has one row for it and a sort of its own, so the join that returns it splits
the rows of a frequent line like any skewed join. Every round is a stored table.

Defined cases: null text is empty; blank lines are no part of a sequence and stay; a text
that loses all its lines has the text '' and n_lines = n_removed; rows that agree in
doc_id and text are one document and get the same result each; a null doc_id comes before
all others; an empty table gives an empty result; other columns are not read, and never
clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store, text_table

MIN_LINES, MIN_WORDS = 2, 5
SALTS = 64
_HELD = r"[^\x20\x09-\x0D]"
#: a document (a null doc_id is false and 0), and a suffix's place
_DOC = ["known", "doc", "th"]
_PLACE = [*_DOC, "pos"]


def _document(docs: DataFrame, *others: str) -> DataFrame:
    """text_table with the columns that name a document, none of them null, and others as a struct of this name."""
    d = text_table(docs, *([F.struct(*[F.col(f"`{c}`") for c in others]).alias("others")] if others else []))
    return d.withColumn("known", F.col("doc_id").isNotNull()).withColumn("doc", F.coalesce("doc_id", F.lit(0).cast("long"))).withColumn("th", F.xxhash64("text"))


def _numbered(text: str = "text"):
    """The lines that hold a word, with their place among all lines."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("line")))
    return F.filter(lines, lambda x: x["line"].rlike(_HELD))


def line_ids(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Stored: known, doc, th, pos, wide, h1, h2: the lines that hold a word, once a document."""
    lines = _document(docs).select(*_DOC, F.posexplode(_numbered()).alias("pos", "x"))
    wide = F.size(F.split(F.trim(F.regexp_replace("x.line", r"[\x20\x09-\x0D]+", " ")), " ")) >= min_words
    lines = store(lines.select(*_PLACE, wide.alias("wide"), F.xxhash64("x.line").alias("h1"), F.xxhash64(F.lit(1), "x.line").alias("h2")), "lines")
    twice = lines.where("pos = 0").groupBy(*_DOC).agg(F.count("*").alias("n")).where("n > 1")
    return lines if twice.isEmpty() else store(lines.dropDuplicates(_PLACE), "lines-once")


def _ranked(named: DataFrame, by: list[str], name: str) -> DataFrame:
    """Stored suffixes that share the columns by with another: place, rank (in the order of by) and first, the earliest of them."""
    classes = named.groupBy(*by).agg(F.count("*").alias("n"), F.min(F.struct(*_PLACE)).alias("first")).where("n > 1")
    # sorted by range: the numbers of partitions and of rows in them grow with the order
    classes = classes.orderBy(*by).withColumn("rank", F.monotonically_increasing_id())
    return store(named.join(classes, by).drop(*by, "n"), name)


def suffix_ranks(lines: DataFrame) -> list[DataFrame]:
    """Of round k the suffixes that share their first 2**k lines with another: place, rank, first."""
    rounds = [_ranked(lines.drop("wide"), ["h1", "h2"], "ranks0")]
    length = 1
    while not rounds[-1].isEmpty():
        now = rounds[-1].select(*_PLACE, F.col("rank").alias("r1"))
        on = rounds[-1].select(*_DOC, (F.col("pos") - length).alias("pos"), F.col("rank").alias("r2"))
        rounds.append(_ranked(now.join(on, _PLACE), ["r1", "r2"], f"ranks{len(rounds)}"))
        length *= 2
    return rounds[:-1]


def maximal_runs(rounds: list[DataFrame]) -> DataFrame | None:
    """Stored: place, length, source (a place): later copies of maximal repeated runs; None without any."""
    if not rounds:
        return None
    later = None
    for k, ranks in enumerate(rounds):
        rows = ranks.where(F.struct(*_PLACE) > F.col("first")).select(*_PLACE, F.struct(F.lit(k).alias("k"), F.lit(1 << k).alias("length"), F.col("first").alias("source")).alias("x"))
        later = rows if later is None else later.union(rows)
    tops = later.groupBy(*_PLACE).agg(F.max("x").alias("x")).select(*_PLACE, "x.*")
    before = F.lag(F.struct("pos", "source")).over(Window.partitionBy(*_DOC).orderBy("pos"))
    goes_on = (F.col("before.pos") == F.col("pos") - 1) & (F.col("before.source") == F.struct("source.known", "source.doc", "source.th", (F.col("source.pos") - 1).alias("pos")))
    heads = tops.withColumn("before", before).where(~F.coalesce(goes_on, F.lit(False))).drop("before")
    heads = store(heads, "heads")
    keys = [f"s_{c}" for c in _PLACE]
    source = [F.col(f"source.{c}").alias(f"s_{c}") for c in _DOC]
    for k in range(len(rounds) - 2, -1, -1):
        ranks = rounds[k].select(*_PLACE, "rank")
        open_ = heads.where(F.col("k") > k).withColumn("at", F.col("pos") + F.col("length"))
        mine = open_.join(ranks.withColumnRenamed("pos", "at"), [*_DOC, "at"]).drop("at")
        # a source with many copies is looked up once for each salt
        mine = mine.select(*_PLACE, "rank", *source, (F.col("source.pos") + F.col("length")).alias("s_pos"), F.pmod(F.xxhash64(*_PLACE), F.lit(SALTS)).alias("salt"))
        theirs = mine.select(*keys, "salt").distinct().join(ranks.select(*[F.col(c).alias(f"s_{c}") for c in _PLACE], F.col("rank").alias("s_rank")), keys)
        same = mine.join(theirs, [*keys, "salt"]).where("rank = s_rank").select(*_PLACE)
        longer = heads.join(same.withColumn("more", F.lit(1 << k)), _PLACE, "left")
        heads = store(longer.withColumn("length", F.col("length") + F.coalesce("more", F.lit(0))).drop("more"), "heads")
    return heads.select(*_PLACE, "length", "source")


def repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame | None:
    """known, doc, th, gone (array of start and end, disjoint and in order), longest: lines to delete of each document that has some."""
    if min_lines < 1 or min_lines & (min_lines - 1):
        raise ValueError("min_lines must be a power of two")
    lines = line_ids(docs, min_words)
    rounds = suffix_ranks(lines)
    runs = maximal_runs(rounds)
    if runs is None:
        return None
    spans = runs.where(F.col("length") >= min_lines).select(*_PLACE, (F.col("pos") + F.col("length")).alias("end"), "length")
    alone = rounds[0].where(F.struct(*_PLACE) > F.col("first")).join(lines.where("wide").select(*_PLACE), _PLACE).select(*_PLACE, (F.col("pos") + 1).alias("end"), F.lit(1).alias("length"))
    spans = spans.union(alone)
    order = Window.partitionBy(*_DOC).orderBy("pos", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.coalesce(F.col("pos") > reached, F.lit(True)).cast("int"))
    spans = spans.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = spans.groupBy(*_DOC, "island").agg(F.min("pos").alias("start"), F.max("end").alias("end"), F.max("length").alias("length"))
    # a document's own lines bound its list
    return merged.groupBy(*_DOC).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("gone"), F.max("length").alias("longest"))


def line_dedup(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, carry: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_removed, longest (lines of its longest run that is a later copy), text (what stays).

    carry: instead, the rows of docs with their own columns and the text that stays, without rows that lose all their lines.
    """
    found = repeated_lines(docs, min_lines, min_words)
    others = [c for c in docs.columns if c not in ("doc_id", "text")] if carry else []
    d = _document(docs, *others)
    if found is None:
        d = d.withColumn("gone", F.lit(None).cast("array<struct<start:int,end:int>>")).withColumn("longest", F.lit(None).cast("int"))
    else:
        d = d.join(found, _DOC, "left")
    d = d.drop(*_DOC).withColumn("held", _numbered())
    n_lines = F.size("held").cast("long")
    n_removed = F.coalesce(F.aggregate("gone", F.lit(0), lambda s, x: s + x["end"] - x["start"]), F.lit(0)).cast("long")
    # places of the deleted lines among all lines, then the pieces between them: no step copies what it has so far
    out = F.flatten(F.transform("gone", lambda x: F.transform(F.slice("held", x["start"] + 1, x["end"] - x["start"]), lambda y: y["i"])))
    d = d.withColumn("n_lines", n_lines).withColumn("n_removed", n_removed).withColumn("out", out).drop("held", "gone")
    d = d.withColumn("lines", F.when(F.col("out").isNotNull(), F.split("text", "\n"))).withColumn("ends", F.concat("out", F.array(F.size("lines"))))
    before = lambda j: F.when(j > 0, F.get("ends", j - 1)).otherwise(-1)
    kept = F.flatten(F.transform("ends", lambda x, j: F.slice("lines", before(j) + 2, x - before(j) - 1)))
    bare = (F.col("n_lines") > 0) & (F.col("n_lines") == F.col("n_removed"))
    text = F.when(bare, "").when(F.col("out").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    if carry:
        kept = d.where(~bare).withColumn("text", text)
        return kept.select(*[F.col(f"others.`{c}`") if c in others else F.col(f"`{c}`") for c in docs.columns])
    return d.select("doc_id", "n_lines", "n_removed", F.coalesce("longest", F.lit(0)).alias("longest"), text.alias("text"))


LINE_DEDUP_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM docs),
held AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
runs AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS line2 FROM held),
marked AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) > 1
                     AND len(string_split_regex(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')), ' ')) >= 5 AS one,
                  line2 IS NOT NULL AND row_number() OVER (PARTITION BY line, line2 ORDER BY doc_id, pos) > 1 AS two FROM runs),
gone AS (SELECT doc_id, i, one OR two OR coalesce(lag(two) OVER (PARTITION BY doc_id ORDER BY pos), false) AS gone FROM marked)
SELECT l.doc_id, count(g.i) AS n_lines, count(*) FILTER (g.gone) AS n_removed,
       sha256(CASE WHEN count(g.i) > 0 AND count(g.i) = count(*) FILTER (g.gone) THEN ''
              ELSE coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (g.gone IS NULL OR NOT g.gone), '') END) AS kept_sha256
FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
"""
