"""Queries from lines to chunks: headings, sections, chunk assembly and the other chunkers, each with its SQL.

Their pages are documents with headings, exercises and page numbers put in by doc_id, so
that units, running heads and page maps occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as T
from ..operators import assembly, chunking, cleaning, structure
from .catalog import _CLEAN_PARTS, _LEVEL, _LINES, _NUMBERED, _PAGES, _SENTENCES, _STRIP, _WORD, _WS, _docs, _query, book_pages

_STAND_IN = """CASE WHEN doc_id % 3 = 0 THEN concat('Unit ', CASE WHEN doc_id % 6 = 0 THEN '0' ELSE '' END, doc_id // 120 % 9 + 1, chr(10)) ELSE '' END
    || CASE WHEN doc_id % 5 = 0 THEN concat('Chapter ', doc_id // 30 % 5 + 1, ': On ', lang, chr(10)) ELSE '' END
    || CASE WHEN doc_id % 4 = 0 THEN concat('Topic: part ', doc_id // 16 % 4, chr(10)) ELSE '' END
    || CASE WHEN doc_id % 11 = 0 THEN concat('Exercise', chr(10)) ELSE '' END || coalesce(text, '')
    || CASE WHEN doc_id % 7 = 0 THEN concat(chr(10), doc_id % 900 + 1) ELSE '' END"""
_BOOK_PAGES = f"pages AS (SELECT source || '-' || (doc_id // 1000) AS book, doc_id AS page, {_STAND_IN} AS text FROM documents)"
_PART = {level: L.NUMBERED[level] for level in assembly.LEVELS}
_EXTRACT = lambda k: "CASE level " + " ".join(f"WHEN '{x}' THEN regexp_extract(line, '{p}', {k})" for x, p in _PART.items())
_HEADS = rf"""held0 AS (SELECT book, page, line_no, s AS line, list_filter(string_split_regex(s, '{_WS}+'), lambda x: x <> '') AS w FROM (SELECT *, regexp_replace(line, {_STRIP}) AS s FROM lines) WHERE s <> ''),
    held1 AS (SELECT book, page, line_no, line, {_LEVEL} AS level FROM held0),
    held2 AS (SELECT *, CASE WHEN level IS NOT NULL THEN {_EXTRACT(1)} ELSE '' END END AS number, regexp_replace({_EXTRACT(2)} ELSE line END, '{L.TITLE_MARKS}', '', 'g') AS bare FROM held1),
    held AS (SELECT * EXCLUDE bare, CASE WHEN bare = '' THEN line ELSE bare END AS title,
      CASE WHEN number <> '' THEN CASE level WHEN 'unit' THEN 'Unit' WHEN 'chapter' THEN 'Chapter' ELSE 'Topic' END || ' ' || CASE WHEN regexp_matches(number, '^[0-9]+$') THEN number::HUGEINT::VARCHAR ELSE number END WHEN bare = '' THEN line ELSE bare END AS name FROM held2)"""
_HEADS = f"{_BOOK_PAGES}{_LINES[len(_PAGES):]}, {_HEADS}"
_UPTO = "ORDER BY page, line_no ROWS UNBOUNDED PRECEDING"
_ECHO = lambda of, level, keys: f"(SELECT * FROM (SELECT *, level = '{level}' AND coalesce(lag(name) OVER (PARTITION BY book{keys}, level ORDER BY page, line_no) = name, false) AS echo FROM {of}) WHERE NOT coalesce(echo, false))"
_SEQ = lambda level, of: f"(SELECT * EXCLUDE echo, count(*) FILTER (level = '{level}') OVER (PARTITION BY book {_UPTO}) AS {level}_seq FROM {of})"
_LAST = lambda level, x, name, keys: f"coalesce(last_value(CASE WHEN level = '{level}' THEN {x} END IGNORE NULLS) OVER (PARTITION BY book{keys} {_UPTO}), '') AS {name}"
_CHAIN = {"unit": "", "chapter": ", unit_seq", "topic": ", unit_seq, chapter_seq"}
_PARSED = f"""{_HEADS}, s1 AS {_SEQ("unit", _ECHO("held", "unit", _CHAIN["unit"]))}, s2 AS {_SEQ("chapter", _ECHO("s1", "chapter", _CHAIN["chapter"]))}, s3 AS {_SEQ("topic", _ECHO("s2", "topic", _CHAIN["topic"]))},
    parsed AS (SELECT book, page, line_no, line, level, count(level) OVER o AS section, coalesce(last_value(CASE WHEN level IS NOT NULL THEN level END IGNORE NULLS) OVER o, 'heading') AS section_level,
      coalesce(last_value(CASE WHEN level IS NOT NULL THEN title END IGNORE NULLS) OVER o, 'Front matter') AS section_title, {", ".join(_LAST(x, "name", x, k) + ", " + _LAST(x, "number", f"{x}_no", k) for x, k in _CHAIN.items())}
      FROM s3 WINDOW o AS (PARTITION BY book {_UPTO}))"""


def stand_in_pages(spark, sf_dir) -> DataFrame:
    book = F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 1000).cast("string"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(book.alias("book"), F.col("doc_id").alias("page"), F.expr(_STAND_IN.replace("//", "div")).alias("text"))


def _parsed(spark, sf_dir) -> DataFrame:
    return assembly.curriculum(cleaning.page_lines(stand_in_pages(spark, sf_dir)))


@_query("heading_parts", f"WITH {_HEADS} SELECT page, line_no, level, number, title, name FROM held WHERE level IS NOT NULL")
def _parts(spark, sf_dir):
    lines = cleaning.page_lines(stand_in_pages(spark, sf_dir)).select("page", "line_no", L.heading(T.strip(F.col("line"))).alias("h")).where("h is not null")
    return lines.select("page", "line_no", "h.level", "h.number", "h.title", L.canonical(F.col("h.level"), F.col("h.number"), F.col("h.title")).alias("name"))


_NAMES = ", ".join(f"{x}, {x}_no" for x in assembly.LEVELS)


@_query("curriculum_sections", f"WITH {_PARSED} SELECT page, line_no, level, section, section_level, section_title, {_NAMES} FROM parsed")
def _sections(spark, sf_dir):
    return _parsed(spark, sf_dir).drop("book", "line")


_SPLIT = _SENTENCES.replace("(text,", "(txt,")
_WALK = """steps AS (SELECT k, c, len(c)::INT AS n, 0 AS s, 0 AS e, 0 AS w, 0 AS seq, NULL::INT AS a, NULL::INT AS z, NULL::INT AS words FROM counts
    UNION ALL SELECT k, c, n, CASE WHEN more THEN s WHEN z2 >= n THEN -1 ELSE greatest(z2 - 1, s + 1) END, CASE WHEN more THEN e + 1 WHEN z2 >= n THEN -1 ELSE greatest(z2 - 1, s + 1) END,
      CASE WHEN more THEN w + c[e + 1] ELSE 0 END, seq + (NOT more)::INT, CASE WHEN NOT more THEN s END, CASE WHEN NOT more THEN z2 END, CASE WHEN NOT more THEN w2 END
    FROM (SELECT *, e < n AND (w = 0 OR w + c[e + 1] <= 120) AS more, e + (e < n AND w < 60)::INT AS z2, w + CASE WHEN e < n AND w < 60 THEN c[e + 1] ELSE 0 END AS w2 FROM steps WHERE s >= 0))"""
_LEXICAL = r"trim(regexp_replace(strip_accents(lower(text)), '[^\p{L}\p{N}_]+', ' ', 'g'))"
_ID_PART = lambda x: f"CASE WHEN {x} <> '' THEN '{x}_' || CASE WHEN regexp_matches({x}_no, '^[0-9]+$') THEN lpad({x}_no::HUGEINT::VARCHAR, greatest(2, length({x}_no::HUGEINT::VARCHAR))::INT, '0') ELSE coalesce(nullif(regexp_replace(regexp_replace(lower(CASE WHEN {x}_no <> '' THEN {x}_no ELSE {x} END), '[^a-z0-9\\x{{0600}}-\\x{{06FF}}]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'x') END END"
_CHUNKS = rf"""WITH RECURSIVE {_PARSED}, body AS (SELECT *, book || '#' || section AS k, len(regexp_extract_all(line, '{_WORD}')) AS n FROM parsed WHERE level IS NULL),
    listed AS (SELECT k, book, section, string_agg(line, chr(10) ORDER BY page, line_no) AS txt, sum(n) AS n, {", ".join(f"any_value({x}) AS {x}" for x in ("section_level", "section_title", *[y for z in assembly.LEVELS for y in (z, f"{z}_no")]))} FROM body GROUP BY k, book, section),
    cut AS (SELECT *, {_CLEAN_PARTS.format(_SPLIT)} AS snt FROM listed),
    counts AS (SELECT k, list_transform(snt, lambda x: len(regexp_extract_all(x, '{_WORD}'))::INT) AS c FROM cut WHERE len(snt) > 0 AND list_sum(list_transform(snt, lambda x: len(regexp_extract_all(x, '{_WORD}')))) = n), {_WALK},
    kids AS (SELECT k, seq - 1 AS seq, a, z, words, coalesce(list_sum(c[1:a]), 0)::INT AS w0 FROM steps WHERE a IS NOT NULL),
    g AS (SELECT k, seq, words, 0 AS parent, words AS w FROM kids WHERE seq = 0
      UNION ALL SELECT c.k, c.seq, c.words, g.parent + (g.w + c.words > 300 AND g.w >= 180)::INT, CASE WHEN g.w + c.words > 300 AND g.w >= 180 THEN c.words ELSE g.w + c.words END FROM g JOIN kids c ON c.k = g.k AND c.seq = g.seq + 1),
    spans AS (SELECT k, page, sum(n) OVER (PARTITION BY k ORDER BY page, line_no) - n AS lo, sum(n) OVER (PARTITION BY k ORDER BY page, line_no) AS hi FROM body WHERE n > 0),
    child AS (SELECT d.* EXCLUDE (snt, txt, n), c.seq, g.parent, array_to_string(snt[a + 1:z], ' ') AS text, p.page AS pdf_start, q.page AS pdf_end FROM kids c JOIN g USING (k, seq) JOIN cut d USING (k)
      JOIN spans p ON p.k = c.k AND p.lo <= w0 AND w0 < p.hi JOIN spans q ON q.k = c.k AND q.lo <= w0 + c.words - 1 AND w0 + c.words - 1 < q.hi),
    conf AS (SELECT book, page, (length(text) % 97)::DOUBLE AS confidence FROM pages),
    child2 AS (SELECT c.*, round((SELECT coalesce(sum(confidence), 0) FROM conf f WHERE f.book = c.book AND f.page BETWEEN pdf_start AND pdf_end) / (pdf_end - pdf_start + 1), 3) AS ocr_confidence FROM child c),
    parent1 AS (SELECT k, parent, any_value(book) AS book, any_value(section) AS section, string_agg(text, chr(10) ORDER BY seq) AS text, min(pdf_start) AS pdf_start, max(pdf_end) AS pdf_end, round(sum(round(ocr_confidence * 1000)::BIGINT) / count(*)) / 1000 AS ocr_confidence,
      {", ".join(f"any_value({x}) AS {x}" for x in ("section_level", "section_title", *[y for z in assembly.LEVELS for y in (z, f"{z}_no")]))} FROM child2 GROUP BY k, parent),
    parent2 AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY section, parent) - 1 AS number FROM parent1),
    parent3 AS (SELECT *, coalesce(nullif(concat_ws('_', {", ".join(_ID_PART(x) for x in assembly.LEVELS)}), ''), 'front') || '_parent_' || lpad(number::VARCHAR, greatest(3, length(number::VARCHAR))::INT, '0') AS parent_id FROM parent2),
    both_kinds AS (SELECT 'child' AS kind, c.seq, c.text, c.pdf_start, c.pdf_end, c.ocr_confidence, p.parent_id, c.book, c.section_title, {", ".join(f"c.{x}" for x in assembly.LEVELS)} FROM child2 c JOIN parent3 p USING (k, parent)
      UNION ALL SELECT 'parent', 0, text, pdf_start, pdf_end, ocr_confidence, parent_id, book, section_title, {", ".join(assembly.LEVELS)} FROM parent3),
    {_NUMBERED}, anchors AS (SELECT book, page, CASE WHEN printed IS NOT NULL THEN {{'p': page, 'q': printed}} END AS x FROM numbered),
    near AS (SELECT book, page, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY book ORDER BY page ROWS UNBOUNDED PRECEDING), first_value(x IGNORE NULLS) OVER (PARTITION BY book ORDER BY page ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS x FROM anchors),
    mapped AS (SELECT book, page, x.q + page - x.p AS printed FROM near WHERE x IS NOT NULL),
    chunks AS (SELECT b.* EXCLUDE (pdf_start, pdf_end), coalesce(m.printed, pdf_start) AS page_start, coalesce(e.printed, pdf_end) AS page_end, pdf_start AS pdf_page_start, pdf_end AS pdf_page_end FROM both_kinds b LEFT JOIN mapped m ON m.book = b.book AND m.page = pdf_start LEFT JOIN mapped e ON e.book = b.book AND e.page = pdf_end)"""


def chunks(spark, sf_dir) -> DataFrame:
    """All chunks of the stand-in books."""
    from ..sources.tables import stored

    pages = stand_in_pages(spark, sf_dir)
    page_map = structure.page_map(pages.withColumn("anchor", structure.find_page_number(F.col("text"))))
    confidence = pages.select("book", "page", (F.length("text") % 97).cast("double").alias("confidence"))
    books = pages.select("book").distinct().select("book", F.lit("board").alias("board"), F.length("book").cast("string").alias("grade"), F.lit("General").alias("subject"), F.lit("1").alias("edition"), F.lit("english").alias("language"))
    return assembly.assemble(stored(_parsed(spark, sf_dir), "parsed"), page_map, confidence, books, version="1")


@_query("chunk_assembly", _CHUNKS + rf""" SELECT sha256(book || '|' || page_start || '|' || text) AS chunk_id, parent_id, kind, md5(text) AS text, md5({_LEXICAL}) AS lexical,
    md5(CASE WHEN kind = 'parent' THEN '' WHEN concat_ws(' · ', {", ".join(f"CASE WHEN {x} <> '' THEN '{x.title()}: ' || {x} END" for x in assembly.LEVELS)}) = '' THEN text ELSE concat_ws(' · ', {", ".join(f"CASE WHEN {x} <> '' THEN '{x.title()}: ' || {x} END" for x in assembly.LEVELS)}) || ' — ' || text END) AS embed,
    page_start, page_end, pdf_page_start, pdf_page_end, book, length(book)::VARCHAR AS grade, {", ".join(assembly.LEVELS)}, section_title, ocr_confidence, seq FROM chunks""")
def _assembly(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return c.select("chunk_id", "parent_id", "kind", F.md5("text_clean").alias("text"), F.md5("text_lexical").alias("lexical"), F.md5("embed_text").alias("embed"), "page_start", "page_end", "pdf_page_start", "pdf_page_end", "book", "grade", *assembly.LEVELS, "section_title", "ocr_confidence", F.col("seq").cast("int").alias("seq"))


@_query("lexical_text", rf"SELECT doc_id, md5({_LEXICAL}) AS value FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def _lexical(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(L.lexical_text(F.col("text"))).alias("value"))


# ---------------------------------------------------------------- the other chunkers
_SIZES = f"sizes AS (SELECT doc_id, list_transform(list_prepend(0, list_transform({_CLEAN_PARTS.format(_SENTENCES)}, lambda x: len(list_filter(string_split_regex(x, '{_WS}+'), lambda y: y <> '')))), lambda x: x::INT) AS c FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)), sums AS (SELECT doc_id, list_transform(range(1, len(c) + 1), lambda i: list_sum(c[1:i])::INT) AS p, (len(c) - 1)::INT AS n FROM sizes WHERE len(c) > 1)"
_BACK = lambda want: f"greatest(s, least(z - 1, len(list_filter(p, lambda x: x <= p[z + 1] - {want})) - 1))"


def _sentence_sizes(spark, sf_dir) -> DataFrame:
    from ..sources.tables import stored

    words = lambda x: F.size(F.filter(F.split(x, rf"{T.WHITE}+"), lambda y: y != ""))
    return stored(_docs(spark, sf_dir).select("doc_id", F.transform(T.sentences(F.col("text")), words).alias("counts")), "sizes")


def _numbered_spans(sizes: DataFrame, spans) -> DataFrame:
    return sizes.select("doc_id", F.posexplode(spans).alias("seq", "x")).select("doc_id", "seq", "x.start", "x.end", "x.words")


@_query("share_chunks", f"""WITH RECURSIVE {_SIZES}, walk AS (SELECT doc_id, p, n, 0 AS seq, 0 AS s, greatest(1, least(len(list_filter(p, lambda x: x < 250)), len(list_filter(p, lambda x: x <= 350)) - 1))::INT AS z FROM sums
    UNION ALL SELECT doc_id, p, n, seq + 1, s2, greatest(s2 + 1, least(len(list_filter(p, lambda x: x < p[s2 + 1] + 250)), len(list_filter(p, lambda x: x <= p[s2 + 1] + 350)) - 1))::INT FROM (SELECT *, greatest(s + 1, {_BACK("0.2::DOUBLE * (p[z + 1] - p[s + 1])")})::INT AS s2 FROM walk WHERE z < n))
    SELECT doc_id, seq, s AS start, z AS "end", p[z + 1] - p[s + 1] AS words FROM walk""")
def _share(spark, sf_dir):
    return _numbered_spans(_sentence_sizes(spark, sf_dir), chunking.share_windows(F.col("counts")))


@_query("tail_chunks", f"""WITH RECURSIVE {_SIZES}, walk AS (SELECT doc_id, p, n, 0 AS seq, 0 AS s, len(list_filter(p, lambda x: x < 300))::INT AS z FROM sums
    UNION ALL SELECT doc_id, p, n, seq + 1, s2, greatest(z + 1, len(list_filter(p, lambda x: x < p[s2 + 1] + 300)))::INT FROM (SELECT *, {_BACK("floor(0.2::DOUBLE * (p[z + 1] - p[s + 1]))")}::INT AS s2 FROM walk WHERE z <= n))
    SELECT doc_id, seq, s AS start, least(z, n) AS "end", p[least(z, n) + 1] - p[s + 1] AS words FROM walk WHERE s < n""")
def _tail(spark, sf_dir):
    return _numbered_spans(_sentence_sizes(spark, sf_dir), chunking.tail_windows(F.col("counts")))


@_query("heading_tags", rf"""WITH {_LINES}, firsts AS (SELECT page, list({{'text': regexp_replace(line, {_STRIP}), 'heading': 'h' || line_no}} ORDER BY line_no) AS s FROM lines WHERE norm <> '' GROUP BY page)
    SELECT doc_id, list_filter(s, lambda x: contains(substr(coalesce(d.text, ''), greatest(1, length(d.text) // 2)::BIGINT), x.text))[1].heading AS heading FROM documents d JOIN firsts ON page = doc_id""")
def _tags(spark, sf_dir):
    lines = cleaning.page_lines(book_pages(spark, sf_dir)).where("norm <> ''")
    firsts = lines.groupBy(F.col("page").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("line_no", T.strip(F.col("line")).alias("text"), F.concat(F.lit("h"), "line_no").alias("heading")))).alias("s"))
    half = F.expr("substring(text, greatest(1, length(text) div 2))")
    return _docs(spark, sf_dir).join(firsts, "doc_id").select("doc_id", chunking.heading_of(F.col("s"), half).alias("heading"))
