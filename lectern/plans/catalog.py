"""Every query of the engine's own operators by name, with its SQL.

The driver tables stand in for textbooks: a page is a row of documents, a book is up to
1000 consecutive documents of one source, questions are the benchmark items.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, cleaning, evaluation, retrieval, structure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_WS = r"[ \t\n\x0B\f\r]"
_WORD = r"[\p{L}\p{N}_]+(''+[\p{L}\p{N}_]+)*"
_STRIP = rf"'^{_WS}+|{_WS}+$', '', 'g'"
_PAGES = "pages AS (SELECT source || '-' || (doc_id // 1000) AS book, doc_id AS page, coalesce(text, '') AS text FROM documents)"
_LINES = f"{_PAGES}, raw AS (SELECT book, page, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM pages), lines AS (SELECT *, lower(trim(regexp_replace(line, '{_WS}+', ' ', 'g'))) AS norm FROM raw)"
_PURE = "regexp_matches(norm, '^([0-9]{1,4}|[ivxlcdmIVXLCDM]{1,8})$')"
_HEADING = r"regexp_matches(norm, '(?i)^(unit|chapter|lesson|section|topic|module|part|exercise|question|q)([^\p{L}\p{N}_]|$)')"
_NOISE = rf"(regexp_replace(line, {_STRIP}) <> '' AND (length(regexp_replace(line, '[^\p{{L}}\p{{N}}]', '', 'g')) = 0 OR (length(line) >= 4 AND 10 * length(regexp_replace(line, '[^\p{{L}}\p{{N}}]', '', 'g')) < 3 * length(line))))"
STAMP_WORDS, STAMP_PATTERNS = ["License", "Not for sale"], [r"copyright (\(c\)|©)? ?[0-9]{4}", "(unclosed"]
_STAMP = rf"(contains(lower(line), 'license') OR contains(lower(line), 'not for sale') OR regexp_matches(regexp_replace(line, {_STRIP}), '(?i)copyright (\(c\)|©)? ?[0-9]{{4}}'))"
_LEAST = "least AS (SELECT book, greatest(2, ceil(count(*) * 0.05)) AS least FROM pages GROUP BY book HAVING count(*) >= 2)"
_EDGE = f"""edge AS (SELECT book, norm, count(*) AS hits FROM (SELECT *, row_number() OVER (PARTITION BY book, page ORDER BY line_no) AS up,
    row_number() OVER (PARTITION BY book, page ORDER BY line_no DESC) AS down FROM lines WHERE norm <> '') WHERE (up <= 3 OR down <= 3) AND NOT {_PURE} GROUP BY book, norm),
    edges AS (SELECT e.book, norm, hits FROM edge e JOIN least USING (book) WHERE hits >= least)"""
_ANY = f"anywhere AS (SELECT book, norm, count(DISTINCT page) AS hits FROM lines WHERE norm <> '' AND NOT {_PURE} GROUP BY book, norm), repeats AS (SELECT a.book, norm, hits FROM anywhere a JOIN least USING (book) WHERE hits >= least)"
_FOUND = f"{_LINES}, {_LEAST}, {_EDGE}, {_ANY}, found AS (SELECT book, norm FROM edges UNION SELECT book, norm FROM repeats)"
_SENTENCES = rf"string_split(regexp_replace(text, '([.!?۔]){_WS}+', '\1' || chr(1), 'g'), chr(1))"
_CLEAN_PARTS = rf"list_filter(list_transform({{}}, lambda x: regexp_replace(x, {_STRIP})), lambda x: x <> '')"


def _query(name: str, sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))


def book_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 1000).cast("string"))
    return _docs(spark, sf_dir).select(book.alias("book"), F.col("doc_id").alias("page"), "text")


def _scalar(name: str, column: Callable, sql: str, source: str = "documents", key: str = "doc_id", on: str = "text") -> None:
    """A query of one function over a whole table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _table(spark, sf_dir, source).select(key, column(F.coalesce(F.col(on), F.lit(""))).alias("value"))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT {key}, {sql} AS value FROM (SELECT {key}, coalesce({on}, '') AS text FROM {source})"


_words_sql = f"len(regexp_extract_all(text, '{_WORD}'))"
_stripped = f"regexp_replace(text, {_STRIP})"
_scalar("word_count", T.word_count, f"{_words_sql}::BIGINT")
_scalar("slug", T.slug, "coalesce(nullif(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\x{0600}-\\x{06FF}]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'x')")
_scalar("sentence_split_v1", lambda x: F.size(T.sentences(x)).cast("long"), f"len({_CLEAN_PARTS.format(_SENTENCES)})::BIGINT")
_scalar("sentence_split_v2", lambda x: F.md5(F.array_join(T.sentences_strict(x), "\u0002")), "md5(array_to_string(" + _CLEAN_PARTS.format(rf"string_split(regexp_replace(text, '([.!?۔\x{{061F}}]){_WS}+([A-Za-z0-9\"''\x{{0600}}-\x{{06FF}}])', '\1' || chr(1) || '\2', 'g'), chr(1))") + ", chr(2)))")
_scalar("paragraph_split", lambda x: F.size(T.paragraphs(x)).cast("long"), f"len({_CLEAN_PARTS.format(rf"string_split_regex(text, '\n{_WS}*\n')")})::BIGINT")
_scalar("token_estimate", T.estimate_tokens, "greatest(1, length(text) // 4)::BIGINT")
_scalar("truncate_text", lambda x: T.truncate(x, 80), f"CASE WHEN length(text) <= 80 THEN text ELSE regexp_replace(substr(text, 1, 77), '{_WS}+$', '') || '...' END")
_scalar("detect_lang", T.chunk_language, r"CASE WHEN length(text) > 0 AND 100 * len(regexp_extract_all(text, '[\x{0600}-\x{06FF}]')) > 15 * length(text) THEN 'ur' ELSE 'en' END")
_scalar("detect_script_lang", T.script_language, r"CASE WHEN len(regexp_extract_all(text, '[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]')) > len(regexp_extract_all(text, '[A-Za-z]')) THEN 'ur' ELSE 'en' END")
_scalar(
    "quality_score",
    T.quality_score,
    rf"CASE WHEN {_stripped} = '' OR {_words_sql} = 0 THEN 0.0 ELSE round(least(1.0, (0.4::DOUBLE) * least(1.0::DOUBLE, {_words_sql} / 40.0::DOUBLE) + (0.4::DOUBLE) * length(regexp_replace({_stripped}, '[^\p{{L}}]', '', 'g')) / greatest(1, length({_stripped})) + (0.2::DOUBLE) * least(1.0::DOUBLE, length(array_to_string(regexp_extract_all({_stripped}, '{_WORD}'), '')) / greatest(1, {_words_sql}) / 5.0::DOUBLE)), 3)::DOUBLE END",
)
_scalar(
    "markdown_strip",
    T.strip_markdown,
    r"substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '```[\s\S]*?```', '', 'g'), '`([^`]+)`', '\1', 'g'), '\*\*(.*?)\*\*', '\1', 'g'), '\*(.*?)\*', '\1', 'g'), '__(.*?)__', '\1', 'g'), '_(.*?)_', '\1', 'g'), '~~(.*?)~~', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g'), "
    + f"{_STRIP}), 1, 1000)",
)
_cues = ", ".join(f"'{w}'" for w in T.ROMAN_URDU)
_strong = ", ".join(f"'{w}'" for w in T.ROMAN_URDU_STRONG)
_asked = "list_distinct(regexp_extract_all(lower(text), '[a-z'']+'))"
_scalar(
    "query_language",
    T.query_language,
    rf"CASE WHEN regexp_matches(text, '[\x{{0600}}-\x{{06FF}}]') THEN 'urdu' WHEN len(list_intersect({_asked}, [{_strong}])) > 0 OR len(list_intersect({_asked}, [{_cues}])) >= 2 THEN 'roman_urdu' ELSE 'english' END",
    "benchmark",
    "item_id",
)
_scalar("format_duration", lambda x: T.format_duration(F.length(x).cast("long")), "CASE WHEN length(text) // 3600 > 0 THEN (length(text) // 3600) || 'h' || CASE WHEN length(text) % 3600 > 0 THEN ' ' ELSE '' END ELSE '' END || CASE WHEN length(text) % 3600 // 60 > 0 THEN (length(text) % 3600 // 60) || 'm' || CASE WHEN length(text) % 60 > 0 THEN ' ' ELSE '' END ELSE '' END || CASE WHEN length(text) % 60 > 0 OR length(text) < 60 THEN (length(text) % 60) || 's' ELSE '' END")
_scalar("json_response", lambda x: T.json_response(F.to_json(F.struct(F.struct(x.alias("content")).alias("message")))), "text")


@_query("chunk_id", "SELECT doc_id, sha256(source || '|' || CASE WHEN doc_id % 5 = 0 THEN 'None' ELSE doc_id::VARCHAR END || '|' || coalesce(text, '')) AS chunk_id FROM documents")
def _chunk_id(spark, sf_dir):
    page = F.when(F.col("doc_id") % 5 != 0, F.col("doc_id"))
    return _docs(spark, sf_dir).select("doc_id", T.chunk_id(F.col("source"), page, F.col("text")).alias("chunk_id"))


_ASKED_FOR = r"regexp_extract(lower(text), '(^|[^\p{L}\p{N}_])(unit|chapter|lesson|section|module|topic)[ \t\n\x0B\f\r]*([0-9]+)([^\p{L}\p{N}_]|$)', "
BOOKS = ["Green Book", "The"]


@_query("infer_filters", r"""SELECT conv_id, turn, nullif(regexp_extract(lower(text), '(^|[^\p{L}\p{N}_])grade[ \t\n\x0B\f\r]*([0-9]+)([^\p{L}\p{N}_]|$)', 2), '') AS grade,
    CASE WHEN k = 'unit' THEN 'Unit ' || n END AS unit, CASE WHEN k IN ('chapter', 'lesson', 'section', 'module') THEN upper(k[1]) || k[2:] || ' ' || n END AS chapter, CASE WHEN k = 'topic' THEN 'Topic ' || n END AS topic,
    CASE """ + " ".join(rf"WHEN regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_]){s}([^\p{{L}}\p{{N}}_]|$)') THEN '{s.title()}'" for s in T.SUBJECTS) + " END AS subject, CASE " + " ".join(f"WHEN contains(lower(text), '{x.lower()}') THEN '{x}'" for x in BOOKS) + f""" END AS book
    FROM (SELECT *, {_ASKED_FOR} 2) AS k, {_ASKED_FOR} 3) AS n FROM conversations)""")
def _filters(spark, sf_dir):
    found = T.inferred_filters(F.col("text"), BOOKS)
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", *[c.alias(n) for n, c in found.items()])


_QUALITY = ORACLE_SQL["quality_score"].removeprefix("SELECT doc_id, ").split(" AS value FROM")[0]


@_query("compare_quality", rf"""WITH e AS (SELECT doc_id, {_QUALITY} AS e, (length(text) % 97)::DOUBLE AS c FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
    o AS (SELECT doc_id, {_QUALITY} AS o FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[aeiou]', '|', 'g') AS text FROM documents)),
    t AS (SELECT *, round(least(1.0::DOUBLE, o * (0.6::DOUBLE + 0.4::DOUBLE * least(1.0::DOUBLE, c / 90.0::DOUBLE))), 3) AS z FROM e JOIN o USING (doc_id))
    SELECT doc_id, CASE WHEN e < 0.05 AND z < 0.05 THEN 'none' WHEN e >= z THEN CASE WHEN z >= 0.05 THEN 'merged' ELSE 'embedded' END ELSE 'ocr' END AS method FROM t""")
def _compare(spark, sf_dir):
    scanned = F.regexp_replace("text", "[aeiou]", "|")
    method = T.compare_quality(T.quality_score(F.col("text")), T.quality_score(scanned), (F.length("text") % 97).cast("double"))
    return _docs(spark, sf_dir).select("doc_id", method.alias("method"))


# ---------------------------------------------------------------- lines and cleaning
@_query("norm_line", f"WITH {_LINES} SELECT page, line_no, norm FROM lines")
def _norm(spark, sf_dir):
    return cleaning.page_lines(book_pages(spark, sf_dir)).select("page", "line_no", "norm")


@_query("line_kinds", rf"""WITH {_LINES} SELECT page, count(*) FILTER ({_NOISE}) AS noise, count(*) FILTER ({_HEADING}) AS heading_like, count(*) FILTER ({_PURE}) AS pure_number,
    count(*) FILTER (contains(line, '|') OR len(list_filter(list_transform(string_split_regex(line, '{_WS}{{2,}}'), lambda x: regexp_replace(x, {_STRIP})), lambda x: x <> '')) >= 2) AS table_line FROM lines GROUP BY page""")
def _kinds(spark, sf_dir):
    line, norm = F.col("line"), F.col("norm")
    return cleaning.page_lines(book_pages(spark, sf_dir)).groupBy("page").agg(F.count_if(T.is_noise(line)).alias("noise"), F.count_if(T.is_heading_like(norm)).alias("heading_like"), F.count_if(T.is_pure_number(norm)).alias("pure_number"), F.count_if(T.is_table_line(line)).alias("table_line"))


@_query("header_footer_artifacts", f"WITH {_LINES}, {_LEAST}, {_EDGE} SELECT book, norm, hits FROM edges")
def _edges(spark, sf_dir):
    return cleaning.edge_artifacts(book_pages(spark, sf_dir), 0.05)


@_query("repeated_lines", f"WITH {_LINES}, {_LEAST}, {_ANY} SELECT book, norm, hits FROM repeats")
def _repeats(spark, sf_dir):
    return cleaning.repeated_lines(book_pages(spark, sf_dir), 0.05)


@_query("inpage_repeat", f"WITH {_LINES} SELECT book, page, norm, count(*) AS hits FROM lines WHERE norm <> '' AND NOT {_HEADING} GROUP BY ALL HAVING count(*) >= 3")
def _inpage(spark, sf_dir):
    return cleaning.in_page_repeats(book_pages(spark, sf_dir))


@_query("keyword_watermark", f"WITH {_LINES} SELECT DISTINCT book, page, norm FROM lines WHERE norm <> '' AND {_STAMP}")
def _keyword(spark, sf_dir):
    return cleaning.keyword_lines(book_pages(spark, sf_dir), STAMP_WORDS, STAMP_PATTERNS)


@_query("artifact_union", f"WITH {_FOUND} SELECT book, norm FROM found")
def _union(spark, sf_dir):
    return cleaning.artifacts(book_pages(spark, sf_dir), 0.05, 0.05)


@_query("artifact_anti_join", f"WITH {_FOUND} SELECT page, line_no, line FROM lines l WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.book = l.book AND f.norm = l.norm) AND (NOT {_NOISE} OR {_HEADING})")
def _anti(spark, sf_dir):
    pages = book_pages(spark, sf_dir)
    return cleaning.remove_artifacts(pages, cleaning.artifacts(pages, 0.05, 0.05)).select("page", "line_no", "line")


@_query("artifact_intersection", f"WITH {_FOUND} SELECT l.page, count(DISTINCT l.norm) AS removed FROM lines l JOIN found f ON f.book = l.book AND f.norm = l.norm GROUP BY l.page")
def _intersection(spark, sf_dir):
    pages = book_pages(spark, sf_dir)
    hit = cleaning.page_lines(pages).join(cleaning.artifacts(pages, 0.05, 0.05), ["book", "norm"], "left_semi")
    return hit.select("page", "norm").distinct().groupBy("page").agg(F.count("*").alias("removed"))


_KEPT_WORDS = r"(?i)^(unit|chapter|lesson|section|topic|module|part|exercise|question|q)([^\p{L}\p{N}_]|$)"
_CLEANED = rf"""{_FOUND}, @NUMBERED@, stamped AS (SELECT DISTINCT page, norm FROM lines WHERE norm <> '' AND {_STAMP} UNION SELECT page, printed::VARCHAR FROM numbered WHERE printed IS NOT NULL),
    marked AS (SELECT l.book, l.page, line_no, norm, regexp_replace(line, {_STRIP}) AS line, f.norm IS NOT NULL OR s.norm IS NOT NULL AS artifact FROM lines l LEFT JOIN found f USING (book, norm) LEFT JOIN stamped s USING (page, norm)),
    kinds AS (SELECT *, line <> '' AND (contains(line, '|') OR len(list_filter(string_split_regex(line, '{_WS}{{2,}}'), lambda x: x <> '')) >= 2) AS t, regexp_matches(line, '{_KEPT_WORDS}') AS h FROM marked),
    beside AS (SELECT *, coalesce(lead(t) OVER (PARTITION BY page ORDER BY line_no), false) AS n FROM kinds),
    codes AS (SELECT page, list_reduce(list_prepend({{'o': '', 'l': 0, 't': false, 'a': false, 'h': false, 'n': false}}, list({{'o': '', 'l': 0, 't': t, 'a': artifact, 'h': h, 'n': n}} ORDER BY line_no)),
      lambda s, x: {{'o': s.o || CASE WHEN x.t AND (s.l > 0 OR (NOT x.a AND x.n)) THEN 't' WHEN x.h AND NOT x.a THEN 'h' ELSE '-' END, 'l': CASE WHEN x.t AND s.l > 0 THEN s.l - 1 WHEN x.t AND NOT x.a AND x.n THEN 11 ELSE 0 END, 't': false, 'a': false, 'h': false, 'n': false}}).o AS code FROM beside GROUP BY page),
    typed AS (SELECT k.*, substr(code, (line_no + 1)::BIGINT, 1) AS code FROM kinds k JOIN codes USING (page)),
    gone AS (SELECT page, count(DISTINCT norm) AS removed FROM typed WHERE artifact AND line <> '' GROUP BY page),
    stay AS (SELECT *, count(*) FILTER (line <> '' AND code = '-') OVER (PARTITION BY page, norm) AS again FROM typed WHERE line = '' OR code <> '-' OR (NOT artifact AND (h OR NOT {_NOISE}))),
    blocks AS (SELECT *, count(*) FILTER (line = '') OVER (PARTITION BY page ORDER BY line_no) AS block FROM stay WHERE line = '' OR code <> '-' OR again < 3 OR h),
    fresh AS (SELECT *, (code <> '-' OR coalesce(lag(code) OVER (PARTITION BY page, block ORDER BY line_no) <> '-', true))::INT AS fresh FROM blocks WHERE line <> ''),
    parts AS (SELECT *, sum(fresh) OVER (PARTITION BY page ORDER BY line_no) AS part FROM fresh),
    ends AS (SELECT *, regexp_replace(line, '{_WS}+', ' ', 'g') AS flat, lead(line_no) OVER (PARTITION BY page, part ORDER BY line_no) IS NULL AS last FROM parts),
    texts AS (SELECT page, block, part, string_agg(CASE WHEN code <> '-' THEN line WHEN last THEN flat WHEN ends_with(flat, '-') THEN flat[:-2] ELSE flat || ' ' END, '' ORDER BY line_no) AS text FROM ends GROUP BY page, block, part),
    joined AS (SELECT page, block, string_agg(text, chr(10) ORDER BY part) AS text FROM texts GROUP BY page, block),
    clean AS (SELECT page, string_agg(text, chr(10) || chr(10) ORDER BY block) AS clean_text FROM joined GROUP BY page)"""


def _clean(spark, sf_dir):
    return cleaning.clean_pages(book_pages(spark, sf_dir), 0.05, 0.05, STAMP_WORDS, STAMP_PATTERNS).select("page", "clean_text", "removed", "printed")


QUERIES["clean_pages"] = _clean


# ---------------------------------------------------------------- structure
_LEVEL = rf"""CASE WHEN regexp_matches(line, '(?i)^(unit|part){_WS}*[0-9ivxlcdmIVXLCDM]+') THEN 'unit' WHEN regexp_matches(line, '(?i)^(chapter|lesson|section|module){_WS}*[0-9ivxlcdmIVXLCDM]+') THEN 'chapter'
    WHEN regexp_matches(line, '(?i)^topic') THEN 'topic' WHEN regexp_matches(line, '(?i)^exercise([^\p{{L}}\p{{N}}_]|$)') THEN 'exercise'
    WHEN length(line) BETWEEN 2 AND 60 AND NOT regexp_matches(line, '[.!?۔]$') AND NOT regexp_matches(line, '^[0-9]+$') AND len(w) BETWEEN 1 AND 8 AND 10 * len(list_filter(w, lambda x: regexp_matches(x, '^\p{{Lu}}'))) >= 7 * len(w) THEN 'heading' END"""
_HELD = rf"{_LINES}, held AS (SELECT book, page, line_no, s AS line, list_filter(string_split_regex(s, '{_WS}+'), lambda x: x <> '') AS w FROM (SELECT *, regexp_replace(line, {_STRIP}) AS s FROM lines) WHERE s <> ''), levels AS (SELECT *, {_LEVEL} AS level FROM held)"


@_query("detect_heading", f"WITH {_HELD} SELECT page, line_no, level FROM levels WHERE level IS NOT NULL")
def _heading(spark, sf_dir):
    lines = cleaning.page_lines(book_pages(spark, sf_dir)).withColumn("line", T.strip(F.col("line"))).where("line <> ''")
    return lines.select("page", "line_no", T.heading_level(F.col("line")).alias("level")).where("level is not null")


@_query("sectionize", f"""WITH {_HELD} SELECT page, line_no, count(level) OVER o AS section, last_value(CASE WHEN level = 'unit' THEN line END IGNORE NULLS) OVER o AS unit,
    coalesce(last_value(CASE WHEN level IS NOT NULL THEN line END IGNORE NULLS) OVER o, 'Front matter') AS title FROM levels WINDOW o AS (PARTITION BY book ORDER BY page, line_no ROWS UNBOUNDED PRECEDING)""")
def _sections(spark, sf_dir):
    return structure.sections(cleaning.page_lines(book_pages(spark, sf_dir))).select("page", "line_no", "section", "unit", "title")


@_query("context_carry", f"""WITH {_HELD}, u AS (SELECT *, count(*) FILTER (level = 'unit') OVER (PARTITION BY book ORDER BY page, line_no ROWS UNBOUNDED PRECEDING) AS unit_no FROM levels)
    SELECT page, line_no, last_value(CASE WHEN level = 'chapter' THEN line END IGNORE NULLS) OVER (PARTITION BY book, unit_no ORDER BY page, line_no ROWS UNBOUNDED PRECEDING) AS chapter FROM u""")
def _carry(spark, sf_dir):
    return structure.sections(cleaning.page_lines(book_pages(spark, sf_dir))).select("page", "line_no", "chapter")


@_query("page_map_asof", f"""WITH {_PAGES}, a AS (SELECT book, page, CASE WHEN page % 11 = 3 THEN {{'p': page, 'q': 2 * page + 1}} END AS k FROM pages),
    b AS (SELECT book, page, coalesce(last_value(k IGNORE NULLS) OVER (PARTITION BY book ORDER BY page ROWS UNBOUNDED PRECEDING), first_value(k IGNORE NULLS) OVER (PARTITION BY book ORDER BY page ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS k FROM a)
    SELECT book, page, k.q + page - k.p AS printed FROM b WHERE k IS NOT NULL""")
def _page_map(spark, sf_dir):
    pages = book_pages(spark, sf_dir).withColumn("anchor", F.when(F.col("page") % 11 == 3, 2 * F.col("page") + 1))
    return structure.page_map(pages)


_NUMBERED = rf"""lines_of AS (SELECT book, page, list_filter(list_transform(string_split_regex(text, '{structure.LINE_ENDS}'), lambda x: regexp_replace(x, '^{structure.BLANK}+|{structure.BLANK}+$', '', 'g')), lambda x: x <> '') AS l FROM pages),
    numbered AS (SELECT book, page, translate(list_filter(l[:3] || l[greatest(len(l) - 2, 1):], lambda x: regexp_matches(x, '^\p{{Nd}}{{1,4}}$'))[1], '{structure.DIGITS}', '{structure.ASCII_DIGITS}')::INT AS printed FROM lines_of)"""


ORACLE_SQL["clean_pages"] = "WITH " + _CLEANED.replace("@NUMBERED@", _NUMBERED) + " SELECT p.page, coalesce(clean_text, '') AS clean_text, coalesce(removed, 0) AS removed, printed FROM pages p LEFT JOIN clean USING (page) LEFT JOIN gone USING (page) JOIN numbered USING (page)"


@_query("page_number", f"WITH {_PAGES}, {_NUMBERED} SELECT page, printed FROM numbered")
@_query("printed_page_number", f"WITH {_PAGES}, {_NUMBERED} SELECT page, printed FROM numbered")
def _printed(spark, sf_dir):
    return book_pages(spark, sf_dir).select("page", structure.find_page_number(F.col("text")).alias("printed"))


@_query("page_map_printed", f"""WITH {_PAGES}, {_NUMBERED}, a AS (SELECT book, page, CASE WHEN printed IS NOT NULL THEN {{'p': page, 'q': printed}} END AS k FROM numbered),
    b AS (SELECT book, page, coalesce(last_value(k IGNORE NULLS) OVER (PARTITION BY book ORDER BY page ROWS UNBOUNDED PRECEDING), first_value(k IGNORE NULLS) OVER (PARTITION BY book ORDER BY page ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS k FROM a)
    SELECT book, page, k.q + page - k.p AS printed FROM b WHERE k IS NOT NULL""")
def _page_map_printed(spark, sf_dir):
    return structure.page_map(book_pages(spark, sf_dir).withColumn("anchor", structure.find_page_number(F.col("text"))))


@_query("book_match", """WITH stems AS (SELECT lower(n_name) || '_file' AS stem FROM nation UNION SELECT substr(n_name, 1, 3) FROM nation)
    SELECT stem, min_by(n_name, n_nationkey) AS book FROM stems JOIN nation ON contains(lower(stem), lower(n_name)) OR contains(lower(n_name), lower(stem)) GROUP BY stem""")
def _match(spark, sf_dir):
    n = _table(spark, sf_dir, "nation")
    stems = n.select(F.concat(F.lower("n_name"), F.lit("_file")).alias("stem")).union(n.select(F.substring("n_name", 1, 3).alias("stem"))).distinct()
    return structure.match_books(stems, n.select(F.col("n_name").alias("book"), F.col("n_nationkey").alias("ordinal")))


# ---------------------------------------------------------------- chunks
_COUNTS = f"counts AS (SELECT doc_id, list_transform({_CLEAN_PARTS.format(_SENTENCES)}, lambda x: len(regexp_extract_all(x, '{_WORD}'))::INT) AS c FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))"
_FOLD = """steps AS (SELECT doc_id, c, len(c)::INT AS n, 0 AS s, 0 AS e, 0 AS w, 0 AS seq, NULL::INT AS a, NULL::INT AS z, NULL::INT AS words FROM counts WHERE len(c) > 0
    UNION ALL SELECT doc_id, c, n, CASE WHEN more THEN s WHEN z2 >= n THEN -1 ELSE greatest(z2 - 1, s + 1) END, CASE WHEN more THEN e + 1 WHEN z2 >= n THEN -1 ELSE greatest(z2 - 1, s + 1) END,
      CASE WHEN more THEN w + c[e + 1] ELSE 0 END, seq + (NOT more)::INT, CASE WHEN NOT more THEN s END, CASE WHEN NOT more THEN z2 END, CASE WHEN NOT more THEN w2 END
    FROM (SELECT *, e < n AND (w = 0 OR w + c[e + 1] <= 120) AS more, e + (e < n AND w < 60)::INT AS z2, w + CASE WHEN e < n AND w < 60 THEN c[e + 1] ELSE 0 END AS w2 FROM steps WHERE s >= 0))"""
_CHILDREN = f"{_COUNTS}, {_FOLD}, children AS (SELECT doc_id, (seq - 1)::INT AS seq, a AS start, z AS \"end\", words FROM steps WHERE a IS NOT NULL)"


def _sentence_counts(spark, sf_dir) -> DataFrame:
    from ..sources.tables import stored

    d = _docs(spark, sf_dir).select("doc_id", T.sentences(F.col("text")).alias("s"))
    return stored(d.select("doc_id", F.transform("s", lambda x: T.word_count(x).cast("int")).alias("counts")), "counts")


@_query("child_chunks", f"WITH RECURSIVE {_CHILDREN} SELECT * FROM children")
def _children(spark, sf_dir):
    return chunking.child_chunks(_sentence_counts(spark, sf_dir))


@_query("parent_groups", f"""WITH RECURSIVE {_CHILDREN}, g AS (SELECT doc_id, seq, words, 0 AS parent, words AS w FROM children WHERE seq = 0
    UNION ALL SELECT c.doc_id, c.seq, c.words, g.parent + (g.w > 0 AND g.w + c.words > 300 AND g.w >= 180)::INT, CASE WHEN g.w > 0 AND g.w + c.words > 300 AND g.w >= 180 THEN c.words ELSE g.w + c.words END FROM g JOIN children c ON c.doc_id = g.doc_id AND c.seq = g.seq + 1)
    SELECT doc_id, seq, words, parent FROM g""")
def _parents(spark, sf_dir):
    return chunking.parent_groups(chunking.child_chunks(_sentence_counts(spark, sf_dir)))


@_query("parent_rollup", f"""WITH RECURSIVE {_CHILDREN}, g AS (SELECT doc_id, seq, start, "end", words, 0 AS parent, words AS w FROM children WHERE seq = 0
    UNION ALL SELECT c.doc_id, c.seq, c.start, c."end", c.words, g.parent + (g.w > 0 AND g.w + c.words > 300 AND g.w >= 180)::INT, CASE WHEN g.w > 0 AND g.w + c.words > 300 AND g.w >= 180 THEN c.words ELSE g.w + c.words END FROM g JOIN children c ON c.doc_id = g.doc_id AND c.seq = g.seq + 1)
    SELECT doc_id, parent, count(*) AS n, min(start) AS start, max("end") AS "end", sum(words)::BIGINT AS words FROM g GROUP BY doc_id, parent""")
def _rollup(spark, sf_dir):
    children = chunking.child_chunks(_sentence_counts(spark, sf_dir))
    both = chunking.parent_groups(children).join(children.select("doc_id", "seq", "start", "end"), ["doc_id", "seq"])
    return both.groupBy("doc_id", "parent").agg(F.count("*").alias("n"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"))


@_query("v2_chunks", f"""WITH RECURSIVE parts AS (SELECT doc_id, unnest({_CLEAN_PARTS.format(rf"string_split_regex(text, '\n{_WS}*\n')")}) AS text, unnest(range(len({_CLEAN_PARTS.format(rf"string_split_regex(text, '\n{_WS}*\n')")})))::INT AS part FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
    counts AS (SELECT doc_id, part, list_transform({_CLEAN_PARTS.format(_SENTENCES)}, lambda x: len(list_filter(string_split_regex(x, '{_WS}+'), lambda y: y <> ''))::INT) AS c FROM parts),
    steps AS (SELECT doc_id, part, c, len(c)::INT AS n, 0 AS s, 0 AS e, 0 AS w, 0 AS seq, NULL::INT AS a, NULL::INT AS z, NULL::INT AS words FROM counts WHERE len(c) > 0
    UNION ALL SELECT doc_id, part, c, n, CASE WHEN more THEN s WHEN e >= n THEN -1 ELSE greatest(e - 1, s + 1) END, CASE WHEN more THEN e + 1 WHEN e >= n THEN -1 ELSE greatest(e - 1, s + 1) END,
      CASE WHEN more THEN w + c[e + 1] ELSE 0 END, seq + (NOT more)::INT, CASE WHEN NOT more THEN s END, CASE WHEN NOT more THEN e END, CASE WHEN NOT more THEN w END
    FROM (SELECT *, e < n AND (e = s OR w + c[e + 1] <= 90) AND NOT (e > s AND w >= 40) AS more FROM steps WHERE s >= 0))
    SELECT doc_id, part, (seq - 1)::INT AS seq, a AS start, z AS "end", words FROM steps WHERE a IS NOT NULL""")
def _v2(spark, sf_dir):
    from ..sources.tables import stored

    parts = _docs(spark, sf_dir).select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("part", "p"))
    counts = parts.select("doc_id", "part", F.transform(T.sentences(F.col("p")), lambda x: F.size(F.filter(F.split(x, rf"{T.WHITE}+"), lambda y: y != ""))).alias("counts"))
    return chunking.topic_chunks(stored(counts, "topic-counts"))


@_query("fixed_window_chunks", f"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '{_WS}+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT doc_id, w, unnest(range(0, len(w), 340)) AS start FROM w WHERE len(w) > 0)
    SELECT doc_id, (start // 340)::INT AS seq, start::INT AS start, len(w[start + 1 : start + 400])::INT AS words, md5(array_to_string(w[start + 1 : start + 400], ' ')) AS digest FROM s WHERE len(w[start + 1 : start + 400]) >= 25""")
def _fixed(spark, sf_dir):
    return chunking.fixed_windows(_docs(spark, sf_dir).select("doc_id", "text"))


@_query("chunk_links", f"WITH RECURSIVE {_CHILDREN} SELECT doc_id, seq, lag(seq) OVER (PARTITION BY doc_id ORDER BY seq) AS previous, lead(seq) OVER (PARTITION BY doc_id ORDER BY seq) AS next FROM children")
def _links(spark, sf_dir):
    return chunking.chunk_links(chunking.child_chunks(_sentence_counts(spark, sf_dir)))


# ---------------------------------------------------------------- retrieval
def _questions(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("q"), "text")


def _texts(spark, sf_dir) -> DataFrame:
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")


def _vector_hits(spark, sf_dir, where: str = "true") -> DataFrame:
    v = _table(spark, sf_dir, "embeddings")
    queries = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), "embedding")
    return retrieval.vector_topk(v.where(where), queries)


def _topk_sql(where: str = "true") -> str:
    return f"""SELECT q, vec_id, distance, row_number() OVER (PARTITION BY q ORDER BY distance, vec_id) AS rank FROM (
    SELECT a.vec_id AS q, b.vec_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND {where}) QUALIFY rank <= 20"""


_TERMS = "terms AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')) AS term FROM documents), postings AS (SELECT id, term, count(*) AS tf FROM terms GROUP BY ALL)"
_BM25 = (
    _TERMS
    + """, lengths AS (SELECT id, count(*) AS dl FROM terms GROUP BY id), df AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
    asked AS (SELECT DISTINCT item_id AS q, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM benchmark WHERE item_id % 20 = 0),
    scored AS (SELECT q, id, round(sum(ln(1 + ((SELECT count(*) FROM documents) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (SELECT avg(dl) FROM lengths)))), 6) AS score
      FROM asked JOIN postings USING (term) JOIN df USING (term) JOIN lengths USING (id) GROUP BY q, id),
    bm25 AS (SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 20)"""
)
_VEC = f"vec AS ({_topk_sql()})"
_FUSED = f"""{_BM25}, {_VEC}, fused0 AS (SELECT q, id, round(sum(part), 9) AS score FROM (SELECT q, vec_id AS id, 1 / (60 + rank)::DOUBLE AS part FROM vec UNION ALL SELECT q, id, 1 / (60 + rank)::DOUBLE FROM bm25) GROUP BY q, id),
    fused AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM fused0)"""


@_query("vector_topk", _topk_sql())
def _vectors(spark, sf_dir):
    return _vector_hits(spark, sf_dir)


@_query("vector_topk_filtered", _topk_sql("b.label IN (1, 3)"))
def _vectors_filtered(spark, sf_dir):
    return _vector_hits(spark, sf_dir, "label in (1, 3)")


@_query("term_stats", f"WITH {_TERMS} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM postings GROUP BY term")
def _stats(spark, sf_dir):
    return retrieval.term_stats(_texts(spark, sf_dir))


@_query("bm25_topk", f"WITH {_BM25} SELECT * FROM bm25")
def _bm25(spark, sf_dir):
    return retrieval.bm25_topk(_texts(spark, sf_dir), _questions(spark, sf_dir))


def _vec_list(spark, sf_dir) -> DataFrame:
    return _vector_hits(spark, sf_dir).select("q", F.col("vec_id").alias("id"), "rank")


def _fused(spark, sf_dir) -> DataFrame:
    return retrieval.fuse((_vec_list(spark, sf_dir), 1), (_bm25(spark, sf_dir), 1))


@_query("rrf_fuse", f"WITH {_FUSED} SELECT q, id, score, rank FROM fused")
def _rrf(spark, sf_dir):
    return _fused(spark, sf_dir)


@_query("hybrid_search", f"WITH {_FUSED} SELECT q, id, score, rank FROM fused WHERE rank <= 5")
def _hybrid(spark, sf_dir):
    return _fused(spark, sf_dir).where("rank <= 5")


@_query("weighted_rrf", f"""WITH {_BM25}, {_VEC}, f AS (SELECT q, id, round(sum(part), 9) AS score FROM (SELECT q, vec_id AS id, 0.6::DOUBLE / (60 + rank) AS part FROM vec WHERE rank <= 5 UNION ALL SELECT q, id, 0.4::DOUBLE / (60 + rank) FROM bm25 WHERE rank <= 5) GROUP BY q, id)
    SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM f""")
def _weighted(spark, sf_dir):
    return retrieval.fuse((_vec_list(spark, sf_dir).where("rank <= 5"), 0.6), (_bm25(spark, sf_dir).where("rank <= 5"), 0.4))


_FALLBACK = f"""{_BM25}, {_VEC}, keys AS (SELECT vec_id AS q, vec_id // 20 % 13 AS key FROM embeddings WHERE vec_id % 20 = 0),
    vf AS ({_topk_sql("b.label = a.vec_id // 20 % 13")}), tf AS (SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM scored JOIN documents ON doc_id = id WHERE doc_id % 13 = q // 20 % 13 AND doc_id % 2 = 0 QUALIFY rank <= 20),
    found AS (SELECT q FROM vf UNION SELECT q FROM tf)"""


@_query("filter_fallback", f"""WITH {_FALLBACK} SELECT 'vector' AS list, q, vec_id AS id, distance AS score, rank FROM vf UNION ALL SELECT 'text', q, id, score, rank FROM tf
    UNION ALL SELECT 'vector', q, vec_id, distance, rank FROM vec WHERE q NOT IN (SELECT q FROM found) UNION ALL SELECT 'text', q, id, score, rank FROM bm25 WHERE q NOT IN (SELECT q FROM found)""")
def _fallback(spark, sf_dir):
    from ..sources.tables import stored

    v = _table(spark, sf_dir, "embeddings")
    queries = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), "embedding", F.expr("vec_id div 20 % 13").alias("label"))
    questions = _questions(spark, sf_dir)
    indexed = retrieval.asked_index(_texts(spark, sf_dir), questions)
    # the text list's filter: per question, so scores are kept before they are ranked
    own = _texts(spark, sf_dir).where("id % 2 = 0").select("id")
    text = retrieval.best_scores(retrieval.bm25_scores(indexed, questions, own).where("id % 13 = q div 20 % 13"))
    filtered = (retrieval.vector_topk(v, queries, key="label"), text)
    filtered = tuple(stored(x, "filtered") for x in filtered)
    one, two, _ = retrieval.with_fallback_both(filtered, (retrieval.vector_topk(v, queries.drop("label")), retrieval.bm25_search(indexed, questions)))
    return one.select(F.lit("vector").alias("list"), "q", F.col("vec_id").alias("id"), F.col("distance").alias("score"), "rank").union(two.select(F.lit("text"), "q", "id", "score", "rank"))


@_query("bm25_topk_filtered", f"WITH {_BM25} SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM scored JOIN documents ON doc_id = id WHERE lang IN ('en', 'de') QUALIFY rank <= 20")
def _bm25_filtered(spark, sf_dir):
    from ..operators.store import predicate

    ids = _table(spark, sf_dir, "documents").where(predicate({"lang": ["en", "de"]})).select(F.col("doc_id").alias("id"))
    return retrieval.bm25_topk(_texts(spark, sf_dir), _questions(spark, sf_dir), ids=ids)


@_query("expand_parent", f"WITH {_FUSED} SELECT q, f.id, rank, source, n_chars FROM fused f LEFT JOIN documents d ON d.doc_id = f.id WHERE rank <= 5")
def _parent(spark, sf_dir):
    parents = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "n_chars")
    return _fused(spark, sf_dir).where("rank <= 5").join(parents, "id", "left").select("q", "id", "rank", "source", "n_chars")


@_query("expand_siblings", f"""WITH {_FUSED}, {_PAGES}, hit AS (SELECT q, id, rank, book FROM fused JOIN pages ON page = id WHERE rank <= 5), s AS (SELECT q, id, rank, p.page FROM hit h JOIN pages p ON p.book = h.book AND p.page <> h.id QUALIFY row_number() OVER (PARTITION BY q, id ORDER BY p.page) <= 50)
    SELECT q, id, rank, array_to_string(list(page ORDER BY page), ',') AS siblings FROM s GROUP BY ALL""")
def _siblings(spark, sf_dir):
    pages = book_pages(spark, sf_dir).select("book", F.col("page").alias("id"))
    hits = _fused(spark, sf_dir).where("rank <= 5").join(pages, "id")
    # a book has at most 1000 pages, so this list is bounded
    listed = pages.groupBy("book").agg(F.sort_array(F.collect_list("id")).alias("all"))
    own = F.slice(F.filter("all", lambda x: x != F.col("id")), 1, 50)
    return hits.join(listed, "book").where(F.size(own) > 0).select("q", "id", "rank", F.array_join(own.cast("array<string>"), ",").alias("siblings"))


@_query("gate_context", f"""WITH {_FUSED}, b AS (SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, rank) AS place, greatest(1, length(coalesce(text, '')) // 4)::BIGINT AS tokens FROM fused JOIN documents ON doc_id = id WHERE score >= 0.015 QUALIFY place <= 5),
    r AS (SELECT *, sum(tokens) OVER (PARTITION BY q ORDER BY place ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM b) SELECT q, id, place, tokens, running FROM r WHERE place = 1 OR running <= 1200""")
def _gate(spark, sf_dir):
    # the gate looks at the size of a text only
    tokens = _texts(spark, sf_dir).select("id", T.estimate_tokens(F.col("text")).alias("tokens"))
    blocks = _fused(spark, sf_dir).join(tokens, "id")
    return retrieval.gate(blocks, 0.015).select("q", "id", "place", "tokens", "running")


# ---------------------------------------------------------------- evaluation and checks
_CATEGORY = "list_value(" + ", ".join(f"'{c}'" for c in evaluation.CATEGORIES) + ")[doc_id % 6 + 1]"
_RESULTS = f"""r AS (SELECT doc_id, {_CATEGORY} AS category, CASE WHEN doc_id % 6 < 4 THEN 'answer' ELSE 'decline' END AS expected, round(least(1.0, n_chars / 5000.0)::DOUBLE, 2) AS top_score, coalesce(text, '') AS text FROM documents),
    e AS (SELECT *, top_score < 0.2 AS declined, top_score >= 0.2 AND doc_id % 7 <> 0 AS grounded, (top_score < 0.2) = (expected = 'decline') AS correct, contains(lower(text), 'license') AS watermark_leak FROM r)"""


def eval_results(spark, sf_dir):
    kinds = F.array(*map(F.lit, evaluation.CATEGORIES))
    d = _docs(spark, sf_dir)
    # the double's own hundredths are rounded, as the SQL does; round(x, 2) would round what is printed (0.145)
    score = F.round(F.least(F.lit(1.0), F.col("n_chars") / 5000.0) * 100) / 100
    r = d.select("doc_id", F.get(kinds, (F.col("doc_id") % 6).cast("int")).alias("category"), F.when(F.col("doc_id") % 6 < 4, "answer").otherwise("decline").alias("expected"), score.alias("top_score"), "text")
    declined = F.col("top_score") < 0.2
    return r.withColumn("declined", declined).withColumn("grounded", ~declined & (F.col("doc_id") % 7 != 0)).withColumn("correct", declined == (F.col("expected") == "decline")).withColumn("watermark_leak", cleaning.is_stamp(F.col("text"), ["License"]))


_rate = lambda good, of: f"round(count(*) FILTER ({good} AND {of}) / nullif(count(*) FILTER ({of}), 0)::DOUBLE, 4)"
_ANSWERED, _OTHER = (f"category IN ({', '.join(repr(c) for c in x)})" for x in (evaluation.ANSWERED, evaluation.CATEGORIES[4:]))


@_query("eval_metrics", f"WITH {_RESULTS} SELECT count(*) AS total, {_rate('NOT declined', _ANSWERED)} AS hit_rate, {_rate('grounded', _ANSWERED + ' AND NOT declined')} AS groundedness, {_rate('correct', _OTHER)} AS decline_accuracy, {_rate('declined', _ANSWERED)} AS false_decline_rate, {_rate('correct', 'true')} AS overall_accuracy, {_rate('watermark_leak', 'true')} AS watermark_leak_rate FROM e")
def _metrics(spark, sf_dir):
    return evaluation.metrics(eval_results(spark, sf_dir))


@_query("eval_per_category", f"WITH {_RESULTS} SELECT c.category, count(e.doc_id) AS n, round(count(*) FILTER (correct) / nullif(count(e.doc_id), 0)::DOUBLE, 4) AS correct FROM (SELECT unnest([{', '.join(repr(c) for c in evaluation.CATEGORIES)}]) AS category) c LEFT JOIN e USING (category) GROUP BY c.category")
def _categories(spark, sf_dir):
    return evaluation.by_category(eval_results(spark, sf_dir))


_SWEEP = f"""{_RESULTS}, t AS (SELECT DISTINCT top_score AS t FROM e UNION SELECT 0.0::DOUBLE UNION SELECT max(top_score) + 1e-6::DOUBLE FROM e),
    s AS (SELECT t, count(*) FILTER ((top_score >= t) = (expected = 'answer')) AS good, count(*) FILTER (top_score < t AND expected = 'answer') AS fd, count(*) FILTER (top_score < t AND expected <> 'answer') AS td, count(*) FILTER (expected = 'answer') AS answers, count(*) FILTER (expected <> 'answer') AS declines, count(*) AS n FROM t, e GROUP BY t)"""


@_query("calibrate_threshold", f"""WITH {_SWEEP} SELECT round(t, 6) AS threshold, round(good / n::DOUBLE, 4) AS accuracy, fd AS false_declines, round(fd / nullif(answers, 0)::DOUBLE, 4) AS false_decline_rate, round(td / nullif(declines, 0)::DOUBLE, 4) AS decline_accuracy FROM s ORDER BY good DESC, fd, t DESC LIMIT 1""")
def _calibrate(spark, sf_dir):
    return evaluation.calibrate(eval_results(spark, sf_dir))


@_query("calibration_sweep", f"WITH {_SWEEP} SELECT round(t, 6) AS t, good AS right, fd AS false_declines, td AS true_declines, answers, declines FROM s")
def _swept(spark, sf_dir):
    return evaluation.sweep(eval_results(spark, sf_dir)).withColumn("t", F.round("t", 6))


@_query("vector_norm_check", "SELECT label, count(*) AS n, count(*) FILTER (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) < 0.5) AS weak, round(avg(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 4) AS mean_norm FROM embeddings GROUP BY label")
def _norms(spark, sf_dir):
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return _table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.count_if(norm < 0.5).alias("weak"), F.round(F.avg(norm), 4).alias("mean_norm"))


@_query("store_stats", "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'pages', count(*) FROM pages")
def _store(spark, sf_dir):
    parts = [_table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in ("documents", "embeddings", "pages")]
    return parts[0].union(parts[1]).union(parts[2])


@_query("method_histogram", "SELECT source, count(*) AS n, count(*) FILTER (coalesce(text, '') = '') AS empty_pages, round(avg(n_chars), 3) AS mean_chars, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs FROM documents GROUP BY source")
def _histogram(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("text") == "").alias("empty_pages"), F.round(F.avg("n_chars"), 3).alias("mean_chars"), F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs"))


@_query("conf_range_join", f"""WITH {_PAGES}, spans AS (SELECT book, page AS a, page + 60 AS z FROM pages), c AS (SELECT book, page, length(text) % 97 AS conf FROM pages)
    SELECT s.book, a, round(coalesce(sum(conf), 0) / (z - a + 1)::DOUBLE, 3) AS mean_conf FROM spans s LEFT JOIN c ON c.book = s.book AND c.page BETWEEN a AND z GROUP BY s.book, a, z""")
def _conf(spark, sf_dir):
    pages = book_pages(spark, sf_dir)
    spans = pages.select("book", F.col("page").alias("a"), (F.col("page") + 60).alias("z"))
    each = spans.select("book", "a", "z", F.explode(F.sequence("a", "z")).alias("page"))
    conf = pages.select("book", "page", (F.length("text") % 97).alias("conf"))
    return each.join(conf, ["book", "page"], "left").groupBy("book", "a", "z").agg(F.round(F.coalesce(F.sum("conf"), F.lit(0)) / (F.col("z") - F.col("a") + 1), 3).alias("mean_conf")).select("book", "a", "mean_conf")
