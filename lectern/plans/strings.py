"""Queries of labels, vectors, repairs and output strings, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import prompts as P
from ..functions import text as T
from ..operators import cleaning
from .catalog import _BM25, _FUSED, _LINES, _STRIP, _WS, _bm25, _docs, _fused, _query, _scalar, _table, book_pages

_scalar("apply_prefix", lambda x: L.apply_prefix(x, "query"), f"CASE WHEN starts_with(lower(regexp_replace(text, {_STRIP})), 'query:') THEN regexp_replace(text, {_STRIP}) ELSE 'query: ' || regexp_replace(text, {_STRIP}) END", "benchmark", "item_id")
_scalar("valid_response", lambda x: L.valid_response(T.strip_markdown(x, 1 << 30), 1000), r"(SELECT CASE WHEN t <> '' AND length(t) <= 1000 THEN t END FROM (SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '```[\s\S]*?```', '', 'g'), '`([^`]+)`', '\1', 'g'), '\*\*(.*?)\*\*', '\1', 'g'), '\*(.*?)\*', '\1', 'g'), '__(.*?)__', '\1', 'g'), '_(.*?)_', '\1', 'g'), '~~(.*?)~~', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g'), " + f"{_STRIP}) AS t))", "conversations", "conv_id")
_scalar("clean_transcript", L.clean_transcript, f"array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, {_STRIP})), lambda x: x <> '' AND NOT (starts_with(x, '[') AND contains(x, '-->'))), ' ')")
_scalar("scan_quality", lambda x: F.round(L.scan_quality(x), 6), r"CASE WHEN length(text) > 0 THEN round((length(text) - length(regexp_replace(text, '[\p{L}\p{N} \t\n\x0B\f\r.,;:!?''\x22()\-—–]', '', 'g'))) / length(text) * 1000 + length(text), 6) ELSE 0.0 END")
_scalar("squeeze_white", lambda x: F.md5(L.squeeze_white(x)), rf"md5(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), {_STRIP}))")
_scalar("mend_punctuation", lambda x: F.md5(L.mend_punctuation(L.drop_short_tokens(x))), rf"md5(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(text, '(^|[^\p{{L}}\p{{N}}_])[A-Za-z]{{1,2}}[).\]]', '\1', 'g'), '{_WS}+', ' ', 'g')), '{_WS}+([.,;:!?])', '\1', 'g'), '([.!?])([A-Z])', '\1 \2', 'g'))")
_KNOWN = ["the", "that", "and", "was", "of"]
_SHORT = ", ".join(f"'{w}'" for w in L.SHORT_WORDS)
_DISPLAY = rf"list_filter(list_transform(string_split_regex(text, '{_WS}+'), lambda w: regexp_replace(w, '[^a-zA-Z'']', '', 'g')), lambda w: w <> '' AND (length(w) > 2 OR list_contains([{_SHORT}], lower(w))) AND (length(w) > 4 OR list_contains([{', '.join(repr(w) for w in _KNOWN)}], lower(w)) OR regexp_matches(w, '^[A-Z]')))"
_scalar("display_words", lambda x: F.md5(L.display_words(x, F.array(*map(F.lit, _KNOWN)))), f"md5(array_to_string({_DISPLAY}, ' '))")
_scalar("short_answer", lambda x: F.md5(L.short_answer(x)), rf"md5(trim(array_to_string(list_filter(string_split(regexp_replace(text, '([.!?]){_WS}+', '\1' || chr(1), 'g'), chr(1)), lambda s: len(regexp_extract_all(s, '[A-Za-z]{{3,}}')) >= 3)[1:5], ' ')))")
_scalar("answer_words", P.first_words, f"array_to_string(list_filter(string_split_regex(text, '{_WS}+'), lambda w: w <> '')[1:40], ' ')")


@_query("supported_language", "SELECT doc_id, coalesce(lang IN ('en', 'ur'), false) AS value FROM documents")
def _supported(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", L.is_supported_language(F.col("lang")).alias("value"))


@_query("light_color", "SELECT doc_id, 0.299::DOUBLE * (doc_id * 7919 >> 16 & 255) + 0.587::DOUBLE * (doc_id * 7919 >> 8 & 255) + 0.114::DOUBLE * (doc_id * 7919 & 255) >= 100 AS value FROM documents")
def _light(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", L.light_color(F.col("doc_id") * 7919, 100).alias("value"))


# ---------------------------------------------------------------- vectors and maps
_V = "embedding::DOUBLE[]"


@_query("vector_functions", f"""SELECT a.vec_id, round(sqrt(list_dot_product(a.{_V}, a.{_V})), 6) AS norm, round(list_dot_product(a.{_V}, b.{_V}), 6) AS inner_product, round(list_cosine_similarity(a.{_V}, b.{_V}), 6) AS cosine, round(list_distance(a.{_V}, b.{_V}), 6) AS l2,
    round((a.{_V})[1] / sqrt(list_dot_product(a.{_V}, a.{_V})), 6) AS first_unit, round(((a.{_V})[2] + (b.{_V})[2]) / 2, 6) AS pooled FROM embeddings a JOIN embeddings b ON b.vec_id = 0""")
def _vectors(spark, sf_dir):
    v = _table(spark, sf_dir, "embeddings")
    # one row
    fixed = v.where("vec_id = 0").select(F.col("embedding").alias("other"))
    a, b = F.col("embedding"), F.col("other")
    out = v.join(F.broadcast(fixed), how="cross")
    pooled = L.mean_pool(F.array(a, b, b), F.array(F.lit(1), F.lit(1), F.lit(0)))
    return out.select("vec_id", *[F.round(c, 6).alias(n) for n, c in (("norm", L.norm(a)), ("inner_product", L.dot(a, b)), ("cosine", L.cosine(a, b)), ("l2", L.l2_distance(a, b)), ("first_unit", L.normalize(a)[0]), ("pooled", pooled[1]))])


@_query("worst_cosine_distance", f"SELECT label, round(max(1 - list_cosine_similarity(a.{_V}, b.{_V})), 6) AS worst FROM embeddings a JOIN (SELECT vec_id, embedding FROM embeddings) b ON b.vec_id = a.vec_id - a.vec_id % 10 GROUP BY label")
def _worst(spark, sf_dir):
    v = _table(spark, sf_dir, "embeddings")
    other = v.select(F.col("vec_id").alias("at"), F.col("embedding").alias("other"))
    pairs = v.withColumn("at", F.col("vec_id") - F.col("vec_id") % 10).join(other, "at")
    return pairs.groupBy("label").agg(F.round(F.max(1 - L.cosine(F.col("embedding"), F.col("other"))), 6).alias("worst"))


@_query("merge_maps", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'b' ELSE source END AS source, lang, doc_id::VARCHAR AS id, 'none' AS missing FROM documents")
def _maps(spark, sf_dir):
    base = F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"))
    over = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("source"), F.lit("b"), F.lit("id"), F.col("doc_id").cast("string"))).otherwise(F.create_map(F.lit("id"), F.col("doc_id").cast("string")))
    d = _docs(spark, sf_dir).select("doc_id", L.merge_maps(base, over).alias("m"))
    return d.select("doc_id", *[L.safe_get(F.col("m"), k, "none").alias(k) for k in ("source", "lang", "id", "missing")])


# ---------------------------------------------------------------- repair
@_query("spelling_candidates", r"""WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]{4,}'))) AS word FROM benchmark), k AS (SELECT DISTINCT lower(n_name) AS known FROM nation WHERE length(n_name) >= 4 UNION SELECT word FROM w WHERE length(word) = 6)
    SELECT word, min(known) AS fixed FROM w JOIN k ON levenshtein(word, known) <= 1 AND word <> known WHERE word NOT IN (SELECT known FROM k) GROUP BY word""")
def _spelling(spark, sf_dir):
    words = _table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("word")).select(F.lower("word").alias("word")).distinct()
    known = _table(spark, sf_dir, "nation").where("length(n_name) >= 4").select(F.lower("n_name").alias("known")).union(words.where("length(word) = 6")).distinct()
    return cleaning.corrections(words, known)


@_query("boilerplate_lines", f"""WITH {_LINES}, held AS (SELECT book, page, line, row_number() OVER (PARTITION BY page ORDER BY line_no) AS up FROM lines WHERE norm <> ''), n AS (SELECT book, greatest(2, floor(count(*) * 0.05)) AS least FROM pages GROUP BY book),
    edge AS (SELECT DISTINCT book, page, regexp_replace(regexp_replace(lower(regexp_replace(line, {_STRIP})), '[0-9]+', '#', 'g'), '{_WS}+', ' ', 'g') AS norm FROM held WHERE up <= 3)
    SELECT book, norm, count(*) AS hits FROM edge JOIN n USING (book) GROUP BY book, norm, least HAVING count(*) >= least""")
def _boilerplate(spark, sf_dir):
    pages = book_pages(spark, sf_dir)
    up = F.row_number().over(Window.partitionBy("page").orderBy("line_no"))
    edges = cleaning.page_lines(pages).where("norm <> ''").withColumn("up", up).where("up <= 3").select("book", "page", "line")
    return cleaning.boilerplate(edges, pages, 0.05)


# ---------------------------------------------------------------- output strings
def _blocks(spark, sf_dir) -> DataFrame:
    """Hits with stand-in pages: every third has none, every other one a single page."""
    texts = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", "source", "lang")
    hits = _fused(spark, sf_dir).where("rank <= 5").join(texts, "id")
    start = F.when(F.col("id") % 3 != 0, F.col("id"))
    return hits.withColumn("page_start", start).withColumn("page_end", start + F.col("id") % 2)


_HIT = f"{_FUSED}, hit AS (SELECT q, id, rank, score, coalesce(text, '') AS text, source, lang, CASE WHEN id % 3 <> 0 THEN id END AS page_start, CASE WHEN id % 3 <> 0 THEN id + id % 2 END AS page_end FROM fused JOIN documents ON doc_id = id WHERE rank <= 5), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rank) AS i FROM hit)"
_PAGES_OF = lambda one, many, none: f"CASE WHEN page_start IS NOT NULL AND page_end <> page_start THEN '{many}' || page_start || '-' || page_end WHEN page_start IS NOT NULL THEN '{one}' || page_start ELSE '{none}' END"
_CONTEXT = f"string_agg('Passage ' || i || CASE WHEN page_start IS NULL THEN '' ELSE {_PAGES_OF(' (page ', ' (pages ', '')} || ')' END || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY i)"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_BEFORE, _AFTER = (_quoted(x) for x in ("System: " + P.SYSTEM.replace("{decline}", P.DECLINE)).split("{context}"))


@_query("context_strings", f"""WITH {_HIT} SELECT q, md5({_CONTEXT}) AS context, string_agg('  - ' || {_PAGES_OF("page ", "page ", "page ?")} || ' (' || source || ' / ' || lang || ')', chr(10) ORDER BY i) AS sources,
    md5(string_agg('[source ' || i || ': ' || source || ', chunk ' || rank || ']' || chr(10) || regexp_replace(text, {_STRIP}), chr(10) || chr(10) ORDER BY i)) AS docs,
    string_agg('  [' || i || '] score=' || printf('%.4f', score) || ' ' || {_PAGES_OF("page ", "page ", "page ?")} || chr(10) || '      ' || CASE WHEN length(regexp_replace(text, {_STRIP})) > 200 THEN replace(substr(regexp_replace(text, {_STRIP}), 1, 200), chr(10), ' ') || '...' ELSE replace(regexp_replace(text, {_STRIP}), chr(10), ' ') END, chr(10) ORDER BY i) AS blocks,
    md5({_BEFORE} || {_CONTEXT} || {_AFTER} || chr(10) || 'Human: ' || any_value(asked)) AS prompt FROM r JOIN (SELECT item_id AS q, text AS asked FROM benchmark) USING (q) GROUP BY q""")
def _context(spark, sf_dir):
    row = F.struct("rank", "score", "text", F.col("text").alias("child_text"), "page_start", "page_end", F.col("source").alias("source_file"), F.col("rank").alias("chunk_index"), F.col("source").alias("unit"), F.lit("").alias("chapter"), F.col("lang").alias("topic"))
    listed = _blocks(spark, sf_dir).groupBy("q").agg(F.sort_array(F.collect_list(row)).alias("b"))
    asked = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), F.col("text").alias("asked"))
    b = F.col("b")
    return listed.join(asked, "q").select("q", F.md5(P.format_context(b)).alias("context"), P.format_sources(b).alias("sources"), F.md5(P.format_docs(b)).alias("docs"), P.format_blocks(b).alias("blocks"), F.md5(P.build_prompt(P.format_context(b), F.col("asked"))).alias("prompt"))


@_query("context_block_text", "SELECT doc_id, md5(array_to_string(list_filter([coalesce(text, ''), CASE WHEN doc_id % 2 = 0 THEN source END, lang, ''], lambda x: x IS NOT NULL AND x <> ''), chr(10) || chr(10))) AS value FROM documents")
def _block_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(P.block_text(F.col("text"), F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.array("lang", F.lit("")))).alias("value"))


@_query("retrieval_trace", f"""WITH {_FUSED}, lists AS (SELECT item_id AS q, CASE WHEN regexp_matches(text, '[\\x{{0600}}-\\x{{06FF}}]') THEN 'urdu' ELSE 'english' END AS language FROM benchmark WHERE item_id % 20 = 0),
    v AS (SELECT q, count(*) AS n, round(min(distance), 5) AS top FROM vec GROUP BY q), t AS (SELECT q, count(*) AS n, round(max(score), 5) AS top FROM bm25 GROUP BY q), f AS (SELECT q, count(*) AS n, round(max(score), 5) AS top FROM fused GROUP BY q), g AS (SELECT q, count(*) AS n FROM fused WHERE score >= 0.015 AND rank <= 5 GROUP BY q)
    SELECT q, coalesce(v.n, 0) AS vector_hits, v.top AS vector_top, coalesce(t.n, 0) AS bm25_hits, t.top AS bm25_top, coalesce(f.n, 0) AS fused, f.top AS fused_top, coalesce(g.n, 0) AS gated, q % 40 = 20 AS fallback,
    CASE WHEN coalesce(f.n, 0) = 0 THEN 'no_match' WHEN coalesce(g.n, 0) = 0 THEN 'gated_out' ELSE 'success' END AS verdict FROM lists LEFT JOIN v USING (q) LEFT JOIN t USING (q) LEFT JOIN f USING (q) LEFT JOIN g USING (q)""")
def _trace(spark, sf_dir):
    from ..operators import retrieval
    from ..sources.tables import stored
    from .catalog import _questions, _vector_hits

    # each list is looked at several times
    vector, text = stored(_vector_hits(spark, sf_dir), "vector"), stored(_bm25(spark, sf_dir), "text")
    fused = stored(retrieval.fuse((vector.select("q", F.col("vec_id").alias("id"), "rank"), 1), (text, 1)), "fused")
    asked = _questions(spark, sf_dir).withColumn("filters", F.when(F.col("q") % 40 == 20, "label = 99").otherwise(""))
    d = retrieval.diagnostics(asked, vector, text, fused, fused.where("score >= 0.015 and rank <= 5"), asked.where("filters = ''").select("q"), 0.015)
    return d.select("q", "vector_hits", "vector_top", "bm25_hits", "bm25_top", "fused", "fused_top", "gated", "fallback", P.verdict(F.col("fused"), F.col("gated"), F.col("threshold")).alias("verdict"))


@_query("weighted_scores", f"""WITH {_BM25}, near AS (SELECT a.vec_id AS q, b.vec_id AS id, round(1 - list_cosine_similarity(a.{_V}, b.{_V}), 6) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0),
    vec AS (SELECT *, 1 - distance AS cosine FROM near QUALIFY row_number() OVER (PARTITION BY q ORDER BY distance, id) <= 20),
    parts AS (SELECT q, id, 0.65::DOUBLE * coalesce((cosine - min(cosine) OVER (PARTITION BY q)) / nullif(max(cosine) OVER (PARTITION BY q) - min(cosine) OVER (PARTITION BY q), 0), 1) AS part FROM vec
      UNION ALL SELECT q, id, 0.35::DOUBLE * coalesce((score - min(score) OVER (PARTITION BY q)) / nullif(max(score) OVER (PARTITION BY q) - min(score) OVER (PARTITION BY q), 0), 1) FROM bm25)
    SELECT q, id, round(sum(part), 6) AS score, row_number() OVER (PARTITION BY q ORDER BY round(sum(part), 6) DESC, id) AS rank FROM parts GROUP BY q, id QUALIFY rank <= 5""")
def _weighted(spark, sf_dir):
    from ..operators import retrieval

    v = _table(spark, sf_dir, "embeddings")
    # four times as many as wanted are fetched, then ranked anew
    near = retrieval.vector_topk(v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), "embedding"), 4 * 5, "cosine")
    vector = near.select("q", F.col("vec_id").alias("id"), (1 - F.col("distance")).alias("cosine"))
    return retrieval.weighted_scores(vector, _bm25(spark, sf_dir).select("q", "id", "score")).where("rank <= 5")
