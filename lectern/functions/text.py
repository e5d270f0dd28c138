"""Text functions as Spark columns. Patterns use explicit classes, so that they mean the same in other engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
WHITE = r"[ \t\n\x0B\f\r]"
LETTER_DIGIT = r"[\p{L}\p{N}_]"
WORD = rf"{LETTER_DIGIT}+('+{LETTER_DIGIT}+)*"
SENTENCE_END = ".!?۔"
URDU = r"[\x{0600}-\x{06FF}]"
ROMAN_URDU = "kya hai hain ka ki ke kahan kaise kyun kis kyaa mein tha thi the nahi na batao bataye samjhao karna hota hoti karne karo".split()
ROMAN_URDU_STRONG = "kya hai hain kahan kaise kyun".split()
SUBJECTS = ["english", "urdu", "science", "mathematics", "maths", "math", "social studies", "islamiat", "general knowledge", "computer"]
HEADING_WORDS = "unit chapter lesson section topic module part exercise question q".split()


def let(x: Column, then: Callable[[Column], Column]) -> Column:
    """then(x) with x worked out once a row, however often then uses it."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(" \t\n\x0b\f\r"))


def norm_line(x: Column) -> Column:
    """One blank for any white space, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(x, rf"{WHITE}+", " ")))


def word_count(x: Column) -> Column:
    return F.regexp_count(x, F.lit(WORD)).cast("long")


def nonblank_parts(x: Column) -> Column:
    return F.filter(F.transform(x, strip), lambda s: s != "")


def sentences(x: Column) -> Column:
    """Split after . ! ? or the Urdu full stop where white space follows."""
    return nonblank_parts(F.split(F.regexp_replace(x, rf"([{SENTENCE_END}]){WHITE}+", "$1\u0001"), "\u0001"))


def sentences_strict(x: Column) -> Column:
    """As sentences(), also at the Urdu question mark, if a letter, digit or quote follows."""
    return nonblank_parts(F.split(F.regexp_replace(x, rf"([{SENTENCE_END}\x{{061F}}]){WHITE}+([A-Za-z0-9\"'\x{{0600}}-\x{{06FF}}])", "$1\u0001$2"), "\u0001"))


def paragraphs(x: Column) -> Column:
    return nonblank_parts(F.split(x, rf"\n{WHITE}*\n"))


def slug(x: Column) -> Column:
    out = F.btrim(F.regexp_replace(F.lower(x), r"[^a-z0-9\x{0600}-\x{06FF}]+", "_"), F.lit("_"))
    return let(out, lambda y: F.when(y == "", "x").otherwise(y))


def chunk_id(book: Column, page: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("|", book, F.coalesce(page.cast("string"), F.lit("None")), text), 256)


def is_heading_like(x: Column) -> Column:
    return x.rlike(rf"(?i)^({'|'.join(HEADING_WORDS)})([^\p{{L}}\p{{N}}_]|$)")


def is_noise(x: Column) -> Column:
    """No letter or digit, or at least 4 characters with under 30 % of them."""
    n, good = F.length(x), F.length(F.regexp_replace(x, r"[^\p{L}\p{N}]+", ""))
    return (strip(x) != "") & let(good, lambda y: (y == 0) | ((n >= 4) & (10 * y < 3 * n)))


def is_table_line(x: Column) -> Column:
    return x.contains("|") | (F.size(nonblank_parts(F.split(x, rf"{WHITE}{{2,}}"))) >= 2)


def is_pure_number(x: Column) -> Column:
    return x.rlike("^([0-9]{1,4}|[ivxlcdmIVXLCDM]{1,8})$")


def is_title_like(x: Column) -> Column:
    """A generic heading: 2 to 60 characters, 1 to 8 words, 70 % of them capitalised, no final stop."""
    words = F.filter(F.split(x, rf"{WHITE}+"), lambda w: w != "")
    upper = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    return F.length(x).between(2, 60) & ~x.rlike(rf"[{SENTENCE_END}]$") & ~x.rlike("^[0-9]+$") & F.size(words).between(1, 8) & (10 * upper >= 7 * F.size(words))


def heading_level(x: Column) -> Column:
    """unit, chapter, topic, exercise, heading or null."""
    number = r"[0-9ivxlcdmIVXLCDM]+"
    return (
        F.when(x.rlike(rf"(?i)^(unit|part){WHITE}*{number}"), "unit")
        .when(x.rlike(rf"(?i)^(chapter|lesson|section|module){WHITE}*{number}"), "chapter")
        .when(x.rlike("(?i)^topic"), "topic")
        .when(x.rlike(r"(?i)^exercise([^\p{L}\p{N}_]|$)"), "exercise")
        .when(is_title_like(x), "heading")
    )


def quality_score(x: Column) -> Column:
    """0 to 1 by word coverage, share of letters and mean word length; rounded half up to 3 places."""

    def score(t: Column, found: Column) -> Column:
        words, size = F.size(found).cast("long"), F.greatest(F.lit(1), F.length(t))
        letters = F.length(F.regexp_replace(t, r"[^\p{L}]+", ""))
        in_words = F.length(F.array_join(found, ""))
        total = 0.4 * F.least(F.lit(1.0), words / 40.0) + 0.4 * letters / size + 0.2 * F.least(F.lit(1.0), in_words / F.greatest(F.lit(1), words) / 5.0)
        return F.when((t == "") | (words == 0), 0.0).otherwise(F.round(F.least(F.lit(1.0), total), 3))

    return let(strip(F.coalesce(x, F.lit(""))), lambda t: let(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), lambda found: score(t, found)))


def compare_quality(embedded: Column, ocr: Column, confidence: Column) -> Column:
    """Which text of a page to trust: none, embedded, ocr or merged."""
    scaled = F.round(F.least(F.lit(1.0), ocr * (0.6 + 0.4 * F.least(F.lit(1.0), confidence / 90.0))), 3)
    method = lambda e, s: F.when((e < 0.05) & (s < 0.05), "none").when(e >= s, F.when(s >= 0.05, "merged").otherwise("embedded")).otherwise("ocr")
    return let(embedded, lambda e: let(scaled, lambda s: method(e, s)))


def query_language(x: Column) -> Column:
    words = F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("[a-z']+"), F.lit(0)))
    cues = lambda many: F.size(F.array_intersect(words, F.array(*map(F.lit, many))))
    return F.when(x.rlike(URDU), "urdu").when((cues(ROMAN_URDU_STRONG) > 0) | (cues(ROMAN_URDU) >= 2), "roman_urdu").otherwise("english")


def chunk_language(x: Column) -> Column:
    return F.when((F.length(x) > 0) & (100 * F.regexp_count(x, F.lit(URDU)) > 15 * F.length(x)), "ur").otherwise("en")


def script_language(x: Column, default: str = "en") -> Column:
    arabic = F.regexp_count(x, F.lit(r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"))
    latin = F.regexp_count(x, F.lit("[A-Za-z]"))
    return F.when(arabic > latin, "ur").when(latin > arabic, "en").otherwise(default)


def inferred_filters(x: Column, books: list[str] = ()) -> dict[str, Column]:
    """grade, unit, chapter, topic, subject and book that a question asks for; null where it doesn't.

    Lesson, section and module are kept as a chapter, under their own name; the first
    subject and the first book of the lists that occur count.
    """
    edge, low = r"([^\p{L}\p{N}_]|$)", F.lower(x)
    grade = F.nullif(F.regexp_extract(low, rf"(^|[^\p{{L}}\p{{N}}_])grade{WHITE}*([0-9]+){edge}", 2), F.lit(""))
    kind = rf"(^|[^\p{{L}}\p{{N}}_])(unit|chapter|lesson|section|module|topic){WHITE}*([0-9]+){edge}"
    label, number = F.regexp_extract(low, kind, 2), F.regexp_extract(low, kind, 3)
    named = F.concat(F.initcap(label), F.lit(" "), number)
    subject = book = F.lit(None).cast("string")
    for s in reversed(SUBJECTS):
        subject = F.when(low.rlike(rf"(^|[^\p{{L}}\p{{N}}_]){s}{edge}"), F.initcap(F.lit(s))).otherwise(subject)
    for b in reversed([b for b in books if b]):
        book = F.when(low.contains(b.lower()), F.lit(b)).otherwise(book)
    return {"grade": grade, "unit": F.when(label == "unit", named), "chapter": F.when(label.isin("chapter", "lesson", "section", "module"), named), "topic": F.when(label == "topic", named), "subject": subject, "book": book}


def estimate_tokens(x: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(x) / 4)).cast("long")


def truncate(x: Column, n: int) -> Column:
    return F.when(F.length(x) <= n, x).otherwise(F.concat(F.regexp_replace(F.substring(x, 1, n - 3), rf"{WHITE}+$", ""), F.lit("...")))


def strip_markdown(x: Column, limit: int = 1000) -> Column:
    out = F.regexp_replace(x, r"```[\s\S]*?```", "")
    for mark in (r"`([^`]+)`", r"\*\*(.*?)\*\*", r"\*(.*?)\*", r"__(.*?)__", r"_(.*?)_", "~~(.*?)~~"):
        out = F.regexp_replace(out, mark, "$1")
    return F.substring(strip(F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), " {2,}", " ")), 1, limit)


def format_duration(x: Column) -> Column:
    h, m, s = F.floor(x / 3600), F.floor(F.pmod(x, F.lit(3600)) / 60), F.pmod(x, F.lit(60))
    parts = F.concat_ws(" ", F.when(h > 0, F.concat(h.cast("string"), F.lit("h"))), F.when(m > 0, F.concat(m.cast("string"), F.lit("m"))), F.when((s > 0) | ((h == 0) & (m == 0)), F.concat(s.cast("string"), F.lit("s"))))
    return F.when(x < 0, "0s").otherwise(parts)


def json_response(x: Column) -> Column:
    """The answer text in a model server's JSON, whichever of three shapes it has."""
    return F.coalesce(F.get_json_object(x, "$.message.content"), F.get_json_object(x, "$.choices[0].message.content"), F.get_json_object(x, "$.content"), F.lit(""))
