"""Labels, ids and search texts of sections and chunks, as Spark columns."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import text as T

# fixed values: numbered headings, the name of each level, and the marks around a title
NUMBER = "[0-9ivxlcdmIVXLCDM]+"
NUMBERED = {
    "unit": rf"(?i)^(?:unit|part){T.WHITE}*({NUMBER}){T.WHITE}*[:.\-]?{T.WHITE}*(.*)$",
    "chapter": rf"(?i)^(?:chapter|lesson|section|module){T.WHITE}*({NUMBER}){T.WHITE}*[:.\-]?{T.WHITE}*(.*)$",
    "topic": rf"(?i)^topic{T.WHITE}*({NUMBER})?{T.WHITE}*[:.\-]?{T.WHITE}*(.*)$",
}
PREFIX = {"unit": "Unit", "chapter": "Chapter", "topic": "Topic"}
TITLE_MARKS = r"^[ :.\-]+|[ :.\-]+$"


def heading(line: Column) -> Column:
    """struct(level, number, title) of a stripped line; null for prose. number is '' where there is none."""

    def parts(level: Column) -> Column:
        number, title = F.lit(""), line
        for name, pattern in NUMBERED.items():
            number = F.when(level == name, F.regexp_extract(line, pattern, 1)).otherwise(number)
            title = F.when(level == name, F.regexp_extract(line, pattern, 2)).otherwise(title)
        bare = T.let(F.regexp_replace(title, TITLE_MARKS, ""), lambda x: F.when(x == "", line).otherwise(x))
        return F.when(level.isNotNull(), F.struct(level.alias("level"), number.alias("number"), bare.alias("title")))

    return T.let(T.heading_level(line), parts)


def plain_number(number: Column) -> Column:
    """The number without leading zeros if it is one of digits, else as it is."""
    return F.coalesce(F.when(number.rlike("^[0-9]+$"), number.cast("decimal(38,0)").cast("string")), number)


def canonical(level: Column, number: Column, title: Column) -> Column:
    """Unit 3 from a numbered heading, else its title."""
    name = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in PREFIX.items() for x in pair]), level), level)
    return F.when(number != "", F.concat(name, F.lit(" "), plain_number(number))).otherwise(title)


def parent_id(levels: list[tuple[str, Column, Column]], index: Column) -> Column:
    """unit_03_topic_02_parent_001 from (label, canonical name, number) of each level; front where all names are empty."""
    parts = []
    for label, name, number in levels:
        digits = F.when(number.rlike("^[0-9]+$"), T.let(plain_number(number), lambda x: F.lpad(x, F.greatest(F.lit(2), F.length(x)), F.lit("0"))))
        of = F.when(number != "", F.coalesce(digits, T.slug(number))).otherwise(T.slug(name))
        parts.append(F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit(f"{label}_"), of)))
    base = T.let(F.concat_ws("_", *parts), lambda x: F.when(x == "", "front").otherwise(x))
    number = index.cast("string")
    return F.concat(base, F.lit("_parent_"), F.lpad(number, F.greatest(F.lit(3), F.length(number)), F.lit("0")))


def embed_text(unit: Column, chapter: Column, topic: Column, text: Column) -> Column:
    """The text behind its chain of headings; the text alone where there is none."""
    parts = [F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(f"{name}: "), x)) for name, x in (("Unit", unit), ("Chapter", chapter), ("Topic", topic))]
    return T.let(F.concat_ws(" · ", *parts), lambda x: F.when(x == "", text).otherwise(F.concat(x, F.lit(" — "), text)))


# there are no accents below
_HIGH = re.compile("[\u0300-\U0010FFFF]+")


def _plain(s: str) -> str:
    if s.isascii():
        return s.lower()
    return _HIGH.sub(lambda m: "".join(c for c in m[0] if unicodedata.category(c) != "Mn"), unicodedata.normalize("NFKD", s).lower())


@F.pandas_udf(StringType())
def _decomposed(x: pd.Series) -> pd.Series:
    # no built-in function decomposes characters
    return x.map(_plain, na_action="ignore")


def lexical_text(x: Column) -> Column:
    """Search text: decomposed, lower case, accents dropped, anything but letters, digits and _ as one blank."""
    return F.trim(F.regexp_replace(_decomposed(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}_]+", " "))


def apply_prefix(x: Column, kind: str) -> Column:
    """passage: or query: before a trimmed text, unless it has it already."""
    if kind not in ("passage", "query"):
        raise ValueError(f"kind must be 'passage' or 'query', got {kind!r}")
    t = T.strip(F.coalesce(x, F.lit("")))
    return F.when(F.lower(t).startswith(f"{kind}:"), t).otherwise(F.concat(F.lit(f"{kind}: "), t))


def is_supported_language(x: Column) -> Column:
    return F.coalesce(x.isin("en", "ur"), F.lit(False))


def valid_response(x: Column, limit: int = 1000) -> Column:
    """The text if it isn't blank and not over limit, else null."""
    return F.when((T.strip(x) != "") & (F.length(x) <= limit), x)


def clean_transcript(x: Column) -> Column:
    """Trimmed lines joined by blanks, without blank lines and time stamps ([... --> ...)."""
    lines = F.transform(F.split(x, "\n"), T.strip)
    return F.array_join(F.filter(lines, lambda s: (s != "") & ~(s.startswith("[") & s.contains("-->"))), " ")


def light_color(packed: Column, threshold: float = 200) -> Column:
    """Whether a packed RGB colour is near white."""
    r, g, b = (F.shiftright(packed, k).bitwiseAND(F.lit(255)) for k in (16, 8, 0))
    return 0.299 * r + 0.587 * g + 0.114 * b >= threshold


# ---------------------------------------------------------------- vectors and maps
def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalize(v: Column) -> Column:
    """Unit length; a vector of zeros stays."""
    n = norm(v)
    return F.transform(v, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """0 where one of them is zero."""
    return F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def mean_pool(vectors: Column, mask: Column) -> Column:
    """The mean of the vectors whose mask is 1; zeros where none is."""
    picked = F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] == 1)
    n = F.greatest(F.size(picked), F.lit(1))
    total = F.aggregate(picked, F.transform(vectors[0], lambda x: F.lit(0.0)), lambda s, x: F.zip_with(s, x["v"], lambda a, b: a + b.cast("double")))
    return F.transform(total, lambda x: x / n)


def merge_maps(base: Column, override: Column) -> Column:
    """Keys of both, override's value where both have one."""
    return F.map_zip_with(base, override, lambda k, a, b: F.coalesce(b, a))


def safe_get(m: Column, key: str, default: str) -> Column:
    return F.when(F.map_contains_key(m, key), F.try_element_at(m, F.lit(key))).otherwise(default)


# ---------------------------------------------------------------- repair of scanned words
# fixed values: scan junk, and short words that stay
JUNK = r"(^|[^\p{L}\p{N}_])(?:Cl|Cz|LJ|UI|CL|CJ|CC|CD)\)?\.?\]?(?=[^\p{L}\p{N}_]|$)"
SHORT_WORDS = "a i to is in of we he be or an as at by do if it no so up us on all and the are for".split()


def scan_quality(x: Column) -> Column:
    """Share of usual characters in thousandths, plus length."""
    good = F.length(x) - F.length(F.regexp_replace(x, "[\\p{L}\\p{N}" + T.WHITE[1:-1] + r""".,;:!?'"()\-—–]""", ""))
    return F.when(F.length(x) > 0, good / F.length(x) * 1000 + F.length(x)).otherwise(0.0)


def squeeze_white(x: Column) -> Column:
    """One blank for blanks and tabs, at most two line ends in a row, trimmed."""
    return T.strip(F.regexp_replace(F.regexp_replace(x, "[ \\t]+", " "), "\\n{3,}", "\n\n"))


def drop_short_tokens(x: Column) -> Column:
    """Without one or two letters before a closing mark, white space squeezed."""
    out = F.regexp_replace(x, r"(^|[^\p{L}\p{N}_])[A-Za-z]{1,2}[).\]]", "$1")
    return F.trim(F.regexp_replace(out, rf"{T.WHITE}+", " "))


def mend_punctuation(x: Column) -> Column:
    """No white space before a mark; a blank between a sentence's end and a capital."""
    return F.regexp_replace(F.regexp_replace(x, rf"{T.WHITE}+([.,;:!?])", "$1"), "([.!?])([A-Z])", "$1 $2")


def within_one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) >= 0


def display_words(x: Column, known: Column) -> Column:
    """The letters of each word, without unit labels, short junk, and short words that known (an array) doesn't have."""
    words = F.transform(F.split(F.regexp_replace(x, rf"(^|[^\p{{L}}\p{{N}}_])Unit{T.WHITE}?[0-9]+(?=[^\p{{L}}\p{{N}}_]|$)", "$1"), rf"{T.WHITE}+"), lambda w: F.regexp_replace(w, "[^a-zA-Z']", ""))

    def stays(w: Column) -> Column:
        short = F.array_contains(F.array(*map(F.lit, SHORT_WORDS)), F.lower(w))
        return (w != "") & ((F.length(w) > 2) | short) & ((F.length(w) > 4) | F.array_contains(known, F.lower(w)) | w.rlike("^[A-Z]"))

    return F.array_join(F.filter(words, stays), " ")


def short_answer(x: Column, most: int = 5) -> Column:
    """The first sentences that have at least three words of three letters."""
    parts = F.split(F.regexp_replace(x, rf"([.!?]){T.WHITE}+", "$1\u0001"), "\u0001")
    return F.trim(F.array_join(F.slice(F.filter(parts, lambda s: F.regexp_count(s, F.lit("[A-Za-z]{3,}")) >= 3), 1, most), " "))
