"""Quality rules: base counts of each text, and a hashed n-gram log-likelihood ratio.

Word unigrams and bigrams of all documents are hashed into `buckets`. Two multinomials
with add-one smoothing are counted over the whole corpus: the trusted target (documents
labelled quality 1) and everything. A document's score is the mean log ratio of its
n-grams; a document is kept if it passes the base rules and its score reaches
`threshold`. Ratios are rounded to millionths and summed as whole numbers, so the verdict
doesn't depend on the order of sums.

Only DataFrame functions run. The corpus is exploded to bucket numbers that are counted
map-side, so a shuffle carries at most one row a bucket and task. The ratios are one array
of `buckets` numbers whatever the input, which is part of the plan; texts are scored where
they are read and nothing of them is shuffled.

Defined cases: null text has no words and fails the base rules; a text without n-grams
scores 0; each row is judged for itself, repeated doc_ids too; without trusted documents
every ratio compares with a flat target; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mark_ids, store, text_table

BUCKETS = 1 << 16
THRESHOLD = -0.25
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
# fixed values: the white space between words of the pattern [^\x20\x09-\x0D]+, and the symbols
WHITE_RE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def word_array(text: str = "text") -> Column:
    bare = F.expr(f"trim(BOTH ' \\t\\n\\u000b\\u000c\\r' FROM {text})")
    return F.when(bare != "", F.split(bare, WHITE_RE)).otherwise(F.array().cast("array<string>"))


def _twice(found: str, same) -> Column:
    """Elements of a sorted array that equal a neighbour by same()."""
    x = F.col(found)
    return F.filter(x, lambda v, j: ((j > 0) & same(v, F.get(x, j - 1))) | ((j + 1 < F.size(x)) & same(v, F.get(x, j + 1))))


def _runs(size: int) -> Column:
    """All runs of size neighbouring words, as structs with fields 0, 1, ..."""
    w = F.col("words")
    n = F.greatest(F.size(w) - (size - 1), F.lit(0))
    return F.arrays_zip(*[F.slice(w, F.lit(k + 1), n).alias(f"w{k}") for k in range(size)])


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words: one row per row of docs."""
    d = text_table(docs).select("doc_id", "text", word_array().alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    bare = F.col("text")
    for c in SYMBOLS:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    d = d.select(
        "doc_id",
        "words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(bare)).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.transform(_runs(3), lambda x: F.xxhash64(x["w0"], x["w1"], x["w2"])).alias("hashes"),
    )
    base = [F.col(c) for c in ("doc_id", "words", "word_chars", "n_symbols")]
    d = d.select(*base, (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.when(F.size("hashes") > F.size(F.array_distinct("hashes")), F.col("hashes")).alias("hashes"))
    base.append(F.col("n_dup_lines"))
    # 32 bits of a window's hash above its place: sorting brings equal windows together; texts without equal hashes stay null
    keyed = F.transform("hashes", lambda x, i: F.shiftleft(x.bitwiseAND(F.lit(0xFFFFFFFF)), 31).bitwiseOR(i.cast("long")))
    d = d.select(*base, F.sort_array(keyed).alias("keyed"))
    d = d.select(*base, F.transform(_twice("keyed", lambda a, b: F.shiftright(a, 31) == F.shiftright(b, 31)), lambda v: v.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("at"))
    # equal hashes are confirmed on the words themselves
    w = F.col("words")
    d = d.select(*base, F.sort_array(F.transform("at", lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i")))).alias("exact"))
    d = d.select(*base, F.sort_array(F.transform(_twice("exact", lambda a, b: a["g"] == b["g"]), lambda v: v["i"])).alias("at"))
    at = F.col("at")
    covered = F.aggregate(F.transform(at, lambda v, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1), v + 3) - v)), F.lit(0), lambda a, b: a + b)
    return d.select(*base, F.size(w).cast("long").alias("n_words"), F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def buckets_of(buckets: int) -> Column:
    """Bucket numbers of all words, and of all pairs of neighbours, of the column words."""
    w = F.col("words")
    place = lambda *x: F.pmod(F.xxhash64(*x), F.lit(buckets)).cast("int")
    pairs = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: place(x, F.get(w, i + 1)))
    return F.concat(F.transform(w, lambda x: place(x)), pairs)


def bucket_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, ratio: log of target over raw probability, in millionths."""
    good = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("target"))
    marked = mark_ids(text_table(docs), good.where("target = 1"))
    w = F.col("words")
    pairs = F.arrays_zip(w.alias("a"), F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1))).alias("b"))
    rows = marked.select(word_array().alias("words"), "target").select("target", F.explode(pairs).alias("p"))
    place = lambda *x: F.pmod(F.xxhash64(*x), F.lit(buckets)).cast("int")
    grams = rows.select("target", F.explode(F.array(place("p.a"), F.when(F.col("p.b").isNotNull(), place("p.a", "p.b")))).alias("bucket")).where("bucket is not null")
    counts = store(grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("target").alias("target")), "counts")
    sums = counts.agg(F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target")).first()
    raw, target = sums["all_raw"] or 0, sums["all_target"] or 0
    ratio = F.log((F.col("target") + 1) / F.lit(float(target + buckets))) - F.log((F.col("raw") + 1) / F.lit(float(raw + buckets)))
    return counts.select("bucket", F.round(ratio * 1e6).cast("long").alias("ratio"))


def quality_rules(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: base counts, base_failed, llr (mean log ratio), kept."""
    ratios = bucket_ratios(docs, labels, buckets)
    # at most `buckets` pairs of numbers, whatever the input; as one constant, which is folded once
    known = {r["bucket"]: r["ratio"] for r in ratios.collect()}
    every = F.split(F.lit(",".join(str(known.get(k, 0)) for k in range(buckets))), ",").cast("array<bigint>")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    total = F.aggregate(buckets_of(buckets), F.lit(0).cast("long"), lambda s, x: s + F.get(every, x))
    grams = F.greatest(2 * F.col("n_words") - 1, F.lit(0))
    scored = base_counts(docs).select(*names, total.alias("total"), grams.alias("grams"))
    llr = F.when(F.col("grams") > 0, F.col("total") / F.col("grams") / 1e6).otherwise(0.0)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return scored.select(*names, failed.alias("base_failed"), llr.alias("llr")).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
