"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text, thresholded by language.

The units are characters in 64 classes (letters by case with accents folded, digits,
white space, kinds of punctuation), the order is 4. Counts of all trusted documents
(labelled quality 1) are gathered; contexts, continuation counts and discounts are joins
and aggregates over count tables sharded by n-gram. The model has at most 64**4 rows
whatever the input, which bounds what is sent to the tasks. Every document's perplexity is
taken over its whole text, and documents above the language's threshold are rejected.

A threshold lies as far above the `QUANTILE` quantile of the log perplexities of the
language's trusted documents as that lies above their median, times `SLACK`. Quantiles
are read from counts in bins of 1/10000, exact to a bin at any size.

Defined cases: null text is empty; a text of fewer than 4 characters has no perplexity
and is rejected; a language without trusted documents (null counts as '') takes the
threshold of all trusted documents, and without any trusted document nothing is
rejected but texts without perplexity; each row is judged for itself, and a repeated doc_id counts
as trusted if its smallest label is 1; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mark_ids, slices, store, text_buffer

ORDER, BITS = 4, 6
QUANTILE, SLACK = 0.99, 1.5
BINS = 10_000
_SIZE = 1 << BITS

# fixed values: base letters of U+00C0 to U+00FF, by the second byte of UTF-8
_FOLD = "AAAAAAACEEEEIIIIDNOOOOO/OUUUUYPsaaaaaaaceeeeiiiidnooooo/ouuuuypy"


def _classes() -> np.ndarray:
    """The class of each byte; 255: no unit of its own."""
    out = np.full(256, 63, np.uint8)
    out[97:123] = np.arange(1, 27)
    out[65:91] = np.arange(27, 53)
    out[48:58] = 53
    out[[9, 10, 11, 12, 13]] = 55
    out[32] = 54
    for k, chars in {56: b".,;:", 57: b"#*$%&@^~_=+/\\<>", 58: b"!?", 59: b"|", 60: b"'\"`", 61: b"-()", 62: b"[]{}"}.items():
        out[list(chars)] = k
    for i, c in enumerate(_FOLD):
        out[0x80 + i] = out[ord(c)]
    out[[0xC2, 0xC3]] = 255
    return out


_CLASS = _classes()


def ngrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all n-grams of the texts on end, and where each text's begin."""
    data, offsets = text_buffer(column)
    code = _CLASS[data]
    keep = code != 255
    first = np.concatenate([[0], np.cumsum(keep)])[offsets]
    code = code[keep].astype(np.int32)
    n = max(0, len(code) - ORDER + 1)
    key = np.zeros(n, np.int32)
    for k in range(ORDER):
        key = (key << BITS) | code[k : k + n]
    ok = np.ones(n, bool)
    for k in range(1, ORDER):
        # n-grams that begin up to ORDER - 1 before a text's end
        cut = first[1:] - k
        ok[cut[(cut >= 0) & (cut < n)]] = False
    short = np.flatnonzero(np.diff(first) < ORDER)
    for d in short.tolist():
        ok[first[d] : min(first[d + 1], n)] = False
    return key[ok], np.concatenate([[0], np.cumsum(ok)])[np.minimum(first, n)]


def _count(batches):
    total = np.zeros(1 << (BITS * ORDER), np.int64)
    for batch in batches:
        for part in slices(batch):
            key, _ = ngrams(part["text"])
            total += np.bincount(key, minlength=len(total))
    at = np.flatnonzero(total)
    for k in range(0, len(at), 1 << 16):
        some = at[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["key", "c"])


def trusted_ids(labels: DataFrame) -> DataFrame:
    ids = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
    return ids.where("quality = 1").select("doc_id")


def kneser_ney(counts: DataFrame) -> DataFrame:
    """counts (key, c) of the highest order -> kind, n, key, value: seen parts ('a') and back-off weights ('g') of each order."""
    tables = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):
        # continuation counts: how many n-grams one longer end with it
        tables[n] = tables[n + 1].groupBy(F.col("key").bitwiseAND(F.lit((1 << (BITS * n)) - 1)).alias("key")).agg(F.count("*").alias("c"))
    out = None
    for n, table in tables.items():
        of = table.agg(*[F.count(F.when(F.col("c") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
        n1, n2, n3, n4 = (of[f"n{k}"] for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
        cut = [k + 1 - (k + 2) * y * b / a if a and b else 0.75 * (k + 1) for k, a, b in ((0, n1, n2), (1, n2, n3), (2, n3, n4))]
        cut = [min(max(d, 0.05), k + 0.95) for k, d in enumerate(cut)]
        c = F.col("c")
        less = F.when(c == 1, cut[0]).when(c == 2, cut[1]).otherwise(cut[2])
        rows = table.withColumn("h", F.shiftright("key", BITS)).withColumn("less", less)
        context = rows.groupBy("h").agg(F.sum("c").alias("total"), F.sum("less").alias("freed"))
        seen = rows.join(context, "h").select(F.lit("a").alias("kind"), F.lit(n).alias("n"), "key", ((c - F.col("less")) / F.col("total")).alias("value"))
        freed = context.select(F.lit("g").alias("kind"), F.lit(n).alias("n"), F.col("h").alias("key"), (F.col("freed") / F.col("total")).alias("value"))
        both = seen.union(freed)
        out = both if out is None else out.union(both)
    return out


class Model:
    """log probabilities of all n-grams, filled in where they are used."""

    def __init__(self, table: pa.Table) -> None:
        kind, n = np.asarray(table["kind"]), np.asarray(table["n"])
        key, value = np.asarray(table["key"], dtype=np.int64), np.asarray(table["value"], dtype=np.float64)
        self.parts = {(k, m): (key[(kind == k) & (n == m)], value[(kind == k) & (n == m)]) for k in "ag" for m in range(1, ORDER + 1)}
        self.logs = None

    def __getstate__(self) -> dict:
        return {"parts": self.parts, "logs": None}

    def log_probabilities(self) -> np.ndarray:
        if self.logs is None:
            p = np.full(1, 1 / _SIZE)
            for n in range(1, ORDER + 1):
                back = np.ones(1 << (BITS * (n - 1)))
                key, value = self.parts["g", n]
                back[key] = value
                # p(w | h) from p(w | h without its first unit)
                lower = np.full(_SIZE, p[0]) if n == 1 else p
                low = np.tile(lower, max(1, (1 << (BITS * n)) // len(lower)))
                low *= np.repeat(back, _SIZE)
                key, value = self.parts["a", n]
                low[key] += value
                p = low
            self.logs = np.log(p).astype(np.float32)
        return self.logs


_MODELS: dict[str, Model] = {}


def train(docs: DataFrame, labels: DataFrame) -> Model:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    trusted = mark_ids(texts, trusted_ids(labels)).where("target = 1")
    counts = trusted.select("text").mapInArrow(_count, "key int, c long").groupBy("key").agg(F.sum("c").alias("c"))
    # at most 64**4 rows of each kind
    return Model(kneser_ney(store(counts, "ngrams")).toArrow())


def _score(model: Model, name: str):
    def run(batches):
        if name not in _MODELS:
            _MODELS.clear()
            _MODELS[name] = model
        logs = _MODELS[name].log_probabilities()
        for batch in batches:
            for part in slices(batch):
                key, first = ngrams(part["text"])
                run_ = np.concatenate([[0.0], np.cumsum(logs[key].astype(np.float64))])
                n = np.diff(first)
                loss = np.where(n > 0, -(run_[first[1:]] - run_[first[:-1]]) / np.maximum(n, 1), np.nan)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["lang"], pa.array(n.astype(np.int64)), pa.array(np.round(loss, 6), mask=n == 0)], ["doc_id", "lang", "n_scored", "loss"])

    return run


def quality_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, n_scored (n-grams), loss (mean negative log probability; null without n-grams)."""
    import uuid

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.col("lang"), F.lit("")).alias("lang"))
    return rows.mapInArrow(_score(model, uuid.uuid4().hex), "doc_id long, lang string, n_scored long, loss double")


def _levels(binned: DataFrame, key: str, quantile: float, slack: float) -> DataFrame:
    """key, threshold from counts per bin; a window over at most some 100,000 bins a key."""
    counts = binned.groupBy(key, "bin").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(key).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy(key))
    ranked = counts.select(key, "bin", upto.alias("upto"), total.alias("total"))
    at = ranked.groupBy(key).agg(F.min(F.when(F.col("upto") >= 0.5 * F.col("total"), F.col("bin"))).alias("mid"), F.min(F.when(F.col("upto") >= quantile * F.col("total"), F.col("bin"))).alias("high"))
    return at.select(key, ((F.col("mid") + (F.col("high") - F.col("mid")) * slack + 1) / BINS).alias("threshold"))


def quality_lm(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """One row per row of docs: doc_id, lang, n_scored, perplexity, threshold (perplexity), kept."""
    scores = store(quality_scores(docs, train(docs, labels)), "scores")
    trusted = scores.where("loss is not null").join(trusted_ids(labels), "doc_id", "left_semi")
    binned = trusted.groupBy("lang", F.floor(F.col("loss") * BINS).alias("bin")).agg(F.count("*").alias("n"))
    by_lang = _levels(binned, "lang", quantile, slack)
    overall = _levels(binned.withColumn("every", F.lit(1)), "every", quantile, slack).first()
    default = F.lit(overall["threshold"] if overall else None).cast("double")
    found = scores.join(by_lang, "lang", "left").withColumn("threshold", F.coalesce("threshold", default))
    kept = F.col("loss").isNotNull() & (F.col("threshold").isNull() | (F.col("loss") <= F.col("threshold")))
    return found.select("doc_id", "lang", "n_scored", F.exp("loss").alias("perplexity"), F.exp("threshold").alias("threshold"), kept.alias("kept"))
