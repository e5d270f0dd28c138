"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

Features of a text: densities and counts of insult words as written and after undoing
obfuscation (look-alike characters, inserted marks, drawn-out letters), second-person
density and insults near a second person, capitals, punctuation, symbols, obfuscated
words and length; and densities of a lexicon learned from the labels. They are counted
over the whole text with array operations.

The learned lexicon has words and word beginnings of 3 to 8 bytes. An entry's density is
its count over the words of a text; its statistic is Welch's t between the densities of
toxic rows and those of others. Entries of at least `MIN_ROWS` toxic rows, a statistic of
`MIN_T` and `MIN_RATIO` times the density qualify, the `LEXICON` with the largest
statistic are kept. No list of a language is needed and lang is never read.

The lexicon and the trees are fitted on at most `max_rows` labelled rows (the labels with
the smallest hash of doc_id, one row each; a documented bound: fitting cost doesn't grow
with the input). Rows are dealt into folds by doc_id; a row's learned features come from
the lexicon of the other folds, and out-of-fold predictions give the isotonic curve, so
neither sees the row's own label. Every document is scored.

Defined cases: null text is empty; empty texts are scored like any other; labels that are
null are not learned from, nor are rows with a null doc_id; of repeated labels for one
doc_id the largest counts, of repeated rows the smallest text is learned from; without
labels of both kinds every score is 0; each row is scored for itself, also with a null or
repeated doc_id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, mix, slices, store, text_buffer, text_table

MAX_ROWS = 20_000
REJECT = 0.7
NEAR_WORDS = 5
FOLDS = 4
#: the learned lexicon: bytes of a word's beginning, and what an entry must reach
STEMS = range(3, 9)
LEXICON, MIN_ROWS, MIN_T, MIN_RATIO = 512, 5, 3.0, 2.0
#: a text counts as having this many words at least, so that one word of a few is no density
LEAST_WORDS = 20

# fixed values: common insults, by language, and words that address somebody
INSULTS = (
    "idiot idiots idiotic stupid stupidity moron morons moronic imbecile dumb dumbass fool fools loser losers trash garbage "
    "scum scumbag worthless pathetic disgusting clown clowns pig pigs rat vermin filth filthy coward cowards jerk jerks ugly "
    "bastard bastards bitch asshole arsehole crap crappy shit shitty bullshit fuck fucking fucker damn retard retarded freak "
    "lunatic psycho creep creepy nasty hate hated hateful despise disgrace disgraceful useless brainless braindead ignorant "
    "liar liars parasite parasites cretin dimwit halfwit nitwit twit twat wanker douche douchebag whore slut degenerate "
    "abomination repulsive revolting vile sicko lowlife deadbeat dunce dolt dullard buffoon oaf sleazy slimeball "
    "idiote stupide imbécile crétin connard connasse salaud salope ordure merde minable nul débile abruti dégueulasse "
    "dumm dummkopf trottel schwachkopf arschloch scheisse scheiße mist abschaum widerlich wertlos versager blödmann hurensohn "
    "idiota estúpido estúpida imbécil tonto tonta basura mierda asqueroso inútil payaso cabrón escoria"
).split()
ADDRESSED = "you your yours yourself yourselves u ur youre tu toi te ton ta tes vous votre vos du dich dir dein deine ihr euch euer usted ustedes vosotros tuyo tuya".split()

FEATURES = ("insult_density", "insult_count", "plain_density", "hidden_count", "addressed_density", "near_addressed", "capitals", "exclaims", "questions", "symbols", "obfuscated_rate", "single_letters", "words", "learned_density", "learned_peak", "learned_weight", "learned_count")

_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[[*range(48, 58), *range(97, 123), *range(128, 256)]] = [*range(48, 58), *range(97, 123), *range(128, 256)]
_PLAIN[65:91] = np.arange(97, 123)
_PLAIN[[9, 10, 11, 12, 13]] = 32
_UNDONE = np.arange(256, dtype=np.uint8)
_UNDONE[65:91] += 32
for _a, _b in zip(b"013457@$!|", b"oieastasii", strict=True):
    _UNDONE[_a] = _b
_MARKS = np.zeros(256, bool)
_MARKS[list(b"*._-~^'\"`,;:#%&+=/\\()[]{}<>?")] = True
_KINDS = {name: np.isin(np.arange(256), list(codes)) for name, codes in {"upper": range(65, 91), "letter": [*range(65, 91), *range(97, 123)], "exclaim": b"!", "question": b"?", "symbol": b"#*$%&|<>@^~", "inner": b"013457@$!*"}.items()}


def _hashes(words: list[str], undone: bool) -> np.ndarray:
    data, offsets = text_buffer(pa.array(words))
    data, offsets = _unhide(data, offsets) if undone else (_PLAIN[data], offsets)
    return np.unique(Words(data, offsets).hash)


def _unhide(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Look-alikes become letters, inserted marks go, runs of one letter shrink to one."""
    keep = ~_MARKS[data]
    out = _UNDONE[data]
    same = np.zeros(len(out), bool)
    same[1:] = (out[1:] == out[:-1]) & (out[1:] > 32)
    inner = offsets[1:-1]
    same[inner[inner < len(out)]] = False
    keep &= ~same
    run = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], run[offsets]


def _member(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return known[at] == hashes


def _per_text(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(flags)])
    return np.diff(run[first]).astype(np.float64)


# ---------------------------------------------------------------- the learned lexicon
def plain_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Runs of letters and digits in lower case, Latin-1 letters included."""
    out = _PLAIN[data]
    if len(out):
        accented = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)
        out[1:][accented] += 32
    return Words(out, offsets)


def entries(words: Words):
    """Pairs (word numbers, keys): whole words, then beginnings of each size in STEMS."""
    yield np.arange(len(words.hash)), words.hash
    size = words.ends - words.starts
    key = np.zeros(len(size), np.uint64)
    for k in range(STEMS.stop - 1):
        at = np.flatnonzero(size > k)
        key[at] = (key[at] << np.uint64(8)) | words.data[words.starts[at] + k]
        if k + 1 in STEMS:
            yield at, mix(key[at] + mix(np.full(1, k + 1, np.uint64)))


def _densities(batches):
    """Of each entry and fold: rows, sums of densities and of their squares, for toxic and other rows."""
    for batch in batches:
        for part in slices(batch):
            words = plain_words(*text_buffer(part["text"]))
            fold, toxic = (np.asarray(part[c]).astype(np.int64) for c in ("fold", "toxic"))
            owner, n = words.doc, np.maximum(words.counts, LEAST_WORDS).astype(np.float64)
            keys, docs = [], []
            for at, key in entries(words):
                keys.append(key)
                docs.append(owner[at])
            key, doc = np.concatenate(keys), np.concatenate(docs)
            if not len(key):
                continue
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]))
            density = np.diff(np.append(new, len(key))) / n[doc[new]]
            key, group = key[new], fold[doc[new]] * 2 + toxic[doc[new]]
            order = np.lexsort((group, key))
            key, group, density = key[order], group[order], density[order]
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])]))
            sums = [np.add.reduceat(v, new) for v in (np.ones(len(density)), density, density**2)]
            for k in range(0, len(new), 1 << 16):
                cut = slice(k, k + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(key[new[cut]].view(np.int64)), pa.array(group[new[cut]]), *[pa.array(v[cut]) for v in sums]], ["key", "part", "rows", "s", "q"])


def learn_lexicons(rows: DataFrame, folds: int = FOLDS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Entries (sorted keys, log ratios of density) from rows (text, toxic, fold): of all rows, then without each fold."""
    sizes = {(r["fold"], r["toxic"]): r["count"] for r in rows.groupBy("fold", "toxic").count().collect()}
    found = rows.select("text", "toxic", "fold").mapInArrow(_densities, "key long, part long, rows double, s double, q double")
    parts = [(c, k, t) for c in ("rows", "s", "q") for k in range(folds) for t in (0, 1)]
    wide = found.groupBy("key").agg(*[F.expr(f"sum(if(part = {2 * k + t}, {c}, 0D)) AS {c}{k}{t}") for c, k, t in parts])
    tried = []
    for number, without in enumerate((None, *range(folds))):
        used = [k for k in range(folds) if k != without]
        of = {t: max(1, sum(sizes.get((k, t), 0) for k in used)) for t in (1, 0)}
        mean = {(c, t): f"(({' + '.join(f'{c}{k}{t}' for k in used) or '0D'}) / {of[t]})" for c in ("s", "q") for t in (1, 0)}
        spread = " + ".join(f"({mean['q', t]} - {mean['s', t]} * {mean['s', t]}) / {of[t]}" for t in (1, 0))
        n = " + ".join(f"rows{k}1" for k in used) or "0D"
        # a density of one word in 100,000 is taken to be met by chance
        tried.append(f"struct({number} AS lexicon, {n} AS n, ({mean['s', 1]} - {mean['s', 0]}) / sqrt(greatest({spread}, 0D) + 1e-12D) AS t, ({mean['s', 1]} + 1e-5D) / ({mean['s', 0]} + 1e-5D) AS ratio)")
    best = wide.selectExpr("key", f"inline(array({', '.join(tried)}))").where(f"n >= {MIN_ROWS} AND t >= {MIN_T} AND ratio >= {MIN_RATIO}")
    rank = F.row_number().over(Window.partitionBy("lexicon").orderBy(F.desc("t"), "key"))
    # LEXICON rows at most for each
    best = best.withColumn("rank", rank).where(F.col("rank") <= LEXICON).select("lexicon", "key", "ratio").toArrow()
    number, key = np.asarray(best["lexicon"], dtype=np.int64), np.asarray(best["key"], dtype=np.int64).view(np.uint64)
    weight, order = np.log(np.asarray(best["ratio"], dtype=np.float64)), np.argsort(key)
    return [(key[at], weight[at]) for k in range(folds + 1) for at in [order[number[order] == k]]]


def learned_features(words: Words, lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Share of words that an entry meets, the largest density of one entry, the mean weight, and the count."""
    known, weight = lexicon
    owner, n = words.doc, np.maximum(words.counts, LEAST_WORDS).astype(np.float64)
    if not len(known):
        return np.zeros((len(n), 4))
    best, peak = np.zeros(len(owner)), np.zeros(len(n))
    for at, key in entries(words):
        place = np.minimum(np.searchsorted(known, key), len(known) - 1)
        hit = known[place] == key
        at, place = at[hit], place[hit]
        best[at] = np.maximum(best[at], weight[place])
        cell, times = np.unique(owner[at] * len(known) + place, return_counts=True)
        np.maximum.at(peak, cell // len(known), times / n[cell // len(known)])
    met = _per_text(best > 0, words.first)
    run = np.concatenate([[0], np.cumsum(best)])
    return np.stack([met / n, peak, np.diff(run[words.first]) / n, np.log1p(met)], axis=1)


def text_features(column: pa.Array, lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One row of FEATURES for each text."""
    data, offsets = text_buffer(column)
    plain, hidden = plain_words(data, offsets), Words(*_unhide(data, offsets))
    insult, addressed = _member(plain.hash, _SETS[0]), _member(plain.hash, _SETS[2])
    near = np.zeros(len(insult), bool)
    owner = plain.doc
    run = np.concatenate([[0], np.cumsum(addressed)])
    at = np.flatnonzero(insult)
    if len(at):
        lo, hi = np.maximum(at - NEAR_WORDS, plain.first[owner[at]]), np.minimum(at + NEAR_WORDS + 1, plain.first[owner[at] + 1])
        near[at] = run[hi] > run[lo]
    undone = _per_text(_member(hidden.hash, _SETS[1]), hidden.first)
    seen = _per_text(insult, plain.first)
    n = np.maximum(plain.counts, 1).astype(np.float64)
    kinds = {k: _per_text(v[data], offsets) for k, v in _KINDS.items()}
    size = np.maximum(np.diff(offsets), 1).astype(np.float64)
    # a mark or digit between two letters
    inner = np.zeros(len(data), bool)
    letter = _KINDS["letter"][data]
    inner[1:-1] = _KINDS["inner"][data[1:-1]] & letter[:-2] & letter[2:]
    single = (plain.ends - plain.starts) == 1
    most = np.maximum(seen, undone)
    columns = [most / n, np.log1p(most), seen / n, np.maximum(undone - seen, 0), _per_text(addressed, plain.first) / n, _per_text(near, plain.first), kinds["upper"] / np.maximum(kinds["letter"], 1), kinds["exclaim"] / size, kinds["question"] / size, kinds["symbol"] / size, _per_text(inner, offsets) / n, _per_text(single, plain.first) / n, np.log1p(plain.counts)]
    return np.concatenate([np.stack(columns, axis=1), learned_features(plain, lexicon)], axis=1)


_SETS = (_hashes(INSULTS, False), _hashes(INSULTS, True), _hashes(ADDRESSED, False))


# ---------------------------------------------------------------- trees
class Boosted:
    """Depth-limited trees on binned features, fitted by second-order logistic boosting."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 2.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        # cuts lie halfway between neighbouring values, so scoring meets no ties
        self.cuts = []
        for f in range(x.shape[1]):
            u = np.unique(x[:, f])
            mid = (u[1:] + u[:-1]) / 2
            self.cuts.append(mid if len(mid) < self.bins else np.unique(mid[np.linspace(0, len(mid) - 1, self.bins - 1).astype(int)]))
        codes = self._codes(x)
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(p / (1 - p)))
        z = np.full(len(y), self.base)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-z))
            tree = self._grow(codes, q - y, np.maximum(q * (1 - q), 1e-6))
            self.trees.append(tree)
            z += self._walk(tree, codes)
        return self

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], "right") for f, c in enumerate(self.cuts)], axis=1)

    def _grow(self, codes: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inner = (1 << self.depth) - 1
        feature, cut, leaf = np.zeros(inner, np.int64), np.full(inner, self.bins), np.zeros(inner + 1)
        node = np.zeros(len(g), np.int64)
        for level in range(self.depth):
            base, width = (1 << level) - 1, 1 << level
            best = np.full(width, 1e-9)
            for f in range(codes.shape[1]):
                cell = (node - base) * (self.bins + 1) + codes[:, f]
                sg, sh = (np.bincount(cell, weights=v, minlength=width * (self.bins + 1)).reshape(width, -1) for v in (g, h))
                lg, lh = np.cumsum(sg, 1), np.cumsum(sh, 1)
                tg, th = lg[:, -1:], lh[:, -1:]
                gain = lg**2 / (lh + self.ridge) + (tg - lg) ** 2 / (th - lh + self.ridge) - tg**2 / (th + self.ridge)
                gain[(lh < 1) | (th - lh < 1)] = 0
                at = gain.argmax(1)
                better = gain[np.arange(width), at] > best
                best[better] = gain[np.arange(width), at][better]
                feature[base : base + width][better], cut[base : base + width][better] = f, at[better]
            node = 2 * node + 1 + (codes[np.arange(len(g)), feature[node]] > cut[node])
        sums = [np.bincount(node - inner, weights=v, minlength=inner + 1) for v in (g, h)]
        leaf[:] = -self.rate * sums[0] / (sums[1] + self.ridge)
        return feature, cut, leaf

    def _walk(self, tree: tuple, codes: np.ndarray) -> np.ndarray:
        feature, cut, leaf = tree
        node, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
        for _ in range(self.depth):
            node = 2 * node + 1 + (codes[rows, feature[node]] > cut[node])
        return leaf[node - len(feature)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        codes = self._codes(x)
        return self.base + sum((self._walk(t, codes) for t in self.trees), np.zeros(len(x)))


def isotonic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots and values of the best non-decreasing curve."""
    knots, index = np.unique(z, return_inverse=True)
    weight = np.bincount(index).astype(float)
    means = np.bincount(index, weights=y) / weight
    blocks: list[list[float]] = []
    for i in range(len(knots)):
        blocks.append([means[i], weight[i], 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, w, n = blocks.pop()
            blocks[-1] = [(blocks[-1][0] * blocks[-1][1] + v * w) / (blocks[-1][1] + w), blocks[-1][1] + w, blocks[-1][2] + n]
    return knots, np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


class Scorer:
    """Trees and calibration curve; the raw margin breaks ties of the curve."""

    def __init__(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray]) -> None:
        self.model, self.lexicon = None, lexicon
        if len(y) < 2 or y.min() == y.max():
            return
        out = np.zeros(len(y))
        for k in np.unique(fold):
            rest = fold != k
            out[~rest] = Boosted().fit(x[rest], y[rest]).margin(x[~rest]) if rest.any() else 0
        self.knots, self.values = isotonic(np.round(out, 1), y)
        self.model = Boosted().fit(x, y)

    def score(self, column: pa.Array) -> np.ndarray:
        if self.model is None:
            return np.zeros(len(column))
        z = self.model.margin(text_features(column, self.lexicon))
        return 0.99 * np.interp(z, self.knots, self.values) + 0.01 / (1 + np.exp(-z))


def _features(lexicons: list):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                fold = np.asarray(part["fold"])
                x = np.zeros((part.num_rows, len(FEATURES)))
                for k in np.unique(fold):
                    at = np.flatnonzero(fold == k)
                    # by the lexicon that hasn't seen the row
                    x[at] = text_features(part["text"].take(pa.array(at)), lexicons[k + 1])
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["toxic"], part["fold"], pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["doc_id", "toxic", "fold", "x"])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Scorer:
    """A scorer from labels (doc_id, toxic) of docs; at most max_rows of them."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # max_rows pairs of numbers at most, so this broadcast is bounded by the parameter
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = text_table(docs).join(F.broadcast(known), "doc_id").repartition(parts, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = store(rows.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")), "labelled")
    lexicons = learn_lexicons(rows)
    found = rows.mapInArrow(_features(lexicons), "doc_id long, toxic int, fold int, x array<double>").toArrow().sort_by("doc_id")
    x = np.asarray(found["x"].combine_chunks().flatten()).reshape(-1, len(FEATURES)) if found.num_rows else np.zeros((0, len(FEATURES)))
    return Scorer(x, np.asarray(found["toxic"], dtype=np.float64), np.asarray(found["fold"]), lexicons[0])


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, reject: float = REJECT, learn_from: Column | None = None) -> DataFrame:
    """One row per row of docs: doc_id, score, predicted. learn_from: which labels may be learned from."""
    scorer = fit_toxicity(docs, labels if learn_from is None else labels.where(learn_from), max_rows)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                score = np.clip(scorer.score(part["text"]), 0, 1)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(score), pa.array((score >= reject).astype(np.int32))], ["doc_id", "score", "predicted"])

    return text_table(docs).mapInArrow(run, "doc_id long, score double, predicted int")
