"""Quality classifier: an interpolated modified Kneser-Ney model of the words of trusted text, thresholded by language.

The units are words (ASCII letters in lower case) and single ASCII marks, the order is 3; a text is read between two begin marks and one end
mark, so every unit and the end are scored. Counts of all trusted documents (labelled
quality 1) are gathered without a bound on vocabulary or contexts, and joined with the
n-grams of all documents in shards: p is what a shard has for a trigram of its own, plus
a weight times p of the bigram, which is made in the same way of what the shards of
bigrams and of words have. Nothing that grows with the input is collected or sent to all
tasks but the ids of trusted documents (mark_ids).

Disk is bounded by passes over all texts: a pass takes the trigrams whose middle word is in
some of 1024 buckets, dealt out evenly by weight, so that all counts of a trigram, of its
context and of its bigram fall in one pass. Only a pass's sums are kept; the files
of its shuffles are deleted when it ends. Numbers of words (continuations, and as
contexts) and discounts come from passes over the trusted texts before.

A document that the model has read looks better than it is. Therefore the trusted are
dealt into two halves by doc_id, and each is scored by the model of the other half (by
that of all, if the other is empty); all others are scored by the model of all. The
threshold is the `QUANTILE` quantile of the losses of the language's trusted documents,
read from counts in bins of 1/10000: the upper end of its bin.

Words and contexts are told apart by 64-bit hashes; in a shard of a pass, bigrams and words
asked for by 48 bits; and the words after one context or before one bigram by 32 bits.
Rows alike in doc_id, lang,
text (by a 64-bit hash) and number of words are scored alike.

Defined cases: null text is empty; a text without words has no perplexity and is
rejected; a language without trusted documents (null counts as '') takes the threshold
of all trusted documents, and without any trusted document perplexities are 1 and nothing is
rejected but texts without words; each row is judged for itself, and a repeated doc_id
counts as trusted if its smallest label is 1; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, _SPACE, SLICE_BYTES, mark_ids, mix, slices, store, text_buffer
from .quality_lm import BINS, _levels, trusted_ids

QUANTILE = 0.99

#: rows of a slice, so that two bytes hold a place in it
ROWS = 60_000
#: the passes that score, and those before that count words; by middle words, in so many buckets
PASSES, TURNS, BUCKETS = 10, 2, 1024
#: shards at least
SHARDS = 8
#: sums of log probabilities are kept in units of 1/UNIT, so that they come out alike in every run
UNIT = 1e9
#: counts, and the models made of them: of all trusted documents, of the first half, of the second
MODELS = ("", "0", "1")

_U = np.uint64
_LOW = _U(0xFFFFFFFF)
#: of each byte: 0 white space, 1 of a word, 2 a mark
_KIND = bytes(0 if _SPACE[b] else 2 if 33 <= b < 127 and not chr(b).isalnum() else 1 for b in range(256))
_LOWERED = _LOWER.tobytes()
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: bytes of a word that are hashed eight at a time; a longer one is hashed for itself
LONG = 64
_BEGIN, _END = _U(0x5851F42D4C957F2D), _U(0x14057B7EF767814F)
_BEGIN_BUCKET = 0


# ---------------------------------------------------------------- n-grams
def _parts(batch: pa.RecordBatch):
    for part in slices(batch, limit=2 * SLICE_BYTES):
        for at in range(0, part.num_rows, ROWS):
            yield part.slice(at, ROWS)


class Units:
    """The words and marks of several texts, with the marks around each text; hashed where they are asked for."""

    def __init__(self, column: pa.Array) -> None:
        data, offsets = text_buffer(column)
        raw = data.tobytes()
        kind = np.frombuffer(raw.translate(_KIND), np.uint8)
        # a unit begins at a mark, at a byte of a word after none, and where a text does
        new = kind > 0
        over = new.copy()
        inside = kind == 1
        run = inside[1:] & inside[:-1]
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]
        run[edge - 1] = False
        new[1:] &= ~run
        over[:-1] &= ~run
        starts = np.flatnonzero(new)
        ends = np.flatnonzero(over) + 1
        self.size = ends - starts
        first = np.searchsorted(starts, offsets)
        self.n = np.diff(first)
        self.data = np.frombuffer(raw.translate(_LOWERED) + bytes(8), np.uint8)
        eight = np.ndarray(len(data) + 1, "<u8", self.data, strides=(1,))
        self.starts, self.eight = starts, eight
        # a bucket is told by a unit's first and last byte and its length
        first_, last = self.data[starts].astype(np.uint16), self.data[ends - 1].astype(np.uint16)
        self.bucket = (first_ * np.uint16(40503) + last * np.uint16(30345) + self.size.astype(np.uint16) * np.uint16(19813)) >> np.uint16(6)
        # places: two begin marks, the units, an end mark
        self.units, self.first = first, np.concatenate([[0], np.cumsum(self.n + 3)])

    def middles(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first places of the trigrams whose middle unit's bucket is chosen, and their texts, of texts with units."""
        at = np.flatnonzero(chosen[self.bucket])
        doc = np.searchsorted(self.units, at, "right") - 1
        at = at + 3 * doc + 1
        if chosen[_BEGIN_BUCKET]:
            some = np.flatnonzero(self.n)
            at, doc = np.concatenate([at, self.first[some]]), np.concatenate([doc, some])
            order = np.argsort(at)
            at, doc = at[order], doc[order]
        return at, doc

    def weights(self, chosen: np.ndarray) -> np.ndarray:
        """How many trigrams have their middle unit in each of the chosen buckets."""
        out = np.bincount(self.bucket, minlength=BUCKETS)
        out[_BEGIN_BUCKET] += np.count_nonzero(self.n)
        return np.where(chosen, out, 0)

    def hash(self, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The hashes of the units at some places of these texts."""
        out = np.full(len(at), _BEGIN)
        inner = at - self.first[doc] - 2
        out[inner == self.n[doc]] = _END
        some = np.flatnonzero((inner >= 0) & (inner < self.n[doc]))
        k = at[some] - 3 * doc[some] - 2
        size = self.size[k]
        at = self.starts[k]
        value = self._mixed(size.astype(np.uint64), at, size)
        more = np.flatnonzero(size > 8)
        for j in range(8, LONG, 8):
            if not len(more):
                break
            value[more] = self._mixed(value[more], at[more] + j, size[more] - j)
            more = more[size[more] > j + 8]
        value = mix(value)
        for x in np.flatnonzero(size > LONG).tolist():
            s = int(self.starts[k[x]])
            value[x] = int.from_bytes(hashlib.blake2b(self.data[s : s + int(size[x])], digest_size=8).digest(), "little")
        out[some] = value
        return out

    def _mixed(self, value: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        value = (value * _U(0xD1342543DE82EF95) + (self.eight[at] & _MASK[np.minimum(left, 8)])) * _U(0x9E3779B97F4A7C15)
        return value ^ (value >> _U(29))

    def trigrams(self, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
        return tuple(self.hash(at + j, doc) for j in range(3))


def half(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64) + _U(1)) & _U(1)).astype(np.uint8)


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(0).to_numpy(zero_copy_only=False)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _U(0x9E3779B97F4A7C15) + b)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The upper halves of two hashes."""
    return (a & ~_LOW) | (b >> _U(32))


def _place(key: np.ndarray, shards: int) -> np.ndarray:
    return ((key & _LOW) % _U(shards)).astype(np.uint16 if shards <= 1 << 16 else np.uint32)


def _order(shard: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by shard and key, and which rows there begin another."""
    order = np.argsort(key)
    order = order[np.argsort(shard[order], kind="stable")]
    s, k = shard[order], key[order]
    return order, np.concatenate([np.ones(min(1, len(k)), bool), (s[1:] != s[:-1]) | (k[1:] != k[:-1])])


def _back(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """For each row its number among the distinct ones."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def _groups(order: np.ndarray, shard: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Which rows of an order by shard and joined hashes begin another first hash."""
    f, s = full[order], shard[order]
    return np.concatenate([np.ones(min(1, len(f)), bool), (f[1:] != f[:-1]) | (s[1:] != s[:-1])])


def _six(key: np.ndarray) -> bytes:
    """The upper six bytes of each hash."""
    return key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _of_six(b) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


# ---------------------------------------------------------------- arrays as bytes
def _pack(a: np.ndarray) -> bytes:
    """The array in the narrowest type of its kind; hashes as they are."""
    if a.dtype.kind == "i":
        a = a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))
    raw = a.tobytes()
    return a.dtype.char.encode() + len(raw).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def _unpack(b: bytes) -> np.ndarray:
    size = int.from_bytes(b[1:9], "little")
    return np.frombuffer(pa.decompress(b[9:], size, "zstd", asbytes=True) if size else b"", np.dtype(b[:1].decode()))


def _to_ipc(table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write(table)
    return sink.getvalue().to_pybytes()


def _from_ipc(b: bytes) -> pa.Table:
    return pa.ipc.open_stream(b).read_all()


def _batch(rows: list[tuple], schema: pa.Schema, kind=pa.RecordBatch):
    return kind.from_arrays([pa.array([x[j] for x in rows], t) for j, t in enumerate(schema.types)], schema=schema)


def _sql(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _stored(df: DataFrame, name: str) -> DataFrame:
    """store(), after which the files of its shuffles are deleted at once, so that those of one pass only take up disk."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return store(df, name)
    finally:
        if before is None:
            conf.unset(key)
        else:
            conf.set(key, before)


def _delete(df: DataFrame) -> None:
    """Delete the folders of stored tables that nothing reads any more."""
    spark = df.sparkSession
    for folder in {x.rpartition("/")[0] for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# ---------------------------------------------------------------- counts of words, and discounts
_TALLIED = pa.schema([("shard", pa.int32()), ("half", pa.int32()), *[(x, pa.binary()) for x in ("tail", "count", "size", "w2", "w3", "buckets")]])
_WORDS = pa.schema([("shard", pa.int32()), ("words", pa.binary()), ("stats", pa.binary())])
#: numbers of each word and model: continuations, their sum and classes as a context
_NUMBERS = [f"{x}{m}" for x in ("c", "total", "one", "two", "more") for m in MODELS]


def _by_bigram(shards: int, turn: int):
    """A slice's trigrams of one half with a middle word of this turn, dealt by their last two words."""

    def run(batches):
        for batch in batches:
            for part in _parts(batch):
                units = Units(part["text"])
                all_, doc = units.middles(np.arange(BUCKETS) % TURNS == turn)
                of = half(_ids(part["doc_id"]))[doc]
                bucket = units.weights(np.arange(BUCKETS) % TURNS == turn)
                rows = []
                for h in (0, 1):
                    own = np.flatnonzero(of == h)
                    w1, w2, w3 = units.trigrams(all_[own], doc[own])
                    bi = _pair(w2, w3)
                    shard, key = _place(bi, shards), _joined(bi, w1)
                    order, new = _order(shard, key)
                    pair = _groups(order, shard, bi)
                    first = np.flatnonzero(new | pair)
                    count, pick, pair = np.diff(np.append(first, len(order))), order[first], pair[first]
                    ends = np.searchsorted(shard[pick], np.arange(shards + 1))
                    for s in np.flatnonzero(np.diff(ends)).tolist():
                        x = slice(ends[s], ends[s + 1])
                        lead = pick[x][pair[x]]
                        rows.append((s, h, _low(w1[pick[x]]), _pack(count[x]), _pack(_sizes(pair[x])), w2[lead].tobytes(), w3[lead].tobytes(), b""))
                if rows:
                    rows[0] = (*rows[0][:-1], _pack(bucket))
                    yield _batch(rows, _TALLIED)

    return run


def _models(first: np.ndarray, second: np.ndarray) -> list[np.ndarray]:
    return [first + second, first, second]


def _low(w: np.ndarray) -> bytes:
    return (w >> _U(32)).astype(np.uint32).tobytes()


def _sizes(new: np.ndarray) -> np.ndarray:
    return np.diff(np.append(np.flatnonzero(new), len(new)))


def _distinct(rows: pa.Table, groups: list[np.ndarray], sizes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of a shard's rows, with some n-grams of each group: the groups, sorted; the distinct n-grams (number of the group, 32 bits), and their counts in each model."""
    tails = [np.frombuffer(x.as_buffer(), np.uint32) for x in rows["tail"]]
    group, rank = np.unique(np.concatenate(groups), return_inverse=True)
    grams = (np.repeat(rank, np.concatenate(sizes)).astype(np.uint64) << _U(32)) | np.concatenate(tails)
    key, back = np.unique(grams, return_inverse=True)
    halves = np.repeat(rows["half"].to_numpy(), [len(x) for x in tails])
    count = np.concatenate([_unpack(x.as_py()) for x in rows["count"]]).astype(np.float64)
    parts = [np.bincount(back[halves == h], weights=count[halves == h], minlength=len(key)).astype(np.int64) for h in (0, 1)]
    return group, key, _models(*parts)


def _starts(group: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(group)), bool), group[1:] != group[:-1]]))


def _classes(counts: list[np.ndarray]) -> list[int]:
    """For each model how many n-grams occur 1, 2, 3 and 4 times."""
    return [int((c == k).sum()) for c in counts for k in (1, 2, 3, 4)]


def _tally(shards: int):
    """What a shard's bigrams say of their words, dealt by word; and its classes of counts."""

    def run(rows: pa.Table) -> pa.Table:
        w2, w3 = ([np.frombuffer(x.as_buffer(), np.uint64) for x in rows[n]] for n in ("w2", "w3"))
        pairs = [_pair(a, b) for a, b in zip(w2, w3, strict=True)]
        _, key, c3 = _distinct(rows, pairs, [_unpack(x.as_py()) for x in rows["size"]])
        at = _starts(key >> _U(32))
        c2 = [np.add.reduceat((c > 0).astype(np.int64), at) for c in c3]
        # the words of each bigram
        _, lead = np.unique(np.concatenate(pairs), return_index=True)
        w2, w3 = np.concatenate(w2)[lead], np.concatenate(w3)[lead]
        word, back = np.unique(np.concatenate([w2, w3]), return_inverse=True)
        as2, as3 = back[: len(w2)], back[len(w2) :]
        sums = lambda at, x: np.bincount(at, weights=x, minlength=len(word)).astype(np.int64)
        columns = [sums(as3, c > 0) for c in c2] + [sums(as2, c) for c in c2] + [sums(as2, c == k) for k in (1, 2) for c in c2] + [sums(as2, c > 2) for c in c2]
        weight = sum((_unpack(x.as_py()).astype(np.int64) for x in rows["buckets"] if len(x.as_buffer())), np.zeros(BUCKETS, np.int64))
        shard = _place(word, shards)
        order = np.argsort(shard, kind="stable")
        ends = np.searchsorted(shard[order], np.arange(shards + 1))
        out = []
        stats = _pack(np.concatenate([_classes(c3), _classes(c2), weight]).astype(np.int64))
        for s in range(shards):
            x = order[ends[s] : ends[s + 1]]
            if len(x) or stats:
                out.append((s, _to_ipc(pa.table([pa.array(word[x]), *[pa.array(c[x]) for c in columns]], names=["word", *_NUMBERS])), stats))
                stats = b""
        return _batch(out, _WORDS, pa.Table)

    return run


def _merge(rows: pa.Table) -> pa.Table:
    """A shard's words with the sums of their numbers."""
    parts = pa.concat_tables([_from_ipc(x.as_py()) for x in rows["words"]])
    word, back = np.unique(parts["word"].to_numpy(), return_inverse=True)
    columns = [np.bincount(back, weights=parts[n].to_numpy(), minlength=len(word)).astype(np.int64) for n in _NUMBERS]
    stats = [_unpack(x.as_py()).astype(np.int64) for x in rows["stats"] if len(x.as_buffer())]
    table = pa.table([pa.array(word), *[pa.array(c) for c in columns]], names=["word", *_NUMBERS])
    return _batch([(rows["shard"][0].as_py(), _to_ipc(table), _pack(sum(stats)) if stats else b"")], _WORDS, pa.Table)


def _word_classes(batches):
    for batch in batches:
        for b in batch["words"]:
            table = _from_ipc(b.as_py())
            c1 = [table[f"c{m}"].to_numpy() for m in MODELS]
            yield _batch([(_pack(np.array([*_classes(c1), *[int(c.sum()) for c in c1], *[int((c > 0).sum()) for c in c1]], np.int64)),)], pa.schema([("stats", pa.binary())]))


class Discounts:
    """What a count loses in each model, by order; and how words are shared out that no context has."""

    def __init__(self, stats: np.ndarray, words: np.ndarray) -> None:
        classes = [stats[:12].reshape(3, 4), stats[12:24].reshape(3, 4), words[:12].reshape(3, 4)]
        self.cut = {n: [self._cut(*c.tolist()) for c in table] for n, table in zip((3, 2, 1), classes, strict=True)}
        self.total, self.types = words[12:15], words[15:18]
        self.ones = classes[2]

    @staticmethod
    def _cut(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
        y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
        cut = [k + 1 - (k + 2) * y * b / a if a and b else 0.75 * (k + 1) for k, a, b in ((0, n1, n2), (1, n2, n3), (2, n3, n4))]
        return np.array([0.0, *[min(max(d, 0.05), k + 0.95) for k, d in enumerate(cut)]])

    def of(self, n: int, m: int, c: np.ndarray) -> np.ndarray:
        return self.cut[n][m][np.minimum(c, 3)]

    def base(self, m: int) -> float:
        """p of one of the words seen, or another, from what all words lose."""
        one, two = self.ones[m][:2].tolist()
        lost = float(self.cut[1][m] @ [0, one, two, self.types[m] - one - two])
        return lost / float(self.total[m]) / (float(self.types[m]) + 1) if self.total[m] else 1.0


def count_words(trusted: DataFrame, shards: int) -> tuple[DataFrame, Discounts, np.ndarray]:
    """(shard, words, stats), the discounts, and how many trigrams have their middle word in each bucket."""
    found = None
    for turn in range(TURNS):
        dealt = trusted.mapInArrow(_by_bigram(shards, turn), _sql(_TALLIED))
        told = dealt.groupBy("shard").applyInArrow(_tally(shards), _sql(_WORDS))
        part = _stored(told.groupBy("shard").applyInArrow(_merge, _sql(_WORDS)), "turn")
        found = part if found is None else found.union(part)
    words = _stored(found.groupBy("shard").applyInArrow(_merge, _sql(_WORDS)), "words")
    _delete(found)
    sums = lambda rows, size: sum((_unpack(r[0]).astype(np.int64) for r in rows if len(r[0])), np.zeros(size, np.int64))
    stats = sums(words.select("stats").collect(), 24 + BUCKETS)
    return words, Discounts(stats, sums(words.mapInArrow(_word_classes, "stats binary").collect(), 18)), stats[24:]


# ---------------------------------------------------------------- scores
_DEALT = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("half", pa.int32()), *[(x, pa.binary()) for x in ("grams", "count", "size", "tail")]])
_ANSWER = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("first", pa.binary()), ("second", pa.binary())])
#: values of half besides 0 and 1: a text that no model has read, what is known of a block, the words' numbers
_OTHER, _INFO, _TABLE = 2, 3, 4
_PASS = "doc_id long, lang string, content long, n_scored long, total long"


def _deal(shards: int, turns: np.ndarray, turn: int):
    """A slice's texts in blocks of one half; a block's n-grams with a middle word of this turn, by shard.

    Shards are three ranges: trigrams by their first two words, bigrams, words. The rows of
    trusted blocks are both counted and looked up.
    """

    def run(batches):
        task, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in _parts(batch):
                units = Units(part["text"])
                n = units.n
                halves = np.where(part["target"].fill_null(0).to_numpy(zero_copy_only=False) == 1, half(_ids(part["doc_id"])), _OTHER)
                all_, doc = units.middles(turns == turn)
                for h in np.unique(halves).tolist():
                    own = np.flatnonzero(halves == h)
                    block, k = (task << 32) + k, k + 1
                    of = np.flatnonzero(halves[doc] == h)
                    rows, info = _block(*units.trigrams(all_[of], doc[of]), np.searchsorted(own, doc[of]), shards, block, h)
                    docs = pa.table([part[x].take(pa.array(own)) for x in ("doc_id", "lang", "content")] + [pa.array(n[own].astype(np.int64))], names=["doc_id", "lang", "content", "n"])
                    rows.append((block % (3 * shards), block, _INFO, _to_ipc(docs), info, b"", b""))
                    yield _batch(rows, _DEALT)

    return run


def _block(w1, w2, w3, doc, shards: int, block: int, h: int) -> tuple[list[tuple], bytes]:
    context, bi = _pair(w1, w2), _pair(w2, w3)
    shard, key = _place(context, shards), _joined(context, _pair(context, w3))
    order, new = _order(shard, key)
    begins = _groups(order, shard, context)
    first = np.flatnonzero(new | begins)
    count, pick, doc_of, begins = np.diff(np.append(first, len(order))), order[first], doc[order], begins[first]
    shard, key, context = shard[pick], key[pick], context[pick]
    rows = []
    ends = np.searchsorted(shard, np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(ends)).tolist():
        x = slice(ends[s], ends[s + 1])
        rows.append((s, block, h, context[x][begins[x]].tobytes(), _pack(count[x]) if h != _OTHER else b"", _pack(_sizes(begins[x])), (key[x] & _LOW).astype(np.uint32).tobytes()))
    # bigrams, with the words before them where these count
    bi, w1, w2, w3 = bi[pick], w1[pick], w2[pick], w3[pick]
    shard = _place(bi, shards)
    order, _ = _order(shard, _joined(bi, w1))
    new = _groups(order, shard, bi)
    bigram_of = _back(order, new)
    ends = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(ends)).tolist():
        x = order[ends[s] : ends[s + 1]]
        own = new[ends[s] : ends[s + 1]]
        count_ = (_pack(np.ones(len(x), np.int64)), _pack(_sizes(own)), _low(w1[x])) if h != _OTHER else (b"", b"", b"")
        rows.append((shards + s, block, h, _six(bi[x[own]]), *count_))
    lead = order[new]
    ends, words, of = {}, {}, {}
    for name, w in (("w3", w3[lead]), ("w2", w2[lead])):
        place = _place(w, shards)
        order, new = _order(place, w)
        of[name], words[name] = _back(order, new), w[order][new]
        ends[name] = np.searchsorted(place[order][new], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(ends["w3"]) + np.diff(ends["w2"])).tolist():
        rows.append((2 * shards + s, block, h, *[_six(words[x][ends[x][s] : ends[x][s + 1]]) for x in ("w3", "w2")], b"", b""))
    parts = pa.schema([(str(j), pa.binary()) for j in range(5)])
    return rows, _to_ipc(_batch([tuple(_pack(x) for x in (doc_of, count, bigram_of, of["w3"], of["w2"]))], parts, pa.Table))


def _find(key: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where of is in key (sorted, not empty), and whether."""
    at = np.minimum(np.searchsorted(key, of), len(key) - 1)
    return at, key[at] == of


def _look_up(shards: int, cut: Discounts):
    """A shard's counts joined with the n-grams asked for: of trigrams the share of the probability that they have of their own and the weight of the shorter n-gram; of bigrams the discounted count; of words their probability, what divides counts after them, and the weight of the next word alone."""

    def model(h: int) -> int:
        # the other half, or all
        m = {0: 2, 1: 1}.get(h, 0)
        return m if cut.total[m] else 0

    def run(rows: pa.Table) -> pa.Table:
        shard = rows["shard"][0].as_py()
        kind, half_ = shard // shards, rows["half"].to_numpy()
        out = [(rows["block"][int(k)].as_py(), -1, rows["grams"][int(k)].as_py(), rows["count"][int(k)].as_py()) for k in np.flatnonzero(half_ == _INFO)]
        ask = np.flatnonzero(half_ <= _OTHER).tolist()
        read = rows.filter(pa.array(half_ < _OTHER))
        get = lambda k, name, t: np.frombuffer(rows[name][k].as_buffer(), t)
        tell = lambda k, *parts: out.append((rows["block"][k].as_py(), shard, *[_pack(x.astype(np.float32)) for x in parts], *[b""] * (2 - len(parts))))
        if kind == 0:
            unpacked = lambda x: [_unpack(y.as_py()) for y in x]
            context, key, counts = np.zeros(1, np.uint64), np.zeros(1, np.uint64), [np.zeros(1, np.int64)] * 3
            if read.num_rows:
                context, key, counts = _distinct(read, [np.frombuffer(x.as_buffer(), np.uint64) for x in read["grams"]], unpacked(read["size"]))
            at = _starts(key >> _U(32))
            size = np.diff(np.append(at, len(key)))
            share, weight = [], []
            for m in range(3):
                less = cut.of(3, m, counts[m])
                total = np.add.reduceat(counts[m], at)
                share.append((counts[m] - less) / np.repeat(np.maximum(total, 1), size))
                weight.append(np.where(total > 0, np.add.reduceat(less, at) / np.maximum(total, 1), 1.0))
            for k in ask:
                m, times = model(int(half_[k])), _unpack(rows["size"][k].as_py())
                y, begun = _find(context, get(k, "grams", np.uint64))
                asked = (np.repeat(y, times).astype(np.uint64) << _U(32)) | get(k, "tail", np.uint32)
                x, known = _find(key, asked)
                tell(k, np.where(known & np.repeat(begun, times), share[m][x], 0.0), np.repeat(np.where(begun, weight[m][y], 1.0), times))
        elif kind == 1:
            value = [np.zeros(1)] * 3
            bigram = np.zeros(1, np.uint64)
            if read.num_rows:
                bigram, key, seen = _distinct(read, [_of_six(x.as_buffer()) for x in read["grams"]], [_unpack(x.as_py()) for x in read["size"]])
                at = _starts(key >> _U(32))
                counts = [np.add.reduceat((x > 0).astype(np.int64), at) for x in seen]
                value = [c - cut.of(2, m, c) for m, c in enumerate(counts)]
            for k in ask:
                x, known = _find(bigram, _of_six(rows["grams"][k].as_buffer()))
                tell(k, np.where(known, value[model(int(half_[k]))][x], 0.0))
        else:
            tables = [_from_ipc(rows["grams"][int(k)].as_py()) for k in np.flatnonzero(half_ == _TABLE)]
            found = tables[0] if tables else None
            key = found["word"].to_numpy() >> _U(16) if tables and found.num_rows else np.zeros(0, np.uint64)
            number = lambda x, m: found[x + MODELS[m]].to_numpy()
            values = []
            for m in range(3) if len(key) else ():
                c, total = number("c", m), number("total", m)
                p = (c - cut.of(1, m, c)) / max(1, int(cut.total[m])) + cut.base(m)
                freed = sum(number(x, m) * cut.cut[2][m][j] for j, x in enumerate(("one", "two", "more"), 1))
                values.append((p, 1 / np.maximum(total, 1), np.where(total > 0, freed / np.maximum(total, 1), 1.0)))
            for k in ask:
                m = model(int(half_[k]))
                last, before = (_of_six(rows[x][k].as_buffer()) for x in ("grams", "count"))
                if not len(key):
                    tell(k, np.full(len(last), cut.base(m)), np.ones(2 * len(before)))
                    continue
                p, divide, weight = values[m]
                x, known = _find(key, last)
                y, begun = _find(key, before)
                tell(k, np.where(known, p[x], cut.base(m)), np.concatenate([np.where(begun, divide[y], 1.0), np.where(begun, weight[y], 1.0)]))
        return _batch(out, _ANSWER, pa.Table)

    return run


def _gather(shards: int):
    def run(rows: pa.Table) -> pa.Table:
        shard = rows["shard"].to_numpy()
        own = int(np.flatnonzero(shard == -1)[0])
        docs, of = _from_ipc(rows["first"][own].as_py()), _from_ipc(rows["second"][own].as_py())
        doc_of, count, bigram_of, last, before = (_unpack(of[j][0].as_py()) for j in range(5))
        total = np.zeros(docs.num_rows)
        if len(doc_of):
            by = [[int(k) for k in np.argsort(shard) if shard[k] // shards == kind and shard[k] >= 0] for kind in range(3)]
            get = lambda kind, name: [_unpack(rows[name][k].as_py()).astype(np.float64) for k in by[kind]]
            share, weight, bigram, word = (np.concatenate(x) for x in (get(0, "first"), get(0, "second"), get(1, "first"), get(2, "first")))
            context = get(2, "second")
            divide, weight2 = np.concatenate([x[: len(x) // 2] for x in context]), np.concatenate([x[len(x) // 2 :] for x in context])
            p2 = bigram * divide[before] + weight2[before] * word[last]
            logs = np.log(share + weight * p2[bigram_of])
            total = np.bincount(doc_of, weights=np.repeat(logs, count), minlength=len(total))
        return pa.table([docs["doc_id"], docs["lang"], docs["content"], docs["n"], pa.array(np.rint(total * UNIT).astype(np.int64))], names=["doc_id", "lang", "content", "n_scored", "total"])

    return run


def _shared_out(weight: np.ndarray) -> np.ndarray:
    """The pass of each bucket: the heaviest first, each to the pass that has least."""
    out, load = np.zeros(len(weight), np.int64), np.zeros(PASSES)
    for k in np.argsort(-weight, kind="stable"):
        out[k] = load.argmin()
        load[out[k]] += weight[k] + 1
    return out


def quality_scores(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, lang, n_scored (words and marks), loss (mean negative log probability of these and the end; null without any)."""
    spark = docs.sparkSession
    # in each of three ranges; fewer than partitions, as every block of texts has a row for each
    shards = max(SHARDS, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.col("lang"), F.lit("")).alias("lang"))
    rows = mark_ids(rows, ids).select("doc_id", "text", "lang", "target", F.xxhash64("text").alias("content"))
    trusted = rows.where(F.col("target") == 1).where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("doc_id", "text")
    words, cut, weight = count_words(trusted, shards)
    table = words.select((F.col("shard") + 2 * shards).alias("shard"), F.lit(0).cast("long").alias("block"), F.lit(_TABLE).alias("half"), F.col("words").alias("grams"), *[F.lit(b"").alias(x) for x in ("count", "size", "tail")])
    # without a model nothing is looked up
    turns, passes = (_shared_out(weight), PASSES) if cut.total[0] else (np.full(BUCKETS, -1), 1)
    found = None
    for turn in range(passes):
        dealt = rows.mapInArrow(_deal(shards, turns, turn), _sql(_DEALT)).union(table)
        answers = dealt.groupBy("shard").applyInArrow(_look_up(shards, cut), _sql(_ANSWER))
        part = _stored(answers.groupBy("block").applyInArrow(_gather(shards), _PASS), "pass")
        found = part if found is None else found.union(part)
    # rows alike in all that is scored have the same sum in every pass
    same = found.groupBy("doc_id", "lang", "content", "n_scored").agg(F.count("*").alias("rows"), F.sum(F.col("total").cast("decimal(38,0)")).cast("double").alias("total"))
    times = (F.col("rows") / passes).cast("int")
    loss = F.when(F.col("n_scored") > 0, F.round(-F.col("total") / times / UNIT / (F.col("n_scored") + 1), 6))
    return same.withColumn("times", times).select("doc_id", "lang", "n_scored", loss.alias("loss"), F.explode(F.expr("array_repeat(0, times)"))).drop("col")


def quality_words(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """One row per row of docs: doc_id, lang, n_scored, perplexity, threshold (perplexity), kept."""
    ids = trusted_ids(labels)
    scores = store(quality_scores(docs, ids), "scores")
    trusted = scores.where("loss is not null").join(ids, "doc_id", "left_semi")
    binned = trusted.groupBy("lang", F.floor(F.col("loss") * BINS).alias("bin")).agg(F.count("*").alias("n"))
    by_lang = _levels(binned, "lang", quantile, 1.0)
    overall = _levels(binned.withColumn("every", F.lit(1)), "every", quantile, 1.0).first()
    default = F.lit(overall["threshold"] if overall else None).cast("double")
    found = scores.join(by_lang, "lang", "left").withColumn("threshold", F.coalesce("threshold", default))
    kept = F.col("loss").isNotNull() & (F.col("threshold").isNull() | (F.col("loss") <= F.col("threshold")))
    return found.select("doc_id", "lang", "n_scored", F.exp("loss").alias("perplexity"), F.exp("threshold").alias("threshold"), kept.alias("kept"))
