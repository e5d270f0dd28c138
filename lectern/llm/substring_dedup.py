"""Substring dedup by fixed-block anchors: non-overlapping blocks are the index, every rolling window probes it.

A window of `window` consecutive words that also starts in a document with a smaller
doc_id is a repeat; every word that a repeat covers is removed. Any window holds a whole
aligned block of `window // 2` words wherever it starts, so a repeat always meets an
anchor of the document that it repeats.

1. Documents are dealt into hash groups of a few MB. Each group sends its anchors and
   the hashes of all its rolling windows, packed by hash bucket, one row a group and bucket.
2. Each bucket answers the groups: which hashes are anchors and stand in two documents.
3. Hits are extended: all full windows over a live hash are sent in the same way, once a
   group with the smallest doc_id there; each bucket answers with the smallest of all.
4. Runs of repeated windows are merged into maximal spans, and the spans are removed.

Copies are reduced to one entry a group before any exchange, so a window that stands in a
third of all documents costs one entry a group. Window identity is a 64-bit hash in a
hash bucket of its own (over 70 bits together); anchors only nominate.

Defined cases: null text has no words; a text shorter than a window is returned as it is
(words joined by one space); rows that repeat a doc_id are judged each for itself and
never against each other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, grams, inside, text_buffer, text_table

BUCKET_BYTES = 8 << 20
_U = np.uint64
_EMPTY = np.zeros(0, np.uint64)


def pack(values: np.ndarray) -> bytes:
    """Sorted unsigned numbers as byte planes of their differences."""
    return np.diff(values, prepend=values.dtype.type(0)).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def unpack(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(data, np.uint8).reshape(size, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


def _binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.large_binary()).cast(pa.binary())


class _Group:
    """The documents of one hash group in a fixed order, as words and hashes."""

    def __init__(self, table: pa.Table, window: int) -> None:
        table = table.sort_by([("doc_id", "ascending")])
        self.ids = np.asarray(table["doc_id"])
        self.words = Words(*text_buffer(table["text"]))
        self.block, self.window = window // 2, window
        hashes, first = self.words.hash, self.words.first
        n = len(hashes)
        self.long = inside(first, window, n)  # full windows within one text
        # blocks of texts that hold a full window
        usable = np.repeat(np.diff(first) >= window, np.diff(first))
        self.rolling = grams(hashes, self.block)
        self.probe = inside(first, self.block, n) & usable[: len(self.rolling)]
        self.doc = self.words.doc
        self.at = np.arange(n) - first[self.doc] if n else np.zeros(0, np.int64)

    def bucket(self, hashes: np.ndarray, buckets: int) -> np.ndarray:
        return ((hashes >> _U(32)) % _U(buckets)).astype(np.int64)

    def live(self, answers: dict[int, np.ndarray], buckets: int) -> np.ndarray:
        """Which full windows hold a block that an anchor of another document answered."""
        hit = np.zeros(len(self.rolling) + 1, np.int64)
        if answers and len(self.rolling):
            known = np.sort(np.concatenate([(np.uint64(b) << _U(32)) | a.astype(np.uint64) for b, a in answers.items()]))
            own = (self.bucket(self.rolling, buckets).astype(np.uint64) << _U(32)) | (self.rolling & _U(0xFFFFFFFF))
            where = np.minimum(np.searchsorted(known, own), len(known) - 1)
            np.cumsum((known[where] == own) & self.probe, out=hit[1:])
        n = len(self.long)
        span = self.window - self.block + 1
        return self.long & (hit[span : span + n] > hit[:n]) if n else self.long

    def windows(self, live: np.ndarray, buckets: int):
        """Live windows sorted by bucket and hash; the number of the distinct one each belongs to, and the distinct ones."""
        at = np.flatnonzero(live)
        full = grams(self.words.hash, self.window, 1)[at] if len(at) else _EMPTY
        bucket = ((full * _U(0x9E3779B97F4A7C15)) >> _U(40)).astype(np.int64) % buckets
        order = np.lexsort((at, full, bucket))
        at, full, bucket = at[order], full[order], bucket[order]
        new = np.ones(len(at), bool)
        new[1:] = (full[1:] != full[:-1]) | (bucket[1:] != bucket[:-1])
        return at, np.cumsum(new) - 1, full[new], bucket[new], self.ids[self.doc[at[new]]] if len(at) else self.ids[:0]


def _send_anchors(window: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        group = _Group(table, window)
        at = np.flatnonzero(group.probe)
        hashes = group.rolling[at]
        bucket = group.bucket(hashes, buckets)
        key = (bucket.astype(np.uint64) << _U(32)) | (hashes & _U(0xFFFFFFFF))
        anchors = np.unique(key[group.at[at] % group.block == 0])
        # one entry a group; those of two documents are marked
        order = np.argsort(key, kind="stable")
        key, ids = key[order], group.ids[group.doc[at[order]]]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        starts = np.flatnonzero(new)
        many = np.maximum.reduceat(ids, starts) > np.minimum.reduceat(ids, starts) if len(starts) else np.zeros(0, bool)
        probes = key[new]
        parts = [probes, anchors, probes[many]]
        cuts = [np.searchsorted(x, np.arange(buckets + 1, dtype=np.uint64) << _U(32)) for x in parts]
        some = np.flatnonzero(np.diff(cuts[0]))
        columns = [[pack((x[c[b] : c[b + 1]] & _U(0xFFFFFFFF)).astype(np.uint32)) for b in some] for x, c in zip(parts, cuts, strict=True)]
        p = table["p"][0].as_py()
        return pa.table([pa.array(some, pa.int64()), pa.array(np.full(len(some), p, np.int64)), *map(_binary, columns)], ["bucket", "p", "probes", "anchors", "many"])

    return run


def _answer_anchors(table: pa.Table) -> pa.Table:
    anchors = np.unique(np.concatenate([unpack(x, np.uint32) for x in table["anchors"].to_pylist()]))
    kept = []
    for x in table["probes"].to_pylist():
        x = unpack(x, np.uint32)
        if len(anchors):
            where = np.minimum(np.searchsorted(anchors, x), len(anchors) - 1)
            kept.append(x[anchors[where] == x])
        else:
            kept.append(x[:0])
    found, count = np.unique(np.concatenate(kept), return_counts=True)
    live = np.union1d(found[count > 1], np.concatenate([unpack(x, np.uint32) for x in table["many"].to_pylist()]))
    kept = [np.intersect1d(x, live, assume_unique=True) for x in kept]
    some = [i for i, x in enumerate(kept) if len(x)]
    return pa.table([table["p"].combine_chunks().take(pa.array(some, pa.int64())), table["bucket"].combine_chunks().take(pa.array(some, pa.int64())), _binary([pack(kept[i]) for i in some]), _binary([b""] * len(some))], ["p", "bucket", "live", "least"])


def _answers(table: pa.Table) -> tuple[dict[int, np.ndarray], dict[int, tuple[np.ndarray, np.ndarray]]]:
    live, least = {}, {}
    for b, x, y in zip(table["bucket"].to_pylist(), table["live"].to_pylist(), table["least"].to_pylist(), strict=True):
        if y:
            n = len(y) // 12
            least[b] = (np.frombuffer(y[: 4 * n], np.uint32), np.frombuffer(y[4 * n :], np.int64))
        else:
            live[b] = unpack(x, np.uint32)
    return live, least


def _send_windows(window: int, buckets: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        live, _ = _answers(answers)
        rows: list[list] = [[], [], [], []]
        if live and docs.num_rows:
            group = _Group(docs, window)
            _, _, full, bucket, ids = group.windows(group.live(live, buckets), buckets)
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(cuts))
            kind = np.uint32 if len(ids) and 0 <= ids.min() and ids.max() < 1 << 32 else np.int64
            p = docs["p"][0].as_py()
            rows = [some.tolist(), [p] * len(some), [pack(full[cuts[b] : cuts[b + 1]]) for b in some], [ids[cuts[b] : cuts[b + 1]].astype(kind).tobytes() for b in some]]
        return pa.table([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), _binary(rows[2]), _binary(rows[3])], ["bucket", "p", "full", "ids"])

    return run


def _answer_windows(table: pa.Table) -> pa.Table:
    full = [unpack(x, np.uint64) for x in table["full"].to_pylist()]
    ids = [np.frombuffer(y, np.int64 if len(y) == 8 * len(x) else np.uint32).astype(np.int64) for x, y in zip(full, table["ids"].to_pylist(), strict=True)]
    known, inverse = np.unique(np.concatenate(full), return_inverse=True)
    flat = np.concatenate(ids)
    least = np.full(len(known), np.iinfo(np.int64).max)
    np.minimum.at(least, inverse, flat)
    theirs = least[inverse]
    out, at = [], 0
    for x in ids:
        low = theirs[at : at + len(x)]
        pick = np.flatnonzero(low < x)
        out.append(pick.astype(np.uint32).tobytes() + low[pick].tobytes())
        at += len(x)
    some = [i for i, x in enumerate(out) if x]
    return pa.table([table["p"].combine_chunks().take(pa.array(some, pa.int64())), table["bucket"].combine_chunks().take(pa.array(some, pa.int64())), _binary([b""] * len(some)), _binary([out[i] for i in some])], ["p", "bucket", "live", "least"])


def _remove(window: int, buckets: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["doc_id", "n_words", "n_removed", "spans", "text"]
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        if not docs.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), spans_type, pa.string())], names)
        live, least = _answers(answers)
        group = _Group(docs, window)
        n = len(group.words.starts)
        cover = np.zeros(n + 1, np.int64)
        if live:
            at, which, full, bucket, low = group.windows(group.live(live, buckets), buckets)
            low = low.copy()
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            for b, (where, values) in least.items():
                low[cuts[b] + where] = np.minimum(low[cuts[b] + where], values)
            again = at[low[which] < group.ids[group.doc[at]]] if len(at) else at
            np.add.at(cover, again, 1)
            np.add.at(cover, again + window, -1)
        gone = np.cumsum(cover[:n]) > 0
        raw, first = group.words.data, group.words.first
        texts, spans, removed = [], [], []
        for i in range(len(group.ids)):
            a, z = int(first[i]), int(first[i + 1])
            mine = gone[a:z]
            edge = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]).astype(np.int8)))
            spans.append([{"start": s, "end": e} for s, e in edge.reshape(-1, 2).tolist()])
            removed.append(int(mine.sum()))
            text = raw[group.words.offsets[i] : group.words.offsets[i + 1]].tobytes()
            if removed[-1] == 0:
                texts.append(b" ".join(text.split()).decode())
            else:
                texts.append(b" ".join(w for w, g in zip(text.split(), mine.tolist(), strict=True) if not g).decode())
        return pa.table([pa.array(group.ids), pa.array(np.diff(first).astype(np.int64)), pa.array(removed, pa.int64()), pa.array(spans, spans_type), pa.array(texts, pa.string())], names)

    return run


def substring_dedup(docs: DataFrame, window: int = 50, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, spans of removed words, text of kept words."""
    texts = text_table(docs)
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(total // bucket_bytes) + 1
    # all-to-all rows: groups grow with very large inputs, so that a packed row keeps some hundred entries
    groups = int(total // min(64 << 20, max(4 << 20, total // 12_000))) + 1
    dealt = texts.withColumn("p", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))
    answer = "p long, bucket long, live binary, least binary"
    probes = dealt.groupBy("p").applyInArrow(_send_anchors(window, buckets), "bucket long, p long, probes binary, anchors binary, many binary")
    live = probes.groupBy("bucket").applyInArrow(_answer_anchors, answer)
    full = dealt.groupBy("p").cogroup(live.groupBy("p")).applyInArrow(_send_windows(window, buckets), "bucket long, p long, full binary, ids binary")
    least = full.groupBy("bucket").applyInArrow(_answer_windows, answer)
    answers = live.union(least)
    schema = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, text string"
    return dealt.groupBy("p").cogroup(answers.groupBy("p")).applyInArrow(_remove(window, buckets), schema)
