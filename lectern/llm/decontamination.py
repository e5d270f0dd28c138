"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check.

Words are lower-cased runs of letters and digits. An item of n words is compared with
windows of n words; both are weighted sets of 5-word shingles, a shingle weighing as many
bytes as its words have. The 64-bit SimHash of a window is looked up among the items of
its size in four tables of 16-bit blocks, each listing every value within 3 flips: two
fingerprints within `RADIUS` = 15 differ by at most 3 in some block, so none is missed.
Candidates are confirmed by exact weighted similarity (sum of minima over sum of maxima
of 80 in 100 or more).

A window that shares no shingle with any item has similarity 0, so fingerprints are only
made for windows that hold a shingle of some item; this screen loses nothing.

The items are read in blocks of at most `BLOCK_ITEMS` and `BLOCK_BYTES`; each block is
sent to the tasks, which read the documents once per block. Documents aren't shuffled.

Defined cases: null text is empty and never contaminated; an item of fewer than 5 words
matches only a document of the same words, one without words matches nothing; a document
shorter than an item is compared as a whole; repeated item_ids count once in the list; each row
of docs is judged for itself; an empty table on either side gives no hits; other columns
are not read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, grams, inside, slices, text_buffer, text_table

SHINGLE, SIMILARITY, RADIUS = 5, 80, 15
BLOCK_ITEMS, BLOCK_BYTES = 4096, 16 << 20
_BLOCK_BITS, _FLIPS = 16, 3
_SCREEN_BITS = 22
_CHUNK = 1024
_U = np.uint64
_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[[*range(48, 58), *range(97, 123), *range(128, 256)]] = [*range(48, 58), *range(97, 123), *range(128, 256)]
_MASKS = np.array([sum(1 << b for b in bits) for k in range(_FLIPS + 1) for bits in itertools.combinations(range(_BLOCK_BITS), k)], np.int64)


def plain_words(column: pa.Array) -> Words:
    data, offsets = text_buffer(column)
    return Words(_PLAIN[data], offsets)


def shingle_weights(words: Words) -> np.ndarray:
    """Bytes of the words of each run of SHINGLE words."""
    run = np.concatenate([[0], np.cumsum(words.ends - words.starts)])
    return run[SHINGLE:] - run[:-SHINGLE] if len(run) > SHINGLE else np.zeros(0, np.int64)


def signs(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One row a shingle: its weight, with the sign of each bit of its hash."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
    return (2 * bits - 1) * weights[:, None].astype(np.int32)


def fingerprint(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def weighted_similar(a: dict[int, int], b: dict[int, int], similarity: int) -> bool:
    low = sum(min(w, b.get(s, 0)) for s, w in a.items())
    return 100 * low >= similarity * (sum(a.values()) + sum(b.values()) - low) and low > 0


def weighted_set(hashes: np.ndarray, weights: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for s, w in zip(hashes.tolist(), weights.tolist(), strict=True):
        out[s] = out.get(s, 0) + w
    return out


class Index:
    """Fingerprints, shingles and tables of one block of items."""

    def __init__(self, ids: list[int], texts: list[str]) -> None:
        words = plain_words(pa.array(texts, pa.large_string()))
        hashes, runs, weights = words.hash, grams(words.hash, SHINGLE), shingle_weights(words)
        self.ids, self.sizes, prints, self.sets, self.short = [], [], [], [], {}
        flat = []
        for i, a, n in zip(ids, words.first[:-1].tolist(), words.counts.tolist(), strict=True):
            if n >= SHINGLE:
                s, w = runs[a : a + n - SHINGLE + 1], weights[a : a + n - SHINGLE + 1]
                self.ids.append(i)
                self.sizes.append(n)
                prints.append(fingerprint(signs(s, w).sum(0, keepdims=True))[0])
                self.sets.append(weighted_set(s, w))
                flat.append(s)
            elif n:
                self.short.setdefault(tuple(hashes[a : a + n].tolist()), []).append(i)
        self.sizes = np.array(self.sizes, np.int64)
        self.prints = np.array(prints, np.uint64)
        self.known = np.unique(np.concatenate(flat)) if flat else np.zeros(0, np.uint64)
        self.screen = np.zeros(1 << _SCREEN_BITS, bool)
        self.screen[(self.known >> _U(64 - _SCREEN_BITS)).astype(np.int64)] = True
        self.lengths = np.unique(self.sizes)
        self.tables = {int(n): self._tables(np.flatnonzero(self.sizes == n)) for n in self.lengths}

    def _tables(self, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each block: sorted values within the flips, and the item each comes from."""
        out = []
        for b in range(64 // _BLOCK_BITS):
            value = ((self.prints[rows] >> _U(b * _BLOCK_BITS)) & _U(0xFFFF)).astype(np.int64)
            near = (value[:, None] ^ _MASKS[None, :]).ravel()
            order = np.argsort(near, kind="stable")
            out.append((near[order], np.repeat(rows, len(_MASKS))[order]))
        return out

    def within(self, size: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (window, item, distance) of items of this size within RADIUS."""
        pairs = []
        for b, (values, rows) in enumerate(self.tables[size]):
            own = ((prints >> _U(b * _BLOCK_BITS)) & _U(0xFFFF)).astype(np.int64)
            lo, hi = np.searchsorted(values, own), np.searchsorted(values, own, "right")
            n = hi - lo
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            pairs.append(np.stack([np.repeat(np.arange(len(own)), n), rows[at]]))
        window, item = np.unique(np.concatenate(pairs, axis=1), axis=1)
        far = np.bitwise_count(prints[window] ^ self.prints[item])
        ok = far <= RADIUS
        return window[ok], item[ok], far[ok]

    def hits(self, part: pa.RecordBatch, similarity: int) -> list[list[int]]:
        """Item ids found in each text."""
        words = plain_words(part["text"])
        n, first = words.counts, words.first
        found: list[set[int]] = [set() for _ in range(len(n))]
        if self.short:
            for d in np.flatnonzero((n > 0) & (n < SHINGLE)).tolist():
                found[d].update(self.short.get(tuple(words.hash[first[d] : first[d + 1]].tolist()), ()))
        if len(self.known):
            runs = grams(words.hash, SHINGLE)
            at = np.flatnonzero(self.screen[(runs >> _U(64 - _SCREEN_BITS)).astype(np.int64)] & inside(first, SHINGLE, len(words.starts)))
            where = np.minimum(np.searchsorted(self.known, runs[at]), len(self.known) - 1)
            at = at[self.known[where] == runs[at]]
            if len(at):
                weights, doc = shingle_weights(words), words.doc[at]
                for d in np.unique(doc).tolist():
                    own = slice(first[d], first[d + 1] - SHINGLE + 1)
                    self._in_text(runs[own], weights[own], at[doc == d] - first[d], found[d], similarity)
        return [sorted(f) for f in found]

    def _in_text(self, runs: np.ndarray, weights: np.ndarray, at: np.ndarray, found: set[int], similarity: int) -> None:
        for size in self.lengths.tolist():
            span = min(size - SHINGLE + 1, len(runs))
            # window starts from which some anchor is inside
            step = np.zeros(len(runs) + 2, np.int64)
            np.add.at(step, np.maximum(at - span + 1, 0), 1)
            np.add.at(step, np.minimum(at, len(runs) - span) + 1, -1)
            starts = np.flatnonzero(np.cumsum(step)[: len(runs) - span + 1] > 0)
            cuts = np.flatnonzero(np.diff(starts) > 1) + 1
            for block in np.split(starts, cuts):
                for k in range(0, len(block), _CHUNK):
                    self._in_block(runs, weights, int(block[k]), int(block[min(k + _CHUNK, len(block)) - 1]) + 1, span, size, found, similarity)

    def _in_block(self, runs: np.ndarray, weights: np.ndarray, a: int, z: int, span: int, size: int, found: set[int], similarity: int) -> None:
        if not z > a:
            return
        own = signs(np.ascontiguousarray(runs[a : z + span - 1]), weights[a : z + span - 1])
        sums = np.zeros((len(own) + 1, 64), np.int64)
        np.cumsum(own, axis=0, out=sums[1:])
        window, item, far = self.within(size, fingerprint(sums[span:] - sums[:-span]))
        for k in np.argsort(far, kind="stable").tolist():
            i = int(item[k])
            if self.ids[i] not in found:
                s = slice(a + int(window[k]), a + int(window[k]) + span)
                if weighted_similar(weighted_set(runs[s], weights[s]), self.sets[i], similarity):
                    found.add(self.ids[i])


_INDEXES: dict[int, Index] = {}


def _scan(number: int, ids: list[int], texts: list[str], similarity: int):
    def run(batches):
        if number not in _INDEXES:
            _INDEXES.clear()
            _INDEXES[number] = Index(ids, texts)
        index = _INDEXES[number]
        for batch in batches:
            for part in slices(batch):
                columns = [part[c] for c in part.schema.names if c != "items"]
                hits = index.hits(part, similarity)
                if "items" in part.schema.names:
                    hits = [sorted({*x, *y}) for x, y in zip(part["items"].to_pylist(), hits, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(hits, pa.list_(pa.int64()))], ["doc_id", "text", "items"])

    return run


def _drop_text(scan):
    def run(batches):
        for batch in scan(batches):
            yield batch.select(["doc_id", "items"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """One row per row of docs: doc_id, items (sorted ids of the items found in it), contaminated."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("text")).where("item_id is not null and text is not null")
    rows = items.orderBy("item_id", "text").toLocalIterator()
    now = text_table(docs).select("doc_id", F.lower("text").alias("text"))
    blocks = list(_blocks(rows)) or [([], [])]
    for k, (ids, texts) in enumerate(blocks):
        scan = _scan(hash((k, tuple(ids), tuple(texts))), ids, texts, similarity)
        last = k == len(blocks) - 1
        now = now.mapInArrow(_drop_text(scan) if last else scan, "doc_id long, items array<long>" if last else "doc_id long, text string, items array<long>")
    return now.withColumn("contaminated", F.size("items") > 0)


def _blocks(rows):
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    for r in rows:
        if ids and (len(ids) >= BLOCK_ITEMS or size + len(r["text"]) > BLOCK_BYTES):
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += len(r["text"])
    if ids:
        yield ids, texts
