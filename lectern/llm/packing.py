"""Best-fit packing with certified bounds: partitions that miss their bound exchange documents.

Documents are tokenised, ended by one id, and cut into pieces of at most `capacity`
tokens from the end (the first piece may be shorter). Pieces are dealt into partitions
of bounded size and packed best-fit decreasing. Dual feasible functions give a lower
bound on each partition's number of sequences. A partition that meets it is certified
and stays, but for its least filled sequence; one with a gap gives up all sequences
that aren't full. What is given up is dealt anew over fewer partitions and packed again,
until the count meets the bound of all pieces together or a round saves nothing.

Only piece lengths decide, so packing works on counts per length; a partition of any
number of equal pieces costs no more than one of a few. All that the driver sees is the
number of pieces of each length (at most `capacity` numbers) and sums per round.

Defined cases: null and empty texts are one piece of the end id alone; rows that repeat
a doc_id are packed each for itself; texts with the string of a special token get that
token's id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, store, text_table
from .tokens import encoder

CAPACITY = 2048
PARTITION_PIECES = 8192
ROUNDS = 6


# ---------------------------------------------------------------- bounds and bins
def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """The best of three families of dual feasible functions; counts[l]: pieces of length l."""
    sizes = np.flatnonzero(counts)
    if not len(sizes):
        return 0
    n = counts[sizes].astype(np.int64)
    best = -(-int((sizes * n).sum()) // capacity)
    half = capacity // 2
    for k in [0, *[int(x) for x in sizes if x <= half]]:
        # pieces over capacity - k fill a sequence; those under k count nothing
        value = np.where(sizes > capacity - k, capacity, np.where(sizes >= k, sizes, 0))
        best = max(best, -(-int((value * n).sum()) // capacity))
    for k in range(1, 21):
        # (k + 1) x / capacity: whole numbers stay, others are rounded down to k-ths
        whole = (k + 1) * sizes % capacity == 0
        value = np.where(whole, sizes * k, (k + 1) * sizes // capacity * capacity)
        best = max(best, -(-int((value * n).sum()) // (k * capacity)))
    for k in range(1, half + 1, max(1, half // 64)):
        # pieces over half count by what they leave, in units of k
        value = np.where(2 * sizes > capacity, 2 * (capacity // k - (capacity - sizes) // k), np.where(2 * sizes == capacity, capacity // k, 2 * (sizes // k)))
        best = max(best, -(-int((value * n).sum()) // (2 * (capacity // k))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece. Bins of one residual are kept on a stack, pieces of one length go together."""
    order = np.argsort(-lengths, kind="stable")
    out = np.empty(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = np.zeros(capacity + 1, bool)
    made = at = 0
    while at < len(order):
        size = int(lengths[order[at]])
        end = at + int(np.searchsorted(-lengths[order[at:]], -size, "right"))
        while at < end:
            fit = int(open_[size:].argmax()) + size
            if open_[fit]:
                stack = stacks[fit]
                take = min(len(stack), end - at)
                if fit - size >= size:
                    take = 1  # the bin just used can be the tightest again
                bins = stack[-take:]
                del stack[-take:]
                open_[fit] = bool(stack)
            else:
                fit = capacity
                each = 1 if capacity - size >= size else end - at
                bins = list(range(made, made + each))
                made += each
                take = each
            out[order[at : at + take]] = bins
            if fit - size > 0:
                stacks[fit - size] += bins
                open_[fit - size] = True
            at += take
    return out


def _pack(capacity: int, round_: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        # a fixed order makes a rerun after a lost executor give the same bins
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = np.asarray(table["length"])
        bins = best_fit_decreasing(lengths, capacity)
        order = np.argsort(bins, kind="stable")
        sums = np.cumsum(lengths[order])
        new = np.ones(len(order), bool)
        new[1:] = bins[order][1:] != bins[order][:-1]
        starts = np.flatnonzero(new)
        offset = np.empty(len(order), np.int64)
        before = np.concatenate([[0], sums[:-1]])
        offset[order] = before - np.repeat(before[starts], np.diff(np.append(starts, len(order))))
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        gap = len(fill) - lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        keep = fill == capacity
        if gap <= 0:
            keep[:] = True
            if fill.min() < capacity:
                keep[int(fill.argmin())] = False
        sequence = (np.int64(round_) << 56) | (np.int64(key[0].as_py()) << 28) | bins
        rest = table.drop_columns([c for c in ("part", "sequence_id", "offset", "settled", "share") if c in table.column_names])
        for name, x in (("sequence_id", sequence), ("offset", offset), ("settled", keep[bins]), ("share", 1.0 / np.bincount(bins)[bins])):
            rest = rest.append_column(name, pa.array(x))
        return rest

    return run


# ---------------------------------------------------------------- pieces
def _pieces(path: str, capacity: int, end_id: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                ids, counts = encoder(path).encode(part["text"].to_pylist())
                rows: list[tuple] = []
                at = 0
                tail = np.array([end_id], np.uint32)
                for doc, n in zip(part["doc_id"].to_pylist(), counts.tolist(), strict=True):
                    own = np.concatenate([ids[at : at + n], tail]).astype("<u4")
                    at += n
                    cuts = [0, *range((n + 1) % capacity or capacity, n + 2, capacity)]
                    for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        rows.append((doc, k, s, e - s, zlib.crc32(own[s:e].tobytes())))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    return text_table(docs).mapInArrow(_pieces(tokenizer, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """Pieces with sequence_id and offset added."""
    full = pieces.where(F.col("length") == capacity)
    histogram = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()
    counts = np.zeros(capacity + 1, np.int64)
    for r in histogram:
        counts[r["length"]] = r["n"]
    bound = lower_bound(counts, capacity) - int(counts[capacity])
    now = pieces.where(F.col("length") < capacity)
    n_now = int(counts[:capacity].sum())
    schema = f"{pieces.select('doc_id', 'piece', 'start', 'length', 'ids_crc32')._jdf.schema().toDDL()}, sequence_id long, offset long, settled boolean, share double"
    kept, settled_bins, before = [], 0, None
    for k in range(rounds):
        parts = -(-n_now // partition_pieces) or 1
        dealt = now.withColumn("part", F.pmod(F.xxhash64(F.lit(k), "doc_id", "piece"), F.lit(parts)))
        packed = store(dealt.groupBy("part").applyInArrow(_pack(capacity, k), schema), f"packed{k}")
        sums = packed.groupBy("settled").agg(F.round(F.sum("share")).cast("long").alias("bins"), F.count("*").alias("n")).collect()
        bins = {r["settled"]: (r["bins"], r["n"]) for r in sums}
        done, (left, n_left) = bins.get(True, (0, 0))[0], bins.get(False, (0, 0))
        if before is not None and done + left >= before[0]:
            kept.append(before[1])  # a round that saves nothing is not taken
            break
        kept.append(packed.where("settled"))
        settled_bins += done
        loose = packed.where("not settled")
        if not n_left or settled_bins + left <= bound or k == rounds - 1:
            kept.append(loose)
            break
        before = (left, loose)
        now, n_now = loose.drop("sequence_id", "offset", "settled", "share"), n_left
    out = kept[0]
    for x in kept[1:]:
        out = out.union(x)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    # a full piece is a sequence of its own, numbered by where its task stood
    alone = full.select("doc_id", "piece", "start", "length", "ids_crc32", (-F.monotonically_increasing_id() - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return out.select(names).union(alone.select(names))


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_pieces(store(token_pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)
