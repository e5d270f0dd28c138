"""Shared parts of the training-data operators: shared tables, word arrays, components.

Texts are handled as Arrow buffers: words are runs of bytes other than ASCII white
space, hashed with numpy over slices of bounded size, so no step holds a Python
object per word.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20
SEGMENT_BYTES = 1 << 20
#: doc_ids that a broadcast may hold: 64 MB of numbers
BROADCAST_IDS = 8_000_000
#: keys that may be joined by broadcast for their many rows
HOT_KEYS = 1000
#: bytes of text in a partition
PART_BYTES = 32 << 20
WORD_RE = r"[^\x20\x09-\x0D]+"

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# ---------------------------------------------------------------- shared tables
def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = known.get() if known.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lectern-shared-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def store(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: a short lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lectern-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_table(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id long and text string (null: empty), and more; other columns can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def mark_ids(df: DataFrame, ids: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """df with target = 1 where its doc_id is one of ids (distinct), else null.

    The ids are counted first: up to limit they are broadcast and df isn't moved; beyond
    it both sides are shuffled, with the ids as the hashed side.
    """
    ids = store(ids.select("doc_id", F.lit(1).alias("target")), "ids")
    return df.join(F.broadcast(ids) if ids.count() <= limit else ids.hint("shuffle_hash"), "doc_id", "left")


def join_hot(left: DataFrame, right: DataFrame, on: str | list[str], weight: str, share: int = HOT_KEYS) -> DataFrame:
    """left joined with right, one row a key, where weight is the number of a key's rows in left.

    Fewer than share keys can hold more than 1/share of all rows each: these rows of right
    are broadcast, so a hot key's rows stay where they are; all others are dealt by key.
    Both sides are read twice and should be stored.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot = right.where(F.col(weight) * share > total)
    cold = right.where(F.col(weight) * share <= total)
    rest = left.join(F.broadcast(hot.select(*([on] if isinstance(on, str) else on))), on, "left_anti")
    return left.join(F.broadcast(hot), on).unionByName(rest.join(cold, on))


def parts_for(spark: SparkSession, size: int | None, each: int = PART_BYTES) -> int:
    """Partitions for so many bytes: what the session has, or more if they would be larger than each."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size or 0) // each))


# ---------------------------------------------------------------- arrays of words
def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as far as asked for."""

    def __init__(self, base: int) -> None:
        self.base, self.inv = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            m = len(self.up)
            self.up = np.concatenate([self.up, self.up * _U(pow(self.base, m, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * _U(pow(self.inv, m, 1 << 64))])
        return self.up[:n], self.down[:n]


_BYTES = Powers(_BASE)
_GRAMS = (Powers(0xC2B2AE3D27D4EB4F), Powers(0xFF51AFD7ED558CCD))


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch | pa.Table, column: str = "text", limit: int = SLICE_BYTES) -> Iterator:
    """Row ranges of a batch with about limit bytes of text each; one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0)
    ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
    at = 0
    while at < len(ends):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Words of several texts: byte spans, hashes, and where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> None:
        self.data, self.offsets = data, offsets
        gap = _SPACE[data]
        before = np.empty(len(gap), bool)
        if len(gap):
            before[0] = True
            before[1:] = gap[:-1]
            inner = offsets[1:-1]
            before[inner[inner < len(gap)]] = True
        self.starts = np.flatnonzero(~gap & before)
        after = np.empty(len(gap), bool)
        if len(gap):
            after[-1] = True
            after[:-1] = gap[1:]
            inner = offsets[1:-1]
            after[inner[inner > 0] - 1] = True
        self.ends = np.flatnonzero(~gap & after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.lower = lower
        self._hash: np.ndarray | None = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            out = np.empty(len(self.starts), np.uint64)
            i = 0
            while i < len(self.starts):
                base = int(self.starts[i])
                j = max(i + 1, int(np.searchsorted(self.ends, base + SEGMENT_BYTES, "right")))
                part = self.data[base : int(self.ends[j - 1])]
                up, down = _BYTES(len(part) + 1)
                run = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(_TABLE[_LOWER[part] if self.lower else part] * up[:-1], out=run[1:])
                s, e = self.starts[i:j] - base, self.ends[i:j] - base
                out[i:j] = mix((run[e] - run[s]) * down[s] + (e - s).astype(np.uint64))
                i = j
            self._hash = out
        return self._hash


def grams(words: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A hash of each run of size word hashes, over the whole array."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _GRAMS[which](len(words) + 1)
    run = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[:-1], out=run[1:])
    return mix((run[size:] - run[:n]) * down[:n])


def inside(first: np.ndarray, size: int, total: int) -> np.ndarray:
    """Which of the runs of size words, by first word, lie within one text."""
    ok = np.zeros(max(0, total - size + 1), bool)
    if not len(ok):
        return ok
    step = np.zeros(len(ok) + 1, np.int32)
    counts = np.diff(first)
    long = counts >= size
    np.add.at(step, first[:-1][long], 1)
    np.add.at(step, first[:-1][long] + counts[long] - size + 1, -1)
    return np.cumsum(step[:-1]) > 0


# ---------------------------------------------------------------- components
def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) long links -> (node, component): component is the smallest node reachable.

    Alternates large-star and small-star; every round is cut by checkpoint(). Hubs are
    reduced by map-side minima, and links are never collected.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(moved.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = cut(small)
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
