"""MinHash near-dedup: a signature-coordinate inverted join, confirmed on full shingle sets.

Rows with equal shingle sets are one class. Every class posts its signature under each
(coordinate, value) pair. Postings are ordered from rare to common over the whole corpus.
Classes that agree on at least `matches` of `coordinates` values must share one of the
first `coordinates - matches + 1` of their own postings (prefix merging), so the longest
lists are never opened (skip merging). Collisions are counted over whole signatures,
pairs with at least `matches` are kept and confirmed on full sets.

Large lists are not expanded into pairs. Each member is first paired with its list's
leader; only lists that still hold several components go on. Those that would make more
than `BLOCKS` blocks are taken apart once more: classes that agree on `matches` values also share two
of their first `coordinates - matches + 2` postings, so members are listed under pairs of
postings. What is left is compared in blocks of bounded bytes, members outside a list's
main component with all members; a block returns a spanning set of links, not its pairs.

Keys that hold many rows (a text with many copies, a common posting, a leader with many
members) are joined by broadcast of at most `HOT_KEYS` rows or dealt by a salt.

Chance of overlooking a link exactly at the threshold with the defaults (16 coordinates,
6 matches, similarity 0.85): P(Binomial(16, 0.85) < 6) < 3e-6, less above it.

Defined cases: null text is empty; a text without words has no shingles and links with
nothing; fewer words than a shingle make one shingle of all words; rows of one doc_id are
one document that has the links of all its texts, and n_shingles is that of its smallest
set; a row with a null doc_id links with nothing, has no component and is kept; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, connected_components, grams, join_hot, mix, parts_for, slices, store, text_buffer, text_table

COORDINATES = 16
MATCHES = 6
#: rows and bytes of the two sides of a block, and blocks from which a list is taken apart
U_BLOCK, M_BLOCK = 256, 1024
U_BYTES, M_BYTES = 1 << 20, 4 << 20
BLOCKS = 256
SALTS = 64
_U = np.uint64
_A = mix(np.arange(1, 129, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)
_B = mix(np.arange(1, 129, dtype=np.uint64) * _U(0xC2B2AE3D27D4EB4F))


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = Words(*text_buffer(column), lower=True)
    hashes, out = words.hash, []
    runs = grams(hashes, size)
    for a, n in zip(words.first[:-1].tolist(), words.counts.tolist(), strict=True):
        if n >= size:
            out.append(np.unique(runs[a : a + n - size + 1]))
        else:
            out.append(grams(hashes[a : a + n], n) if n else np.zeros(0, np.uint64))
    return out


def _signature(size: int, coordinates: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part["text"], size)
                counts = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(counts)
                keys = np.zeros((len(sets), coordinates), np.int64)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    at = np.cumsum(counts[full]) - counts[full]
                    for k in range(coordinates):
                        x = flat * _A[k] + _B[k]
                        x ^= x >> _U(32)
                        x *= _U(0xD6E8FEB86659FD93)
                        keys[full, k] = mix(np.minimum.reduceat(x, at) + _B[64 + k]).view(np.int64)
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["th"], pc.binary_length(part["text"]).cast(pa.int64()), pa.array(counts), pa.array(digest, pa.binary()), pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), coordinates).cast(pa.list_(pa.int64()))],
                    ["doc_id", "th", "size", "n_shingles", "digest", "keys"],
                )

    return run


def _confirm(size: int, similarity: int):
    """Of rows (a, salt, b, text) in this order, b null in the leader's own, the pairs whose full sets reach the similarity."""

    def run(batches):
        last, kept = None, None
        for batch in batches:
            for part in slices(batch):
                a = np.asarray(part["a"])
                leads = np.asarray(part["b"].is_null())
                b = np.asarray(part["b"].fill_null(0))
                sets = shingle_sets(part["text"], size)
                ok = np.zeros(len(a), bool)
                for i in range(len(a)):
                    if leads[i]:
                        last, kept = a[i], sets[i]
                        continue
                    if a[i] != last:
                        raise RuntimeError("a leader's text is missing")
                    both = len(np.intersect1d(kept, sets[i], assume_unique=True))
                    ok[i] = 100 * both >= similarity * (len(kept) + len(sets[i]) - both)
                yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])

    return run


def _segments(key: np.ndarray):
    """Row numbers of each distinct key."""
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order])) + 1
    return np.split(order, cuts) if len(order) else []


def _matrix(column, rows: np.ndarray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten()).reshape(len(flat), -1)[rows]


def _suspects(matches: int, similarity: int):
    """Members of block pairs that have a partner of another component with enough collisions."""

    def run(table: pa.Table) -> pa.Table:
        block, rep, comp, n = (np.asarray(table[c]) for c in ("block", "rep", "comp", "n"))
        outer = np.asarray(table["outer"].cast(pa.int8())).astype(bool)
        keys = _matrix(table["keys"], np.arange(len(rep)))
        out = []
        for rows in _segments(block):
            u, m = rows[outer[rows]], rows[~outer[rows]]
            if not len(u) or not len(m):
                continue
            low, high = np.minimum.outer(n[u], n[m]), np.maximum.outer(n[u], n[m])
            ok = (comp[u][:, None] != comp[m][None, :]) & (100 * low >= similarity * high)
            if not ok.any():
                continue
            hits = np.zeros(ok.shape, np.int16)
            for k in range(keys.shape[1]):
                hits += keys[u, k][:, None] == keys[m, k][None, :]
            ok &= hits >= matches
            out += [u[ok.any(1)], m[ok.any(0)]]
        pick = np.concatenate(out) if out else np.zeros(0, np.int64)
        return pa.table({"block": pa.array(block[pick]), "rep": pa.array(rep[pick]), "outer": pa.array(outer[pick]), "comp": pa.array(comp[pick])})

    return run


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of bounded incidence matrices."""
    out = np.zeros((len(left), len(right)), np.float32)
    flat = [np.concatenate(s) if s else np.zeros(0, np.uint64) for s in (left, right)]
    owner = [np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (left, right)]
    vocabulary = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    for at in range(0, len(vocabulary), 4096):
        part = vocabulary[at : at + 4096]
        sides = []
        for x, who, s in zip(flat, owner, (left, right), strict=True):
            where = np.minimum(np.searchsorted(part, x), len(part) - 1)
            hit = part[where] == x
            one = np.zeros((len(s), len(part)), np.float32)
            one[who[hit], where[hit]] = 1
            sides.append(one)
        out += sides[0] @ sides[1].T
    return out


def _block_links(size: int, similarity: int):
    """A spanning set of the confirmed links between components in each block."""

    def run(table: pa.Table) -> pa.Table:
        block, rep, comp = (np.asarray(table[c]) for c in ("block", "rep", "comp"))
        outer = np.asarray(table["outer"].cast(pa.int8())).astype(bool)
        texts = table["text"].combine_chunks()
        a, b = [], []
        for rows in _segments(block):
            u, m = rows[outer[rows]], rows[~outer[rows]]
            if not len(u) or not len(m):
                continue
            left, right = (shingle_sets(texts.take(pa.array(x)), size) for x in (u, m))
            both = _shared(left, right)
            n = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
            ok = (100 * both >= similarity * (n - both)) & (comp[u][:, None] != comp[m][None, :])
            root: dict[int, int] = {}

            def find(x: int, root: dict[int, int] = root) -> int:
                while (y := root.get(x, x)) != x:
                    root[x] = root.get(y, y)
                    x = y
                return x

            for i, j in zip(*np.nonzero(ok), strict=True):
                p, q = find(int(comp[u[i]])), find(int(comp[m[j]]))
                if p != q:
                    root[p] = q
                    a.append(int(rep[u[i]]))
                    b.append(int(rep[m[j]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _lists(keyed: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Stored rows (key, ...), and (key, g) of keys with several rows."""
    keyed = store(keyed, name)
    return keyed, store(keyed.groupBy("key").agg(F.count("*").alias("g")).where("g > 1"), f"{name}-sizes")


def near_dedup(docs: DataFrame, shingle: int = 5, similarity: int = 80, coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept. similarity is in hundredths."""
    spark = docs.sparkSession
    texts = text_table(docs).withColumn("th", F.xxhash64("text"))
    sketch = texts.mapInArrow(_signature(shingle, coordinates), "doc_id long, th long, size long, n_shingles long, digest binary, keys array<bigint>")
    sketch = store(sketch, "sketch")
    full = sketch.where("n_shingles > 0 and doc_id is not null")
    # classes of equal sets; one text stands for its class
    classes = full.groupBy("digest").agg(F.count("*").alias("copies"), F.min_by(F.struct("doc_id", "th", "size", "n_shingles", "keys"), F.struct("doc_id", "th")).alias("x"))
    classes = store(classes.select("digest", "copies", F.monotonically_increasing_id().alias("rep"), "x.*"), "classes")
    members = store(join_hot(full.select("doc_id", "digest"), classes.select("digest", "copies", "rep"), "digest", "copies").select("doc_id", "rep").distinct(), "members")
    reps = classes.select("rep", "size", F.col("n_shingles").alias("n"), "keys")

    posts, lengths = _lists(reps.select("rep", F.posexplode("keys").alias("k", "value")).select("rep", F.xxhash64("k", "value").alias("key")), "posts")
    shared = join_hot(posts, lengths, "key", "g").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("g", "key"))).alias("all"))
    # postings that nobody shares stand first in the order; of the rest, the matches - 1 longest are skipped
    opened = shared.where(F.size("all") >= matches).select("rep", F.transform("all", lambda x: x["key"]).alias("all"))
    opened = opened.join(reps, "rep").select("rep", "size", "n", "keys", F.slice("all", F.lit(1), F.size("all") - (matches - 1)).alias("prefix"), F.when(F.lit(matches > 1), F.slice("all", F.lit(1), F.size("all") - (matches - 2))).alias("wide"))
    opened = store(opened, "opened")
    # texts of those that share a posting at all; the rest never needs them again
    parts = parts_for(spark, sketch.agg(F.sum("size")).first()[0])
    chosen = opened.select("rep").join(classes.select("rep", "doc_id", "th"), "rep")
    wanted = store(texts.repartition(parts, "doc_id", "th").join(chosen, ["doc_id", "th"]).groupBy("doc_id", "th", "rep").agg(F.min("text").alias("text")).select("rep", "text"), "wanted")

    lists, sizes = _lists(opened.select("rep", F.explode("prefix").alias("key")), "lists")
    leaders = store(lists.groupBy("key").agg(F.min("rep").alias("a"), F.count("*").alias("g")).where("g > 1"), "leaders")
    pairs = join_hot(lists, leaders, "key", "g").where("a < rep").select("a", F.col("rep").alias("b")).distinct()
    one, two = (opened.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("keys").alias(f"k{c}")) for c in ("a", "b"))
    pairs = store(pairs.join(two, "b"), "pairs")
    one = store(pairs.groupBy("a").agg(F.count("*").alias("g")).join(one, "a"), "heads")
    collisions = sum(((F.col("ka")[i] == F.col("kb")[i]).cast("int") for i in range(coordinates)), F.lit(0))
    pairs = join_hot(pairs, one, "a", "g").where((collisions >= matches) & (100 * F.least("na", "nb") >= similarity * F.greatest("na", "nb")))
    pairs = store(pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("salt")), "candidates")
    left = pairs.select("a", "salt").distinct().join(wanted.withColumnRenamed("rep", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    right = pairs.join(wanted.withColumnRenamed("rep", "b"), "b").select("a", "salt", "b", "text")
    dealt = left.union(right).repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", "b")
    links = store(dealt.mapInArrow(_confirm(shingle, similarity), "a long, b long"), "links")

    # a document with several texts ties their classes
    tied = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.count("*").alias("g")).where("g > 1").select("doc_id", "a")
    links = links.union(members.join(tied, "doc_id").where("a < rep").select("a", F.col("rep").alias("b")))
    found = connected_components(links)
    more = _between_components(found, opened, lists, sizes, wanted, shingle, similarity, matches)
    if not more.isEmpty():
        found = connected_components(more.union(found.select(F.col("component").alias("a"), F.col("node").alias("b"))))
    # components are named by the smallest doc_id of their classes
    named = classes.select("rep", "copies", F.col("doc_id").alias("first")).join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("g"))
    named, least = store(named, "named"), store(least, "components")
    named = store(join_hot(named, least, "component", "g").select("rep", "copies", "component_id"), "classes-named")
    ids = join_hot(members, named, "rep", "copies").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = sketch.where("doc_id is not null").groupBy("doc_id").agg(F.min("n_shingles").alias("n_shingles")).join(ids, "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    return out.union(sketch.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long"), F.lit(True)))


def _mixed(lists: DataFrame) -> DataFrame:
    """(key, main: its largest component, us, ms: blocks of either side) of lists (key, comp, size) with several components."""
    by = lists.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    x = by.groupBy("key").agg(F.count("*").alias("comps"), F.max(F.struct("n", F.col("comp").alias("c"), "size")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size")).where("comps > 1")
    blocks = lambda n, size, rows, most: F.greatest(F.ceil(n / rows), F.ceil(size / most), F.lit(1))
    return x.select("key", F.col("main.c").alias("main"), "n", blocks(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size"), U_BLOCK, U_BYTES).alias("us"), blocks(F.col("n"), F.col("size"), M_BLOCK, M_BYTES).alias("ms"))


def _between_components(found: DataFrame, opened: DataFrame, lists: DataFrame, sizes: DataFrame, wanted: DataFrame, shingle: int, similarity: int, matches: int) -> DataFrame:
    """Links that leaders don't show: lists with several components, compared in blocks."""
    known = found.select(F.col("node").alias("rep"), "component")
    reps = store(opened.join(known, "rep", "left").select("rep", "size", F.coalesce("component", "rep").alias("comp"), "wide"), "grouped")
    lists = store(join_hot(lists, sizes, "key", "g").join(reps, "rep").select("key", "rep", "comp", "size"), "members")
    heads = store(_mixed(lists), "mixed")
    many = heads.where(F.col("us") * F.col("ms") > BLOCKS)
    if matches > 1 and not many.isEmpty():
        # members of such lists, under each pair of postings one of which is such a list
        long = join_hot(lists, many.select("key", "n"), "key", "n").groupBy("rep").agg(F.collect_set("key").alias("hot")).join(reps, "rep")
        pairs = F.flatten(F.transform("wide", lambda x, i: F.transform(F.slice("wide", i + 2, F.size("wide")), lambda y: F.when(F.array_contains("hot", x) | F.array_contains("hot", y), F.xxhash64(x, y)))))
        long = store(long.select(F.explode(F.filter(pairs, lambda x: x.isNotNull())).alias("key"), "rep", "comp", "size"), "members-pairs")
        heads = store(heads.where(F.col("us") * F.col("ms") <= BLOCKS).union(_mixed(long)), "mixed-pairs")
        lists = lists.union(long)
    lists = join_hot(lists, heads, "key", "n").withColumn("outer", F.col("comp") != F.col("main"))
    lists = lists.withColumn("ub", F.pmod(F.xxhash64("rep"), F.col("us"))).withColumn("mb", F.pmod(F.xxhash64("rep"), F.col("ms")))
    outer = lists.where("outer").select("*", F.explode(F.sequence(F.lit(0), F.col("ms") - 1)).alias("other")).select("key", "rep", "comp", "outer", F.col("ub").alias("i"), F.col("other").alias("j"))
    inner = lists.select("*", F.explode(F.sequence(F.lit(0), F.col("us") - 1)).alias("other")).select("key", "rep", "comp", F.lit(False).alias("outer"), F.col("other").alias("i"), F.col("mb").alias("j"))
    rows = store(outer.union(inner).select(F.xxhash64("key", "i", "j").alias("block"), "rep", "comp", "outer"), "blocks")
    buckets = max(1, rows.count() // 20_000)
    rows = rows.join(opened.select("rep", "n", "keys"), "rep").withColumn("bucket", F.pmod("block", F.lit(buckets)))
    near = rows.groupBy("bucket").applyInArrow(_suspects(matches, similarity), "block long, rep long, outer boolean, comp long")
    near = store(near.distinct().join(opened.select("rep", "size"), "rep"), "suspects")
    of = near.agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
    buckets = max(1, of["n"] // 2_000, (of["size"] or 0) // (M_BYTES + U_BYTES))
    near = near.drop("size").join(wanted, "rep").withColumn("bucket", F.pmod("block", F.lit(buckets))).repartition(parts_for(near.sparkSession, of["size"]), "bucket")
    return store(near.groupBy("bucket").applyInArrow(_block_links(shingle, similarity), "a long, b long"), "block-links")
