"""The chunk store: Parquet tables of parents and children below a folder, and an inverted index beside them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import retrieval

PARENTS, CHILDREN = "parents", "children"
#: fixed values: what a parent's row has, and what a child's has besides
PARENT_COLUMNS = ["chunk_id", "parent_id", "board", "grade", "subject", "book", "edition", "unit", "chapter", "topic", "language", "page_start", "page_end", "text_clean", "pipeline_version"]
CHILD_COLUMNS = [*PARENT_COLUMNS, "text_lexical", "vector", "ocr_confidence", "seq"]


def predicate(filters: Mapping[str, object] | None) -> Column:
    """column = value for each filter, IN for a list, tuple or set, joined by AND; values are compared as strings; true without filters."""
    out = F.lit(True)
    for name, value in (filters or {}).items():
        column = F.col(f"`{name}`").cast("string")
        many = isinstance(value, (list, tuple, set, frozenset))
        out = out & (column.isin([str(v) for v in value]) if many else column == str(value))
    return out


def parent_rows(parents: DataFrame) -> DataFrame:
    return parents.select(*PARENT_COLUMNS)


def child_rows(children: DataFrame, vectors: DataFrame) -> DataFrame:
    """Children with the vector of their chunk_id (vectors: chunk_id, vector); an error if the two differ in ids."""
    both = children.select(*[c for c in CHILD_COLUMNS if c != "vector"]).join(vectors.select("chunk_id", F.col("vector").cast("array<float>").alias("vector"), F.lit(1).alias("known")), "chunk_id", "full")
    bad = F.col("vector").isNull() | F.col("parent_id").isNull()
    checked = F.when(bad, F.raise_error(F.concat(F.lit("children and vectors differ: "), F.col("chunk_id")))).otherwise(F.col("chunk_id"))
    return both.withColumn("chunk_id", checked).select(*CHILD_COLUMNS)


def hits(rows: DataFrame, score: str) -> DataFrame:
    """Rows of the store as hits: without the vector, with their score as a double."""
    return rows.drop("vector").withColumn("score", F.coalesce(F.col(score).cast("double"), F.lit(0.0)))


class Store:
    """Tables below a folder that all executors can reach. Reading finds missing ones and says so."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, path: str, mode: str = "overwrite") -> Store:
        store = cls(spark, path)
        if mode == "overwrite":
            store.reset()
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Store:
        """An error unless both tables are there."""
        store = cls(spark, path)
        missing = [t for t in (PARENTS, CHILDREN) if t not in store.tables()]
        if missing:
            raise FileNotFoundError(f"incomplete store at {path}: missing {', '.join(missing)}")
        return store

    @classmethod
    def is_valid(cls, spark: SparkSession, path: str) -> bool:
        return all(t in cls(spark, path).tables() for t in (PARENTS, CHILDREN))

    def _folder(self, name: str = ""):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def tables(self) -> set[str]:
        fs, at = self._folder()
        return {x.getPath().getName() for x in fs.listStatus(at) if x.isDirectory()} if fs.exists(at) else set()

    def reset(self) -> None:
        for name in self.tables():
            fs, at = self._folder(name)
            fs.delete(at, True)

    def table(self, name: str) -> DataFrame:
        if name not in self.tables():
            raise RuntimeError(f"table '{name}' is missing at {self.path}: add chunks first")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _add(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.path}/{name}")

    def add_parents(self, parents: DataFrame) -> None:
        self._add(PARENTS, parent_rows(parents))

    def add_children(self, children: DataFrame, vectors: DataFrame) -> None:
        self._add(CHILDREN, child_rows(children, vectors))

    def upsert_children(self, children: DataFrame, vectors: DataFrame) -> None:
        """Rows with a known chunk_id are replaced, others are added."""
        new = child_rows(children, vectors)
        if CHILDREN not in self.tables():
            return self._add(CHILDREN, new)
        old = self.table(CHILDREN)
        kept = old.join(new.select("chunk_id"), "chunk_id", "left_anti").select(*CHILD_COLUMNS)
        # written beside the table before it takes its place
        kept.unionByName(new).write.mode("overwrite").parquet(f"{self.path}/{CHILDREN}-next")
        fs, at = self._folder(CHILDREN)
        fs.delete(at, True)
        fs.rename(self._folder(f"{CHILDREN}-next")[1], at)
        return None

    def build_indexes(self) -> None:
        """Postings, lengths and document frequencies of the lexical texts; an error on an empty table."""
        children = self.table(CHILDREN)
        if children.isEmpty():
            raise RuntimeError("cannot index an empty table of children")
        index = retrieval.index(children.select(F.col("chunk_id").alias("id"), F.col("text_lexical").alias("text")))
        for name, rows in index.items():
            rows.write.mode("overwrite").parquet(f"{self.path}/index-{name}")

    def index(self) -> dict[str, DataFrame]:
        return {name: self.table(f"index-{name}") for name in ("postings", "lengths")}

    def search_vector(self, queries: DataFrame, filters: Mapping[str, object] | None = None, k: int = 20, metric: str = "l2") -> DataFrame:
        """q, id, distance, rank for queries (q, embedding); the filter holds before the nearest are taken."""
        rows = self.table(CHILDREN).where(predicate(filters))
        return retrieval.vector_topk(rows.select(F.col("chunk_id").alias("vec_id"), F.col("vector").alias("embedding")), queries, k, metric).withColumnRenamed("vec_id", "id")

    def search_text(self, queries: DataFrame, filters: Mapping[str, object] | None = None, k: int = 20) -> DataFrame:
        """q, id, score, rank for queries (q, text) over the stored index."""
        ids = self.table(CHILDREN).where(predicate(filters)).select(F.col("chunk_id").alias("id")) if filters else None
        return retrieval.bm25_search(self.index(), queries, k, ids)

    def hybrid(self, queries: DataFrame, filters: Mapping[str, object] | None = None, k: int = 20) -> DataFrame:
        """Both searches fused, for queries (q, text, embedding)."""
        both = retrieval.fuse((self.search_vector(queries, filters, k).select("q", "id", "rank"), 1), (self.search_text(queries, filters, k), 1))
        return both.where(F.col("rank") <= k)

    def parents_of(self, ids: DataFrame) -> DataFrame:
        """ids (parent_id) with their parents, all columns."""
        return ids.join(self.table(PARENTS), "parent_id", "left")

    def children_of(self, ids: DataFrame, limit: int = 50) -> DataFrame:
        """ids (parent_id) with at most `limit` children each, by page and place."""
        from pyspark.sql import Window

        order = Window.partitionBy("parent_id").orderBy(F.coalesce("page_start", F.lit(0)), F.coalesce("seq", F.lit(0)), "chunk_id")
        rows = ids.select("parent_id").distinct().join(self.table(CHILDREN).drop("vector"), "parent_id")
        return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)

    def sample(self, n: int = 5) -> DataFrame:
        """n children, to look at: which ones isn't stated."""
        return self.table(CHILDREN).limit(n)

    def weak_vectors(self, least: float = 0.5) -> DataFrame:
        """chunk_id and norm of children whose vector is near zero."""
        from ..functions.labels import norm

        return self.table(CHILDREN).select("chunk_id", norm(F.col("vector")).alias("norm")).where(F.col("norm") < least)

    def stats(self) -> dict[str, int]:
        return {name: self.table(name).count() if name in self.tables() else 0 for name in (PARENTS, CHILDREN)}


def resolve(spark: SparkSession, override: str | None, candidates: Iterable[str]) -> str:
    """The override, else the first candidate that is a whole store, else the first candidate."""
    if override:
        return override
    paths = list(candidates)
    return next((p for p in paths if Store.is_valid(spark, p)), paths[0])
