"""Reading and writing: PDFs, page texts, manifests, evaluation sets, corpora, settings, and tables kept between steps."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

EVAL_SCHEMA = "id string, category string, question string, expected string"
CATEGORIES = ("answerable", "paraphrased", "roman_urdu", "ocr_typo", "wrong_chapter", "unrelated")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the folder that the cluster shares and read again; a local folder only in local mode where none is set."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        shared = known.get() if known.isDefined() else None
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.sparkContext.setCheckpointDir(shared)
    path = f"{shared}/lectern-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _status(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise FileNotFoundError(path)
    return fs.getFileStatus(at)


# ---------------------------------------------------------------- PDFs
def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """path, book (the file's stem), digest and content of one PDF or of every PDF below a folder, in order of path; decoding them is out of scope."""
    if _status(spark, path).isFile() and not path.lower().endswith(".pdf"):
        raise ValueError(f"not a PDF: {path}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    book = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?i)\.pdf$", "")
    return files.select("path", book.alias("book"), F.sha2("content", 256).alias("source_hash"), "content").orderBy("path")


def only_pdf(spark: SparkSession, path: str) -> str:
    """The path of the one PDF below a folder; an error if there is none or another."""
    found = [r["path"] for r in read_pdfs(spark, path).select("path").limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"exactly one PDF is expected in {path}, found {'none' if not found else 'several'}")
    return found[0]


# ---------------------------------------------------------------- page texts
def _page_files(spark: SparkSession, *folders: str) -> DataFrame:
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(list(folders), wholetext=True)
    name = F.col("_metadata.file_path")
    page = F.regexp_extract(name, r"page_(\d+)\.txt$", 1)
    rows = files.select(F.element_at(F.split(name, "/"), -2).alias("book"), F.nullif(page, F.lit("")).cast("int").alias("page"), F.element_at(F.split(name, "/"), -1).alias("source_file"), T.strip(F.col("value")).alias("text"))
    return rows.where("text <> ''")


def read_page_texts(spark: SparkSession, *folders: str) -> DataFrame:
    """book (folder), page (from the file's name), text (trimmed); files without any are skipped."""
    return _page_files(spark, *folders).drop("source_file")


def read_page_chunks(spark: SparkSession, *folders: str, least: int = 40, most: int = 90, overlap: int = 1) -> DataFrame:
    """source_file, page, chunk_index, lang, text: the topic chunks of every page text, in order of file."""
    from ..operators.chunking import sentence_windows

    parts = _page_files(spark, *folders).select("book", "page", "source_file", F.posexplode(T.paragraphs(F.col("text"))).alias("part", "p"))
    cut = parts.withColumn("s", T.sentences_strict(F.col("p")))
    words = F.transform("s", lambda x: F.size(F.filter(F.split(x, rf"{T.WHITE}+"), lambda y: y != "")))
    spans = sentence_windows(words, least, most, overlap, greedy=False)
    pieces = cut.withColumn("x", spans).select("book", "page", "source_file", "part", F.posexplode(F.transform("x", lambda v: F.array_join(F.slice("s", v["start"] + 1, v["end"] - v["start"]), " "))).alias("k", "text"))
    listed = pieces.groupBy("book", "page", "source_file").agg(F.sort_array(F.collect_list(F.struct("part", "k", "text"))).alias("c"))
    return listed.select("book", "page", "source_file", F.posexplode("c").alias("chunk_index", "c")).select("book", "source_file", "page", "chunk_index", T.chunk_language(F.col("c.text")).alias("lang"), "c.text")


def write_page_records(pages: DataFrame, path: str) -> None:
    """kind (raw or clean), book, page, text below path: one text file a page in kind=/book=/file=page_NNNN."""
    named = pages.select("kind", "book", F.format_string("page_%04d", F.col("page").cast("int")).alias("file"), F.coalesce("text", F.lit("")).alias("value"))
    named.write.mode("overwrite").option("lineSep", "\n").partitionBy("kind", "book", "file").text(path)


def read_page_records(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True)
    return files.select("kind", "book", F.regexp_extract("file", r"(\d+)$", 1).cast("int").alias("page"), F.regexp_replace("value", r"\n$", "").alias("text"))


def write_page_texts(pages: DataFrame, path: str) -> None:
    """One folder a book, JSON lines of page and text."""
    pages.select("book", "page", "text").write.mode("overwrite").partitionBy("book").json(path)


def manifest(pages: DataFrame, lang: str = "en") -> DataFrame:
    """source_file, page, chars, lang, extraction_method, text_file of pages (book, page, text)."""
    text = T.strip(F.coalesce("text", F.lit("")))
    return pages.select(F.concat("book", F.lit(".pdf")).alias("source_file"), "page", F.length(text).alias("chars"), F.lit(lang).alias("lang"), F.lit("text_layer").alias("extraction_method"), F.format_string("%s_page_%04d.txt", "book", F.col("page").cast("int")).alias("text_file"))


def write_manifest(pages: DataFrame, path: str, lang: str = "en") -> int:
    """The manifest as JSON lines; returns the number of empty pages."""
    manifest(pages, lang).write.mode("overwrite").json(path)
    return pages.sparkSession.read.json(path).where("chars = 0").count()


def page_dump(pages: DataFrame, book: str, first: int, last: int) -> DataFrame:
    """A book's pages of a range, in order, to look at."""
    return pages.where((F.col("book") == book) & F.col("page").between(first, last)).orderBy("page")


# ---------------------------------------------------------------- evaluation sets, corpora, settings
def read_eval_set(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation questions from JSON lines, blank ones skipped; a row without id or question, or of unknown kind, is an error with its line's number."""
    files = spark.read.text(path, wholetext=True)
    lines = files.select(F.posexplode(F.split("value", "\n")).alias("at", "line")).where(T.strip(F.col("line")) != "")
    rows = lines.select((F.col("at") + 1).cast("string").alias("at"), F.from_json("line", EVAL_SCHEMA).alias("x")).select("at", "x.*")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    wrong = lambda text, *c: F.raise_error(F.concat(F.lit("evaluation set, line "), F.col("at"), F.lit(f": {text}"), *c)).cast("string")
    checked = (
        F.when(blank("id") | blank("question"), wrong("id and question are required"))
        .when(~F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False)), wrong("unknown category ", F.coalesce("category", F.lit(""))))
        .when(~F.coalesce(F.col("expected").isin("answer", "decline"), F.lit(False)), wrong("expected must be answer or decline"))
        .otherwise(F.col("id"))
    )
    return rows.select(checked.alias("id"), "category", "question", "expected")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """page_content and metadata (a map) of a JSON array or of JSON lines of documents."""
    return spark.read.schema("page_content string, metadata map<string, string>").option("multiLine", True).json(path)


def write_corpus(docs: DataFrame, path: str) -> None:
    docs.select("page_content", "metadata").write.mode("overwrite").json(path)


def read_curriculum(spark: SparkSession, path: str) -> DataFrame:
    """ordinal, book, edition, board, grade, subject, language from a curriculum file ({books: [...]}) in YAML or JSON: a small declared list."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        found = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as missing:
            raise RuntimeError("reading YAML needs PyYAML; a JSON file does not") from missing
        found = yaml.safe_load(text)
    names = ("book", "edition", "board", "grade", "subject", "language")
    rows = [(i, *[str(b.get(n, "english" if n == "language" else "")) for n in names]) for i, b in enumerate((found or {}).get("books") or [])]
    return spark.createDataFrame(rows, "ordinal int, " + ", ".join(f"{n} string" for n in names))


def write_threshold(path: str, value: float) -> bool:
    """Puts value into the first line relevance_threshold: of a settings file, all else as it is; whether there is one."""
    at = Path(path)
    if not at.exists():
        return False
    text, n = re.subn(r"^([ \t]*relevance_threshold[ \t]*:[ \t]*)[^\n]+", rf"\g<1>{value}   # calibrated", at.read_text(encoding="utf-8"), count=1, flags=re.MULTILINE)
    if n:
        at.write_text(text, encoding="utf-8")
    return bool(n)


def write_report(df: DataFrame, path: str) -> None:
    """A one-row result as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)
