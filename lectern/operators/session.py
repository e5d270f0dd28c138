"""Questions against a store: filters, both searches, fusion, expansion, gate, answer, and what to print."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prompts
from ..functions import text as T
from . import evaluation, retrieval
from .store import Store


@dataclass
class Settings:
    vector_k: int = 20
    text_k: int = 20
    rrf_k: int = 60
    max_blocks: int = 5
    budget: int = 1200
    threshold: float | None = None
    books: list[str] = field(default_factory=list)


@dataclass
class Found:
    """blocks: what passed the gate; expanded: all hits with their context; trace: one row a question."""

    blocks: DataFrame
    expanded: DataFrame
    trace: DataFrame


def retrieve(store: Store, questions: DataFrame, settings: Settings | None = None) -> Found:
    """questions: q, text, embedding. One search runs for each different set of filters that a call's questions ask for."""
    s = settings or Settings()
    spark = store.spark
    asked = questions.select("q", *[c.alias(n) for n, c in T.inferred_filters(F.col("text"), s.books).items()]).collect()
    groups: dict[tuple, list[int]] = {}
    for r in asked:
        filters = tuple((k, v) for k, v in r.asDict().items() if k != "q" and v is not None)
        groups.setdefault(filters, []).append(r["q"])
    vector = text = None
    for filters, ids in groups.items():
        some = questions.where(F.col("q").isin(ids))
        v, t = store.search_vector(some, dict(filters), s.vector_k), store.search_text(some, dict(filters), s.text_k)
        vector, text = (v, t) if vector is None else (vector.unionByName(v), text.unionByName(t))
    if vector is None:
        raise ValueError("no questions")
    if any(groups):
        vector, text, found = retrieval.with_fallback_both((vector, text), (store.search_vector(questions, None, s.vector_k), store.search_text(questions, None, s.text_k)))
    else:
        found = questions.select("q")
    fused = retrieval.fuse((vector.select("q", "id", "rank"), 1), (text.select("q", "id", "rank"), 1), k=s.rrf_k)
    rows = store.table("children").drop("vector").withColumnRenamed("chunk_id", "id").withColumnRenamed("text_clean", "child_text")
    hits = fused.join(rows, "id")
    expanded = retrieval.expand(hits, store.table("parents"), store.table("children").drop("vector"))
    expanded = expanded.withColumn("text", prompts.block_text(F.col("child_text"), F.col("parent_text"), F.col("siblings")))
    gated = retrieval.gate(expanded, s.threshold, s.max_blocks, s.budget)
    described = spark.createDataFrame([(r["q"], ", ".join(f"{k} = {v}" for k, v in r.asDict().items() if k != "q" and v is not None)) for r in asked], "q long, filters string")
    trace = retrieval.diagnostics(questions.select("q", "text").join(described, "q"), vector, text, fused, gated, found, s.threshold)
    return Found(gated, expanded, trace)


def answer(store: Store, questions: DataFrame, settings: Settings | None = None, model: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, Found]:
    """answers() of the questions; model turns prompts (q, prompt) into replies (q, reply), none is built in."""
    found = retrieve(store, questions, settings)
    replies = None
    if model is not None:
        listed = found.blocks.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("place", "page_start", "page_end", "text"))).alias("b"))
        asked = listed.join(questions.select("q", F.col("text").alias("asked")), "q")
        replies = model(asked.select("q", prompts.build_prompt(prompts.format_context(F.col("b")), F.col("asked")).alias("prompt")))
    return evaluation.answers(questions, found.blocks, replies), found


def evaluate(store: Store, questions: DataFrame, settings: Settings | None = None, model: Callable | None = None, keywords: list[str] = (), patterns: list[str] = ()) -> DataFrame:
    """evaluation.evaluate() of questions (q, category, expected, text, embedding): one retrieval, measured before the gate and answered after it."""
    answered, found = answer(store, questions, settings, model)
    return evaluation.evaluate(questions, found.expanded.select("q", "score", "text"), answered, keywords, patterns)


def ask(store: Store, question: str, embedding: list[float], settings: Settings | None = None, model: Callable | None = None, debug: bool = False) -> str:
    """What to print for one question: the answer with its sources, or without a model the blocks found; with debug also the trace."""
    if not question.strip():
        return prompts.NO_QUESTION
    one = store.spark.createDataFrame([(0, question.strip(), embedding)], "q long, text string, embedding array<double>")
    answered, found = answer(store, one, settings, model)
    parts = []
    if debug:
        columns = {c: F.col(c) for c in found.trace.columns}
        parts.append(found.trace.select(prompts.format_diagnostics(columns).alias("x")).first()["x"])
    if model is None:
        # the gate bounds the blocks
        row = F.struct("place", "score", "page_start", "page_end", "child_text")
        listed = found.blocks.groupBy("q").agg(F.sort_array(F.collect_list(row)).alias("b")).select(prompts.format_blocks(F.col("b")).alias("x")).first()
        parts.append(listed["x"] if listed else prompts.DECLINE)
    else:
        r = answered.select("answer", F.when(F.size("sources") > 0, prompts.format_sources(F.col("sources"))).alias("sources")).first()
        parts += [r["answer"], *([r["sources"]] if r["sources"] else [])]
    return "\n".join(parts)
