"""Context, citation, prompt and trace strings, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# fixed values: answers that are always the same
DECLINE = "This is not covered in the provided book."
LLM_ERROR = "I'm having trouble reaching the answering engine right now. Please try again in a moment."
NO_QUESTION = "Please ask a question."
#: our own wording of the rules; {decline} and {context} are filled in
SYSTEM = (
    "You are a patient teacher. Use the passages below and nothing else. Reply in the language of the question. "
    'If the passages do not answer it, reply exactly: "{decline}" Cite pages in parentheses. Keep it short. '
    "Leave out stamps and other marks that are no part of the lesson.\n\nPassages:\n{context}\n"
)


def block_text(child: Column, parent: Column, siblings: Column) -> Column:
    """The matched text, its parent and its neighbours, with blank lines between; empty ones are left out."""
    return F.array_join(F.filter(F.concat(F.array(child, parent), F.coalesce(siblings, F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != "")), "\n\n")


def page_label(start: Column, end: Column, one: str = "page ", many: str = "page ", none: str = "page ?") -> Column:
    span = F.concat(F.lit(many), start.cast("string"), F.lit("-"), end.cast("string"))
    return F.when(start.isNotNull() & end.isNotNull() & (end != start), span).when(start.isNotNull(), F.concat(F.lit(one), start.cast("string"))).otherwise(none)


def format_context(blocks: Column) -> Column:
    """Passage 1 (pages 3-4): text, and so on, from an array of struct(page_start, page_end, text)."""
    label = lambda b: page_label(b["page_start"], b["page_end"], " (page ", " (pages ", "")
    closed = lambda b: F.when(label(b) == "", "").otherwise(F.concat(label(b), F.lit(")")))
    return F.array_join(F.transform(blocks, lambda b, i: F.concat(F.lit("Passage "), (i + 1).cast("string"), closed(b), F.lit(":\n"), b["text"])), "\n\n")


def format_docs(docs: Column) -> Column:
    """[source 1: file, chunk 2] and the text, from an array of struct(source_file, chunk_index, text)."""
    head = lambda d, i: F.concat(F.lit("[source "), (i + 1).cast("string"), F.lit(": "), F.coalesce(d["source_file"], F.lit("unknown")), F.lit(", chunk "), F.coalesce(d["chunk_index"].cast("string"), F.lit("?")), F.lit("]\n"))
    return F.array_join(F.transform(docs, lambda d, i: F.concat(head(d, i), T.strip(d["text"]))), "\n\n")


def format_sources(sources: Column) -> Column:
    """One line a source: pages and headings, from an array of struct(page_start, page_end, unit, chapter, topic)."""

    def line(s: Column) -> Column:
        where = F.array_join(F.filter(F.array(s["unit"], s["chapter"], s["topic"]), lambda x: x.isNotNull() & (x != "")), " / ")
        return F.concat(F.lit("  - "), page_label(s["page_start"], s["page_end"]), F.when(where == "", "").otherwise(F.concat(F.lit(" ("), where, F.lit(")"))))

    return F.array_join(F.transform(sources, line), "\n")


def format_blocks(blocks: Column) -> Column:
    """Numbered hits with score, pages and the first 200 characters, from an array of struct(score, page_start, page_end, child_text)."""

    def line(b: Column, i: Column) -> Column:
        flat = F.regexp_replace(T.strip(b["child_text"]), "\n", " ")
        snippet = F.when(F.length(flat) > 200, F.concat(F.substring(flat, 1, 200), F.lit("..."))).otherwise(flat)
        return F.concat(F.lit("  ["), (i + 1).cast("string"), F.lit("] score="), F.format_string("%.4f", b["score"]), F.lit(" "), page_label(b["page_start"], b["page_end"]), F.lit("\n      "), snippet)

    return F.when(F.size(blocks) == 0, "  (nothing retrieved)").otherwise(F.array_join(F.transform(blocks, line), "\n"))


def verdict(expanded: Column, gated: Column, threshold: Column) -> Column:
    """Which stage decided: no_match, gated_out, success, or '' where there is nothing to say."""
    return F.when(expanded == 0, "no_match").when((gated == 0) & threshold.isNotNull(), "gated_out").when(gated > 0, "success").otherwise("")


def format_diagnostics(d: dict[str, Column]) -> Column:
    """A trace of all stages from columns by the names of retrieval.diagnostics()."""
    text = lambda x: F.coalesce(x.cast("string"), F.lit("none"))
    lines = [
        F.concat(F.lit("language: "), d["language"]),
        F.concat(F.lit("filters: "), F.coalesce(F.nullif(d["filters"], F.lit("")), F.lit("(none)")), F.when(d["fallback"], ", none matched, searched without").otherwise("")),
        F.concat(F.lit("vector hits: "), text(d["vector_hits"]), F.lit(", nearest "), text(d["vector_top"])),
        F.concat(F.lit("BM25 hits: "), text(d["bm25_hits"]), F.lit(", best "), text(d["bm25_top"])),
        F.concat(F.lit("fused: "), text(d["fused"]), F.lit(", best "), text(d["fused_top"])),
        F.concat(F.lit("passed the gate: "), text(d["gated"]), F.lit(" at threshold "), text(d["threshold"])),
        F.concat(F.lit("verdict: "), verdict(d["fused"], d["gated"], d["threshold"])),
    ]
    return F.concat_ws("\n", *lines)


def build_prompt(context: Column, question: Column) -> Column:
    """System rules with the passages, then the question."""
    before, after = SYSTEM.replace("{decline}", DECLINE).split("{context}")
    return F.concat(F.lit("System: " + before), context, F.lit(after + "\nHuman: "), question)


def with_context(question: Column, context: Column) -> Column:
    """The context, a blank line and the question; the question alone without context."""
    return F.when(F.coalesce(context, F.lit("")) == "", question).otherwise(F.concat(context, F.lit("\n\n"), question))


def system_prompt(language: Column, english: str, urdu: str) -> Column:
    return F.when(language == "ur", urdu).otherwise(english)


def first_words(x: Column, n: int = 40) -> Column:
    """At most n words of an answer."""
    return F.array_join(F.slice(F.filter(F.split(x, rf"{T.WHITE}+"), lambda w: w != ""), 1, n), " ")
