"""Evaluation: outcomes of questions, rates, per-category counts and threshold calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prompts
from .cleaning import is_stamp

# fixed values: kinds of questions; the first four have an answer
CATEGORIES = ("answerable", "paraphrased", "roman_urdu", "ocr_typo", "wrong_chapter", "unrelated")
ANSWERED = CATEGORIES[:4]


def answers(questions: DataFrame, gated: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """q, answer, declined, error, sources of questions (q, text) from the blocks that passed the gate.

    gated: q, place, id, parent_id, page_start, page_end, unit, chapter, topic. replies
    (q, reply) is what a model said: without blocks the answer is the fixed one, with
    blocks but without a reply the model is out of reach.
    """
    source = F.struct("place", "id", "parent_id", "page_start", "page_end", "unit", "chapter", "topic")
    # the gate bounds the blocks of a question
    listed = gated.groupBy("q").agg(F.sort_array(F.collect_list(source)).alias("sources"))
    out = questions.select("q").join(listed, "q", "left")
    out = out.join(replies.select("q", "reply"), "q", "left") if replies is not None else out.withColumn("reply", F.lit(None).cast("string"))
    declined = F.col("sources").isNull()
    text = F.when(declined, prompts.DECLINE).when(F.col("reply").isNull(), prompts.LLM_ERROR).otherwise(F.trim("reply"))
    return out.select("q", text.alias("answer"), declined.alias("declined"), (~declined & F.col("reply").isNull()).alias("error"), "sources")


def evaluate(questions: DataFrame, blocks: DataFrame, answered: DataFrame, keywords: list[str] = (), patterns: list[str] = ()) -> DataFrame:
    """One row a question (q, category, expected): top_score and num_blocks before the gate, and how the answer fares.

    blocks: q, score, text of all that the ungated search brings; answered: of answers().
    """
    leak = is_stamp(F.col("text"), keywords, patterns)
    seen = blocks.groupBy("q").agg(F.max("score").alias("top_score"), F.count("*").alias("num_blocks"), F.max(leak).alias("leak"))
    out = questions.join(seen, "q", "left").join(answered.select("q", "answer", "declined", "sources"), "q")
    said = is_stamp(F.col("answer"), keywords, patterns)
    return out.select("q", "category", "expected", F.coalesce("top_score", F.lit(0.0)).alias("top_score"), F.coalesce("num_blocks", F.lit(0)).alias("num_blocks"), "declined", F.col("sources").isNotNull().alias("grounded"), ((F.col("expected") == "decline") == F.col("declined")).alias("correct"), (F.coalesce("leak", F.lit(False)) | said).alias("watermark_leak"))


def metrics(results: DataFrame) -> DataFrame:
    """One row of rates from category, declined, grounded, correct, watermark_leak; null where nothing counts. Groundedness is over answered rows only."""
    rate = lambda good, of: F.round(F.count_if(good & of) / F.nullif(F.count_if(of), F.lit(0)), 4)
    answer, other, declined = F.col("category").isin(*ANSWERED), F.col("category").isin(*CATEGORIES[4:]), F.col("declined")
    return results.agg(
        F.count("*").alias("total"),
        rate(~declined, answer).alias("hit_rate"),
        rate(F.col("grounded"), answer & ~declined).alias("groundedness"),
        rate(F.col("correct"), other).alias("decline_accuracy"),
        rate(declined, answer).alias("false_decline_rate"),
        rate(F.col("correct"), F.lit(True)).alias("overall_accuracy"),
        rate(F.col("watermark_leak"), F.lit(True)).alias("watermark_leak_rate"),
    )


def by_category(results: DataFrame) -> DataFrame:
    """category, n, correct (a rate, null without rows): every known category has a row."""
    known = results.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    counts = results.groupBy("category").agg(F.count("*").alias("n"), F.round(F.count_if("correct") / F.count("*"), 4).alias("correct"))
    return known.join(counts, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"), "correct")


def sweep(results: DataFrame) -> DataFrame:
    """t, right, false_declines, true_declines, answers, declines at every threshold: 0, every score seen and one above all.

    Running counts over the distinct scores replace the product of thresholds and results.
    Scores are dealt by range; within a range they are counted in order, and the totals of
    the ranges before, one row each, are added.
    """
    from ..sources.tables import stored

    answer = F.col("expected") == "answer"
    per = results.groupBy(F.col("top_score").alias("t")).agg(F.count_if(answer).alias("good"), F.count_if(~answer).alias("bad"))
    ends = per.agg(F.max("t").alias("t"))
    extra = ends.select((F.coalesce("t", F.lit(0.0)) + 1e-6).alias("t")).union(ends.select(F.lit(0.0).alias("t"))).select("t", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("bad"))
    points = per.union(extra).groupBy("t").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    points = stored(points.repartitionByRange("t").withColumn("range", F.spark_partition_id()), "thresholds")
    totals = points.groupBy("range").agg(F.sum("good").alias("goods"), F.sum("bad").alias("bads"))
    before, whole = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    # one row a range
    totals = totals.select("range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("goods", "bads")], F.sum("goods").over(whole).alias("answers"), F.sum("bads").over(whole).alias("declines"))
    below = Window.partitionBy("range").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    count = lambda c: F.coalesce(F.sum(c).over(below), F.lit(0))
    swept = points.select("range", "t", count("good").alias("g"), count("bad").alias("b")).join(F.broadcast(totals), "range")
    swept = swept.select("t", (F.col("g") + F.col("goods_before")).alias("false_declines"), (F.col("b") + F.col("bads_before")).alias("true_declines"), "answers", "declines")
    return swept.withColumn("right", F.col("answers") - F.col("false_declines") + F.col("true_declines"))


def calibrate(results: DataFrame) -> DataFrame:
    """The threshold of best accuracy: fewest false declines, then the largest, break ties."""
    best = sweep(results).agg(F.max_by(F.struct("t", "right", "false_declines", "true_declines", "answers", "declines"), F.struct(F.col("right"), -F.col("false_declines"), F.col("t"))).alias("x")).select("x.*")
    part = lambda a, b: F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), 4)
    return best.select(F.round("t", 6).alias("threshold"), F.round(F.col("right") / (F.col("answers") + F.col("declines")), 4).alias("accuracy"), "false_declines", part("false_declines", "answers").alias("false_decline_rate"), part("true_declines", "declines").alias("decline_accuracy"))
