"""Votes among readings, and accuracy against the truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def majority(rows: DataFrame, keys: Sequence[str], value: str, position: str) -> DataFrame:
    """The value met most often per key, the first met of equals and then the smaller, with its votes."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("votes"), F.min(position).alias("_first"))
    best = counted.groupBy(*keys).agg(F.min_by(F.struct(value, "votes"), F.struct(-F.col("votes"), "_first", value)).alias("b"))
    return best.select(*keys, f"b.{value}", "b.votes")


def weighted(rows: DataFrame, keys: Sequence[str], value: str, confidence: str, bonus: float = 0.0) -> DataFrame:
    """The value of the largest summed confidence per key, each reading raised by ``bonus``; equals go by value."""
    summed = rows.groupBy(*keys, value).agg(F.sum(F.col(confidence) + bonus).alias("weight"))
    best = summed.groupBy(*keys).agg(F.min_by(F.struct(value, F.round("weight", 4).alias("weight")), F.struct(-F.round("weight", 6), F.col(value))).alias("b"))
    return best.select(*keys, f"b.{value}", "b.weight")


def best_across_pages(rows: DataFrame) -> DataFrame:
    """Per document and field the value of the highest confidence, raised by .1 for every further page that has it and .15 where a page of the right role has it."""
    scored = rows.groupBy("doc_id", "field", "value").agg((F.max("confidence") + 0.1 * (F.countDistinct("page") - 1) + F.when(F.bool_or("role_page"), 0.15).otherwise(0.0)).alias("score"))
    best = scored.groupBy("doc_id", "field").agg(F.min_by(F.struct("value", F.round("score", 4).alias("score")), F.struct(-F.round("score", 6), "value")).alias("b"))
    return best.select("doc_id", "field", "b.value", "b.score")


def ordered_values(rows: DataFrame) -> DataFrame:
    """The values of each document in page order."""
    return rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "value"))), lambda x: x["value"]).alias("values"))


def weighted_cgpa(rows: DataFrame) -> DataFrame:
    """Grade points weighted by credits; the plain mean without credits; terms without points are left out."""
    there = rows.where(F.coalesce("sgpa", F.lit(0.0)) != 0)
    w = F.coalesce("credits", F.lit(0))
    value = F.when(F.sum(w) > 0, F.sum(F.col("sgpa") * w) / F.sum(w)).otherwise(F.avg("sgpa"))
    return there.groupBy("student").agg(F.round(value, 2).alias("cgpa"))


def accuracy(rows: DataFrame, *keys: str) -> DataFrame:
    """Share of correct rows per key, four digits."""
    return rows.groupBy(*keys).agg(F.round(F.avg(F.col("correct").cast("int")), 4).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def outcome(expected: Column, found: Column, correct: Column) -> Column:
    """correct, missed, wrong or hallucinated."""
    return F.when(expected.isNull() & found.isNotNull(), "hallucinated").when(expected.isNotNull() & found.isNull(), "missed").when(F.coalesce(correct, expected.isNull() & found.isNull()), "correct").otherwise("wrong")


def close(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) <= tolerance


#: What each field weighs in the robustness score.
ROBUSTNESS = {"percentage": 0.30, "name": 0.25, "cgpa": 0.20, "result": 0.15, "grade": 0.10}


def robustness(rows: DataFrame) -> DataFrame:
    """One row: weighted field accuracy in percent, less up to 10 for retries beyond two on average, plus 5 times the recovery rate, within 0 and 100, and its grade."""
    fields = [F.coalesce(F.avg(F.when(F.col("field") == f, F.col("correct").cast("int"))), F.lit(0.0)) * w for f, w in ROBUSTNESS.items()]
    retries, recovered = F.avg("retries"), F.coalesce(F.try_divide(F.sum("recoveries"), F.sum("retries")), F.lit(0.0))
    raw = sum(fields[1:], fields[0]) * 100 - F.greatest(F.lit(0.0), F.least(F.lit(10.0), 3 * (retries - 2))) + 5 * recovered
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), 2)
    return rows.agg(score.alias("score")).select("score", F.when(F.col("score") >= 90, "A").when(F.col("score") >= 75, "B").when(F.col("score") >= 55, "C").otherwise("D").alias("grade"))


def severity_curve(rows: DataFrame) -> DataFrame:
    """Accuracy by severity in steps of a tenth."""
    return rows.groupBy(F.round(F.round(F.col("severity") / 0.1) * 0.1, 1).alias("step")).agg(F.round(F.avg(F.col("correct").cast("int")), 4).alias("accuracy"))


def failure_clusters(rows: DataFrame, least: int = 2, samples: int = 3) -> DataFrame:
    """Failures by transform, field and mode that occur at least twice, with the first few ids, which are ranked before they are gathered."""
    key = ["transform", "field", "mode"]
    first = rows.select(*key, "id").withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy("id"))).where(F.col("_rank") <= samples)
    few = first.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("samples"))
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).join(few, key)


def worst(rows: DataFrame, key: str, top: int = 3) -> DataFrame:
    return accuracy(rows, key).orderBy("accuracy", key).limit(top)


def forward_fill(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """The last value that was there, per group in order."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("filled", F.last(value, ignorenulls=True).over(w))
