"""Reviewers, queues and corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossierlake.operators.metrics import rate


def reviewer_stats(reviews: DataFrame) -> DataFrame:
    """Outcomes and rates of every reviewer; rows without a reviewer are left out."""
    total = F.count(F.lit(1))
    n = {k: F.count_if(F.col("status") == v) for k, v in (("approved", "approved"), ("rejected", "rejected"), ("corrected", "corrected"), ("reprocessed", "reprocess_requested"))}
    rates = {"approval_rate": "approved", "rejection_rate": "rejected", "correction_rate": "corrected"}
    return reviews.where(F.col("reviewer_id").isNotNull()).groupBy("reviewer_id").agg(total.alias("total"), *[v.alias(k) for k, v in n.items()], *[rate(n[v], total).alias(k) for k, v in rates.items()])


def leaderboard(reviews: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` reviewers by volume, ties by id, with productivity and rank.

    Productivity is .40 of the volume score, .30 of the approval rate, less .30 of half the correction rate,
    within 0 and 100.
    """
    best = reviewer_stats(reviews).orderBy(F.desc("total"), "reviewer_id").limit(top)
    score = 0.40 * F.least(F.lit(100), F.col("total") * 5) + 0.30 * F.col("approval_rate") - 0.30 * (F.col("correction_rate") * 0.5)
    rank = F.row_number().over(Window.orderBy(F.desc("total"), "reviewer_id"))  # over ``top`` rows
    return best.select("*", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 1).alias("productivity_score"), rank.alias("rank"))


def queue_backlog(reviews: DataFrame) -> DataFrame:
    """Waiting reviews by priority; overloaded above 200 in all or 50 of the first priority."""
    waiting = reviews.where(F.col("status").isin("pending", "in_review"))
    total, first, held = F.count(F.lit(1)), F.count_if(F.col("priority") == 1), F.count_if(F.col("status") == "in_review")
    return waiting.agg(total.alias("total_pending"), first.alias("high_priority"), F.count_if(F.col("priority") == 2).alias("medium_priority"), F.count_if(F.col("priority") == 3).alias("low_priority"), held.alias("being_reviewed"), (total - held).alias("awaiting_review"), ((total > 200) | (first > 50)).alias("overloaded"))


def correction_frequency(log: DataFrame) -> DataFrame:
    """Corrections by field and by type from one pass."""
    grouped = log.groupingSets([["field"], ["correction_type"]], "field", "correction_type")
    by_field = F.grouping("field") == 0
    return grouped.agg(F.when(by_field, "field").otherwise("type").alias("kind"), F.when(by_field, F.col("field")).otherwise(F.col("correction_type")).alias("value"), F.count(F.lit(1)).alias("n")).select("kind", "value", "n")


def most_corrected(log: DataFrame) -> DataFrame:
    """The field corrected most, the first by name of equals."""
    return log.groupBy("field").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "field").limit(1)


def review_page(reviews: DataFrame, users: DataFrame, page: int = 1, page_size: int = 20, status: list[str] | None = None, doc_type: str | None = None, decision: str | None = None, priority: int | None = None) -> DataFrame:
    """A page of the queue with its users, most urgent and oldest first; waiting reviews unless statuses are named."""
    rows = reviews.where(F.col("status").isin(*(status or ["pending", "in_review"])))
    for name, value in (("doc_type", doc_type), ("decision", decision), ("priority", priority)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    joined = rows.join(users.select(F.col("id").alias("user_id"), "full_name", "dob"), "user_id")
    return joined.orderBy("priority", "created_at", "id").offset((page - 1) * page_size).limit(page_size)


def page_count(reviews: DataFrame, page_size: int = 20) -> DataFrame:
    waiting = reviews.where(F.col("status").isin("pending", "in_review")).agg(F.count(F.lit(1)).alias("total"))
    return waiting.select("total", F.greatest(F.lit(1), F.ceil(F.col("total") / page_size)).cast("long").alias("pages"))
