"""Counts, rates and bands over the logical tables. Every function takes an explicit instant where time matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days that a named period reaches back; ``today`` begins at midnight, an unknown name is taken as ``today``.
PERIOD_DAYS = {"week": 7, "month": 30}


def instant(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def in_period(column: str, period: str, as_of: str) -> Column:
    """Whether a timestamp lies in a named period that ends now."""
    at = F.col(column).cast("timestamp_ntz")
    if period == "all":
        return F.lit(True)
    if period in PERIOD_DAYS:
        return at >= instant(as_of) - F.expr(f"INTERVAL {PERIOD_DAYS[period]} DAYS")
    return at >= F.date_trunc("day", instant(as_of)).cast("timestamp_ntz")


def rate(part: Column, whole: Column, digits: int = 2) -> Column:
    """A percentage; 0 where there is nothing."""
    return F.coalesce(F.round(F.try_divide(part, whole) * 100, digits), F.lit(0.0))


def count_rows(rows: DataFrame, column: str | None = None, period: str = "all", as_of: str = "", **equals: object) -> DataFrame:
    """One row: n, the rows of a period with the given values."""
    if column:
        rows = rows.where(in_period(column, period, as_of))
    for name, value in equals.items():
        rows = rows.where(F.col(name) == value)
    return rows.agg(F.count(F.lit(1)).alias("n"))


def verification_stats(rows: DataFrame) -> DataFrame:
    """Statuses folded into five buckets and a total; a null status counts in the total alone."""
    def n(*statuses: str) -> Column:
        return F.count_if(F.col("status").isin(*statuses))

    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        n("VERIFIED", "APPROVED").alias("verified"),
        n("MISMATCH", "REJECTED").alias("mismatch"),
        n("POSSIBLE_MISMATCH", "needs_review", "REVIEW_REQUIRED").alias("possible_mismatch"),
        n("OCR_FAILED").alias("ocr_failed"),
        n("DOC_TYPE_UNKNOWN").alias("unknown"),
    )


def average_confidence(rows: DataFrame) -> DataFrame:
    """Mean of the scores that are there, 0 if none is."""
    return rows.agg(F.coalesce(F.round(F.avg("confidence_score"), 4), F.lit(0.0)).alias("avg_confidence"))


def review_queue_counts(rows: DataFrame) -> DataFrame:
    """Counts by status, by decision and by priority from one pass over the reviews."""
    grouped = rows.groupingSets([["status"], ["decision"], ["priority"]], "status", "decision", "priority")
    kind = F.when(F.grouping("status") == 0, "status").when(F.grouping("decision") == 0, "decision").otherwise("priority")
    value = F.when(F.grouping("status") == 0, F.col("status")).when(F.grouping("decision") == 0, F.col("decision")).otherwise(F.col("priority").cast("string"))
    return grouped.agg(kind.alias("kind"), value.alias("value"), F.count(F.lit(1)).alias("n")).select("kind", "value", "n")


def review_queue_totals(rows: DataFrame) -> DataFrame:
    s, d = F.col("status"), F.col("decision")
    named = {"pending": s.isin("pending", "in_review"), "approved": s == "approved", "rejected": s == "rejected", "corrected": s == "corrected", "auto_approved": d == "AUTO_APPROVED", "auto_rejected": d == "AUTO_REJECTED"}
    return rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(v).alias(k) for k, v in named.items()])


def review_queue_fallback(rows: DataFrame) -> DataFrame:
    """The same totals from verification statuses, where there are no reviews."""
    s = F.col("status")
    good, bad = F.count_if(s.isin("VERIFIED", "APPROVED")), F.count_if(s.isin("MISMATCH", "REJECTED"))
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(s.isin("PENDING", "needs_review", "REVIEW_REQUIRED")).alias("pending"), good.alias("approved"), bad.alias("rejected"), F.lit(0).cast("long").alias("corrected"), good.alias("auto_approved"), bad.alias("auto_rejected"))


def fraud_summary(rows: DataFrame) -> DataFrame:
    level, total = F.col("risk_level"), F.count(F.lit(1))
    high, dup = F.count_if(level.isin("HIGH_RISK", "CRITICAL_RISK")), F.count_if("duplicate_detected")
    return rows.agg(
        total.alias("total"),
        F.count_if(level == "LOW_RISK").alias("low_count"),
        F.count_if(level == "MEDIUM_RISK").alias("medium_count"),
        high.alias("high_risk_count"),
        F.count_if(level == "CRITICAL_RISK").alias("critical_count"),
        dup.alias("duplicate_count"),
        F.count_if("is_screenshot").alias("screenshot_count"),
        F.count_if(F.coalesce("tamper_score", F.lit(0)) >= 25).alias("tamper_count"),
        rate(high, total).alias("fraud_rate"),
        rate(dup, total).alias("duplicate_rate"),
    )


def fraud_summary_proxy(rows: DataFrame) -> DataFrame:
    """Stand-in from confidences where no analysis exists: below .6 is high risk, below .5 a duplicate; null counts as 0."""
    score, total = F.coalesce("confidence_score", F.lit(0.0)), F.count(F.lit(1))
    high, dup = F.count_if(score < 0.6), F.count_if(score < 0.5)
    return rows.agg(total.alias("total"), high.alias("high_risk_count"), (total - high).alias("low_risk_count"), dup.alias("duplicate_count"), rate(high, total).alias("fraud_rate"), rate(dup, total).alias("duplicate_rate"))


def risk_distribution(rows: DataFrame) -> DataFrame:
    """Rows and percentage of each level."""
    counted = rows.groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("risk_level", "n", rate(F.col("n"), F.col("total")).alias("pct"))  # one row is sent


def fraud_statistics(rows: DataFrame) -> DataFrame:
    total = F.count(F.lit(1))
    return rows.agg(
        total.alias("total"),
        F.round(F.avg("risk_score"), 1).alias("avg_risk_score"),
        F.round(F.avg("quality_score"), 1).alias("avg_quality_score"),
        F.round(F.avg("tamper_score"), 1).alias("avg_tamper_score"),
        rate(F.count_if("duplicate_detected"), total, 1).alias("duplicate_rate"),
        rate(F.count_if("is_screenshot"), total, 1).alias("screenshot_rate"),
    )


def ocr_success_rate(rows: DataFrame) -> DataFrame:
    s = verification_stats(rows)
    t = F.col("total")
    return s.select(rate(t - F.col("ocr_failed"), t).alias("success_rate"), rate(F.col("ocr_failed"), t).alias("failure_rate"), rate(F.col("verified"), t).alias("verified_rate"), "total", "ocr_failed", "verified", "mismatch")


def confidence_bands(rows: DataFrame) -> DataFrame:
    """Rows per band; a null score counts as 0."""
    c = F.coalesce("confidence_score", F.lit(0.0))
    band = F.when(c <= 0.40, "0-40").when(c <= 0.70, "41-70").when(c <= 0.85, "71-85").otherwise("86-100")
    return rows.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


def confidence_by_type(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_type").agg(F.round(F.avg(F.coalesce("confidence_score", F.lit(0.0))), 4).alias("avg_confidence"))


def type_breakdown(rows: DataFrame) -> DataFrame:
    counted = rows.groupBy("doc_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.crossJoin(F.broadcast(counted.agg(F.sum("n").alias("total")))).select("doc_type", "n", rate(F.col("n"), F.col("total")).alias("pct"))


def worker_health(documents: DataFrame, extracted: DataFrame, as_of: str) -> DataFrame:
    """Documents an hour old against extractions. The critical band lies inside the degraded one and is never reached."""
    old = documents.where(F.col("uploaded_at") < instant(as_of) - F.expr("INTERVAL 1 HOUR")).agg(F.count(F.lit(1)).alias("total_documents"))
    done = extracted.agg(F.count(F.lit(1)).alias("total_extracted"))
    left = F.greatest(F.lit(0), F.col("total_documents") - F.col("total_extracted"))
    share = left / F.greatest(F.col("total_documents"), F.lit(1))
    status = F.when(share > 0.5, "degraded").when(share > 0.8, "critical").otherwise("healthy")
    return old.crossJoin(done).select(status.alias("status"), "total_documents", "total_extracted", left.alias("unprocessed_count"), F.round((1 - share) * 100, 1).alias("coverage_rate"))


def evaluate_summary(rows: DataFrame) -> DataFrame:
    """Decisions as approved, rejected, review or pending."""
    d = F.col("decision")
    kind = F.when(d == "AUTO_APPROVED", "approved").when(d == "AUTO_REJECTED", "rejected").when(d == "REVIEW_REQUIRED", "review").otherwise("pending")
    return rows.groupBy(kind.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def ocr_progress(documents: DataFrame, extracted: DataFrame, reviews: DataFrame) -> DataFrame:
    """Progress clamped to the number of documents."""
    a = documents.agg(F.count(F.lit(1)).alias("total"))
    b = extracted.agg(F.countDistinct("id").alias("done"))
    c = reviews.agg(F.count_if(F.col("status") == "approved").alias("approved"))
    done = F.least("done", "total")
    return a.crossJoin(b).crossJoin(c).select("total", done.alias("processed"), F.greatest(F.lit(0), F.col("total") - done).alias("remaining"), "approved", rate(done, F.col("total"), 1).alias("pct"))


def queue_stats(rows: DataFrame) -> DataFrame:
    """Waiting reviews by priority, with a row for each of 1, 2 and 3."""
    waiting = rows.where(F.col("status").isin("pending", "in_review")).groupBy("priority").agg(F.count(F.lit(1)).alias("n"))
    seeds = rows.sparkSession.range(1, 4).select(F.col("id").cast("int").alias("priority"))
    return seeds.join(waiting, "priority", "left").select("priority", F.coalesce("n", F.lit(0)).alias("n"))
