"""Daily series without gaps, and what is read off them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossierlake.operators.metrics import instant, rate


def spine(spark: SparkSession, as_of: str, days: int) -> DataFrame:
    """One row per calendar day, the last one that of ``as_of``."""
    last = F.to_date(F.lit(as_of))
    return spark.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("date"))


def daily(rows: DataFrame, column: str, as_of: str, days: int, **measures: Column) -> DataFrame:
    """date and the measures of each day, null on days without rows.

    Rows go back ``days`` days from the instant, so the oldest, partial day is outside the calendar and drops out.
    """
    at = F.col(column).cast("timestamp_ntz")
    recent = rows.where(at >= instant(as_of) - F.expr(f"INTERVAL {days} DAYS"))
    counted = recent.groupBy(F.to_date(at).alias("date")).agg(*[v.alias(k) for k, v in measures.items()])
    return spine(rows.sparkSession, as_of, days).join(counted, "date", "left")


def daily_counts(rows: DataFrame, column: str, as_of: str, days: int = 30) -> DataFrame:
    return daily(rows, column, as_of, days, count=F.count(F.lit(1))).select("date", F.coalesce("count", F.lit(0)).alias("count"))


def weekly(series: DataFrame) -> DataFrame:
    """Days summed by weeks that begin on Monday."""
    return series.groupBy(F.to_date(F.date_trunc("week", "date")).alias("week")).agg(F.sum("count").alias("count"))


def growth(series: DataFrame) -> DataFrame:
    """The last seven days against the seven before; null growth below fourteen days, 0 where the earlier sum is 0."""
    back = F.row_number().over(Window.orderBy(F.desc("date")))  # a calendar: as many rows as days
    x = series.withColumn("back", back).agg(F.sum(F.when(F.col("back") <= 7, F.col("count"))).alias("last_7_days"), F.sum(F.when(F.col("back").between(8, 14), F.col("count"))).alias("prev_7_days"), F.count(F.lit(1)).alias("days"))
    pct = F.when(F.col("days") >= 14, F.when(F.col("prev_7_days") > 0, F.round((F.col("last_7_days") - F.col("prev_7_days")) / F.col("prev_7_days") * 100, 1)).otherwise(0.0))
    return x.select("last_7_days", "prev_7_days", pct.alias("growth_pct"))


def fraud_rate_trend(rows: DataFrame, as_of: str, days: int) -> DataFrame:
    high = F.col("risk_level").isin("HIGH_RISK", "CRITICAL_RISK")
    out = daily(rows, "analyzed_at", as_of, days, total=F.count(F.lit(1)), high_risk=F.count_if(high)).fillna(0)
    return out.select("date", "total", "high_risk", F.round(F.col("high_risk") / F.greatest("total", F.lit(1)) * 100, 2).alias("fraud_rate_pct"))


def confidence_trend(rows: DataFrame, as_of: str, days: int) -> DataFrame:
    """Daily mean with null scores as 0."""
    out = daily(rows, "processed_at", as_of, days, avg_confidence=F.round(F.avg(F.coalesce("confidence_score", F.lit(0.0))), 4), sample_count=F.count(F.lit(1)))
    return out.fillna(0)


def duplicate_trend(rows: DataFrame, as_of: str, days: int) -> DataFrame:
    return daily(rows, "analyzed_at", as_of, days, duplicate_count=F.count_if("duplicate_detected")).fillna(0)


def risk_trend(rows: DataFrame, as_of: str, days: int) -> DataFrame:
    high = F.col("risk_level").isin("HIGH_RISK", "CRITICAL_RISK")
    return daily(rows, "analyzed_at", as_of, days, total=F.count(F.lit(1)), high_risk=F.count_if(high), avg_risk_score=F.round(F.avg("risk_score"), 1)).fillna(0)


def quality_trend(rows: DataFrame, as_of: str, days: int) -> DataFrame:
    return daily(rows, "analyzed_at", as_of, days, avg_quality=F.round(F.avg("quality_score"), 1), screenshot_count=F.count_if("is_screenshot"), duplicate_count=F.count_if("duplicate_detected")).fillna(0)


def rolling_mean(series: DataFrame, window: int = 7) -> DataFrame:
    """Each day with the mean of the ``window`` days before it, 0 where there are none."""
    before = Window.orderBy("date").rowsBetween(-window, -1)  # a calendar: as many rows as days
    return series.withColumn("rolling_avg", F.coalesce(F.avg("count").over(before), F.lit(0.0)))


def latest_value(series: DataFrame) -> DataFrame:
    return series.agg(F.max_by("count", "date").alias("today"))


def spikes(series: DataFrame, factor: float, critical: float, fresh: int | None = None) -> DataFrame:
    """Each day with its rolling mean and a severity: strictly above ``factor`` (``critical``) times a positive mean, or ``fresh`` and more after none."""
    x = rolling_mean(series)
    c, m = F.col("count"), F.col("rolling_avg")
    severity = F.when((m > 0) & (c > m * critical), "CRITICAL").when((m > 0) & (c > m * factor), "WARNING")
    if fresh is not None:
        severity = severity.when((m == 0) & (c >= fresh), "WARNING")
    return x.select("date", "count", F.round(m, 2).alias("rolling_avg"), F.round(m * factor, 2).alias("threshold"), severity.alias("severity"))


def recent_mean_ratio(series: DataFrame, value: str, recent: int, earlier: int, skip_zero: bool = False) -> DataFrame:
    """Mean of the last ``recent`` days and of the ``earlier`` days before, zeros left out if asked."""
    x = series.withColumn("back", F.row_number().over(Window.orderBy(F.desc("date"))))
    v = F.when(F.col(value) != 0, F.col(value)) if skip_zero else F.col(value)
    return x.agg(F.round(F.avg(F.when(F.col("back") <= recent, v)), 4).alias("recent"), F.round(F.avg(F.when(F.col("back").between(recent + 1, recent + earlier), v)), 4).alias("earlier"))


__all__ = ["confidence_trend", "daily", "daily_counts", "duplicate_trend", "fraud_rate_trend", "growth", "latest_value", "quality_trend", "rate", "recent_mean_ratio", "risk_trend", "rolling_mean", "spikes", "spine", "weekly"]


def two_weeks(series: DataFrame) -> DataFrame:
    """One row: the sums of the last seven days of a series and of the seven before."""
    back = F.row_number().over(Window.orderBy(F.desc("date")))  # as many rows as days
    x = series.withColumn("_n", back)
    return x.agg(F.sum(F.when(F.col("_n") <= 7, F.col("count"))).alias("recent"), F.sum(F.when(F.col("_n").between(8, 14), F.col("count"))).alias("previous"))
