"""Rule engines: field comparison, approval, decisions, anomalies, insights, health and the dashboard."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake.functions import names as nm
from dossierlake.operators import metrics as m
from dossierlake.operators import reviewers as rev
from dossierlake.operators import timeseries as ts

#: Gates of readability and of the name score.
OCR_HIGH, OCR_MEDIUM, NAME_APPROVE, NAME_CORRECT = 0.85, 0.40, 95, 88
HIGH, MEDIUM, LOW = 1, 2, 3


def compare_fields(rows: DataFrame, score: Column | None = None) -> DataFrame:
    """Adds statuses and scores of name, dob and number, and the overall verdict.

    ``rows`` has stored_name, found_name, stored_dob, found_dob, stored_id, found_id, doc_type and ocr_confidence.
    ``score`` is the name score; without it names are compared by the fuzzy and phonetic scores.
    """
    a, b = nm.normal_name(F.col("stored_name")), nm.normal_name(F.col("found_name"))
    empty = (F.coalesce("stored_name", F.lit("")) == ""), (F.coalesce("found_name", F.lit("")) == "")
    name = F.when(empty[0] & empty[1], 100.0).when(empty[0] | empty[1], 0.0).otherwise(F.round(score if score is not None else nm.name_score(a, b), 1))
    out = rows.withColumn("name_score", name)
    out = out.withColumn("name_status", nm.name_status(F.col("name_score"))).withColumn("dob_status", nm.dob_status(F.col("stored_dob"), F.col("found_dob"))).withColumn("id_status", nm.id_status(F.col("stored_id"), F.col("found_id")))
    out = out.withColumn("dob_score", F.when(F.col("dob_status") == "MATCH", 100).when(F.col("dob_status") == "POSSIBLE_MATCH", 80).otherwise(0)).withColumn("id_score", F.when(F.col("id_status") == "MATCH", 100).otherwise(0))
    return out.withColumn("overall_status", overall_status())


def overall_status() -> Column:
    """Any mismatch beats any possible match beats verified; unknown types and empty extractions come first."""
    statuses = F.array("name_status", "dob_status", "id_status")
    nothing = reduce(lambda x, y: x & y, [F.coalesce(c, F.lit("")) == "" for c in ("found_name", "found_dob", "found_id")])
    return F.when(F.col("doc_type") == "unknown", "DOC_TYPE_UNKNOWN").when(nothing & (F.col("ocr_confidence") == 0), "OCR_FAILED").when(F.array_contains(statuses, "MISMATCH"), "MISMATCH").when(F.array_contains(statuses, "POSSIBLE_MATCH"), "POSSIBLE_MISMATCH").otherwise("VERIFIED")


def difference_type(field: str, stored: Column, found: Column, status: Column, score: Column) -> Column:
    """What kind of difference a field shows."""
    wrong = {"id": F.lit("id_number_mismatch"), "dob": F.lit("date_mismatch"), "name": F.when(score >= 50, "significant_name_difference").otherwise("completely_different_name")}
    near = F.when(score >= 90, "minor_ocr_variation").when(score >= 80, "spelling_variation").otherwise("word_order_variation")
    return F.when(status == "MATCH", "exact_match").when(stored.isNull() | found.isNull(), "missing_value").when(status == "POSSIBLE_MATCH", near).otherwise(wrong.get(field, F.lit("field_mismatch")))


def recommended_action(status: Column, kind: Column) -> Column:
    return (
        F.when(status == "MATCH", "no_action")
        .when(kind == "minor_ocr_variation", "auto_correct_suggested")
        .when(kind == "missing_value", "re_upload_document")
        .when(kind.isin("id_number_mismatch", "completely_different_name", "date_mismatch"), "reject_document")
        .otherwise("manual_review")
    )


def evaluate(rows: DataFrame, intended: bool = False) -> DataFrame:
    """Adds decision, priority, reasons (codes: passed, then to review, then rejected) and auto_correctable.

    Priorities are raised with the larger number, as the rules have always done, so a finding can only lower the
    urgency that a rejection set; ``intended`` keeps the most urgent one instead.
    """
    c, name, score, dob, number = F.col("ocr_confidence"), F.col("name_status"), F.col("name_score"), F.col("dob_status"), F.col("id_status")
    missing = F.size(F.filter(F.array("found_name", "found_dob", F.when(F.col("doc_type").isin("aadhaar", "pan"), F.col("found_id")).otherwise("-")), lambda x: F.coalesce(x, F.lit("")) == ""))
    weaker = F.least if intended else F.greatest
    # Each rule in order: (condition, list, code, how it sets the priority).
    steps: list[tuple[Column, str, str, str]] = [
        (c < OCR_MEDIUM, "reject", "ocr_below_minimum", "set"),
        (missing >= 2, "reject", "fields_missing", "set"),
        (missing == 1, "review", "field_missing", "medium"),
        (F.col("overall_status") == "OCR_FAILED", "reject", "ocr_failed", "set"),
        (number == "MISMATCH", "reject", "id_mismatch", "set"),
        (number == "POSSIBLE_MATCH", "review", "id_confusion", "medium"),
        (number == "MATCH", "pass", "id_match", ""),
        (name == "MISMATCH", "reject", "name_mismatch", "high"),
        (name == "POSSIBLE_MATCH", "review", "name_variation", "medium"),
        ((name == "MATCH") & (score < NAME_APPROVE), "review", "name_below_approval", "medium"),
        ((name == "MATCH") & (score >= NAME_APPROVE), "pass", "name_match", ""),
        (dob == "MISMATCH", "reject", "dob_mismatch", "high"),
        (dob == "POSSIBLE_MATCH", "review", "dob_year_only", "medium"),
        (dob == "MATCH", "pass", "dob_match", ""),
        ((c >= OCR_MEDIUM) & (c < OCR_HIGH), "review", "ocr_acceptable", "medium"),
        (c >= OCR_HIGH, "pass", "ocr_high", ""),
    ]
    level = {"set": HIGH, "high": HIGH, "medium": MEDIUM}
    marks = F.array(*[F.struct(hit.alias("hit"), F.lit(how == "set").alias("set"), F.lit(level[how]).alias("level")) for hit, _, _, how in steps if how])
    priority = F.aggregate(marks, F.lit(LOW), lambda p, x: F.when(x["hit"], F.when(x["set"], x["level"]).otherwise(weaker(p, x["level"]))).otherwise(p))
    codes = {k: F.array_compact(F.array(*[F.when(hit, code) for hit, kind, code, _ in steps if kind == k])) for k in ("pass", "review", "reject")}
    unknown = F.col("doc_type") == "unknown"
    rejected, reviewed = F.size(codes["reject"]) > 0, F.size(codes["review"]) > 0
    decision = F.when(unknown | rejected, "AUTO_REJECTED").when(reviewed, "REVIEW_REQUIRED").otherwise("AUTO_APPROVED")
    final = F.when(unknown, HIGH).when(~rejected & ~reviewed, LOW).otherwise(priority)
    reasons = F.when(unknown, F.array(F.lit("type_unknown"))).otherwise(F.concat(codes["pass"], codes["review"], codes["reject"]))
    fixable = ~unknown & ~rejected & reviewed & (c >= OCR_HIGH) & (name == "POSSIBLE_MATCH") & (score >= NAME_CORRECT) & (number == "MATCH") & (dob == "MATCH")
    return rows.select("*", decision.alias("decision"), final.alias("priority"), reasons.alias("reasons"), fixable.alias("auto_correctable"))


def _anomaly(series: DataFrame, kind: str, factor: float, critical: float | None, fresh: str | None = None) -> DataFrame:
    """The last day of a series as an anomaly, if it is one."""
    x = ts.rolling_mean(series).agg(F.max_by("count", "date").alias("t"), F.max_by("rolling_avg", "date").alias("a"))
    t, a = F.col("t").cast("double"), F.col("a")
    over = (a > 0) & (t > a * factor)
    severity = F.when(over & (t > a * critical), "CRITICAL").when(over, "WARNING") if critical else F.when(over, "WARNING")
    new = (a == 0) & (t >= 5) if fresh else F.lit(False)
    found = x.select(F.when(new, fresh or "").otherwise(kind).alias("anomaly_type"), F.round(t, 2).alias("today_value"), F.round(F.when(new, 0.0).otherwise(a), 2).alias("rolling_avg"), F.round(F.when(new, 0.0).otherwise(a * factor), 2).alias("threshold"), F.when(new, "WARNING").otherwise(severity).alias("severity"))
    return found.where(F.col("severity").isNotNull())


def anomalies(fraud: DataFrame, verified: DataFrame, uploads: DataFrame, reviews: DataFrame, fraud_at: str, events_at: str) -> DataFrame:
    """All checks on 14-day series and on the queue; ``position`` keeps the order in which checks are made."""
    high = fraud.where(F.col("risk_level").isin("HIGH_RISK", "CRITICAL_RISK"))
    parts = [
        _anomaly(ts.daily_counts(high, "analyzed_at", fraud_at, 14), "fraud_spike", 1.5, 2.5),
        _anomaly(ts.daily_counts(verified.where("status = 'OCR_FAILED'"), "verified_at", events_at, 14), "ocr_failure_spike", 1.5, 3.0, "ocr_failure_new"),
        _anomaly(ts.daily_counts(uploads, "uploaded_at", events_at, 14), "upload_flood", 2.0, None),
        _anomaly(ts.daily_counts(fraud.where("duplicate_detected"), "analyzed_at", fraud_at, 14), "duplicate_surge", 2.0, 3.0),
    ]
    q = rev.queue_backlog(reviews)
    total, first = F.col("total_pending"), F.col("high_priority")
    size = q.select(F.when(total > 500, F.struct(F.lit("queue_critical_overload").alias("anomaly_type"), F.lit(500.0).alias("threshold"), F.lit("CRITICAL").alias("severity"))).when(total > 200, F.struct(F.lit("queue_overload").alias("anomaly_type"), F.lit(200.0).alias("threshold"), F.lit("WARNING").alias("severity"))).alias("x"), total.alias("v"))
    urgent = q.where(first > 50).select(F.lit("high_priority_backlog").alias("anomaly_type"), first.cast("double").alias("today_value"), F.lit(0.0).alias("rolling_avg"), F.lit(50.0).alias("threshold"), F.lit("WARNING").alias("severity"))
    parts += [size.where("x IS NOT NULL").select("x.anomaly_type", F.col("v").cast("double").alias("today_value"), F.lit(0.0).alias("rolling_avg"), "x.threshold", "x.severity"), urgent]
    return reduce(DataFrame.unionByName, [p.withColumn("position", F.lit(k)) for k, p in enumerate(parts)])


def severity_rank() -> Column:
    s = F.col("severity")
    return F.when(s == "CRITICAL", 0).when(s == "WARNING", 1).otherwise(2)


def system_alert(found: DataFrame) -> DataFrame:
    critical, warnings = F.count_if(F.col("severity") == "CRITICAL"), F.count_if(F.col("severity") == "WARNING")
    return found.agg(F.count(F.lit(1)).alias("total"), critical.alias("critical"), warnings.alias("warnings"), F.when(critical > 0, "CRITICAL").when(warnings > 0, "WARNING").otherwise("HEALTHY").alias("system_alert"))


def alerts(found: DataFrame) -> DataFrame:
    """Alert rows of anomalies, ready to append."""
    title = F.initcap(F.replace("anomaly_type", F.lit("_"), F.lit(" ")))
    return found.select(F.col("anomaly_type").alias("alert_type"), "severity", title.alias("title"), F.col("anomaly_type").alias("metric_name"), F.col("today_value").alias("metric_value"), "threshold", F.lit(False).alias("resolved"))


def measures(fraud: DataFrame, verified: DataFrame, extracted: DataFrame, reviews: DataFrame, corrections: DataFrame, fraud_at: str) -> DataFrame:
    """One row with every figure that the insight rules look at; each table is read once or twice, never collected."""
    ocr = m.ocr_success_rate(verified).select("failure_rate", F.col("total").alias("ocr_total"), "success_rate")
    score = F.coalesce("confidence_score", F.lit(0.0))
    conf = extracted.agg(F.coalesce(F.round(F.avg("confidence_score"), 4), F.lit(0.0)).alias("avg_confidence"), F.count_if(score <= 0.40).alias("low_band"), F.count_if(F.col("doc_type") == "unknown").alias("unknown_types"), F.count(F.lit(1)).alias("extracted_total"))
    summary = m.fraud_summary(fraud).select("fraud_rate", "duplicate_rate", "critical_count", "screenshot_count", "high_risk_count", F.col("total").alias("fraud_total"))
    dup = ts.recent_mean_ratio(ts.duplicate_trend(fraud, fraud_at, 14), "duplicate_count", 3, 5).select(F.col("recent").alias("dup_recent"), F.col("earlier").alias("dup_earlier"))
    qual = ts.recent_mean_ratio(ts.quality_trend(fraud, fraud_at, 14), "avg_quality", 3, 4, skip_zero=True).select(F.col("recent").alias("quality_recent"), F.col("earlier").alias("quality_earlier"))
    queue = rev.queue_backlog(reviews).select("total_pending", "high_priority")
    board = reviews.agg(F.countDistinct("reviewer_id").alias("reviewers"))
    fixes = corrections.agg(F.count(F.lit(1)).alias("corrections"))
    return reduce(lambda x, y: x.crossJoin(y), [ocr, conf, summary, dup, qual, queue, board, fixes])  # rows of one


#: The insight rules in order: name, condition, severity, figure.
INSIGHTS = (
    ("ocr_high_failure", "failure_rate > 15", "CRITICAL", "failure_rate"),
    ("ocr_elevated_failure", "failure_rate > 8 AND failure_rate <= 15", "WARNING", "failure_rate"),
    ("ocr_low_confidence", "avg_confidence < 0.55", "WARNING", "avg_confidence"),
    ("low_confidence_band", "round(low_band / greatest(ocr_total, 1) * 100, 1) > 20", "WARNING", "round(low_band / greatest(ocr_total, 1) * 100, 1)"),
    ("unknown_doc_type", "round(unknown_types / greatest(extracted_total, 1) * 100, 2) > 10", "WARNING", "round(unknown_types / greatest(extracted_total, 1) * 100, 2)"),
    ("high_fraud_rate", "fraud_rate > 20", "CRITICAL", "fraud_rate"),
    ("elevated_fraud_rate", "fraud_rate > 10 AND fraud_rate <= 20", "WARNING", "fraud_rate"),
    ("duplicate_attack", "duplicate_rate > 15", "CRITICAL", "duplicate_rate"),
    ("duplicate_attack", "duplicate_rate > 5 AND duplicate_rate <= 15", "WARNING", "duplicate_rate"),
    ("critical_risk_cases", "critical_count > 0", "CRITICAL", "critical_count"),
    ("duplicate_spike", "dup_earlier > 0 AND dup_recent > dup_earlier * 2", "WARNING", "round(dup_recent, 1)"),
    ("queue_overloaded", "total_pending > 300", "CRITICAL", "total_pending"),
    ("queue_elevated", "total_pending > 150 AND total_pending <= 300", "WARNING", "total_pending"),
    ("high_priority_backlog", "high_priority > 30", "WARNING", "high_priority"),
    ("no_reviewer_activity", "reviewers = 0", "INFO", "0"),
    ("frequent_corrections", "corrections > 50", "INFO", "corrections"),
    ("high_screenshot_rate", "round(screenshot_count / greatest(fraud_total, 1) * 100, 1) > 30", "WARNING", "round(screenshot_count / greatest(fraud_total, 1) * 100, 1)"),
    ("quality_degradation", "quality_earlier > 0 AND quality_recent < quality_earlier * 0.85", "WARNING", "round(quality_recent, 1)"),
)


def insights(figures: DataFrame) -> DataFrame:
    """The rules that hold, one row each, with their place in the order."""
    rules = F.array(*[F.struct(F.lit(k).alias("position"), F.lit(name).alias("insight"), F.lit(severity).alias("severity"), F.expr(f"cast({figure} AS double)").alias("metric"), F.expr(f"coalesce({condition}, false)").alias("holds")) for k, (name, condition, severity, figure) in enumerate(INSIGHTS)])
    return figures.select(F.inline(rules)).where("holds").drop("holds")


def queue_health(reviews: DataFrame) -> DataFrame:
    pending = F.col("total_pending")
    return rev.queue_backlog(reviews).select(F.when(pending > 500, "critical").when(pending > 200, "degraded").otherwise("healthy").alias("status"), "*")


def dashboard(figures: DataFrame, found: DataFrame, users: DataFrame, uploads: DataFrame, reviews: DataFrame) -> DataFrame:
    """The headline row: health, rates, queue, leading insight and the totals."""
    lead = insights(figures).agg(F.min_by("insight", F.struct(severity_rank(), "position")).alias("top_insight"), F.count(F.lit(1)).alias("insights"))
    totals = m.review_queue_totals(reviews).select("auto_approved", "auto_rejected")
    parts = [system_alert(found).select(F.col("system_alert").alias("system_health")), figures.select(F.col("success_rate").alias("ocr_success_rate"), "avg_confidence", "fraud_rate", "duplicate_rate", F.col("total_pending").alias("review_queue_size"), F.col("high_risk_count").alias("high_risk_cases")), lead, totals, m.count_rows(users).select(F.col("n").alias("total_users")), m.count_rows(uploads).select(F.col("n").alias("total_documents"))]
    return reduce(lambda x, y: x.crossJoin(y), parts)  # rows of one


def active_alerts(alerts: DataFrame, most: int = 20) -> DataFrame:
    """Alerts that nobody has resolved, the gravest first; the limit is that of the list."""
    return alerts.where("NOT resolved").orderBy(F.when(F.col("severity") == "CRITICAL", 0).when(F.col("severity") == "WARNING", 1).otherwise(2), "alert_type").limit(most)


def system_health(alerts: DataFrame, queue: DataFrame, verified: DataFrame) -> DataFrame:
    """One row: health by open alerts and the queue, their numbers, and the success rate of reading."""
    a = alerts.where("NOT resolved").agg(F.count(F.lit(1)).alias("alerts"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"))
    one = a.crossJoin(queue.select(F.col("status").alias("queue_status"))).crossJoin(m.ocr_success_rate(verified).select(F.col("success_rate").alias("ocr_success_rate")))  # one row each
    health = F.when(F.col("critical") > 0, "CRITICAL").when((F.col("alerts") > 0) | (F.col("queue_status") != "healthy"), "WARNING").otherwise("HEALTHY")
    return one.select(health.alias("health"), "alerts", "critical", "queue_status", "ocr_success_rate")
