"""Queries over counts, series, reviewers, records and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossierlake.operators import duplicates as dup
from dossierlake.operators import metrics as m
from dossierlake.operators import records as rec
from dossierlake.operators import reviewers as rev
from dossierlake.operators import timeseries as ts
from dossierlake.plans._registry import query
from dossierlake.sources import logical as lt
from dossierlake.sources.logical import EVENTS_AS_OF as E_AT
from dossierlake.sources.logical import ORDERS_AS_OF as O_AT
from dossierlake.sources.logical import with_tables as w

_RATE = "coalesce(round({} / nullif({}, 0)::DOUBLE * 100, {}), 0.0)"


def pct(a: str, b: str, digits: int = 2) -> str:
    return _RATE.format(a, b, digits)


def spine(at: str, days: int) -> str:
    return f"spine AS (SELECT d::DATE AS date FROM range(DATE '{at[:10]}' - {days - 1}, DATE '{at[:10]}' + INTERVAL 1 DAY, INTERVAL 1 DAY) t(d))"


def daily(table: str, column: str, at: str, days: int, measures: str, defaults: str, where: str = "true") -> str:
    return w(
        f"""WITH {spine(at, days)}, c AS (SELECT {column}::DATE AS date, {measures} FROM {table} WHERE {where} AND {column} >= TIMESTAMP '{at}' - INTERVAL {days} DAY GROUP BY 1)
        SELECT date, {defaults} FROM spine LEFT JOIN c USING (date)""",
        table,
    )


# Counts and rates
query("a1_count_users", w(f"SELECT count(*) AS n FROM users WHERE created_at >= TIMESTAMP '{O_AT}' - INTERVAL 30 DAY", "users"))(lambda s, d: m.count_rows(lt.users(s, d), "created_at", "month", O_AT))
query("a2_count_documents", w(f"SELECT count(*) AS n FROM uploads WHERE uploaded_at >= TIMESTAMP '{E_AT}' - INTERVAL 7 DAY AND doc_type = 'purchase'", "uploads"))(lambda s, d: m.count_rows(lt.uploads(s, d), "uploaded_at", "week", E_AT, doc_type="purchase"))
query("f6_documents_today", w(f"SELECT count(*) AS n FROM uploads WHERE uploaded_at >= TIMESTAMP '{E_AT[:10]}'", "uploads"))(lambda s, d: m.count_rows(lt.uploads(s, d), "uploaded_at", "no such period", E_AT))
_VER = """count(*) AS total, count(*) FILTER (status IN ('VERIFIED', 'APPROVED')) AS verified, count(*) FILTER (status IN ('MISMATCH', 'REJECTED')) AS mismatch,
  count(*) FILTER (status IN ('POSSIBLE_MISMATCH', 'needs_review', 'REVIEW_REQUIRED')) AS possible_mismatch, count(*) FILTER (status = 'OCR_FAILED') AS ocr_failed, count(*) FILTER (status = 'DOC_TYPE_UNKNOWN') AS unknown"""
query("a3_verification_stats", w(f"SELECT {_VER} FROM verified", "verified"))(lambda s, d: m.verification_stats(lt.verified(s, d)))
query("a4_average_confidence", w("SELECT coalesce(round(avg(confidence_score), 4), 0.0) AS avg_confidence FROM extracted", "extracted"))(lambda s, d: m.average_confidence(lt.extracted(s, d)))
query("a5_review_queue_counts", w("""SELECT 'status' AS kind, status AS value, count(*) AS n FROM reviews GROUP BY status UNION ALL SELECT 'decision', decision, count(*) FROM reviews GROUP BY decision
  UNION ALL SELECT 'priority', priority::VARCHAR, count(*) FROM reviews GROUP BY priority""", "reviews"))(lambda s, d: m.review_queue_counts(lt.reviews(s, d)))
query("a5_review_queue_totals", w("""SELECT count(*) AS total, count(*) FILTER (status IN ('pending', 'in_review')) AS pending, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'rejected') AS rejected,
  count(*) FILTER (status = 'corrected') AS corrected, count(*) FILTER (decision = 'AUTO_APPROVED') AS auto_approved, count(*) FILTER (decision = 'AUTO_REJECTED') AS auto_rejected FROM reviews""", "reviews"))(lambda s, d: m.review_queue_totals(lt.reviews(s, d)))
query("a5_review_queue_fallback", w("""SELECT count(*) AS total, count(*) FILTER (status IN ('PENDING', 'needs_review', 'REVIEW_REQUIRED')) AS pending, count(*) FILTER (status IN ('VERIFIED', 'APPROVED')) AS approved,
  count(*) FILTER (status IN ('MISMATCH', 'REJECTED')) AS rejected, 0::BIGINT AS corrected, count(*) FILTER (status IN ('VERIFIED', 'APPROVED')) AS auto_approved, count(*) FILTER (status IN ('MISMATCH', 'REJECTED')) AS auto_rejected FROM verified""", "verified"))(lambda s, d: m.review_queue_fallback(lt.verified(s, d)))
_HIGH = "count(*) FILTER (risk_level IN ('HIGH_RISK', 'CRITICAL_RISK'))"
query("a6_fraud_summary", w(f"""SELECT count(*) AS total, count(*) FILTER (risk_level = 'LOW_RISK') AS low_count, count(*) FILTER (risk_level = 'MEDIUM_RISK') AS medium_count, {_HIGH} AS high_risk_count,
  count(*) FILTER (risk_level = 'CRITICAL_RISK') AS critical_count, count(*) FILTER (duplicate_detected) AS duplicate_count, count(*) FILTER (is_screenshot) AS screenshot_count, count(*) FILTER (tamper_score >= 25) AS tamper_count,
  {pct(_HIGH, 'count(*)')} AS fraud_rate, {pct('count(*) FILTER (duplicate_detected)', 'count(*)')} AS duplicate_rate FROM fraud""", "fraud"))(lambda s, d: m.fraud_summary(lt.fraud(s, d)))
_C = "coalesce(confidence_score, 0)"
query("a7_fraud_summary_proxy", w(f"""SELECT count(*) AS total, count(*) FILTER ({_C} < 0.6) AS high_risk_count, count(*) FILTER ({_C} >= 0.6) AS low_risk_count, count(*) FILTER ({_C} < 0.5) AS duplicate_count,
  {pct(f'count(*) FILTER ({_C} < 0.6)', 'count(*)')} AS fraud_rate, {pct(f'count(*) FILTER ({_C} < 0.5)', 'count(*)')} AS duplicate_rate FROM extracted""", "extracted"))(lambda s, d: m.fraud_summary_proxy(lt.extracted(s, d)))
query("a15_risk_distribution", w(f"SELECT risk_level, count(*) AS n, {pct('count(*)', 'sum(count(*)) OVER ()')} AS pct FROM fraud GROUP BY risk_level", "fraud"))(lambda s, d: m.risk_distribution(lt.fraud(s, d)))
query("a20_fraud_statistics", w(f"""SELECT count(*) AS total, round(avg(risk_score), 1) AS avg_risk_score, round(avg(quality_score), 1) AS avg_quality_score, round(avg(tamper_score), 1) AS avg_tamper_score,
  {pct('count(*) FILTER (duplicate_detected)', 'count(*)', 1)} AS duplicate_rate, {pct('count(*) FILTER (is_screenshot)', 'count(*)', 1)} AS screenshot_rate FROM fraud""", "fraud"))(lambda s, d: m.fraud_statistics(lt.fraud(s, d)))
query("a21_ocr_success_rate", w(f"""WITH v AS (SELECT {_VER} FROM verified) SELECT {pct('(total - ocr_failed)', 'total')} AS success_rate, {pct('ocr_failed', 'total')} AS failure_rate, {pct('verified', 'total')} AS verified_rate,
  total, ocr_failed, verified, mismatch FROM v""", "verified"))(lambda s, d: m.ocr_success_rate(lt.verified(s, d)))
query("a22_confidence_bands", w(f"SELECT CASE WHEN {_C} <= 0.40 THEN '0-40' WHEN {_C} <= 0.70 THEN '41-70' WHEN {_C} <= 0.85 THEN '71-85' ELSE '86-100' END AS band, count(*) AS n FROM extracted GROUP BY 1", "extracted"))(lambda s, d: m.confidence_bands(lt.extracted(s, d)))
query("a22_confidence_by_type", w(f"SELECT doc_type, round(avg({_C}), 4) AS avg_confidence FROM extracted GROUP BY 1", "extracted"))(lambda s, d: m.confidence_by_type(lt.extracted(s, d)))
query("a23_type_breakdown", w(f"SELECT doc_type, count(*) AS n, {pct('count(*)', 'sum(count(*)) OVER ()')} AS pct FROM extracted GROUP BY 1", "extracted"))(lambda s, d: m.type_breakdown(lt.extracted(s, d)))
query("a30_queue_stats", w("SELECT p::INT AS priority, count(id) AS n FROM range(1, 4) t(p) LEFT JOIN reviews ON priority = p AND status IN ('pending', 'in_review') GROUP BY 1", "reviews"))(lambda s, d: m.queue_stats(lt.reviews(s, d)))
query("a31_ocr_progress", w(f"""WITH a AS (SELECT count(*) AS total FROM uploads), b AS (SELECT count(DISTINCT id) AS done FROM extracted WHERE confidence_score > 0.3), c AS (SELECT count(*) FILTER (status = 'approved') AS approved FROM reviews)
  SELECT total, least(done, total) AS processed, greatest(0, total - least(done, total))::BIGINT AS remaining, approved, {pct('least(done, total)', 'total', 1)} AS pct FROM a, b, c""", "uploads", "extracted", "reviews"))(lambda s, d: m.ocr_progress(lt.uploads(s, d), lt.extracted(s, d).where("confidence_score > 0.3"), lt.reviews(s, d)))
query("a32_evaluate_summary", w("SELECT CASE decision WHEN 'AUTO_APPROVED' THEN 'approved' WHEN 'AUTO_REJECTED' THEN 'rejected' WHEN 'REVIEW_REQUIRED' THEN 'review' ELSE 'pending' END AS outcome, count(*) AS n FROM reviews GROUP BY 1", "reviews"))(lambda s, d: m.evaluate_summary(lt.reviews(s, d)))
query("a33_worker_health", w(f"""WITH a AS (SELECT count(*) AS total_documents FROM uploads WHERE uploaded_at < TIMESTAMP '{E_AT}' - INTERVAL 1 HOUR), b AS (SELECT count(*) AS total_extracted FROM extracted WHERE confidence_score > 0.5),
  c AS (SELECT *, greatest(0, total_documents - total_extracted)::BIGINT AS unprocessed_count FROM a, b), e AS (SELECT *, unprocessed_count / greatest(total_documents, 1)::DOUBLE AS r FROM c)
  SELECT CASE WHEN r > 0.5 THEN 'degraded' WHEN r > 0.8 THEN 'critical' ELSE 'healthy' END AS status, total_documents, total_extracted, unprocessed_count, round((1 - r) * 100, 1) AS coverage_rate FROM e""", "uploads", "extracted"))(lambda s, d: m.worker_health(lt.uploads(s, d), lt.extracted(s, d).where("confidence_score > 0.5"), E_AT))

# Series
_N = ("count(*) AS count", "coalesce(count, 0) AS count")
query("a8_daily_counts", w(f"""WITH {spine(E_AT, 14)}, c AS (SELECT uploaded_at::DATE AS date, count(*) AS count FROM uploads WHERE uploaded_at >= TIMESTAMP '{E_AT}' - INTERVAL 14 DAY GROUP BY 1),
  x AS (SELECT date, coalesce(count, 0) AS count FROM spine LEFT JOIN c USING (date)), r AS (SELECT *, coalesce(avg(count) OVER (ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0.0) AS a FROM x)
  SELECT date, count, round(a, 2) AS rolling_avg, round(a * 1.1, 2) AS threshold, CASE WHEN a > 0 AND count > a * 1.2 THEN 'CRITICAL' WHEN a > 0 AND count > a * 1.1 THEN 'WARNING' END AS severity FROM r""", "uploads"))(
    lambda s, d: ts.spikes(ts.daily_counts(lt.uploads(s, d), "uploaded_at", E_AT, 14), 1.1, 1.2))
query("a8_daily_counts_30", daily("uploads", "uploaded_at", E_AT, 30, *_N))(lambda s, d: ts.daily_counts(lt.uploads(s, d), "uploaded_at", E_AT, 30))
_D30 = daily("uploads", "uploaded_at", E_AT, 30, *_N)
query("a9_weekly_counts", f"SELECT date_trunc('week', date)::DATE AS week, sum(count)::BIGINT AS count FROM ({_D30}) GROUP BY 1")(lambda s, d: ts.weekly(ts.daily_counts(lt.uploads(s, d), "uploaded_at", E_AT, 30)))
query("a10_upload_growth", f"""SELECT l::BIGINT AS last_7_days, p::BIGINT AS prev_7_days, CASE WHEN p > 0 THEN round((l - p) / p::DOUBLE * 100, 1) ELSE 0.0 END AS growth_pct FROM
  (SELECT sum(count) FILTER (b <= 7) AS l, sum(count) FILTER (b BETWEEN 8 AND 14) AS p FROM (SELECT *, row_number() OVER (ORDER BY date DESC) AS b FROM ({_D30})))""")(lambda s, d: ts.growth(ts.daily_counts(lt.uploads(s, d), "uploaded_at", E_AT, 30)))
query("a11_reviews_created", daily("reviews", "created_at", O_AT, 30, *_N))(lambda s, d: ts.daily_counts(lt.reviews(s, d), "created_at", O_AT, 30))
query("a11_reviews_resolved", daily("reviews", "reviewed_at", O_AT, 30, *_N))(lambda s, d: ts.daily_counts(lt.reviews(s, d), "reviewed_at", O_AT, 30))
query("a12_fraud_rate_trend", daily("fraud", "analyzed_at", O_AT, 30, f"count(*) AS t, {_HIGH} AS h", "coalesce(t, 0) AS total, coalesce(h, 0) AS high_risk, round(coalesce(h, 0) / greatest(coalesce(t, 0), 1)::DOUBLE * 100, 2) AS fraud_rate_pct"))(lambda s, d: ts.fraud_rate_trend(lt.fraud(s, d), O_AT, 30))
query("a13_confidence_trend", daily("extracted", "processed_at", E_AT, 30, f"round(avg({_C}), 4) AS a, count(*) AS n", "coalesce(a, 0.0) AS avg_confidence, coalesce(n, 0) AS sample_count"))(lambda s, d: ts.confidence_trend(lt.extracted(s, d), E_AT, 30))
query("a16_duplicate_trend", daily("fraud", "analyzed_at", O_AT, 14, "count(*) FILTER (duplicate_detected) AS n", "coalesce(n, 0) AS duplicate_count"))(lambda s, d: ts.duplicate_trend(lt.fraud(s, d), O_AT, 14))
query("a17_risk_trend", daily("fraud", "analyzed_at", O_AT, 14, f"count(*) AS t, {_HIGH} AS h, round(avg(risk_score), 1) AS a", "coalesce(t, 0) AS total, coalesce(h, 0) AS high_risk, coalesce(a, 0.0) AS avg_risk_score"))(lambda s, d: ts.risk_trend(lt.fraud(s, d), O_AT, 14))
query("a18_quality_trend", daily("fraud", "analyzed_at", O_AT, 14, "round(avg(quality_score), 1) AS a, count(*) FILTER (is_screenshot) AS n, count(*) FILTER (duplicate_detected) AS p", "coalesce(a, 0.0) AS avg_quality, coalesce(n, 0) AS screenshot_count, coalesce(p, 0) AS duplicate_count"))(lambda s, d: ts.quality_trend(lt.fraud(s, d), O_AT, 14))
query("a24_failure_trend", daily("verified", "verified_at", E_AT, 14, *_N, where="status = 'OCR_FAILED'"))(lambda s, d: ts.daily_counts(lt.verified(s, d).where("status = 'OCR_FAILED'"), "verified_at", E_AT, 14))
query("w1_rolling_mean", f"SELECT *, coalesce(avg(count) OVER (ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0.0) AS rolling_avg FROM ({_D30})")(lambda s, d: ts.rolling_mean(ts.daily_counts(lt.uploads(s, d), "uploaded_at", E_AT, 30)))
query("w2_latest_value", f"SELECT arg_max(count, date) AS today FROM ({_D30})")(lambda s, d: ts.latest_value(ts.daily_counts(lt.uploads(s, d), "uploaded_at", E_AT, 30)))
_DUP = daily("fraud", "analyzed_at", O_AT, 14, "count(*) FILTER (duplicate_detected) AS n", "coalesce(n, 0) AS duplicate_count")
query("w4_recent_duplicates", f"SELECT round(avg(duplicate_count) FILTER (b <= 3), 4) AS recent, round(avg(duplicate_count) FILTER (b BETWEEN 4 AND 8), 4) AS earlier FROM (SELECT *, row_number() OVER (ORDER BY date DESC) AS b FROM ({_DUP}))")(lambda s, d: ts.recent_mean_ratio(ts.duplicate_trend(lt.fraud(s, d), O_AT, 14), "duplicate_count", 3, 5))
_QUAL = daily("fraud", "analyzed_at", O_AT, 14, "round(avg(quality_score), 1) AS a", "nullif(coalesce(a, 0.0), 0.0) AS q")
query("w5_recent_quality", f"SELECT round(avg(q) FILTER (b <= 3), 4) AS recent, round(avg(q) FILTER (b BETWEEN 4 AND 7), 4) AS earlier FROM (SELECT *, row_number() OVER (ORDER BY date DESC) AS b FROM ({_QUAL}))")(lambda s, d: ts.recent_mean_ratio(ts.quality_trend(lt.fraud(s, d), O_AT, 14), "avg_quality", 3, 4, skip_zero=True))

# Reviewers
_STATS = f"""SELECT reviewer_id, count(*) AS total, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'corrected') AS corrected,
  count(*) FILTER (status = 'reprocess_requested') AS reprocessed, {pct("count(*) FILTER (status = 'approved')", 'count(*)')} AS approval_rate, {pct("count(*) FILTER (status = 'rejected')", 'count(*)')} AS rejection_rate,
  {pct("count(*) FILTER (status = 'corrected')", 'count(*)')} AS correction_rate FROM reviews WHERE reviewer_id IS NOT NULL GROUP BY 1"""
query("a25_reviewer_stats", w(_STATS, "reviews"))(lambda s, d: rev.reviewer_stats(lt.reviews(s, d)))
query("a26_leaderboard", w(f"""WITH st AS ({_STATS}) SELECT *, round(greatest(0.0, least(100.0, 0.40::DOUBLE * least(100, total * 5) + 0.30::DOUBLE * approval_rate - 0.30::DOUBLE * (correction_rate * 0.5::DOUBLE))), 1) AS productivity_score,
  row_number() OVER (ORDER BY total DESC, reviewer_id)::INT AS rank FROM st QUALIFY rank <= 10""", "reviews"))(lambda s, d: rev.leaderboard(lt.reviews(s, d)))
query("a27_queue_backlog", w("""SELECT count(*) AS total_pending, count(*) FILTER (priority = 1) AS high_priority, count(*) FILTER (priority = 2) AS medium_priority, count(*) FILTER (priority = 3) AS low_priority,
  count(*) FILTER (status = 'in_review') AS being_reviewed, count(*) FILTER (status <> 'in_review') AS awaiting_review, count(*) > 200 OR count(*) FILTER (priority = 1) > 50 AS overloaded FROM reviews WHERE status IN ('pending', 'in_review')""", "reviews"))(lambda s, d: rev.queue_backlog(lt.reviews(s, d)))
query("a28_correction_frequency", w("SELECT 'field' AS kind, field AS value, count(*) AS n FROM corrections GROUP BY 2 UNION ALL SELECT 'type', correction_type, count(*) FROM corrections GROUP BY 2", "corrections"))(lambda s, d: rev.correction_frequency(lt.corrections(s, d)))
query("a28_most_corrected", w("SELECT field, count(*) AS n FROM corrections GROUP BY 1 ORDER BY n DESC, field LIMIT 1", "corrections"))(lambda s, d: rev.most_corrected(lt.corrections(s, d)))
query("a29_distinct_reviewers", w("SELECT count(DISTINCT reviewer_id) AS n FROM reviews", "reviews"))(lambda s, d: lt.reviews(s, d).agg(F.countDistinct("reviewer_id").alias("n")))
_PAGE = "SELECT user_id, r.id, doc_type, status, decision, priority, reviewer_id, r.created_at, reviewed_at, ocr_confidence, full_name, dob FROM reviews r JOIN users u ON u.id = r.user_id WHERE status IN ('pending', 'in_review')"
query("o2_review_page", w(f"{_PAGE} AND priority = 2 ORDER BY priority, r.created_at, r.id LIMIT 20 OFFSET 20", "reviews", "users"))(lambda s, d: rev.review_page(lt.reviews(s, d), lt.users(s, d), page=2, priority=2))
query("o2_page_count", w("SELECT count(*) AS total, greatest(1, ceil(count(*) / 20.0))::BIGINT AS pages FROM reviews WHERE status IN ('pending', 'in_review')", "reviews"))(lambda s, d: rev.page_count(lt.reviews(s, d)))

# Joins, latest records, collisions
query("j1_review_queue_view", w(_PAGE, "reviews", "users"))(lambda s, d: lt.reviews(s, d).where("status IN ('pending', 'in_review')").join(lt.users(s, d).select(F.col("id").alias("user_id"), "full_name", "dob"), "user_id"))
query("j2_fraud_risk_dashboard", w("SELECT user_id, f.id, risk_score, risk_level, full_name FROM fraud f JOIN users u ON u.id = f.user_id WHERE risk_level IN ('HIGH_RISK', 'CRITICAL_RISK')", "fraud", "users"))(lambda s, d: lt.fraud(s, d).where("risk_level IN ('HIGH_RISK', 'CRITICAL_RISK')").join(lt.users(s, d).select(F.col("id").alias("user_id"), "full_name"), "user_id").select("user_id", "id", "risk_score", "risk_level", "full_name"))
_LAST_X = "SELECT * FROM extracted QUALIFY row_number() OVER (PARTITION BY user_id, doc_type ORDER BY processed_at DESC, id DESC) = 1"
_LAST_R = "SELECT * FROM reviews QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) = 1"
query("w7_latest_extractions", w(_LAST_X, "extracted"))(lambda s, d: rec.latest_extractions(lt.extracted(s, d)))
query("w8_latest_reviews", w(_LAST_R, "reviews"))(lambda s, d: rec.latest_reviews(lt.reviews(s, d)))
_STATE = "CASE WHEN id % 13 = 0 THEN 'verified' WHEN id % 11 = 0 THEN 'UPLOADED' WHEN id % 7 = 0 THEN 'Rejected' END"
_OUTCOME = "CASE WHEN status IN ('approved', 'corrected') THEN 'completed' ELSE status END AS status, CASE WHEN status IN ('approved', 'corrected') THEN 'approved' WHEN status = 'rejected' THEN 'rejected' END AS decision"
query("j4_user_overview", w(f"""WITH x AS ({_LAST_X}), t AS (SELECT user_id, string_agg(DISTINCT doc_type, ',' ORDER BY doc_type) AS doc_types, arg_max_null(confidence_score, (processed_at, id)) AS confidence FROM x GROUP BY 1), r AS (SELECT user_id, {_OUTCOME} FROM ({_LAST_R})),
  v AS (SELECT *, {_STATE} AS st, CASE WHEN id % 17 = 0 THEN 'Verified' END AS wf FROM users)
  SELECT u.id AS user_id, full_name, doc_types, confidence, r.status AS review_status, r.decision AS review_decision, CASE WHEN upper(coalesce(st, '')) = 'VERIFIED' OR upper(coalesce(wf, '')) = 'VERIFIED' THEN 'VERIFIED' WHEN upper(st) IN ('REJECTED', 'APPROVED', 'REVIEW_REQUIRED', 'UPLOADED', 'PROCESSING') THEN upper(st)
    WHEN r.status = 'completed' AND r.decision = 'approved' THEN 'VERIFIED' WHEN r.decision = 'rejected' THEN 'REJECTED' WHEN r.status = 'pending' THEN 'REVIEW_REQUIRED' WHEN r.status IS NOT NULL THEN upper(coalesce(st, '')) ELSE 'PENDING' END AS display_status
  FROM v u LEFT JOIN t ON t.user_id = u.id LEFT JOIN r ON r.user_id = u.id""", "users", "extracted", "reviews"))(lambda s, d: rec.user_overview(_stateful(lt.users(s, d)), lt.extracted(s, d), _outcomes(lt.reviews(s, d))))


def _stateful(users: DataFrame) -> DataFrame:
    k = F.col("id")
    return users.withColumns({"status": F.when(k % 13 == 0, "verified").when(k % 11 == 0, "UPLOADED").when(k % 7 == 0, "Rejected"), "workflow_state": F.when(k % 17 == 0, "Verified")})


def _outcomes(reviews: DataFrame) -> DataFrame:
    """Reviews whose decision is the reviewer's."""
    done = F.col("status").isin("approved", "corrected")
    return reviews.withColumn("decision", F.when(done, "approved").when(F.col("status") == "rejected", "rejected")).withColumn("status", F.when(done, "completed").otherwise(F.col("status")))


def collisions(expr: str, kind: str) -> str:
    return w(f"""WITH g AS (SELECT {expr} AS number, user_id FROM identities), f AS (SELECT number, user_id, count(*) AS n FROM g WHERE length(number) > 0 GROUP BY number, user_id)
  SELECT '{kind}' AS match_type, number, user_id, min(user_id) OVER k AS first_user, n, count(*) OVER k - 1 AS others FROM f WINDOW k AS (PARTITION BY number) QUALIFY others > 0""", "identities")


_AADHAAR, _PAN = collisions("regexp_replace(coalesce(aadhaar_number, ''), '\\s', '', 'g')", "AADHAAR_NUMBER"), collisions("upper(coalesce(pan_number, ''))", "PAN_NUMBER")
query("j6_aadhaar_collisions", _AADHAAR)(lambda s, d: rec.id_collisions(lt.identities(s, d), rec.aadhaar_number(), "AADHAAR_NUMBER"))
query("j6_pan_collisions", _PAN)(lambda s, d: rec.id_collisions(lt.identities(s, d), rec.pan_number(), "PAN_NUMBER"))
query("u2_all_collisions", f"SELECT * FROM ({_AADHAAR}) UNION ALL SELECT * FROM ({_PAN})")(lambda s, d: rec.id_collisions(lt.identities(s, d), rec.aadhaar_number(), "AADHAAR_NUMBER").unionByName(rec.id_collisions(lt.identities(s, d), rec.pan_number(), "PAN_NUMBER")))
query("j8_same_names", w("SELECT id, full_name, count(*) OVER (PARTITION BY lower(trim(full_name))) - 1 AS others FROM users WHERE len(regexp_split_to_array(trim(full_name), '\\s+')) >= 2 QUALIFY others >= 3", "users"))(lambda s, d: rec.same_names(lt.users(s, d)))
query("j10_users_with_rejections", w("SELECT id, full_name FROM users WHERE id IN (SELECT user_id FROM reviews WHERE status = 'rejected')", "users", "reviews"))(lambda s, d: lt.users(s, d).join(lt.reviews(s, d).where("status = 'rejected'").select(F.col("user_id").alias("id")), "id", "left_semi").select("id", "full_name"))
query("j11_missing_type", w("SELECT id, full_name FROM users WHERE id NOT IN (SELECT user_id FROM reviews WHERE doc_type = 'pan')", "users", "reviews"))(lambda s, d: rec.missing_type(lt.users(s, d), lt.reviews(s, d), "pan"))
query("w9_top_risky_users", w("SELECT user_id, risk_score, risk_level FROM (SELECT * FROM fraud WHERE risk_score >= 50 ORDER BY risk_score DESC, id LIMIT 50) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY risk_score DESC, id) = 1", "fraud"))(lambda s, d: rec.top_risky(lt.fraud(s, d), 50))
query("w9_top_risky_users_corrected", w("SELECT user_id, risk_score, risk_level FROM (SELECT * FROM fraud WHERE risk_score >= 50 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY risk_score DESC, id) = 1) ORDER BY risk_score DESC, id LIMIT 50", "fraud"))(lambda s, d: rec.top_risky(lt.fraud(s, d), 50, corrected=True))
_AUDIT = ("SELECT 'review' AS source, status AS action, id AS ref, created_at AS happened_at FROM reviews", "SELECT 'correction' AS source, correction_type AS action, review_id AS ref, created_at AS happened_at FROM corrections", "SELECT 'upload' AS source, doc_type AS action, id AS ref, uploaded_at AS happened_at FROM uploads")
query("u1_audit_events", w(" UNION ALL ".join(_AUDIT), "reviews", "corrections", "uploads"))(lambda s, d: rec.audit_events(lt.reviews(s, d), lt.corrections(s, d), lt.uploads(s, d)))
query("u1_audit_page", w(f"""SELECT * FROM ({" UNION ALL ".join(f"(SELECT * FROM ({a}) ORDER BY happened_at DESC, ref, action LIMIT 200)" for a in _AUDIT)}) WHERE action <> 'view' ORDER BY happened_at DESC, source, ref, action LIMIT 50""", "reviews", "corrections", "uploads"))(
    lambda s, d: rec.audit_events(lt.reviews(s, d), lt.corrections(s, d), lt.uploads(s, d), 200).where("action <> 'view'").orderBy(F.desc("happened_at"), "source", "ref", "action").limit(50))
query("u3_types_of_users", w("SELECT user_id, string_agg(DISTINCT doc_type, ',' ORDER BY doc_type) AS types FROM (SELECT user_id, doc_type FROM uploads UNION SELECT user_id, doc_type FROM reviews) GROUP BY 1", "uploads", "reviews"))(
    lambda s, d: lt.uploads(s, d).select("user_id", "doc_type").union(lt.reviews(s, d).select("user_id", "doc_type")).distinct().groupBy("user_id").agg(F.concat_ws(",", F.sort_array(F.collect_set("doc_type"))).alias("types")))


_CLASSES = "SELECT kind, hash, count(*) AS documents, min(user_id) AS lu, max(user_id) AS mu FROM (" + " UNION ALL ".join(f"SELECT user_id, '{k}' AS kind, {k} AS hash FROM hashes" for k in dup.KINDS) + ") GROUP BY ALL"
query("j7_near_images", w(f"""WITH c AS ({_CLASSES}), p AS (SELECT a.kind, a.hash AS hash_a, b.hash AS hash_b, bit_count(xor(('0x' || a.hash)::UBIGINT, ('0x' || b.hash)::UBIGINT))::INT AS distance, a.documents AS documents_a, b.documents AS documents_b, least(a.lu, b.lu) AS lu, greatest(a.mu, b.mu) AS mu
    FROM c a JOIN c b ON a.kind = b.kind AND length(a.hash) = length(b.hash) AND a.hash <= b.hash)
  SELECT kind, hash_a, hash_b, distance, documents_a, documents_b, greatest(0, floor((1 - distance / 64.0::DOUBLE) * 100))::INT AS similarity, CASE WHEN distance <= 3 THEN 'IDENTICAL' WHEN distance <= 10 THEN 'NEAR_DUPLICATE' ELSE 'SIMILAR' END AS match_class FROM p WHERE distance <= 10 AND lu < mu""", "hashes"))(lambda s, d: dup.near_images(lt.hashes(s, d)))
query("j7_image_hashes", w("SELECT document_id, user_id, unnest(['phash', 'ahash', 'dhash']) AS kind, unnest([phash, ahash, dhash]) AS hash FROM hashes", "hashes"))(lambda s, d: dup.image_hashes(lt.hashes(s, d)))
query("m5_hash_distances", w("SELECT document_id, CASE WHEN length(phash) = length(ahash) THEN bit_count(xor(('0x' || phash)::UBIGINT, ('0x' || ahash)::UBIGINT))::INT ELSE 999 END AS distance FROM hashes", "hashes"))(lambda s, d: lt.hashes(s, d).select("document_id", dup.hamming(F.col("phash"), F.col("ahash")).alias("distance")))
