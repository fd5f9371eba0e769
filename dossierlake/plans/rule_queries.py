"""Queries over the rule engines, search, votes and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlake.functions import names as nm
from dossierlake.functions import scores as sc
from dossierlake.operators import duplicates as dup
from dossierlake.operators import metrics as m
from dossierlake.operators import votes as vt
from dossierlake.plans import metric_queries as mq
from dossierlake.plans import rules, search
from dossierlake.plans._registry import query
from dossierlake.sources import logical as lt
from dossierlake.sources.logical import EVENTS_AS_OF as E_AT
from dossierlake.sources.logical import ORDERS_AS_OF as O_AT
from dossierlake.sources.logical import with_tables as w

# Scores
_K = "o_orderkey"


def risk_inputs(s: SparkSession, d: str) -> DataFrame:
    k = F.col(_K)
    parts = {"tamper": k * 13 % 101, "duplicate": k * 7 % 131, "quality": k * 29 % 101, "metadata": k * 3 % 101, "pattern": k * 11 % 101}
    return lt.table(s, d, "orders").select(k.alias("id"), *[v.cast("int").alias(n) for n, v in parts.items()], (k % 100 / F.lit(100.0)).alias("confidence"))


_RISK_IN = f"""i AS (SELECT {_K} AS id, {_K} * 13 % 101 AS tamper, {_K} * 7 % 131 AS dup0, {_K} * 29 % 101 AS quality, {_K} * 3 % 101 AS metadata, {_K} * 11 % 101 AS pattern, ({_K} % 100) / 100.0::DOUBLE AS c FROM orders),
 r AS (SELECT *, 0.0::DOUBLE + tamper * 0.30::DOUBLE + least(dup0, 100) * 0.25::DOUBLE + (100 - quality) * 0.20::DOUBLE + metadata * 0.15::DOUBLE + pattern * 0.10::DOUBLE
   + CASE WHEN c < 0.40 THEN (0.40::DOUBLE - c) * 30 WHEN c < 0.70 THEN (0.70::DOUBLE - c) * 10 ELSE 0.0::DOUBLE END AS raw FROM i), q AS (SELECT *, least(100, trunc(raw))::INT AS risk_score FROM r),
 l AS (SELECT *, CASE WHEN risk_score <= 24 THEN 'LOW_RISK' WHEN risk_score <= 49 THEN 'MEDIUM_RISK' WHEN risk_score <= 74 THEN 'HIGH_RISK' ELSE 'CRITICAL_RISK' END AS risk_level FROM q)"""


@query("m1_risk_score", f"""WITH {_RISK_IN} SELECT id, risk_score, risk_level, CASE risk_level WHEN 'CRITICAL_RISK' THEN CASE WHEN dup0 >= 70 THEN 'block_and_investigate_identity_collision' WHEN tamper >= 70 THEN 'block_and_flag_for_fraud_review' ELSE 'escalate_to_fraud_team' END
  WHEN 'HIGH_RISK' THEN 'manual_review_required' WHEN 'MEDIUM_RISK' THEN 'enhanced_verification_recommended' ELSE 'proceed_with_standard_review' END AS recommendation,
  CASE risk_level WHEN 'LOW_RISK' THEN 3 WHEN 'MEDIUM_RISK' THEN 2 ELSE 1 END AS priority FROM l""")
def risk(s: SparkSession, d: str) -> DataFrame:
    x = risk_inputs(s, d)
    score = sc.risk_score(*[F.col(c) for c in ("tamper", "duplicate", "quality", "metadata", "pattern", "confidence")])
    out = x.withColumn("risk_score", score).withColumn("risk_level", sc.risk_level(F.col("risk_score")))
    return out.select("id", "risk_score", "risk_level", sc.recommendation(F.col("risk_level"), F.col("tamper"), F.col("duplicate")).alias("recommendation"), sc.review_priority(F.col("risk_level")).alias("priority"))


_PTS = "CASE WHEN k % 4 = 0 THEN 70 WHEN k % 4 = 1 THEN 60 WHEN k % 4 = 2 THEN 40 WHEN k % 8 = 3 THEN 20 ELSE 0 END"


@query("m3_duplicate_score", f"SELECT user_id, least(100, sum({_PTS}))::BIGINT AS duplicate_score FROM (SELECT o_custkey AS user_id, o_orderkey AS k FROM orders) GROUP BY 1")
def duplicate_scores(s: SparkSession, d: str) -> DataFrame:
    k = F.col(_K)
    kind = F.when(k % 4 == 0, "PAN_NUMBER").otherwise("IMAGE_HASH")
    cls = F.when(k % 4 == 1, "IDENTICAL").when(k % 4 == 2, "NEAR_DUPLICATE").when(k % 8 == 3, "SIMILAR").otherwise("DIFFERENT")
    return dup.duplicate_score(lt.table(s, d, "orders").select(F.col("o_custkey").alias("user_id"), kind.alias("match_type"), cls.alias("match_class")), "user_id")


_FLAGS = (("u > 5", "high_upload_frequency", 25), ("f >= 3", "repeated_ocr_failures", 20), ("j >= 2", "repeated_document_rejections", 30), ("n >= 3", "multiple_users_same_name", 20), ("p > 0", "prior_duplicate_match_history", 40))


@query("m4_pattern_score", w(f"""WITH a AS (SELECT user_id, count(*) AS u FROM uploads WHERE uploaded_at >= TIMESTAMP '{E_AT}' - INTERVAL 1 HOUR GROUP BY 1), b AS (SELECT user_id, count(*) AS f FROM verified WHERE status = 'OCR_FAILED' GROUP BY 1),
  c AS (SELECT user_id, count(*) AS j FROM reviews WHERE status = 'rejected' GROUP BY 1), n AS (SELECT id, count(*) OVER (PARTITION BY lower(trim(full_name))) - 1 AS n FROM users),
  e AS (SELECT user_id, count(*) AS p FROM fraud WHERE duplicate_detected GROUP BY 1),
  z AS (SELECT n.id AS user_id, coalesce(u, 0) AS u, coalesce(f, 0) AS f, coalesce(j, 0) AS j, n, coalesce(p, 0) AS p FROM n LEFT JOIN a ON a.user_id = n.id LEFT JOIN b ON b.user_id = n.id LEFT JOIN c ON c.user_id = n.id LEFT JOIN e ON e.user_id = n.id),
  y AS (SELECT user_id, {' + '.join(f'CASE WHEN {c} THEN {p} ELSE 0 END' for c, _, p in _FLAGS)} AS t, {' + '.join(f'CASE WHEN {c} THEN 1 ELSE 0 END' for c, _, _ in _FLAGS)} AS k,
    concat_ws(',', {', '.join(f"CASE WHEN {c} THEN '{f}' END" for c, f, _ in _FLAGS)}) AS flags FROM z)
  SELECT user_id, least(100, t)::INT AS pattern_score, flags, t >= 25 OR k >= 2 AS is_suspicious FROM y""", "uploads", "verified", "reviews", "users", "fraud"))
def patterns(s: SparkSession, d: str) -> DataFrame:
    def count(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias(name))

    u = lt.users(s, d)
    key = F.lower(F.trim("full_name"))
    namesakes = u.groupBy(key.alias("key")).agg((F.count(F.lit(1)) - 1).alias("n"))
    recent = lt.uploads(s, d).where(F.col("uploaded_at") >= m.instant(E_AT) - F.expr("INTERVAL 1 HOUR"))
    rows = u.select("id", key.alias("key")).join(namesakes, "key")
    for part in (count(recent, "u"), count(lt.verified(s, d).where("status = 'OCR_FAILED'"), "f"), count(lt.reviews(s, d).where("status = 'rejected'"), "j"), count(lt.fraud(s, d).where("duplicate_detected"), "p")):
        rows = rows.join(part, "id", "left")
    zero = [F.coalesce(c, F.lit(0)) for c in ("u", "f", "j", "n", "p")]
    out = rows.select(F.col("id").alias("user_id"), sc.pattern_flags(*zero).alias("f")).withColumn("pattern_score", sc.pattern_score(F.col("f")))
    return out.select("user_id", "pattern_score", F.concat_ws(",", "f").alias("flags"), ((F.col("pattern_score") >= 25) | (F.size("f") >= 2)).alias("is_suspicious"))


query("m9_percentages", f"""SELECT {_K} AS id, CASE WHEN {_K} % 700 > 0 AND {_K} % 500 <= {_K} % 700 THEN round(({_K} % 500) / ({_K} % 700)::DOUBLE * 100, 2) END AS pct, round(({_K} % 110) / 10.0::DOUBLE / 10.0::DOUBLE * 100, 2) AS from_cgpa FROM orders""")(
    lambda s, d: lt.table(s, d, "orders").select(F.col(_K).alias("id"), sc.percentage(F.col(_K) % 500, F.col(_K) % 700).alias("pct"), sc.cgpa_percentage(F.col(_K) % 110 / F.lit(10.0)).alias("from_cgpa")))
query("m12_recalibrated", f"""SELECT id, round(greatest(0.0, least(1.0, CASE WHEN id % 3 = 0 THEN (c + 0.9::DOUBLE) / 2 ELSE c END + CASE WHEN id % 2 = 0 THEN 0.1::DOUBLE ELSE -0.3::DOUBLE END - (id % 4) * 0.05::DOUBLE)), 6) AS confidence
  FROM (SELECT {_K} AS id, ({_K} % 100) / 100.0::DOUBLE AS c FROM orders)""")(
    lambda s, d: lt.table(s, d, "orders").select(F.col(_K).alias("id"), F.round(sc.recalibrated(F.col(_K) % 100 / F.lit(100.0), F.col(_K) % 2 == 0, F.col(_K) % 3 == 0, F.col(_K) % 4), 6).alias("confidence")))
query("x25_field_confidence", f"SELECT {_K} AS id, CASE WHEN {_K} % 5 > 0 THEN least(100, 30 + CASE WHEN {_K} % 2 = 0 THEN 60 ELSE 0 END + CASE WHEN {_K} % 3 = 0 THEN 20 ELSE 0 END) ELSE 0 END AS confidence FROM orders")(
    lambda s, d: lt.table(s, d, "orders").select(F.col(_K).alias("id"), sc.field_confidence(F.col(_K) % 5 > 0, F.col(_K) % 2 == 0, F.col(_K) % 3 == 0).alias("confidence")))


# Names and fields
def field_pairs(s: SparkSession, d: str) -> DataFrame:
    """Stored fields of users against what their reviews read: equal, changed or missing by id."""
    u = lt.users(s, d).select(F.col("id").alias("user_id"), F.col("full_name").alias("stored_name"), F.col("dob").alias("stored_dob"))
    r = lt.reviews(s, d).select("id", "user_id", "doc_type", "ocr_confidence")
    k = F.col("id")
    x = r.join(u, "user_id")
    stored = F.concat(F.lit("ID "), F.lpad((k % 9000).cast("string"), 4, "0"))
    found_name = F.when(k % 7 == 0, F.lit(None).cast("string")).when(k % 5 == 0, F.concat("stored_name", F.lit("x"))).when(k % 3 == 0, F.upper("stored_name")).otherwise(F.col("stored_name"))
    found_dob = F.when(k % 11 == 0, F.right("stored_dob", F.lit(4))).when(k % 13 == 0, F.lit("01/01/1900")).when(k % 17 == 0, F.lit("")).otherwise(F.translate("stored_dob", "/", "-"))
    found_id = F.when(k % 19 == 0, F.lit("0000")).when(k % 23 == 0, F.lit(None).cast("string")).otherwise(F.lower(F.concat_ws("-", F.substring(stored, 1, 2), F.substring(stored, 4, 4))))
    return x.select("id", "doc_type", "ocr_confidence", "stored_name", found_name.alias("found_name"), "stored_dob", found_dob.alias("found_dob"), stored.alias("stored_id"), found_id.alias("found_id"))


_PAIRS = """p AS (SELECT r.id, r.doc_type, ocr_confidence, full_name AS stored_name, CASE WHEN r.id % 7 = 0 THEN NULL WHEN r.id % 5 = 0 THEN full_name || 'x' WHEN r.id % 3 = 0 THEN upper(full_name) ELSE full_name END AS found_name, dob AS stored_dob,
  CASE WHEN r.id % 11 = 0 THEN right(dob, 4) WHEN r.id % 13 = 0 THEN '01/01/1900' WHEN r.id % 17 = 0 THEN '' ELSE replace(dob, '/', '-') END AS found_dob, 'ID ' || lpad((r.id % 9000)::VARCHAR, 4, '0') AS stored_id,
  CASE WHEN r.id % 19 = 0 THEN '0000' WHEN r.id % 23 = 0 THEN NULL ELSE 'id-' || lpad((r.id % 9000)::VARCHAR, 4, '0') END AS found_id FROM reviews r JOIN users u ON u.id = r.user_id),
 c AS (SELECT *, trim(regexp_replace(regexp_replace(lower(stored_name), '[^a-z\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS na, trim(regexp_replace(regexp_replace(lower(coalesce(found_name, '')), '[^a-z\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS nb,
   replace(coalesce(found_dob, ''), '-', '/') AS nd, upper(regexp_replace(stored_id, '[\\s-]', '', 'g')) AS ia, upper(regexp_replace(coalesce(found_id, ''), '[\\s-]', '', 'g')) AS ib FROM p),
 t AS (SELECT *, CASE WHEN found_name IS NULL THEN 0.0 WHEN na = nb THEN 100.0 ELSE 0.0 END AS name_score, CASE WHEN nd = '' THEN 'MISMATCH' WHEN nd = stored_dob THEN 'MATCH' WHEN length(nd) = 4 AND right(stored_dob, 4) = nd THEN 'POSSIBLE_MATCH' ELSE 'MISMATCH' END AS dob_status,
   CASE WHEN ib = '' THEN 'MISMATCH' WHEN ia = ib THEN 'MATCH' ELSE 'MISMATCH' END AS id_status FROM c),
 v AS (SELECT *, CASE WHEN name_score >= 90 THEN 'MATCH' WHEN name_score >= 75 THEN 'POSSIBLE_MATCH' ELSE 'MISMATCH' END AS name_status FROM t),
 o AS (SELECT *, CASE WHEN coalesce(found_name, '') = '' AND coalesce(found_dob, '') = '' AND coalesce(found_id, '') = '' AND ocr_confidence = 0 THEN 'OCR_FAILED' WHEN 'MISMATCH' IN (name_status, dob_status, id_status) THEN 'MISMATCH' WHEN 'POSSIBLE_MATCH' IN (name_status, dob_status, id_status) THEN 'POSSIBLE_MISMATCH' ELSE 'VERIFIED' END AS overall_status FROM v)"""


def compared(s: SparkSession, d: str) -> DataFrame:
    """Without a fuzzy library names match when their normal forms are equal."""
    same = F.when(nm.normal_name(F.col("stored_name")) == nm.normal_name(F.col("found_name")), 100.0).otherwise(0.0)
    return rules.compare_fields(field_pairs(s, d), same)


query("r1_validation", w(f"WITH {_PAIRS} SELECT id, name_score, name_status, dob_status, id_status, overall_status FROM o", "reviews", "users"))(lambda s, d: compared(s, d).select("id", "name_score", "name_status", "dob_status", "id_status", "overall_status"))
query("r1_validation_fuzzy")(lambda s, d: rules.compare_fields(field_pairs(s, d)).select("id", "name_score", "name_status", "dob_status", "id_status", "overall_status"))
query("j9_fuzzy_validation")(lambda s, d: rules.compare_fields(field_pairs(s, d)).select("id", "name_score", "name_status", "overall_status"))
_STEPS = (("ocr_confidence < 0.40", "j", "ocr_below_minimum"), ("mi >= 2", "j", "fields_missing"), ("mi = 1", "w", "field_missing"), ("overall_status = 'OCR_FAILED'", "j", "ocr_failed"), ("id_status = 'MISMATCH'", "j", "id_mismatch"), ("id_status = 'MATCH'", "p", "id_match"),
  ("name_status = 'MISMATCH'", "j", "name_mismatch"), ("name_status = 'POSSIBLE_MATCH'", "w", "name_variation"), ("name_status = 'MATCH' AND name_score < 95", "w", "name_below_approval"), ("name_status = 'MATCH' AND name_score >= 95", "p", "name_match"),
  ("dob_status = 'MISMATCH'", "j", "dob_mismatch"), ("dob_status = 'POSSIBLE_MATCH'", "w", "dob_year_only"), ("dob_status = 'MATCH'", "p", "dob_match"), ("ocr_confidence >= 0.40 AND ocr_confidence < 0.85", "w", "ocr_acceptable"), ("ocr_confidence >= 0.85", "p", "ocr_high"))


def _codes(kind: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, k, n in _STEPS if k == kind) + "], lambda x: x IS NOT NULL)"


# Priority steps: a rejection by readability, missing fields, failure or number sets 1; the rest keep the larger number.
_P = ("CASE WHEN ocr_confidence < 0.40 THEN 1 ELSE 3 END", "CASE WHEN mi >= 2 THEN 1 WHEN mi = 1 THEN greatest(p0, 2) ELSE p0 END", "CASE WHEN overall_status = 'OCR_FAILED' OR id_status = 'MISMATCH' THEN 1 ELSE p1 END", "CASE WHEN name_status = 'POSSIBLE_MATCH' OR (name_status = 'MATCH' AND name_score < 95) THEN greatest(p2, 2) ELSE p2 END", "CASE WHEN dob_status = 'POSSIBLE_MATCH' THEN greatest(p3, 2) ELSE p3 END", "CASE WHEN ocr_confidence >= 0.40 AND ocr_confidence < 0.85 THEN greatest(p4, 2) ELSE p4 END")
_EVAL = f"""{_PAIRS}, e0 AS (SELECT *, (coalesce(found_name, '') = '')::INT + (coalesce(found_dob, '') = '')::INT + (doc_type IN ('aadhaar', 'pan') AND coalesce(found_id, '') = '')::INT AS mi FROM o),
  e1 AS (SELECT *, {_P[0]} AS p0 FROM e0), e2 AS (SELECT *, {_P[1]} AS p1 FROM e1), e3 AS (SELECT *, {_P[2]} AS p2 FROM e2), e4 AS (SELECT *, {_P[3]} AS p3 FROM e3), e5 AS (SELECT *, {_P[4]} AS p4 FROM e4), e6 AS (SELECT *, {_P[5]} AS p5, {_codes('p')} AS ok, {_codes('w')} AS rv, {_codes('j')} AS rj FROM e5)
  SELECT id, CASE WHEN len(rj) > 0 THEN 'AUTO_REJECTED' WHEN len(rv) > 0 THEN 'REVIEW_REQUIRED' ELSE 'AUTO_APPROVED' END AS decision, CASE WHEN len(rj) = 0 AND len(rv) = 0 THEN 3 ELSE p5 END AS priority, array_to_string(ok || rv || rj, ',') AS reasons FROM e6"""
query("r2_approval", w(f"WITH {_EVAL}", "reviews", "users"))(lambda s, d: rules.evaluate(compared(s, d)).select("id", "decision", "priority", F.concat_ws(",", "reasons").alias("reasons")))
query("r2_approval_fuzzy")(lambda s, d: rules.evaluate(rules.compare_fields(field_pairs(s, d))).select("id", "decision", "priority", F.concat_ws(",", "reasons").alias("reasons")))
_PI = ("CASE WHEN ocr_confidence < 0.40 THEN 1 ELSE 3 END", "CASE WHEN mi >= 2 THEN 1 WHEN mi = 1 THEN least(p0, 2) ELSE p0 END", "CASE WHEN overall_status = 'OCR_FAILED' OR id_status = 'MISMATCH' THEN 1 ELSE p1 END", "CASE WHEN name_status = 'MISMATCH' THEN 1 WHEN name_status = 'POSSIBLE_MATCH' OR (name_status = 'MATCH' AND name_score < 95) THEN least(p2, 2) ELSE p2 END", "CASE WHEN dob_status = 'MISMATCH' THEN 1 WHEN dob_status = 'POSSIBLE_MATCH' THEN least(p3, 2) ELSE p3 END", "CASE WHEN ocr_confidence >= 0.40 AND ocr_confidence < 0.85 THEN least(p4, 2) ELSE p4 END")
_EVAL_I = _EVAL
for _old, _new in zip(_P, _PI, strict=True):
    _EVAL_I = _EVAL_I.replace(_old + " AS p", _new + " AS p")
query("r2_approval_intended", w(f"WITH {_EVAL_I}", "reviews", "users"))(lambda s, d: rules.evaluate(compared(s, d), intended=True).select("id", "decision", "priority", F.concat_ws(",", "reasons").alias("reasons")))


@query("r3_comparison", w(f"""WITH {_PAIRS}, z AS (SELECT id, 'name' AS field, CASE WHEN name_status = 'MATCH' THEN 'exact_match' WHEN found_name IS NULL THEN 'missing_value' WHEN name_score >= 50 THEN 'significant_name_difference' ELSE 'completely_different_name' END AS difference FROM o
  UNION ALL SELECT id, 'dob', CASE WHEN dob_status = 'MATCH' THEN 'exact_match' WHEN found_dob IS NULL THEN 'missing_value' WHEN dob_status = 'POSSIBLE_MATCH' THEN 'spelling_variation' ELSE 'date_mismatch' END FROM o
  UNION ALL SELECT id, 'id', CASE WHEN id_status = 'MATCH' THEN 'exact_match' WHEN found_id IS NULL THEN 'missing_value' ELSE 'id_number_mismatch' END FROM o)
  SELECT id, field, difference, CASE WHEN difference = 'exact_match' THEN 'no_action' WHEN difference = 'missing_value' THEN 're_upload_document' WHEN difference IN ('id_number_mismatch', 'completely_different_name', 'date_mismatch') THEN 'reject_document' ELSE 'manual_review' END AS action FROM z""", "reviews", "users"))
def comparison(s: SparkSession, d: str) -> DataFrame:
    return _differences(compared(s, d))


query("r3_comparison_fuzzy")(lambda s, d: _differences(rules.compare_fields(field_pairs(s, d))))


def _differences(x: DataFrame) -> DataFrame:
    one = [F.struct(F.lit(f).alias("field"), (diff := rules.difference_type(f, F.col(f"stored_{f}"), F.col(f"found_{f}"), F.col(f"{f}_status"), F.col(f"{f}_score"))).alias("difference"), rules.recommended_action(F.col(f"{f}_status"), diff).alias("action")) for f in ("name", "dob", "id")]
    return x.select("id", F.inline(F.array(*one)))


_RUNS = "translate(regexp_replace(upper(split_part(full_name, ' ', 1))[2:], '[^BCDFGJKLMNPQRSTVXYZ]', '', 'g'), 'BFPVCGJKQSXYZDTLMNR', '1111222222222334556')"
for _c in "123456":
    _RUNS = f"regexp_replace({_RUNS}, '{_c}+', '{_c}', 'g')"
query("x4_sound_codes", w(f"SELECT id, rpad(upper(full_name[1:1]) || ({_RUNS})[1:3], 4, '0') AS code FROM users", "users"))(lambda s, d: lt.users(s, d).select("id", nm.sound(F.element_at(F.split("full_name", " "), 1)).alias("code")))
query("x1_normal_names", w("SELECT id, trim(regexp_replace(regexp_replace(lower(full_name), '[^a-z\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS name FROM users", "users"))(lambda s, d: lt.users(s, d).select("id", nm.normal_name(F.col("full_name")).alias("name")))
query("x2_normal_ids", w("SELECT id, upper(regexp_replace(aadhaar_number, '[\\s-]', '', 'g')) AS number FROM identities", "identities"))(lambda s, d: lt.identities(s, d).select("id", nm.normal_id(F.col("aadhaar_number")).alias("number")))
query("u4_word_difference", w("SELECT u.id, array_to_string(list_sort(list_distinct(list_concat(list_filter(a, lambda x: NOT list_contains(b, x)), list_filter(b, lambda x: NOT list_contains(a, x))))), ',') AS words FROM (SELECT id, string_split(lower(full_name), ' ') AS a, string_split('asha name' || (id % 25), ' ') AS b FROM users) u", "users"))(
    lambda s, d: lt.users(s, d).select("id", F.array_join(nm.word_difference(F.lower("full_name"), F.concat(F.lit("asha name"), (F.col("id") % 25).cast("string"))), ",").alias("words")))

# Anomalies, insights, dashboard
_SER = (("fraud_spike", mq.daily("fraud", "analyzed_at", O_AT, 14, *mq._N, where="risk_level IN ('HIGH_RISK', 'CRITICAL_RISK')"), 1.5, 2.5), ("ocr_failure_spike", mq.daily("verified", "verified_at", E_AT, 14, *mq._N, where="status = 'OCR_FAILED'"), 1.5, 3.0), ("upload_flood", mq.daily("uploads", "uploaded_at", E_AT, 14, *mq._N), 2.0, 1e9), ("duplicate_surge", mq.daily("fraud", "analyzed_at", O_AT, 14, *mq._N, where="duplicate_detected"), 2.0, 3.0))


def _anomaly_sql(k: int, kind: str, series: str, factor: float, critical: float) -> str:
    fresh = kind == "ocr_failure_spike"
    new = "a = 0 AND t >= 5" if fresh else "false"
    return f"""SELECT CASE WHEN {new} THEN 'ocr_failure_new' ELSE '{kind}' END AS anomaly_type, t AS today_value, CASE WHEN {new} THEN 0.0 ELSE round(a, 2) END AS rolling_avg, CASE WHEN {new} THEN 0.0 ELSE round(a * {factor}::DOUBLE, 2) END AS threshold,
  CASE WHEN {new} THEN 'WARNING' WHEN t > a * {critical} THEN 'CRITICAL' ELSE 'WARNING' END AS severity, {k} AS position FROM (SELECT arg_max(count, date)::DOUBLE AS t, arg_max(r, date) AS a FROM (SELECT *, coalesce(avg(count) OVER (ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0.0) AS r FROM ({series}))) WHERE (a > 0 AND t > a * {factor}) OR {new}"""


_BACKLOG = w("SELECT count(*)::DOUBLE AS total, (count(*) FILTER (priority = 1))::DOUBLE AS first FROM reviews WHERE status IN ('pending', 'in_review')", "reviews")
_ANOM = " UNION ALL ".join([f"SELECT * FROM ({_anomaly_sql(k, *x)})" for k, x in enumerate(_SER)] + [f"SELECT CASE WHEN total > 500 THEN 'queue_critical_overload' ELSE 'queue_overload' END, total, 0.0, CASE WHEN total > 500 THEN 500.0 ELSE 200.0 END, CASE WHEN total > 500 THEN 'CRITICAL' ELSE 'WARNING' END, 4 FROM ({_BACKLOG}) WHERE total > 200", f"SELECT 'high_priority_backlog', first, 0.0, 50.0, 'WARNING', 5 FROM ({_BACKLOG}) WHERE first > 50"])


def found_anomalies(s: SparkSession, d: str) -> DataFrame:
    return rules.anomalies(lt.fraud(s, d), lt.verified(s, d), lt.uploads(s, d), lt.reviews(s, d), O_AT, E_AT)


query("r6_anomalies", _ANOM)(found_anomalies)
query("r6_system_alert", f"""SELECT count(*) AS total, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'WARNING') AS warnings, CASE WHEN count(*) FILTER (severity = 'CRITICAL') > 0 THEN 'CRITICAL' WHEN count(*) FILTER (severity = 'WARNING') > 0 THEN 'WARNING' ELSE 'HEALTHY' END AS system_alert FROM ({_ANOM})""")(lambda s, d: rules.system_alert(found_anomalies(s, d)))
query("o4_anomalies_by_severity", f"SELECT * FROM ({_ANOM}) ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'WARNING' THEN 1 ELSE 2 END, position")(lambda s, d: found_anomalies(s, d).orderBy(rules.severity_rank(), "position"))
query("r9_alerts", f"SELECT anomaly_type AS alert_type, severity, CASE anomaly_type WHEN 'queue_critical_overload' THEN 'Queue Critical Overload' WHEN 'queue_overload' THEN 'Queue Overload' WHEN 'high_priority_backlog' THEN 'High Priority Backlog' WHEN 'fraud_spike' THEN 'Fraud Spike' WHEN 'ocr_failure_spike' THEN 'Ocr Failure Spike' WHEN 'ocr_failure_new' THEN 'Ocr Failure New' WHEN 'upload_flood' THEN 'Upload Flood' ELSE 'Duplicate Surge' END AS title, anomaly_type AS metric_name, today_value AS metric_value, threshold, false AS resolved FROM ({_ANOM})")(lambda s, d: rules.alerts(found_anomalies(s, d)))


def figures(s: SparkSession, d: str) -> DataFrame:
    return rules.measures(lt.fraud(s, d), lt.verified(s, d), lt.extracted(s, d), lt.reviews(s, d), lt.corrections(s, d), O_AT)


_FIG = f"""WITH a AS (SELECT failure_rate, total AS ocr_total, success_rate FROM ({{ocr}})), b AS ({{conf}}), c AS ({{summary}}), e AS ({{dup}}), f AS ({{qual}}), g AS ({_BACKLOG}), h AS ({{board}}), i AS ({{fixes}})
  SELECT * FROM a, b, c, e, f, (SELECT total AS total_pending, first AS high_priority FROM g) g2, h, i"""


def _figures_sql() -> str:
    from dossierlake.plans._registry import SQL

    return _FIG.format(
        ocr=SQL["a21_ocr_success_rate"],
        conf=w("SELECT coalesce(round(avg(confidence_score), 4), 0.0) AS avg_confidence, count(*) FILTER (coalesce(confidence_score, 0) <= 0.40) AS low_band, count(*) FILTER (doc_type = 'unknown') AS unknown_types, count(*) AS extracted_total FROM extracted", "extracted"),
        summary=f"SELECT fraud_rate, duplicate_rate, critical_count, screenshot_count, high_risk_count, total AS fraud_total FROM ({SQL['a6_fraud_summary']})",
        dup=f"SELECT recent AS dup_recent, earlier AS dup_earlier FROM ({SQL['w4_recent_duplicates']})",
        qual=f"SELECT recent AS quality_recent, earlier AS quality_earlier FROM ({SQL['w5_recent_quality']})",
        board=w("SELECT count(DISTINCT reviewer_id) AS reviewers FROM reviews", "reviews"),
        fixes="SELECT count(*) AS corrections FROM lineitem",
    )


def _insight_sql() -> str:
    parts = [f"SELECT {k} AS position, '{n}' AS insight, '{sev}' AS severity, ({fig})::DOUBLE AS metric FROM fig WHERE {cond}" for k, (n, cond, sev, fig) in enumerate(rules.INSIGHTS)]
    return f"WITH fig AS ({_figures_sql()}) " + " UNION ALL ".join(parts)


query("r7_insights", _insight_sql())(lambda s, d: rules.insights(figures(s, d)))
query("r9_queue_health", w("SELECT CASE WHEN total_pending > 500 THEN 'critical' WHEN total_pending > 200 THEN 'degraded' ELSE 'healthy' END AS status, * FROM (SELECT count(*) AS total_pending, count(*) FILTER (priority = 1) AS high_priority, count(*) FILTER (priority = 2) AS medium_priority, count(*) FILTER (priority = 3) AS low_priority, count(*) FILTER (status = 'in_review') AS being_reviewed, count(*) FILTER (status <> 'in_review') AS awaiting_review, count(*) > 200 OR count(*) FILTER (priority = 1) > 50 AS overloaded FROM reviews WHERE status IN ('pending', 'in_review'))", "reviews"))(lambda s, d: rules.queue_health(lt.reviews(s, d)))
query("r8_dashboard", f"""WITH f AS ({_figures_sql()}), n AS ({_insight_sql()}), al AS ({_ANOM}) SELECT CASE WHEN (SELECT count(*) FROM al WHERE severity = 'CRITICAL') > 0 THEN 'CRITICAL' WHEN (SELECT count(*) FROM al WHERE severity = 'WARNING') > 0 THEN 'WARNING' ELSE 'HEALTHY' END AS system_health, success_rate AS ocr_success_rate, avg_confidence, fraud_rate, duplicate_rate,
  total_pending::BIGINT AS review_queue_size, high_risk_count AS high_risk_cases, (SELECT arg_min(insight, (CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'WARNING' THEN 1 ELSE 2 END, position)) FROM n) AS top_insight, (SELECT count(*) FROM n) AS insights,
  (SELECT count(*) FROM orders WHERE o_orderkey % 5 = 0) AS auto_approved, (SELECT count(*) FROM orders WHERE o_orderkey % 5 = 1) AS auto_rejected, (SELECT count(*) FROM customer) AS total_users, (SELECT count(*) FROM events) AS total_documents FROM f""")(
    lambda s, d: rules.dashboard(figures(s, d), found_anomalies(s, d), lt.users(s, d), lt.uploads(s, d), lt.reviews(s, d)))


# Search
def marks(s: SparkSession, d: str) -> DataFrame:
    k = F.col(_K)
    return lt.table(s, d, "orders").select(F.col("o_custkey").alias("user_id"), F.when(k % 3 == 0, "aadhaar").when(k % 3 == 1, "pan").otherwise("academic").alias("doc_type"), F.when(k % 3 == 2, F.when(k % 2 == 0, (k % 65 + 35).cast("string")).otherwise((k % 50 / F.lit(10.0) + 5).cast("string"))).alias("mark"))


def profiles(s: SparkSession, d: str) -> DataFrame:
    from dossierlake.operators.records import latest_reviews

    u, best = lt.users(s, d), search.academic_best(marks(s, d))
    r = latest_reviews(lt.reviews(s, d)).select("user_id", F.col("status").alias("review_status"), F.col("ocr_confidence").alias("confidence"))
    return u.join(best, u["id"] == best["user_id"], "left").drop("user_id").join(r, F.col("id") == r["user_id"], "left").drop("user_id")


_MARKS = "SELECT o_custkey AS user_id, CASE o_orderkey % 3 WHEN 0 THEN 'aadhaar' WHEN 1 THEN 'pan' ELSE 'academic' END AS doc_type, CASE WHEN o_orderkey % 3 = 2 THEN CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 65 + 35)::DOUBLE ELSE (o_orderkey % 50) / 10.0::DOUBLE + 5 END END AS mark FROM orders"
_BEST = f"SELECT user_id, max(mark) FILTER (mark > 10) AS best_pct, max(mark) FILTER (mark <= 10) AS best_cgpa, list_sort(list_distinct(list(doc_type))) AS doc_types FROM ({_MARKS}) GROUP BY 1"
_PROF = f"""WITH b AS ({_BEST}), r AS ({mq._LAST_R}), pr AS (SELECT u.id, full_name, dob, best_pct, best_cgpa, doc_types, r.status AS review_status, r.ocr_confidence AS confidence FROM users u LEFT JOIN b ON b.user_id = u.id LEFT JOIN r ON r.user_id = u.id)"""
query("a34_academic_best", f"SELECT user_id, best_pct, best_cgpa, array_to_string(doc_types, ',') AS doc_types FROM ({_BEST})")(lambda s, d: search.academic_best(marks(s, d)).withColumn("doc_types", F.concat_ws(",", "doc_types")))
_AGE = f"(year(TIMESTAMP '{O_AT}') - right(dob, 4)::INT - (CASE WHEN (7, 30) < (dob[4:5]::INT, dob[1:2]::INT) THEN 1 ELSE 0 END))"
# The whole ladder, over profiles with the kinds of academic documents and the names on two documents
def ladder_profiles(s: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    parts = [F.when(k % n < r, F.lit(t)) for t, n, r in (("aadhaar", 4, 3), ("pan", 5, 3), ("tenth", 2, 1), ("twelfth", 3, 1), ("degree", 7, 2), ("diploma", 11, 1))]
    names = F.when(k % 3 > 0, F.upper("full_name")), F.when(k % 4 > 0, F.when(k % 5 == 0, F.concat("full_name", F.lit("x"))).otherwise(F.col("full_name")))
    return profiles(s, d).withColumn("doc_types", F.array_compact(F.array(*parts))).withColumns(dict(zip(("aadhaar_name", "pan_name"), names, strict=True)))


_LADDER = f"""{_PROF}, lp AS (SELECT id, full_name, dob, best_pct, best_cgpa, id % 4 < 3 AS aadhaar, id % 5 < 3 AS pan, id % 2 < 1 AS t, id % 3 < 1 AS h, id % 7 < 2 OR id % 11 < 1 AS g,
  CASE WHEN id % 3 > 0 THEN lower(full_name) END AS an, CASE WHEN id % 4 > 0 THEN lower(CASE WHEN id % 5 = 0 THEN full_name || 'x' ELSE full_name END) END AS pn FROM pr)"""
for _name, _text, _where in (
    ("aadhaar", "no adhar", "NOT aadhaar"),
    ("pan", "missing PAN", "NOT pan"),
    ("mismatch", "name mismatch", "an <> pn"),
    ("older", "age > 40", f"{_AGE} > 40"),
    ("younger", "age < 40", f"{_AGE} < 40"),
    ("75", "above 75", "best_pct >= 75"),
    ("80", "above 80", "best_pct >= 80"),
    ("first", "first class", "best_pct >= 60 AND best_pct < 75"),
    ("60", "low marks", "best_pct < 60"),
    ("40", "failed", "best_pct < 40"),
    ("toppers", "toppers", "coalesce(best_pct, 0) <> 0 OR coalesce(best_cgpa, 0) <> 0"),
    ("cgpa_8", "cgpa above 8", "best_cgpa >= 8"),
    ("cgpa_7", "cgpa above 7", "best_cgpa >= 7"),
    ("cgpa_6", "low cgpa", "best_cgpa < 6"),
    ("cgpa_best", "highest cgpa", "best_cgpa <> 0"),
    ("no_academic", "no marksheet", "NOT (t OR h OR g)"),
    ("some_academic", "with academic", "t OR h OR g"),
    ("all_academic", "all academic", "t AND h AND g"),
    ("only_tenth", "only 10th", "t AND NOT h AND NOT g"),
    ("only_twelfth", "only 12th", "h AND NOT t AND NOT g"),
    ("degree", "bachelor", "g"),
    ("tenth", "ssc", "t"),
    ("twelfth", "hsc", "h"),
    ("name", "name7", "contains(lower(full_name), 'name7') OR contains(id::VARCHAR, 'name7')"),
):
    query(f"f13_ladder_{_name}", w(f"{_LADDER} SELECT id, full_name, best_pct, best_cgpa FROM lp WHERE {_where}", "users", "reviews"))(lambda s, d, t=_text: search.ladder(ladder_profiles(s, d), t, O_AT).select("id", "full_name", "best_pct", "best_cgpa"))
query("o7_toppers", w(f"{_LADDER} SELECT id, full_name, best_pct, best_cgpa FROM lp WHERE coalesce(best_pct, 0) <> 0 OR coalesce(best_cgpa, 0) <> 0 ORDER BY coalesce(best_pct, 0) + 10 * coalesce(best_cgpa, 0) DESC, id", "users", "reviews"))(lambda s, d: search.ladder(ladder_profiles(s, d), "toppers", O_AT).select("id", "full_name", "best_pct", "best_cgpa"))
query("f14_ages", w(f"SELECT id, {_AGE}::INT AS age FROM users", "users"))(lambda s, d: lt.users(s, d).select("id", search.age(F.col("dob"), O_AT).alias("age")))


# Votes and evaluation
def readings(s: SparkSession, d: str) -> DataFrame:
    """Readings of a field by document: document, engine position, value and confidence."""
    x = lt.table(s, d, "lineitem")
    return x.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("position"), F.col("l_returnflag").alias("value"), F.col("l_discount").alias("confidence"), F.concat(F.lit("f"), (F.col("l_suppkey") % 3).cast("string")).alias("field"), (F.col("l_linenumber") % 4).alias("page"), (F.col("l_linestatus") == "O").alias("role_page"))


_READ = "SELECT l_orderkey AS doc_id, l_linenumber AS position, l_returnflag AS value, l_discount AS confidence, 'f' || (l_suppkey % 3) AS field, l_linenumber % 4 AS page, l_linestatus = 'O' AS role_page FROM lineitem"
query("a37_majority_vote", f"SELECT doc_id, value, votes FROM (SELECT doc_id, value, count(*) AS votes, min(position) AS f FROM ({_READ}) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY votes DESC, f, value) = 1")(lambda s, d: vt.majority(readings(s, d), ["doc_id"], "value", "position"))
query("a38_weighted_vote", f"SELECT doc_id, value, round(wt, 4) AS weight FROM (SELECT doc_id, value, sum(confidence + 0.1::DOUBLE) AS wt FROM ({_READ}) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(wt, 6) DESC, value) = 1")(lambda s, d: vt.weighted(readings(s, d), ["doc_id"], "value", "confidence", 0.1))
query("a39_best_across_pages", f"SELECT doc_id, field, value, round(sc, 4) AS score FROM (SELECT doc_id, field, value, max(confidence) + 0.1::DOUBLE * (count(DISTINCT page) - 1) + CASE WHEN bool_or(role_page) THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END AS sc FROM ({_READ}) GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY round(sc, 6) DESC, value) = 1")(lambda s, d: vt.best_across_pages(readings(s, d)))
query("a40_ordered_values", f"SELECT doc_id, string_agg(value, ',' ORDER BY page, value) AS vals FROM ({_READ}) GROUP BY 1")(lambda s, d: vt.ordered_values(readings(s, d)).select("doc_id", F.concat_ws(",", "values").alias("vals")))
query("a36_weighted_cgpa", "SELECT o_custkey AS student, round(CASE WHEN sum(o_orderkey % 5) > 0 THEN sum((o_orderkey % 100) / 10.0::DOUBLE * (o_orderkey % 5)) / sum(o_orderkey % 5) ELSE avg((o_orderkey % 100) / 10.0::DOUBLE) END, 2) AS cgpa FROM orders WHERE o_orderkey % 100 <> 0 GROUP BY 1")(
    lambda s, d: vt.weighted_cgpa(lt.table(s, d, "orders").select(F.col("o_custkey").alias("student"), (F.col(_K) % 100 / F.lit(10.0)).alias("sgpa"), (F.col(_K) % 5).alias("credits"))))


def trials(s: SparkSession, d: str) -> DataFrame:
    k = F.col(_K)
    field = F.when(k % 5 == 0, "percentage").when(k % 5 == 1, "name").when(k % 5 == 2, "cgpa").when(k % 5 == 3, "result").otherwise("grade")
    return lt.table(s, d, "orders").select(k.alias("id"), F.col("o_orderpriority").alias("transform"), field.alias("field"), F.concat(F.lit("m"), (k % 7).cast("string")).alias("mode"), (k % 11 < 8).alias("correct"), (k % 4).alias("retries"), (k % 4 == 3).cast("int").alias("recoveries"), (k % 101 / F.lit(100.0)).alias("severity"))


_TRIALS = "SELECT o_orderkey AS id, o_orderpriority AS transform, CASE o_orderkey % 5 WHEN 0 THEN 'percentage' WHEN 1 THEN 'name' WHEN 2 THEN 'cgpa' WHEN 3 THEN 'result' ELSE 'grade' END AS field, 'm' || (o_orderkey % 7) AS mode, o_orderkey % 11 < 8 AS correct, o_orderkey % 4 AS retries, (o_orderkey % 4 = 3)::INT AS recoveries, (o_orderkey % 101) / 100.0::DOUBLE AS severity FROM orders"
query("a41_field_accuracy", f"SELECT field, transform, round(avg(correct::INT), 4) AS accuracy, count(*) AS n FROM ({_TRIALS}) GROUP BY 1, 2")(lambda s, d: vt.accuracy(trials(s, d), "field", "transform"))
query("a41_worst_transforms", f"SELECT transform, round(avg(correct::INT), 4) AS accuracy, count(*) AS n FROM ({_TRIALS}) GROUP BY 1 ORDER BY 2, 1 LIMIT 3")(lambda s, d: vt.worst(trials(s, d), "transform"))
query("a42_robustness", f"""SELECT score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 55 THEN 'C' ELSE 'D' END AS grade FROM (SELECT round(greatest(0.0, least(100.0, ({' + '.join(f"coalesce(avg(correct::INT) FILTER (field = '{f}'), 0.0) * {x}::DOUBLE" for f, x in vt.ROBUSTNESS.items())}) * 100
  - greatest(0.0, least(10.0, 3 * (avg(retries) - 2))) + 5 * coalesce(sum(recoveries) / nullif(sum(retries), 0)::DOUBLE, 0.0))), 2) AS score FROM ({_TRIALS}))""")(lambda s, d: vt.robustness(trials(s, d)))
query("a43_severity_curve", f"SELECT round(round(severity / 0.1::DOUBLE) * 0.1::DOUBLE, 1) AS step, round(avg(correct::INT), 4) AS accuracy FROM ({_TRIALS}) GROUP BY 1")(lambda s, d: vt.severity_curve(trials(s, d)))
query("a44_failure_clusters", f"SELECT transform, field, mode, count(*) AS n, array_to_string(list_sort(list(id))[1:3], ',') AS samples FROM ({_TRIALS}) WHERE NOT correct GROUP BY 1, 2, 3 HAVING count(*) >= 2")(lambda s, d: vt.failure_clusters(trials(s, d).where("NOT correct")))
query("a48_recovery_rate", f"SELECT round(sum(recoveries) / sum(retries)::DOUBLE, 4) AS recovery_rate, round(avg(retries), 4) AS avg_retries FROM ({_TRIALS})")(lambda s, d: trials(s, d).agg(F.round(F.try_divide(F.sum("recoveries"), F.sum("retries")), 4).alias("recovery_rate"), F.round(F.avg("retries"), 4).alias("avg_retries")))
query("a46_dataset_outcomes", """SELECT CASE WHEN e IS NULL AND f IS NOT NULL THEN 'hallucinated' WHEN e IS NOT NULL AND f IS NULL THEN 'missed' WHEN coalesce(abs(e - f) <= 0.5, e IS NULL AND f IS NULL) THEN 'correct' ELSE 'wrong' END AS outcome, count(*) AS n FROM (SELECT CASE WHEN quality = 1 THEN doc_id % 10 END AS e, CASE WHEN doc_id % 6 > 0 THEN doc_id % 10 + (doc_id % 4 = 0)::INT END AS f FROM labels) GROUP BY 1""")(
    lambda s, d: lt.table(s, d, "labels").select(F.when(F.col("quality") == 1, F.col("doc_id") % 10).alias("e"), F.when(F.col("doc_id") % 6 > 0, F.col("doc_id") % 10 + (F.col("doc_id") % 4 == 0).cast("int")).alias("f")).groupBy(vt.outcome(F.col("e"), F.col("f"), vt.close(F.col("e"), F.col("f"), 0.5)).alias("outcome")).agg(F.count(F.lit(1)).alias("n")))
query("w14_forward_fill", "SELECT o_orderkey, o_custkey, last_value(CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS filled FROM orders")(
    lambda s, d: vt.forward_fill(lt.table(s, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col(_K) % 4 == 0, F.col("o_orderpriority")).alias("v")), "o_custkey", "o_orderkey", "v").select("o_orderkey", "o_custkey", "filled"))
query("a49_medians", "SELECT l_returnflag, median(l_quantity) AS median_quantity FROM lineitem GROUP BY 1")(lambda s, d: lt.table(s, d, "lineitem").groupBy("l_returnflag").agg(F.median("l_quantity").alias("median_quantity")))
