"""The logical tables of document verification, derived from the driver's tables.

Each function takes (spark, sf_dir) and returns a DataFrame with the logical columns only, so column pruning and
filters reach the scan. ``ORACLE`` holds the same derivations for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Instants as of which the queries are asked: within the last day of events and of orders.
EVENTS_AS_OF, ORDERS_AS_OF = "2024-01-30 12:00:00", "2001-07-30 12:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(key: Column, *choices: tuple[int, int, str], default: str) -> Column:
    """The value of the first (modulus, remainder, value) that holds."""
    out = None
    for modulus, remainder, value in choices:
        hit = key % modulus == remainder
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(default)


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: id, user_id, doc_type, uploaded_at."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("doc_type"), F.col("ts").alias("uploaded_at"))


def verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """verified_data: id, user_id, doc_type, status, verified_at."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "VERIFIED").when(kind == "signup", "APPROVED").when(kind == "error", "OCR_FAILED").when(kind == "click", "MISMATCH").when(F.col("event_id") % 7 == 0, "DOC_TYPE_UNKNOWN").otherwise("POSSIBLE_MISMATCH")
    return e.select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("doc_type"), status.alias("status"), F.col("ts").alias("verified_at"))


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """extracted_data: id, user_id, doc_type, confidence_score (with nulls), processed_at."""
    e = table(spark, sf_dir, "events")
    score = F.when(F.col("event_id") % 17 != 0, (F.col("event_id") * 31 % 101) / F.lit(100.0))
    return e.select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("doc_type"), score.alias("confidence_score"), F.col("ts").alias("processed_at"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """validation_reviews: id, user_id, doc_type, status, decision, priority, reviewer_id, created_at, reviewed_at, ocr_confidence."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "in_review").otherwise(_pick(k, (7, 0, "corrected"), (5, 1, "rejected"), (13, 2, "reprocess_requested"), default="approved"))
    waiting = F.col("o_orderstatus").isin("O", "P")
    return o.select(
        k.alias("id"),
        F.col("o_custkey").alias("user_id"),
        _pick(k, (3, 0, "aadhaar"), (3, 1, "pan"), default="academic").alias("doc_type"),
        status.alias("status"),
        _pick(k, (5, 0, "AUTO_APPROVED"), (5, 1, "AUTO_REJECTED"), default="REVIEW_REQUIRED").alias("decision"),
        F.least(F.lit(3), F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"),
        F.when(~waiting, F.concat(F.lit("rev"), (F.col("o_custkey") % 40).cast("string"))).alias("reviewer_id"),
        F.col("o_orderdate").alias("created_at"),
        F.when(~waiting, F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("reviewed_at"),
        (k % 100 / F.lit(100.0)).alias("ocr_confidence"),
    )


def fraud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fraud_analysis: id, user_id, risk_score, risk_level, duplicate_detected, is_screenshot, tamper_score, quality_score, analyzed_at."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    risk = (k * 37 % 101).cast("int")
    level = F.when(risk <= 24, "LOW_RISK").when(risk <= 49, "MEDIUM_RISK").when(risk <= 74, "HIGH_RISK").otherwise("CRITICAL_RISK")
    return o.select(k.alias("id"), F.col("o_custkey").alias("user_id"), risk.alias("risk_score"), level.alias("risk_level"), (k % 9 == 0).alias("duplicate_detected"), (k % 6 == 0).alias("is_screenshot"), (k * 13 % 60).cast("int").alias("tamper_score"), (k * 29 % 101).cast("int").alias("quality_score"), F.col("o_orderdate").alias("analyzed_at"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """users: id, full_name, dob (DD/MM/YYYY), nation, created_at."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    name = F.concat(F.when(k % 3 == 0, "Asha ").when(k % 3 == 1, "ASHA ").otherwise("Ravi "), F.concat(F.lit("Name"), (k % 50).cast("string")))
    dob = F.concat_ws("/", F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lpad((k % 12 + 1).cast("string"), 2, "0"), (F.lit(1950) + k % 60).cast("string"))
    born = F.lit(ORDERS_AS_OF).cast("timestamp_ntz") - F.make_dt_interval(days=(k % 90).cast("int"))
    return c.select(k.alias("id"), name.alias("full_name"), dob.alias("dob"), F.col("c_nationkey").alias("nation"), born.alias("created_at"))


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """correction_logs: review_id, field, correction_type, corrected_by, created_at."""
    x = table(spark, sf_dir, "lineitem")
    field = F.when(F.col("l_returnflag") == "R", "name").when(F.col("l_returnflag") == "A", "dob").otherwise("aadhaar_number")
    return x.select(F.col("l_orderkey").alias("review_id"), field.alias("field"), F.when(F.col("l_linestatus") == "O", "manual").otherwise("ocr_fix").alias("correction_type"), F.concat(F.lit("rev"), (F.col("l_suppkey") % 40).cast("string")).alias("corrected_by"), F.col("l_shipdate").alias("created_at"))


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """extracted identity numbers: id, user_id, doc_type, aadhaar_number (some spaced), pan_number (mixed case)."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    digits = F.lpad((k * 7919 % 4001).cast("string"), 12, "2")
    spaced = F.concat_ws(" ", F.substring(digits, 1, 4), F.substring(digits, 5, 4), F.substring(digits, 9, 4))
    pan = F.concat(F.lit("abcde"), F.lpad((k * 104729 % 5003).cast("string"), 4, "0"), F.lit("f"))
    return o.select(k.alias("id"), F.col("o_custkey").alias("user_id"), _pick(k, (3, 0, "aadhaar"), (3, 1, "pan"), default="academic").alias("doc_type"), F.when(k % 2 == 0, spaced).otherwise(digits).alias("aadhaar_number"), F.when(k % 2 == 0, F.upper(pan)).otherwise(pan).alias("pan_number"))


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_hashes: document_id, user_id, phash, ahash, dhash, 16 hex digits each; every ninth phash has 15."""
    d = table(spark, sf_dir, "documents")
    m = F.md5(F.coalesce("text", F.lit("")))
    p = F.substring(m, 1, 16)
    # Two copies differ in the last digit, so that near matches exist.
    p = F.when(F.col("doc_id") % 2 == 0, p).otherwise(F.concat(F.substring(m, 1, 15), F.lit("0")))
    p = F.when(F.col("doc_id") % 9 == 0, F.substring(m, 1, 15)).otherwise(p)
    return d.select(F.col("doc_id").alias("document_id"), (F.col("doc_id") % 500).alias("user_id"), p.alias("phash"), F.substring(m, 9, 16).alias("ahash"), F.substring(m, 17, 16).alias("dhash"))


_E = "event_id AS id, user_id, event_type AS doc_type"
_K3 = "CASE WHEN o_orderkey % 3 = 0 THEN 'aadhaar' WHEN o_orderkey % 3 = 1 THEN 'pan' ELSE 'academic' END"
#: The logical tables as DuckDB selects.
ORACLE = {
    "uploads": f"SELECT {_E}, ts AS uploaded_at FROM events",
    "verified": f"""SELECT {_E}, CASE event_type WHEN 'purchase' THEN 'VERIFIED' WHEN 'signup' THEN 'APPROVED' WHEN 'error' THEN 'OCR_FAILED'
        WHEN 'click' THEN 'MISMATCH' ELSE CASE WHEN event_id % 7 = 0 THEN 'DOC_TYPE_UNKNOWN' ELSE 'POSSIBLE_MISMATCH' END END AS status, ts AS verified_at FROM events""",
    "extracted": f"SELECT {_E}, CASE WHEN event_id % 17 <> 0 THEN (event_id * 31 % 101) / 100.0::DOUBLE END AS confidence_score, ts AS processed_at FROM events",
    "reviews": f"""SELECT o_orderkey AS id, o_custkey AS user_id, {_K3} AS doc_type,
        CASE WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderstatus = 'P' THEN 'in_review' WHEN o_orderkey % 7 = 0 THEN 'corrected'
          WHEN o_orderkey % 5 = 1 THEN 'rejected' WHEN o_orderkey % 13 = 2 THEN 'reprocess_requested' ELSE 'approved' END AS status,
        CASE WHEN o_orderkey % 5 = 0 THEN 'AUTO_APPROVED' WHEN o_orderkey % 5 = 1 THEN 'AUTO_REJECTED' ELSE 'REVIEW_REQUIRED' END AS decision,
        least(3, o_orderpriority[1]::INT) AS priority, CASE WHEN o_orderstatus NOT IN ('O', 'P') THEN 'rev' || (o_custkey % 40) END AS reviewer_id,
        o_orderdate AS created_at, CASE WHEN o_orderstatus NOT IN ('O', 'P') THEN o_orderdate + INTERVAL 1 DAY END AS reviewed_at,
        (o_orderkey % 100) / 100.0::DOUBLE AS ocr_confidence FROM orders""",
    "fraud": """SELECT o_orderkey AS id, o_custkey AS user_id, (o_orderkey * 37 % 101)::INT AS risk_score,
        CASE WHEN o_orderkey * 37 % 101 <= 24 THEN 'LOW_RISK' WHEN o_orderkey * 37 % 101 <= 49 THEN 'MEDIUM_RISK' WHEN o_orderkey * 37 % 101 <= 74 THEN 'HIGH_RISK' ELSE 'CRITICAL_RISK' END AS risk_level,
        o_orderkey % 9 = 0 AS duplicate_detected, o_orderkey % 6 = 0 AS is_screenshot, (o_orderkey * 13 % 60)::INT AS tamper_score,
        (o_orderkey * 29 % 101)::INT AS quality_score, o_orderdate AS analyzed_at FROM orders""",
    "users": f"""SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'Asha ' WHEN 1 THEN 'ASHA ' ELSE 'Ravi ' END || 'Name' || (c_custkey % 50) AS full_name,
        lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0') || '/' || lpad((c_custkey % 12 + 1)::VARCHAR, 2, '0') || '/' || (1950 + c_custkey % 60) AS dob,
        c_nationkey AS nation, TIMESTAMP '{ORDERS_AS_OF}' - to_days((c_custkey % 90)::INT) AS created_at FROM customer""",
    "corrections": """SELECT l_orderkey AS review_id, CASE l_returnflag WHEN 'R' THEN 'name' WHEN 'A' THEN 'dob' ELSE 'aadhaar_number' END AS field,
        CASE l_linestatus WHEN 'O' THEN 'manual' ELSE 'ocr_fix' END AS correction_type, 'rev' || (l_suppkey % 40) AS corrected_by, l_shipdate AS created_at FROM lineitem""",
    "digits": "SELECT *, lpad((o_orderkey * 7919 % 4001)::VARCHAR, 12, '2') AS d FROM orders",
    "identities": f"""SELECT o_orderkey AS id, o_custkey AS user_id, {_K3} AS doc_type,
        CASE WHEN o_orderkey % 2 = 0 THEN d[1:4] || ' ' || d[5:8] || ' ' || d[9:12] ELSE d END AS aadhaar_number,
        CASE WHEN o_orderkey % 2 = 0 THEN upper('abcde' || lpad((o_orderkey * 104729 % 5003)::VARCHAR, 4, '0') || 'f') ELSE 'abcde' || lpad((o_orderkey * 104729 % 5003)::VARCHAR, 4, '0') || 'f' END AS pan_number FROM digits""",
    "hashes": """SELECT doc_id AS document_id, doc_id % 500 AS user_id,
        CASE WHEN doc_id % 9 = 0 THEN m[1:15] WHEN doc_id % 2 = 0 THEN m[1:16] ELSE m[1:15] || '0' END AS phash, m[9:24] AS ahash, m[17:32] AS dhash
        FROM (SELECT doc_id, md5(coalesce(text, '')) AS m FROM documents)""",
}
_NEEDS = {"identities": ["digits"]}


def with_tables(sql: str, *names: str) -> str:
    """``sql`` after the definitions of the logical tables it names."""
    every = [y for x in names for y in [*_NEEDS.get(x, []), x]]
    parts = ", ".join(f"{x} AS ({ORACLE[x]})" for x in dict.fromkeys(every))
    body = sql.strip()
    return f"WITH {parts}, {body[5:]}" if body.startswith("WITH ") else f"WITH {parts} {body}"
