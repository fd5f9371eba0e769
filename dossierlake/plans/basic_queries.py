"""Queries of the plain scans, filters, joins and scores that other queries use inside, and of positioned words."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlake.functions import names as nm
from dossierlake.functions import scores as sc
from dossierlake.functions import text as tx
from dossierlake.operators import layout as ly
from dossierlake.operators import records as rec
from dossierlake.operators import timeseries as ts
from dossierlake.plans import document_queries  # noqa: F401  its SQL is used
from dossierlake.plans import rule_queries as rq
from dossierlake.plans import rules, search
from dossierlake.plans import text_queries as tq
from dossierlake.plans._registry import SQL, query
from dossierlake.plans.record_queries import _key, _pick, _sql_pick
from dossierlake.sources import logical as lt
from dossierlake.sources import sinks
from dossierlake.sources.logical import EVENTS_AS_OF as E_AT
from dossierlake.sources.logical import ORDERS_AS_OF as O_AT
from dossierlake.sources.logical import with_tables as w
from dossierlake.sources.shared import remove, shared_root
from dossierlake.streaming import jobs

# Scans and filters
query("s1_scan", w("SELECT id, user_id, status FROM reviews", "reviews"))(lambda s, d: lt.reviews(s, d).select("id", "user_id", "status"))
query("s2_exact_count", w("SELECT count(*) AS n FROM reviews", "reviews"))(lambda s, d: lt.reviews(s, d).agg(F.count(F.lit(1)).alias("n")))
query("s3_embedded_join", w("SELECT r.id, status, to_json({'full_name': full_name, 'dob': dob})::VARCHAR AS users FROM reviews r JOIN users u ON u.id = r.user_id", "reviews", "users"))(
    lambda s, d: lt.reviews(s, d).join(lt.users(s, d).select(F.col("id").alias("user_id"), F.struct("full_name", "dob").alias("users")), "user_id").select("id", "status", F.to_json("users").alias("users")))
query("s4_single_row", w("SELECT id, status FROM reviews WHERE id = (SELECT min(id) FROM reviews)", "reviews"))(lambda s, d: sinks.single(lt.reviews(s, d).orderBy("id").limit(1).select("id", "status")))
query("f1_equal", w("SELECT id FROM fraud WHERE risk_level = 'HIGH_RISK' AND user_id <> 7", "fraud"))(lambda s, d: lt.fraud(s, d).where((F.col("risk_level") == "HIGH_RISK") & (F.col("user_id") != 7)).select("id"))
query("f2_range", w(f"SELECT id FROM fraud WHERE risk_score >= 50 AND analyzed_at >= TIMESTAMP '{O_AT}' - INTERVAL 300 DAY AND risk_score < 90", "fraud"))(lambda s, d: lt.fraud(s, d).where((F.col("risk_score") >= 50) & (F.col("risk_score") < 90) & (F.col("analyzed_at") >= F.lit(O_AT).cast("timestamp_ntz") - F.expr("INTERVAL 300 DAYS"))).select("id"))
query("f3_in_list", w("SELECT id FROM reviews WHERE status IN ('pending', 'corrected')", "reviews"))(lambda s, d: lt.reviews(s, d).where(F.col("status").isin("pending", "corrected")).select("id"))
query("f4_not_null", w("SELECT id FROM reviews WHERE reviewer_id IS NOT NULL", "reviews"))(lambda s, d: lt.reviews(s, d).where(F.col("reviewer_id").isNotNull()).select("id"))
query("f5_same_name", w("SELECT id FROM users WHERE lower(full_name) = 'asha name7'", "users"))(lambda s, d: lt.users(s, d).where(F.lower("full_name") == "asha name7").select("id"))
query("f7_queue_filters", w("SELECT id FROM reviews WHERE status IN ('pending', 'in_review') AND doc_type = 'pan' AND decision = 'REVIEW_REQUIRED' AND priority = 1", "reviews"))(lambda s, d: rec.filtered(lt.reviews(s, d), doc_type="pan", decision="REVIEW_REQUIRED", priority=1).select("id"))
_CHAIN = ["", " ", None, "final"], [None, "read ", ""], ["given", "", None]
query("f9_first_filled", "SELECT o_orderkey AS id, coalesce(" + ", ".join(f"nullif(trim({_sql_pick(f'(o_orderkey // {i + 1})', x)}), '')" for i, x in enumerate(_CHAIN)) + ") AS name FROM orders")(lambda s, d: lt.table(s, d, "orders").select(_key().alias("id"), rec.first_filled(*[_pick(F.floor(_key() / (i + 1)), x) for i, x in enumerate(_CHAIN)]).alias("name")))
query("f15_score_parts", f"SELECT user_id, CASE WHEN mark > 10 THEN mark END AS pct, CASE WHEN mark <= 10 THEN mark END AS cgpa FROM ({rq._MARKS})")(lambda s, d: rq.marks(s, d).select("user_id", *[x.alias(n) for n, x in zip(("pct", "cgpa"), search.score_parts(F.col("mark")), strict=True)]))
_AUDIT = SQL["u1_audit_events"]
query("f16_audit_filters", f"SELECT * FROM ({_AUDIT}) WHERE action = 'approved' AND contains(lower(source || ' ' || action || ' ' || ref), 'review')")(lambda s, d: rec.audit_filter(rec.audit_events(lt.reviews(s, d), lt.corrections(s, d), lt.uploads(s, d)), action="approved", text="Review"))

# Joins, order and windows
query("j3_high_risk_users", SQL["j2_fraud_risk_dashboard"])(lambda s, d: lt.fraud(s, d).where(F.col("risk_level").isin("HIGH_RISK", "CRITICAL_RISK")).join(lt.users(s, d).select(F.col("id").alias("user_id"), "full_name"), "user_id").select("user_id", "id", "risk_score", "risk_level", "full_name"))
query("j5_user_documents", w("""WITH k AS (SELECT user_id, doc_type, arg_max(id, (created_at, id)) AS last FROM reviews WHERE doc_type IN ('aadhaar', 'pan') GROUP BY 1, 2), a AS (SELECT user_id, string_agg(id::VARCHAR, ',' ORDER BY id) AS academic FROM reviews WHERE doc_type = 'academic' GROUP BY 1)
  SELECT u.id, max(last) FILTER (doc_type = 'aadhaar') AS aadhaar, max(last) FILTER (doc_type = 'pan') AS pan, any_value(academic) AS academic FROM users u LEFT JOIN k ON k.user_id = u.id LEFT JOIN a ON a.user_id = u.id GROUP BY u.id""", "users", "reviews"))(lambda s, d: rec.user_documents(lt.users(s, d), lt.reviews(s, d)))
query("o1_recent", w("SELECT id, risk_score FROM fraud ORDER BY risk_score DESC, id LIMIT 25", "fraud"))(lambda s, d: lt.fraud(s, d).orderBy(F.desc("risk_score"), "id").limit(25).select("id", "risk_score"))
query("o3_third_page", w("SELECT id FROM fraud ORDER BY id LIMIT 20 OFFSET 40", "fraud"))(lambda s, d: lt.fraud(s, d).orderBy("id").offset(40).limit(20).select("id"))
query("o5_top_of_each", w("SELECT user_id, id, risk_score FROM fraud QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY risk_score DESC, id) <= 3", "fraud"))(lambda s, d: rec.top_of_each(lt.fraud(s, d), "user_id", 3, F.desc("risk_score"), F.asc("id")).select("user_id", "id", "risk_score"))
query("w3_last_and_previous_week", f"SELECT sum(count) FILTER (n <= 7) AS recent, sum(count) FILTER (n BETWEEN 8 AND 14) AS previous FROM (SELECT count, row_number() OVER (ORDER BY date DESC) AS n FROM ({SQL['a8_daily_counts']}))")(lambda s, d: ts.two_weeks(ts.daily_counts(lt.uploads(s, d), "uploaded_at", E_AT, 14)))
query("w6_ranks", w("SELECT reviewer_id, n, row_number() OVER (ORDER BY n DESC, reviewer_id)::INT AS rank FROM (SELECT reviewer_id, count(*) AS n FROM reviews WHERE reviewer_id IS NOT NULL GROUP BY 1) QUALIFY rank <= 10", "reviews"))(lambda s, d: rec.ranked(lt.reviews(s, d).where("reviewer_id IS NOT NULL").groupBy("reviewer_id").agg(F.count(F.lit(1)).alias("n")), 10))
query("a50_overall_verdicts", SQL["r1_validation"].replace("SELECT id, name_score, name_status, dob_status, id_status, overall_status FROM o", "SELECT id, overall_status FROM o"))(lambda s, d: rq.compared(s, d).select("id", "overall_status"))
query("a51_capped_sums", "SELECT o_custkey AS user_id, least(100, sum(o_orderkey % 40))::BIGINT AS score FROM orders GROUP BY 1")(lambda s, d: lt.table(s, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.least(F.lit(100), F.sum(_key() % 40)).alias("score")))
query("m2_risk_levels", f"SELECT id, risk_level, priority FROM ({SQL['m1_risk_score']})")(lambda s, d: rq.risk(s, d).select("id", sc.risk_level(F.col("risk_score")).alias("risk_level"), sc.review_priority(sc.risk_level(F.col("risk_score"))).alias("priority")))
_ACTIVE = f"SELECT alert_type, severity, metric_value FROM ({SQL['r9_alerts']}) WHERE NOT resolved"
query("r9_active_alerts", f"SELECT * FROM ({_ACTIVE}) ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'WARNING' THEN 1 ELSE 2 END, alert_type LIMIT 20")(lambda s, d: rules.active_alerts(rules.alerts(rq.found_anomalies(s, d))).select("alert_type", "severity", "metric_value"))
query("r9_system_health", f"SELECT CASE WHEN c > 0 THEN 'CRITICAL' WHEN n > 0 OR status <> 'healthy' THEN 'WARNING' ELSE 'HEALTHY' END AS health, n AS alerts, c AS critical, status AS queue_status, success_rate AS ocr_success_rate FROM (SELECT count(*) AS n, count(*) FILTER (severity = 'CRITICAL') AS c FROM ({_ACTIVE})), (SELECT status FROM ({SQL['r9_queue_health']})), (SELECT success_rate FROM ({SQL['a21_ocr_success_rate']}))")(
    lambda s, d: rules.system_health(rules.alerts(rq.found_anomalies(s, d)), rules.queue_health(lt.reviews(s, d)), lt.verified(s, d)))

# Names, numbers and dates
_PAIR = (["Asha Rao", "Robert Smith", "Aasha Rau", None, "", "Rupert"], ["Aasha Rau", "Rupert Smyth", "Asha", "Ravi", ""])
query("x5_phonetic")(lambda s, d: lt.table(s, d, "orders").select(_key().alias("id"), F.round(nm.phonetic(nm.normal_name(_pick(_key(), _PAIR[0])), nm.normal_name(_pick(F.floor(_key() / 2), _PAIR[1]))), 6).alias("heard")))
query("x6_name_scores")(lambda s, d: lt.table(s, d, "orders").select(_key().alias("id"), F.round(nm.name_score(nm.normal_name(_pick(_key(), _PAIR[0])), nm.normal_name(_pick(F.floor(_key() / 2), _PAIR[1]))), 6).alias("score")))
query("x7_exact_names", SQL["r1_validation"].replace("SELECT id, name_score, name_status, dob_status, id_status, overall_status FROM o", "SELECT id, name_score FROM o"))(lambda s, d: rq.compared(s, d).select("id", "name_score"))
query("x8_name_statuses", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 101 >= 90 THEN 'MATCH' WHEN o_orderkey % 101 >= 75 THEN 'POSSIBLE_MATCH' ELSE 'MISMATCH' END AS status FROM orders")(lambda s, d: lt.table(s, d, "orders").select(_key().alias("id"), nm.name_status(_key() % 101).alias("status")))
query("x9_id_statuses", SQL["r1_validation"].replace("SELECT id, name_score, name_status, dob_status, id_status, overall_status FROM o", "SELECT id, id_status FROM o"))(lambda s, d: rq.field_pairs(s, d).select("id", nm.id_status(F.col("stored_id"), F.col("found_id")).alias("id_status")))
query("x10_dob_statuses", SQL["r1_validation"].replace("SELECT id, name_score, name_status, dob_status, id_status, overall_status FROM o", "SELECT id, dob_status FROM o"))(lambda s, d: rq.field_pairs(s, d).select("id", nm.dob_status(F.col("stored_dob"), F.col("found_dob")).alias("dob_status")))
query("x27_masked", "SELECT o_orderkey AS id, 'XXXX XXXX ' || right(lpad((o_orderkey * 7919 % 4001)::VARCHAR, 12, '2'), 4) AS masked FROM orders")(lambda s, d: lt.table(s, d, "orders").select(_key().alias("id"), tx.masked(F.lpad((_key() * 7919 % 4001).cast("string"), 12, "2")).alias("masked")))

# Positioned words
_OK = f"{tq._WORDS}, q AS (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM ok)"
query("j13_nearest_below", f"{_OK} SELECT a.doc, a.page, a.word_id AS a, arg_min(b.word_id, (b.cy - a.cy, b.word_id)) AS below FROM q a JOIN q b ON a.doc = b.doc AND a.page = b.page AND a.word_id <> b.word_id AND b.cy > a.cy AND abs(a.cx - b.cx) < 50 GROUP BY ALL")(lambda s, d: ly.nearest_below(ly.clean_words(tq.words(s, d))))
# The hops of labels: right, below, right of right and once more, and what a word has besides the label.
_HOPS = f"""{tq._WORDS}, q AS (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM ok),
  rt AS (SELECT a.doc, a.page, a.word_id AS a, arg_min(b.word_id, (b.x1 - a.x2, b.word_id)) AS nxt FROM q a JOIN q b ON a.doc = b.doc AND a.page = b.page AND a.word_id <> b.word_id AND abs(a.cy - b.cy) < 0.8 * 20 AND b.x1 >= a.x2 GROUP BY ALL),
  bl AS (SELECT a.doc, a.page, a.word_id AS a, arg_min(b.word_id, (b.cy - a.cy, b.word_id)) AS nxt FROM q a JOIN q b ON a.doc = b.doc AND a.page = b.page AND a.word_id <> b.word_id AND b.cy > a.cy AND abs(a.cx - b.cx) < 50 GROUP BY ALL),
  ht AS (SELECT doc, page, word_id AS label_id, text AS label FROM ok WHERE regexp_matches(lower(text), 'the|name')),
  r1 AS (SELECT ht.*, rt.nxt AS n1 FROM ht LEFT JOIN rt ON rt.doc = ht.doc AND rt.page = ht.page AND rt.a = label_id), r2 AS (SELECT r1.*, rt.nxt AS n2 FROM r1 LEFT JOIN rt ON rt.doc = r1.doc AND rt.page = r1.page AND rt.a = n1), r3 AS (SELECT r2.*, rt.nxt AS n3 FROM r2 LEFT JOIN rt ON rt.doc = r2.doc AND rt.page = r2.page AND rt.a = n2),
  al AS (SELECT r3.doc, r3.page, label_id, label, unnest([0, 1, 2, 3]) AS step, unnest(['nearest_right', 'nearest_below', 'right_hop', 'right_hop']) AS strategy, unnest([n1, bl.nxt, n2, n3]) AS id FROM r3 LEFT JOIN bl ON bl.doc = r3.doc AND bl.page = r3.page AND bl.a = label_id),
  vl AS (SELECT al.doc, al.page, label_id, label, step, strategy, ok.text AS value FROM al JOIN ok ON ok.doc = al.doc AND ok.page = al.page AND ok.word_id = al.id
    UNION ALL SELECT doc, page, label_id, label, 4, 'inline', rest FROM (SELECT *, regexp_replace(regexp_replace(label, 'the|name', '', 'gi'), '^[ :/|-]+|[ :/|-]+$', '', 'g') AS rest FROM ht) WHERE rest <> '' AND rest <> trim(label))
  SELECT doc, page, label_id, label, value, strategy FROM vl QUALIFY row_number() OVER (PARTITION BY doc, page, value ORDER BY label_id, step) = 1"""
query("j14_label_values", _HOPS)(lambda s, d: ly.label_values(ly.clean_words(tq.words(s, d)), ["the", "name"]))
query("j15_anchor_values")(lambda s, d: ly.anchor_scores(tq.gridded(s, d), _anchors(tq.gridded(s, d))))
query("j17_nearest_anchors", f"{tq._PHR} SELECT doc, page, line, phrase, (list_sort(list_transform([100.0, 300.0, 500.0, 700.0], lambda x, i: {{'d': abs(x - (x1 + x2) / 2), 'i': i - 1}}))[1]).i::INT AS anchor FROM ph")(
    lambda s, d: ly.phrases(tq.gridded(s, d)).select("doc", "page", "line", "phrase", ly.nearest_anchor(F.col("cx"), [100.0, 300.0, 500.0, 700.0]).alias("anchor")))
query("m17_geometry", f"{_OK} SELECT a.doc, a.page, a.word_id AS a, abs(a.cy - b.cy) < 0.5 * least(a.y2 - a.y1, b.y2 - b.y1) AS same_row, abs(a.cx - b.cx) < 50 AS same_column, round(sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2), 6) AS distance FROM q a JOIN q b ON a.doc = b.doc AND a.page = b.page AND b.word_id = a.word_id + 1")(
    lambda s, d: ly.neighbours(ly.clean_words(tq.words(s, d))))
query("o6_reading_order", f"{tq._BAND} SELECT doc, page, word_id, row_number() OVER (PARTITION BY doc, page ORDER BY line, x1, word_id)::INT AS place FROM b")(lambda s, d: ly.reading_order(tq.gridded(s, d)))
query("w10_smoothed_regions", SQL["r14_regions_smoothed"])(lambda s, d: ly.regions(ly.lines(ly.phrases(tq.gridded(s, d)))).select("doc", "page", "line", "region"))
_WRAP = f"""WITH RECURSIVE {tq._PHR.removeprefix("WITH ")}, ln AS (SELECT doc, page, line, min(x1) AS x1, max(x2) AS x2, min(y1) AS y1, max(y2) AS y2, (min(y1) + max(y2)) / 2 AS cy, count(*) AS tokens FROM ph GROUP BY ALL),
  st AS (SELECT *, cy - lag(cy) OVER (PARTITION BY doc, page ORDER BY line) AS fall, row_number() OVER (PARTITION BY doc, page ORDER BY line) AS r, min(x1) OVER (PARTITION BY doc, page) AS margin FROM ln),
  sp AS (SELECT *, coalesce(median(CASE WHEN fall > 0 THEN fall END) OVER (PARTITION BY doc, page), 15.0) AS spacing FROM st),
  wr AS (SELECT doc, page, line, r, x1 AS l, x2 AS rt, y2 AS b, 0::BIGINT AS logical FROM sp WHERE r = 1
    UNION ALL SELECT s.doc, s.page, s.line, s.r, CASE WHEN j THEN least(s.l, s.x1) ELSE s.x1 END, CASE WHEN j THEN greatest(s.rt, s.x2) ELSE s.x2 END, CASE WHEN j THEN greatest(s.b, s.y2) ELSE s.y2 END, CASE WHEN j THEN s.logical ELSE s.logical + 1 END
      FROM (SELECT sp.*, wr.l, wr.rt, wr.b, wr.logical, sp.x1 > margin + 20 AND sp.x2 >= wr.l AND sp.x1 <= wr.rt AND sp.y1 - wr.b < spacing * 1.5 AND (tokens < 5 OR sp.x1 >= wr.l) AS j FROM wr JOIN sp ON sp.doc = wr.doc AND sp.page = wr.page AND sp.r = wr.r + 1) s)
  SELECT doc, page, line, logical FROM wr"""
query("w13_wrapped_lines", _WRAP)(lambda s, d: ly.wrapped_lines(ly.lines(ly.phrases(tq.gridded(s, d)))).select("doc", "page", "line", "logical"))
_SLOTS = f"""{tq._BAND}, cw AS (SELECT *, least(greatest(coalesce(median(CASE WHEN x2 > x1 THEN (x2 - x1) / length(text) END) OVER (PARTITION BY doc, page), 8.0), 5.0), 15.0) AS char FROM b),
  k AS (SELECT *, greatest(0, floor(x1 / char))::BIGINT AS col FROM cw), s AS (SELECT doc, page, line, col, arg_max(text, (x1, word_id)) AS t FROM k GROUP BY ALL)
  SELECT doc, page, line, rtrim(list_reduce(list({{'c': col, 't': t}} ORDER BY col), lambda a, x: {{'c': 0, 't': rpad(a.t[1:x.c], x.c::INT, ' ') || x.t || a.t[x.c + length(x.t) + 1:]}}, {{'c': 0, 't': ''}}).t) AS text FROM s GROUP BY ALL"""
query("x24_positioned_text", _SLOTS)(lambda s, d: ly.positioned_text(tq.gridded(s, d)))
query("r17_row_blocks", f"{tq._LINES}, t AS (SELECT *, tokens >= greatest(2, max(tokens) OVER v * 0.5) AS wide FROM ln WINDOW v AS (PARTITION BY doc, page)), ed AS (SELECT *, min(CASE WHEN wide THEN line END) OVER v AS a, max(CASE WHEN wide THEN line END) OVER v AS z FROM t WINDOW v AS (PARTITION BY doc, page)) SELECT doc, page, line, CASE WHEN a IS NULL OR line < a THEN 'header' WHEN line > z THEN 'footer' ELSE 'table' END AS block FROM ed")(lambda s, d: ly.row_blocks(ly.lines(ly.phrases(tq.gridded(s, d)))).select("doc", "page", "line", "block"))


def _anchors(words: DataFrame) -> DataFrame:
    return words.where("word_id % 10 = 0").select("doc", "page", F.col("word_id").alias("anchor_id"), F.when(F.col("word_id") % 20 == 0, "PERCENTAGE").otherwise("NAME").alias("kind"), "x1", "y1", "x2", "y2", "line")


# Statements: a grid of cells with a header, or without one, from the lines of orders
_HEADS = [["Txn Date", "Particulars", "Debit", "Balance"], ["a", "b", "c", "d"], ["Date", "Ref No", "Amount", "Details"]]


def statements(s: SparkSession, d: str) -> DataFrame:
    x = lt.table(s, d, "lineitem")
    k = F.col("l_orderkey")
    date = F.date_format("l_shipdate", "dd/MM/yyyy")
    cells = F.array(F.when(F.col("l_linenumber") % 5 == 4, "").otherwise(date), F.concat(F.lit("item "), F.col("l_partkey").cast("string")), F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.concat(F.col("l_suppkey").cast("string"), F.lit(".50"))), F.concat(F.lit("1,"), F.lpad(F.col("l_suppkey").cast("string"), 3, "0"), F.lit(".00")))
    rows = x.select(k.alias("doc"), F.lit(0).cast("long").alias("page"), F.col("l_linenumber").cast("long").alias("row"), cells.alias("cells"))
    head = x.select(k.alias("doc")).distinct().select("doc", F.lit(0).cast("long").alias("page"), F.lit(0).cast("long").alias("row"), F.get(F.array(*[F.array(*[F.lit(c) for c in h]) for h in _HEADS]), (F.col("doc") % 3).cast("int")).alias("cells"))
    return rows.unionByName(head)


_STM = """st AS (SELECT l_orderkey AS doc, l_linenumber AS row, CASE WHEN l_linenumber % 5 = 4 THEN '' ELSE strftime(l_shipdate, '%d/%m/%Y') END AS c0, 'item ' || l_partkey AS c1, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE l_suppkey || '.50' END AS c2, '1,' || lpad(l_suppkey::VARCHAR, 3, '0') || '.00' AS c3 FROM lineitem)"""
# Orders divisible by 3 have a full header; those of remainder 1 one whose only role is none; those of remainder 2 one with other columns.
query("r15_transactions")(lambda s, d: ly.transactions(statements(s, d)))
query("r15_transactions_with_header", f"WITH {_STM} SELECT doc, row, c0 AS date, c1 AS description, '' AS amount, c3 AS balance FROM st WHERE doc % 3 = 0 AND c0 <> ''")(lambda s, d: ly.transactions(statements(s, d).where("doc % 3 = 0")).select("doc", "row", "date", "description", "amount", "balance"))
query("r16_labelled_rows", f"WITH {_STM} SELECT doc, row, 0 AS column, CASE doc % 3 WHEN 0 THEN 'Txn Date' WHEN 1 THEN 'a' ELSE 'Date' END AS label, c0 AS value FROM st UNION ALL SELECT doc, row, 1, CASE doc % 3 WHEN 0 THEN 'Particulars' WHEN 1 THEN 'b' ELSE 'Ref No' END, c1 FROM st UNION ALL SELECT doc, row, 2, CASE doc % 3 WHEN 0 THEN 'Debit' WHEN 1 THEN 'c' ELSE 'Amount' END, c2 FROM st UNION ALL SELECT doc, row, 3, CASE doc % 3 WHEN 0 THEN 'Balance' WHEN 1 THEN 'd' ELSE 'Details' END, c3 FROM st")(
    lambda s, d: ly.labelled_rows(statements(s, d)).select("doc", "row", "column", "label", "value"))


# Sources and streams
def _text_file(s: SparkSession, name: str, text: str) -> str:
    at = f"{shared_root(s)}/{name}-{uuid.uuid4().hex}"
    s.createDataFrame([(text,)], "value string").coalesce(1).write.text(at)
    return at


@query("s21_truth", "SELECT * FROM (VALUES ('a.png', 'ssc', 'name', 'Asha Rao'), ('a.png', 'ssc', 'percentage', '82.4'), ('a.png', 'ssc', 'obtained_marks', NULL), ('a.png', 'ssc', 'total_marks', NULL), ('a.png', 'ssc', 'result', 'PASS')) t(filename, doc_type, field, expected)")
def truth_file(s: SparkSession, d: str) -> DataFrame:
    """Expected values out of a JSON file of the documented form."""
    body = {"documents": [{"filename": "a.png", "doc_type": "ssc", "expected": {"name": "Asha Rao", "percentage": "82.4", "result": "PASS"}}]}
    return sinks.read_truth(s, _text_file(s, "truth", json.dumps(body)))


@query("s16_file_kinds", "SELECT 'unknown' AS kind, 10 AS length, sha256('plain txt' || chr(10)) AS content_key UNION ALL SELECT 'pdf', 9, sha256('%PDF-1.7' || chr(10))")
def file_kinds(s: SparkSession, d: str) -> DataFrame:
    """Files by their first bytes."""
    at = f"{shared_root(s)}/files-{uuid.uuid4().hex}"
    for name, text in (("a", "plain txt"), ("b", "%PDF-1.7")):
        s.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{at}/{name}")
    return sinks.read_binaries(s, f"{at}/*/part-*.txt").select("kind", "length", "content_key")


def _appended(s: SparkSession, d: str, rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows that come as a stream of files, a few a batch, appended once by key."""
    at = f"{shared_root(s)}/{name}-{uuid.uuid4().hex}"
    rows.repartition(3).write.parquet(f"{at}/in")
    jobs.run_once(jobs.read_files(s, f"{at}/in", rows.schema, files_per_batch=1), f"{at}/state", jobs.append_new(f"{at}/out", keys))
    remove(s, f"{at}/in", f"{at}/state")
    return s.read.parquet(f"{at}/out").select(*rows.columns)


query("st3_queued_jobs", w("SELECT id, user_id FROM uploads WHERE doc_type = 'purchase'", "uploads"))(lambda s, d: _appended(s, d, lt.uploads(s, d).where("doc_type = 'purchase'").select("id", "user_id"), ["id"], "jobs"))
query("st4_bulk_users", w("SELECT DISTINCT user_id FROM uploads WHERE user_id NOT IN (SELECT user_id FROM reviews WHERE status = 'approved')", "uploads", "reviews"))(
    lambda s, d: _appended(s, d, lt.uploads(s, d).select("user_id").join(lt.reviews(s, d).where("status = 'approved'").select("user_id"), "user_id", "left_anti"), ["user_id"], "bulk"))
query("s5_appended_alerts", SQL["st8_stored_alerts"])(lambda s, d: _appended(s, d, rules.alerts(rq.found_anomalies(s, d)).select("alert_type", "severity", "title", "metric_value"), ["alert_type"], "alerts"))
query("st6_risk_timeline", w("SELECT id, user_id, risk_score, risk_level, analyzed_at FROM fraud", "fraud"))(lambda s, d: _appended(s, d, lt.fraud(s, d).select("id", "user_id", "risk_score", "risk_level", "analyzed_at"), ["id"], "timeline"))
