"""Queries over document kinds and fields, review events, evaluation, bundles and exports."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlake.functions import marksheets as mk
from dossierlake.functions import parsers as ps
from dossierlake.functions import scores as sc
from dossierlake.operators import documents as dc
from dossierlake.plans import rule_queries as rq
from dossierlake.plans import rules
from dossierlake.plans._registry import QUERIES, SQL, edges, query
from dossierlake.plans.record_queries import _key, _pick, _sql_pick
from dossierlake.sources import logical as lt
from dossierlake.sources import sinks
from dossierlake.sources.logical import with_tables as w
from dossierlake.sources.shared import remove, shared_root
from dossierlake.streaming import jobs

CARDS = [
    "Government of India\nAsha Rao\nDOB: 01-02-1990\nFemale\n2345 6789 0123",
    "INCOME TAX DEPARTMENT\nRAVI KUMAR\nPermanent Account Number\nABCDE1234F\n12/11/1985",
    "1990 2345 6789\n234567890123\nYear of Birth 1975",
    "Meera Shah Patil\nAddress: 12 Main Street, Pune 411001\n\nphone 9876543210 born 05.06.07",
    "PASSPORT Republic of India\n12345678 9012 and 0000 1111 2222",
    "SSC examination March 2019 state board seat no 12 Secondary School Certificate",
    "Higher Secondary Certificate HSC science stream state board 2021",
    "University of Pune statement of grades SGPA 8.2 CGPA 8.5",
    "SSC state board total marks 500 obtained marks 412 division first",
    "class 12th commerce stream junior college cbse total marks list of students",
    "Semester IV B.Tech university credit points grade point toppers",
    "short",
    None,
    "nothing of note is written in this long enough sentence",
    "bank statement of account 12 Jan 2024 balance 12.50",
    "DL no 12 driving licence DOB 31/12/99",
]
SHEETS = [
    "Mathematics | 72 | 100 | A\nEnglish | 65 | 100 | B\nTotal | 137",
    "Mathematics 72/100 A\nEnglish 65 B\n70 80\nScience 300 88",
    "physics    55    75\nchemistry\t60\t75\tC\nmaths of 12",
    "History 45\nhistory 50\nart 9 OF 10\nab",
    None,
    "no subjects here",
]
NAMES = ["Asha Rao", "Gni Nao To Any.", "Village Road", "A B Kumar", "Jo Smith", "Mc Donald", "XKCD WRTZ", "Ravi123", "Om", "wright paul", "chen li", "INCOME TAX", "Ravi Kumar Shah", "R@vi Kumar", "the Kumar", ""]
_S = {"card": (CARDS, 1), "sheet": (SHEETS, 3), "line": (NAMES, 5)}


def texts(s: SparkSession, d: str) -> DataFrame:
    return lt.table(s, d, "orders").select(_key().alias("id"), *[_pick(F.floor(_key() / m), values).alias(c) for c, (values, m) in _S.items()])


_TX = "tx AS (SELECT o_orderkey AS id, " + ", ".join(f"{_sql_pick(f'(o_orderkey // {m})', values)} AS {c}" for c, (values, m) in _S.items()).replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + " FROM orders)"


def _rx(x: str, p: str, g: int = 1) -> str:
    p = p.replace("'", "''")
    return f"CASE WHEN regexp_matches({x}, '{p}') THEN regexp_extract({x}, '{p}', {g}) END"


def _digits(raw: str) -> str:
    d = f"regexp_replace({raw}, '[\\s\\-]', '', 'g')"
    return f"CASE WHEN length({d}) = 12 AND NOT coalesce(try_cast({d}[1:4] AS INT) BETWEEN 1800 AND 2099, false) AND {d}[1:4] <> '0000' AND {d}[5:8] <> '0000' AND {d}[9:12] <> '0000' THEN {d}[1:4] || ' ' || {d}[5:8] || ' ' || {d}[9:12] END"


_ALONE = f"list_filter(list_transform(list_filter(list_transform(string_split(card, chr(10)), lambda x: regexp_replace(x, '[\\s\\-]', '', 'g')), lambda x: regexp_matches(x, '^[0-9]{{12}}$')), lambda x: {_digits('x')}), lambda x: x IS NOT NULL)[1]"
_SHORT = f"translate({_rx('card', ps.BORN[3])}, '-.', '//')"
query("x16_identity_numbers", f"""WITH {_TX} SELECT id, coalesce({', '.join(_digits(f'({_rx("card", p)})') for p in ps.TWELVE)}, {_ALONE}) AS aadhaar,
  coalesce(translate({_rx('card', ps.BORN[0])}, '-.', '//'), translate({_rx('card', ps.BORN[1])}, '-.', '//'), {_rx('card', ps.BORN[2])}, {_SHORT}[1:6] || (right({_SHORT}, 2)::INT + CASE WHEN right({_SHORT}, 2)::INT <= 25 THEN 2000 ELSE 1900 END)::VARCHAR) AS dob FROM tx""")(
    lambda s, d: texts(s, d).select("id", ps.twelve_digits(F.col("card")).alias("aadhaar"), ps.born(F.col("card")).alias("dob")))
_KF = {n: _rx("card", p) for n, p in ps.KYC.items()}
_KF["aadhaar_number"] = f"regexp_replace({_KF['aadhaar_number']}, '[\\s\\-]', '', 'g')"
_KF["address"] = f"replace(regexp_replace({_KF['address']}, '^\\s+|\\s+$', '', 'g'), chr(10), ', ')"
query("x16_kyc_fields", f"WITH {_TX} SELECT id, {', '.join(f'{x} AS {n}' for n, x in _KF.items())} FROM tx")(lambda s, d: texts(s, d).select("id", *[x.alias(n) for n, x in ps.kyc_fields(F.col("card")).items()]))
query("x22_kyc_kinds", f"WITH {_TX} SELECT id, CASE {' '.join('WHEN ' + ' OR '.join(f'''contains(lower(card), '{x}')''' for x in words) + f''' THEN '{k}' ''' for k, words in ps.KYC_KINDS)} ELSE 'unknown' END AS kind FROM tx")(lambda s, d: texts(s, d).select("id", ps.kyc_kind(F.col("card")).alias("kind")))


_SUMS = ", ".join(" + ".join(f"CASE WHEN regexp_matches(low, '{edges(p).replace(chr(39), chr(39) * 2)}') THEN {x} ELSE 0 END" for x, p in signals) + f" AS {k}" for k, signals in ps.SIGNALS.items())
_SETTLED = "CASE " + " ".join(f"WHEN regexp_matches(low, '{edges(p)}') THEN '{k}'" for k, p in ps.SETTLED) + " END"


def _kinds(x: str) -> str:
    return f"""a AS (SELECT id, {x} AS t, lower({x}) AS low FROM src), b AS (SELECT id, coalesce(length(regexp_replace(t, '^\\s+|\\s+$', '', 'g')), 0) < 30 AS short, {_SETTLED} AS settled, {_SUMS} FROM a),
  c AS (SELECT *, greatest(ssc, hsc, degree) AS top, ssc + hsc + degree - greatest(ssc, hsc, degree) - least(ssc, hsc, degree) AS second FROM b)
  SELECT id, CASE WHEN short THEN 'unknown' WHEN settled IS NOT NULL THEN settled WHEN top < 5 THEN 'unknown' WHEN ssc = top THEN 'ssc' WHEN hsc = top THEN 'hsc' ELSE 'degree' END AS document_type,
    CASE WHEN short THEN 0.0 WHEN settled IS NOT NULL THEN 95.0 WHEN top < 5 THEN 0.0 ELSE round(least(30.0::DOUBLE + (top - second) / top::DOUBLE * 70.0::DOUBLE, 99.0::DOUBLE) + 1e-9, 1) END AS confidence FROM c"""


query("x22_academic_kinds", f"WITH {_TX}, src AS (SELECT id, card FROM tx), {_kinds('card')}")(lambda s, d: texts(s, d).select("id", ps.academic_kind(F.col("card")).alias("k")).select("id", "k.*"))
query("x22_kinds_of_documents", f"WITH src AS (SELECT doc_id AS id, text FROM documents), {_kinds('text')}")(lambda s, d: lt.table(s, d, "documents").select(F.col("doc_id").alias("id"), ps.academic_kind(F.col("text")).alias("k")).select("id", "k.*"))
_GENDER = ["Male", "mele ", "F", "FEMALE", "femafe", "x", None, ""]
query("x19_genders", f"SELECT o_orderkey AS id, CASE {' '.join(f'''WHEN lower(trim(g)) IN ({', '.join(repr(x) for x in words)}) THEN '{n}' ''' for n, words in ps.GENDERS.items())} END AS gender FROM (SELECT o_orderkey, {_sql_pick('o_orderkey', _GENDER)} AS g FROM orders)")(
    lambda s, d: lt.table(s, d, "orders").select(_key().alias("id"), ps.gender(_pick(_key(), _GENDER)).alias("gender")))
_DATES = ["01/02/1990", "O1-I2-l985", "31.12.99", "32/01/2000", "01/13/2001", "1990", "12/11/2030", "05.06.07", None, "x"]
_DT = "translate(trim(r), 'lIiOoSsZzBgq', '111005522899')"
query("x3_full_dates", f"""WITH a AS (SELECT o_orderkey AS id, {_sql_pick('o_orderkey', _DATES)} AS r FROM orders), b AS (SELECT id, r, {_DT} AS t FROM a),
  c AS (SELECT *, CASE WHEN regexp_matches(t, '^[0-9]{{2}}[/.-][0-9]{{2}}[/.-][0-9]{{4}}$') THEN right(t, 4) WHEN regexp_matches(t, '^[0-9]{{2}}[/.-][0-9]{{2}}[/.-][0-9]{{2}}$') THEN (right(t, 2)::INT + CASE WHEN right(t, 2)::INT <= 25 THEN 2000 ELSE 1900 END)::VARCHAR END AS y FROM b)
  SELECT id, CASE WHEN try_cast(t[1:2] AS INT) BETWEEN 1 AND 31 AND try_cast(t[4:5] AS INT) BETWEEN 1 AND 12 AND try_cast(y AS INT) BETWEEN 1900 AND 2025 THEN t[1:2] || '/' || t[4:5] || '/' || y END AS dob,
    coalesce(CASE WHEN regexp_matches(r, '^[0-9]{{4}}$') THEN r::INT BETWEEN 1900 AND 2025 END, regexp_matches(r, '^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}$') AND try_cast(r[1:2] AS INT) BETWEEN 1 AND 31 AND try_cast(r[4:5] AS INT) BETWEEN 1 AND 12 AND try_cast(right(r, 4) AS INT) BETWEEN 1900 AND 2025, false) AS plausible FROM c""")(
    lambda s, d: lt.table(s, d, "orders").select(_key().alias("id"), ps.full_date(_pick(_key(), _DATES)).alias("dob"), ps.plausible_date(_pick(_key(), _DATES)).alias("plausible")))
_IN = lambda words: ", ".join(f"'{x}'" for x in words)
_PART = f"""NOT regexp_matches(x, '[.,;:!?]$') AND CASE WHEN length(x) = 1 THEN regexp_matches(x, '[A-Za-z]') ELSE NOT regexp_matches(x, '{ps.NO_START}') AND (length(x) < 4 OR regexp_matches(lower(x), '[aeiou]')) AND lower(x) NOT IN ({_IN(ps.NO_NAMES)}) AND (length(x) <> 2 OR lower(x) IN ({_IN(ps.SHORT_NAMES)})) END"""
_LETTERS = "len(regexp_extract_all({0}, '[a-zA-Z]'))"
query("x14_names", f"""WITH {_TX}, n AS (SELECT id, trim(line) AS s, list_filter(regexp_split_to_array(trim(line), '\\s+'), lambda x: x <> '') AS ws FROM tx)
  SELECT id, coalesce(length(s) BETWEEN 4 AND 50 AND regexp_matches(s, '^[A-Za-z\\s.\\-'']+$') AND len(ws) BETWEEN 1 AND 5 AND NOT regexp_matches(s, '{ps.ADDRESS}') AND len(list_filter(ws, lambda x: NOT ({_PART}))) = 0, false) AS human,
    length(s) >= 4 AND NOT ({' OR '.join(f"regexp_matches(s, '{p}')" for p in ps.NO_NAME_LINES)}) AND {_LETTERS.format('s')} / greatest(length(s), 1)::DOUBLE >= 0.88 AND len(ws) BETWEEN 2 AND 5 AND len(list_filter(ws, lambda x: length(x) > 1 AND {_LETTERS.format('x')} / length(x)::DOUBLE < 0.7)) = 0 AS holder FROM n""")(
    lambda s, d: texts(s, d).select("id", ps.human_name(F.col("line")).alias("human"), ps.name_line(F.col("line")).alias("holder")))
# Rows of cells, and of sentences where a text has fewer than two of cells.
_SUBJ, _GRADE, _MARKS = ps.SUBJECT.removeprefix("(?i)"), ps.GRADE, ps.MARKS
_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_TITLE = "array_to_string(list_transform(string_split(lower({0}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
_GNAME = "CASE upper(trim({0})) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ps.GRADE_NAMES.items()) + " ELSE trim({0}) END"
_NUM = "'^[0-9]+(?:\\.[0-9]+)?$'"
_SUBJECTS = rf"""WITH {_TX}, ln AS (SELECT id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT id, regexp_split_to_array(sheet, '\r\n|\n|\r') AS ls FROM tx)),
  ce AS (SELECT id, pos, {_STRIP.format('line')} AS t, list_filter(list_transform(regexp_split_to_array({_STRIP.format('line')}, '\|+|\t+|\s{{3,}}'), lambda x: trim(x)), lambda x: x <> '') AS cells FROM ln),
  pa AS (SELECT *, list_filter(cells, lambda x: regexp_matches(x, {_NUM})) AS nums, list_filter(cells, lambda x: NOT regexp_matches(x, {_NUM}) AND regexp_matches(x, '{_SUBJ}', 'i')) AS subj,
    list_filter(cells, lambda x: NOT regexp_matches(x, {_NUM}) AND NOT regexp_matches(x, '{_SUBJ}', 'i') AND regexp_matches(x, '^(?:{_GRADE})$')) AS gr,
    list_filter(list_transform(regexp_extract_all(t, '{_MARKS}'), lambda m: {{'got': regexp_extract(m, '^([0-9]+)', 1)::DOUBLE, 'of': try_cast(regexp_extract(m, '/\s*([0-9]+)$', 1) AS DOUBLE)}}), lambda m: m.got <= 200) AS marks, regexp_extract(t, '{_GRADE}', 1) AS g FROM ce),
  ta AS (SELECT id, 0 AS way, pos, {_TITLE.format('subj[-1]')} AS subject, nums[1]::DOUBLE AS marks_obtained, nums[2]::DOUBLE AS marks_total, CASE WHEN len(gr) > 0 THEN {_GNAME.format('gr[-1]')} END AS grade FROM pa WHERE len(cells) >= 2 AND len(subj) > 0 AND len(nums) > 0),
  te AS (SELECT id, 1 AS way, pos, {_TITLE.format(f"regexp_extract(t, '({_SUBJ})', 1, 'i')")} AS subject, marks[1].got AS marks_obtained, list_filter(marks, lambda m: m.of IS NOT NULL)[1].of AS marks_total, CASE WHEN g NOT IN ('', 'OF') THEN {_GNAME.format('g')} END AS grade
    FROM pa WHERE length(t) >= 4 AND regexp_matches(t, '{_SUBJ}', 'i') AND len(marks) > 0 AND id NOT IN (SELECT id FROM ta GROUP BY id HAVING count(*) >= 2))
  SELECT id, subject, marks_obtained, marks_total, grade FROM (SELECT * FROM ta UNION ALL SELECT * FROM te) QUALIFY row_number() OVER (PARTITION BY id, lower(replace(subject, ' ', '')) ORDER BY way, pos) = 1"""
query("r18_subjects", _SUBJECTS)(lambda s, d: dc.subjects(texts(s, d).select("id", F.col("sheet").alias("text")), "id"))
_LABELS = ["Candidate's Full Name", "Name of Student", "Surname", "Nane of Studnt", "NAME", "Father", ""]
_LT = "lower(trim({0}))"
_CLEAN = "regexp_replace({0}, '[^a-z\\s]', ' ', 'g')"
_BI = "CASE WHEN length({0}) >= 2 THEN list_distinct(list_transform(range(1, length({0})), lambda i: {0}[i:i + 1])) ELSE [] END"
query("u7_label_scores", f"""WITH a AS (SELECT o_orderkey AS id, lower(trim({_sql_pick('o_orderkey', _LABELS)})) AS t, {_sql_pick('(o_orderkey // 2)', ['name', 'student name', 'candidate name'])} AS l FROM orders),
  b AS (SELECT *, list_filter(regexp_split_to_array({_CLEAN.format('l')}, '\\s+'), lambda x: x <> '') AS lw, list_filter(regexp_split_to_array({_CLEAN.format('t')}, '\\s+'), lambda x: x <> '') AS tw, replace({_CLEAN.format('t')}, ' ', '') AS tc, replace({_CLEAN.format('l')}, ' ', '') AS lc FROM a),
  c AS (SELECT *, {_BI.format('tc')} AS tb, {_BI.format('lc')} AS lb FROM b)
  SELECT id, round(CASE WHEN t = '' THEN 0.0 WHEN contains(t, l) THEN CASE WHEN l = 'name' AND NOT regexp_matches(t, '\\bname\\b') THEN 0.0 ELSE 1.0 END
    ELSE len(list_filter(lw, lambda x: len(list_filter(tw, lambda y: contains(y, x))) > 0)) / len(lw)::DOUBLE * 0.6::DOUBLE + CASE WHEN len(tb) > 0 AND len(lb) > 0 THEN len(list_intersect(tb, lb)) / (len(tb) + len(lb) - len(list_intersect(tb, lb)))::DOUBLE ELSE 0.0 END * 0.4::DOUBLE END, 9) AS score FROM c""")(
    lambda s, d: lt.table(s, d, "orders").select(_key().alias("id"), F.round(ps.label_score(_pick(_key(), _LABELS), _pick(F.floor(_key() / 2), ["name", "student name", "candidate name"])), 9).alias("score")))
query("x13_label_matches", f"SELECT o_orderkey AS id, CASE WHEN contains(t, 'name of student') THEN 1.0 WHEN len(list_intersect(['name', 'of', 'student'], regexp_split_to_array(t, '\\s+'))) / 3.0::DOUBLE >= 0.6 THEN 0.8 WHEN contains(t, 'father') THEN 1.0 WHEN list_contains(regexp_split_to_array(t, '\\s+'), 'father') THEN 0.8 ELSE 0.0 END AS score FROM (SELECT o_orderkey, lower({_sql_pick('o_orderkey', _LABELS)}) AS t FROM orders)")(
    lambda s, d: lt.table(s, d, "orders").select(_key().alias("id"), ps.label_match(_pick(_key(), _LABELS), ["Name of Student", "Father"]).alias("score")))
_WRAPPED = ['{"value": " Asha ", "confidence": 0.9}', "plain ", "{broken", '{"other": 1}', '{"value": ""}', "", None, '{"value": 12}']
query("f10_unwrapped", f"SELECT o_orderkey AS id, nullif(CASE WHEN v[1:1] = '{{' AND json_valid(v) AND list_contains(json_keys(CASE WHEN json_valid(v) THEN v ELSE '{{}}' END), 'value') THEN trim(json_extract_string(CASE WHEN json_valid(v) THEN v ELSE '{{}}' END, '$.value')) ELSE v END, '') AS plain FROM (SELECT o_orderkey, trim({_sql_pick('o_orderkey', _WRAPPED)}) AS v FROM orders)")(
    lambda s, d: lt.table(s, d, "orders").select(_key().alias("id"), ps.unwrapped(_pick(_key(), _WRAPPED)).alias("plain")))
_GIVEN = {"name": (["Asha  Rao", "asha rao", "", None, "Ravi"], ["ASHA RAO", "", None, "Asha Rao"]), "aadhaar": (["1234 5678", "12345678", None], ["1234-5678", None, ""]), "pan": (["abcde 1f", "ABCDE1F", ""], ["ABCDE1F", "x", None, ""])}


def _norm(x: str, kind: str) -> str:
    s = f"trim(regexp_replace(regexp_replace(coalesce({x}, ''), '[\\n\\r\\t]', '', 'g'), ' +', ' ', 'g'))"
    return {"name": f"lower({s})", "aadhaar": f"regexp_replace({s}, '[^0-9]', '', 'g')", "pan": f"replace(upper({s}), ' ', '')"}[kind]


_GV = ", ".join(f"{_norm(_sql_pick(f'(o_orderkey // {i + 1})', a), k)} AS {k}_o, {_norm(_sql_pick(f'(o_orderkey // {i + 2})', b), k)} AS {k}_e" for i, (k, (a, b)) in enumerate(_GIVEN.items()))
_ST = ", ".join(f"CASE WHEN {k}_o = '' AND {k}_e = '' THEN 'empty' WHEN {k}_e = '' THEN 'invalid' WHEN {k}_o = '' THEN 'system_extracted' WHEN {k}_o = {k}_e THEN 'matched' ELSE 'needs_review' END AS {k}" for k in _GIVEN)


@query("f12_record_states", f"""WITH a AS (SELECT o_orderkey AS id, {_GV} FROM orders), b AS (SELECT id, {_ST} FROM a)
  SELECT *, CASE WHEN id % 19 = 0 OR (id % 7 < 2 AND id % 2 = 0) THEN 'matched' WHEN 'needs_review' IN (name, aadhaar, pan) THEN 'needs_review' WHEN 'invalid' IN (name, aadhaar, pan) THEN 'invalid' WHEN 'system_extracted' IN (name, aadhaar, pan) THEN 'system_extracted' WHEN name = 'matched' AND aadhaar = 'matched' AND pan = 'matched' THEN 'matched' ELSE 'system_extracted' END AS record FROM b""")
def record_states(s: SparkSession, d: str) -> DataFrame:
    states = {k: ps.field_state(_pick(F.floor(_key() / (i + 1)), a), _pick(F.floor(_key() / (i + 2)), b), k) for i, (k, (a, b)) in enumerate(_GIVEN.items())}
    x = lt.table(s, d, "orders").select(_key().alias("id"), *[c.alias(k) for k, c in states.items()])
    flow = F.when(F.col("id") % 7 == 0, "verified").when(F.col("id") % 7 == 1, "Approved")
    return x.withColumn("record", ps.record_state([F.col(k) for k in _GIVEN], F.col("id") % 19 == 0, flow, F.col("id") % 2 == 0))


# Review events
_ACT = "CASE l_linenumber % 5 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' WHEN 2 THEN 'correct' WHEN 3 THEN 'reprocess' ELSE 'note' END"


def actions(s: SparkSession, d: str) -> DataFrame:
    k = F.col("l_linenumber") % 5
    name = F.when(k == 0, "approve").when(k == 1, "reject").when(k == 2, "correct").when(k == 3, "reprocess").otherwise("note")
    return lt.table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), name.alias("action"), F.concat(F.lit("rev"), (F.col("l_suppkey") % 40).cast("string")).alias("reviewer_id"), F.col("l_shipdate").alias("acted_at"), F.col("l_linenumber").alias("position"))


query("r4_submitted_reviews", f"SELECT id, decision, priority, CASE decision WHEN 'AUTO_APPROVED' THEN 'approved' WHEN 'AUTO_REJECTED' THEN 'rejected' ELSE 'pending' END AS status FROM ({SQL['r2_approval']})")(lambda s, d: dc.submitted(rules.evaluate(rq.compared(s, d))).select("id", "decision", "priority", "status"))
query("r4_audit_rows", f"""WITH e AS (SELECT * FROM ({SQL['r2_approval']})) SELECT id, 'CREATED' AS action, decision AS reason, 0 AS step FROM e
  UNION ALL SELECT id, CASE decision WHEN 'AUTO_APPROVED' THEN 'AUTO_APPROVED' WHEN 'AUTO_REJECTED' THEN 'AUTO_REJECTED' ELSE 'SUBMITTED_FOR_REVIEW' END, CASE decision WHEN 'AUTO_APPROVED' THEN 'all_rules_passed' WHEN 'AUTO_REJECTED' THEN array_to_string(string_split(reasons, ',')[1:3], '; ') ELSE 'queued_for_reviewer' END, 1 FROM e""")(
    lambda s, d: dc.audit_rows(rules.evaluate(rq.compared(s, d))))
_NEW = "CASE action WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' WHEN 'correct' THEN 'corrected' WHEN 'reprocess' THEN 'reprocess_requested' END"
_ACTS = f"ac AS (SELECT l_orderkey AS id, {_ACT} AS action, 'rev' || (l_suppkey % 40) AS reviewer_id, l_shipdate AS acted_at, l_linenumber AS position FROM lineitem), ev AS (SELECT *, {_NEW} AS status FROM ac WHERE action <> 'note')"
query("r5_reviewed", w(f"WITH {_ACTS} SELECT r.id, coalesce(arg_max(e.status, (e.acted_at, e.position, e.action, e.reviewer_id)), any_value(r.status)) AS status, coalesce(arg_max(e.reviewer_id, (e.acted_at, e.position, e.action, e.reviewer_id)), any_value(r.reviewer_id)) AS reviewer_id, count(e.id) AS actions FROM reviews r LEFT JOIN ev e ON e.id = r.id GROUP BY r.id", "reviews"))(lambda s, d: dc.reviewed(lt.reviews(s, d), actions(s, d)))
query("r5_audit_rows", w(f"WITH {_ACTS} SELECT ev.id, CASE action WHEN 'approve' THEN 'APPROVED' WHEN 'reject' THEN 'REJECTED' WHEN 'correct' THEN 'CORRECTED' ELSE 'REPROCESS_REQUESTED' END AS action, ev.reviewer_id, acted_at, coalesce(lag(ev.status) OVER (PARTITION BY ev.id ORDER BY acted_at, position, action, ev.reviewer_id), r.status) AS before, ev.status AS after FROM ev LEFT JOIN reviews r ON r.id = ev.id", "reviews"))(lambda s, d: dc.action_log(lt.reviews(s, d), actions(s, d)))

# Evaluation
_TRUTH = {"name": (["Asha Rao", "Ravi Kumar", None], ["rao asha x", "Ravi", None, "Ravi Kumar"]), "percentage": (["80", "75.5", None], ["81.9", "70", None, "x"]), "obtained_marks": (["400", None], ["401", "390", None]), "total_marks": (["500", "650"], ["500", "x", None]), "result": (["PASS", None, "FAIL"], ["pass ", "FAIL", None])}


def truth(s: SparkSession, d: str) -> DataFrame:
    """(file, field, expected)."""
    return lt.table(s, d, "orders").select(_key().alias("file"), F.inline(F.array(*[F.struct(F.lit(f).alias("field"), _pick(F.floor(_key() / (i + 1)), a).alias("expected")) for i, (f, (a, _)) in enumerate(_TRUTH.items())])))


def predicted(s: SparkSession, d: str) -> DataFrame:
    """(file, field, predicted); files of keys divisible by 10 have no result at all."""
    return lt.table(s, d, "orders").where(_key() % 10 != 0).select(_key().alias("file"), F.inline(F.array(*[F.struct(F.lit(f).alias("field"), _pick(F.floor(_key() / (i + 2)), b).alias("predicted")) for i, (f, (_, b)) in enumerate(_TRUTH.items())])))


_TP = "tp AS (" + " UNION ALL ".join(f"SELECT o_orderkey AS file, '{f}' AS field, {_sql_pick(f'(o_orderkey // {i + 1})', a)} AS expected, CASE WHEN o_orderkey % 10 <> 0 THEN {_sql_pick(f'(o_orderkey // {i + 2})', b)} END AS predicted FROM orders" for i, (f, (a, b)) in enumerate(_TRUTH.items())) + ")"
_HIT = f"""hit AS (SELECT file, field, expected, predicted, coalesce(CASE field WHEN 'name' THEN predicted IS NOT NULL AND len(list_filter(regexp_split_to_array(lower(trim(expected)), '\\s+'), lambda x: NOT contains(lower(trim(predicted)), x))) = 0 WHEN 'percentage' THEN abs(try_cast(predicted AS DOUBLE) - try_cast(expected AS DOUBLE)) <= 2
  WHEN 'result' THEN upper(trim(predicted)) = upper(trim(expected)) ELSE abs(try_cast(predicted AS DOUBLE) - try_cast(expected AS DOUBLE)) <= 1 END, false) AS match FROM tp WHERE expected IS NOT NULL)"""
query("j18_against_truth", f"WITH {_TP}, {_HIT} SELECT * FROM hit")(lambda s, d: dc.against_truth(truth(s, d), predicted(s, d)))
query("a47_accuracy", f"WITH {_TP}, {_HIT} SELECT coalesce(field, 'overall') AS field, sum(match::INT)::BIGINT AS hits, count(*) AS trials, round(sum(match::INT) / count(*)::DOUBLE * 100, 1) AS accuracy FROM hit GROUP BY GROUPING SETS ((field), ())")(lambda s, d: dc.accuracy(dc.against_truth(truth(s, d), predicted(s, d))))
_MODE = """CASE WHEN coalesce(trim(predicted), '') = '' THEN 'empty' WHEN expected IS NULL THEN 'unknown' WHEN field IN ('percentage', 'cgpa') THEN CASE WHEN abs(try_cast(predicted AS DOUBLE) - try_cast(expected AS DOUBLE)) <= 3 THEN 'near_miss' WHEN regexp_matches(predicted, '[0-9]') THEN 'invalid' ELSE 'wrong' END
  WHEN upper(trim(predicted)) = upper(trim(expected)) THEN 'correct' WHEN len(list_intersect(list_filter(regexp_split_to_array(upper(expected), '\\s+'), lambda x: x <> ''), list_filter(regexp_split_to_array(upper(predicted), '\\s+'), lambda x: x <> ''))) > 0 THEN 'near_miss' ELSE 'wrong' END"""
query("r20_failure_modes", f"WITH {_TP} SELECT file, field, {_MODE} AS mode FROM tp")(lambda s, d: truth(s, d).join(predicted(s, d), ["file", "field"], "left").select("file", "field", dc.failure_mode(F.col("field"), F.col("predicted"), F.col("expected")).alias("mode")))
query("u5_shared_words", "SELECT c_custkey AS id, array_to_string(list_sort(list_intersect(string_split(upper(c_name || ' of ' || c_mktsegment), ' '), string_split(upper('of the ' || c_mktsegment), ' '))), ',') AS words FROM customer")(
    lambda s, d: lt.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.array_join(F.array_sort(dc.shared_words(F.concat_ws(" of ", "c_name", "c_mktsegment"), F.concat(F.lit("of the "), F.col("c_mktsegment")))), ",").alias("words")))
_REGION = {"candidate_name": "candidate_zone", "percentage": "summary_zone", "cgpa": "summary_zone", "result": "summary_zone", "grade_class": "summary_zone", "board_university": "header_zone", "passing_year": "header_zone"}
query("a45_region_heatmap", f"SELECT CASE field {' '.join(f'''WHEN '{f}' THEN '{r}' ''' for f, r in _REGION.items())} ELSE 'unknown_zone' END AS region, count(*) AS failures FROM ({rq._TRIALS}) WHERE NOT correct GROUP BY 1")(lambda s, d: dc.region_heatmap(rq.trials(s, d).where("NOT correct")))
_CL = f"SELECT transform, field, mode, count(*) AS n, min(severity) AS low, max(severity) AS high FROM ({rq._TRIALS}) WHERE NOT correct GROUP BY 1, 2, 3 HAVING count(*) >= 2"
_HM = f"SELECT region, failures FROM ({SQL['a45_region_heatmap']})"
query("r20_recommendations", f"""SELECT 'cluster' AS source, field || ':' || transform AS subject, CASE mode WHEN 'empty' THEN 'widen_fallback_crop' WHEN 'near_miss' THEN 'expand_character_table' WHEN 'invalid' THEN 'prefer_adaptive_threshold' ELSE 'review_spatial_anchors' END AS advice, n::DOUBLE AS measure FROM (SELECT * FROM ({_CL}) ORDER BY n DESC, transform, field, mode LIMIT 5)
  UNION ALL SELECT 'region', region, 'preprocess_zone', failures::DOUBLE FROM (SELECT * FROM ({_HM}) ORDER BY failures DESC, region LIMIT 2) WHERE failures > 5
  UNION ALL SELECT 'transform', transform, 'restore_scan', score FROM (SELECT transform, round(avg(correct::INT) * 100, 2) AS score FROM ({rq._TRIALS}) GROUP BY 1 ORDER BY 2, 1 LIMIT 3) WHERE score < 60""")(lambda s, d: dc.recommendations(rq.trials(s, d)))

# Bundles, exports and alerts
query("a35_client_summary", w(f"""{rq._LADDER} SELECT count(*) AS total, count(*) FILTER (aadhaar AND pan) AS clean, count(*) FILTER (NOT aadhaar) AS missing_aadhaar, count(*) FILTER (NOT pan) AS missing_pan, count(*) FILTER (t OR h OR g) AS with_academic,
  round(avg(nullif(best_pct, 0)) + 1e-9, 1) AS average_percentage, round(avg(nullif(best_cgpa, 0)) + 1e-9, 2) AS average_cgpa, count(*) FILTER (best_pct >= 75) AS above_75, count(*) FILTER (best_pct <> 0 AND best_pct < 60) AS below_60 FROM lp""", "users", "reviews"))(lambda s, d: dc.client_summary(rq.ladder_profiles(s, d)))
query("a35_audit_counts", w("SELECT count(*) AS total, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (reviewer_id IS NULL) AS system FROM reviews", "reviews"))(
    lambda s, d: lt.reviews(s, d).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "approved").alias("approved"), F.count_if(F.col("status") == "rejected").alias("rejected"), F.count_if(F.col("reviewer_id").isNull()).alias("system")))


# Series and measures of a bundle; the rows of all are put together
_TRENDS = (("upload_volume", "a8_daily_counts_30", "date", ("count",)), ("review_load", "a11_reviews_created", "date", ("count",)), ("fraud_rate", "a12_fraud_rate_trend", "date", ("total", "high_risk", "fraud_rate_pct")), ("ocr_confidence", "a13_confidence_trend", "date", ("avg_confidence", "sample_count")))
_FRAUD = (("risk_distribution", "a15_risk_distribution", "risk_level", ("n", "pct")), ("top_risky_users", "w9_top_risky_users", "user_id", ("risk_score",)), ("fraud_trend", "a17_risk_trend", "date", ("total", "high_risk", "avg_risk_score")), ("duplicate_trend", "a16_duplicate_trend", "date", ("duplicate_count",)), ("quality_trend", "a18_quality_trend", "date", ("avg_quality", "screenshot_count", "duplicate_count")))


def _bundle_sql(parts) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS series, {key}::VARCHAR AS key, '{m}' AS measure, coalesce({m}, 0)::DOUBLE AS value FROM ({SQL[of]})" for name, of, key, measures in parts for m in measures)


def _bundle(s: SparkSession, d: str, parts) -> DataFrame:
    return reduce(DataFrame.unionByName, [dc.melted(QUERIES[of](s, d), name, key, measures) for name, of, key, measures in parts])


query("a14_all_trends", _bundle_sql(_TRENDS))(lambda s, d: _bundle(s, d, _TRENDS))
query("a19_fraud_analytics", _bundle_sql(_FRAUD))(lambda s, d: _bundle(s, d, _FRAUD))


def _written(s: SparkSession, rows: DataFrame, name: str, schema: str) -> DataFrame:
    """Rows written as CSV with a header, and read back."""
    at = f"{shared_root(s)}/{name}-{uuid.uuid4().hex}"
    sinks.write_csv(rows, at)
    return s.read.option("header", True).schema(schema).csv(at)


_EXPORT = ("id", "user_id", "doc_type", "decision", "priority", "status", "ocr_confidence", "reviewer_id", "created_at", "reviewed_at")


@query("s12_review_export", w(f"SELECT {', '.join(_EXPORT[:-2])} FROM reviews WHERE status IN ('pending', 'in_review') ORDER BY priority, created_at, id LIMIT 1000", "reviews"))
def review_export(s: SparkSession, d: str) -> DataFrame:
    """The first thousand waiting reviews as CSV: the limit is that of the export."""
    rows = lt.reviews(s, d).where("status IN ('pending', 'in_review')").orderBy("priority", "created_at", "id").limit(1000).select(*_EXPORT)
    schema = "id long, user_id long, doc_type string, decision string, priority int, status string, ocr_confidence double, reviewer_id string, created_at timestamp_ntz, reviewed_at timestamp_ntz"
    return _written(s, rows, "review-export", schema).select(*_EXPORT[:-2])


query("s13_subject_export", _SUBJECTS)(lambda s, d: _written(s, dc.subjects(texts(s, d).select("id", F.col("sheet").alias("text")), "id"), "subject-export", "id long, subject string, marks_obtained double, marks_total double, grade string"))
query("s19_known_users", w("SELECT id, full_name, id IN (SELECT user_id FROM identities WHERE aadhaar_number LIKE '%2%') AS known FROM users", "users", "identities"))(lambda s, d: dc.known(lt.users(s, d), lt.identities(s, d).where(F.contains("aadhaar_number", F.lit("2")))))
query("s11_csv_rows", w("SELECT id, full_name, dob FROM users", "users"))(lambda s, d: _written(s, lt.users(s, d).select("id", "full_name", "dob"), "users", "id long, full_name string, dob string"))
query("s15_json_rows", "SELECT r_regionkey, r_name FROM region")(lambda s, d: _as_json(s, lt.table(s, d, "region").select("r_regionkey", "r_name")))


def _as_json(s: SparkSession, rows: DataFrame) -> DataFrame:
    at = f"{shared_root(s)}/json-{uuid.uuid4().hex}"
    sinks.write_json(rows, at)
    return s.read.schema(rows.schema).json(at)


@query("st8_stored_alerts", f"SELECT alert_type, severity, title, metric_value FROM ({SQL['r9_alerts']})")
def stored_alerts(s: SparkSession, d: str) -> DataFrame:
    """Alerts of anomalies that come in as a stream, appended once each, though a batch be tried again."""
    at = f"{shared_root(s)}/alerts-{uuid.uuid4().hex}"
    found = rq.found_anomalies(s, d)
    found.write.parquet(f"{at}/in")
    stream = jobs.read_files(s, f"{at}/in", s.read.parquet(f"{at}/in").schema)
    jobs.run_once(rules.alerts(stream), f"{at}/state", jobs.append_new(f"{at}/out", ["alert_type"]))
    remove(s, f"{at}/in", f"{at}/state")
    return s.read.parquet(f"{at}/out").select("alert_type", "severity", "title", "metric_value")


# Fields of marksheets
MARKSHEETS = [
    "MAHARASHTRA STATE BOARD OF SECONDARY EDUCATION\nCandidate's Name: ASHA RAO\nMother's Name: MEERA\nSeat No: A12345\nMarch, 2019\nTotal Marks: 500\nObtained: 412\nPercentage: 82.40\nFirst Class\nResult PASS",
    "CBSE delhi\nName of the Candidate - RAVI  KUMAR\nRoll No. : 998877\nCertificate No: CERT-2020\nSchool Code: SC12\nexamination 2020\nMarks: 300 out of 650\nscience stream\nFailed",
    "Some State Board\nname: ZED ALI\nyear: 2018\nsecond division grade : b+ DOB: 01/02/2001\nGrand Total: 99\nMaximum Marks: 90",
    "Pune Central University of Arts\nStudent Name: MINA SEN\nPRN: 2019ABC123\nB.Tech programme: Computer Science\nSem I : SGPA 8.25\nSemester 2 SGPA: 7.50\nSem ii 9.10 SGPA\nfirst class with distinction",
    "University of Mumbai,\nEnrollment No: EN998877\nM.Sc. department of Physics\nCGPA: 8.74\nSemester xi 9.99 Sem 3: 11.50\naverage passed in 2021",
    "Name of Student: LEE\nstream: Fine Things\nborn on - 1.2.99\nnothing else 1985",
    None,
    "",
]
_MS = "ms AS (SELECT o_orderkey AS id, " + _sql_pick("o_orderkey", MARKSHEETS).replace("\n", "' || chr(10) || '") + " AS t FROM orders)"


def _anchor_sql(patterns) -> str:
    return "coalesce(" + ", ".join("nullif(regexp_replace(regexp_extract(t, '(?i){}', 1), '^\\s+|\\s+$', '', 'g'), '')".format(p.replace("'", "''")) for p in patterns) + ")"


def _named_sql(phrases) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(t, '(?i){p}') THEN '{n}'" for p, n in phrases) + " END"


def _title_sql(x: str) -> str:
    return f"array_to_string(list_transform(string_split(lower(regexp_replace({x}, '\\s+', ' ', 'g')), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ')"


_PCT_SQL = "coalesce(" + ", ".join(f"CASE WHEN try_cast(nullif(regexp_extract(t, '{p}', 1), '') AS DOUBLE) <= 100 THEN round(try_cast(nullif(regexp_extract(t, '{p}', 1), '') AS DOUBLE), 2) END" for p in sc.PERCENTAGES) + ")"
_A = {f: _anchor_sql(p) for f, p in mk.SCHOOL.items()}
query("r19_school_fields", f"""WITH {_MS}, a AS (SELECT id, t, {_title_sql(_A['candidate_name'])} AS candidate_name, {_title_sql(_A['mother_name'])} AS mother_name, {_A['seat_number']} AS seat_number, {_A['certificate_no']} AS certificate_no, {_title_sql(_A['board'])} AS board, {_A['school_number']} AS school_number, {_A['passing_year']}::INT AS passing_year,
    {_A['total_marks']}::DOUBLE AS total_marks, {_A['obtained_marks']}::DOUBLE AS obtained_marks, {_title_sql(_A['division'])} AS division, {_A['dob']} AS dob, {_PCT_SQL} AS p FROM ms)
  SELECT * EXCLUDE (t, p), coalesce(CASE WHEN p > 0 THEN p END, CASE WHEN total_marks > 0 AND obtained_marks <= total_marks THEN round(obtained_marks / total_marks * 100, 2) END, p) AS percentage, coalesce({_named_sql(mk.GRADES)}, upper(nullif(regexp_extract(t, '{mk.GRADE_LETTER}', 1), ''))) AS grade, {_named_sql(mk.RESULTS)} AS result, coalesce({_named_sql(mk.STREAMS)}, {_title_sql(_anchor_sql((mk.STREAM.removeprefix('(?i)'),)))}) AS stream FROM a""")(
    lambda s, d: _marksheets(s, d).select("id", *[x.alias(f) for f, x in mk.school_fields(F.col("t")).items()]))
_B = {f: _anchor_sql(p) for f, p in mk.DEGREE.items()}
_TERM = f"list_transform(regexp_extract_all(t, '{mk.SEMESTER}', 0), lambda m: {{'s': coalesce(try_cast(lower(regexp_extract(m, '{mk.SEMESTER}', 1)) AS INT), list_position({list(mk.ROMAN)}, lower(regexp_extract(m, '{mk.SEMESTER}', 1))), 0), 'g': regexp_extract(m, '{mk.SEMESTER}', 2)::DOUBLE}})"
query("r19_degree_fields", f"""WITH {_MS}, a AS (SELECT id, t, {_title_sql(_B['student_name'])} AS student_name, {_B['prn']} AS prn, {_B['seat_number']} AS seat_number, {_title_sql(_B['university'])} AS university, replace(upper({_B['degree_name']}), '.', '') AS degree_name, {_title_sql(_B['course_name'])} AS course_name, {_B['passing_year']}::INT AS passing_year, {_PCT_SQL} AS p, try_cast(nullif(regexp_extract(t, '{sc.CGPA}', 1), '') AS DOUBLE) AS c, list_filter({_TERM}, lambda x: x.g <= 10) AS terms FROM ms),
  e AS (SELECT id, s, arg_min(g, i) AS g FROM (SELECT id, unnest(terms).s AS s, unnest(terms).g AS g, generate_subscripts(terms, 1) AS i FROM a) GROUP BY 1, 2), f AS (SELECT id, string_agg(s || ':' || g, ',' ORDER BY s) AS semesters, round(avg(g) FILTER (g <> 0), 2) AS mean FROM e GROUP BY 1),
  h AS (SELECT a.*, coalesce(semesters, '') AS sem, coalesce(CASE WHEN c <> 0 AND c <= 10 THEN round(c, 2) END, mean) AS cgpa FROM a LEFT JOIN f USING (id))
  SELECT id, student_name, prn, seat_number, university, degree_name, course_name, passing_year, cgpa, coalesce(nullif(p, 0), round(cgpa / 10.0::DOUBLE * 100, 2)) AS aggregate_percentage, {_named_sql(mk.CLASSES)} AS result_class, {_named_sql(mk.DEGREE_GRADES)} AS grade, CASE WHEN t IS NOT NULL THEN sem END AS semesters FROM h""")(
    lambda s, d: _marksheets(s, d).select("id", *[x.alias(f) for f, x in mk.degree_fields(F.col("t")).items()]))


def _marksheets(s: SparkSession, d: str) -> DataFrame:
    return lt.table(s, d, "orders").select(_key().alias("id"), _pick(_key(), MARKSHEETS).alias("t"))
