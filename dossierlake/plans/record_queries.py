"""Queries over field validation, healing, corrections, fraud components and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlake.functions import correction as co
from dossierlake.functions import fraud as fr
from dossierlake.functions import scores as sc
from dossierlake.functions import validation as v
from dossierlake.operators import healing as hl
from dossierlake.plans import rule_queries as rq
from dossierlake.plans._registry import SQL, query
from dossierlake.sources import logical as lt
from dossierlake.sources.logical import ORDERS_AS_OF as O_AT
from dossierlake.sources.logical import with_tables as w

# What was read of each document, by field: (multiplier, values); a document has one of each, chosen by its key.
READ = {
    "name": (1, ["Asha Rao", "RAVI KUMAR", "xkcdwrtf", "H225007404", "12345", "University of X", "Ab", "R4v1 K3m4r", "", None, "O'Neil  Devi", "CS205008392", "----", "Meera Shah Patil"]),
    "percentage": (3, ["82.40", "71 33 PASS", "7517", "£ 82.40", "H225007404", "105.5", "3713399945898", "9I.5", "71", "abc", "S5.20%", "8 5", None, "407+05", "99 101", "1.2.3"]),
    "cgpa": (5, ["8.5", "895", "9.1 PASS", "11.2", None, "O", "7 25", "B.4"]),
    "year": (7, ["2019", "March 2021", "1979", "20", None, "2036", "Z019"]),
    "result": (11, ["PASS", "First Class with marks", "pass", "unknown", None, "DISTINCTION"]),
    "obtained_marks": (13, ["407+05", "412", "£407", "5", None, "3l2", "600", "99999", "4O0 of 500"]),
    "total_marks": (17, ["500", "650", "6000", None, "S00", "£ 500", "0", "1200"]),
}


def _key() -> Column:
    return F.col("o_orderkey")


def _pick(key: Column, values: list) -> Column:
    return F.get(F.array(*[F.lit(x) for x in values]), (key % len(values)).cast("int"))


def _sql_pick(key: str, values: list) -> str:
    quoted = ", ".join("NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'" for x in values)
    return f"([{quoted}])[({key} % {len(values)}) + 1]"


def readings(s: SparkSession, d: str) -> DataFrame:
    """(id, field, value, confidence); documents of keys divisible by 9 have no percentage."""
    rows = [F.struct(F.lit(f).alias("field"), _pick(F.floor(_key() / m), values).alias("value"), (_key() * m % 97 / F.lit(97.0)).alias("confidence")) for f, (m, values) in READ.items()]
    x = lt.table(s, d, "orders").select(_key().alias("id"), F.inline(F.array(*rows)))
    return x.where(~((F.col("id") % 9 == 0) & (F.col("field") == "percentage")))


_READ = "rd AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT o_orderkey AS id, '{f}' AS field, {_sql_pick(f'(o_orderkey // {m})', values)} AS value, (o_orderkey * {m} % 97) / 97.0::DOUBLE AS confidence FROM orders" for f, (m, values) in READ.items()) + ") WHERE NOT (id % 9 = 0 AND field = 'percentage'))"


def _serial(x: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, '{p}')" for p in v.SERIALS) + ")"


_RX = "regexp_extract"
_UNREAL = f"""un AS (SELECT *, value IS NOT NULL AND (confidence < 0.15 OR (length(v) > 3 AND NOT regexp_matches(v, '[\\p{{L}}\\p{{N}}]')) OR coalesce(CASE field
  WHEN 'percentage' THEN {_serial('v')} OR regexp_matches(v, '^[0-9]{{4,}}') OR coalesce(try_cast(regexp_replace(v, '[^0-9.]', '', 'g') AS DOUBLE) > 100, false)
  WHEN 'total_marks' THEN coalesce(try_cast(regexp_replace(v, '[^0-9]', '', 'g') AS DOUBLE) > 5000, false)
  WHEN 'name' THEN (length(v) > 6 AND NOT regexp_matches(v, '[AEIOUaeiou]')) OR regexp_matches(replace(v, ' ', ''), '^[0-9]+$') OR {_serial("replace(v, ' ', '')")} ELSE false END, false)) AS unreal FROM (SELECT *, trim(value) AS v FROM rd))"""
_MEND = f"""m1 AS (SELECT *, translate(v, 'SsOolI|?ZzBG', '550011172286') AS t FROM un), m2 AS (SELECT *, trim(regexp_replace(t, '[£$€₹%]', '', 'g')) AS b, trim(regexp_replace(t, '^[£$€₹]\\s*', '')) AS q FROM m1),
  m3 AS (SELECT *, CASE WHEN regexp_matches(b, '^[0-9]+\\s+[0-9]+(\\s|$)') THEN CASE WHEN try_cast({_RX}(b, '^([0-9]+)\\s+([0-9]+)', 1) || '.' || {_RX}(b, '^([0-9]+)\\s+([0-9]+)', 2) AS DOUBLE) <= 100 THEN {_RX}(b, '^([0-9]+)\\s+([0-9]+)', 1) || '.' || {_RX}(b, '^([0-9]+)\\s+([0-9]+)', 2) ELSE b END
    WHEN regexp_matches(b, '^[0-9]+\\s') THEN {_RX}(b, '^([0-9]+)', 1) ELSE b END AS f1,
    CASE WHEN regexp_matches(q, '^[0-9]{{2,4}}\\s*\\+\\s*[0-9]{{1,3}}$') THEN ({_RX}(q, '^([0-9]+)', 1)::INT + {_RX}(q, '\\+\\s*([0-9]+)$', 1)::INT)::VARCHAR ELSE q END AS g FROM m2),
  m4 AS (SELECT *, regexp_replace(f1, '^([0-9]{{2}})([0-9]{{2}})$', '\\1.\\2') AS f2 FROM m3),
  m5 AS (SELECT *, CASE WHEN field IN ('cgpa', 'spi') THEN regexp_replace(f2, '^([0-9])([0-9]{{2}})$', '\\1.\\2') WHEN field = 'percentage' THEN f2 WHEN regexp_matches(g, '^[0-9]{{2,4}}') THEN {_RX}(g, '^([0-9]{{2,4}})', 1) ELSE g END AS fixed FROM m4),
  m6 AS (SELECT *, NOT unreal AND field IN ('percentage', 'cgpa', 'spi', 'total_marks', 'obtained_marks') AND value IS NOT NULL AS mend FROM m5), m7 AS (SELECT *, CASE WHEN mend THEN fixed ELSE value END AS mended, mend AND fixed <> v AS repaired FROM m6)"""
_PCT = "\\b([0-9]{1,3})(?:[.\\s]([0-9]{1,2}))?\\b"
_VALID = f"""v1 AS (SELECT *, trim(coalesce(mended, 'None')) AS nm, trim(replace(trim(mended), '%', '')) AS pc FROM m7),
  v2 AS (SELECT *, coalesce(NOT unreal AND CASE WHEN field = 'name' THEN confidence >= 0.25 AND nm <> '' AND NOT regexp_matches(lower(nm), '{"|".join(v.ORGANISATIONS)}') AND len(regexp_extract_all(nm, '[0-9]')) <= 2 AND length(replace(nm, ' ', '')) >= 3
    WHEN field = 'percentage' THEN NOT regexp_matches(pc, '(?i)[A-Z][0-9]{{6,}}') AND NOT regexp_matches(pc, '[0-9]{{8,}}') AND regexp_matches(pc, '{_PCT}') AND try_cast({_RX}(pc, '{_PCT}', 1) || '.' || CASE {_RX}(pc, '{_PCT}', 2) WHEN '' THEN '0' ELSE {_RX}(pc, '{_PCT}', 2) END AS DOUBLE) <= 100
    WHEN field = 'cgpa' THEN try_cast(nullif({_RX}(mended, '[0-9]{{1,2}}(?:\\.[0-9]{{1,2}})?'), '') AS DOUBLE) <= 10 WHEN field = 'year' THEN try_cast(nullif({_RX}(mended, '[0-9]{{4}}'), '') AS INT) BETWEEN 1980 AND 2035
    WHEN field = 'result' THEN regexp_matches(upper(mended), '{"|".join(v.RESULTS)}') ELSE regexp_matches(trim(regexp_replace(trim(mended), '[£$+][0-9]+', '', 'g')), '[0-9]{{2,4}}') END, false) AS validated FROM v1),
  hl AS (SELECT id, field, value AS original, CASE WHEN validated THEN mended END AS value, validated, repaired, 'initial' AS strategy, confidence AS c0,
    greatest(0.0, least(1.0, CASE WHEN repaired THEN (confidence + 0.9::DOUBLE) / 2 ELSE confidence END + CASE WHEN validated THEN 0.1::DOUBLE ELSE -0.3::DOUBLE END)) AS confidence FROM v2)"""
_HEALED = f"{_READ}, {_UNREAL}, {_MEND}, {_VALID}"
_WIDE = "wd AS (SELECT id, {0} FROM hl GROUP BY id)".format(", ".join(f"max(CASE WHEN field = '{f}' THEN value END) AS {f}" for f in ("percentage", "cgpa", "obtained_marks", "total_marks")))
_MADE = "CASE WHEN try_cast(total_marks AS DOUBLE) > 0 AND try_cast(obtained_marks AS DOUBLE) <= try_cast(total_marks AS DOUBLE) THEN round(try_cast(obtained_marks AS DOUBLE) / try_cast(total_marks AS DOUBLE) * 100, 2) END"
_RECOVERED = f"""{_HEALED}, {_WIDE}, md AS (SELECT id, {_MADE} AS made FROM wd), rc AS (SELECT hl.*, made, field = 'percentage' AND made IS NOT NULL AND (value IS NULL OR NOT validated) AS take FROM hl JOIN md USING (id)),
  al AS (SELECT id, field, original, CASE WHEN take THEN made ELSE try_cast(value AS DOUBLE) END AS number, CASE WHEN take THEN NULL ELSE value END AS text, CASE WHEN take THEN 0.99 ELSE confidence END AS confidence, validated OR take AS validated, repaired OR take AS repaired, CASE WHEN take THEN 'mathematical_recovery' ELSE strategy END AS strategy FROM rc
    UNION ALL SELECT id, 'percentage', NULL, made, NULL, 0.99, true, true, 'mathematical_recovery' FROM md WHERE made IS NOT NULL AND id NOT IN (SELECT id FROM hl WHERE field = 'percentage'))"""


def _shown(x: DataFrame) -> DataFrame:
    """Recovered values as numbers, as engines write them differently."""
    made = F.col("strategy") == "mathematical_recovery"
    return x.select("id", "field", "original", F.col("value").try_cast("double").alias("number"), F.when(~made, F.col("value")).alias("text"), F.round("confidence", 6).alias("confidence"), "validated", "repaired", "strategy")


query("x26_hallucinations", f"WITH {_READ}, {_UNREAL} SELECT id, field, unreal FROM un")(lambda s, d: readings(s, d).select("id", "field", v.hallucinated(F.col("field"), F.col("value"), F.col("confidence")).alias("unreal")))
query("x15_repaired_numbers", f"WITH {_READ}, {_UNREAL}, {_MEND} SELECT id, field, fixed FROM m5 WHERE field IN ('percentage', 'cgpa', 'total_marks', 'obtained_marks')")(
    lambda s, d: readings(s, d).where(F.col("field").isin(*v.NUMBERS)).select("id", "field", v.repaired_number(F.col("field"), F.col("value")).alias("fixed")))
query("x14_plausible_values", f"WITH {_READ}, un AS (SELECT *, trim(value) AS v, false AS unreal FROM rd), m7 AS (SELECT *, value AS mended, false AS repaired FROM un), {_VALID} SELECT id, field, validated FROM hl")(
    lambda s, d: readings(s, d).select("id", "field", v.valid_value(F.col("field"), F.col("value"), F.col("confidence")).alias("validated")))
query("r11_healed_fields", f"WITH {_RECOVERED} SELECT id, field, original, number, text, round(confidence, 6) AS confidence, validated, repaired, strategy FROM al")(lambda s, d: _shown(hl.recover(hl.heal(readings(s, d)))))
query("m14_recovered_percentages", f"WITH {_RECOVERED} SELECT id, number AS percentage FROM al WHERE strategy = 'mathematical_recovery'")(
    lambda s, d: hl.recover(hl.heal(readings(s, d))).where("strategy = 'mathematical_recovery'").select("id", F.col("value").cast("double").alias("percentage")))
_NUM = "try_cast(nullif(regexp_extract({0}, '[0-9]+(?:\\.[0-9]+)?'), '') AS DOUBLE)"
query("m13_inconsistencies", f"""WITH {_HEALED}, {_WIDE}, nn AS (SELECT id, {_NUM.format('percentage')} AS p, {_NUM.format('cgpa')} AS c, {_NUM.format('obtained_marks')} AS o, {_NUM.format('total_marks')} AS t FROM wd)
  SELECT id, concat_ws(',', CASE WHEN p <= 10 AND c <= 10 THEN 'percentage_and_grade_on_one_scale' END, CASE WHEN o > t THEN 'obtained_exceeds_total' END, CASE WHEN t > 0 AND abs(o / nullif(t, 0) * 100 - p) > 1 THEN 'percentage_disagrees_with_marks' END) AS warnings FROM nn""")(
    lambda s, d: hl.inconsistent(hl.heal(readings(s, d))).select("id", F.concat_ws(",", "warnings").alias("warnings")))

_NUMBERS_SQL = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 8 <> 0 THEN o_orderkey * 7 % 700 - 5 END AS o, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey * 3 % 650 - 2 END AS t, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 120 - 3 END AS p, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey % 150 + 1930 END AS y, CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 130) / 10.0::DOUBLE - 1 END AS c, o_orderkey % 3 = 0 AS degree, CASE WHEN o_orderkey % 7 > 2 THEN 'A' END AS grade, CASE WHEN o_orderkey % 11 > 3 THEN 'PASS' END AS result FROM orders"


def numbers(s: SparkSession, d: str) -> DataFrame:
    values = {"obtained": _key() * 7 % 700 - 5, "total": _key() * 3 % 650 - 2, "percentage": _key() % 120 - 3, "year": _key() % 150 + 1930, "cgpa": _key() % 130 / F.lit(10.0) - 1}
    gaps = {"obtained": 8, "total": 9, "percentage": 5, "year": 6, "cgpa": 4}
    return lt.table(s, d, "orders").select(_key().alias("id"), *[F.when(_key() % gaps[c] != 0, x).alias(c) for c, x in values.items()], F.when(_key() % 3 == 0, "degree").otherwise("ssc").alias("doc_type"), F.when(_key() % 7 > 2, "A").alias("grade"), F.when(_key() % 11 > 3, "PASS").alias("result"))


query("m10_mark_warnings", f"""SELECT id, concat_ws(',', CASE WHEN o > t THEN 'obtained_exceeds_total' END, CASE WHEN o IS NOT NULL AND t <= 0 THEN 'total_invalid' END, CASE WHEN t IS NOT NULL AND o < 0 THEN 'obtained_negative' END,
  CASE WHEN p < 0 OR p > 100 THEN 'percentage_out_of_range' END, CASE WHEN y < 1950 OR y > 2027 THEN 'year_unrealistic' END, CASE WHEN degree AND (c < 0 OR c > 10) THEN 'cgpa_out_of_range' END) AS warnings FROM ({_NUMBERS_SQL})""")(
    lambda s, d: numbers(s, d).select("id", F.concat_ws(",", v.mark_warnings(*[F.col(c) for c in ("doc_type", "obtained", "total", "percentage", "year", "cgpa")], 2026)).alias("warnings")))
query("m15_kept_scores", f"""SELECT id, c AS cgpa, CASE WHEN c IS NULL THEN p END AS percentage, grade, result, CASE WHEN k THEN o END AS obtained_marks, CASE WHEN k THEN t END AS total_marks,
  CASE WHEN c IS NOT NULL THEN 'CGPA' WHEN p IS NOT NULL THEN 'PERCENTAGE' WHEN grade IS NOT NULL THEN 'GRADE' WHEN result IS NOT NULL THEN 'RESULT' WHEN o IS NOT NULL THEN 'MARKS' END AS primary_score FROM (SELECT *, c IS NULL AND p IS NULL AND grade IS NULL AND result IS NULL AS k FROM ({_NUMBERS_SQL}))""")(
    lambda s, d: numbers(s, d).select("id", *[x.alias(n) for n, x in v.kept_scores(*[F.col(c) for c in ("cgpa", "percentage", "grade", "result", "obtained", "total")]).items()]))
_DAMAGED = ["75,17", "(82.4%)", "7S 17", "7517", "854", "10000", "T5.5", "1.2.3", "", "abc", "100.01", None, " 9O.5 % ", "12345", "0", "8..25"]
_CLEAN = "trim(regexp_replace(regexp_replace(trim(trim(trim(raw), '%')), '^\\(+', ''), '\\)+$', ''))"
_LETTERS = "translate({0}, '" + "', '".join(v.RECOVERED_DIGITS) + "')"
query("m16_recovered_readings", f"""WITH a AS (SELECT o_orderkey AS id, {_sql_pick('o_orderkey', _DAMAGED)} AS raw FROM orders), b AS (SELECT id, replace({_CLEAN}, ',', '.') AS x FROM a),
  c AS (SELECT id, regexp_replace(regexp_replace({_LETTERS.format("regexp_replace(x, '([0-9])\\s+([0-9])', '\\1.\\2', 'g')")}, '[^0-9.]', '', 'g'), '\\.{{2,}}', '.', 'g') AS p, regexp_replace(regexp_replace({_LETTERS.format('x')}, '[^0-9.]', '', 'g'), '\\.{{2,}}', '.', 'g') AS g FROM b),
  e AS (SELECT id, try_cast(regexp_replace(regexp_replace(p, '^([0-9]{{2}})([0-9]{{1,2}})$', '\\1.\\2'), '^([0-9]{{3}})([0-9]{{2}})$', '\\1.\\2') AS DOUBLE) AS p, try_cast(regexp_replace(g, '^([0-9])([0-9]{{2}})$', '\\1.\\2') AS DOUBLE) AS g FROM c)
  SELECT id, CASE WHEN p > 0 AND p <= 100 THEN round(p, 2) END AS percentage, CASE WHEN g > 0 AND g <= 10 THEN round(g, 2) END AS cgpa FROM e""")(
    lambda s, d: lt.table(s, d, "orders").select(_key().alias("id"), _pick(_key(), _DAMAGED).alias("raw")).select("id", v.recovered_percentage(F.col("raw")).alias("percentage"), v.recovered_grade(F.col("raw")).alias("cgpa")))

# Confidence of whole documents
_FORMS = {
    "candidate_name": ["Asha Rao", "RAVI KUMAR", "Meera Shah Patil", "Al", "", None, "a b c d"],
    "board_university": ["State Board", "XY", None, "  x "],
    "passing_year": ["2019", "1995", "1970", "x", None],
    "percentage": ["82.4", "22", "5", "abc", None, ""],
    "cgpa": ["8.2", "4", "11", None, "x"],
    "grade_class": ["A+", None, "First Class"],
    "result": ["PASS", None, "P"],
}


def forms(s: SparkSession, d: str) -> DataFrame:
    return lt.table(s, d, "orders").select(_key().alias("id"), *[_pick(F.floor(_key() / (i + 1)), values).alias(f) for i, (f, values) in enumerate(_FORMS.items())], (_key() % 130 / F.lit(100.0)).alias("ocr"))


_D = "try_cast({0} AS DOUBLE)"
_FIELD_SQL = {
    "candidate_name": "least(0.5 + CASE WHEN n >= 3 THEN 0.2 WHEN n = 2 THEN 0.1 ELSE 0 END + CASE WHEN candidate_name IN ('Asha Rao', 'Meera Shah Patil', 'Al') THEN 0.15 ELSE 0 END + CASE WHEN length(candidate_name) BETWEEN 10 AND 50 THEN 0.15 ELSE 0 END, 1.0)::DOUBLE",
    "percentage": "CASE WHEN {0} BETWEEN 35 AND 100 THEN 0.95 WHEN {0} BETWEEN 10 AND 35 THEN 0.75 WHEN {0} IS NOT NULL THEN 0.5 ELSE 0.0 END".format(_D.format("percentage")),
    "cgpa": "CASE WHEN {0} BETWEEN 5 AND 10 THEN 0.95 WHEN {0} >= 0 AND {0} < 5 THEN 0.75 WHEN {0} IS NOT NULL THEN 0.5 ELSE 0.0 END".format(_D.format("cgpa")),
    "passing_year": "CASE WHEN {0} BETWEEN 2000 AND 2030 THEN 1.0 WHEN {0} >= 1980 AND {0} < 2000 THEN 0.85 WHEN {0} IS NOT NULL THEN 0.6 ELSE 0.0 END".format("try_cast(passing_year AS INT)"),
} | {f: f"CASE WHEN length(trim({f})) > 2 THEN 0.85 ELSE 0.5 END" for f in ("board_university", "grade_class", "result")}
_SCORES = ", ".join(f"CASE WHEN {f} = '' THEN 0.0 ELSE round({_FIELD_SQL[f]}::DOUBLE, 3) END AS s_{f}" for f in _FORMS)
_W = v.FIELD_WEIGHTS
query("m11_overall_confidence", f"""WITH a AS (SELECT o_orderkey AS id, {', '.join(f"{_sql_pick(f'(o_orderkey // {i + 1})', values)} AS {f}" for i, (f, values) in enumerate(_FORMS.items()))}, (o_orderkey % 130) / 100.0::DOUBLE AS ocr FROM orders),
  b AS (SELECT *, len(list_filter(regexp_split_to_array(candidate_name, '\\s+'), lambda x: x <> '')) AS n FROM a), c AS (SELECT *, {_SCORES} FROM b),
  e AS (SELECT *, 0.0::DOUBLE + {' + '.join(f'CASE WHEN {f} IS NOT NULL THEN {_W[f]}::DOUBLE ELSE 0.0::DOUBLE END' for f in _W)} AS wt, 0.0::DOUBLE + {' + '.join(f'CASE WHEN {f} IS NOT NULL THEN s_{f} * {_W[f]}::DOUBLE ELSE 0.0::DOUBLE END' for f in _W)} AS sm, {' + '.join(f'({f} IS NOT NULL)::INT' for f in _W)} AS fields_found FROM c),
  f AS (SELECT *, round(CASE WHEN wt > 0 THEN sm / wt ELSE 0.0::DOUBLE END * 0.70::DOUBLE + least(ocr, 1.0::DOUBLE) * 0.30::DOUBLE + 1e-9, 3) AS overall FROM e)
  SELECT id, overall, CASE WHEN overall >= 0.70 THEN 'high' WHEN overall >= 0.45 THEN 'medium' WHEN overall >= 0.20 THEN 'low' ELSE 'insufficient' END AS grade, fields_found, round(fields_found / 7.0::DOUBLE, 2) AS coverage FROM f""")(
    lambda s, d: forms(s, d).select("id", *[x.alias(n) for n, x in v.overall_confidence({f: F.col(f) for f in _FORMS}, F.col("ocr")).items()]))
_STATED = ["Percentage: 82.456 %", "scored 75 % in all", "aggregate 640 marks", "Aggregate % : 61.2", "percent-71", "none", "percentage 150 then 45.50 pct", "CGPA: 8.74 SGPA 7.5 sem gpa - 9.25 sgpa: 12", ""]
query("m9_stated", f"""WITH a AS (SELECT o_orderkey AS id, {_sql_pick('o_orderkey', _STATED)} AS x FROM orders), b AS (SELECT id, x, {', '.join(f"try_cast(nullif({_RX}(x, '{p}', 1), '') AS DOUBLE) AS p{i}" for i, p in enumerate(sc.PERCENTAGES))}, try_cast(nullif({_RX}(x, '{sc.CGPA}', 1), '') AS DOUBLE) AS g FROM a)
  SELECT id, coalesce({', '.join(f'CASE WHEN p{i} <= 100 THEN round(p{i}, 2) END' for i in range(len(sc.PERCENTAGES)))}) AS percentage, CASE WHEN g <= 10 THEN round(g, 2) END AS cgpa, list_sum(list_filter(regexp_extract_all(x, '{sc.SGPA}', 1)::DOUBLE[], lambda y: y <= 10)) AS terms FROM b""")(
    lambda s, d: lt.table(s, d, "orders").select(_key().alias("id"), _pick(_key(), _STATED).alias("x")).select("id", sc.stated_percentage(F.col("x")).alias("percentage"), sc.stated_average(F.col("x")).alias("cgpa"), F.when(F.size(sc.stated_terms(F.col("x"))) > 0, F.aggregate(sc.stated_terms(F.col("x")), F.lit(0.0), lambda a, y: a + y)).alias("terms")))
query("m9_course_averages", """WITH t AS (SELECT l_orderkey AS id, (l_partkey % 11)::DOUBLE AS sgpa, CASE WHEN l_orderkey % 3 <> 0 OR l_linenumber <> 2 THEN (l_quantity % 5)::DOUBLE END AS credits FROM lineitem),
  u AS (SELECT id, count(*) AS n, count(credits) AS c, sum(sgpa) AS s, sum(sgpa * credits) AS w, sum(credits) AS k FROM t WHERE sgpa <> 0 GROUP BY 1)
  SELECT i.id, CASE WHEN n > 0 THEN round(CASE WHEN n = c AND k > 0 THEN w / k ELSE s / n END, 2) END AS average FROM (SELECT DISTINCT id FROM t) i LEFT JOIN u USING (id)""")(
    lambda s, d: lt.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct((F.col("l_partkey") % 11).cast("double").alias("sgpa"), F.when((F.col("l_orderkey") % 3 != 0) | (F.col("l_linenumber") != 2), (F.col("l_quantity") % 5).cast("double")).alias("credits"))).alias("terms")).select("id", sc.course_average(F.col("terms")).alias("average")))

# Corrections
_WRONG = ["Asha  Rao", "AshaRao", "asha rao", "Asha, Rao!", "Ashá Rao", "Asha Rao", "", None, "Someone Else", "asha-rao"]
_FIX = """f1 AS (SELECT *, translate(x, 'áéíóú', 'aeiou') AS a1 FROM p), f2 AS (SELECT *, regexp_replace(a1, '([a-z])([A-Z])', '\\1 \\2', 'g') AS a2 FROM f1), f3 AS (SELECT *, trim(regexp_replace(trim(regexp_replace(a2, '[^\\p{L}\\p{N}_\\s/\\-]', '', 'g')), '\\s+', ' ', 'g')) AS a3 FROM f2),
  f4 AS (SELECT *, trim(regexp_replace(a3, '\\s+', ' ', 'g')) AS a4 FROM f3), f5 AS (SELECT *, CASE lower(a4) WHEN 'asha rao' THEN 'Asha Rao' WHEN 'asharao' THEN 'Asharao' WHEN 'someone else' THEN 'Someone Else' WHEN 'asha-rao' THEN 'Asha-Rao' ELSE a4 END AS a5 FROM f4),
  f6 AS (SELECT *, concat_ws(',', CASE WHEN a1 <> x THEN 'unicode_cleanup' END, CASE WHEN a2 <> a1 THEN 'merged_word_fix' END, CASE WHEN a3 <> a2 THEN 'punctuation_cleanup' END, CASE WHEN a4 <> a3 THEN 'spacing_fix' END, CASE WHEN a5 <> a4 THEN 'capitalization_fix' END) AS applied FROM f5)"""
_WRONG_SQL = f"p AS (SELECT o_orderkey AS id, 'ASHA RAO' AS stored, {_sql_pick('o_orderkey', _WRONG)} AS x, {_sql_pick('(o_orderkey // 3)', ['MATCH', 'POSSIBLE_MATCH', 'MISMATCH', 'MISMATCH'])} AS status, (o_orderkey * 7 % 101)::DOUBLE AS score FROM orders)"


def wrong(s: SparkSession, d: str) -> DataFrame:
    return lt.table(s, d, "orders").select(_key().alias("id"), F.lit("ASHA RAO").alias("stored"), _pick(_key(), _WRONG).alias("x"), _pick(F.floor(_key() / 3), ["MATCH", "POSSIBLE_MATCH", "MISMATCH", "MISMATCH"]).alias("status"), (_key() * 7 % 101).cast("double").alias("score"))


@query("x11_fixed_values", f"WITH {_WRONG_SQL}, {_FIX} SELECT id, a5 AS fixed, CASE WHEN x IS NOT NULL THEN applied ELSE '' END AS applied FROM f6")
def fixed_values(s: SparkSession, d: str) -> DataFrame:
    value, applied = co.fixed(F.col("x"))
    return wrong(s, d).select("id", value.alias("fixed"), F.concat_ws(",", applied).alias("applied"))


def _suggested(s: SparkSession, d: str, **how) -> DataFrame:
    return wrong(s, d).select("id", co.suggestion(*[F.col(c) for c in ("stored", "x", "status", "score")], **how).alias("g")).select("id", "g.*")


_CASE = "CASE WHEN status = 'MATCH' THEN {0} WHEN coalesce(x, '') = '' THEN {1} WHEN aft > score + 3 THEN {2} WHEN status = 'POSSIBLE_MATCH' AND score >= 85 THEN {3} ELSE {4} END"
query("x12_suggestions", f"""WITH {_WRONG_SQL}, {_FIX}, g AS (SELECT *, CASE WHEN lower(stored) = lower(a5) THEN 100.0 ELSE 0.0 END AS aft FROM f6)
  SELECT id, {_CASE.format('x', 'NULL', 'a5', 'stored', 'NULL')} AS suggested_value, {_CASE.format("'no_correction'", "'manual_required'", "CASE WHEN applied = '' THEN 'spacing_fix' ELSE string_split(applied, ',')[1] END", "'ocr_typo_fix'", "'manual_required'")} AS correction_type,
  {_CASE.format('false', 'false', 'true', 'true', 'false')} AS auto_fixable, {_CASE.format('100', '0', 'aft::INT', '97', 'trunc(score)::INT')} AS confidence_after FROM g""")(lambda s, d: _suggested(s, d, similarity=co.same))
query("x12_suggestions_fuzzy")(_suggested)

# Fraud components, from measures of images
_SOFT = ["Adobe Photoshop 25", "", None, "Screenshot tool", "Camera 1.0", "paint.net", "Greenshot grab", "GIMP"]


def measures(s: SparkSession, d: str) -> DataFrame:
    k = _key()
    real = {"sharpness": k * 7 % 300, "brightness": k * 11 % 256, "contrast": k * 5 % 60, "noise": k * 3 % 20 / F.lit(100.0), "edges": k % 10 / F.lit(100.0), "entropy": k * 13 % 80 / F.lit(10.0), "glare": k * 23 % 10 / F.lit(100.0), "ela_share": k * 29 % 20 / F.lit(100.0), "ela_spread": k * 31 % 12, "contrast_share": k * 37 % 16 / F.lit(100.0), "flat_share": k * 41 % 16 / F.lit(100.0), "flat_blocks": k * 43 % 6, "edge_ratio": k * 47 % 50 / F.lit(10.0), "top_spread": k * 53 % 40, "bottom_spread": k * 59 % 40}
    sides = {"width": _pick(k, [100, 640, 1080, 1280, 856, 500]), "height": _pick(F.floor(k / 5), [140, 480, 1920, 720, 540, 900])}
    taken = F.lit(O_AT).cast("timestamp") - F.make_dt_interval((k % 4000 - 100).cast("int"))
    return lt.table(s, d, "orders").select(k.alias("id"), F.col("o_custkey").alias("user_id"), *[x.cast("double").alias(n) for n, x in real.items()], *[x.alias(n) for n, x in sides.items()], (k % 4 != 0).alias("has_exif"), (k % 3 != 0).alias("camera"), _pick(k, _SOFT).alias("software"), F.when(k % 10 != 1, taken).alias("taken"), F.when(k % 2 == 0, "PNG").otherwise("JPEG").alias("format"), (k % 5 < 3).alias("jfif"), _pick(F.floor(k / 2), [72, 96, 300, 72]).alias("dpi"), (k % 100 / F.lit(100.0)).alias("confidence"))


_MS = f"""ms AS (SELECT o_orderkey AS id, o_custkey AS user_id, o_orderkey * 7 % 300 AS sharpness, o_orderkey * 11 % 256 AS brightness, o_orderkey * 5 % 60 AS contrast, (o_orderkey * 3 % 20) / 100.0::DOUBLE AS noise, (o_orderkey % 10) / 100.0::DOUBLE AS edges, (o_orderkey * 13 % 80) / 10.0::DOUBLE AS entropy, (o_orderkey * 23 % 10) / 100.0::DOUBLE AS glare,
  (o_orderkey * 29 % 20) / 100.0::DOUBLE AS ela_share, o_orderkey * 31 % 12 AS ela_spread, (o_orderkey * 37 % 16) / 100.0::DOUBLE AS contrast_share, (o_orderkey * 41 % 16) / 100.0::DOUBLE AS flat_share, o_orderkey * 43 % 6 AS flat_blocks, (o_orderkey * 47 % 50) / 10.0::DOUBLE AS edge_ratio, o_orderkey * 53 % 40 AS top_spread, o_orderkey * 59 % 40 AS bottom_spread,
  {_sql_pick('o_orderkey', [100, 640, 1080, 1280, 856, 500])} AS width, {_sql_pick('(o_orderkey // 5)', [140, 480, 1920, 720, 540, 900])} AS height, o_orderkey % 4 <> 0 AS has_exif, o_orderkey % 3 <> 0 AS camera, lower(coalesce({_sql_pick('o_orderkey', _SOFT)}, '')) AS soft, CASE WHEN o_orderkey % 10 <> 1 THEN o_orderkey % 4000 - 100 END AS days, o_orderkey % 2 = 1 AS jpeg, o_orderkey % 5 < 3 AS jfif, {_sql_pick('(o_orderkey // 2)', [72, 96, 300, 72])} AS dpi, (o_orderkey % 100) / 100.0::DOUBLE AS confidence FROM orders)"""
_QF = (("sharpness < 30", "unusable"), ("sharpness >= 30 AND sharpness < 80", "blurry"), ("brightness < 40", "dark"), ("brightness > 220", "overexposed"), ("contrast < 20", "low_contrast"), ("noise > 0.12", "high_noise"), ("edges < 0.03", "low_edge_density"), ("entropy < 5.5", "low_entropy"), ("width < 300 OR height < 150", "very_low_resolution"), ("NOT (width < 300 OR height < 150) AND (width < 600 OR height < 300)", "low_resolution"), ("glare > 0.05", "glare_detected"))
_QS = f"""qs AS (SELECT id, concat_ws(',', {', '.join(f"CASE WHEN {c} THEN '{f}' END" for c, f in _QF)}) AS quality_flags, greatest(0, 100 - {' - '.join(f'CASE WHEN {c} THEN {fr.QUALITY_POINTS[f]} ELSE 0 END' for c, f in _QF)} - CASE WHEN sharpness >= 80 AND sharpness < 200 THEN 10 ELSE 0 END)::INT AS quality_score,
  CASE WHEN sharpness >= 200 THEN 'sharp' WHEN sharpness >= 80 THEN 'acceptable' WHEN sharpness >= 30 THEN 'blurry' ELSE 'unusable' END AS blur_class FROM ms)"""
_QG = "CASE WHEN quality_score >= 80 THEN 'EXCELLENT' WHEN quality_score >= 65 THEN 'GOOD' WHEN quality_score >= 45 THEN 'ACCEPTABLE' WHEN quality_score >= 25 THEN 'POOR' ELSE 'UNUSABLE' END"
_ED = "CASE " + " ".join(f"WHEN contains(soft, '{e}') THEN 'edited_with_{e}'" for e in fr.EDITORS) + " END"
_SCR = "CASE " + " ".join(f"WHEN width = {x} OR height = {x} THEN 'screen_resolution_dimension_{x}p'" for x in fr.SCREENS) + " END"
_MF = f"""mf AS (SELECT *, ed IS NOT NULL AND has_exif AS f1, has_exif AND ed IS NULL AND ({' OR '.join(f"contains(soft, '{x}')" for x in fr.SCREENSHOTS)}) AS f2, NOT has_exif AS f3, has_exif AND NOT camera AS f4, coalesce(has_exif AND days < 0, false) AS f5, coalesce(has_exif AND days > 1825, false) AS f6, jpeg AND jfif AS f7, jpeg AND dpi IN (72, 96) AS f8, {_SCR} AS sr,
  abs(greatest(width, height) / least(width, height)::DOUBLE - 85.6::DOUBLE / 54.0::DOUBLE) > 0.4 AS f9 FROM (SELECT *, {_ED} AS ed FROM ms)),
  mt AS (SELECT id, concat_ws(',', CASE WHEN f1 THEN ed END, CASE WHEN f2 THEN 'screenshot_software_detected' END, CASE WHEN f3 THEN 'no_exif_data' WHEN f4 THEN 'missing_camera_metadata' END, CASE WHEN f5 THEN 'future_timestamp' WHEN f6 THEN 'very_old_document_timestamp' END, CASE WHEN f7 THEN 'jfif_header_present' END, CASE WHEN f8 THEN 'low_dpi_resampled_possibly_whatsapp' END, sr, CASE WHEN f9 THEN 'non_standard_card_aspect_ratio' END) AS metadata_flags,
  least(100, f1::INT * 50 + f2::INT * 40 + f5::INT * 30 + (f3 AND NOT f7)::INT * 20 + f8::INT * 10)::INT AS metadata_score, f2::INT + f3::INT + f4::INT + (sr IS NOT NULL)::INT >= 2 AS is_screenshot FROM mf)"""
_SF = [(f"abs(width / height::DOUBLE - {x!r}::DOUBLE) < 0.02", f"screenshot_aspect_ratio_{n}") for x, n in ((16 / 9, "16_9"), (9 / 16, "9_16"), (4 / 3, "4_3"), (3 / 4, "3_4"))] + [("height > width * 1.7", "possible_phone_screenshot"), ("top_spread < 5 OR bottom_spread < 5", "uniform_border_band")]
_TF = [("ela_share > 0.10 AND ela_spread > 5", "ela_anomaly_detected"), ("contrast_share > 0.08", "local_contrast_anomaly"), ("flat_share > 0.08 AND flat_blocks >= 3", "suspicious_uniform_regions"), ("edge_ratio > 3.5 OR edge_ratio < 0.4", "edge_inconsistency")]
_TS = f"""tp AS (SELECT id, concat_ws(',', {', '.join(f"CASE WHEN {c} THEN '{f}' END" for c, f in [*_TF, *_SF])}) AS tamper_flags, {' + '.join(f'({c})::INT' for c, _ in [*_TF, *_SF])} AS nf, {' OR '.join(f'({c})' for c, _ in _SF)} AS shot,
  least(100, {' + '.join(f'CASE WHEN {c} THEN {fr.TAMPER_POINTS[f]} ELSE 0 END' for c, f in _TF)} + CASE WHEN {' OR '.join(f'({c})' for c, _ in _SF)} THEN 15 ELSE 0 END)::INT AS tamper_score FROM ms)"""


def with_quality(x: DataFrame) -> DataFrame:
    flags = fr.quality_flags(*[F.col(c) for c in ("sharpness", "brightness", "contrast", "noise", "edges", "entropy", "width", "height", "glare")])
    return x.withColumn("quality_flags", flags).withColumn("quality_score", fr.quality_score(F.col("quality_flags"), F.col("sharpness")))


def with_metadata(x: DataFrame) -> DataFrame:
    c = {n: F.col(n) for n in x.columns}
    flags = fr.metadata_flags(c["has_exif"], c["software"], c["camera"], c["taken"], F.lit(O_AT).cast("timestamp"), c["format"], c["jfif"], c["dpi"], c["width"], c["height"])
    return x.withColumn("metadata_flags", flags).withColumn("metadata_score", fr.metadata_score(F.col("metadata_flags")))


def with_tampering(x: DataFrame) -> DataFrame:
    shots = fr.screenshot_flags(*[F.col(c) for c in ("width", "height", "top_spread", "bottom_spread")])
    flags = fr.tamper_flags(*[F.col(c) for c in ("ela_share", "ela_spread", "contrast_share", "flat_blocks", "flat_share", "edge_ratio")], shots)
    return x.withColumn("shots", shots).withColumn("tamper_flags", flags).withColumn("tamper_score", fr.tamper_score(F.col("tamper_flags")))


query("m6_quality_scores", f"WITH {_MS}, {_QS} SELECT id, quality_flags, quality_score, blur_class, {_QG} AS quality_grade FROM qs")(
    lambda s, d: with_quality(measures(s, d)).select("id", F.concat_ws(",", "quality_flags").alias("quality_flags"), "quality_score", fr.blur_class(F.col("sharpness")).alias("blur_class"), fr.quality_grade(F.col("quality_score")).alias("quality_grade")))
query("m7_metadata_scores", f"WITH {_MS}, {_MF} SELECT * FROM mt")(lambda s, d: with_metadata(measures(s, d)).select("id", F.concat_ws(",", "metadata_flags").alias("metadata_flags"), "metadata_score", fr.looks_like_screenshot(F.col("metadata_flags")).alias("is_screenshot")))
query("m8_tamper_scores", f"WITH {_MS}, {_TS} SELECT id, tamper_flags, tamper_score, tamper_score >= 25 OR nf >= 2 AS is_suspicious FROM tp")(
    lambda s, d: with_tampering(measures(s, d)).select("id", F.concat_ws(",", "tamper_flags").alias("tamper_flags"), "tamper_score", fr.tampered(F.col("tamper_score"), F.col("tamper_flags")).alias("is_suspicious")))


@query("r10_fraud_analysis", f"""WITH {_MS}, {_QS}, {_MF}, {_TS}, dp AS ({SQL['m3_duplicate_score']}), pt AS ({SQL['m4_pattern_score']}),
  al AS (SELECT ms.id, quality_score, tamper_score, metadata_score, coalesce(duplicate_score, 0) AS dup, coalesce(pattern_score, 0) AS pat, confidence AS c, is_screenshot OR shot AS is_screenshot FROM ms JOIN qs USING (id) JOIN mt USING (id) JOIN tp USING (id) LEFT JOIN dp USING (user_id) LEFT JOIN pt USING (user_id)),
  rs AS (SELECT *, least(100, trunc(0.0::DOUBLE + tamper_score * 0.30::DOUBLE + dup * 0.25::DOUBLE + (100 - quality_score) * 0.20::DOUBLE + metadata_score * 0.15::DOUBLE + pat * 0.10::DOUBLE + CASE WHEN c < 0.40 THEN (0.40::DOUBLE - c) * 30 WHEN c < 0.70 THEN (0.70::DOUBLE - c) * 10 ELSE 0.0::DOUBLE END))::INT AS risk_score FROM al),
  lv AS (SELECT *, CASE WHEN risk_score <= 24 THEN 'LOW_RISK' WHEN risk_score <= 49 THEN 'MEDIUM_RISK' WHEN risk_score <= 74 THEN 'HIGH_RISK' ELSE 'CRITICAL_RISK' END AS risk_level FROM rs)
  SELECT id, quality_score, tamper_score, metadata_score, dup::BIGINT AS duplicate_score, pat AS pattern_score, is_screenshot, risk_score, risk_level, CASE risk_level WHEN 'CRITICAL_RISK' THEN CASE WHEN dup >= 70 THEN 'block_and_investigate_identity_collision' WHEN tamper_score >= 70 THEN 'block_and_flag_for_fraud_review' ELSE 'escalate_to_fraud_team' END
    WHEN 'HIGH_RISK' THEN 'manual_review_required' WHEN 'MEDIUM_RISK' THEN 'enhanced_verification_recommended' ELSE 'proceed_with_standard_review' END AS recommendation FROM lv""")
def fraud_analysis(s: SparkSession, d: str) -> DataFrame:
    """All components of a document's risk, those of its user joined to those of its image."""
    x = with_tampering(with_metadata(with_quality(measures(s, d))))
    x = x.join(rq.duplicate_scores(s, d), "user_id", "left").join(rq.patterns(s, d).select("user_id", "pattern_score"), "user_id", "left")
    x = x.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("duplicate_score", "pattern_score")})
    score = sc.risk_score(*[F.col(c) for c in ("tamper_score", "duplicate_score", "quality_score", "metadata_score", "pattern_score", "confidence")])
    x = x.withColumn("risk_score", score).withColumn("risk_level", sc.risk_level(F.col("risk_score")))
    shot = fr.looks_like_screenshot(F.col("metadata_flags")) | (F.size("shots") > 0)
    return x.select("id", "quality_score", "tamper_score", "metadata_score", "duplicate_score", "pattern_score", shot.alias("is_screenshot"), "risk_score", "risk_level", sc.recommendation(F.col("risk_level"), F.col("tamper_score"), F.col("duplicate_score")).alias("recommendation"))
