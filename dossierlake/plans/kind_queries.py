"""Queries over kinds of papers and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlake.functions import kinds as kd
from dossierlake.plans._registry import edges, query
from dossierlake.plans.record_queries import _pick, _sql_pick
from dossierlake.sources import logical as lt

HEADS = ["STATEMENT OF MARKS", "H1GHER SEC0NDARY CERT1FICATE", "Secondary School Certificate", "this is to certify that", "University of Mumbai", "B.Tech semester IV grade card", "nothing of note", "CBSE class 12th"]
BODIES = ["seat no 12 total marks 600", "has passed the examination in first class", "Maharashtra State B0ARD", "science stream junior college", "degree of bachelor convocation", "roll no 7 MARCH - 2019 examination"]
ENDS = ["PASSED with d1st1nct1on", "diploma", "std x", "माध्यमिक परीक्षा", "H.S.C exam", "IIT Bombay", "x", "गुण पत्रक ▒ é"]
FILES = ["aadhaar_scan", "PAN-card", "bank.statement.2019", "marksheet", "invoice", "my_cv", "photo", ".hidden", "dl front", "Result_HSC", "paper", "voter id"]
HINT = ["auto", "ssc", "ug", None, "hsc", "other"]


def papers(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.concat_ws(" ", _pick(k, HEADS), _pick(F.floor(k / 8), BODIES), _pick(F.floor(k / 48), ENDS))
    return lt.table(s, d, "orders").select(k.alias("id"), F.when(k % 97 == 0, F.substring(text, 1, 8)).otherwise(text).alias("text"), _pick(F.floor(k / 5), HINT).alias("hint"))


_Q = lambda p: edges(p).replace("'", "''")
_SUM = lambda patterns: " + ".join(f"CASE WHEN regexp_matches(low, '{_Q(p)}', 's') THEN 1 ELSE 0 END" for p in patterns)
_CLEAN = "regexp_replace(regexp_replace(text, '[^\\x20-\\x7E\\x{0900}-\\x{097F}\\n]', ' ', 'g'), '[ \\t]+', ' ', 'g')"
for _p, _word in kd.REPAIRS:
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', '{_word}', 'gi')"
_KIND = f"""WITH r AS (SELECT o_orderkey AS id, {_sql_pick('o_orderkey', HEADS)} || ' ' || {_sql_pick('(o_orderkey // 8)', BODIES)} || ' ' || {_sql_pick('(o_orderkey // 48)', ENDS)} AS t, {_sql_pick('(o_orderkey // 5)', HINT)} AS hint FROM orders),
  p AS (SELECT id, hint, CASE WHEN id % 97 = 0 THEN t[1:8] ELSE t END AS text FROM r), l AS (SELECT *, lower({_CLEAN}) AS low FROM p),
  c AS (SELECT id, length(trim(text)) < 10 AS short, {_SUM(kd.MARKSHEET)} AS sheet, {_SUM(kd.CERTIFICATE)} AS paper, {', '.join(f"{_SUM(v)} + CASE WHEN coalesce(hint, '') IN ({', '.join(repr(h) for h in kd.HINTS[k])}) THEN 20 ELSE 0 END AS {k}" for k, v in kd.LEVELS.items())},
    regexp_matches(low, '{_Q(r"\bmarks?\b|\btotal\b|\bsubject\b")}') AS marked, CASE {' '.join(f"WHEN regexp_matches(low, '{_Q(p)}') THEN '{n}'" for p, n in kd.BOARDS)} END AS board FROM l),
  v AS (SELECT *, CASE WHEN degree > greatest(ssc, hsc) THEN 'degree' WHEN hsc > ssc THEN 'hsc' WHEN ssc > 0 THEN 'ssc' WHEN board IS NOT NULL THEN 'hsc' END AS lv, CASE WHEN sheet > paper THEN 'marksheet' WHEN paper > sheet THEN 'certificate' WHEN marked THEN 'marksheet' ELSE 'certificate' END AS st, greatest(ssc + hsc + degree, 1)::DOUBLE AS n FROM c),
  w AS (SELECT *, short OR lv IS NULL AS none FROM v)
  SELECT id, CASE WHEN none THEN 'hsc_marksheet' ELSE lv || '_' || st END AS category, CASE WHEN none THEN 'hsc' ELSE lv END AS level, CASE WHEN none THEN 'marksheet' ELSE st END AS subtype, CASE WHEN NOT none THEN board END AS board,
    CASE WHEN none THEN 0.25 ELSE round(CASE WHEN lv = 'degree' THEN degree / n WHEN lv = 'hsc' AND hsc > ssc THEN hsc / n WHEN lv = 'ssc' THEN ssc / n ELSE 0.35 END, 3) END::DOUBLE AS level_confidence,
    CASE WHEN none OR sheet = paper THEN 0.5 ELSE round(greatest(sheet, paper) / greatest(sheet + paper, 1)::DOUBLE, 3) END::DOUBLE AS subtype_confidence FROM w"""
query("x22_paper_kinds", _KIND)(lambda s, d: papers(s, d).select("id", kd.paper_kind(F.col("text"), F.col("hint")).alias("k")).select("id", "k.*"))


def files(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return lt.table(s, d, "orders").select(k.alias("id"), F.concat(_pick(k, FILES), F.when(k % 3 == 0, ".PDF").when(k % 3 == 1, ".jpg").otherwise("")).alias("name"), F.when(k % 4 == 0, F.unhex(F.lit("255044462D312E37"))).when(k % 4 == 1, F.unhex(F.lit("FFD8FFE0"))).alias("head"))


_HAS = lambda table: " ".join(f"WHEN {' OR '.join(f'''contains(base, '{x}')''' for x in words)} THEN '{n}'" for n, words in table)
query("x22_routed_files", f"""WITH f AS (SELECT o_orderkey AS id, lower({_sql_pick('o_orderkey', FILES)} || CASE o_orderkey % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.jpg' ELSE '' END) AS low FROM orders),
  b AS (SELECT id, id % 4 = 0 AS is_pdf, CASE WHEN regexp_matches(low, '^.*[^.].*\\.[^.]*$') THEN regexp_replace(low, '\\.[^.]*$', '') ELSE low END AS base FROM f),
  c AS (SELECT *, CASE {_HAS(kd.CLASSES)} WHEN is_pdf THEN 'academic' ELSE 'unknown' END AS doc_class FROM b)
  SELECT id, doc_class, CASE {_HAS(kd.TYPES)} ELSE 'unknown' END AS doc_type, is_pdf, CASE doc_class {' '.join(f"WHEN '{k}' THEN {v}" for k, v in kd.SECONDS.items())} END AS seconds, doc_class = 'bank' AS skip_images FROM c""")(
    lambda s, d: files(s, d).select("id", kd.routed(F.col("name"), F.col("head")).alias("r")).select("id", "r.*"))
# Pages have fields before colons, in their styles and texts, as documents have not.
query("x23_page_key_values", "SELECT page_id, n::INT AS line, trim(regexp_extract(line, '^([^:]*):(.*)$', 1)) AS key, trim(regexp_extract(line, '^([^:]*):(.*)$', 2)) AS val FROM (SELECT page_id, unnest(string_split(regexp_replace(html, '<[^>]*>', chr(10), 'g'), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(html, '<[^>]*>', chr(10), 'g'), chr(10)), 1) - 1 AS n FROM pages) WHERE contains(line, ':')")(
    lambda s, d: lt.table(s, d, "pages").select("page_id", F.posexplode(F.split(F.regexp_replace("html", "<[^>]*>", "\n"), "\n")).alias("line", "t")).where(F.contains("t", F.lit(":"))).select("page_id", "line", F.trim(F.regexp_extract("t", "^([^:]*):(.*)$", 1)).alias("key"), F.trim(F.regexp_extract("t", "^([^:]*):(.*)$", 2)).alias("val")))
