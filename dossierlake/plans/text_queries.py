"""Queries over text features, layout, keyed changes, sinks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlake.functions import text as tx
from dossierlake.operators import layout as ly
from dossierlake.operators import ledgers as ld
from dossierlake.plans._registry import edges, query
from dossierlake.sources import logical as lt
from dossierlake.sources import sinks
from dossierlake.sources.shared import remove, shared_root
from dossierlake.sources.logical import with_tables as w
from dossierlake.streaming import jobs

_T = "coalesce(text, '')"
_NL = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]"
_LN = f"list_filter(regexp_split_to_array({_T}, '{_NL}'), lambda x: regexp_matches(x, '\\S'))"
_ALL = "len(regexp_extract_all({0}, '{1}')) / greatest(length({0}), 1)::DOUBLE"
_FEATURES = f"""SELECT doc_id, len(list_filter(regexp_split_to_array({_T}, '\\s+'), lambda x: x <> ''))::INT AS word_count, len({_LN})::INT AS line_count, round(len(regexp_extract_all({_T}, '[\\x{{0900}}-\\x{{097F}}]')) / greatest(length({_T}), 1)::DOUBLE, 3) AS devanagari_ratio,
  round({_ALL.format(_T, '[A-Za-z]')}, 3) AS latin_ratio, round({_ALL.format(_T, '[0-9]')}, 3) AS numeric_ratio, regexp_matches({_T}, '[₹$€£]') AS currency_present, regexp_matches({_T}, '₹\\s*[0-9,]+') AS has_currency_amounts,
  round(len(regexp_extract_all({_T}, '[A-Za-z\\x{{0900}}-\\x{{097F}}][^:]+:\\s*\\S')) / greatest(len({_LN}), 1)::DOUBLE, 3) AS field_pattern_density, round(len(list_filter({_LN}, lambda x: len(regexp_extract_all(x, '[0-9,.₹/\\- ]')) / length(x)::DOUBLE > 0.5)) / greatest(len({_LN}), 1)::DOUBLE, 3) AS numeric_row_density,
  {', '.join(f"regexp_matches({_T}, '{p}') AS {k}" for k, p in tx.PATTERNS.items())} FROM documents"""


def _documents(s: SparkSession, d: str) -> DataFrame:
    return lt.table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


query("x20_text_features", _FEATURES)(lambda s, d: _documents(s, d).select("doc_id", tx.feature_row(F.col("text")).alias("f")).select("doc_id", "f.*"))
_Q = lambda p: edges(p).replace("'", "''")
_RAW = ", ".join("least(0.95::DOUBLE, (0.0::DOUBLE + " + " + ".join(f"CASE WHEN regexp_matches(t, '{_Q(p)}') THEN {x}::DOUBLE ELSE 0.0::DOUBLE END" for x, p in ps) + f") / greatest({sum(x for x, _ in ps)!r}::DOUBLE, 1.0::DOUBLE)) AS s_{k}" for k, ps in tx.SIGNATURES.items())
_BOOST = ", ".join(f"CASE WHEN regexp_matches(t, '{_Q(tx.FORMATS[k][0])}') THEN least(0.95::DOUBLE, s_{k} + {tx.FORMATS[k][1]}::DOUBLE) ELSE s_{k} END AS b_{k}" if k in tx.FORMATS else f"CASE WHEN devanagari > 0.30 THEN least(0.95::DOUBLE, s_{k} + {x}::DOUBLE) ELSE s_{k} END AS b_{k}" for k, x in ((k, {"ration_card": 0.08, "government_doc": 0.05}.get(k, 0.0)) for k in tx.SIGNATURES))
_TOP = "greatest(" + ", ".join(f"b_{k}" for k in tx.SIGNATURES) + ")"
query("x21_document_type", f"""WITH a AS (SELECT doc_id, {_T} AS t, round(len(regexp_extract_all({_T}, '[\\x{{0900}}-\\x{{097F}}]')) / greatest(length({_T}), 1)::DOUBLE, 3) AS devanagari FROM documents), b AS (SELECT *, {_RAW} FROM a), c AS (SELECT *, {_BOOST} FROM b)
  SELECT doc_id, CASE WHEN {_TOP} < 0.08 THEN 'unknown' {' '.join(f"WHEN b_{k} = {_TOP} THEN '{k}'" for k in tx.SIGNATURES)} END AS doc_type FROM c""")(lambda s, d: _documents(s, d).select("doc_id", tx.signature_type(F.col("text")).alias("doc_type")))
query("x16_first_matches", f"SELECT doc_id, nullif(regexp_extract({_T}, '\\b[A-Z]{{5}}[0-9]{{4}}[A-Z]\\b'), '') AS pan, nullif(regexp_extract({_T}, '\\b[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}\\b'), '') AS dob, coalesce(nullif(regexp_extract({_T}, '\\+[0-9]{{2}}[0-9]{{10}}'), ''), nullif(regexp_extract({_T}, '[0-9]{{10,}}'), '')) AS phone FROM documents")(
    lambda s, d: _documents(s, d).select("doc_id", tx.first_match(F.col("text"), r"\b[A-Z]{5}[0-9]{4}[A-Z]\b").alias("pan"), tx.first_match(F.col("text"), r"\b[0-9]{2}/[0-9]{2}/[0-9]{4}\b").alias("dob"), tx.first_match(F.col("text"), r"\+[0-9]{2}[0-9]{10}", "[0-9]{10,}").alias("phone")))
query("x23_key_values", f"SELECT doc_id, trim(regexp_extract(line, '^([^:]*):(.*)$', 1)) AS key, trim(regexp_extract(line, '^([^:]*):(.*)$', 2)) AS val FROM (SELECT doc_id, unnest(string_split({_T}, chr(10))) AS line FROM documents) WHERE contains(line, ':')")(
    lambda s, d: _documents(s, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.contains("line", F.lit(":"))).select("doc_id", F.trim(F.regexp_extract("line", "^([^:]*):(.*)$", 1)).alias("key"), F.trim(F.regexp_extract("line", "^([^:]*):(.*)$", 2)).alias("val")))
_DIG = "lpad((o_orderkey * 7919 % 4001)::VARCHAR, 12, '2')"
query("x18_grouped_and_masked", f"SELECT o_orderkey AS id, {_DIG}[1:4] || ' ' || {_DIG}[5:8] || ' ' || {_DIG}[9:12] AS grouped, 'XXXX XXXX ' || right({_DIG}, 4) AS masked FROM orders")(
    lambda s, d: lt.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.lpad((F.col("o_orderkey") * 7919 % 4001).cast("string"), 12, "2").alias("n")).select("id", tx.grouped_digits(F.col("n")).alias("grouped"), tx.masked(F.col("n")).alias("masked")))
_TIMES, _TURNS = [x for row in tx._TIMES for x in row], [x for row in tx._permutations() for x in row]
query("x17_check_digits", f"SELECT o_orderkey AS id, list_reduce(list_transform(list_reverse(string_split({_DIG}, '')), lambda x, i: ({_TURNS})[((i - 1) % 8) * 10 + x::INT + 1]), lambda c, x: ({_TIMES})[c * 10 + x + 1], 0) = 0 AS holds FROM orders")(lambda s, d: lt.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), tx.check_digit_holds(F.lpad((F.col("o_orderkey") * 7919 % 4001).cast("string"), 12, "2")).alias("holds")))
query("x3_years", "SELECT o_orderkey AS id, (CASE WHEN o_orderkey % 100 <= 25 THEN 2000 ELSE 1900 END + o_orderkey % 100)::INT AS year, o_orderkey % 40 BETWEEN 1 AND 31 AND o_orderkey % 15 BETWEEN 1 AND 12 AND CASE WHEN o_orderkey % 100 <= 25 THEN 2000 ELSE 1900 END + o_orderkey % 100 BETWEEN 1900 AND 2025 AS plausible FROM orders")(
    lambda s, d: lt.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), tx.four_digit_year(F.col("o_orderkey") % 100).alias("year")).withColumn("plausible", tx.plausible_dob(F.col("id") % 40, F.col("id") % 15, F.col("year"))))
query("x15_repaired_digits", "SELECT s_suppkey AS id, translate(s_name, 'OoQDIlisSBZ', '00001115582') AS repaired FROM supplier")(lambda s, d: lt.table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), tx.repaired_digits(F.col("s_name")).alias("repaired")))
query("f8_json_paths", "SELECT event_id, (props->>'$.k')::INT AS k FROM events")(lambda s, d: lt.table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")))


# Layout, on words laid out on a grid from the turns of conversations
def words(s: SparkSession, d: str) -> DataFrame:
    c = lt.table(s, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "[ \n]")).alias("word_id", "text"))
    p = F.col("word_id")
    x1, y1 = (p % 7 * 130 + p * 37 % 40).cast("double"), (F.floor(p / 7) * 30 + p % 4).cast("double")
    return c.select("doc", "page", "word_id", "text", (F.lit(0.5) + p % 50 / F.lit(100.0)).alias("conf"), x1.alias("x1"), y1.alias("y1"), (x1 + F.least(F.length("text") * 9, F.lit(100))).alias("x2"), (y1 + 20).alias("y2"))


_WORDS = """WITH c AS (SELECT conv_id AS doc, turn AS page, regexp_split_to_array(coalesce(text, ''), '[ \\n]') AS t FROM conversations), e AS (SELECT doc, page, unnest(t) AS text, generate_subscripts(t, 1) - 1 AS p FROM c),
 wd AS (SELECT doc, page, p::INT AS word_id, text, 0.5 + (p % 50) / 100.0 AS conf, (p % 7 * 130 + p * 37 % 40)::DOUBLE AS x1, (floor(p / 7.0) * 30 + p % 4)::DOUBLE AS y1 FROM e),
 wb AS (SELECT *, x1 + least(length(text) * 9, 100) AS x2, y1 + 20 AS y2 FROM wd), ok AS (SELECT * FROM wb WHERE conf >= 0.55 AND x2 - x1 >= 2 AND text <> '')"""
query("s18_clean_words", f"{_WORDS} SELECT doc, page, word_id, text, x1, y1, x2, y2, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM ok")(lambda s, d: ly.clean_words(words(s, d)).select("doc", "page", "word_id", "text", "x1", "y1", "x2", "y2", "cx", "cy"))
_BAND = f"{_WORDS}, b AS (SELECT *, floor(word_id / 7.0)::BIGINT AS line FROM ok)"
query("w11_row_bands", f"{_BAND} SELECT doc, page, word_id, dense_rank() OVER (PARTITION BY doc, page ORDER BY line) - 1 AS line FROM b")(lambda s, d: ly.row_bands(ly.clean_words(words(s, d))).select("doc", "page", "word_id", "line"))
# Words on a slope: no fixed bands part them, so where a line ends is up to the mean of its words so far.
_SLOPE = f"""WITH RECURSIVE {_WORDS.removeprefix("WITH ")}, sl AS (SELECT doc, page, word_id, x1, p.word_id * 3.5 + p.word_id * 7 % 6 + 10 AS cy FROM ok p),
  so AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY cy, x1, word_id) AS r FROM sl),
  ln AS (SELECT doc, page, word_id, r, 0::BIGINT AS line, cy::DOUBLE AS total, 1 AS n FROM so WHERE r = 1
    UNION ALL SELECT s.doc, s.page, s.word_id, s.r, CASE WHEN far THEN line + 1 ELSE line END, CASE WHEN far THEN s.cy ELSE total + s.cy END, CASE WHEN far THEN 1 ELSE n + 1 END
      FROM (SELECT so.*, line, total, n, abs(so.cy - total / n) > 20 * 0.55::DOUBLE AS far FROM ln JOIN so ON so.doc = ln.doc AND so.page = ln.page AND so.r = ln.r + 1) s)
  SELECT doc, page, word_id, line FROM ln"""


def sloping(s: SparkSession, d: str) -> DataFrame:
    y = F.col("word_id") * 3.5 + F.col("word_id") * 7 % 6
    return ly.clean_words(words(s, d).withColumns({"y1": y, "y2": y + 20}))


query("w11_sloping_bands", _SLOPE)(lambda s, d: ly.row_bands(sloping(s, d)).select("doc", "page", "word_id", "line"))
_PHR = f"""{_BAND}, g AS (SELECT *, greatest(8.0, median((x2 - x1) / length(text)) OVER (PARTITION BY doc, page, line) * 1.8::DOUBLE) AS lim, x1 - lag(x2) OVER (PARTITION BY doc, page, line ORDER BY x1, word_id) AS gap FROM b),
 h AS (SELECT *, sum(CASE WHEN gap > lim THEN 1 ELSE 0 END) OVER (PARTITION BY doc, page, line ORDER BY x1, word_id) AS phrase FROM g), ph AS (SELECT doc, page, line, phrase::BIGINT AS phrase, string_agg(text, ' ' ORDER BY x1, word_id) AS text, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS words FROM h GROUP BY ALL)"""


def gridded(s: SparkSession, d: str) -> DataFrame:
    return ly.clean_words(words(s, d)).withColumn("line", F.floor(F.col("word_id") / 7))


query("w12_phrases", f"{_PHR} SELECT doc, page, line, phrase, text, x1, x2, words FROM ph")(lambda s, d: ly.phrases(gridded(s, d)).select("doc", "page", "line", "phrase", "text", "x1", "x2", "words"))
_LINES = f"""{_PHR}, ln AS (SELECT doc, page, line, string_agg(text, ' ' ORDER BY x1, phrase) AS text, min(x1) AS x1, max(x2) AS x2, (min(y1) + max(y2)) / 2 AS cy, count(*) AS tokens, count(*) FILTER (regexp_matches(text, '[0-9]')) AS numbers FROM ph GROUP BY ALL)"""
query("w11_lines", f"{_LINES} SELECT doc, page, line, text, tokens, numbers FROM ln")(lambda s, d: ly.lines(ly.phrases(gridded(s, d))).select("doc", "page", "line", "text", "tokens", "numbers"))
query("r14_region_types", f"""{_LINES} SELECT doc, page, line, CASE WHEN cy < 1600.0 * 0.18 THEN CASE WHEN contains(text, ':') THEN 'kv_block' ELSE 'header' END WHEN cy > 1600.0 * 0.90 THEN 'footer' WHEN (tokens > 5 AND (x2 - x1) / 1000.0 > 0.4 AND numbers >= 2) OR (tokens > 3 AND numbers >= 1 AND x2 - x1 > 200) THEN 'table' WHEN contains(text, ':') THEN 'kv_block' ELSE 'paragraph' END AS region FROM ln""")(
    lambda s, d: ly.lines(ly.phrases(gridded(s, d))).select("doc", "page", "line", ly.region_type(1000.0, 1600.0).alias("region")))
_KINDS = """CASE WHEN cy < 1600.0 * 0.18 THEN CASE WHEN contains(text, ':') THEN 'kv_block' ELSE 'header' END WHEN cy > 1600.0 * 0.90 THEN 'footer' WHEN (tokens > 5 AND (x2 - x1) / 1000.0 > 0.4 AND numbers >= 2) OR (tokens > 3 AND numbers >= 1 AND x2 - x1 > 200) THEN 'table' WHEN contains(text, ':') THEN 'kv_block' ELSE 'paragraph' END"""
query("r14_regions_smoothed", f"""WITH RECURSIVE {_LINES.removeprefix("WITH ")}, kd AS (SELECT doc, page, line, tokens, {_KINDS} AS kind FROM ln), nb AS (SELECT *, lead(kind) OVER v AS below, row_number() OVER v AS r FROM kd WINDOW v AS (PARTITION BY doc, page ORDER BY line)),
  sm AS (SELECT doc, page, line, r, kind AS region FROM nb WHERE r = 1 UNION ALL SELECT nb.doc, nb.page, nb.line, nb.r, CASE WHEN nb.kind = 'paragraph' AND nb.below IS NOT NULL AND sm.region = 'table' AND (nb.below = 'table' OR nb.tokens < 5) THEN 'table' ELSE nb.kind END FROM sm JOIN nb ON nb.doc = sm.doc AND nb.page = sm.page AND nb.r = sm.r + 1) SELECT doc, page, line, region FROM sm""")(lambda s, d: ly.regions(ly.lines(ly.phrases(gridded(s, d)))).select("doc", "page", "line", "region"))
query("w11_x_clusters", f"{_PHR}, cl AS (SELECT doc, page, line, phrase, (x1 + x2) / 2 AS cx FROM ph), cg AS (SELECT *, cx - lag(cx) OVER (PARTITION BY doc, page ORDER BY cx, line, phrase) AS gap FROM cl) SELECT doc, page, line, phrase, sum(CASE WHEN gap > 50.0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc, page ORDER BY cx, line, phrase)::BIGINT AS cluster FROM cg")(
    lambda s, d: ly.x_clusters(ly.phrases(gridded(s, d))).select("doc", "page", "line", "phrase", "cluster"))
_GRID = f"""WITH RECURSIVE {_PHR.removeprefix("WITH ")}, pc AS (SELECT doc, page, line, phrase, text, x1, (x1 + x2) / 2 AS cx FROM ph), so AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY cx, line, phrase) AS r FROM pc),
  an AS (SELECT doc, page, r, 0 AS k, cx AS total, 1 AS n FROM so WHERE r = 1
    UNION ALL SELECT so.doc, so.page, so.r, CASE WHEN so.cx - total / n > 45 THEN k + 1 ELSE k END, CASE WHEN so.cx - total / n > 45 THEN so.cx ELSE total + so.cx END, CASE WHEN so.cx - total / n > 45 THEN 1 ELSE n + 1 END FROM an JOIN so ON so.doc = an.doc AND so.page = an.page AND so.r = an.r + 1),
  me AS (SELECT doc, page, k, arg_max(total / n, r) AS pos FROM an GROUP BY ALL),
  hi AS (SELECT doc, page, k FROM (SELECT pc.doc, pc.page, line, phrase, arg_min(k, (abs(cx - pos), k)) AS k FROM pc JOIN me ON me.doc = pc.doc AND me.page = pc.page GROUP BY ALL) GROUP BY ALL HAVING count(DISTINCT line) >= 2),
  kp AS (SELECT me.doc, me.page, pos, row_number() OVER (PARTITION BY me.doc, me.page ORDER BY k) - 1 AS c, count(*) OVER (PARTITION BY me.doc, me.page) AS n FROM me JOIN hi USING (doc, page, k)),
  pl AS (SELECT pc.doc, pc.page, line, phrase, x1, text, CASE WHEN any_value(n) <= 12 THEN arg_min(c, (abs(cx - pos), c)) ELSE 0 END AS col, CASE WHEN any_value(n) <= 12 THEN any_value(n) ELSE 1 END AS cols FROM pc LEFT JOIN kp ON kp.doc = pc.doc AND kp.page = pc.page GROUP BY ALL),
  ce AS (SELECT doc, page, line, coalesce(col, 0) AS col, coalesce(cols, 1) AS cols, trim(string_agg(text, ' ' ORDER BY x1, phrase, text)) AS t FROM pl GROUP BY ALL),
  li AS (SELECT doc, page, line, cols, count(*) FILTER (t <> '') AS filled, string_agg(t, ' ' ORDER BY col) AS whole FROM ce GROUP BY ALL),
  ca AS (SELECT *, lag(line) OVER w IS NOT NULL AND filled > 0 AND filled < 0.65 * cols AND NOT regexp_matches(whole, '{ly.DATE}') AND NOT (regexp_matches(whole, '{ly.AMOUNT}') AND filled >= 2) AS can FROM li WINDOW w AS (PARTITION BY doc, page ORDER BY line)),
  ru AS (SELECT *, sum(CASE WHEN can THEN 0 ELSE 1 END) OVER (PARTITION BY doc, page ORDER BY line) AS run FROM ca),
  mg AS (SELECT *, can AND coalesce(max(filled) OVER (PARTITION BY doc, page, run ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 2, false) AS merged FROM ru),
  ro AS (SELECT *, sum(CASE WHEN merged THEN 0 ELSE 1 END) OVER (PARTITION BY doc, page ORDER BY line) - 1 AS row_ FROM mg),
  tx AS (SELECT ce.doc, ce.page, row_, col, string_agg(t, ' ' ORDER BY ce.line) AS t FROM ce JOIN ro ON ro.doc = ce.doc AND ro.page = ce.page AND ro.line = ce.line WHERE t <> '' GROUP BY ALL),
  mp AS (SELECT doc, page, row_, map_from_entries(list((col, t))) AS m FROM tx GROUP BY ALL)
  SELECT ro.doc, ro.page, row_::BIGINT AS row, array_to_string(list_transform(range(0, cols), lambda i: coalesce(m[i], '')), ' | ') AS cells FROM ro LEFT JOIN mp USING (doc, page, row_) WHERE NOT merged""".replace("AS row,", 'AS "row",')
query("r13_table_grid", _GRID)(lambda s, d: ly.table_grid(ly.phrases(gridded(s, d))).select("doc", "page", "row", F.concat_ws(" | ", "cells").alias("cells")))
query("j12_nearest_right", f"{_WORDS}, q AS (SELECT *, (y1 + y2) / 2 AS cy FROM ok) SELECT a.doc, a.page, a.word_id AS a, arg_min(b.word_id, (b.x1 - a.x2, b.word_id)) AS right FROM q a JOIN q b ON a.doc = b.doc AND a.page = b.page AND a.word_id <> b.word_id AND abs(a.cy - b.cy) < 0.8 * 20 AND b.x1 >= a.x2 GROUP BY ALL".replace("AS right", 'AS "right"'))(lambda s, d: ly.nearest_right(ly.clean_words(words(s, d))))
query("j16_box_overlaps", f"""{_WORDS}, i AS (SELECT a.doc, a.page, a.word_id AS a, b.word_id AS b, greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS v, (a.x2 - a.x1) * 20.0 AS s1, (b.x2 - b.x1) * 20.0 AS s2 FROM ok a JOIN ok b ON a.doc = b.doc AND a.page = b.page AND a.word_id < b.word_id)
  SELECT doc, page, a, b, round(v / (s1 + s2 - v), 6) AS iou FROM i WHERE round(v / (s1 + s2 - v), 6) > 0.4""")(lambda s, d: ly.overlaps(ly.clean_words(words(s, d))))

# Keyed changes and sinks
query("s6_upsert", w("SELECT * FROM reviews WHERE NOT (status = 'pending' AND id % 2 = 0) UNION ALL SELECT * REPLACE ('approved' AS status) FROM reviews WHERE status = 'pending' AND id % 2 = 0", "reviews"))(
    lambda s, d: sinks.upsert(lt.reviews(s, d), lt.reviews(s, d).where("status = 'pending' AND id % 2 = 0").withColumn("status", F.lit("approved")), ["id"]))
query("s7_replace_by_key", w("SELECT * FROM extracted WHERE user_id % 3 <> 0 UNION ALL SELECT * REPLACE (0.5::DOUBLE AS confidence_score) FROM extracted WHERE user_id % 3 = 0 AND doc_type = 'view'", "extracted"))(
    lambda s, d: sinks.replace_by_key(lt.extracted(s, d), lt.extracted(s, d).where("user_id % 3 = 0 AND doc_type = 'view'").withColumn("confidence_score", F.lit(0.5)), ["user_id"]))
# Events of reviews: three reviewers claim and release them, and now and then one decides.
_EVENTS = """ev AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, a, r) AS n, a AS action, r AS reviewer_id FROM (
    SELECT *, CASE WHEN l_partkey % 8 < 4 THEN 'claim' WHEN l_partkey % 8 < 7 THEN 'release' WHEN l_suppkey % 2 = 0 THEN 'approve' ELSE 'reprocess' END AS a, CASE WHEN l_partkey % 11 > 0 THEN 'rev' || (l_suppkey % 3) END AS r FROM lineitem)),
  st AS (SELECT r.id, 0::BIGINT AS n, NULL::VARCHAR AS action, NULL::VARCHAR AS reviewer_by, true AS accepted, NULL::VARCHAR AS before, r.status AS after, r.reviewer_id AS holder FROM reviews r
    UNION ALL SELECT e.id, e.n, e.action, e.reviewer_id, CASE e.action WHEN 'claim' THEN st.after = 'pending' WHEN 'release' THEN coalesce(st.holder = e.reviewer_id, false) ELSE true END, st.after,
      CASE e.action WHEN 'claim' THEN CASE WHEN st.after = 'pending' THEN 'in_review' ELSE st.after END WHEN 'release' THEN CASE WHEN st.holder = e.reviewer_id THEN 'pending' ELSE st.after END WHEN 'approve' THEN 'approved' ELSE 'reprocess_requested' END,
      CASE e.action WHEN 'claim' THEN CASE WHEN st.after = 'pending' THEN e.reviewer_id ELSE st.holder END WHEN 'release' THEN CASE WHEN st.holder = e.reviewer_id THEN NULL ELSE st.holder END ELSE coalesce(e.reviewer_id, st.holder) END
    FROM st JOIN ev e ON e.id = st.id AND e.n = st.n + 1)"""


def review_events(s: SparkSession, d: str) -> DataFrame:
    p, r = F.col("l_partkey"), F.col("l_suppkey")
    action = F.when(p % 8 < 4, "claim").when(p % 8 < 7, "release").when(r % 2 == 0, "approve").otherwise("reprocess")
    return lt.table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("at"), F.col("l_linenumber").alias("position"), action.alias("action"), F.when(p % 11 > 0, F.concat(F.lit("rev"), (r % 3).cast("string"))).alias("reviewer_id"))


_LEDGER = lambda s, d: ld.review_ledger(lt.reviews(s, d).select("id", "status", "reviewer_id"), review_events(s, d), nulls_last=True)
query("s8_claims", w("SELECT 1", "reviews").replace("WITH ", "WITH RECURSIVE ", 1).removesuffix("SELECT 1") + f", {_EVENTS} SELECT id, arg_max(after, n) AS status, arg_max_null(holder, n) AS reviewer_id, count(*) FILTER (accepted AND n > 0) AS accepted FROM st GROUP BY id")(lambda s, d: ld.review_states(_LEDGER(s, d)))
query("s8_rejected_events", w("SELECT 1", "reviews").replace("WITH ", "WITH RECURSIVE ", 1).removesuffix("SELECT 1") + f", {_EVENTS} SELECT id, n AS number, action, reviewer_by AS reviewer_id, before AS status, holder FROM st WHERE NOT accepted")(lambda s, d: ld.rejected_events(_LEDGER(s, d)).where("status IS NOT NULL"))  # of reviews that are there
query("s9_bulk_approve", w("SELECT id, CASE WHEN id % 10 = 0 AND status IN ('pending', 'in_review') THEN 'approved' ELSE status END AS status FROM reviews", "reviews"))(
    lambda s, d: sinks.bulk_update(lt.reviews(s, d).select("id", "status"), lt.reviews(s, d).where("id % 10 = 0"), "id", "status", F.lit("approved")))
query("s10_key_values", w("SELECT unnest(['a', 'b']) AS key, unnest([count(*)::VARCHAR, max(id)::VARCHAR]) AS value FROM reviews", "reviews"))(lambda s, d: sinks.key_values(lt.reviews(s, d).agg(F.count(F.lit(1)).alias("a"), F.max("id").alias("b"))))
query("s14_json_rows", "SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS json FROM nation")(lambda s, d: sinks.as_json(lt.table(s, d, "nation").select("n_nationkey", "n_name")))
query("s20_content_keys", f"SELECT sha256({_T}) AS content_key, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1")(lambda s, d: _documents(s, d).groupBy(F.sha2("text", 256).alias("content_key")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")))



def cache_requests(s: SparkSession, d: str) -> DataFrame:
    """Requests for the readings of documents: an event asks for the content of one document, every 50th for a new reading."""
    e = lt.table(s, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.floor(F.col("user_id") * 7 % 200 + F.col("event_id") % 3).alias("doc_id"), (F.col("event_id") % 50 == 0).alias("fresh"))
    return e.join(_documents(s, d).select("doc_id", F.sha2("text", 256).alias("key")), "doc_id").select("id", "at", "key", "fresh")


# One cache large enough for all its keys, so that SQL can follow a key by itself; eviction is held against a plain table in tests.
query("s20_cache_log", f"""WITH RECURSIVE r AS (SELECT event_id AS id, ts, sha256({_T}) AS key, event_id % 50 = 0 AS fresh FROM events JOIN documents ON doc_id = user_id * 7 % 200 + event_id % 3),
  o AS (SELECT *, epoch_us(ts) / 1e6 AS sec, row_number() OVER (PARTITION BY key ORDER BY ts, id) AS n FROM r),
  c AS (SELECT key, n, id, sec AS put, 'miss' AS outcome, NULL::DOUBLE AS age FROM o WHERE n = 1
    UNION ALL SELECT o.key, o.n, o.id, CASE WHEN o.fresh OR o.sec - c.put > 86400 THEN o.sec ELSE c.put END, CASE WHEN o.fresh THEN 'refreshed' WHEN o.sec - c.put > 86400 THEN 'expired' ELSE 'hit' END, CASE WHEN NOT o.fresh AND o.sec - c.put <= 86400 THEN o.sec - c.put END FROM c JOIN o ON o.key = c.key AND o.n = c.n + 1)
  SELECT id, key, outcome, round(age, 3) AS age FROM c""")(lambda s, d: ld.cache_log(cache_requests(s, d), most=1_000_000).select("id", "key", "outcome", F.round("age", 3).alias("age")))
query("s20_evicting_cache_log")(lambda s, d: ld.cache_log(cache_requests(s, d), shards=4, most=20))

# Streams
def _streamed(s: SparkSession, d: str, build, mode: str = "append") -> DataFrame:
    """Runs a stream over the events once into a memory of files, and returns what it wrote."""
    at = f"{shared_root(s)}/stream-{uuid.uuid4().hex}"
    lt.uploads(s, d).write.parquet(f"{at}/in")
    stream = build(jobs.read_files(s, f"{at}/in", lt.uploads(s, d).schema))
    s.createDataFrame([], stream.schema).write.parquet(f"{at}/out/batch=-1")
    jobs.run_once(stream, f"{at}/state", lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out/batch={n}"), mode)
    remove(s, f"{at}/in", f"{at}/state")
    return s.read.schema(stream.schema).parquet(f"{at}/out").select(*stream.columns)


query("st1_upload_bursts", w("SELECT user_id, start, start + INTERVAL 1 HOUR AS \"end\", count(*) AS uploads FROM (SELECT user_id, unnest([time_bucket(INTERVAL 5 MINUTE, uploaded_at) - to_minutes(5 * k) FOR k IN range(12)]) AS start FROM uploads) GROUP BY ALL HAVING count(*) > 1", "uploads"))(lambda s, d: jobs.upload_bursts(lt.uploads(s, d), over=1))
query("st2_daily_buckets", w("SELECT uploaded_at::DATE AS date, doc_type, count(*) AS count FROM uploads GROUP BY ALL", "uploads"))(lambda s, d: _streamed(s, d, jobs.daily_buckets, "update").groupBy("date", "doc_type").agg(F.max("count").alias("count")))
query("st5_first_seen", w("SELECT DISTINCT user_id, doc_type FROM uploads", "uploads"))(lambda s, d: _streamed(s, d, lambda x: jobs.first_seen(x, "user_id", "doc_type", late="60 days").select("user_id", "doc_type")))
query("st7_sessions", w("WITH g AS (SELECT user_id, uploaded_at, CASE WHEN uploaded_at - lag(uploaded_at) OVER (PARTITION BY user_id ORDER BY uploaded_at) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM uploads), h AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY uploaded_at ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(uploaded_at) AS start, count(*) AS uploads FROM h GROUP BY user_id, k", "uploads"))(lambda s, d: jobs.sessions(lt.uploads(s, d)))
