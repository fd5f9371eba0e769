"""Queries over boxes: readings of several engines, rows, fields beside labels, and grids from columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlake.functions import text as tx
from dossierlake.operators import boxes as bx
from dossierlake.operators import layout as ly
from dossierlake.operators import votes as vt
from dossierlake.plans import sheet_queries as sq
from dossierlake.plans._registry import query
from dossierlake.plans.text_queries import _BAND, _WORDS, gridded, words


def engine_readings(s: SparkSession, d: str) -> DataFrame:
    """Three readings of each word, each a little off, some of other letters; their numbers don't follow the page."""
    w = ly.clean_words(words(s, d)).select("doc", "page", "word_id", "text", "conf", "x1", "y1", "x2", "y2")
    x = w.withColumn("engine", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    p, e = F.col("word_id"), F.col("engine")
    off, down = (p * 7 + e * 5) % 23, (p + e * 3) % 4
    text = F.when((e == 2) & (p % 7 == 0), tx.capitals(F.col("text"))).when((e == 1) & (p % 5 == 0), F.concat("text", F.lit("_"))).otherwise(F.col("text"))
    return x.select("doc", "page", (e * 1000 + (p * 37 + e) % 997).alias("word_id"), text.alias("text"), (F.col("conf") - e * 0.05).alias("conf"), *[(F.col(c) + (off if c[0] == "x" else down)).alias(c) for c in ("x1", "y1", "x2", "y2")])


_READINGS = f"""{_WORDS}, rd AS (SELECT doc, page, e * 1000 + (word_id * 37 + e) % 997 AS id, CASE WHEN e = 2 AND word_id % 7 = 0 THEN upper(text) WHEN e = 1 AND word_id % 5 = 0 THEN text || '_' ELSE text END AS text, conf - e * 0.05 AS conf,
    x1 + (word_id * 7 + e * 5) % 23 AS x1, y1 + (word_id + e * 3) % 4 AS y1, x2 + (word_id * 7 + e * 5) % 23 AS x2, y2 + (word_id + e * 3) % 4 AS y2 FROM ok, unnest([0, 1, 2]) AS u(e)),
  ov AS (SELECT a.doc, a.page, a.id AS a, b.id AS b, greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS v, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s
    FROM rd a JOIN rd b ON a.doc = b.doc AND a.page = b.page AND a.id < b.id),
  ne AS (SELECT doc, page, b AS id, list(a ORDER BY a) AS earlier FROM ov WHERE round(v / (s - v), 6) > 0.4 GROUP BY ALL),
  od AS (SELECT doc, page, id, coalesce(earlier, []) AS earlier, row_number() OVER (PARTITION BY doc, page ORDER BY id) AS n FROM rd LEFT JOIN ne USING (doc, page, id)),
  st AS (SELECT doc, page, n, id, [id] AS leaders, id AS leader FROM od WHERE n = 1
    UNION ALL SELECT od.doc, od.page, od.n, od.id, CASE WHEN len(list_filter(od.earlier, lambda x: list_contains(st.leaders, x))) = 0 THEN list_append(st.leaders, od.id) ELSE st.leaders END, coalesce(list_filter(od.earlier, lambda x: list_contains(st.leaders, x))[1], od.id)
      FROM st JOIN od ON od.doc = st.doc AND od.page = st.page AND od.n = st.n + 1),
  gr AS (SELECT st.doc, st.page, st.id AS word_id, leader, dense_rank() OVER (PARTITION BY st.doc, st.page ORDER BY floor(l.y1 / 15), l.x1, leader) AS place FROM st JOIN rd l ON l.doc = st.doc AND l.page = st.page AND l.id = leader)"""
_READINGS = _READINGS.replace("WITH ", "WITH RECURSIVE ", 1)
query("j16_reading_groups", f"{_READINGS} SELECT * FROM gr")(lambda s, d: bx.box_groups(engine_readings(s, d)))


@query("j16_group_votes", f"""{_READINGS}, w AS (SELECT gr.doc, gr.page, leader, text, sum(conf + 0.1::DOUBLE) AS weight FROM gr JOIN rd ON rd.doc = gr.doc AND rd.page = gr.page AND rd.id = gr.word_id GROUP BY ALL)
  SELECT doc, page, leader, text, round(weight, 4) AS weight FROM w QUALIFY row_number() OVER (PARTITION BY doc, page, leader ORDER BY round(weight, 6) DESC, text) = 1""")
def group_votes(s: SparkSession, d: str) -> DataFrame:
    """What the readings of each group agree on."""
    return vt.weighted(bx.box_groups(engine_readings(s, d), keep=["text", "conf"]), ["doc", "page", "leader"], "text", "conf", 0.1)


query("m17_box_rows", f"""{_WORDS}, r AS (SELECT *, max(y2) OVER (PARTITION BY doc, page ORDER BY y1, word_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ok)
  SELECT doc, page, word_id, sum(CASE WHEN y1 > reach + 8.0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc, page ORDER BY y1, word_id) AS row FROM r""".replace("AS row ", 'AS "row" '))(lambda s, d: bx.box_rows(ly.clean_words(words(s, d)), 8.0).select("doc", "page", "word_id", "row"))




@query("j15_mapped_fields")
def mapped(s: SparkSession, d: str) -> DataFrame:
    """Fields of the sheets of all customers, by their labels."""
    return bx.mapped_fields(sq.sheet_words(s, d))


# The same on words of conversations, whose labels and values are those of prose.
_PROSE = {"label_the": bx.Field("^(?:the|and)$", "^[a-z]{5,}$", 250, 40), "label_of": bx.Field("^of$", "[a-z]{3,}", 90, 30), "own": bx.Field("^to$", "x", 0, 0)}
query("j15_mapped_words", f"""{_WORDS}, f(field, labels, val, reach, fall) AS (VALUES {', '.join(f"('{n}', '{f.labels}', '{f.value}', {float(f.right)}, {float(f.below)})" for n, f in _PROSE.items())}),
  lb AS (SELECT doc, page, field, val, reach, fall, word_id AS label_id, text AS label, x2 AS edge, (x1 + x2) / 2 AS lx, (y1 + y2) / 2 AS ly FROM ok JOIN f ON regexp_matches(text, labels, 'i') QUALIFY row_number() OVER (PARTITION BY doc, page, field ORDER BY conf DESC, word_id) = 1),
  cd AS (SELECT lb.*, o.word_id, trim(o.text) AS value, sqrt(pow((o.x1 + o.x2) / 2 - lx, 2) + pow((o.y1 + o.y2) / 2 - ly, 2)) AS far FROM lb JOIN ok o ON o.doc = lb.doc AND o.page = lb.page AND o.word_id <> label_id
    WHERE reach > 0 AND ((o.x1 + o.x2) / 2 - edge BETWEEN 0 AND reach OR (o.y1 + o.y2) / 2 - ly BETWEEN 0 AND fall) AND regexp_matches(trim(o.text), val, 'i') AND len(regexp_extract_all(o.text, '[0-9]')) <= 5)
  SELECT doc, page, field, label, value, round(far, 6) AS distance FROM cd QUALIFY row_number() OVER (PARTITION BY doc, page, field ORDER BY far, word_id) = 1
  UNION ALL SELECT doc, page, field, label, trim(label), 0.0 FROM lb WHERE reach = 0""")(lambda s, d: bx.mapped_fields(ly.clean_words(words(s, d)), _PROSE))
_CUTS = """oc AS (SELECT doc, page, greatest(0, greatest(0, floor(x1)::INT) - 2) AS a, least({w}, least({w}, floor(x2)::INT) + 3) AS b FROM {t} WHERE least({w}, floor(x2)::INT) > greatest(0, floor(x1)::INT)),
  rc AS (SELECT *, coalesce(max(b) OVER (PARTITION BY doc, page ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, 0) AS start FROM oc),
  ct AS (SELECT doc, page, ((start + a) // 2)::INT AS cut FROM rc WHERE a - start >= {g} UNION SELECT doc, page, ((max(b) + 1 + {w} + 1) // 2)::INT FROM oc GROUP BY ALL HAVING {w} + 1 - (max(b) + 1) >= {g}),
  ed AS (SELECT doc, page, CASE WHEN cuts IS NULL THEN [0, {w}] ELSE list_concat(list_concat([0], cuts), [{w}]) END AS e FROM (SELECT DISTINCT doc, page FROM {t}) LEFT JOIN (SELECT doc, page, list(DISTINCT cut ORDER BY cut) AS cuts FROM ct GROUP BY ALL) USING (doc, page))"""
query("r17_column_gaps", f"{_WORDS}, {_CUTS.format(w=1000, g=20, t='ok')} SELECT doc, page, unnest(range(0, len(e) - 1))::INT AS column, unnest(e[:-2])::INT AS x_left, unnest(e[2:])::INT AS x_right FROM ed".replace("AS column,", 'AS "column",'))(lambda s, d: ly.column_gaps(ly.clean_words(words(s, d))))
query("r17_column_grid", f"""{_BAND}, sz AS (SELECT doc, page, line, count(*) AS tokens FROM b GROUP BY ALL), wd2 AS (SELECT *, tokens >= greatest(2.0, max(tokens) OVER (PARTITION BY doc, page) * 0.5) AS wide FROM sz),
  tb AS (SELECT doc, page, line FROM wd2 QUALIFY line BETWEEN min(line) FILTER (wide) OVER (PARTITION BY doc, page) AND max(line) FILTER (wide) OVER (PARTITION BY doc, page)),
  ins AS (SELECT b.*, (x1 + x2) / 2 AS cx FROM b SEMI JOIN tb USING (doc, page, line)), {_CUTS.format(w=1488, g=18, t='ins')},
  pl AS (SELECT doc, page, line, word_id, x1, text, len(e) - 1 AS n, CASE WHEN len(list_filter(e, lambda x: x <= cx)) BETWEEN 1 AND len(e) - 1 THEN len(list_filter(e, lambda x: x <= cx)) - 1 ELSE len(e) - 2 END AS k FROM ins JOIN ed USING (doc, page)),
  ce AS (SELECT doc, page, line, n, k, string_agg(trim(text), ' ' ORDER BY x1, word_id) AS t FROM pl GROUP BY ALL),
  hd AS (SELECT doc, page, line, any_value(n) AS n, map_from_entries(list((k, t))) AS m FROM ce GROUP BY doc, page, line)
  SELECT doc, page, line, array_to_string(list_transform(range(0, n), lambda i: coalesce(m[i], '')), ' | ') AS cells FROM hd""")(
    lambda s, d: bx.column_grid(gridded(s, d)).select("doc", "page", "line", F.concat_ws(" | ", "cells").alias("cells")))
