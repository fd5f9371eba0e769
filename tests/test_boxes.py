"""Boxes against plain walks over each page."""

from __future__ import annotations

import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from dossierlake.operators import boxes as bx
from dossierlake.plans.registry import QUERIES, SQL
from tests.oracle import assert_same

WORDS = "doc long, page long, word_id int, text string, conf double, x1 double, y1 double, x2 double, y2 double"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(12)
    pool = ("Percentage", "75.17", "CGPA", "8.4", "Result", "PASS", "Grade", "First Class", "year", "2019", "Board of X", "123456", "Rao", "61%")
    out = []
    for page in range(40):
        for i in range(r.choice((1, 8, 25))):
            x, y = r.randrange(0, 400, 5), r.randrange(0, 120, 3)
            out.append((1, page, i, r.choice(pool), r.choice((0.7, 0.8, 0.9)), float(x), float(y), float(x + r.choice((30, 45, 60))), float(y + r.choice((12, 18, 20)))))
    return out


def by_page(rows):
    out = {}
    for w in rows:
        out.setdefault(w[1], []).append(w)
    return out


def overlap(a, b):
    w, h = min(a[7], b[7]) - max(a[5], b[5]), min(a[8], b[8]) - max(a[6], b[6])
    v = max(0, w) * max(0, h)
    return v / ((a[7] - a[5]) * (a[8] - a[6]) + (b[7] - b[5]) * (b[8] - b[6]) - v)


def test_greedy_groups(spark, rows):
    want, sizes = [], []
    for page, words in by_page(rows).items():
        used, groups = set(), []
        for a in words:
            if a[2] in used:
                continue
            group = [b for b in words if b[2] not in used and (b is a or round(overlap(a, b), 6) > 0.4)]
            used |= {b[2] for b in group}
            groups.append((a, group))
            sizes.append(len(group))
        groups.sort(key=lambda g: (g[0][6] // 15, g[0][5], g[0][2]))
        want += [(1, page, b[2], a[2], k + 1) for k, (a, group) in enumerate(groups) for b in group]
    assert max(sizes) > 2
    assert sorted(map(tuple, bx.box_groups(spark.createDataFrame(rows, WORDS).repartition(3)).collect())) == sorted(want)


@pytest.mark.parametrize("name", ["j16_reading_groups", "j16_group_votes"])
def test_readings_cross_no_join_however_small_their_texts(spark, tiny, name):
    plan = QUERIES[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan


def test_groups_of_pages_across_batches(spark):
    r = random.Random(3)
    boxes = [(doc, page, i, "t", 0.9, float(x), float(y), float(x + 30), float(y + 20)) for doc, page, n in ((None, 1, 3), (1, 1, 40), (1, 2, 1), (1, None, 2), (2, 1, 25), (2, 2, 90)) for i in range(n) for x, y in [(r.randrange(0, 60, 3), r.randrange(0, 60, 3))]]
    boxes += [(3, 1, 0, "t", 0.9, None, 1.0, 2.0, 3.0), (3, 1, 1, "t", 0.9, 5.0, 1.0, 5.0, 3.0), (3, 1, 2, "t", 0.9, 5.0, 1.0, 5.0, 3.0), (3, 1, None, "t", 0.9, 5.0, 1.0, 9.0, 3.0)]
    df = spark.createDataFrame(boxes, WORDS)
    whole = sorted(map(tuple, bx.box_groups(df, keep=["conf"]).collect()))
    assert len(whole) == 159 and {x[:5] for x in whole if x[0] == 3} == {(3, 1, 0, 0, 1), (3, 1, 1, 1, 2), (3, 1, 2, 2, 3)}
    for size in (1, 7, 40):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            assert sorted(map(tuple, bx.box_groups(df, keep=["conf"]).collect())) == whole
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rows_of_boxes(spark, rows):
    want = []
    for page, words in by_page(rows).items():
        row, bottom = 0, None
        for w in sorted(words, key=lambda w: (w[6], w[2])):
            if bottom is not None and w[6] > bottom + 4:
                row, bottom = row + 1, None
            bottom = w[8] if bottom is None else max(bottom, w[8])
            want.append((page, w[2], row))
    assert max(r for *_, r in want) > 1
    assert sorted((r["page"], r["word_id"], r["row"]) for r in bx.box_rows(spark.createDataFrame(rows, WORDS), 4.0).collect()) == sorted(want)


def test_fields_beside_their_labels(spark, rows):
    want = set()
    for page, words in by_page(rows).items():
        for name, f in bx.FIELDS.items():
            labels = [w for w in words if re.search(f.labels, w[3], re.I)]
            if not labels:
                continue
            a = max(labels, key=lambda w: w[4])
            if not f.right:
                want.add((page, name, a[3], a[3].strip(), 0.0))
                continue
            lx, ly, best = (a[5] + a[7]) / 2, (a[6] + a[8]) / 2, None
            for b in words:
                cx, cy = (b[5] + b[7]) / 2, (b[6] + b[8]) / 2
                if b is a or not re.search(f.value, b[3].strip(), re.I) or not (0 <= cx - a[7] <= f.right or 0 <= cy - ly <= f.below) or len(re.findall(r"\d", b[3])) > 5:
                    continue
                far = math.hypot(cx - lx, cy - ly)
                if best is None or far < best[0]:
                    best = far, b[3].strip()
            if best:
                want.add((page, name, a[3], best[1], round(best[0], 6)))
    assert {w[1] for w in want} >= {"percentage", "cgpa", "result", "grade_class", "passing_year", "board_university"}
    assert {tuple(r)[1:] for r in bx.mapped_fields(spark.createDataFrame(rows, WORDS).repartition(2)).collect()} == want


def test_grids_and_empty_tables(spark):
    rows = [(1, 1, i, t, 0.9, float(x), float(y), float(x + 40), float(y + 10)) for i, (t, x, y) in enumerate([("head", 10, 0), ("a", 10, 50), ("b", 200, 50), ("c", 400, 50), ("d ", 12, 80), ("e", 205, 80), ("f", 215, 80), ("g", 405, 80), ("foot", 10, 120)])]
    df = spark.createDataFrame(rows, WORDS).withColumn("line", F.floor(F.col("y1") / 30)).withColumn("cx", (F.col("x1") + F.col("x2")) / 2)
    assert sorted((r["line"], r["cells"]) for r in bx.column_grid(df).collect()) == [(1, ["a", "b", "c", ""]), (2, ["d", "e f", "g", ""])]
    none = df.limit(0)
    assert [f(none).collect() for f in (bx.box_groups, bx.box_rows, bx.mapped_fields, bx.column_grid)] == [[]] * 4


def test_votes_for_letters_whose_capital_is_spelt_out(spark, tmp_path):
    letters = [chr(c) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000 and len(chr(c).upper()) > 1]
    texts = [*letters, *"äéñдωᾼ", "a", "Straße", "Maßstäbe", "ﬁnß", "ΐᾳ", "ß̈"]
    rows = [(i, 1, f"a a a a a a a {t} x") for i, t in enumerate(texts)]
    spark.createDataFrame([*rows, (-1, 1, None)], "conv_id long, turn int, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    found = QUERIES["j16_group_votes"](spark, str(tmp_path)).toPandas()
    assert {"ß", "ẞ", "ᾼ", "ﬁ", "Ä", "Д", "A"} <= set(found["text"]) and not {"SS", "FI", "ΑΙ"} & set(found["text"])
    assert_same(found, duck.sql(SQL["j16_group_votes"]).df())
