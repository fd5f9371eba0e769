"""Operators on documents that SQL can't follow, against brute force on small fixtures."""

from __future__ import annotations

import random
import re
import statistics
import subprocess
import sys
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from dossierlake.functions import correction as co
from dossierlake.functions import names as nm
from dossierlake.functions import parsers as ps
from dossierlake.operators import documents as dc
from dossierlake.operators import layout as ly
from dossierlake.plans import basic_queries as bq
from dossierlake.plans import document_queries as dq

WORDS = "doc long, page long, word_id int, text string, conf double, x1 double, y1 double, x2 double, y2 double"


def test_queries_are_named_without_a_session():
    """The driver asks for names and SQL before it has Spark."""
    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=".")


@pytest.fixture(scope="module")
def scattered() -> list[tuple]:
    r = random.Random(7)
    rows = []
    for page in range(6):
        for i in range(r.choice((1, 14, 30))):
            x, y = r.randrange(0, 900), r.randrange(0, 12) * 25 + r.randrange(4)
            text = r.choice(("the", "name: Asha", "75.17", "12%", "Name", "of", "Name Rao", "long-word"))
            rows.append((1, page, i, text, 0.9, float(x), float(y), float(x + 8 * len(text)), float(y + 20)))
    return rows


@pytest.fixture(scope="module")
def words(spark, scattered):
    return ly.clean_words(spark.createDataFrame(scattered, WORDS)).withColumn("line", F.floor(F.col("y1") / 25))


def pages(rows):
    out = defaultdict(list)
    for r in rows:
        out[r[0], r[1]].append({"id": r[2], "text": r[3], "x1": r[5], "y1": r[6], "x2": r[7], "y2": r[8], "cx": (r[5] + r[7]) / 2, "cy": (r[6] + r[8]) / 2})
    return out


def to_right(w, page):
    near = [x for x in page if x is not w and abs(x["cy"] - w["cy"]) < 16 and x["x1"] >= w["x2"]]
    return min(near, key=lambda x: (x["x1"] - w["x2"], x["id"]), default=None)


def below(w, page):
    near = [x for x in page if x is not w and x["cy"] > w["cy"] and abs(x["cx"] - w["cx"]) < 50]
    return min(near, key=lambda x: (x["cy"] - w["cy"], x["id"]), default=None)


def test_nearest_words(words, scattered):
    right = {(r["page"], r["a"]): r["right"] for r in ly.nearest_right(words).collect()}
    under = {(r["page"], r["a"]): r["below"] for r in ly.nearest_below(words).collect()}
    for (_, page), rows in pages(scattered).items():
        for w in rows:
            assert right.get((page, w["id"])) == (to_right(w, rows) or {}).get("id")
            assert under.get((page, w["id"])) == (below(w, rows) or {}).get("id")


def test_label_values(words, scattered):
    want = set()
    for (_, page), rows in pages(scattered).items():
        seen = set()
        for w in sorted(rows, key=lambda x: x["id"]):
            if not re.search("name|the", w["text"].lower()):
                continue
            found = [("nearest_right", to_right(w, rows)), ("nearest_below", below(w, rows))]
            hop = found[0][1]
            for _ in range(2):
                hop = to_right(hop, rows) if hop else None
                found.append(("right_hop", hop))
            rest = re.sub("(?i)name|the", "", w["text"]).strip(" :/-|")
            values = [(s, x["text"]) for s, x in found if x] + ([("inline", rest)] if rest and rest != w["text"] else [])
            for s, value in values:
                if value not in seen:
                    seen.add(value)
                    want.add((page, w["id"], value, s))
    assert {(r["page"], r["label_id"], r["value"], r["strategy"]) for r in ly.label_values(words, ["name", "the"]).collect()} == want


def test_anchor_scores(words, scattered):
    got = {(r["page"], r["anchor_id"]): (r["word_id"], r["score"]) for r in ly.anchor_scores(words, bq._anchors(words)).collect()}
    for (_, page), rows in pages(scattered).items():
        for a in (w for w in rows if w["id"] % 10 == 0):
            best = None
            for w in rows:
                if w is a:
                    continue
                far = ((w["cx"] - a["cx"]) ** 2 + (w["cy"] - a["cy"]) ** 2) ** 0.5
                score = 40 * (1 - far / 500) if far < 500 else 0
                if abs(w["cy"] - a["cy"]) < 20:
                    score += 10 + 10 * (w["x1"] > a["x2"])
                elif abs(w["cx"] - a["cx"]) < 50:
                    score += 10 + 10 * (w["y1"] > a["y2"])
                score += 10 * (w["y1"] // 25 == a["y1"] // 25) + 10 + 20 * (a["id"] % 20 == 0 and "%" in w["text"])
                if best is None or (round(score, 6), -w["id"]) > (best[1], -best[0]):
                    best = (w["id"], round(score, 6))
            if best:
                assert got[page, a["id"]][0] == best[0] and abs(got[page, a["id"]][1] - best[1]) < 1e-5


def test_column_gaps(words, scattered):
    got = defaultdict(list)
    for r in ly.column_gaps(words).orderBy("page", "column").collect():
        got[r["page"]].append((r["x_left"], r["x_right"]))
    for (_, page), rows in pages(scattered).items():
        on = [False] * 1001
        for w in rows:
            if min(1000, int(w["x2"])) > int(w["x1"]):
                for x in range(max(0, int(w["x1"]) - 2), min(1000, min(1000, int(w["x2"])) + 3) + 1):
                    on[x] = True
        cuts, start = [0], None
        for x in range(1002):
            free = x <= 1000 and not on[x]
            if free and start is None:
                start = x
            if not free and start is not None:
                if x - start >= 20:
                    cuts.append((start + x) // 2)
                start = None
        cuts.append(1000)
        assert got[page] == (list(zip(cuts, cuts[1:], strict=False)) if len(cuts) > 2 else [(0, 1000)])


def test_positioned_text(words, scattered):
    got = {(r["page"], r["line"]): r["text"] for r in ly.positioned_text(words).collect()}
    for (_, page), rows in pages(scattered).items():
        char = min(max(statistics.median((w["x2"] - w["x1"]) / len(w["text"]) for w in rows), 5.0), 15.0)
        for line in {w["y1"] // 25 for w in rows}:
            slots = {}
            for w in sorted((w for w in rows if w["y1"] // 25 == line), key=lambda w: (w["x1"], w["id"])):
                slots[int(w["x1"] // char)] = w["text"]
            shown = [" "] * 400
            for column, text in sorted(slots.items()):
                shown[column : column + len(text)] = text
            assert got[page, line] == "".join(shown).rstrip()


def test_wrapped_lines(spark):
    r = random.Random(4)
    rows = []
    for page in range(8):
        y = 0.0
        for n in range(r.randint(1, 12)):
            x = float(r.choice((0, 10, 40, 60, 300)))
            rows.append((1, page, n, x, x + r.choice((50, 200, 400)), y, y + 20, r.randint(1, 7), y + 10))
            y += r.choice((22, 30, 90))
    frame = spark.createDataFrame(rows, "doc long, page long, line long, x1 double, x2 double, y1 double, y2 double, tokens long, cy double")
    got = {(x["page"], x["line"]): x["logical"] for x in ly.wrapped_lines(frame).collect()}
    for page in range(8):
        mine = sorted(x for x in rows if x[1] == page)
        falls = [b[8] - a[8] for a, b in zip(mine, mine[1:], strict=False)]
        spacing, margin, groups = statistics.median(falls) if falls else 15.0, min(x[3] for x in mine), []
        for x in mine:
            joins = False
            if groups:
                left, right, low = min(g[3] for g in groups[-1]), max(g[4] for g in groups[-1]), max(g[6] for g in groups[-1])
                joins = x[3] > margin + 20 and x[4] >= left and x[3] <= right and x[5] - low < 1.5 * spacing and (x[7] < 5 or x[3] >= left)
            groups[-1].append(x) if joins else groups.append([x])
        assert [got[page, x[2]] for x in mine] == [k for k, g in enumerate(groups) for _ in g]


def test_table_rows_that_continue(spark):
    r = random.Random(9)
    rows, want = [], {}
    for page in range(12):
        grid = []
        for n in range(r.randint(2, 9)):
            cells = [r.choice(("", "", "rent", "food x")) for _ in range(4)] if r.random() < 0.6 else ["01/02/2024", "pay", "12", "3.50"]
            grid.append(cells)
            rows += [(1, page, n, k, t, 200.0 * k, 0.0, 200.0 * k + 50, 10.0, 1, 200.0 * k + 25) for k, t in enumerate(cells) if t]
        used = [k for k in range(4) if sum(bool(c[k]) for c in grid) >= 2]
        anchors = [k for k in range(4) if any(c[k] for c in grid)]
        out = []
        for cells in grid:
            if not any(cells):
                continue
            if used:
                placed = [[] for _ in used]
                for k in anchors:
                    if cells[k]:
                        placed[min(range(len(used)), key=lambda i: (abs(used[i] - k), i))].append(cells[k])
                row = [" ".join(x) for x in placed]
            else:
                row = [" ".join(c for c in cells if c)]
            text = [c for c in row if c]
            date = re.search(r"(?i)\b(\d{1,2}[-/\s]?\w{3}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4})\b", " ".join(text))
            number = re.search(r"\d", " ".join(text))
            if out and len(text) < 0.65 * len(row) and not date and not (number and len(text) >= 2) and sum(map(bool, out[-1])) >= 2:
                out[-1] = [f"{a} {b}".strip() for a, b in zip(out[-1], row, strict=True)]
            else:
                out.append(row)
        want[page] = out
    frame = spark.createDataFrame(rows, "doc long, page long, line long, phrase long, text string, x1 double, y1 double, x2 double, y2 double, words long, cx double")
    got = defaultdict(list)
    for x in ly.table_grid(frame).orderBy("page", "row").collect():
        got[x["page"]].append(x["cells"])
    assert got == {k: v for k, v in want.items() if v}


def test_transactions(spark):
    grids = {
        1: [["Statement", "", "", ""], ["Date", "Narration", "Withdrawal", "Balance"], ["01/02/2024", "rent", "10.00", "90.00"], ["", "more", "", ""], ["02 Feb 24", "a", "", "80.00"]],
        2: [["01/02/2024", "ABCDEF1234567", "5.00", "95.00"], ["02/02/2024", "ABCDEF7654321", "6.00", "89.00"]],
        3: [["12", "34", "", ""], ["x", "", "", ""]],
    }
    frame = spark.createDataFrame([(d, 1, i, c) for d, g in grids.items() for i, c in enumerate(g)], "doc long, page long, row long, cells array<string>")
    got = sorted((r["doc"], r["row"], r["date"], r["description"], r["amount"], r["balance"], r["ref"]) for r in ly.transactions(frame).collect())
    assert got == [
        (1, 2, "01/02/2024", "rent", "", "90.00", ""),
        (1, 4, "02 Feb 24", "a", "", "80.00", ""),
        (2, 0, "01/02/2024", "", "5.00", "95.00", "ABCDEF1234567"),
        (2, 1, "02/02/2024", "", "6.00", "89.00", "ABCDEF7654321"),
    ]


def test_subjects(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(dq.SHEETS)], "id long, text string")
    got = sorted((r["id"], r["subject"], r["marks_obtained"], r["marks_total"], r["grade"]) for r in dc.subjects(rows, "id").collect())
    assert got == [
        (0, "English", 65.0, 100.0, "Above Average"),
        (0, "Mathematics", 72.0, 100.0, "Very Good"),
        (1, "English", 65.0, None, "Above Average"),
        (1, "Mathematics", 72.0, 100.0, "Very Good"),
        (1, "Science", 88.0, None, None),
        (2, "Chemistry", 60.0, 75.0, "Average"),
        (2, "Physics", 55.0, 75.0, None),
        (3, "Art", 9.0, None, None),
        (3, "History", 45.0, None, None),
    ]


def test_names_that_sound_alike(spark):
    pairs = [("asha rao", "aasha rau"), ("rao asha", "asha rao"), ("robert", "rupert"), ("x", ""), ("asha", "asha rao devi")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", nm.name_score(F.col("a"), F.col("b")).alias("s"), nm.sorted_ratio("a", "b").alias("r")).collect()
    found = {(r["a"], r["b"]): r["s"] for r in rows}
    assert found["asha rao", "aasha rau"] >= 95 * 0.95 and found["rao asha", "asha rao"] == 100 and found["x", ""] == 0 and found["robert", "rupert"] == 95.0
    for r in rows:
        longest = [nm.indel_ratio(*x) for x in ((r["a"], r["b"]), tuple(" ".join(sorted(y.split())) for y in (r["a"], r["b"])))]
        assert r["r"] == (max(longest) if r["a"] and r["b"] else 0.0)


def test_suggestions(spark):
    rows = [("Asha Rao", "AshaRao", "MISMATCH", 40.0), ("Asha Rao", "Asha Raq", "POSSIBLE_MATCH", 90.0), ("Asha Rao", None, "MISMATCH", 0.0), ("Asha Rao", "Zed", "MISMATCH", 10.0), ("Asha Rao", "Asha Rao", "MATCH", 100.0)]
    got = spark.createDataFrame(rows, "stored string, x string, status string, score double").select(co.suggestion(*[F.col(c) for c in ("stored", "x", "status", "score")]).alias("g")).select("g.*").collect()
    assert [tuple(r) for r in got] == [("Asha Rao", "merged_word_fix", True, 100), ("Asha Rao", "ocr_typo_fix", True, 97), (None, "manual_required", False, 0), (None, "manual_required", False, 10), ("Asha Rao", "no_correction", False, 100)]


def test_numbers_and_kinds(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()[0]
    assert one(ps.twelve_digits(F.lit("x 2345-6789-0123"))) == "2345 6789 0123" and one(ps.twelve_digits(F.lit("1999 6789 0123"))) is None
    assert one(ps.twelve_digits(F.lit("no\n 2345 67890123 \n"))) == "2345 6789 0123"
    assert one(ps.born(F.lit("on 01-02-1990"))) == "01/02/1990" and one(ps.born(F.lit("YOB: 1975"))) == "1975" and one(ps.born(F.lit("05.06.27"))) == "05/06/1927"
    kind = one(ps.academic_kind(F.lit("SSC state board total marks 500 obtained marks 412")))
    assert kind["document_type"] == "ssc" and 30 <= kind["confidence"] <= 99
    assert one(ps.academic_kind(F.lit(None).cast("string")))["document_type"] == "unknown"


def test_grids_need_no_join_and_no_page_in_one_batch(spark, tiny):
    from dossierlake.plans.registry import QUERIES

    grid = QUERIES["r13_table_grid"](spark, tiny)
    plan = grid._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
    r = random.Random(8)
    rows = [(doc, page, line, k, r.choice(("a", "bc", "12", "01/02/2024", " ", "")), float(10 + 200 * k), float(10 + 200 * k + r.randrange(60))) for doc, page, n in ((1, 1, 30), (1, 2, 1), (2, 2, 9), (None, 2, 4), (2, None, 4)) for line in range(n) for k in range(4) if r.random() < 0.6]
    rows += [(3, 1, 0, 0, None, 1.0, 1.0), (3, 1, 0, 1, "x", 2.0, 2.0), (3, 1, 1, 0, "y", 1.0, 1.0)]
    parts = spark.createDataFrame(rows, "doc long, page long, line long, phrase long, text string, x1 double, cx double").repartition(3)
    whole = sorted(((x["doc"], x["page"], x["row"], x["cells"]) for x in ly.table_grid(parts).collect()), key=str)
    assert {len(x[3]) for x in whole if x[:2] == (1, 1)} == {4} and [x[3] for x in whole if x[0] == 3] == [["x"], ["y"]]
    for size in (1, 6, 50):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            assert sorted(((x["doc"], x["page"], x["row"], x["cells"]) for x in ly.table_grid(parts).collect()), key=str) == whole
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("anchors", [[5.0], [1.0, 2.0, 4.0], [0.0, 10.0, 10.5]])
def test_the_nearest_of_anchors_is_the_first_of_equals(anchors):
    for x in [k / 4 for k in range(-8, 60)]:
        assert ly._nearest_of(anchors, x) == min(range(len(anchors)), key=lambda i: (abs(x - anchors[i]), i))
