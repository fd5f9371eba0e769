"""Fields of marksheets: known sheets, and scattered pages against a plain reading of the same rules."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from dossierlake.operators import sheets as sh

WORDS = "doc long, page long, word_id int, text string, conf double, x1 double, y1 double, x2 double, y2 double"


def row(text, x, y, step=90):
    return [(w, x + step * i, y) for i, w in enumerate(text.split())]


#: Invented sheets in the styles of five decades: texts and places of words, and what must be read.
SHEETS = {
    "old_board": (row("STATEMENT OF MARKS", 100, 10) + row("DIVISIONAL BOARD", 10, 40) + row("SEAT NO. F073000 MARCH-2000", 10, 80) + row("CANDIDATE'S FULL NAME", 10, 120) + row("WAGHRE SUNIL MADHAV", 10, 140) + row("MAXIMUM MARKS 100 100 150 750", 10, 200) + row("MARKS OBTAINED 075 070 122 535", 10, 240) + [("PERCENTAGE", 620, 200), ("71", 620, 240), ("33", 660, 240), ("RESULT", 720, 200), ("PASS", 720, 240)],
        {"name": "WAGHRE SUNIL MADHAV", "percentage": "71.33", "result": "PASS", "total_marks": "750.0", "passing_year": "2000"}),
    "statement": (row("HIGHER SECONDARY CERTIFICATE EXAMINATION", 100, 10) + row("CANDIDATE'S FULL NAME", 10, 100) + row("Rokade Amol Bhaskar", 10, 130) + row("CANDIDATE'S MOTHER'S NAME", 10, 160) + row("Nita", 10, 180) + row("54 PHYSICS ENG 100 071", 10, 250) + row("टकेवारी/ Percentage 75.17", 10, 380) + row("एकूण गुण/Total Marks 600 451", 350, 380) + row("Result/ निकाल PASS", 10, 420) + row("H225007000", 200, 500) + row("3713399945000", 10, 530),
        {"name": "Rokade Amol Bhaskar", "percentage": "75.17", "result": "PASS", "obtained_marks": "451.0", "total_marks": "600.0"}),
    "grace": (row("SECONDARY SCHOOL CERTIFICATE EXAMINATION", 100, 10) + row("This is to certify that", 10, 60) + row("Rokade Amol Bhaskar", 10, 90) + row("Mother Name", 10, 115) + row("Nita", 200, 115) + row("KOLHAPUR", 10, 165) + row("एकूण 500 £407+05", 10, 430) + row("PERCENTAGE £", 10, 470) + row("82.40", 200, 470) + row("DISTINCTION", 10, 510) + row("CS205008000", 300, 600),
        {"name": "Rokade Amol Bhaskar", "percentage": "£ 82.40", "result": "DISTINCTION", "obtained_marks": "412.0", "total_marks": "500.0"}),
    "certificate": (row("HIGHER SECONDARY CERTIFICATE", 100, 10) + row("This is to certify that", 10, 60) + row("Rokade Amol Bhaskar", 10, 90) + row("CANDIDATE'S MOTHER'S NAME Nita", 10, 120) + row("I-DIST with subjects shown below.", 200, 210) + row("टकेवारी/ Percentage 75.17", 10, 440) + row("गुण/Total Marks 600 451", 430, 440) + row("CH225006000", 200, 520),
        {"name": "Rokade Amol Bhaskar", "percentage": "75.17", "result": "DISTINCTION"}),
    "two_line_name": (row("CANDIDATE'S FULL NAME", 10, 100) + row("WAGHRE", 10, 130) + row("SUNIL MADHAV", 10, 160) + row("SEAT NO. F073000", 10, 190), {"name": "WAGHRE SUNIL MADHAV"}),
    "no_label": (row("Statement", 300, 10) + row("Tambe Uday Keshav", 300, 200) + row("77.50", 10, 900), {"name": "Tambe Uday Keshav", "percentage": "77.50"}),
    "grade_card": (row("Name: Ghorade Ravi Anand", 10, 100) + row("Mother Name: Nita", 500, 100) + row("Examination: EVEN 2023-24", 10, 140) + row("Semester IV SPI: 8.12", 10, 180) + row("of the course with all its papers and their credits as they were taken in this and in earlier years, now in", 10, 200, 5) + row("Semester V SPI: 8.31", 10, 220) + row("Cumulative SPI: 8.05", 10, 260) + row("CGPA: 8.40", 10, 300),
        {"name": "Ghorade Ravi Anand", "passing_year": "2023-2024", "spi": "8.31", "cgpa": "8.4", "semester_scores": '[{"semester":4,"spi":8.12},{"semester":5,"spi":8.31}]', "cpi": "8.05", "display_score": '{"type":"CPI","value":8.05}'}),
}


@pytest.fixture(scope="module")
def read(spark):
    rows = [(d, 1, i, t, 0.9, float(x), float(y), float(x + 80), float(y + 20)) for d, (words, _) in enumerate(SHEETS.values()) for i, (t, x, y) in enumerate(words)]
    out = {}
    for r in sh.sheet_fields(spark.createDataFrame(rows, WORDS).repartition(3)).collect():
        out.setdefault(list(SHEETS)[r["doc"]], {})[r["field"]] = r["value"]
    return out


@pytest.mark.parametrize("sheet", SHEETS)
def test_known_sheets(read, sheet):
    want = SHEETS[sheet][1]
    assert {k: read[sheet].get(k) for k in want} == want


def plain_lines(words):
    """Lines of (number, text, x, y, w, h), by walking down the page."""
    lines, last = [], None
    for w in sorted(words, key=lambda w: (w[5], w[4], w[2])):
        if last is None or abs(w[5] - last[5]) >= (last[7] - last[5]) * 0.6:
            lines.append([])
        lines[-1].append(w)
        last = w
    out = []
    for n, ws in enumerate(lines):
        ws = sorted(ws, key=lambda w: w[4])
        x, y = min(w[4] for w in ws), min(w[5] for w in ws)
        out.append((n, " ".join(w[3] for w in ws), x, y, max(w[6] for w in ws) - x, max(w[7] for w in ws) - y))
    return out


def number(t):
    t = t.strip()
    m = re.search(r"\b(\d{1,3}(?:\.\d{1,2})?)\b", t)
    return float(m[1]) if m and not re.search(sh.SERIAL, t) and float(m[1]) <= 100 else None


def plain_percentage(lines):
    """The best linked candidate, each line's neighbours found by looking at all others."""
    right, left, below = {}, {}, {}
    for a in lines:
        beside, under = float("inf"), float("inf")
        for b in lines:
            if a is b:
                continue
            gap = b[2] - a[2] - a[4]
            if abs(a[3] - b[3]) < a[5] * 0.8 and b[2] >= a[2] and 0 <= gap < beside:
                beside, right[a[0]], left[b[0]] = gap, b[0], a[0]
            gap = b[3] - a[3] - a[5]
            if b[3] > a[3] and max(a[2], b[2]) < min(a[2] + a[4], b[2] + b[4]) + 100 and 0 <= gap < under:
                under, below[a[0]] = gap, b[0]
    sign = lambda n: n is not None and re.search("percent|%", lines[n][1], re.I)
    seen, best = set(), None
    for a in lines:
        if not any(k in a[1].lower() for k in sh.PERCENT_LABELS):
            continue
        r1 = right.get(a[0])
        r2 = right.get(r1)
        rest = re.sub("|".join(sorted(map(re.escape, sh.PERCENT_LABELS), key=len, reverse=True)), "", a[1], flags=re.I).strip(" :/-|")
        options = [(lines[n][1], n, how) for n, how in ((r1, "nearest_right"), (below.get(a[0]), "nearest_below"), (r2, "right_hop"), (right.get(r2), "right_hop")) if n is not None]
        if rest and rest != a[1].strip():
            options.append((rest, a[0], "inline"))
        for value, n, how in options:
            if value in seen:
                continue
            seen.add(value)
            words, x = value.split(), number(value)
            if re.search(r"[A-Z]\d{6,}", value, re.I) or re.search(r"\d{8,}", value):
                score = -100
            elif x is None:
                score = -50
            else:
                score = 5 - 20 * any(re.match("^[A-Za-z]{3,}$", w) for w in words) + 4 * bool(re.search(r"\d\.\d", value)) + (3 if len(words) == 1 else len(words) == 2 and all(w.isdigit() for w in words)) + (x >= 30) + 3 * ("%" in value)
                score += 8 * bool(sign(left.get(n))) + 6 * any(b == n and sign(a2) for a2, b in below.items())
            if best is None or score > best[0]:
                best = (score, value, how)
    return best


def scattered(pages, seed=3):
    r = random.Random(seed)
    pool = ["Percentage", "75.17", "62", "%", "Aggregate:", "40.5%", "Percent 66.10", "H22500700", "PASS", "total", "12.5", "Name", "8", "99 50", "टकेवारी"]
    return [(0, p, i, r.choice(pool), 0.9, float(r.randrange(0, 700, 7)), float(r.choice((10, 24, 40, 41, 70, 84, 110)) + r.randrange(3)), 0.0, 0.0) for p in range(pages) for i in range(r.randint(1, 14))]


def test_linked_percentages_against_a_plain_reading(spark):
    rows = [(*w[:7], w[5] + 9 * len(w[3]), w[6] + 20) for w in scattered(150)]
    got = sh.sheet_pages(spark.createDataFrame(rows, WORDS)).select("page", F.transform("lines", lambda a: a["text"]).alias("texts"), sh._linked_percentage(F.col("lines")).alias("c")).collect()
    found = 0
    for g in got:
        words = [(d, p, i, t, x1, y1, x2, y2) for d, p, i, t, _, x1, y1, x2, y2 in rows if p == g["page"]]
        lines = plain_lines(words)
        assert [t for _, t, *_ in lines] == g["texts"]
        want = plain_percentage(lines)
        assert (want is None) == (g["c"] is None)
        if want:
            found += 1
            assert (g["c"]["score"], g["c"]["value"], g["c"]["strategy"]) == want
    assert found > 100


def test_scores_of_names(spark):
    texts = ["Rokade Amol Bhaskar", "WAGHRE SUNIL", "State Board", "A1B2C3", "a@b", "one two three four five six seven", "ab", "Father Name", "Amol", "Amol 12", "उमा", "O'Neil Jo", "one two three four five", None, " "]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(sh.name_score(F.col("t"), F.lit(1.0))).collect()]
    assert got[:9] == [19.5, 19.0, None, None, None, None, None, None, 5.0 - 5.0 + 4.0 + 3.0 + 6.0]
    assert got[9] == 5.0 + 4.0 + 1.5 + 6.0 - 8.0
    assert got[11] == 5.0 + 4.0 + 1.5 + 6.0 and got[12] == 3.0 + 3.0 + 1.5 + 6.0 - 1.0 and got[13:] == [None, None]


def test_label_scores_are_those_of_the_parsers(spark):
    from dossierlake.functions import parsers as ps

    texts = ["CANDIDATE'S FULL NAME", "Nane of Candidat", "surname first", "उमेदवाराचे नाव", "", "total marks", "x", "NAME"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("all", sh._label_scores(sh._letters(F.col("t"))))
    for r in df.select("t", F.col("all"), F.array(*[ps.label_score(F.col("t"), F.lit(x)) for x in sh.NAME_LABELS]).alias("want")).collect():
        assert [round(x["score"], 9) for x in r["all"]] == [round(x, 9) for x in r["want"]]


def test_pages_without_fields_and_odd_words(spark):
    rows = [(1, 1, 0, None, None, 0.0, 0.0, 10.0, 10.0), (2, 1, 0, "", 0.9, 0.0, 0.0, 0.0, 0.0), (3, 1, 0, "PASS", 0.9, 5.0, 5.0, 50.0, 25.0), (3, 1, 0, "PASS", 0.9, 5.0, 5.0, 50.0, 25.0), (4, None, 0, "PASS", 0.9, 5.0, 5.0, 50.0, 25.0)]
    df = spark.createDataFrame(rows, WORDS).withColumn("lines", F.lit("x")).withColumn("label", F.lit(1))
    got = sorted((r["doc"], r["field"], r["value"]) for r in sh.sheet_fields(df).collect())
    assert got == [(3, "result", "PASS"), (4, "result", "PASS")]
    assert sh.sheet_fields(df.limit(0)).collect() == []
