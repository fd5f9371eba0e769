"""Queries over marksheets: a sheet for each customer, laid out in one of five styles, read back and compared with what was put on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlake.functions import card_names as cn
from dossierlake.operators import sheets as sh
from dossierlake.plans._registry import query
from dossierlake.sources import logical as lt

SURNAMES = ("Waghre", "Testkar", "Ghorade", "Nimbal", "Rokade", "Salve", "Tambe")
GIVEN = ("Asha", "Kiran", "Meera", "Nitin", "Ravi", "Sunil", "Tara", "Uday", "Vimal")
MIDDLE = ("Anand", "Bhaskar", "Chandra", "Dinkar", "Ganesh", "Hari", "Jayant", "Keshav")
RESULTS = {"AUTOMOBILE": "PASS", "BUILDING": "DISTINCTION", "FURNITURE": "FIRST CLASS", "HOUSEHOLD": "SECOND CLASS", "MACHINERY": "FAIL"}


def _at(words: tuple[str, ...], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), i.cast("int") + 1)


def _hundredths(x: Column) -> Column:
    return F.concat(F.floor(x / 100).cast("string"), F.lit("."), F.lpad((x % 100).cast("string"), 2, "0"))


def sheet_truth(s: SparkSession, d: str) -> DataFrame:
    """What stands on the sheet of each customer."""
    c, k = lt.table(s, d, "customer"), F.col("c_custkey")
    cents = F.round(F.abs("c_acctbal") * 100).cast("long")
    marks = [(35 + (k * (11 + 2 * i) + cents) % 60).cast("int") for i in range(1, 7)]
    x = c.select(k.alias("doc"), (k % 5).cast("int").alias("style"), _at(SURNAMES, k % 7).alias("surname"), _at(GIVEN, F.floor(k / 7) % 9).alias("given"), _at(MIDDLE, F.floor(k / 63) % 8).alias("middle"), F.array(*marks).alias("marks"), F.col("c_mktsegment").alias("segment"), (1990 + k % 30).cast("string").alias("year"), (600 + k % 350).alias("average"))
    x = x.withColumn("obtained", F.aggregate("marks", F.lit(0), lambda a, m: a + m)).withColumn("percent", F.floor((F.col("obtained") * 100 + 3) / 6))
    return x.withColumn("result", F.element_at(F.create_map(*[F.lit(v) for pair in RESULTS.items() for v in pair]), F.col("segment")))


def sheet_words(s: SparkSession, d: str) -> DataFrame:
    """(doc, page, word_id, text, conf, x1, y1, x2, y2): positioned words of all sheets, each word up to two pixels off its row."""
    t = sheet_truth(s, d)
    word = lambda text, x, y: F.struct((F.lit(text) if isinstance(text, str) else text).alias("text"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    row = lambda text, x, y: [word(w, x + 90 * i, y) for i, w in enumerate(text.split(" "))]
    person = [F.col("surname"), F.col("given"), F.col("middle")]
    named = lambda x, y, f=lambda c: c: [word(f(c), x + 95 * i, y) for i, c in enumerate(person)]
    mark = lambda i: F.lpad(F.get("marks", F.lit(i)).cast("string"), 3, "0")
    obtained, percent = F.col("obtained").cast("string"), _hundredths(F.col("percent"))
    verdict = lambda x, y: [word(F.col("result"), x, y)]
    marks_rows = row("MAXIMUM MARKS", 10, 220) + [word("100", 200 + 70 * i, 220) for i in range(6)] + [word("600", 640, 220)] + row("MARKS OBTAINED", 10, 260) + [word(mark(i), 200 + 70 * i, 260) for i in range(6)] + [word(obtained, 640, 260)]
    seat = [*row("SEAT NO.", 10, 70), word(F.concat(F.lit("F0"), F.lpad((F.col("doc") % 100000).cast("string"), 5, "0")), 200, 70), word(F.concat(F.lit("MARCH-"), F.col("year")), 400, 70)]
    average = F.col("average")
    styles = [
        row("STATEMENT OF MARKS", 100, 20) + seat + row("CANDIDATE'S FULL NAME", 10, 130) + named(10, 160, F.upper) + marks_rows + row("PERCENTAGE", 10, 300) + [word(percent, 200, 300)] + row("RESULT", 10, 340) + verdict(200, 340),
        row("STATEMENT OF MARKS", 100, 20) + seat + row("Student Name", 10, 130) + named(300, 144) + marks_rows + row("PERCENTAGE", 10, 300) + [word(percent, 10, 330)] + row("RESULT", 10, 370) + verdict(200, 370),
        row("HIGHER SECONDARY EXAMINATION", 100, 20) + seat + row("CANDIDATE'S FULL NAME", 10, 130) + named(10, 160) + row("CANDIDATE'S MOTHER'S NAME", 10, 190) + row("Nita", 10, 220) + row("टकेवारी/ Percentage", 10, 300) + [word(percent, 250, 300), *row("एकूण गुण/Total Marks", 350, 300), word("600", 640, 300), word(obtained, 740, 300)] + row("Result/ निकाल", 10, 340) + verdict(250, 340) + [word(F.concat(F.lit("H"), F.lpad(F.col("doc").cast("string"), 9, "2")), 300, 480)],
        row("SECONDARY SCHOOL CERTIFICATE", 100, 20) + row("This is to certify that", 10, 60) + named(10, 90) + row("Mother Name", 10, 115) + row("Nita", 250, 115) + [word(F.concat(F.lit("MARCH-"), F.col("year")), 400, 150)] + row("एकूण", 10, 300) + [word("600", 200, 300), word(F.concat(F.lit("£"), (F.col("obtained") - 5).cast("string"), F.lit("+05")), 320, 300)] + row("PERCENTAGE £", 10, 340) + [word(percent, 260, 340)] + verdict(10, 380),
        row("UNIVERSITY GRADE CARD", 100, 20) + row("Name :", 10, 100) + named(200, 100) + row("Mother Name : Nita", 520, 100) + row("Examination: EVEN", 10, 140) + [word(F.concat(F.col("year"), F.lit("-"), F.lpad(((F.col("year").cast("int") + 1) % 100).cast("string"), 2, "0")), 300, 140)] + row("Semester III SPI:", 10, 180) + [word(_hundredths(average - 9), 320, 180)] + row("CGPA:", 10, 220) + [word(_hundredths(average - 20), 120, 220)] + row("Performance Summary", 10, 300) + [word("22", 10, 340), word(_hundredths(average + 5), 110, 340), word("96", 210, 340), word(_hundredths(average), 310, 340)],
    ]
    laid = F.element_at(F.array(*[F.array(*words) for words in styles]), F.col("style") + 1)
    x = t.select("doc", F.posexplode(laid).alias("word_id", "w")).select("doc", "word_id", "w.*")
    y = F.col("y") + (F.col("doc") + F.col("word_id")) % 3
    return x.select("doc", F.lit(1).cast("long").alias("page"), "word_id", "text", F.lit(0.9).alias("conf"), F.col("x").alias("x1"), y.alias("y1"), (F.col("x") + F.least(F.length("text") * 9, F.lit(85))).alias("x2"), (y + 20).alias("y2"))


def _sql_at(words: tuple[str, ...], i: str) -> str:
    return f"([{', '.join(repr(w) for w in words)}])[{i} + 1]"


_SHEETS = f"""WITH t AS (SELECT c_custkey AS doc, (c_custkey % 5)::INT AS style, {_sql_at(SURNAMES, 'c_custkey % 7')} || ' ' || {_sql_at(GIVEN, 'c_custkey // 7 % 9')} || ' ' || {_sql_at(MIDDLE, 'c_custkey // 63 % 8')} AS name,
    {' + '.join(f'(35 + (c_custkey * {11 + 2 * i} + round(abs(c_acctbal) * 100)::BIGINT) % 60)' for i in range(1, 7))} AS obtained,
    CASE c_mktsegment {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in RESULTS.items())} END AS result, 1990 + c_custkey % 30 AS year, 600 + c_custkey % 350 AS average FROM customer),
  p AS (SELECT *, (obtained * 100 + 3) // 6 AS pct, average / 100.0::DOUBLE AS cpi, (average + 5) / 100.0::DOUBLE AS term, (average - 9) / 100.0::DOUBLE AS third, (average - 20) / 100.0::DOUBLE AS cgpa FROM t),
  f AS (SELECT doc, 'name' AS field, CASE style WHEN 0 THEN upper(name) ELSE name END AS value, 0.97::DOUBLE AS confidence, 'name_extractor_v2' AS strategy FROM p
    UNION ALL SELECT doc, 'percentage', CASE style WHEN 3 THEN '£ ' ELSE '' END || (pct // 100) || '.' || lpad((pct % 100)::VARCHAR, 2, '0'), CASE style WHEN 0 THEN round(13 / 15.0::DOUBLE, 6) WHEN 1 THEN 1.0 ELSE round(10 / 15.0::DOUBLE, 6) END,
      CASE style WHEN 1 THEN 'nearest_below' WHEN 2 THEN 'regex_same_line' ELSE 'inline' END FROM p WHERE style < 4
    UNION ALL SELECT doc, 'obtained_marks', obtained::DOUBLE::VARCHAR, 0.85, 'regex_marks' FROM p WHERE style < 4
    UNION ALL SELECT doc, 'total_marks', '600.0', 0.85, 'regex_marks' FROM p WHERE style < 4
    UNION ALL SELECT doc, 'result', result, 0.9, 'regex_result' FROM p WHERE style < 4
    UNION ALL SELECT doc, 'passing_year', CASE style WHEN 4 THEN year || '-' || (year // 100) || lpad(((year + 1) % 100)::VARCHAR, 2, '0') ELSE year::VARCHAR END, 0.88, 'regex_year' FROM p
    UNION ALL SELECT doc, 'cgpa', cgpa::VARCHAR, 0.88, 'regex_cgpa' FROM p WHERE style = 4
    UNION ALL SELECT doc, 'cpi', cpi::VARCHAR, 0.92, 'academic_resolver' FROM p WHERE style = 4
    UNION ALL SELECT doc, 'spi', term::VARCHAR, 0.9, 'academic_resolver_latest_sem' FROM p WHERE style = 4
    UNION ALL SELECT doc, 'semester_scores', '[{{"semester":3,"spi":' || third || '}}]', 0.9, 'academic_resolver' FROM p WHERE style = 4
    UNION ALL SELECT doc, 'display_score', '{{"type":"CPI","value":' || cpi || '}}', 0.95, 'academic_priority_resolver' FROM p WHERE style = 4)"""
# A short second year takes the first one's century, so 1999-00 is read as 1999-1900.
query("r12_marksheet_fields", f"{_SHEETS} SELECT doc, field, value, confidence, strategy FROM f")(
    lambda s, d: sh.sheet_fields(sheet_words(s, d)).select("doc", "field", "value", F.round("confidence", 6).alias("confidence"), "strategy"))



def cards(s: SparkSession, d: str) -> DataFrame:
    """(id, number, tax, identity, sheet): texts of a tax card in six styles, an identity card in five and a sheet in four, for each customer."""
    t = sheet_truth(s, d)
    k = F.col("doc")
    number = F.concat(F.lit("ABCDE"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("F"))
    upper = F.upper(F.concat_ws(" ", "surname", "given", "middle"))
    titled = F.concat_ws(" ", "given", "middle", "surname")
    born = F.concat(F.lit("01/02/"), F.col("year"))
    lines = lambda *some: F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in some])
    tax = F.element_at(F.array(
        lines("INCOME TAX DEPARTMENT", "GOVT OF INDIA", number, "नाम / Name", upper, "पिता का नाम / Father's Name", "MADHAV RAO", born),
        lines("INCOME TAX DEPARTMENT", "Permanent Account Number", number, upper, "Father's Name", "MADHAV RAO", born),
        lines("INCOME TAX DEPARTMENT", "a 1234 b", titled, "x9", "S/O MADHAV RAO", "Asha Late Line", born),
        lines("INCOME TAX DEPARTMENT", number, "Name", "q 9981", upper, "A Further Name", "Father's Name", "MADHAV RAO"),
        lines("INCOME TAX DEPARTMENT", "Name", "/ Date of Birth", upper, number, "1 2", titled, "Signature"),
        lines("INCOME TAX DEPARTMENT", number, "12345", "Signature"),
    ), (k % 6).cast("int") + 1)
    identity = F.element_at(F.array(
        lines("Government of India", titled, F.concat(F.lit("DOB: "), born), "Male", "2345 6789 0123"),
        lines("Government of India", F.concat(titled, F.lit(" DOB: "), born, F.lit(" Male")), "2345 6789 0123"),
        lines(titled, F.concat(F.lit("Year of Birth "), F.col("year")), "2345 6789 0123"),
        lines("Unique Identification Authority", "12 Main Road, Pune", titled, F.concat(F.lit("DOB "), born)),
        lines("2345 6789 0123", "9988"),
    ), (k % 5).cast("int") + 1)
    sheet = F.element_at(F.array(
        lines("STATEMENT OF MARKS", "CANDIDATE'S FULL NAME", "", upper, "MOTHER'S NAME"),
        lines("higher secondary board", "seat no 12", titled, "total marks 600"),
        lines("Candidate", "12 34", "9", "8", F.concat(F.lit("roll 77 "), titled, F.lit(" pass"))),
        lines("12", "total marks", "x1"),
    ), (k % 4).cast("int") + 1)
    return t.select(k.alias("id"), F.when(k % 6 != 2, number).alias("number"), tax.alias("tax"), identity.alias("identity"), sheet.alias("sheet"))


_NAMES = f"""WITH n AS (SELECT c_custkey AS id, {_sql_at(SURNAMES, 'c_custkey % 7')} AS s, {_sql_at(GIVEN, 'c_custkey // 7 % 9')} AS g, {_sql_at(MIDDLE, 'c_custkey // 63 % 8')} AS m FROM customer),
  p AS (SELECT *, upper(s || ' ' || g || ' ' || m) AS u, g || ' ' || m || ' ' || s AS t, (length(s || g || m) / (length(s || g || m) + 2)::DOUBLE) * 40 AS a FROM n)"""
# A name of too many blanks for its letters is none.
query("x16_card_holders", f"""{_NAMES}, h AS (SELECT id, a / 40 < 0.88 AS short, CASE id % 6 WHEN 2 THEN t WHEN 4 THEN t WHEN 5 THEN NULL ELSE u END AS name, ([4, 3, 2, 4, 6, NULL])[id % 6 + 1]::INT AS line,
    (['name_label', 'below_number', 'any_line', 'name_label', 'below_number', NULL])[id % 6 + 1] AS method, round(a + ([100, 66, 45, 90, 57, NULL])[id % 6 + 1]::DOUBLE, 6) AS score FROM p)
  SELECT id, CASE WHEN NOT short THEN name END AS name, CASE WHEN NOT short THEN line END AS line, CASE WHEN NOT short THEN method END AS method, CASE WHEN NOT short THEN score END AS score FROM h""")(
    lambda s, d: cards(s, d).select("id", cn.card_holder(F.col("tax"), F.col("number")).alias("h")).select("id", "h.*"))
query("x16_identity_names", f"{_NAMES} SELECT id, CASE WHEN id % 5 < 4 THEN t END AS name, ([1, 1, 0, 2, NULL])[id % 5 + 1]::INT AS line, (['zone', 'fused_line', 'zone', 'zone', NULL])[id % 5 + 1] AS method FROM p")(
    lambda s, d: cards(s, d).select("id", cn.identity_name(F.col("identity")).alias("h")).select("id", "h.*"))
query("x14_candidate_names", f"{_NAMES} SELECT id, CASE id % 4 WHEN 0 THEN s || ' ' || g || ' ' || m WHEN 1 THEN t WHEN 2 THEN g || ' ' || m ELSE 'Total Marks' END AS name, CASE id % 4 WHEN 0 THEN 'label' ELSE 'ranked' END AS method, ([NULL, 90.0, 90.0, 30.0])[id % 4 + 1]::DOUBLE AS score FROM p")(
    lambda s, d: cards(s, d).select("id", cn.candidate_name(F.col("sheet")).alias("h")).select("id", "h.*"))
