"""Plausibility, repair and recovery of single extracted values, as column expressions over strings.

``value`` is what was read, null where nothing was; ``confidence`` is between 0 and 1.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossierlake.functions.text import title_case

#: Shapes of barcodes, serial and certificate numbers.
SERIALS = (r"(?i)^[A-Z]{1,3}[0-9]{6,}$", r"^[0-9]{10,}$", r"(?i)^[A-Z]-[0-9]{5,}$", r"(?i)^[A-Z]{2}[0-9]{4,}[A-Z]?[0-9]+$")
#: Words of organisations, which no name has.
ORGANISATIONS = ("board", "university", "exam", "marksheet", "institute", "divisional", "secondary", "maharashtra", "msbshse", "school")
#: Results that a marksheet states.
RESULTS = ("PASS", "FAIL", "DISTINCTION", "FIRST CLASS", "SECOND CLASS")
#: Characters that are read for digits, in marks and in recovery.
MARK_DIGITS = ("SsOolI|?ZzBG", "550011172286")
RECOVERED_DIGITS = ("OoQlISsBGgZzTq", "00011558692279")
SIGNS = "[£$€₹]"
#: Weights of the fields in the overall confidence.
FIELD_WEIGHTS = {"candidate_name": 0.30, "board_university": 0.15, "passing_year": 0.15, "percentage": 0.20, "cgpa": 0.20, "grade_class": 0.10, "result": 0.10}
NUMBERS = ("percentage", "cgpa", "spi", "total_marks", "obtained_marks")


def _any(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """What a pattern's group finds first, null if it doesn't occur."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def number_in(text: Column) -> Column:
    """The first number of a text."""
    return _found(text, r"([0-9]+(?:\.[0-9]+)?)").cast("double")


def is_serial(text: Column) -> Column:
    return _any(*[text.rlike(p) for p in SERIALS])


def hallucinated(field: Column, value: Column, confidence: Column) -> Column:
    """Whether a value can't be what the field holds: next to no confidence, no letter or digit, a serial number for a
    percentage or name, a percentage above 100, marks above 5000, a name without vowels or of digits alone."""
    v = F.trim(value)
    whole = F.replace(v, F.lit(" "), F.lit(""))
    digits = F.regexp_replace(v, "[^0-9]", "")
    percentage = is_serial(v) | v.rlike("^[0-9]{4,}") | F.coalesce(F.regexp_replace(v, r"[^0-9.]", "").try_cast("double") > 100, F.lit(False))
    name = ((F.char_length(v) > 6) & ~v.rlike("[AEIOUaeiou]")) | whole.rlike("^[0-9]+$") | is_serial(whole)
    own = F.when(field == "percentage", percentage).when(field == "total_marks", (digits != "") & (digits.try_cast("double") > 5000)).when(field == "name", name).otherwise(False)
    return value.isNotNull() & ((confidence < 0.15) | ((F.char_length(v) > 3) & ~v.rlike(r"[\p{L}\p{N}]")) | F.coalesce(own, F.lit(False)))


def repaired_number(field: Column, value: Column) -> Column:
    """Numbers as they were before they were misread: letters for digits, a blank or nothing for the point, added grace marks."""
    t = F.translate(F.trim(value), *MARK_DIGITS)
    bare = F.trim(F.regexp_replace(t, "[£$€₹%]", ""))
    two = r"^([0-9]+)\s+([0-9]+)(?:\s|$)"
    joined = F.concat(F.regexp_extract(bare, two, 1), F.lit("."), F.regexp_extract(bare, two, 2))
    first = F.when(bare.rlike(two), F.when(joined.try_cast("double") <= 100, joined).otherwise(bare)).when(bare.rlike(r"^[0-9]+\s"), F.regexp_extract(bare, "^([0-9]+)", 1)).otherwise(bare)
    four = F.regexp_replace(first, "^([0-9]{2})([0-9]{2})$", "$1.$2")
    ratio = F.when(field.isin("cgpa", "spi"), F.regexp_replace(four, "^([0-9])([0-9]{2})$", "$1.$2")).otherwise(four)
    plain = F.trim(F.regexp_replace(t, rf"^{SIGNS}\s*", ""))
    grace = r"^([0-9]{2,4})\s*\+\s*([0-9]{1,3})$"
    summed = F.when(plain.rlike(grace), (F.regexp_extract(plain, grace, 1).cast("int") + F.regexp_extract(plain, grace, 2).cast("int")).cast("string")).otherwise(plain)
    marks = F.when(summed.rlike("^[0-9]{2,4}"), F.regexp_extract(summed, "^([0-9]{2,4})", 1)).otherwise(summed)
    return F.when(field.isin("percentage", "cgpa", "spi"), ratio).when(field.isin("total_marks", "obtained_marks"), marks).otherwise(value)


def valid_name(value: Column, confidence: Column) -> Column:
    """A missing name is taken as the word for it, and passes, as it always has."""
    v = F.trim(F.coalesce(value, F.lit("None")))
    return (confidence >= 0.25) & (v != "") & ~F.lower(v).rlike("|".join(ORGANISATIONS)) & (F.regexp_count(v, F.lit("[0-9]")) <= 2) & (F.char_length(F.replace(v, F.lit(" "), F.lit(""))) >= 3)


def valid_percentage(value: Column) -> Column:
    v = F.trim(F.replace(F.trim(value), F.lit("%"), F.lit("")))
    first = r"\b([0-9]{1,3})(?:[.\s]([0-9]{1,2}))?\b"
    whole, rest = F.regexp_extract(v, first, 1), F.regexp_extract(v, first, 2)
    number = F.concat(whole, F.lit("."), F.when(rest == "", "0").otherwise(rest)).try_cast("double")
    return F.coalesce(~v.rlike("(?i)[A-Z][0-9]{6,}") & ~v.rlike("[0-9]{8,}") & v.rlike(first) & (number <= 100), F.lit(False))


def valid_value(field: Column, value: Column, confidence: Column) -> Column:
    """Whether a value may stand in its field; fields without a rule take any."""
    grade = _found(value, r"([0-9]{1,2}(?:\.[0-9]{1,2})?)").cast("double")
    year = _found(value, "([0-9]{4})").cast("int")
    marks = F.trim(F.regexp_replace(F.trim(value), "[£$+][0-9]+", "")).rlike("[0-9]{2,4}")
    rules = (
        F.when(field == "name", valid_name(value, confidence))
        .when(field == "percentage", valid_percentage(value))
        .when(field.isin("cgpa", "spi"), grade <= 10)
        .when(field == "year", year.between(1980, 2035))
        .when(field == "result", F.upper(value).rlike("|".join(RESULTS)))
        .when(field.isin("obtained_marks", "total_marks"), marks)
        .otherwise(True)
    )
    return F.coalesce(rules, F.lit(False))


def mark_warnings(doc_type: Column, obtained: Column, total: Column, percentage: Column, year: Column, cgpa: Column, this_year: int) -> Column:
    """Codes of what is wrong with a document's numbers, in a fixed order."""
    rules = (
        (obtained.isNotNull() & (obtained > total), "obtained_exceeds_total"),
        (obtained.isNotNull() & (total <= 0), "total_invalid"),
        (total.isNotNull() & (obtained < 0), "obtained_negative"),
        ((percentage < 0) | (percentage > 100), "percentage_out_of_range"),
        ((year < 1950) | (year > this_year + 1), "year_unrealistic"),
        ((doc_type == "degree") & ((cgpa < 0) | (cgpa > 10)), "cgpa_out_of_range"),
    )
    return F.array_compact(F.array(*[F.when(c, code) for c, code in rules]))


def consistency_warnings(percentage: Column, grade: Column, obtained: Column, total: Column) -> Column:
    """Codes of what disagrees between the numbers of a document's values: two scales, marks, or the percentage by more than one."""
    pct, spi, got, of = (number_in(x) for x in (percentage, grade, obtained, total))
    rules = (
        ((pct <= 10) & (spi <= 10), "percentage_and_grade_on_one_scale"),
        (got > of, "obtained_exceeds_total"),
        ((of > 0) & (F.abs(got / F.nullif(of, F.lit(0.0)) * 100 - pct) > 1), "percentage_disagrees_with_marks"),
    )
    return F.array_compact(F.array(*[F.when(c, code) for c, code in rules]))


def marks_percentage(obtained: Column, total: Column) -> Column:
    """What the marks make in percent; null where they can't be right."""
    got, of = obtained.try_cast("double"), total.try_cast("double")
    return F.when((of > 0) & (got <= of), F.round(got / of * 100, 2))


def recovered_percentage(raw: Column) -> Column:
    """A percentage out of a damaged reading: comma or blank for the point, letters for digits, a point lost before the last digits."""
    t = F.regexp_replace(F.regexp_replace(F.btrim(F.btrim(F.trim(raw), F.lit("%"))), r"^\(+", ""), r"\)+$", "")
    t = F.regexp_replace(F.replace(F.trim(t), F.lit(","), F.lit(".")), r"([0-9])\s+([0-9])", "$1.$2")
    t = F.regexp_replace(F.regexp_replace(F.translate(t, *RECOVERED_DIGITS), "[^0-9.]", ""), r"\.{2,}", ".")
    for shape in ("^([0-9]{2})([0-9]{1,2})$", "^([0-9]{3})([0-9]{2})$"):
        t = F.regexp_replace(t, shape, "$1.$2")
    v = t.try_cast("double")
    return F.when((v > 0) & (v <= 100), F.round(v, 2))


def recovered_grade(raw: Column) -> Column:
    """A grade point average up to 10 out of a damaged reading."""
    t = F.regexp_replace(F.regexp_replace(F.btrim(F.btrim(F.trim(raw), F.lit("%"))), r"^\(+", ""), r"\)+$", "")
    t = F.translate(F.replace(F.trim(t), F.lit(","), F.lit(".")), *RECOVERED_DIGITS)
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "[^0-9.]", ""), r"\.{2,}", "."), "^([0-9])([0-9]{2})$", "$1.$2")
    v = t.try_cast("double")
    return F.when((v > 0) & (v <= 10), F.round(v, 2))


def kept_scores(cgpa: Column, percentage: Column, grade: Column, result: Column, obtained: Column, total: Column) -> dict[str, Column]:
    """The highest kind of score alone: the average, else the percentage, else grade and result, else marks."""
    named = grade.isNotNull() | result.isNotNull()
    marks = cgpa.isNull() & percentage.isNull() & ~named
    label = F.when(cgpa.isNotNull(), "CGPA").when(percentage.isNotNull(), "PERCENTAGE").when(grade.isNotNull(), "GRADE").when(result.isNotNull(), "RESULT").when(obtained.isNotNull(), "MARKS")
    return {"cgpa": cgpa, "percentage": F.when(cgpa.isNull(), percentage), "grade": grade, "result": result, "obtained_marks": F.when(marks, obtained), "total_marks": F.when(marks, total), "primary_score": label}


def field_score(field: str, value: Column) -> Column:
    """How sure a value of a field is by its form alone, 0 to 1."""
    v = value.try_cast("double")
    if field == "candidate_name":
        words = F.size(F.filter(F.split(value, r"\s+"), lambda x: x != ""))
        score = F.lit(0.5) + F.when(words >= 3, 0.2).when(words == 2, 0.1).otherwise(0.0) + F.when(value == title_case(value), 0.15).otherwise(0.0) + F.when(F.char_length(value).between(10, 50), 0.15).otherwise(0.0)
        score = F.least(score, F.lit(1.0))
    elif field == "percentage":
        score = F.when(v.between(35, 100), 0.95).when(v.between(10, 35), 0.75).when(v.isNotNull(), 0.5).otherwise(0.0)
    elif field == "cgpa":
        score = F.when(v.between(5, 10), 0.95).when((v >= 0) & (v < 5), 0.75).when(v.isNotNull(), 0.5).otherwise(0.0)
    elif field == "passing_year":
        y = value.try_cast("int")
        score = F.when(y.between(2000, 2030), 1.0).when((y >= 1980) & (y < 2000), 0.85).when(y.isNotNull(), 0.6).otherwise(0.0)
    else:
        score = F.when(F.char_length(F.trim(value)) > 2, 0.85).otherwise(0.5)
    return F.round(F.when(value == "", 0.0).otherwise(score), 3)


def overall_confidence(values: dict[str, Column], ocr_confidence: Column) -> dict[str, Column]:
    """Weighted mean of the fields that are there (.7) and the reading's confidence (.3), with grade and coverage."""
    there = {f: values[f].isNotNull() for f in FIELD_WEIGHTS}
    total = sum((F.when(there[f], w).otherwise(0.0) for f, w in FIELD_WEIGHTS.items()), F.lit(0.0))
    scored = sum((F.when(there[f], field_score(f, values[f]) * w).otherwise(0.0) for f, w in FIELD_WEIGHTS.items()), F.lit(0.0))
    fields = F.when(total > 0, scored / total).otherwise(0.0)
    overall = F.round(fields * 0.70 + F.least(ocr_confidence, F.lit(1.0)) * 0.30 + 1e-9, 3)  # a half is a half in any arithmetic
    found = sum((c.cast("int") for c in there.values()), F.lit(0))
    grade = F.when(overall >= 0.70, "high").when(overall >= 0.45, "medium").when(overall >= 0.20, "low").otherwise("insufficient")
    return {"overall": overall, "grade": grade, "fields_found": found, "coverage": F.round(found / len(FIELD_WEIGHTS), 2)}
