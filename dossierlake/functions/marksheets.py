"""Fields of school certificates and of degree documents, read from their text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossierlake.functions import scores as sc
from dossierlake.functions.text import title_case

# The labels after which a field stands, in the order in which they are tried; letter case doesn't matter.
SCHOOL = {
    "candidate_name": (
        r"candidate(?:'s)?\s+name\s*[:\-]\s*([A-Z][A-Z\s.]{2,40})",
        r"student(?:'s)?\s+name\s*[:\-]\s*([A-Z][A-Z\s.]{2,40})",
        r"name\s+of\s+(?:the\s+)?candidate\s*[:\-]\s*([A-Z][A-Z\s.]{2,40})",
        r"name\s*[:\-]\s*([A-Z][A-Z\s.]{4,40})",
    ),
    "mother_name": (
        r"mother(?:'s)?\s+name\s*[:\-]\s*([A-Z][A-Z\s.]{2,40})",
        r"name\s+of\s+mother\s*[:\-]\s*([A-Z][A-Z\s.]{2,40})",
    ),
    "seat_number": (
        r"seat\s+no\.?\s*[:\-]\s*([A-Z0-9]{4,12})",
        r"exam\s+seat\s+no\.?\s*[:\-]\s*([A-Z0-9]{4,12})",
        r"roll\s+no\.?\s*[:\-]\s*([A-Z0-9]{4,12})",
    ),
    "certificate_no": (
        r"certificate\s+no\.?\s*[:\-]\s*([A-Z0-9\-]{4,20})",
        r"cert\.\s*no\.?\s*[:\-]\s*([A-Z0-9\-]{4,20})",
    ),
    "board": (
        r"(maharashtra\s+state\s+board[^\n]{0,40})",
        r"(cbse[^\n]{0,20})",
        r"(central\s+board[^\n]{0,30})",
        r"(icse[^\n]{0,20})",
        r"(council\s+for\s+the\s+indian\s+school[^\n]{0,30})",
        r"(board\s+of\s+secondary\s+education[^\n]{0,30})",
        r"(\w+\s+state\s+board[^\n]{0,30})",
    ),
    "school_number": (
        r"school\s+(?:index\s+)?no\.?\s*[:\-]\s*([A-Z0-9]{4,12})",
        r"school\s+code\s*[:\-]\s*([A-Z0-9]{4,12})",
    ),
    "passing_year": (
        r"(?:march|october|november)\s*[,\-]\s*(20[0-2]\d|19[89]\d)",
        r"year\s*[:\-]\s*(20[0-2]\d|19[89]\d)",
        r"(?:passing|passed)\s+in\s+(20[0-2]\d|19[89]\d)",
        r"examination\s+(20[0-2]\d|19[89]\d)",
        r"\b((?:19[89]|20[0-2])\d)\b",
    ),
    "total_marks": (
        r"total\s+marks?\s*[:\-]\s*(\d{2,4})",
        r"maximum\s+marks?\s*[:\-]\s*(\d{2,4})",
        r"out\s+of\s*[:\-]?\s*(\d{2,4})",
    ),
    "obtained_marks": (
        r"(?:marks?|marks?\s+obtained|total\s+obtained)\s*[:\-]\s*(\d{2,4})",
        r"obtained\s*[:\-]\s*(\d{2,4})",
        r"grand\s+total\s*[:\-]\s*(\d{2,4})",
    ),
    "division": (r"\b((?:first|second|third|distinction)\s+division)\b",),
    "dob": (
        r"(?:date\s+of\s+birth|dob)\s*[:\-]\s*(\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4})",
        r"(?:born\s+on)\s*[:\-]\s*(\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4})",
        r"\b(\d{2}[/\-.]\d{2}[/\-.]\d{4})\b",
    ),
}
DEGREE = {
    "student_name": (
        r"student(?:'s)?\s+name\s*[:\-]\s*([A-Z][A-Z\s.]{3,40})",
        r"name\s+of\s+(?:the\s+)?student\s*[:\-]\s*([A-Z][A-Z\s.]{3,40})",
        r"candidate(?:'s)?\s+name\s*[:\-]\s*([A-Z][A-Z\s.]{3,40})",
        r"name\s*[:\-]\s*([A-Z][A-Z\s.]{4,40})",
    ),
    "prn": (
        r"\bprn\b\s*[:\-.#]?\s*([0-9A-Z]{6,20})",
        r"permanent\s+reg(?:istration)?\s+no\.?\s*[:\-]\s*([0-9A-Z]{6,20})",
        r"enroll(?:ment)?\s+no\.?\s*[:\-]\s*([0-9A-Z]{6,20})",
        r"reg(?:istration)?\s+no\.?\s*[:\-]\s*([0-9A-Z]{6,20})",
    ),
    "seat_number": (
        r"seat\s+no\.?\s*[:\-]\s*([A-Z0-9]{4,14})",
        r"roll\s+no\.?\s*[:\-]\s*([A-Z0-9]{4,14})",
        r"exam\s+seat\s+no\.?\s*[:\-]\s*([A-Z0-9]{4,14})",
    ),
    "university": (
        r"((?:\w+\s+){1,5}university[^\n]{0,30})",
        r"university\s+of\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3})",
    ),
    "degree_name": (r"\b(b\.?tech|b\.?e\.?|b\.?sc\.?|b\.?com\.?|b\.?ca|b\.?a\.?|m\.?tech|m\.?sc\.?|m\.?com\.?|mba|mca|ph\.?d|b\.?arch)\b",),
    "course_name": (
        r"course\s+name\s*[:\-]\s*([A-Za-z &()]{5,50})",
        r"programme\s*[:\-]\s*([A-Za-z &()]{5,50})",
        r"department\s+of\s+([A-Za-z &]{5,40})",
    ),
    "passing_year": SCHOOL["passing_year"],
}
#: Phrases that name a grade, class, result or stream, the first that occurs.
GRADES = ((r"\bdistinction\b", "DISTINCTION"), (r"\bfirst\s+class\b", "FIRST CLASS"), (r"\bsecond\s+class\b", "SECOND CLASS"), (r"\bpass\s+class\b", "PASS CLASS"))
GRADE_LETTER = r"(?i)\bgrade\s+[:\-]\s*([OABCDF][+]?)"
RESULTS = ((r"\bpassed\b|\bpass\b", "PASSED"), (r"\bfailed\b|\bfail\b|\bwithheld\b", "FAILED"))
STREAMS = ((r"\bscience\b", "Science"), (r"\bcommerce\b", "Commerce"), (r"\barts?\b|\bhumanities\b", "Arts"), (r"\bvocational\b", "Vocational"))
STREAM = r"(?i)stream\s*[:\-]\s*([A-Za-z ]{3,20})"
CLASSES = ((r"first\s+class\s+with\s+distinction", "First Class with Distinction"), (r"first\s+class", "First Class"), (r"second\s+class", "Second Class"), (r"distinction", "Distinction"), (r"pass\s+class", "Pass Class"), (r"outstanding", "Outstanding"), (r"excellent", "Excellent"))
DEGREE_GRADES = ((r"\boutstanding\b", "Outstanding"), (r"\bexcellent\b", "Excellent"), (r"\bvery\s+good\b", "Very Good"), (r"\bgood\b", "Good"), (r"\baverage\b", "Average"), (r"\bgrade\s+o\b", "O (Outstanding)"), (r"\bgrade\s+a\b", "A"), (r"\bgrade\s+b\b", "B"))
SEMESTER = r"(?i)sem(?:ester)?\s*[:\-.\s]*([1-8iivx]+)\s*[:\-]?\s*(?:sgpa|gpa)?\s*[:\-]?\s*([0-9]+\.[0-9]{1,2})"
ROMAN = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii")


def anchored(text: Column, patterns: tuple[str, ...]) -> Column:
    """What the first pattern with a match that isn't blank finds."""
    return F.coalesce(*[F.nullif(F.regexp_replace(F.regexp_extract(text, f"(?i){p}", 1), r"^\s+|\s+$", ""), F.lit("")) for p in patterns])


def named(text: Column, phrases: tuple[tuple[str, str], ...]) -> Column:
    return F.coalesce(*[F.when(text.rlike(f"(?i){p}"), name) for p, name in phrases])


def _titled(name: Column) -> Column:
    return title_case(F.regexp_replace(name, r"\s+", " "))


def school_fields(text: Column) -> dict[str, Column]:
    """The fields of a certificate of school: found by their labels, the percentage from its statement or the marks."""
    out = {f: anchored(text, p) for f, p in SCHOOL.items()}
    out |= {f: _titled(out[f]) for f in ("candidate_name", "mother_name")} | {f: title_case(out[f]) for f in ("board", "division")}
    out |= {f: out[f].cast("double") for f in ("total_marks", "obtained_marks")} | {"passing_year": out["passing_year"].cast("int")}
    out["percentage"] = sc.resolved_percentage(sc.stated_percentage(text), out["obtained_marks"], out["total_marks"], text)
    out["grade"] = F.coalesce(named(text, GRADES), F.when(text.rlike(GRADE_LETTER), F.upper(F.regexp_extract(text, GRADE_LETTER, 1))))
    out["result"] = named(text, RESULTS)
    out["stream"] = F.coalesce(named(text, STREAMS), title_case(anchored(text, (STREAM.removeprefix("(?i)"),))))
    return out


def semesters(text: Column) -> Column:
    """Structs of semester and sgpa up to 10, the first of each semester, in order; numerals that aren't known are semester 0."""
    places = F.create_map(*[F.lit(x) for i, r in enumerate(ROMAN) for x in (r, i + 1)])

    def entry(m: Column) -> Column:
        number = F.lower(F.regexp_extract(m, SEMESTER, 1))
        return F.struct(F.coalesce(number.try_cast("int"), F.element_at(places, number), F.lit(0)).alias("semester"), F.regexp_extract(m, SEMESTER, 2).cast("double").alias("sgpa"))

    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(SEMESTER), 0), entry), lambda x: x["sgpa"] <= 10)
    add = lambda seen, x: F.when(F.exists(seen, lambda y: y["semester"] == x["semester"]), seen).otherwise(F.concat(seen, F.array(x)))
    return F.array_sort(F.aggregate(found, F.array().cast("array<struct<semester:int,sgpa:double>>"), add))


def degree_fields(text: Column) -> dict[str, Column]:
    """The fields of a degree document; the average is stated or that of its semesters, the percentage is stated or follows from it."""
    out = {f: anchored(text, p) for f, p in DEGREE.items()}
    out["student_name"] = _titled(out["student_name"])
    out |= {f: title_case(out[f]) for f in ("university", "course_name")} | {"passing_year": out["passing_year"].cast("int"), "degree_name": F.replace(F.upper(out["degree_name"]), F.lit("."), F.lit(""))}
    terms = semesters(text)
    counted = F.filter(terms, lambda x: x["sgpa"] != 0)
    mean = F.when(F.size(counted) > 0, F.round(F.aggregate(counted, F.lit(0.0), lambda a, x: a + x["sgpa"]) / F.greatest(F.size(counted), F.lit(1)), 2))
    out["cgpa"] = F.coalesce(F.nullif(sc.stated_average(text), F.lit(0.0)), mean)
    out["aggregate_percentage"] = F.coalesce(F.nullif(sc.stated_percentage(text), F.lit(0.0)), sc.cgpa_percentage(out["cgpa"]))
    out["result_class"], out["grade"] = named(text, CLASSES), named(text, DEGREE_GRADES)
    out["semesters"] = F.array_join(F.transform(terms, lambda x: F.concat_ws(":", x["semester"].cast("string"), x["sgpa"].cast("string"))), ",")
    return out
