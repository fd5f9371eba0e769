"""A keyword query over users, compiled on the driver into one Column.

The first rule whose words occur decides; thresholds belong to the words, only ages are read as numbers. A query
that no rule knows is looked for in the name.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_Rule = tuple[tuple[str, ...], Callable[[], Column]]


def age(dob: Column, as_of: str) -> Column:
    """Whole years at the instant, from DD/MM/YYYY; null for anything else."""
    m = [F.try_to_number(F.regexp_extract(dob, r"^(\d{2})/(\d{2})/(\d{4})$", k), F.lit("9999")).cast("int") for k in (1, 2, 3)]
    day, month, year = m
    at = F.lit(as_of).cast("timestamp_ntz")
    before = (F.month(at) < month) | ((F.month(at) == month) & (F.dayofmonth(at) < day))
    return F.year(at) - year - before.cast("int")


def score_parts(value: Column) -> tuple[Column, Column]:
    """A mark above 10 is a percentage, up to 10 a grade point average."""
    v = value.try_cast("double")
    return F.when(v > 10, v), F.when(v <= 10, v)


def _branches() -> list[_Rule]:
    """The branches in their order; ages stand fourth and are read by ``ladder``."""
    pct, cgpa = F.col("best_pct"), F.col("best_cgpa")
    types = F.coalesce("doc_types", F.array().cast("array<string>"))
    some = F.size(F.array_except(types, F.array(F.lit("aadhaar"), F.lit("pan")))) > 0
    tenth, twelfth, degree = F.array_contains(types, "tenth"), F.array_contains(types, "twelfth"), F.arrays_overlap(types, F.array(F.lit("degree"), F.lit("diploma")))
    names = [F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in ("aadhaar_name", "pan_name")]
    return [
        (("missing aadhaar", "missing adhar", "no aadhaar", "no adhar"), lambda: ~F.array_contains(types, "aadhaar")),
        (("missing pan", "no pan"), lambda: ~F.array_contains(types, "pan")),
        (("mismatch",), lambda: (names[0] != "") & (names[1] != "") & (names[0] != names[1])),
        (("distinction", "above 75", "> 75", "75%"), lambda: pct >= 75),
        (("above 80", "> 80", "80%"), lambda: pct >= 80),
        (("first class", "first division"), lambda: (pct >= 60) & (pct < 75)),
        (("below 60", "< 60", "low marks", "low score"), lambda: pct < 60),
        (("failed", "fail", "below 40", "< 40"), lambda: pct < 40),
        (("toppers", "top scorer", "top students", "highest marks", "best score"), lambda: (F.coalesce(pct, F.lit(0.0)) != 0) | (F.coalesce(cgpa, F.lit(0.0)) != 0)),
        (("cgpa > 8", "cgpa>8", "cgpa above 8"), lambda: cgpa >= 8),
        (("cgpa > 7", "cgpa>7", "cgpa above 7"), lambda: cgpa >= 7),
        (("low cgpa", "cgpa < 6", "weak cgpa"), lambda: cgpa < 6),
        (("highest cgpa", "best cgpa", "top cgpa"), lambda: cgpa != 0),
        (("missing academic", "no marksheet", "no academic"), lambda: ~some),
        (("has academic", "with academic", "academic docs"), lambda: some),
        (("all academic", "complete academic", "full academic"), lambda: tenth & twelfth & degree),
        (("only 10th", "only tenth", "ssc only"), lambda: tenth & ~twelfth & ~degree),
        (("only 12th", "only twelfth", "hsc only"), lambda: twelfth & ~tenth & ~degree),
        (("degree", "graduate", "graduation", "bachelor"), lambda: degree),
        (("10th", "tenth", "ssc"), lambda: tenth),
        (("12th", "twelfth", "hsc"), lambda: twelfth),
    ]


#: Words whose users come ordered by their marks.
RANKED = ("toppers", "top scorer", "highest marks", "highest cgpa", "best cgpa", "top students", "best score")


def ladder(profiles: DataFrame, text: str, as_of: str) -> DataFrame:
    """Users that a query asks for; anything that no branch knows is looked for in names and ids.

    ``profiles`` has id, full_name, dob, aadhaar_name, pan_name, doc_types (with tenth, twelfth, degree or diploma),
    best_pct and best_cgpa.
    """
    q = text.lower().strip()
    condition = F.contains(F.lower(F.coalesce("full_name", F.lit(""))), F.lit(q)) | F.contains(F.col("id").cast("string"), F.lit(q))
    m = re.search(r"age\s*([<>])\s*(\d+)", q)
    if over := re.search(r"age\s*>\s*(\d+)", q):
        m = over
    for k, (words, branch) in enumerate(_branches()):
        if k == 3 and m:
            years = age(F.col("dob"), as_of)
            condition = years > int(m[m.lastindex]) if ">" in m[0] else years < int(m[m.lastindex])
            break
        if any(x in q for x in words):
            condition = branch()
            break
    found = profiles.where(F.coalesce(condition, F.lit(False)))
    if any(x in q for x in RANKED):
        return found.orderBy(F.desc(F.coalesce("best_pct", F.lit(0.0)) + 10 * F.coalesce("best_cgpa", F.lit(0.0))), "id")
    return found


def academic_best(marks: DataFrame) -> DataFrame:
    """Per user the best percentage, the best grade point average and the distinct types in order."""
    pct, cgpa = score_parts(F.col("mark"))
    return marks.groupBy("user_id").agg(F.max(pct).alias("best_pct"), F.max(cgpa).alias("best_cgpa"), F.sort_array(F.collect_set("doc_type")).alias("doc_types"))
