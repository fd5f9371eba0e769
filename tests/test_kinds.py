"""Kinds of papers and files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from dossierlake.functions import kinds as kd

PAPERS = [
    ("STATEMENT OF MARKS higher secondary certificate total marks", None, ("hsc_marksheet", None, 1.0, 1.0)),
    ("H1GHER SEC0NDARY CERT1FICATE this is to certify that", None, ("hsc_certificate", None, 1.0, 1.0)),
    ("Secondary School Certificate first class", None, ("ssc_certificate", None, 1.0, 1.0)),
    ("University of Mumbai diploma, first class with distinction", None, ("degree_certificate", "University of Mumbai", 1.0, 1.0)),
    ("Shivaji University marks and more", None, ("hsc_marksheet", "Shivaji University, Kolhapur", 0.35, 0.5)),
    ("Shivaji University and more", None, ("hsc_certificate", "Shivaji University, Kolhapur", 0.35, 0.5)),
    ("nothing of note stands here", None, ("hsc_marksheet", None, 0.25, 0.5)),
    ("nothing of note stands here", "ug", ("degree_certificate", None, 1.0, 0.5)),
    ("ssc marks", None, ("hsc_marksheet", None, 0.25, 0.5)),
    ("ssc and hsc and class xii marksheet", "ssc", ("ssc_marksheet", None, 0.913, 1.0)),
    ("", None, ("hsc_marksheet", None, 0.25, 0.5)),
    (None, "ug", ("hsc_marksheet", None, 0.25, 0.5)),
]
FILES = [("Aadhaar.PDF", "%PDF-1", ("kyc", "aadhaar", True, 45, False)), ("x.pdf", "%PDF", ("academic", "unknown", True, 90, False)), ("x.pdf", "", ("unknown", "unknown", False, 120, False)), ("bank.pdf.txt", None, ("bank", "bank_statement", False, 300, True)), ("x.bank", None, ("unknown", "unknown", False, 120, False)), (".bank", None, ("bank", "bank_statement", False, 300, True)), (None, None, ("unknown", "unknown", False, 120, False))]


def test_papers(spark):
    got = spark.createDataFrame([(i, t, h) for i, (t, h, _) in enumerate(PAPERS)], "i int, t string, h string").orderBy("i").select(kd.paper_kind(F.col("t"), F.col("h")).alias("k")).collect()
    assert [(r["k"]["category"], r["k"]["board"], r["k"]["level_confidence"], r["k"]["subtype_confidence"]) for r in got] == [w for *_, w in PAPERS]


@pytest.mark.parametrize("hinted", [True, False])
def test_levels_are_those_of_the_most_signs(spark, hinted):
    import re

    texts = [" ".join(p) for p in (("ssc", "hsc", "master"), ("class 10", "std xii", "std 12"), ("bachelor", "prn", "hsc"), ("matric", "grade 10", "phd"))]
    for t in texts:
        counts = {k: sum(bool(re.search(p, t)) for p in v) for k, v in kd.LEVELS.items()}
        r = spark.createDataFrame([(t,)], "t string").select(kd.paper_kind(F.col("t"), F.lit("none") if hinted else None).alias("k")).first()[0]
        best = "degree" if counts["degree"] > max(counts["ssc"], counts["hsc"]) else "hsc" if counts["hsc"] > counts["ssc"] else "ssc"
        assert (r["level"], r["level_confidence"]) == (best, round(counts[best] / sum(counts.values()), 3))


def test_files(spark):
    got = spark.createDataFrame([(i, n, None if h is None else h.encode()) for i, (n, h, _) in enumerate(FILES)], "i int, n string, h binary").orderBy("i").select(kd.routed(F.col("n"), F.col("h")).alias("r")).collect()
    assert [tuple(r["r"]) for r in got] == [w for *_, w in FILES]
