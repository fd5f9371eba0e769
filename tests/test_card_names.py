"""Names of cards by where they stand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from dossierlake.functions import card_names as cn

CARDS = [
    ("नाम / Name\nASHOKAN KUMARAN RAMARAO\nपिता का नाम / Father's Name\nMADHAVAN KUMARAN RAMARAO\nABCDE1234F", "ABCDE1234F", ("ASHOKAN KUMARAN RAMARAO", 1, "name_label")),
    ("INCOME TAX DEPARTMENT\nABCDE 1234F\nASHOKAN KUMARAN RAMARAO\nFather's Name\nMADHAVAN KUMARAN RAMARAO", "ABCDE1234F", ("ASHOKAN KUMARAN RAMARAO", 2, "below_number")),
    ("INCOME TAX DEPARTMENT\nABCDE 1Z34F\nASHOKAN KUMARAN RAMARAO", "ABCDE1234F", ("ASHOKAN KUMARAN RAMARAO", 2, "below_number")),
    ("INCOME TAX DEPARTMENT\nGOVT\n\nAshokan Kumaran\nS/O MADHAVAN RAMARAO\nLaterine Namely", None, ("Ashokan Kumaran", 2, "any_line")),
    ("Name\nDate of Birth\nASHOKAN KUMARAN RAMARAO\n1\n2\n3\n4\n5", None, ("ASHOKAN KUMARAN RAMARAO", 2, "any_line")),
    ("Name\nx\ny\nz\nASHOKAN KUMARAN RAMARAO\n1\n2", None, ("ASHOKAN KUMARAN RAMARAO", 4, "any_line")),
    ("Father's Name\nMADHAVAN KUMARAN RAMARAO", None, None),
    ("", "ABCDE1234F", None),
    (None, None, None),
]
IDENTITY = [
    ("Government of India\nAshok Rao\nDOB: 01/02/1990\nMale", ("Ashok Rao", 1, "zone")),
    ("Government of India\nUnlikely Words\nAshok Rao\nDOB: 01/02/1990", ("Ashok Rao", 2, "zone")),
    ("Ashok Rao Kale DOB: 01/02/1990 Male", ("Ashok Rao Kale", 0, "fused_line")),
    ("2345 6789 0123\n12", None),
    ("DOB: 01/02/1990\nGovernment of India\nAshok Rao", None),
    (None, None),
]
SHEETS = [
    ("x\nCandidate's Full Name\n\nASHOK RAO\nother words here", ("Ashok Rao", "label", None)),
    ("FULL NAME\nA1 B2\none\nmarks 12 of 30", ("Full Name", "ranked", 75.0)),
    ("seat 12\nAshok Kumar Rao\nresult pass", ("Ashok Kumar Rao", "ranked", 90.0)),
    ("12 34\n5", None),
    ("", None),
    (None, None),
]


def struct(r, *names):
    return None if r is None else tuple(r[n] for n in names)


@pytest.mark.parametrize("k", range(len(CARDS)))
def test_tax_cards(spark, k):
    text, number, want = CARDS[k]
    r = spark.createDataFrame([(text, number)], "t string, n string").select(cn.card_holder(F.col("t"), F.col("n")).alias("h")).first()[0]
    assert struct(r, "name", "line", "method") == want


def test_identity_cards(spark):
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(IDENTITY)], "i int, t string").orderBy("i").select(cn.identity_name(F.col("t")).alias("h")).collect()
    assert [struct(r["h"], "name", "line", "method") for r in got] == [want for _, want in IDENTITY]


def test_candidates_of_sheets(spark):
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SHEETS)], "i int, t string").orderBy("i").select(cn.candidate_name(F.col("t")).alias("h")).collect()
    assert [struct(r["h"], "name", "method", "score") for r in got] == [want for _, want in SHEETS]


def test_nearer_lines_score_higher(spark):
    r = spark.range(1).select(*[cn.holder_score(F.lit(x), F.lit(b)).alias(str(i)) for i, (x, b) in enumerate((("RAVI RAO", 50), ("RAVI RAO", 40), ("Ravi Rao", 40), ("Ravi rao", 40), ("RA VI RA OK", 0)))]).first()
    assert r[0] - r[1] == 10 and r[1] - r[2] == 5 and r[2] - r[3] == 15
    assert round(r[4], 6) == round(8 / 11 * 40 + 22 + 20, 6)
