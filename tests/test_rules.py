"""Rules and functions on literal cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from dossierlake.functions import names as nm
from dossierlake.functions import scores as sc
from dossierlake.functions import text as tx
from dossierlake.operators import duplicates as dup
from dossierlake.operators import layout as ly
from dossierlake.operators import timeseries as ts
from dossierlake.plans import rules
from dossierlake.sources import sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def review(spark, **changes):
    base = {"stored_name": "Asha Rao", "found_name": "Asha Rao", "stored_dob": "01/02/1990", "found_dob": "01-02-1990", "stored_id": "2345 6789 0123", "found_id": "234567890123", "doc_type": "aadhaar", "ocr_confidence": 0.9}
    row = base | changes
    rows = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'double' if k == 'ocr_confidence' else 'string'}" for k in row))
    score = changes.get("_score")
    return rules.evaluate(rules.compare_fields(rows, F.lit(score) if score is not None else None)).first()


@pytest.mark.parametrize(
    ("changes", "decision", "priority"),
    [
        ({}, "AUTO_APPROVED", 3),
        ({"found_id": "999"}, "AUTO_REJECTED", 1),
        ({"found_dob": None}, "AUTO_REJECTED", 3),
        ({"ocr_confidence": 0.39}, "AUTO_REJECTED", 1),
        ({"ocr_confidence": 0.40}, "REVIEW_REQUIRED", 3),
        ({"ocr_confidence": 0.84}, "REVIEW_REQUIRED", 3),
        ({"ocr_confidence": 0.85}, "AUTO_APPROVED", 3),
        ({"doc_type": "unknown"}, "AUTO_REJECTED", 1),
        ({"found_dob": "1990"}, "REVIEW_REQUIRED", 3),
        ({"found_name": None, "found_dob": None, "found_id": None, "ocr_confidence": 0.0}, "AUTO_REJECTED", 1),
    ],
)
def test_decisions(spark, changes, decision, priority):
    r = review(spark, **changes)
    assert (r["decision"], r["priority"]) == (decision, priority)


def test_small_name_difference_can_be_corrected(spark):
    r = review(spark, found_name="Asha Raq", _score=None)
    assert r["name_status"] in ("POSSIBLE_MATCH", "MATCH")
    if r["name_status"] == "POSSIBLE_MATCH":
        assert r["auto_correctable"] == (r["name_score"] >= 88)


def test_indel_ratios():
    assert nm.indel_ratio("abcd", "abxd") == 75.0
    assert nm.indel_ratio("", "") == 100.0
    assert nm.fuzzy_score("rao asha", "asha rao") == 100.0
    assert nm.fuzzy_score("asha", "asha rao") == 100.0
    assert nm.fuzzy_score("", "x") == 0.0


def test_sound_codes(spark):
    assert one(spark, nm.sound(F.lit("Robert"))) == "R163"
    assert one(spark, nm.sound(F.lit("Tymczak"))) == "T252"  # Y counts as 2
    assert one(spark, nm.sound(F.lit(""))) == ""
    assert one(spark, nm.phonetic(F.lit("asha rao"), F.lit("aasha rau"))) == 100.0


def test_normal_names(spark):
    assert one(spark, nm.normal_name(F.lit("  José  Núñez-Ortiz "))) == "jose nunez ortiz"
    assert one(spark, nm.normal_name(F.lit("आशा"))) == ""


@pytest.mark.parametrize(("c", "score"), [(1.0, 20), (0.39, 20), (0.0, 32)])
def test_risk_score(spark, c, score):
    zero = F.lit(0)
    assert one(spark, sc.risk_score(zero, zero, zero, zero, zero, F.lit(c))) == score


def test_hash_distances(spark):
    rows = spark.createDataFrame([("0" * 16, "0" * 15 + "7"), ("0" * 16, "0" * 15), ("f" * 16, "0" * 16)], "a string, b string")
    assert [r[0] for r in rows.select(dup.hamming(F.col("a"), F.col("b"))).collect()] == [3, 999, 64]
    assert [one(spark, dup.match_class(F.lit(d))) for d in (3, 4, 10, 11, 20, 21)] == ["IDENTICAL", "NEAR_DUPLICATE", "NEAR_DUPLICATE", "SIMILAR", "SIMILAR", "DIFFERENT"]


@pytest.mark.parametrize(("block", "at_once"), [(1 << 18, 1 << 16), (40, 7), (7, 1)])
def test_hashes_meet_in_blocks_without_a_join(spark, monkeypatch, block, at_once):
    import random

    import numpy as np

    monkeypatch.setattr(dup, "BLOCK", block)
    monkeypatch.setattr(dup, "AT_ONCE", at_once)
    r = random.Random(block)
    codes = [r.getrandbits(64) for _ in range(12)]
    codes = sorted({c ^ sum(1 << b for b in r.sample(range(64), k)) for c in codes for k in (0, 0, 1, 2, 9, 10, 11, 12)} | {0, 1, 2**64 - 1})
    near = {(a, b, (a ^ b).bit_count()) for a in codes for b in codes if a < b and (a ^ b).bit_count() <= 10}
    signed = np.array(codes, np.uint64).view(np.int64)
    i, j, d = dup.near_codes(signed, None, 10)
    assert sorted((codes[x], codes[y], z) for x, y, z in zip(i, j, d.tolist(), strict=True)) == sorted(near)
    i, j, d = dup.near_codes(signed[::2], signed[1::2], 10)
    odd = {c for c in codes[1::2]}
    assert {(*sorted((codes[::2][x], codes[1::2][y])), z) for x, y, z in zip(i, j, d.tolist(), strict=True)} == {p for p in near if (p[0] in odd) != (p[1] in odd)}
    frame = spark.createDataFrame([(n, n, f"{c:016x}", f"{c:016x}"[:15], None) for n, c in enumerate(codes)], "document_id long, user_id long, phash string, ahash string, dhash string")
    found = dup.near_images(frame)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(int(x["hash_a"], 16), int(x["hash_b"], 16), x["distance"]) for x in found.where("kind = 'phash'").collect()} == near


@pytest.mark.parametrize("most", [10, 3, 15])
def test_bands_miss_no_near_pair(spark, most):
    import random

    r = random.Random(3)
    rows = []
    for i in range(150):
        base = r.getrandbits(64) if i % 3 == 0 else rows[-1][5] ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 18)))
        rows.append((i, i % 50, f"{base:016x}", f"{r.getrandbits(64):016x}", f"{r.getrandbits(64):016x}", base))
    frame = spark.createDataFrame([x[:5] for x in rows], "document_id long, user_id long, phash string, ahash string, dhash string")
    found = {(x["hash_a"], x["hash_b"]): x["distance"] for x in dup.near_images(frame, most).where("kind = 'phash'").collect()}
    apart = lambda a, b: (a[5] ^ b[5]).bit_count()
    expected = {tuple(sorted((a[2], b[2]))): apart(a, b) for a in rows for b in rows if a[0] < b[0] and a[1] != b[1] and apart(a, b) <= most}
    assert found == expected and expected


def test_check_digit(spark):
    assert one(spark, tx.check_digit_holds(F.lit("2363")))
    assert not one(spark, tx.check_digit_holds(F.lit("2364")))
    assert one(spark, tx.title_case(F.lit("o'neil SMITH-jones"))) == "O'Neil Smith-Jones"


def test_growth_needs_two_weeks(spark):
    series = spark.sql("SELECT date_add(DATE '2024-01-01', cast(id AS int)) AS date, IF(id < 7, 5L, 10L) AS count FROM range(14) t(id)")
    assert ts.growth(series).first()["growth_pct"] == 100.0
    assert ts.growth(series.where("date > DATE '2024-01-02'")).first()["growth_pct"] is None
    assert {r["rolling_avg"] for r in ts.rolling_mean(series.withColumn("count", F.lit(4))).where("date > DATE '2024-01-01'").collect()} == {4.0}


def test_row_bands_follow_the_mean(spark):
    cy = [0, 8, 16, 24, 60]  # each is near the mean of the line so far, or begins a new line
    rows = spark.createDataFrame([(1, 1, i, f"w{i}", 0.9, 0.0, y - 10.0, 50.0, y + 10.0) for i, y in enumerate(cy)], "doc long, page long, word_id int, text string, conf double, x1 double, y1 double, x2 double, y2 double")
    out = {r["word_id"]: r["line"] for r in ly.row_bands(ly.clean_words(rows)).collect()}
    assert out == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2}


def test_table_continuation(spark):
    lines = [["01/01/2024", "rent", "10.00"], ["", "for may", ""], ["02/01/2024", "food", "3.00"]]
    rows = [(1, 1, n, k, t, 200.0 * k, 0.0, 200.0 * k + 50, 10.0, 1, 200.0 * k + 25) for n, cells in enumerate(lines) for k, t in enumerate(cells) if t]
    frame = spark.createDataFrame(rows, "doc long, page long, line long, phrase long, text string, x1 double, y1 double, x2 double, y2 double, words long, cx double")
    assert [r["cells"] for r in ly.table_grid(frame).orderBy("row").collect()] == [["01/01/2024", "rent for may", "10.00"], ["02/01/2024", "food", "3.00"]]


def test_keyed_changes(spark, tmp_path):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, sinks.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    several = spark.createDataFrame([(2, "z"), (2, "c")], "k int, v string")
    assert sorted(map(tuple, sinks.upsert(old, several, ["k"]).collect())) == [(1, "a"), (2, "c")]
    events = spark.createDataFrame([(1, "x", 5), (1, "y", 5), (1, "a", 4)], "k int, v string, at int")
    assert sorted(map(tuple, sinks.fold_events(old, events, "k", "v", "at").collect())) == [(1, "y"), (2, "b")]
    sinks.write_csv(new, f"file://{tmp_path}/out", quote_all=True)
    assert spark.read.csv(f"file://{tmp_path}/out", header=True).count() == 2
    with pytest.raises(Exception, match="not exactly one row"):
        sinks.single(old).collect()


def test_what_patterns_need():
    import re

    from dossierlake.functions import text as tx

    assert tx.needed(r"(?i)\b(a|bc\s*def)\b") == ["a", "def"] and tx.needed(r"(?i)\b(x\?y|reg(istration)?)\b") == ["x?y", "reg"]
    assert tx.needs_digit(r"\b\d{4}\s?x") and not tx.needs_digit(r"[₹]\s*[\d,]+\.?\d{0,2}") and not tx.needs_digit(r"(?i)(tax|%)[\s:]+[\d,.]+")
    samples = {
        "bank_statement": ["a/c: 12345678", "ac 123456789", "₹ ,", "NEFT", "1/2/24 3,4", "available"],
        "invoice": ["tax: ,", "% 12", "grand  total", "amount\tdue"],
        "marksheet": ["reg number", "registration no", "roll no", "75 / 100"],
        "government_doc": ["no. 7", "order 1", "ref no", "ref. no", "this is  to certify"],
        "pan": ["father's name", "income tax department", "भारत सरकार"],
        "passport": ["republic of india", "date  of issue", "P<INDABCDEF"],
    }
    for kind, texts in samples.items():
        for t in texts:
            for _, p in tx.SIGNATURES[kind]:
                if re.search(p, t):
                    assert not p.startswith("(?i)") or not tx.needed(p) or any(x in t.lower() for x in tx.needed(p)), (t, p)
                    assert not tx.needs_digit(p) or re.search(r"\d", t), (t, p)
