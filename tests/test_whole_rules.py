"""Rules in full, against brute force."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from dossierlake.functions import names as nm
from dossierlake.functions import text as tx
from dossierlake.operators import duplicates as dup
from dossierlake.plans import rule_queries as rq
from dossierlake.plans import search
from dossierlake.plans.registry import QUERIES


def plain_type(text: str) -> str:
    scores = {k: min(0.95, sum(w for w, p in x if re.search(p, text)) / max(sum(w for w, _ in x), 1.0)) for k, x in tx.SIGNATURES.items()}
    for k, (p, points) in tx.FORMATS.items():
        if re.search(p, text):
            scores[k] = min(0.95, scores[k] + points)
    if round(sum("\u0900" <= c <= "\u097f" for c in text) / max(len(text), 1), 3) > 0.3:
        scores["ration_card"] = min(0.95, scores["ration_card"] + 0.08)
        scores["government_doc"] = min(0.95, scores["government_doc"] + 0.05)
    best = max(scores, key=scores.get)
    return best if scores[best] >= 0.08 else "unknown"


TEXTS = {
    "Subject Theory Marks 071/100 Result: first division, Roll No 12": "marksheet",
    "Fair price shop: rice, sugar, kerosene. Head of family": "ration_card",
    "राशन कार्ड": "ration_card",
    "Ministry of Finance, office of the Director, order 12 dated": "government_doc",
    "Tax invoice: qty 3, total 12": "invoice",
    "NEFT credit, closing balance ₹ 1,200.00": "bank_statement",
    "UIDAI XXXX XXXX 1234 Address": "aadhaar",
    "आधार 1234 5678 9012": "aadhaar",
    "Income tax ABCDE1234F": "pan",
    "P<INDRAO<<ASHA<<<<": "passport",
    "पिता चीनी": None,
    "a plain sentence": "unknown",
    "": "unknown",
}


def test_all_eight_document_types(spark, tiny):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    found = {r["text"]: r["t"] for r in rows.select("text", tx.signature_type(F.col("text")).alias("t")).collect()}
    assert found == {t: plain_type(t) for t in TEXTS} and all(found[t] == k for t, k in TEXTS.items() if k)
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select(F.coalesce("text", F.lit("")).alias("text"))
    assert all(r["t"] == plain_type(r["text"]) for r in docs.select("text", tx.signature_type(F.col("text")).alias("t")).collect())
    hinted = rows.select(tx.signature_type(F.lit("12.50\n13.00"), F.lit(0.5)).alias("a"), tx.signature_type(F.lit("x"), hint=F.lit("invoice")).alias("b")).first()
    assert tuple(hinted) == ("bank_statement", "invoice")


def test_misread_names_are_scored_in_approvals(spark, tiny):
    pairs = {r["id"]: r for r in rq.field_pairs(spark, tiny).select("id", nm.normal_name(F.col("stored_name")).alias("a"), nm.normal_name(F.col("found_name")).alias("b")).collect()}
    scores = {r["id"]: r for r in QUERIES["r1_validation_fuzzy"](spark, tiny).collect()}
    reasons = {r["id"]: r["reasons"].split(",") for r in QUERIES["r2_approval_fuzzy"](spark, tiny).collect()}
    names = {r["id"]: r["difference"] for r in QUERIES["r3_comparison_fuzzy"](spark, tiny).where("field = 'name'").collect()}
    assert scores.keys() == reasons.keys() == names.keys() == pairs.keys()
    misread = 0
    for k, p in pairs.items():
        score = nm.fuzzy_score(p["a"] or "", p["b"] or "")
        if score < nm.MATCH and p["b"]:
            continue  # these may be raised by their sound
        assert abs(scores[k]["name_score"] - score) <= 0.051
        assert (scores[k]["name_status"] == "MATCH") == ("name_mismatch" not in reasons[k]) == (names[k] == "exact_match") == (score >= nm.MATCH)
        misread += p["a"] != p["b"]
    assert misread > 0
    assert QUERIES["r2_approval_intended"](spark, tiny).count() == len(pairs)


def test_members_and_pairs_give_all_near_images(spark):
    near, far = "00000000000000ff", "ffff0000ffff0000"
    rows = [(1, 1, near), (2, 1, near), (3, 1, near), (4, 2, near), (5, 2, near), (6, 3, far), (7, None, far), (8, None, far), (9, 3, "00000000000000f0"), (10, 1, None)]
    hashes = spark.createDataFrame([(d, u, h, h, h) for d, u, h in rows], "document_id long, user_id long, phash string, ahash string, dhash string")
    of = {}
    for r in dup.image_hashes(hashes).where("kind = 'phash'").collect():
        of.setdefault(r["hash"], []).append((r["document_id"], r["user_id"]))
    pairs = [(r["hash_a"], r["hash_b"]) for r in dup.near_images(hashes).where("kind = 'phash'").collect()]
    assert len(pairs) == len(set(pairs)) == 2
    found = {tuple(sorted((x, y))) for a, b in pairs for x, u in of[a] for y, v in of[b] if x != y and u and v and u != v}
    apart = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    assert found == {(a, b) for a, u, g in rows for b, v, h in rows if a < b and u and v and u != v and g and h and apart(g, h) <= 10}


def test_all_branches_of_the_search(spark):
    rows = [
        (1, "Asha Rao", "01/02/1980", "Asha Rao", "asha rao ", ["aadhaar", "pan", "tenth", "twelfth", "degree"], 75.0, None),
        (2, "Ravi Das", "01/12/2000", "Ravi", "Ravi Das", ["tenth"], 60.0, 7.0),
        (3, "Mina Sen", None, None, "Mina", ["twelfth"], None, 8.0),
        (12, "Om Pal", "bad", None, None, None, None, None),
        (5, "Zed Ali", "01/01/1990", None, None, ["pan", "diploma"], 39.0, 5.0),
    ]
    people = spark.createDataFrame(rows, "id long, full_name string, dob string, aadhaar_name string, pan_name string, doc_types array<string>, best_pct double, best_cgpa double")
    want = {"no adhar": {2, 3, 12, 5}, "name mismatch": {2}, "age > 30": {1, 5}, "age<30": {2}, "above 75": {1}, "above 80": set(), "first class": {2}, "below 60": {5}, "fail": {5}, "cgpa > 7": {2, 3}, "low cgpa": {5}, "best cgpa": {2, 3, 5}, "no academic": {12}, "all academic": {1}, "only 10th": {2}, "only 12th": {3}, "degree": {1, 5}, "12th": {1, 3}, "12": {12}, "rao": {1}}
    for q, ids in want.items():
        assert {r["id"] for r in search.ladder(people, q, "2024-06-01 00:00:00").collect()} == ids, q
    assert [r["id"] for r in search.ladder(people, "toppers", "2024-06-01 00:00:00").collect()] == [2, 5, 3, 1]
