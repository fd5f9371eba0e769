from __future__ import annotations

import random
import re

import pytest

from dossierlake.llm import decontam
from tests.llm.conftest import prose, whole
from tests.oracle import assert_same, connection

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=13):
    found = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            found.setdefault(tuple(w[j : j + n]), set()).update([] if i is None else [str(i)])
    lengths = {len(k) for k in found}
    out = []
    for i, t in docs:
        w, hit, got = words(t), set(), set()
        for n in lengths:
            for j in range(len(w) - n + 1):
                if (own := found.get(tuple(w[j : j + n]))) is not None:
                    got |= own
                    hit |= set(range(j, j + n))
        out.append((i, len(w), len(hit), sorted(got), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items():
    r = random.Random(8)
    rows = [(i, prose(r, r.choice((3, 7, 12, 13, 14, 40)))) for i in range(25)]
    return [*rows, (25, None), (26, " .,"), (27, rows[3][1]), (None, rows[4][1]), (28, "a a a a a a a a a a a a a a a a")]


@pytest.fixture(scope="module")
def planted(items):
    r = random.Random(9)
    rows = []
    for i in range(50):
        w = prose(r, r.randint(0, 120)).split(" ")
        for _ in range(i % 3):
            part = words(items[r.randrange(25)][1])
            a = r.randint(0, max(0, len(part) - 13))
            at = r.randint(0, len(w))
            w[at:at] = [x.upper() for x in part[a : a + r.choice((12, 13, 20, 60))]]
        rows.append((i, ", ".join(w)))
    return [*rows, (50, None), (51, ""), (51, "a " * 30), (None, items[0][1])]


@pytest.mark.parametrize("block_bytes", [1 << 20, 900, 1])
def test_brute_force(spark, planted, items, block_bytes):
    docs, bench = spark.createDataFrame(planted, "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(docs, bench, block_bytes=block_bytes).collect()
    found, want = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got), key=str), brute(planted, items)
    assert found == want and any(r[4] for r in want)


def test_an_item_named_none(spark):
    """A real id ``None`` is listed; an item without an id isn't, though its words are hits."""
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "a b c"), ("None", "d e f")], "item_id string, text string")
    for most in (1 << 20, 1):
        got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontam.contamination(docs, bench, block_bytes=most).collect()}
        assert got == {1: (3, []), 2: (3, ["None"])}


@pytest.mark.parametrize("block_bytes", [1 << 20, 900])
def test_clashing_columns(spark, clashing, corpus, items, block_bytes):
    bench = spark.createDataFrame([*items, (99, corpus[5][1])], "item_id long, text string")
    left = decontam.drop_contaminated(clashing, bench, block_bytes=block_bytes)
    want = {r[0] for r in brute(corpus, [*items, (99, corpus[5][1])]) if not r[4]}
    assert whole(left, clashing) and {r["doc_id"] for r in left.collect()} == want and len(want) < len(corpus)


def test_stage_keeps_columns(spark, strange, items, empty):
    bench = spark.createDataFrame(items, "item_id long, text string")
    left = decontam.drop_contaminated(strange, bench)
    assert left.columns == strange.columns and left.count() == strange.count()
    assert decontam.contamination(empty, bench).collect() == []
    assert decontam.contamination(strange, bench.limit(0)).where("n_hit > 0").isEmpty()


def test_query(spark, tiny):
    docs = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in decontam.op9_decontam(spark, tiny).collect()), key=str)
    assert got == [(*r[:3], len(r[3]), r[4]) for r in brute(docs, items)]


def test_query_matches_sql(spark, tiny):
    assert_same(decontam.op9_decontam(spark, tiny).toPandas(), connection(tiny).sql(decontam.OP9_SQL).df())
