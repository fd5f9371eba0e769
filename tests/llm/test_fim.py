from __future__ import annotations

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from dossierlake.llm import fim
from tests.oracle import assert_same, connection

TEXTS = st.text(st.one_of(st.sampled_from("ab \n\r <>PSM漢\U0001f600"), st.characters(exclude_categories=["Cs"])), max_size=60)


def brute(doc_id, text, rate=100, spm=50):
    """Form, cuts and output by the rule as it is written, with the standard library's regular expressions."""
    units = re.findall(fim.LINES, text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_units_are_those_of_the_pattern(text):
    assert fim.unit_ends(text) == [m.end() for m in re.finditer(fim.LINES, text)]


def made(docs, **options):
    out = fim.fill_in_middle(docs, **options)
    return out.withColumn("restored", fim.restore(out["form"], out["output"])).collect()


def check(spark, rows, **options):
    got = made(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), **options)
    want = sorted((str(i), t or "", *brute(i, t or "", **options)) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["restored"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got) == want


def test_against_brute_force(spark):
    r = random.Random(5)
    rows = [(i, "".join(r.choice(("a", "\n", "é漢", "<", "S>", "\U0001f600 ", "word ", "P", ">")) for _ in range(r.randint(0, 40)))) for i in range(400)]
    check(spark, rows)
    check(spark, rows, rate=60, spm=20)
    assert {"plain", "psm", "spm"} == {brute(i, t)[1] for i, t in rows}


def test_texts_that_end_or_begin_like_a_mark_come_back(spark):
    check(spark, [(i, t) for i in range(40) for t in ("a<\nS>b\n<", "<\nP", "M>\n<S\n>", "\n\n\n", "<P\n>S<\nM>")])


def test_strange_rows(spark, strange, empty):
    check(spark, [(r["doc_id"], r["text"]) for r in strange.collect()])
    assert fim.fill_in_middle(empty).collect() == []


def test_clashing_columns_and_names(spark):
    docs = spark.createDataFrame([(1, "a\nb", 7, "x")], "n long, output string, id int, h1 string")
    got = fim.fill_in_middle(docs.withColumnsRenamed({"n": "form_id"}), id_col="form_id", text="output").collect()
    assert got[0]["output"] == brute(1, "a\nb")[4]


def test_long_texts_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(fim, "HELD_CHARS", 1)
    check(spark, [(i, "long line é\n" * 30_000) for i in range(3)] + [(9, "x" * 500_000)])


def test_query(spark, tiny):
    assert_same(fim.op13_fim(spark, tiny).toPandas(), connection(tiny).sql(fim.OP13_SQL).df())
