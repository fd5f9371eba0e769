from __future__ import annotations

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dossierlake.llm import licenses as ls

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def places(text, phrases):
    """Every place of every phrase, by comparing words one by one."""
    words = WORD.findall(lowered(text))
    return len(words), sorted((i, p) for p in phrases for i in range(len(words)) if words[i : i + len(p.split())] == p.split())


def climb(tokens):
    """Strictness and labels of an expression by precedence climbing, apart from the shunting-yard."""

    def atom():
        if tokens[0] == "(":
            tokens.pop(0)
            x = either(1)
            tokens.pop(0)
            return x
        label = ls.label_of(tokens.pop(0))
        return ls.STRICT.get(label, ls.UNKNOWN), {label}

    def either(least):
        x = atom()
        while tokens and ls.BINDS.get(tokens[0].lower(), 0) >= least:
            word = tokens.pop(0).lower()
            if word == "with":
                tokens.pop(0)
                x = max(0, x[0] - 1), x[1]
                continue
            y = either(ls.BINDS[word] + 1)
            x = (min if word == "or" else max)(x[0], y[0]), x[1] | y[1]
        return x

    return either(1)


NAMES = st.sampled_from(["MIT", "Apache-2.0", "GPL-2.0-only", "GPL-3.0+", "LGPL-2.1", "AGPL-3.0-or-later", "CC-BY-NC-4.0", "0BSD", "LicenseRef-own", "BSD-3-Clause", "cc0-1.0"])
EXPRESSIONS = st.recursive(
    st.one_of(NAMES, st.builds(lambda a: f"{a} WITH Classpath-exception-2.0", NAMES)),
    lambda x: st.one_of(st.builds(lambda a, o, b: f"{a} {o} {b}", x, st.sampled_from(["AND", "OR", "and", "or"]), x), st.builds(lambda a: f"({a})", x)),
    max_leaves=8,
)


@settings(max_examples=400, deadline=None)
@given(EXPRESSIONS)
def test_shunting_yard_against_precedence_climbing(expression):
    tokens = re.findall(r"[()]|[^() ]+", expression)
    terms = ls.evaluate(ls.postfix(expression))
    assert (terms.step, set(terms.labels)) == climb(tokens)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["MIT", "GPL-3.0", "(", ")", "AND", "or", "with", "x", "*", "\n"]), max_size=12))
def test_any_tokens_are_read(tokens):
    terms = ls.evaluate(ls.postfix(" ".join(tokens)))
    assert terms is None or 0 <= terms.step <= 4


@pytest.mark.parametrize(
    ("text", "ordered"),
    [
        ("MIT OR GPL-2.0-only AND BSD-3-Clause", "MIT GPL-2.0-only BSD-3-Clause and or"),
        ("(MIT or GPL-2.0-only) AND ISC", "MIT GPL-2.0-only or ISC and"),
        ("GPL-2.0-only WITH Classpath-exception-2.0 OR MIT */", "GPL-2.0-only Classpath-exception-2.0 with MIT or"),
        ("MIT and further words", "MIT further and"),
        ("MIT (see below)", "MIT"),
        ("MIT AND (ISC OR", "MIT"),
        ("AND MIT", ""),
        ("(MIT", ""),
        ("MIT WITH a WITH b", "MIT a with"),
        ("(MIT OR ISC) WITH x", "MIT ISC or"),
        (") MIT", ""),
        ("", ""),
    ],
)
def test_expressions(text, ordered):
    assert " ".join(ls.postfix(text)) == ordered


def test_what_expressions_come_to():
    value = lambda x: ls.STEPS[ls.evaluate(ls.postfix(x)).step]
    assert value("MIT OR GPL-3.0-only") == 0.25
    assert value("MIT AND GPL-3.0-only") == 0.75
    assert value("GPL-3.0-only WITH GCC-exception-3.1") == 0.5
    assert value("AGPL-3.0-only AND (CC0-1.0 OR MIT)") == 1.0
    assert value("SomethingElse") == 0.5


def rows_of(docs, **options):
    return ls.scan_licenses(docs, **options).collect()


def test_places_against_brute_force(spark):
    r = random.Random(2)
    pool = "gnu general public license apache mit cc by nc sa bsd the of GNU License, MIT é 漢 cc0 all rights reserved\n --".split(" ")
    rows = [(i, " ".join(r.choice(pool) for _ in range(r.randint(0, 60)))) for i in range(300)]
    rows += [(300, "cc by cc by nc cc  by-NC_sa"), (301, "mit license mit license"), (302, "smit license"), (303, "mit licensed")]
    phrases = ls.BASE | ls.NOTICES
    got = {x["doc_id"]: x for x in rows_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))}
    for i, t in rows:
        n, found = places(t, phrases)
        assert (got[i]["n_words"], [(x["word"], x["phrase"]) for x in got[i]["places"]]) == (n, found)
        assert got[i]["labels"] == sorted({phrases[p] for _, p in found})
        assert got[i]["score"] == max([ls.STEPS[ls.STRICT[phrases[p]]] for _, p in found], default=0.0)


def test_tags(spark):
    rows = [
        (1, "/* é SPDX-License-Identifier: MIT OR Apache-2.0 */\nint x;"),
        (2, "# spdx-license-identifier: (GPL-2.0-only WITH Classpath-exception-2.0) AND Apache-2.0\n# SPDX-License-Identifier: CC-BY-NC-4.0"),
        (3, "License-Expression: LicenseRef-own"),
        (4, "SPDX-License-Identifier:\nMIT"),
        (5, "Released under the MIT License. SPDX-License-Identifier: GPL-3.0-or-later"),
    ]
    got = {x["doc_id"]: x for x in rows_of(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert [(x["byte"], x["postfix"], x["strictness"]) for x in got[1]["tags"]] == [(6, "MIT Apache-2.0 or", 0.25)]
    assert (got[2]["labels"], got[2]["score"]) == (["apache", "cc-by", "cc-by-nc", "gpl"], 1.0)  # the words of the base phrase stand in it
    assert [x["strictness"] for x in got[2]["tags"]] == [0.5, 1.0]
    assert (got[3]["labels"], got[3]["score"]) == (["licenseref-own"], 0.5)
    assert (got[4]["tags"], got[4]["score"]) == ([], 0.0)
    assert (got[5]["labels"], got[5]["score"]) == (["gpl", "mit"], 0.75)


def test_strange_rows(spark, strange, empty):
    got = rows_of(strange)
    assert len(got) == strange.count()
    want = sorted((str(r["doc_id"]), len(WORD.findall(lowered(r["text"] or "")))) for r in strange.collect())
    assert sorted((str(r["doc_id"]), r["n_words"]) for r in got) == want
    assert all(r["score"] == 0 and r["labels"] == [] for r in got)
    assert rows_of(empty) == []


def test_clashing_columns_and_long_texts(spark):
    text = "word " * 300_000 + "MIT License " + "é\n" * 200_000 + "cc by"
    docs = spark.createDataFrame([(1, text, "a", 2)], "places long, labels string, doc_id string, score int")
    got = rows_of(docs.withColumnsRenamed({"places": "key", "labels": "text"}), id_col="key")
    assert [(x["word"], x["phrase"]) for x in got[0]["places"]] == [(300_000, "mit license"), (500_002, "cc by")]


def test_query_against_brute_force(spark, tiny):
    texts = {r[0]: r[1] or "" for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()}
    got = ls.op11_licenses(spark, tiny).collect()
    assert len(got) == len(texts)
    for r in got:
        n, found = places(texts[r["doc_id"]], ls.BASE)
        starts = [i for i, _ in found]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (n, len(found), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({ls.BASE[p] for _, p in found}))
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}
        assert (r["score"] > 0) == bool(r["labels"])
    assert any(r["n_base"] for r in got)
