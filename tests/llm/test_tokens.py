from __future__ import annotations

import random
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import pre_tokenizers

from dossierlake.llm import tokens
from dossierlake.llm._bpe import merges
from dossierlake.llm._tokenizer import load, special_strings

NAME = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def counts():
    return tokens._Counts(NAME, tokens.whole_tokens(NAME))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(counts, text):
    text = text.encode("utf-8", "replace").decode()
    assert tokens.count_tokens(text, counts, special_strings(load(NAME))) == len(load(NAME).encode(text, add_special_tokens=False).ids)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from("ab 1.'\n\t\u00a0\u1680\u2009\u05d0\u0e01\U0001f600\u1ea5\u0301\u3000"), st.characters()), max_size=60))
def test_doubted_characters_among_others(counts, text):
    text = text.encode("utf-8", "replace").decode()
    assert tokens.count_tokens(text, counts, special_strings(load(NAME))) == len(load(NAME).encode(text, add_special_tokens=False).ids)


def test_only_what_is_around_doubted_characters_goes_to_the_library(counts, monkeypatch):
    asked = []
    monkeypatch.setattr(counts, "library", lambda x: asked.append(x) or len(load(NAME).encode(x, add_special_tokens=False).ids))
    text = "some words \u05d0\u05d1 and then \U0001f600 the end " + "of it all " * 50
    assert tokens.count_tokens(text, counts, []) == len(load(NAME).encode(text, add_special_tokens=False).ids)
    assert sum(map(len, asked)) < 60


def test_known_texts(counts):
    for text in ("it's we'll  two\n\n three", "a<|endoftext|>b", "’quoted’ – 漢字 한글", "½ ² x1", "\t\t end ", "é" * 500):
        assert tokens.count_tokens(text, counts, special_strings(load(NAME))) == len(load(NAME).encode(text, add_special_tokens=False).ids)


def test_character_classes_agree_where_they_are_trusted():
    cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    for c in range(sys.maxunicode + 1):
        if 0xD800 <= c <= 0xDFFF or tokens.UNSURE.match(chr(c)):
            continue
        if c > 0x2070 and c % 37:
            continue
        text = f"a{chr(c)}{chr(c)}1{chr(c)} {chr(c)}"
        assert [e for _, e in cut.pre_tokenize_str(text)] == [m.span() for m in tokens.PRE_TOKEN.finditer(text)], hex(c)


def test_proven_strings_are_single_tokens():
    proven = tokens.whole_tokens(NAME)
    assert len(proven) > 40_000
    for text in random.Random(1).sample(sorted(proven), 500):
        assert len(load(NAME).encode(text, add_special_tokens=False).ids) == 1


def test_long_texts_are_counted_in_parts(counts, monkeypatch):
    monkeypatch.setattr(tokens, "HELD", 50)
    text = "some words, and 123 more. " * 40
    assert tokens.count_tokens(text, counts, []) == len(load(NAME).encode(text, add_special_tokens=False).ids)


def test_strange_rows(spark, strange, empty):
    got = tokens.with_token_counts(strange, limit=5).collect()
    texts = [r["text"] or "" for r in strange.collect()]
    want = sorted((len(t.encode()), n := len(load(NAME).encode(t, add_special_tokens=False).ids), n > 5) for t in texts)
    assert sorted((r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == want
    assert tokens.with_token_counts(empty).collect() == []


@pytest.mark.parametrize("name", [NAME, "word_bpe_49k.json"])
def test_own_merges(name):
    r = random.Random(3)
    words = ["".join(r.choice("abcdeéüst") for _ in range(r.randint(1, 25))) for _ in range(2000)]
    found = merges(name).encode([w.encode() for w in words])
    assert [x.tolist() for x in found] == [load(name).encode(w, add_special_tokens=False).ids for w in words]


def test_query(spark, tiny):
    texts = {r[0]: r[1] or "" for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()}
    want = {i: (len(t.encode()), n := len(load(NAME).encode(t, add_special_tokens=False).ids), n > 512) for i, t in texts.items()}
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.op10_token_counts(spark, tiny).collect()} == want


def test_a_very_long_text(spark):
    text = "some w\u00f6rds \u05d0 and, \U0001f600 " * 60_000
    got = tokens.with_token_counts(spark.createDataFrame([(1, text), (2, "x" * 300_000)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {1: len(load(NAME).encode(text, add_special_tokens=False).ids), 2: len(load(NAME).encode("x" * 300_000, add_special_tokens=False).ids)}
