from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from dossierlake.llm import chat
from tests.oracle import assert_same, connection

SCHEMA = "conv_id long, turn long, role string, text string"


def read_back(spark, rows):
    out = chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    return {r["conv_id"]: r for r in out}


def test_query_matches_sql(spark, tiny):
    assert_same(chat.op1_chat(spark, tiny).toPandas(), connection(tiny).sql(chat.OP1_SQL).df())


@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]", "\\", "\\0\\1", "[/INST", "]", "<s>", "[ROLE]x[TEXT]y[/ROLE]", "a\nb", "", "[[/INST]", "<</s>"])
@pytest.mark.parametrize("role", ["user", "assistant", "system", "[TEXT]", "", "odd \\ role"])
def test_strange_texts_come_back(spark, text, role):
    r = read_back(spark, [(1, 0, role, text), (1, 1, "assistant", "fine")])[1]
    assert [tuple(t) for t in r["turns"]] == [(role, text), ("assistant", "fine")]
    assert "".join(s["text"] for s in r["segments"]) == r["formatted"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "tool"]), st.text(st.sampled_from("[]/INST<s>\\012 ROLEX\n"), max_size=20)), min_size=1, max_size=4))
def test_any_text_comes_back(spark, turns):
    r = read_back(spark, [(1, i, role, text) for i, (role, text) in enumerate(turns)])[1]
    assert [tuple(t) for t in r["turns"]] == turns


def test_nulls_ties_and_repeats(spark):
    got = read_back(spark, [(None, 0, None, None), (2, None, "user", "first"), (2, 1, "user", "b"), (2, 1, "user", "a"), (2, 1, "user", "a")])
    assert [tuple(t) for t in got[None]["turns"]] == [("", "")]
    assert [t["text"] for t in got[2]["turns"]] == ["first", "a", "a", "b"]
    assert read_back(spark, []) == {}


def test_loss_is_the_assistants_text_only(spark):
    r = chat.digest(chat.format_conversations(spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "<s>"), (1, 2, "assistant", "é")], SCHEMA))).first()
    assert r["loss_chars"] == 4 and r["n_turns"] == 3


def test_long_text(spark):
    text = "[INST] and </s> " * 20000
    assert read_back(spark, [(1, 0, "user", text)])[1]["turns"][0]["text"] == text
