from __future__ import annotations

import re

import numpy as np
import pytest

from dossierlake.llm import substring
from dossierlake.llm.substring import OP2_SQL, op2_substring, remove_repeats
from tests.oracle import assert_same, connection

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, length):
    """Per row in the order given: words, removed, kept text."""
    start: dict[tuple, tuple] = {}
    words = [(-1 << 63 if i is None else i, WORD.findall(t or "")) for i, t in rows]
    for key, w in words:
        for j in range(len(w) - length + 1):
            k = tuple(w[j : j + length])
            start[k] = min(start.get(k, (key, j)), (key, j))
    out = []
    for (i, _), (key, w) in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for j in range(len(w) - length + 1):
            if start[tuple(w[j : j + length])] < (key, j):
                gone[j : j + length] = [True] * length
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("length", "start"), [(20, 10), (20, 5), (4, 4)])
def test_brute_force(spark, documents, corpus, length, start):
    got = remove_repeats(documents, length, start, chunk_bytes=4000, bucket_words=500)
    assert sorted(map(tuple, got.collect()), key=str) == brute(corpus, length)


def test_strange_rows(spark, strange):
    rows = [(r[0], r[1]) for r in strange.select("doc_id", "text").collect()]
    assert sorted(map(tuple, remove_repeats(strange, 2, 1).collect()), key=str) == brute(rows, 2)


def test_empty(spark, empty):
    assert remove_repeats(empty).collect() == []


def test_a_text_that_repeats_itself(spark):
    rows = [(1, "a b c d " * 50), (2, "a b c d " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, remove_repeats(docs, 8, 4).collect()), key=str) == brute(rows, 8)


def test_levels_above_one_doubling_and_long_texts(spark):
    rows = [(i, " ".join(f"w{(k * (i + 3)) % 97}" for k in range(400))) for i in range(12)] + [(20, "ab cd " * 200_000 + "z"), (21, "x" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, remove_repeats(docs, 16, 2).collect()), key=str) == brute(rows, 16)


def test_windows_of_one_hash_are_told_apart_by_the_second():
    h, second = np.array([5, 5, 5, 7], np.uint64), np.array([2, 1, 2, 1], np.uint64)
    order, new = substring._runs(h, second, np.array([3, 2, 1, 1]), np.array([0, 0, 0, 0]))
    assert order.tolist() == [1, 2, 0, 3] and new.tolist() == [True, True, False, True]


def test_other_ids_are_refused(spark):
    with pytest.raises(ValueError, match="whole number"):
        remove_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_length_must_be_a_doubling(documents):
    with pytest.raises(ValueError, match="power of two"):
        remove_repeats(documents, 20, 7)


def test_query_matches_sql(spark, tiny):
    assert_same(op2_substring(spark, tiny).toPandas(), connection(tiny).sql(OP2_SQL).df())
