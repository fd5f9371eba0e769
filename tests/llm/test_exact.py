from __future__ import annotations

from collections import defaultdict

import pytest

from dossierlake.llm import exact
from tests.llm.conftest import whole
from tests.oracle import assert_same, connection


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return sorted(((i, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""])) for i, t in rows), key=str)


@pytest.mark.parametrize("digests", [("sha256",), ("crc32", "sha256")])
def test_groups(spark, documents, corpus, digests):
    out = exact.exact_groups(documents, digests=digests, files_per_batch=1).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in out), key=str) == brute(corpus)
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in out)


def test_equal_digests_of_different_texts(spark):
    """Two texts of one CRC-32: full bytes tell them apart, so the wider digest is taken."""
    docs = spark.createDataFrame([(1, "plumless"), (2, "buckeroo"), (3, "buckeroo")], "doc_id long, text string")
    out = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact.exact_groups(docs, digests=("crc32", "sha256")).collect()}
    assert out == {1: (1, 1), 2: (3, 2), 3: (3, 2)}
    with pytest.raises(ValueError, match="share every digest"):
        exact.exact_groups(docs, digests=("crc32",))


def test_strange_rows(spark, strange, empty):
    out = exact.exact_groups(strange).collect()
    kept = [r["doc_id"] for r in out if r["kept"]]
    assert sorted(x for x in kept if x is not None) == [2, 3, 5, 6, 7, 8, 9, 9, 10] and None in kept
    left = exact.drop_duplicates(strange)
    assert left.columns == strange.columns and left.count() == len(kept)
    assert exact.exact_groups(empty).collect() == [] and exact.drop_duplicates(empty).collect() == []


def test_clashing_columns(clashing, corpus):
    left = exact.drop_duplicates(clashing)
    assert whole(left, clashing) and sorted(r["doc_id"] for r in left.collect()) == sorted({k for _, k, _ in brute(corpus)})
    assert exact.exact_groups(clashing).count() == len(corpus)


def test_large_groups_and_long_texts(spark):
    """A group of a third of all rows, null ids among them, and texts of some megabytes that differ at their ends."""
    rows = [(i if i % 7 else None, "one text") for i in range(2000)] + [(i, f"text {i % 1500}") for i in range(2000, 6000)]
    rows += [(6000 + i, "x" * 3_000_000 + str(i % 2)) for i in range(4)]
    out = exact.exact_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in out), key=str) == brute(rows)
    assert sum(r["kept"] for r in out) == len({t for _, t in rows})


def test_null_ids_alone(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (None, "b")], "doc_id long, text string")
    assert sorted((r["group_size"], r["kept"]) for r in exact.exact_groups(docs).collect()) == [(1, True), (2, False), (2, True)]
    assert sorted(r["text"] for r in exact.drop_duplicates(docs).collect()) == ["a", "b"]


def test_half_of_all_rows_have_one_text_and_no_id(spark):
    rows = [(None, "one text", i) for i in range(3000)] + [(5, "other text", i) for i in range(1000)] + [(i, f"text {i}", i) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(4)
    out = exact.exact_groups(docs).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in out), key=str) == brute([x[:2] for x in rows])
    left = exact.drop_duplicates(docs).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in left), key=str) == sorted({x[:2] for x in rows}, key=str)
    # What of it crosses a shuffle is a row a task.
    plan = exact.drop_duplicates(docs)._jdf.queryExecution().executedPlan().toString()
    assert "partial_first" in plan and "Window" not in plan


def test_query_matches_sql(spark, tiny):
    assert_same(exact.op5_exact(spark, tiny).toPandas(), connection(tiny).sql(exact.OP5_SQL).df())
