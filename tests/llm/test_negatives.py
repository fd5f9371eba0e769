from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dossierlake.llm import negatives as ng
from tests.oracle import assert_same, connection

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100, positives=5, negatives=5, least=80, most=100, scale=256):
    """(anchor, positive, rank, negative, scores) by scoring all pairs in plain integers."""
    kept = [(n, i, [math.floor(float(np.float32(x)) * scale) for x in v], c) for n, (i, v, c) in enumerate(rows) if c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
    out = []
    for n, i, v, c in kept:
        if i is None or i % every:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, m, d) for m, j, w, d in kept if m != n]  # noqa: B905
        for p in sorted((x for x in scored if x[3] == c), key=order)[:positives]:
            fits = [x for x in scored if x[3] != c and least * p[0] <= 100 * x[0] <= most * p[0]]
            out += [(i, p[1], k + 1, x[1], p[0], x[0]) for k, x in enumerate(sorted(fits, key=order)[:negatives])]
    return sorted(map(str, out))


def found(spark, rows, parts=3, every=100, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted(str(tuple(r)) for r in ng.mine(df, F.col("vec_id") % every == 0, **options).collect())


def clustered(n, width, seed, labels=4, spread=0.4):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(3, width))
    x = centres[r.integers(0, 3, n)] + spread * r.normal(size=(n, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, [float(np.float32(c)) for c in v], int(r.integers(0, labels))) for i, v in enumerate(x)]


@pytest.mark.parametrize("block_bytes", [1 << 20, 500])
def test_against_brute_force(spark, block_bytes):
    rows = clustered(600, 12, 1)
    assert found(spark, rows, every=50, block_bytes=block_bytes) == brute(rows, every=50)


def test_other_numbers(spark):
    rows = clustered(200, 5, 2, labels=2)
    assert found(spark, rows, every=20, positives=2, negatives=3, least=50, most=90, scale=64) == brute(rows, every=20, positives=2, negatives=3, least=50, most=90, scale=64)


def test_ties_copies_and_a_common_vector(spark):
    r = random.Random(4)
    common = [0.5, -0.25, 0.125]
    rows = [(i, common if r.random() < 0.6 else [r.choice((0.0, 0.5, -0.5)) for _ in range(3)], r.randint(0, 2)) for i in range(300)]
    assert found(spark, rows, every=25, block_bytes=700) == brute(rows, every=25)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, nan], 1), (2, [inf, 0.0], 1), (3, None, 1), (4, [1.0, None], 1), (5, [1.0, 0.5], None), (6, [0.5, 0.5], 1), (7, [0.5, 0.25], 2), (100, [nan, 1.0], 1), (None, [0.5, 0.5], 2), (None, [0.75, 0.5], 1), (200, [], 1), (8, [0.25], 2), (300, [0.0, 0.0], 2)]
    assert found(spark, rows) == brute(rows)


def test_negative_scores_have_no_negatives(spark):
    rows = [(0, [1.0], 1), (1, [-0.5], 1), (2, [-0.45], 2), (3, [-0.5], 2)]
    assert found(spark, rows) == brute(rows) == []


def test_empty_tables_and_extra_columns(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert ng.mine(df, F.col("vec_id") % 100 == 0).collect() == []
    none = spark.createDataFrame([(1, [0.5], 1), (2, [0.5], 2)], SCHEMA)
    assert ng.mine(none, F.col("vec_id") % 100 == 0).collect() == []
    rows = clustered(120, 4, 3)
    named = spark.createDataFrame(rows, SCHEMA)
    for c in ("row", "id", "anchor", "block", "vector", "span", "score", "place"):
        named = named.withColumn(c, F.lit("x"))
    assert sorted(str(tuple(r)) for r in ng.mine(named, F.col("vec_id") % 100 == 0).collect()) == brute(rows)


def test_large_components_stay_exact(spark):
    r = random.Random(6)
    rows = [(i, [float(r.randint(-(2**20), 2**20)) for _ in range(3)], i % 2) for i in range(60)]
    assert found(spark, rows, every=10) == brute(rows, every=10)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([3, 300, 2**24, 2**29]))
def test_intervals_lose_no_pair(seed, size):
    r = np.random.default_rng(seed)
    q, x = r.integers(-size, size + 1, (4, 6)), r.integers(-size, size + 1, (50, 6))
    true = q.astype(object) @ x.T.astype(object)
    least, most = np.sort(r.choice(true.ravel(), (4, 2)).astype(np.int64), axis=1).T
    anchors = ng.Anchors(np.arange(4), np.zeros(4, int), q, least[:, None], most[:, None])
    rows = ng.Rows(np.arange(50), np.zeros((2, 50), int), np.zeros(50, int), x)
    a, b, score = ng.scores(anchors, rows, np.ones((4, 50), bool), least, most)
    assert sorted(zip(a, b, score, strict=True)) == [(i, j, true[i, j]) for i in range(4) for j in range(50) if least[i] <= true[i, j] <= most[i]]
    a, b, score = ng.scores(anchors, rows, np.ones((4, 50), bool), least, most, keep=3)
    for i in range(4):
        want = sorted((true[i, j] for j in range(50) if least[i] <= true[i, j] <= most[i]), reverse=True)[:3]
        if want and max(true[i]) <= most[i]:
            assert sorted(score[a == i].tolist(), reverse=True)[: len(want)] == want


def test_pairs_are_dropped_before_the_last_plane(monkeypatch):
    """Most pairs never get their lower planes."""
    rows = clustered(2000, 64, 7, labels=3)
    x = np.floor(np.array([v for _, v, _ in rows]) * 256).astype(np.int64)
    worked = []
    plain = np.einsum
    monkeypatch.setattr(np, "einsum", lambda form, a, b: worked.append(len(a)) or plain(form, a, b))
    anchors = ng.Anchors(np.arange(20), np.zeros(20, int), x[:20], np.full((20, 1), -ng.FAR), np.full((20, 1), ng.FAR))
    best = ng.search(anchors, iter([ng.Rows(np.arange(2000), np.zeros((2, 2000), int), np.zeros(2000, int), x)]), 5, True)
    assert len(best.score) == 100
    assert sum(worked) < 20 * 2000


def test_matrix_of_uneven_rows():
    assert ng.matrix(pa.array([[1, 2], [], [3]], pa.list_(pa.int64()))).tolist() == [[1, 2], [0, 0], [3, 0]]


def test_query(spark, tiny):
    assert_same(ng.op12_negatives(spark, tiny).toPandas(), connection(tiny).sql(ng.OP12_SQL).df())
