from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from dossierlake.llm import minhash
from dossierlake.llm._bytes import mix
from tests.llm.conftest import prose, whole

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def bag(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])


def similar(a, b):
    inter = sum((a & b).values())
    return 5 * inter >= 4 * (sum(a.values()) + sum(b.values()) - inter)


def brute(rows):
    bags = [bag(t) for _, t in rows]
    name = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if name[i] != name[j] and similar(bags[i], bags[j]):
                old, new = name[i], name[j]
                name = [new if x == old else x for x in name]
    least = {}
    for (i, _), n in zip(rows, name, strict=True):
        least[n] = min(least.get(n, i), i)
    return {i: least[n] for (i, _), n in zip(rows, name, strict=True)}


def classes(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: r["class_id"] for r in minhash.near_classes(docs, **options).collect()}


def test_classes(spark, corpus):
    assert classes(spark, corpus) == brute(corpus)


def test_bands_of_several_families(spark):
    """Families share so much that bands mix them; members within a family are linked by chains."""
    r = random.Random(4)
    base = prose(r, 120).split(" ")
    rows = []
    for family in range(6):
        head = prose(r, 14).split(" ")
        words = head + base
        for k in range(6):
            words = list(words)
            words[20 + 15 * k] = f"f{family}k{k}"
            rows.append((family * 10 + k, " ".join(words)))
    assert classes(spark, rows, small=2, block=4) == brute(rows)


def test_signatures_estimate_weighted_jaccard():
    r = np.random.default_rng(1)
    h = mix(np.arange(1, 61, dtype=np.uint64))
    a, b = r.integers(0, 40, 60), r.integers(0, 40, 60)
    text = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
    sig = minhash.signatures(text, np.concatenate([h[a > 0], h[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, slots=8192)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - true) < 4 * np.sqrt(true * (1 - true) / 8192)


def test_a_signature_depends_on_its_text_alone():
    h = mix(np.arange(1, 400, dtype=np.uint64))
    alone = minhash.signatures(np.zeros(5, int), h[:5], np.array([1, 2, 3, 100, 7]), 1)
    text = np.concatenate([np.zeros(5, int), np.ones(300, int)])
    both = minhash.signatures(text, np.concatenate([h[:5], h[50:350]]), np.concatenate([[1, 2, 3, 100, 7], np.ones(300, int)]), 2)
    assert (alone[0] == both[0]).all()


def test_strange_rows(spark, strange, empty):
    got = minhash.near_classes(strange).collect()
    assert len(got) == strange.count()
    by = {r["doc_id"]: r["class_id"] for r in got}
    assert by[1] == by[2] == by[3] == 1 and by[4] == by[5] == 4 and by[8] == 8
    left = minhash.drop_near_duplicates(strange)
    assert left.columns == strange.columns
    assert sorted(r["doc_id"] for r in left.collect() if r["doc_id"] is not None) == [1, 4, 6, 7, 8, 9, 9, 10]
    assert minhash.near_classes(empty).collect() == [] and minhash.drop_near_duplicates(empty).collect() == []


def test_clashing_columns(clashing, corpus):
    left = minhash.drop_near_duplicates(clashing)
    assert whole(left, clashing) and sorted(r["doc_id"] for r in left.collect()) == sorted(set(brute(corpus).values()))


def test_common_features_are_counted_exactly():
    r = np.random.default_rng(3)
    bags_ = [r.choice(5000, int(n), replace=False).astype(np.uint64) for n in r.integers(1, 4000, 20)]
    found = minhash._common([mix(x).tobytes() for x in bags_])
    assert all(found[i, j] == len(np.intersect1d(bags_[i], bags_[j])) for i in range(20) for j in range(20) if i != j)


def test_long_texts(spark):
    r = random.Random(6)
    long = prose(r, 60_000).split(" ")
    near, far = list(long), list(long)
    near[::100] = ["changed"] * len(near[::100])
    far[::10] = ["changed"] * len(far[::10])
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(far)), (4, "x" * 300_000)]
    assert classes(spark, rows) == {1: 1, 2: 1, 3: 3, 4: 4}


def test_query(spark, tiny):
    """The query on its small table against all pairs."""
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    size = Counter(want.values())
    assert {r["doc_id"]: (r["class_id"], r["class_size"]) for r in minhash.op7_minhash(spark, tiny).collect()} == {i: (c, size[c]) for i, c in want.items()}


def test_components(spark, tmp_path):
    from dossierlake.llm._scratch import Scratch

    r = random.Random(2)
    edges = [(f"{a:03d}".encode(), f"{b:03d}".encode()) for a, b in [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(40)]]
    found = {bytes(x["bag"]): bytes(x["component"]) for x in minhash.components(Scratch(spark, "t"), spark.createDataFrame(edges, "a binary, b binary"), "c").collect()}
    assert found[b"040"] == b"000" and found[b"102"] == b"100"
    name = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            name[a] = name[b] = min(name[a], name[b])
    assert all(found.get(x, x) == n for x, n in name.items())


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6])
def test_short_texts(n):
    from dossierlake.llm._bytes import LOWER, NOT_ALNUM, Words

    raw = " ".join(["w"] * n).encode()
    t, _ = minhash.shingles(Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), NOT_ALNUM, LOWER))
    assert len(t) == max(1, n - 4)
