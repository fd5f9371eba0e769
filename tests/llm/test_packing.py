from __future__ import annotations

import random
import zlib
from itertools import pairwise

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from dossierlake.llm import packing
from dossierlake.llm._tokenizer import load

NAME = "word_bpe_49k.json"


def library(text):
    return [*load(NAME).encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, out, capacity):
    pieces = {}
    for r in out:
        pieces.setdefault(r["doc_id"], []).append(r)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    for i, group in texts.items():
        want = sorted((k // capacity, k, len(x[k : k + capacity]), zlib.crc32(np.asarray(x[k : k + capacity], "<u4").tobytes())) for x in map(library, group) for k in range(0, len(x), capacity))
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces[i]) == want
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins)


def test_pieces_and_places(spark, documents, corpus):
    out = packing.pack(documents, capacity=256, shard_pieces=50).collect()
    total = sum(len(library(t)) for _, t in corpus)
    assert check(corpus, out, 256) <= 1.1 * total / 256 + 4


def test_strange_rows(spark, strange, empty):
    rows = [(r[0], r[1]) for r in strange.select("doc_id", "text").collect()]
    check(rows, packing.pack(strange, capacity=64).collect(), 64)
    assert packing.pack(empty).collect() == []


def encoded(known, *texts):
    raw = [t.encode("utf-8", "replace") for t in texts]
    ids, first = known.texts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    return [ids[a:b].tolist() for a, b in pairwise(first.tolist())]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("abZÉé×÷ßÿ 1.,'<|\n\t%"), st.characters()), max_size=60), max_size=4))
def test_ids_equal_the_library(texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    assert encoded(packing._Encoded(NAME), *texts) == [library(t)[:-1] for t in texts]


def test_special_strings_and_contractions():
    known = packing._Encoded(NAME)
    for text in ("a<|endoftext|>b", "it's we'll DON'T 'sam", "x y ź Å", "3.14 %%% ###", "ΑΣ ΣΑΣ", "İx", "ÀÉ×É÷", "e\u0301 é", "a" * 500 + "!" * 90, "12ab34.-5"):
        assert encoded(known, text) == [library(text)[:-1]]
        assert encoded(known, text, "", text) == [library(text)[:-1], [], library(text)[:-1]]  # now remembered


def test_what_is_forgotten_and_hashes_that_meet(monkeypatch, corpus):
    """Ids don't depend on what is remembered, how much is encoded at once, or on hashes that meet."""
    texts = [t for _, t in corpus[:30]]
    want = [library(t)[:-1] for t in texts]
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    monkeypatch.setattr(packing, "AT_ONCE", 64)
    known = packing._Encoded(NAME)
    assert encoded(known, *texts) == want == encoded(known, *texts) and len(known.hash) <= 64 + 50
    spans = packing.hash_spans
    monkeypatch.setattr(packing, "hash_spans", lambda *a: spans(*a) % np.uint64(5))
    known = packing._Encoded(NAME)
    assert encoded(known, *texts) == want == encoded(known, *texts)


def test_very_long_text(spark):
    rows = [(1, "word " * 300_000), (2, "x" * 200_000), (3, None)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(rows, out, 4096)


def test_query(spark, tiny):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    out = packing.op4_packing(spark, tiny).collect()
    bins = check(rows, out, 4096)
    assert bins <= 1.02 * sum(r["length"] for r in out) / 4096 + 2


def brute_sum_of_squares(lengths, capacity):
    """The rule, tried out for every choice."""
    bins = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        s = lengths[i]
        cost = {}
        for gap in sorted({capacity} | {b for b in bins if b >= s}):
            left = [b for b in bins]
            if gap != capacity or gap in bins:
                left.remove(gap)
            left.append(gap - s)
            cost[gap if gap != capacity else capacity] = sum(left.count(g) ** 2 for g in set(left) if g)
        best = min(cost.values())
        gap = min((g for g, c in cost.items() if c == best))
        if gap in bins:
            bins.remove(gap)
        bins.append(gap - s)
    return len(bins)


def test_rule():
    r = random.Random(5)
    for _ in range(60):
        capacity = r.randint(4, 30)
        lengths = [r.randint(1, capacity) for _ in range(r.randint(1, 40))]
        sequence, offset = packing.sum_of_squares(np.array(lengths), capacity)
        assert len(set(sequence.tolist())) == brute_sum_of_squares(lengths, capacity)
        assert all(o + s <= capacity for o, s in zip(offset, lengths, strict=True))
