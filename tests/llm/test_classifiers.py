from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossierlake.llm import quality, toxicity
from dossierlake.llm._bytes import BLANK, LOWER, NOT_ALNUM, Words
from tests.llm.conftest import prose, whole


def slices(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])


@pytest.fixture(scope="module")
def rated():
    r = random.Random(6)
    rows = []
    for i in range(400):
        text, grade = prose(r, r.randint(5, 60)), 2
        if i % 4 == 0:
            text, grade = " ".join(f"{w}{r.choice(('%%%', '$$$', '!!'))}" for w in text.split(" ")), 0
        elif i % 4 == 1:
            text, grade = text + " " + "%%% " * 3 + text, 1
        rows.append((i, text, grade))
    return rows


def test_ordinal_regression(rated):
    x = quality.features(*slices([t for _, t, _ in rated]))
    y = np.array([g for *_, g in rated])
    model = quality.fit(x[:300], y[:300])
    assert (np.diff(model.thresholds) > 0).all() and list(model.grades) == [0, 1, 2]
    above = model.above(x[300:])
    assert (np.diff(above, axis=1) <= 1e-12).all()  # P(grade > k) falls with k
    assert np.abs(model.expected(above) - y[300:]).mean() < 0.35
    assert ((model.tail(above, 2) >= 0.5) == (y[300:] == 2)).mean() > 0.9


def test_gradient_of_the_likelihood_is_right(rated):
    """Training lowers the loss that the probabilities define."""
    x = quality.features(*slices([t for _, t, _ in rated[:200]]))
    y = np.array([g for *_, g in rated[:200]])

    def loss(m):
        edges = np.concatenate([np.ones((len(y), 1)), m.above(x), np.zeros((len(y), 1))], 1)
        return -np.log(np.maximum(edges[np.arange(len(y)), y] - edges[np.arange(len(y)), y + 1], 1e-9)).mean()

    assert loss(quality.fit(x, y, steps=200)) < loss(quality.fit(x, y, steps=20)) < loss(quality.fit(x, y, steps=1))


def test_quality_of_a_table(spark, rated, strange, empty):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rated], "doc_id long, text string")
    labels = spark.createDataFrame([*((i, g) for i, _, g in rated if i < 300), (5, None), (None, 1), (999_999, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels, sample_rows=250)
    out = {r["doc_id"]: r for r in quality.score(docs, model, accept=2).collect()}
    held = [(i, g) for i, _, g in rated if i >= 300]
    assert np.mean([out[i]["selected"] == (g == 2) for i, g in held]) > 0.9
    found = quality.score(strange, model)
    assert found.columns == [*strange.columns, "expected_grade", "tail_probability", "selected"] and found.count() == strange.count()
    assert found.where("tail_probability IS NULL OR isnan(tail_probability)").isEmpty()
    assert quality.score(empty, model).collect() == []


def test_likelihood_equals_plain_sums(rated):
    """Probabilities of grades, written out from weights and thresholds, and the loss that training minimises."""
    texts, y = [t for _, t, _ in rated[:60]], [g for *_, g in rated[:60]]
    x = quality.features(*slices(texts))
    model = quality.fit(x, np.array(y), penalty=0.0, steps=1500, rate=0.02)
    total = 0.0
    for row, grade, above in zip(x.astype(float), y, model.above(x), strict=True):
        score = sum(a * b for a, b in zip(row.tolist(), model.weights.astype(float).tolist(), strict=True))
        below = [1 / (1 + math.exp(score - t)) for t in model.thresholds.tolist()]
        p = [b - a for a, b in zip([0.0, *below], [*below, 1.0], strict=True)]
        assert abs(sum(p) - 1) < 1e-9 and all(abs(1 - b - a) < 1e-4 for a, b in zip(above, below, strict=True))
        assert abs(sum(k * q for k, q in enumerate(p)) - model.expected(above[None])[0]) < 1e-3
        assert abs(sum(p[1:]) - model.tail(above[None], 1)[0]) < 1e-4 and abs(p[2] - model.tail(above[None], 2)[0]) < 1e-4
        total -= math.log(max(p[grade], 1e-12))
    assert total / len(y) < 0.3  # separable without a penalty, so far below that of the shares alone, 1.04


def test_clashing_columns(spark, clashing, rated):
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(61)], "doc_id long, quality int")
    model = quality.train(clashing, labels)
    left = quality.keep_selected(clashing, model)
    assert whole(left, clashing)
    assert {r["doc_id"] for r in left.collect()} == {r["doc_id"] for r in quality.score(clashing.select("doc_id", "text"), model).where("selected").collect()}


def test_rows_that_share_an_id_take_the_smallest_text(spark):
    rows = [(1, "b bad %%%"), (1, "a good text of words"), (2, "%%% zz"), (3, "good words here")]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    twice = quality.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    once = quality.train(spark.createDataFrame([x for x in rows if x[1] != "b bad %%%"], "doc_id long, text string"), labels)
    assert (twice.weights == once.weights).all()


def test_one_grade_and_no_rows(spark, empty):
    none = quality.train(empty, spark.createDataFrame([], "doc_id long, quality int"))
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert quality.score(docs, none, accept=0).first()["selected"]


def test_query_accuracy(spark):
    at = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    got = {r["doc_id"]: r["selected"] for r in quality.op8_quality(spark, at).collect()}
    assert np.mean([got[i] == bool(q) for i, q in labels.items()]) > 0.97


# Toxicity
@pytest.fixture(scope="module")
def insults():
    r = random.Random(2)
    rows = []
    for i in range(700):
        words = prose(r, r.randint(3, 90)).split(" ")
        toxic = i % 3 == 0
        if toxic:
            for _ in range(r.randint(1, 3)):
                words.insert(r.randrange(len(words)), r.choice(("idiot", "scum", "vequ" + r.choice(("ta", "mo", "ille", "oir")))))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def auc(score, y):
    a, b = score[y == 1], score[y == 0]
    return (a[:, None] > b[None]).mean() + 0.5 * (a[:, None] == b[None]).mean()


def test_gradients():
    r = np.random.default_rng(0)
    data, offsets = slices(["the scum an ou", "sti ba", "one"])
    words = Words(data, offsets, NOT_ALNUM, LOWER)
    v = toxicity.vocabulary(words)
    _, start, size = toxicity.windows(words.first)
    net = toxicity.Network.new(3)
    net.p = {k: a.astype(np.float64) for k, a in net.p.items()}
    goal = np.array([1.0, 0.0, 1.0])

    def loss():
        z = net.forward(net.inputs(v), v.place, start, size)
        return (np.log1p(np.exp(z)) - goal * z).sum()

    x = net.inputs(v)
    z, kept = net.forward(x, v.place, start, size, keep=True)
    g, d_x = net.backward(1 / (1 + np.exp(-z)) - goal, x, kept)
    g |= net.embedding_gradients(d_x, v)
    for k, a in net.p.items():
        flat = a.reshape(-1)
        touched = np.flatnonzero(g[k].reshape(-1)) if k in ("word", "gram") else np.arange(flat.size)
        for i in r.choice(touched, min(4, len(touched)), replace=False):
            before = flat[i]
            flat[i] = before + 1e-3
            up = loss()
            flat[i] = before - 1e-3
            down = loss()
            flat[i] = before
            assert abs((up - down) / 2e-3 - g[k].reshape(-1)[i]) < 2e-3, k


def test_forward_pass_equals_plain_loops(insults):
    """The network written out for one window at a time, with Python numbers."""
    net = toxicity.Network.new(5)
    data, offsets = slices([t for _, t, _ in insults[:12]])
    words = Words(data, offsets, NOT_ALNUM, LOWER)
    v = toxicity.vocabulary(words)
    _, start, size = toxicity.windows(words.first)
    fast = net.forward(net.inputs(v), v.place, start, size)
    p, h = {k: a.astype(float).tolist() for k, a in net.p.items()}, toxicity.HIDDEN
    sig = lambda z: 1 / (1 + math.exp(-z))
    dot = lambda x, m: [sum(a * b for a, b in zip(x, column, strict=True)) for column in zip(*m, strict=True)]

    def vector(word):
        grams = v.grams[v.first[word] : v.first[word + 1]].tolist()
        pooled = [sum(p["gram"][g][i] for g in grams) / math.sqrt(len(grams)) for i in range(toxicity.EMBED)]
        return [a + b for a, b in zip(p["word"][int(v.word[word])], pooled, strict=True)]

    for k in range(0, len(start), 3):
        inputs = [vector(int(x)) for x in v.place[start[k] : start[k] + size[k]]]
        states = [[0.0] * (2 * h) for _ in inputs]
        for layer in (0, 1):
            s = [0.0] * h
            for t in range(len(inputs)) if layer == 0 else reversed(range(len(inputs))):
                g = [a + b for a, b in zip(dot(inputs[t], p["w"]), p["b"], strict=True)][3 * h * layer : 3 * h * (layer + 1)]
                su = dot(s, p[f"u{layer}"])
                z, r = [sig(a + b) for a, b in zip(g[:h], su[:h], strict=True)], [sig(a + b) for a, b in zip(g[h : 2 * h], su[h : 2 * h], strict=True)]
                n = [math.tanh(a + x * b) for a, x, b in zip(g[2 * h :], r, su[2 * h :], strict=True)]
                s = [a + x * (b - a) for a, x, b in zip(n, z, s, strict=True)]
                states[t][h * layer : h * (layer + 1)] = s
        e = [sum(math.tanh(a + b) * c for a, b, c in zip(dot(x, p["a"]), p["c"], p["v"], strict=True)) for x in states]
        weight = [math.exp(x) for x in e]
        pool = [sum(a * x[i] for a, x in zip(weight, states, strict=True)) / sum(weight) for i in range(2 * h)]
        assert abs(sum(a * b for a, b in zip(pool, p["o"], strict=True)) + p["bias"][0] - fast[k]) < 1e-4


def test_toxicity_query(spark, tiny):
    """Every document once, held out by its id, scored within 0 and 1; labels of held-out rows don't matter."""
    docs = {r["doc_id"] for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id").collect()}
    rows = toxicity.op6_toxicity(spark, tiny).collect()
    assert [r.asDict().keys() for r in rows[:1]] == [{"doc_id", "held_out", "score", "predicted"}] and {r["doc_id"] for r in rows} == docs and len(rows) == len(docs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    labels = spark.read.parquet(f"{tiny}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    table = spark.read.parquet(f"{tiny}/documents.parquet")
    again = {r["doc_id"]: r["score"] for r in toxicity.score(table, toxicity.train(table, turned)).collect()}
    assert all(again[r["doc_id"]] == r["score"] for r in rows)


def test_held_out_accuracy(insults):
    y = np.array([t for *_, t in insults])
    net = toxicity.fit([t for _, t, _ in insults[:500]], y[:500], 0.33)
    score = net.probability(net.highest(*slices([t for _, t, _ in insults[500:]])))
    assert auc(score, y[500:]) > 0.93
    assert ((score >= 0.3) == y[500:]).mean() > 0.85


def test_all_windows_are_scored(insults):
    """An insult is found wherever in a long text it stands, also across the ends of windows."""
    y = np.array([t for *_, t in insults])
    net = toxicity.fit([t for _, t, _ in insults[:400]], y[:400], 0.33)
    clean = " ".join(t for _, t, k in insults if not k).split(" ")[:500]
    base = net.highest(*slices([" ".join(clean)]))[0]
    for at in (0, 23, 24, 31, 32, 250, 499, 500):
        words = clean[:at] + ["scum", "idiot"] + clean[at:]
        assert net.highest(*slices([" ".join(words)]))[0] > base


def test_windows_cover_every_word():
    first = np.array([0, 0, 1, 33, 65, 200])
    text, start, size = toxicity.windows(first)
    seen = np.zeros(200, int)
    for s, n in zip(start, size, strict=True):
        seen[s : s + n] += 1
    assert (seen > 0).all() and set(text.tolist()) == {1, 2, 3, 4} and size.max() <= toxicity.LENGTH


def test_toxicity_of_a_table(spark, insults, strange, empty):
    docs = spark.createDataFrame([(i, t) for i, t, _ in insults], "doc_id long, text string")
    labels = spark.createDataFrame([*((i, k) for i, _, k in insults), (None, 1), (7, None)], "doc_id long, toxic int")
    net = toxicity.train(docs, labels, sample_rows=150)
    out = toxicity.score(docs, net).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    other = labels.selectExpr("doc_id", "if(pmod(crc32(cast(cast(doc_id AS string) AS binary)), 4) = 2, 1 - toxic, toxic) AS toxic")
    again = toxicity.train(docs, other, sample_rows=150)
    assert all((net.p[k] == again.p[k]).all() for k in net.p)  # held-out labels change nothing
    assert toxicity.score(strange, net).count() == strange.count()
    assert toxicity.score(strange, net).where("score IS NULL OR isnan(score)").isEmpty()
    assert toxicity.score(empty, net).collect() == []


def test_words_of_bytes():
    data, offsets = slices(["a  b\n", "", " c", "d"])
    w = Words(data, offsets, BLANK)
    assert [bytes(data[s:e]) for s, e in zip(w.start, w.end, strict=True)] == [b"a", b"b", b"c", b"d"] and w.counts.tolist() == [2, 0, 1, 1]


def glued(insults, at: int, word: str) -> str:
    """Clean words without blanks, with ``word`` after ``at`` bytes."""
    clean = "".join(t.replace(" ", "") for t, k in ((t, k) for _, t, k in insults) if not k).encode("ascii", "ignore").decode()[:600]
    return clean[:at] + word + clean[at:]


def test_an_insult_after_byte_64_of_one_word_is_read(insults):
    y = np.array([t for *_, t in insults])
    net = toxicity.fit([t for _, t, _ in insults], y, 0.33)
    for before in ("", "é" * 200):
        base = net.highest(*slices([before + glued(insults, 0, "")]))[0]
        for at in (64, 90, 96, 100, 300, 590):
            assert net.highest(*slices([before + glued(insults, at, "idiotscum")]))[0] > base + 0.1, (before, at)


def test_pieces_hold_all_bytes_of_long_words():
    texts = ["short", "x" * 64, "", "".join(map(chr, range(0x4E00, 0x4E00 + 100))) + " end", "y" * 65]
    data, offsets = slices(texts)
    w = toxicity.Pieces(data, offsets)
    assert w.counts.tolist() == [1, 1, 0, 147, 29]
    assert (w.end - w.start)[2] == 300 and (w.end - w.start)[3:148].max() == toxicity.PIECE and (w.end - w.start)[149] == 65
    whole = Words(data, offsets, NOT_ALNUM, LOWER)
    assert w.hash[[0, 1, 2, 148, 149]].tolist() == whole.hash.tolist()
    seen = np.zeros(len(data), bool)
    for s, e in zip(w.start, w.end, strict=True):
        seen[s:e] = True
    assert (seen | (data == 32)).all()
    v = toxicity.vocabulary(w)
    parts = [toxicity.vocabulary(w, a, a + 1) for a in range(len(w.start))]
    for k, p in enumerate(parts):
        own = v.grams[v.first[v.place[k]] : v.first[v.place[k] + 1]]
        assert (own == p.grams).all() and len(own) == sum(max(w.end[k] - w.start[k] + 3 - n, 0) for n in toxicity.GRAMS)


def test_long_texts_teach_by_the_windows_that_score_highest(spark, insults):
    y = np.array([t for *_, t in insults])
    net = toxicity.fit([t for _, t, _ in insults], y, 0.33)
    calm, bad = next(t for _, t, k in insults if not k), next(t for _, t, k in insults if k)
    text = (calm + " ") * 200 + "\n" + bad + "\n" + (calm + " ") * 200
    part = toxicity.telling_part(net, text.encode(), 2000)
    assert len(part.encode()) <= 2000 and net.highest(*slices([part]))[0] > net.highest(*slices([calm]))[0] + 0.1
    assert toxicity.telling_part(net, b" \n ", 100) == "" and 0 < len(toxicity.telling_part(net, b"x" * 5000, 100)) <= 100


def test_labelled_texts_beyond_the_bound_are_learned_from(spark, insults, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, y, share, real=toxicity.fit: seen.append(sorted(map(len, texts))) or real(texts, y, share))
    rows = [(i, t, k) for i, t, k in insults if i % 4 != 2][:60] + [(10_000 + i, (insults[i][1] + " ") * 60, insults[i][2]) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"), sample_bytes=600)
    assert len(seen) == 2 and len(seen[1]) > len(seen[0]) and max(seen[1]) <= 600 + 60


def test_phrases_of_half_a_window_are_seen_whole():
    first = np.array([0, 200, 233])
    _, start, size = toxicity.windows(first)
    for a, b in zip(first, first[1:], strict=False):
        for at in range(a, b - 16):
            assert ((start <= at) & (start + size >= at + 17)).any(), at
