"""Toxicity by a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

A word comes in as the sum of two inputs: an embedding of the whole word and the pooled embeddings of its
character n-grams, both hashed. A word of more than ``WHOLE`` bytes, as a text without blanks is, comes in like any
other and is followed by overlapping pieces, words of their own, that together hold all its bytes. Windows of
``LENGTH`` words overlap; a forward and a backward gated recurrent layer read each, attention pools their states, and a linear layer scores the pool. A text scores as its highest
window, over all windows of the whole text, and a logistic curve fitted on held-back training rows turns that
into a probability.

Labels are of texts, not of windows. Each epoch therefore scores all windows of the sample and learns from those
that decide: the highest window of a toxic text, and the highest and a random window of another. The first epoch
picks windows by how much likelier their n-grams are in toxic texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossierlake.llm._bytes import LOWER, NOT_ALNUM, U64, Words, hash_spans, mix, text_slices
from dossierlake.llm._scratch import Scratch

LENGTH, STRIDE = 32, 16
EMBED, HIDDEN, TABLE = 12, 8, 1 << 14
GRAMS = (3, 4, 5)
#: Bytes of the longest word without pieces; those of a longer word's pieces, and from one's beginning to the next.
WHOLE, PIECE, STEP = 64, 12, 2
#: Windows that are scored at once.
BLOCK = 4096


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Vocabulary:
    """The distinct words of a run of texts: word buckets, and n-gram buckets of all words in a row."""

    word: np.ndarray
    grams: np.ndarray
    first: np.ndarray  # of each word's n-grams
    place: np.ndarray  # distinct word of each word


class Pieces(Words):
    """The words of a run of texts; one of more than ``WHOLE`` bytes is followed by overlapping pieces that are words of their own.

    Pieces are as short as a word, as an insult among the pooled n-grams of a long one would weigh next to nothing.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        super().__init__(data, offsets, NOT_ALNUM, LOWER)
        size, whole = self.end - self.start, self.hash
        per = np.where(size > WHOLE, 1 - (PIECE - size) // STEP, 0)
        k = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        start = np.repeat(self.start, per) + k * STEP
        end = np.minimum(start + PIECE, np.repeat(self.end, per))
        before = np.cumsum(per) - per  # pieces of earlier words
        at = np.repeat(np.arange(len(size)) + 1, per) + np.arange(len(start))  # a piece comes after its own word
        word = np.arange(len(size)) + before

        def mixed(of_words: np.ndarray, of_pieces: np.ndarray) -> np.ndarray:
            out = np.empty(len(size) + len(start), of_words.dtype)
            out[word], out[at] = of_words, of_pieces
            return out

        total = np.concatenate([word, [len(size) + len(start)]])
        self._hash = mixed(whole, hash_spans(self.data, start, end))
        self.start, self.end = mixed(self.start, start), mixed(self.end, end)
        self.first = total[self.first]


def vocabulary(words: Words, lo: int = 0, hi: int | None = None) -> Vocabulary:
    """Of the words from ``lo`` to ``hi``, all by default; n-grams are of all bytes of a word."""
    found, at, place = np.unique(words.hash[lo:hi], return_index=True, return_inverse=True)
    at = at + lo
    start, size = words.start[at], words.end[at] - words.start[at]
    per = np.stack([np.maximum(size + 3 - n, 0) for n in GRAMS])
    first = np.concatenate([[0], np.cumsum(per.sum(0))])
    grams = np.empty(first[-1], np.uint16)
    # Each word between marks of its beginning and end; words are taken some bytes at a time.
    total = np.concatenate([[0], np.cumsum(size + 2)])
    a = 0
    while a < len(found):
        b = max(a + 1, int(np.searchsorted(total, total[a] + (1 << 18), side="right")) - 1)
        own = size[a:b]
        owner = np.repeat(np.arange(b - a, dtype=np.int32), own + 2)
        inner = (np.arange(total[a], total[b]) - total[a:b][owner]).astype(np.int32)
        data = np.where(inner == 0, 1, 2).astype(np.uint8)
        letter = (inner > 0) & (inner <= own[owner])
        data[letter] = words.data[start[a:b][owner[letter]] + inner[letter] - 1]
        for k, n in enumerate(GRAMS):
            before = first[a:b] + per[:k, a:b].sum(0)
            count = max(0, len(data) - n + 1)
            code = np.full(count, n, U64)
            for j in range(n):
                code = (code << U64(8)) | data[j : j + count]
            whole = np.flatnonzero(owner[:count] == owner[n - 1 :])
            grams[before[owner[whole]] + inner[whole]] = (mix(code[whole]) % U64(TABLE)).astype(np.uint16)
        a = b
    return Vocabulary((mix(found) % U64(TABLE)).astype(np.int32), grams, first, place.astype(np.int32))


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and number of words of all overlapping windows."""
    counts = np.diff(first)
    per = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - LENGTH) // STRIDE)), 0)
    text = np.repeat(np.arange(len(counts)), per)
    k = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    start = first[:-1][text] + k * STRIDE
    return text, start, np.minimum(LENGTH, first[1:][text] - start)


@dataclass
class Network:
    """All parameters. Gates lie side by side: update, reset, candidate; layer 0 reads forward, layer 1 backward."""

    p: dict[str, np.ndarray] = field(default_factory=dict)
    curve: tuple[float, float] = (1.0, 0.0)

    @staticmethod
    def new(seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        h, e = HIDDEN, EMBED
        shapes = {"word": (TABLE, e), "gram": (TABLE, e), "w": (e, 6 * h), "u0": (h, 3 * h), "u1": (h, 3 * h), "a": (2 * h, 2 * h), "v": (2 * h,), "o": (2 * h,)}
        scale = {"word": 0.1, "gram": 0.1, "w": 0.4, "u0": 0.3, "u1": 0.3, "a": 0.3, "v": 0.3, "o": 0.3}
        p = {k: (r.normal(size=s) * scale[k]).astype(np.float32) for k, s in shapes.items()}
        p |= {"b": np.zeros(6 * h, np.float32), "c": np.zeros(2 * h, np.float32), "bias": np.zeros(1, np.float32)}
        return Network(p)

    def inputs(self, v: Vocabulary) -> np.ndarray:
        """The input of each distinct word."""
        n = np.diff(v.first)
        pooled = np.empty((len(n), EMBED), np.float32)
        for a in range(0, len(n), 1 << 14):  # every word has an n-gram, as its marks count
            b = min(len(n), a + (1 << 14))
            pooled[a:b] = np.add.reduceat(self.p["gram"][v.grams[v.first[a] : v.first[b]]], v.first[a:b] - v.first[a], axis=0)
        return self.p["word"][v.word] + pooled / np.sqrt(np.maximum(n, 1))[:, None].astype(np.float32)

    def forward(self, x: np.ndarray, place: np.ndarray, start: np.ndarray, size: np.ndarray, keep: bool = False):
        """Logit of each window; x are inputs of distinct words and ``place`` the distinct word of each word."""
        p, h = self.p, HIDDEN
        gates = np.concatenate([x @ p["w"] + p["b"], np.zeros((1, 6 * h), np.float32)])
        steps = int(size.max()) if len(size) else 0
        idx = np.full((steps, len(start)), len(x), np.int64)
        for t in range(steps):
            there = size > t
            idx[t, there] = place[start[there] + t]
        mask = np.arange(steps)[:, None] < size[None, :]
        states = np.zeros((steps, len(start), 2 * h), np.float32)
        trace: dict = {}
        for layer in (0, 1):
            u = p[f"u{layer}"]
            own = slice(3 * h * layer, 3 * h * (layer + 1))
            s = np.zeros((len(start), h), np.float32)
            mine = np.ascontiguousarray(gates[:, own])
            for t in range(steps) if layer == 0 else range(steps - 1, -1, -1):
                g = mine[idx[t]]
                su = s @ u
                zr = _sigmoid(g[:, : 2 * h] + su[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                n = np.tanh(g[:, 2 * h :] + r * su[:, 2 * h :])
                new = n + z * (s - n)
                if keep:
                    trace[layer, t] = (s, z, r, n, su[:, 2 * h :])
                s = np.where(mask[t][:, None], new, s)
                states[t, :, h * layer : h * (layer + 1)] = s
        q = np.tanh(states @ p["a"] + p["c"])
        e = np.where(mask, q @ p["v"], -1e9)
        e = np.exp(e - e.max(0, initial=-1e9))
        alpha = e / np.maximum(e.sum(0), 1e-9)
        pool = np.einsum("tb,tbh->bh", alpha, states, optimize=True)
        logit = pool @ p["o"] + p["bias"]
        return (logit, (idx, mask, states, trace, q, alpha, pool)) if keep else logit

    def backward(self, d: np.ndarray, x: np.ndarray, kept) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the layers and of the distinct words' inputs, from those of the logits."""
        idx, mask, states, trace, q, alpha, pool = kept
        p, h = self.p, HIDDEN
        g = {"o": pool.T @ d, "bias": np.array([d.sum()], np.float32)}
        d_pool = d[:, None] * p["o"]
        d_alpha = np.einsum("bh,tbh->tb", d_pool, states, optimize=True)
        d_states = alpha[:, :, None] * d_pool[None]
        d_e = alpha * (d_alpha - (alpha * d_alpha).sum(0))
        g["v"] = np.einsum("tb,tbk->k", d_e, q, optimize=True)
        d_q = d_e[:, :, None] * p["v"] * (1 - q * q)
        g["c"] = d_q.sum((0, 1))
        g["a"] = np.einsum("tbh,tbk->hk", states, d_q, optimize=True)
        d_states += d_q @ p["a"].T
        d_gates = np.zeros((len(x) + 1, 6 * h), np.float32)
        steps = len(idx)
        for layer in (0, 1):
            u = p[f"u{layer}"]
            g_u = np.zeros_like(u)
            d_s = np.zeros((idx.shape[1], h), np.float32)
            every = np.zeros((steps, idx.shape[1], 3 * h), np.float32)
            for t in range(steps - 1, -1, -1) if layer == 0 else range(steps):
                s, z, r, n, su_n = trace[layer, t]
                d_s = d_s + d_states[t, :, h * layer : h * (layer + 1)]
                d_new = d_s * mask[t][:, None]
                dn = d_new * (1 - z) * (1 - n * n)
                dz = d_new * (s - n) * z * (1 - z)
                dr = dn * su_n * r * (1 - r)
                d_su = np.concatenate([dz, dr, dn * r], 1)
                g_u += s.T @ d_su
                d_s = d_s - d_new + d_new * z + d_su @ u.T
                every[t] = np.concatenate([dz, dr, dn], 1)
            g[f"u{layer}"] = g_u
            flat, order = every.reshape(-1, 3 * h), np.argsort(idx.ravel(), kind="stable")
            ids = idx.ravel()[order]
            cut = np.flatnonzero(np.diff(ids, prepend=-1))
            d_gates[ids[cut], 3 * h * layer : 3 * h * (layer + 1)] = np.add.reduceat(flat[order], cut, axis=0)
        d_gates = d_gates[:-1]
        g["w"], g["b"] = x.T @ d_gates, d_gates.sum(0)
        return g, d_gates @ p["w"].T

    def embedding_gradients(self, d_x: np.ndarray, v: Vocabulary) -> dict[str, np.ndarray]:
        n = np.diff(v.first)
        spread = np.repeat(d_x / np.sqrt(np.maximum(n, 1))[:, None].astype(np.float32), n, axis=0)
        word, gram = np.zeros_like(self.p["word"]), np.zeros_like(self.p["gram"])
        for k in range(EMBED):
            word[:, k] = np.bincount(v.word, d_x[:, k], TABLE)
            gram[:, k] = np.bincount(v.grams, spread[:, k], TABLE)
        return {"word": word, "gram": gram}

    def highest(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The highest logit of each text's windows; a text without words has that of an empty pool."""
        words = Pieces(data, offsets)
        text, start, size = windows(words.first)
        out = np.full(len(offsets) - 1, -np.inf, np.float32)
        for a in range(0, len(text), BLOCK):
            own = slice(a, a + BLOCK)
            lo = int(start[a])
            v = vocabulary(words, lo, int((start[own] + size[own]).max()))
            np.maximum.at(out, text[own], self.forward(self.inputs(v), v.place, start[own] - lo, size[own]))
        out[words.counts == 0] = min(float(self.p["bias"][0]), float(out[np.isfinite(out)].min(initial=0)))
        return out

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * logit.astype(float) + self.curve[1], -30, 30)))


def _first_choice(v: Vocabulary, text: np.ndarray, first: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A weight of each distinct word: its most telling n-gram, by log odds of the texts that hold it."""
    n = np.diff(v.first)
    counts = np.zeros((2, TABLE))
    pairs = np.unique(np.repeat(np.arange(len(first) - 1), np.diff(first)) * len(n) + v.place)
    text, place = pairs // len(n), pairs % len(n)
    blocks = [(a, min(len(n), a + (1 << 14))) for a in range(0, len(n), 1 << 14)]
    for kind in (0, 1):
        times = np.bincount(place[y[text] == kind], minlength=len(n))
        for a, b in blocks:
            counts[kind] += np.bincount(v.grams[v.first[a] : v.first[b]], np.repeat(times[a:b], n[a:b]), TABLE)
    odds = np.log((counts[1] + 0.5) / (y.sum() + 1)) - np.log((counts[0] + 0.5) / ((1 - y).sum() + 1))
    out = np.empty(len(n))
    for a, b in blocks:  # every word has an n-gram
        out[a:b] = np.maximum.reduceat(odds[v.grams[v.first[a] : v.first[b]]], v.first[a:b] - v.first[a])
    return out


def fit(texts: list[str], y: np.ndarray, share: float, epochs: int = 12, batch: int = 256, seed: int = 7) -> Network:
    """Trains on four fifths of the texts; the rest fixes the curve. ``share`` is the true share of toxic texts."""
    net = Network.new(seed)
    y = np.asarray(y, np.int64)
    if len(set(y.tolist())) < 2:
        base = float(np.clip(y.mean() if len(y) else 0.0, 0.01, 0.99))
        net.curve = (0.0, float(np.log(base / (1 - base))))
        return net
    joined = pa.array(texts, pa.large_string())
    (_, _, data, offsets), = text_slices(joined, 1 << 62)
    words = Pieces(data, offsets)
    v = vocabulary(words)
    text, start, size = windows(words.first)
    rng = np.random.default_rng(seed)
    held = rng.random(len(y)) < 0.2
    usable = ~held[text]
    moments = {k: [np.zeros_like(a), np.zeros_like(a)] for k, a in net.p.items()}
    step = 0
    bounds = np.searchsorted(text, np.arange(len(y) + 1))
    weight = _first_choice(v, text, words.first, np.where(held, 0, y))[v.place]
    score = np.array([weight[a : a + n].max() for a, n in zip(start, size, strict=True)])
    for epoch in range(epochs):
        if epoch:
            x = net.inputs(v)
            score = np.concatenate([net.forward(x, v.place, start[a : a + BLOCK], size[a : a + BLOCK]) for a in range(0, len(start), BLOCK)])
        picks = []
        for i in range(len(y)):
            a, b = bounds[i], bounds[i + 1]
            if a == b or held[i]:
                continue
            top = a + int(np.argmax(score[a:b]))
            picks.append(top)
            if not y[i]:
                picks.append(a + int(rng.integers(b - a)))
        picks = rng.permutation(np.unique(picks))
        for a in range(0, len(picks), batch):
            own = picks[a : a + batch]
            own = own[usable[own]]
            used, place = np.unique(np.concatenate([v.place[s : s + n] for s, n in zip(start[own], size[own], strict=True)]), return_inverse=True)
            part = _part(v, used)
            starts = np.cumsum(size[own]) - size[own]
            x = net.inputs(part)
            logit, kept = net.forward(x, place, starts, size[own], keep=True)
            goal = y[text[own]]
            d = ((_sigmoid(logit) - goal) / len(own)).astype(np.float32)
            g, d_x = net.backward(d, x, kept)
            g |= net.embedding_gradients(d_x, part)
            step += 1
            for k, q in net.p.items():
                m, s = moments[k]
                m += 0.1 * (g[k] - m)
                s += 0.01 * (g[k] * g[k] - s)
                q -= (0.01 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    top = net.highest(data, offsets)
    _set_curve(net, top[held], y[held], share) if len(set(y[held].tolist())) == 2 else _set_curve(net, top, y, share)
    return net


def _part(v: Vocabulary, used: np.ndarray) -> Vocabulary:
    n = np.diff(v.first)[used]
    total = np.concatenate([[0], np.cumsum(n)])
    grams = v.grams[np.repeat(v.first[:-1][used], n) + np.arange(total[-1]) - np.repeat(total[:-1], n)]
    return Vocabulary(v.word[used], grams, total, np.zeros(0, np.int64))


def _set_curve(net: Network, logit: np.ndarray, y: np.ndarray, share: float) -> None:
    """A penalised logistic curve, rows weighted so that toxic ones have their true share."""
    w = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
    # Parted rows would drive the slope without end, so it is held near one, and steps are short.
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
        r = w * (p - y)
        s = w * p * (1 - p)
        g = np.array([(r * logit).sum() + 5 * (a - 1), r.sum() + 0.1 * b])
        hess = np.array([[(s * logit * logit).sum() + 5, (s * logit).sum()], [(s * logit).sum(), s.sum() + 0.1]])
        da, db = np.clip(np.linalg.solve(hess, g), -0.5, 0.5)
        a, b = min(max(a - da, 0.1), 3.0), b - db
    net.curve = (float(a), float(b))


def telling_part(net: Network, text: bytes, most: int) -> str:
    """Of a long text the windows that score highest, in the text's order, up to ``most`` bytes in all."""
    (_, _, data, offsets), = text_slices(pa.array([text.decode()], pa.large_string()), 1 << 62)
    words = Pieces(data, offsets)
    _, start, size = windows(words.first)
    if not len(start):
        return ""
    logits = []
    for a in range(0, len(start), BLOCK):
        own = slice(a, a + BLOCK)
        lo = int(start[a])
        v = vocabulary(words, lo, int((start[own] + size[own]).max()))
        logits.append(net.forward(net.inputs(v), v.place, start[own] - lo, size[own]))
    taken, used = [], 0
    for w in np.argsort(-np.concatenate(logits), kind="stable"):
        low = int(words.start[start[w] : start[w] + size[w]].min())
        high = min(int(words.end[start[w] : start[w] + size[w]].max()), low + most)
        if used and used + high - low > most:
            break
        taken.append((low, high))
        used += high - low + 1
    return " ".join(text[low:high].decode(errors="replace") for low, high in sorted(taken))


def _telling_parts(long: DataFrame, net: Network, most: int) -> DataFrame:
    """(_id, _text, _label) of long texts, each read whole and cut down to its telling part."""
    shared = long.sparkSession.sparkContext.broadcast(net)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [telling_part(shared.value, x.as_py().encode(), most) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.string()), batch.column(2)], names=["_id", "_text", "_label"])

    return long.select("_id", "_text", "_label").mapInArrow(run, long.select("_id", "_text", "_label").schema)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text: str = "text", sample_rows: int = 2048, sample_bytes: int = 8192, scratch: Scratch | None = None) -> Network:
    """Fits on at most ``sample_rows`` rows of either label, those of the smallest hashes of their ids.

    Rows that ``held_out`` names are never learned from, nor are rows without id or label; of rows that share an id
    the smallest text is taken. The driver holds at most 2 * sample_rows * sample_bytes: where a text of the sample
    is longer, a network fitted on the others reads all its windows in its task, and those that score highest, up to
    ``sample_bytes``, are what the last fit has of it, with its label.
    """
    scratch = scratch or Scratch(docs.sparkSession, "toxicity")
    given = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(F.col(label).cast("int")).alias("_label"))
    totals = {r[0]: r[1] for r in given.where("_label IN (0, 1)").groupBy("_label").count().collect()}
    drawn = [given.where(f"_label = {k}").orderBy(F.xxhash64(id_col), id_col).limit(sample_rows) for k in (0, 1)]
    sample = F.broadcast(drawn[0].unionByName(drawn[1]).withColumnRenamed(id_col, "_id"))  # at most twice sample_rows rows
    there = docs.where(docs[text].isNotNull()).select(docs[id_col].alias("_id"), docs[text].alias("_text"))
    least = there.join(sample, "_id").groupBy("_id").agg(F.min(F.struct("_text", "_label")).alias("least"))
    sampled = scratch.keep(least.select("_id", "least.*"), "sample")
    short = sampled.where(F.octet_length("_text") <= sample_bytes).collect()
    share = totals.get(1, 0) / max(1, sum(totals.values()))

    def fitted(rows: list) -> Network:
        rows = sorted(rows, key=lambda r: (zlib.crc32(f"{r[0]}:".encode()), r[0]))
        return fit([r[1] for r in rows], np.array([r[2] for r in rows]), min(max(share, 0.001), 0.999))

    net, long = fitted(short), sampled.where(F.octet_length("_text") > sample_bytes)
    parts = _telling_parts(long, net, sample_bytes).collect()
    scratch.discard()
    return fitted(short + parts) if parts else net


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: id_col, held_out, score, predicted.

    All windows of every whole text are scored. A null text counts as empty and an empty text has a score too. A
    null id isn't held out; tied and repeated ids are rows of their own; an empty table gives an empty table;
    other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size
    schema = T.StructType([docs.schema[id_col], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.probability(shared.value.highest(data, offsets)) for _, _, data, offsets in text_slices(batch.column(2), 1 << 19)]
            found = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32))], names=schema.names)

    return docs.select(docs[id_col], held_out(id_col), docs[text]).mapInArrow(run, schema)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of ``documents``, learned from ``labels.toxic``."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, train(docs, labels))
