"""Quality by ordinal cumulative-link regression on hashed text.

One weight vector over hashed features of the text serves all grades; ordered thresholds cut its score:
P(grade <= k) = sigmoid(threshold[k] - w.x). The model is fitted in numpy on a bounded sample of rated rows and
gives every document its expected grade and the probability of reaching the grade that is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossierlake.llm._bytes import BLANK, U64, Words, text_slices

#: Classes of bytes: capitals, small letters and bytes of other letters, digits, white space, line ends, and ASCII marks by kind.
_CLASS = np.full(256, 1, np.int64)
_CLASS[0x41:0x5B] = 0
_CLASS[0x30:0x3A] = 2
_CLASS[[0x20, 0x09]] = 3
_CLASS[0x0A:0x0E] = 4
for _i, _marks in enumerate((b".,;:", b"!?", b"'\"()[]{}", b"-_/", b"#$%&*+=@^~", b"|<>\\`")):
    _CLASS[list(_marks)] = 5 + _i
_KINDS = 11
SHAPES, WORDS, RATES = _KINDS**3, 2048, 4
WIDTH = SHAPES + WORDS + RATES


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row per text: frequencies of class trigrams and of hashed words, as square roots, and rates of repetition."""
    n = len(offsets) - 1
    code = _CLASS[data]
    out = np.zeros((n, WIDTH), np.float32)
    if len(code) >= 3:
        grams = (code[:-2] * _KINDS + code[1:-1]) * _KINDS + code[2:]
        text = np.repeat(np.arange(n), np.diff(offsets))
        whole = text[:-2] == text[2:]
        out[:, :SHAPES] = np.bincount(text[:-2][whole] * SHAPES + grams[whole], minlength=n * SHAPES).reshape(n, SHAPES)
    words = Words(data, offsets, BLANK)
    text, counts = words.text_of, np.maximum(words.counts, 1)
    out[:, SHAPES : SHAPES + WORDS] = np.bincount(text * WORDS + (words.hash % U64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
    again = np.zeros(len(words.hash), bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (text[1:] == text[:-1])
    order = np.lexsort((words.hash, text))
    seen = np.zeros(len(words.hash), bool)
    seen[order[1:]] = (words.hash[order[1:]] == words.hash[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    rates = out[:, SHAPES + WORDS :]
    rates[:, 0] = np.bincount(text, again, n) / counts
    rates[:, 1] = np.bincount(text, seen, n) / counts
    rates[:, 2] = np.log1p(words.counts) / 10
    rates[:, 3] = words.counts == 0
    for a, b in ((0, SHAPES), (SHAPES, SHAPES + WORDS)):
        part = out[:, a:b]
        part /= np.maximum(part.sum(1, keepdims=True), 1)
        np.sqrt(part, out=part)
    return out


@dataclass
class Ordinal:
    """Weights, ordered thresholds and the grades that they part."""

    weights: np.ndarray
    thresholds: np.ndarray
    grades: np.ndarray

    def above(self, x: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - (x @ self.weights)[:, None], -60, 60)))

    def expected(self, above: np.ndarray) -> np.ndarray:
        return self.grades[0] + above @ np.diff(self.grades)

    def tail(self, above: np.ndarray, grade: float) -> np.ndarray:
        """P(grade or higher)."""
        k = int(np.searchsorted(self.grades, grade))
        if k == 0:
            return np.ones(len(above))
        return above[:, k - 1] if k <= above.shape[1] else np.zeros(len(above))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 2e-4, steps: int = 300, rate: float = 0.1) -> Ordinal:
    """Penalised likelihood of the cumulative-link model, by Adam on all rows. Thresholds stay ordered as a first one and positive gaps."""
    grades = np.unique(y).astype(float)
    cuts = len(grades) - 1
    if cuts < 1:
        return Ordinal(np.zeros(WIDTH, np.float32), np.zeros(0), grades if len(grades) else np.zeros(1))
    rank = np.searchsorted(grades, y)
    share = np.array([(rank <= k).mean() for k in range(cuts)])
    theta = np.log(share / (1 - share))
    w, first, gaps = np.zeros(x.shape[1], np.float32), theta[:1].copy(), np.log(np.maximum(np.diff(theta), 1e-2))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, first, gaps)]
    rows = np.arange(len(y))
    for step in range(1, steps + 1):
        t = np.concatenate([first, first + np.cumsum(np.exp(gaps))])
        below = 1 / (1 + np.exp(np.clip((x @ w)[:, None] - t, -60, 60)))  # P(rank <= k)
        edges = np.concatenate([np.zeros((len(y), 1)), below, np.ones((len(y), 1))], 1)
        p = np.maximum(edges[rows, rank + 1] - edges[rows, rank], 1e-9)
        slope = np.pad(below * (1 - below), ((0, 0), (1, 1)))
        high, low = slope[rows, rank + 1] / p, slope[rows, rank] / p
        by_cut = np.zeros((len(y), cuts + 2))
        by_cut[rows, rank + 1] -= high
        by_cut[rows, rank] += low
        g_t = by_cut[:, 1:-1].mean(0)
        g_w = (x.T @ ((high - low) / len(y)).astype(np.float32)) + penalty * w
        g_first = np.array([g_t.sum()])
        g_gaps = np.exp(gaps) * np.cumsum(g_t[::-1])[::-1][1:]
        for q, g, (m, v) in zip((w, first, gaps), (g_w, g_first, g_gaps), state, strict=True):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            q -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(q.dtype)
    return Ordinal(w, np.concatenate([first, first + np.cumsum(np.exp(gaps))]), grades)


def train(docs: DataFrame, labels: DataFrame, grade: str = "quality", id_col: str = "doc_id", text: str = "text", sample_rows: int = 4096) -> Ordinal:
    """Fits on at most ``sample_rows`` rated rows, those of the smallest hashes of their ids.

    Rows without id or grade are left out; of an id's ratings the lowest counts; of rows that share an id the
    smallest text is taken.
    """
    rated = labels.where(F.col(id_col).isNotNull() & F.col(grade).isNotNull()).groupBy(id_col).agg(F.min(grade).cast("double").alias("_grade"))
    sample = rated.orderBy(F.xxhash64(id_col), id_col).limit(sample_rows)
    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), T.StructField("_grade", T.DoubleType()), T.StructField("x", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row.astype(np.float16).tobytes() for _, _, data, offsets in text_slices(batch.column(2)) for row in features(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=schema.names)

    found = docs.select(docs[id_col].alias("_id"), docs[text].alias("_text")).join(F.broadcast(sample.withColumnRenamed(id_col, "_id")), "_id")  # at most sample_rows rows
    single = found.groupBy("_id").agg(F.min(F.struct("_text", "_grade")).alias("least")).select("_id", "least._grade", "least._text")
    rows = single.mapInArrow(run, schema).collect()
    rows.sort(key=lambda r: r[0])
    x = np.stack([np.frombuffer(r[2], np.float16) for r in rows]).astype(np.float32) if rows else np.zeros((0, WIDTH), np.float32)
    return fit(x, np.array([r[1] for r in rows]))


def _above(model: Ordinal, texts: pa.Array) -> np.ndarray:
    parts = [model.above(features(data, offsets)) for _, _, data, offsets in text_slices(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, len(model.thresholds)))


def keep_selected(docs: DataFrame, model: Ordinal, accept: float = 1, probability: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``score`` selects, with all their columns, whatever their names."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.tail(_above(model, batch.column(place)), accept) >= probability, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, model: Ordinal, accept: float = 1, probability: float = 0.5, text: str = "text") -> DataFrame:
    """``docs`` with expected_grade, tail_probability (of grade ``accept`` or more) and selected.

    A document is selected if that probability is at least ``probability``. A null text counts as empty; null,
    tied and repeated ids make no difference; an empty table gives an empty table; columns of ``docs`` stay as
    they are, but for those named like the three, which are replaced. Whole texts are read. A model of a single
    grade gives it to all.
    """
    added = [T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probability", T.DoubleType()), T.StructField("selected", T.BooleanType())]
    docs = docs.drop(*[f.name for f in added])
    schema = T.StructType(docs.schema.fields + added)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above = _above(model, batch.column(place))
            tail = model.tail(above, accept)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.expected(above), pa.float64()), pa.array(tail, pa.float64()), pa.array(tail >= probability, pa.bool_())], names=schema.names)

    return docs.mapInArrow(run, schema)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """Expected grade and selection of all ``documents``, fitted on ``labels.quality``."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs.select("doc_id", "text"), train(docs, labels)).select("doc_id", "expected_grade", "tail_probability", "selected")
