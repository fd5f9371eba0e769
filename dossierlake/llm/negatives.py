"""Hard-negative mining with bit-sliced integer products.

Components become integers, and those of the rows are cut into bit planes. A score starts as an interval and planes
are taken in, the most significant first: what the planes still to come can add lies between the sums of the
anchor's negative and of its positive components, times their weight. Once an interval can't reach the best scores
found so far, or the span in which negatives lie, the pair of anchor and row is dropped, and lower planes are worked
out for what is left only.

Anchors are taken in blocks of bounded size. A block is broadcast, every task goes through its own rows once and
hands on the best few of each anchor, and these are ranked by a window. So rows are never shuffled or paired as rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossierlake.llm._scratch import Scratch

#: Beyond every score.
FAR = 1 << 62
#: Bytes of anchors in a block, and pairs of anchors and rows that a task holds at once.
BLOCK_BYTES, PAIRS = 4 << 20, 1 << 21
#: Pairs whose lower planes are worked out one by one, at once.
LOOSE = 1 << 15
#: Beyond this share of pairs left, a plane is worked out for all pairs of a block as a product of matrices.
DENSE = 1 / 16


def matrix(vectors: pa.Array) -> np.ndarray:
    """The rows of a list column; where lengths differ, missing components are 0."""
    sizes = np.asarray(vectors.value_lengths(), np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max()) if len(sizes) else 0
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _fit(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


@dataclass
class Anchors:
    """A block of anchors, and the spans of scores that are looked for: of each, ``spans`` pairs of least and most."""

    row: np.ndarray
    label: np.ndarray
    vector: np.ndarray
    least: np.ndarray
    most: np.ndarray

    def widened(self, width: int) -> Anchors:
        return Anchors(self.row, self.label, _fit(self.vector, width), self.least, self.most)


@dataclass
class Rows:
    row: np.ndarray
    key: np.ndarray  # by which ties go: ids, and behind them rows without one
    label: np.ndarray
    vector: np.ndarray

    def part(self, a: int, b: int) -> Rows:
        return Rows(self.row[a:b], self.key[:, a:b], self.label[a:b], self.vector[a:b])


class Best:
    """The ``keep`` best rows of each slot, an anchor and one of its spans."""

    def __init__(self, slots: int, keep: int):
        self.keep = keep
        self.slot, self.score, self.row = (np.zeros(0, np.int64) for _ in range(3))
        self.key = np.zeros((2, 0), np.int64)
        self.bar = np.full(slots, -FAR)  # what a score must reach to come in

    def add(self, slot: np.ndarray, score: np.ndarray, key: np.ndarray, row: np.ndarray) -> None:
        slot, score, row, key = np.append(self.slot, slot), np.append(self.score, score), np.append(self.row, row), np.append(self.key, key, axis=1)
        order = np.lexsort((row, key[1], key[0], -score, slot))
        slot = slot[order]
        first = np.searchsorted(slot, slot)
        place = np.arange(len(slot)) - first
        kept = place < self.keep
        self.slot, self.score, self.row, self.key = slot[kept], score[order][kept], row[order][kept], key[:, order][:, kept]
        full = place[kept] == self.keep - 1
        self.bar[self.slot[full]] = self.score[full]


def scores(anchors: Anchors, rows: Rows, wanted: np.ndarray, least: np.ndarray, most: np.ndarray, keep: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the wanted pairs, by place, whose score can lie between ``least`` and ``most`` of the anchor.

    With ``keep``, only pairs that can be among so many best of their anchor. All arithmetic is exact.
    """
    low = int(rows.vector.min(initial=0))
    above = rows.vector - low
    bits = int(above.max(initial=0)).bit_length()
    negative, positive = np.minimum(anchors.vector, 0).sum(1), np.maximum(anchors.vector, 0).sum(1)
    reach = float((np.abs(anchors.vector.astype(float)).sum(1) * (abs(low) + float(1 << bits))).max(initial=0))
    if reach >= 1 << 53:
        if reach >= FAR:
            raise OverflowError("scores don't fit 64-bit integers")
        kind = np.dtype(np.int64)
    else:
        kind = np.dtype(np.float32 if reach < 1 << 24 else np.float64)
    q, negative, positive = anchors.vector.astype(kind), negative.astype(kind)[:, None], positive.astype(kind)[:, None]
    alive, score = wanted.copy(), np.repeat((q.sum(1) * kind.type(low))[:, None], len(rows.row), axis=1)
    plane = bits
    while plane and alive.mean() > DENSE:
        plane -= 1
        score += (q @ ((above >> plane) & 1).astype(kind).T) * kind.type(1 << plane)
        rest = kind.type((1 << plane) - 1)
        upper, lower = score + rest * positive, score + rest * negative
        bar = least
        if keep and keep < alive.shape[1]:
            sure = np.where(alive, lower, kind.type(-FAR))
            bar = np.maximum(bar, np.partition(sure, alive.shape[1] - keep, axis=1)[:, alive.shape[1] - keep])
        alive &= (upper >= bar[:, None]) & (lower <= most[:, None])
    a, r = np.nonzero(alive)
    score = score[a, r]
    while plane:
        plane -= 1
        bit = ((above >> plane) & 1).astype(kind)
        for i in range(0, len(a), LOOSE):
            score[i : i + LOOSE] += np.einsum("ij,ij->i", q[a[i : i + LOOSE]], bit[r[i : i + LOOSE]]) * kind.type(1 << plane)
        rest = kind.type((1 << plane) - 1)
        left = (score + rest * positive[a, 0] >= least[a]) & (score + rest * negative[a, 0] <= most[a])
        a, r, score = a[left], r[left], score[left]
    return a, r, score.astype(np.int64)


def search(anchors: Anchors, parts: Iterator[Rows], keep: int, same: bool) -> Best:
    """The best rows of each span: of the anchor's label, or with ``same`` off of other labels."""
    count, spans = anchors.least.shape
    best = Best(count * spans, keep)
    place = {int(x): i for i, x in enumerate(anchors.row)}
    for rows in parts:
        width = max(anchors.vector.shape[1], rows.vector.shape[1])
        anchors = anchors.widened(width)
        wanted = (anchors.label[:, None] == rows.label[None, :]) == same
        if same:  # a row is no positive of its own
            for j in np.flatnonzero(np.isin(rows.row, anchors.row)):
                wanted[place[int(rows.row[j])], j] = False
        floor = np.maximum(anchors.least, best.bar.reshape(count, spans))
        a, r, score = scores(anchors, Rows(rows.row, rows.key, rows.label, _fit(rows.vector, width)), wanted, floor.min(1), anchors.most.max(1), keep if same else None)
        for s in range(spans):
            fits = (score >= floor[a, s]) & (score <= anchors.most[a, s])
            best.add(a[fits] * spans + s, score[fits], rows.key[:, r[fits]], rows.row[r[fits]])
    return best


def _search(table: DataFrame, block, keep: int, same: bool) -> DataFrame:
    """(anchor, span, row, id, score): the best of each task."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("anchor", "span", "row", "id", "score")])

    def parts(batches: Iterator[pa.RecordBatch], count: int) -> Iterator[Rows]:
        step = max(1, PAIRS // count)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(1)
            key = np.stack([np.asarray(ids.is_null(), np.int64), ids.fill_null(0).to_numpy(zero_copy_only=False)])
            rows = Rows(batch.column(0).to_numpy(), key, batch.column(2).to_numpy(), matrix(batch.column(3)))
            for a in range(0, batch.num_rows, step):
                yield rows.part(a, a + step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = block.value
        spans = anchors.least.shape[1]
        found = search(anchors, parts(batches, len(anchors.row)), keep, same)
        ids = pa.array(found.key[1], mask=found.key[0] > 0)
        yield pa.RecordBatch.from_arrays([pa.array(anchors.row[found.slot // spans]), pa.array(found.slot % spans), pa.array(found.row), ids, pa.array(found.score)], names=schema.names)

    return table.select("row", "id", "label", "vector").mapInArrow(run, schema)


def _ranked(found: DataFrame, *by: str) -> DataFrame:
    """Higher scores first, then smaller ids, rows without one last, then rows in the order that they were read."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("place", F.row_number().over(order))


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100, scale: int = 256, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", block_bytes: int = BLOCK_BYTES, scratch: Scratch | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components are floored at ``scale`` times their value; a score is the inner product with the anchor. An anchor's
    positives are its best other rows of the same (whole-number) label; the negatives of each are the best rows of
    other labels whose score has at least ``least`` and at most ``most`` hundredths of the positive's.

    Rows with a null label, a null vector, or a null or non-finite component take no part. Ties go by the smaller id,
    then ids that are null, then the order of rows; ``is_anchor`` decides on rows without an id as on any.
    Repeated rows are rows of their own, so one is the other's positive. Missing components of shorter vectors count
    as 0, so all scores with an empty vector are 0. A table without anchors or without rows gives no rows; further
    columns are not read. Scores are exact; values that could pass 62 bits raise an error.
    """
    spark = rows.sparkSession
    scratch = scratch or Scratch(spark, "negatives")
    x = rows[vector]
    usable = rows[label].isNotNull() & x.isNotNull() & F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    own = rows.where(usable).select(F.monotonically_increasing_id().alias("row"), rows[id_col].cast("long").alias("id"), rows[label].cast("long").alias("label"), scaled.alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    table = scratch.keep(own, "rows")
    count, width = table.where("anchor").agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    blocks = max(1, math.ceil(count * 8 * (width + 2 + 2 * positives) / block_bytes))
    anchors = scratch.keep(table.where("anchor").drop("anchor").repartition(blocks).withColumn("block", F.spark_partition_id()), "anchors")

    def block_of(b: int, spans: DataFrame | None):
        """Block ``b`` with the spans of scores that its positives give, or one span without ends."""
        taken = anchors.where(F.col("block") == b)
        if spans is not None:
            taken = taken.join(spans.where(F.col("block") == b).drop("block"), "row", "left")
        got = taken.toArrow().combine_chunks()  # of bounded size
        n = got.num_rows
        if not n:
            return None
        low, high = np.full((n, 1), -FAR), np.full((n, 1), FAR)
        if spans is not None:
            low, high = np.full((n, positives), FAR), np.full((n, positives), -FAR)  # none, where there are fewer positives
            for i, scores_ in enumerate(got.column("scores").to_pylist()):
                for s, p in enumerate(scores_ or ()):
                    low[i, s], high[i, s] = -(-least * p // 100), most * p // 100
        return spark.sparkContext.broadcast(Anchors(got.column("row").to_numpy(), got.column("label").to_numpy(), matrix(got.column("vector").combine_chunks()), low, high))

    def through_blocks(name: str, keep: int, same: bool, spans: DataFrame | None) -> DataFrame:
        for b in range(blocks):
            block = block_of(b, spans)
            if block is None:
                continue
            found = _search(table, block, keep, same).withColumn("block", F.lit(b))
            found.write.mode("append").option("compression", "zstd").parquet(scratch.at(name))
            block.unpersist()
        schema = "anchor long, span long, row long, id long, score long, block int"
        spark.createDataFrame([], schema).write.mode("append").parquet(scratch.at(name))  # where there is no anchor
        return spark.read.schema(schema).parquet(scratch.at(name))

    near = _ranked(through_blocks("same", positives, True, None), "anchor").where(F.col("place") <= positives)
    ids = table.where("anchor").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    near = scratch.keep(near.join(ids, "anchor").select("anchor", "anchor_id", "block", (F.col("place") - 1).cast("long").alias("span"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    spans = near.groupBy(F.col("anchor").alias("row"), "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("span", "positive_score"))), lambda s: s["positive_score"]).alias("scores"))
    other = _ranked(through_blocks("other", negatives, False, spans), "anchor", "span").where(F.col("place") <= negatives)
    scratch.keep_only("positives", "other")
    joined = other.select("anchor", "span", F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(near.drop("block"), ["anchor", "span"])
    return joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of the rows of ``embeddings`` whose id is divisible by 100, among all rows."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH q AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM q a JOIN q b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT ar, anchor_id, br, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY ar, p.br ORDER BY score DESC, vec_id))::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (ar) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5"""
