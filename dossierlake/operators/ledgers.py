"""Events whose effect depends on the state that earlier ones left: claims of reviews, and a cache with expiry and eviction.

Rows are dealt by key and sorted within their partitions, and a task goes through its rows once with the state of the
key at hand. So a task holds one state and never the rows of a key, however many there are.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake.operators.documents import ACTIONS

#: Entries that a cache holds and seconds for which one is good.
MOST_ENTRIES, GOOD_FOR = 200, 24 * 3600
#: Rows that a task hands on at once.
CHUNK = 20_000


def fold_in_order(rows: DataFrame, key: str, order: list[Column], schema: str, fold: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """``fold`` of each task's rows, as tuples in the columns' order: all rows of a key follow each other, in ``order``."""
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "double": pa.float64()}
    out = pa.schema([(name, kinds[kind]) for name, kind in fields])

    def tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        for row in fold(tuples(batches)):
            made.append(row)
            if len(made) == CHUNK:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), out, strict=True)], schema=out)
                made = []
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), out, strict=True)], schema=out)

    return rows.repartition(key).sortWithinPartitions(F.col(key).asc_nulls_first(), *order).mapInArrow(run, schema)


def _review_steps(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(id, number, action, reviewer_id, accepted, before, after, holder) of each event, and one with number 0 of each review as it ends.

    A claim needs a review that is pending, a release one that the same reviewer has; other actions always take effect.
    """
    current, known = None, False
    status = holder = None
    number = taken = 0
    seen = False
    for ident, _, _, action, reviewer, first in rows:
        if not seen or ident != current:
            if seen and known:
                yield current, 0, "state", None, None, str(taken), status, holder
            current, seen, known, number, taken = ident, True, False, 0, 0
            status = holder = None
        if action == "start":
            known, status, holder = True, first, reviewer
            continue
        number += 1
        before, accepted = status, False
        if known and action == "claim" and status == "pending":
            status, holder, accepted = "in_review", reviewer, True
        elif known and action == "release" and reviewer is not None and holder == reviewer:
            status, holder, accepted = "pending", None, True
        elif known and action in ACTIONS:
            status, holder, accepted = ACTIONS[action][0], reviewer if reviewer is not None else holder, True
        taken += accepted
        yield ident, number, action, reviewer, accepted, before, status, holder
    if seen and known:
        yield current, 0, "state", None, None, str(taken), status, holder


def review_ledger(reviews: DataFrame, events: DataFrame, nulls_last: bool = False) -> DataFrame:
    """(id, number, action, reviewer_id, accepted, before, after, holder): every event with what came of it, and a row numbered 0 with the state in which each review ends.

    ``reviews`` are (id, status, reviewer_id), ``events`` (id, at, position, action, reviewer_id). Events of a review go
    by ``at``, ``position``, ``action`` and ``reviewer_id``, nulls first or last in each. A claim that finds the review taken, a release by another
    reviewer than the holder, an unknown action, and any event of a review that isn't there are rejected and change
    nothing. An action without a reviewer leaves the holder. Repeated events are tried again; repeated reviews count
    once, by their least status. In the row numbered 0 ``before`` is the number of accepted events.
    """
    start = reviews.groupBy(F.col("id").cast("long").alias("id")).agg(F.min(F.struct("status", "reviewer_id")).alias("s"))
    start = start.select("id", F.lit(None).cast("timestamp").alias("at"), F.lit(None).cast("long").alias("position"), F.lit("start").alias("action"), F.col("s.reviewer_id").alias("reviewer_id"), F.col("s.status").alias("first"))
    told = events.where(F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), F.col("at").cast("timestamp").alias("at"), F.col("position").cast("long").alias("position"), F.coalesce("action", F.lit("")).alias("action"), "reviewer_id", F.lit(None).cast("string").alias("first"))
    told = told.withColumn("action", F.when(F.col("action") == "start", "").otherwise(F.col("action")))
    order = [(F.col("action") != "start").asc(), *[F.col(c).asc_nulls_last() if nulls_last else F.col(c).asc_nulls_first() for c in ("at", "position", "action", "reviewer_id")]]
    return fold_in_order(start.unionByName(told), "id", order, "id long, number long, action string, reviewer_id string, accepted boolean, before string, after string, holder string", _review_steps)


def review_states(ledger: DataFrame) -> DataFrame:
    """(id, status, reviewer_id, accepted) of each review after all its events."""
    return ledger.where("number = 0").select("id", F.col("after").alias("status"), F.col("holder").alias("reviewer_id"), F.col("before").cast("long").alias("accepted"))


def rejected_events(ledger: DataFrame) -> DataFrame:
    """(id, number, action, reviewer_id, status, holder): events that changed nothing, and the state that they met."""
    return ledger.where("number > 0 AND NOT accepted").select("id", "number", "action", "reviewer_id", F.col("before").alias("status"), "holder")


def _cache_steps(most: int, good_for: float) -> Callable[[Iterator[tuple]], Iterator[tuple]]:
    """(id, shard, key, outcome, age) of each request, by an ordered table of each shard's entries."""

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        current, held = None, OrderedDict()
        for shard, at, ident, key, fresh in rows:
            if shard != current:
                current, held = shard, OrderedDict()
            put = held.get(key)
            if fresh and put is not None:
                del held[key]
                outcome, put = "refreshed", None
            elif put is None:
                outcome = "miss"
            elif at - put > good_for:
                del held[key]
                outcome, put = "expired", None
            else:
                outcome = "hit"
            if put is None:
                held[key] = at
            held.move_to_end(key)
            if len(held) > most:
                held.popitem(last=False)
            yield ident, shard, key, outcome, (at - put if put is not None else None)

    return fold


def cache_log(requests: DataFrame, shards: int = 64, most: int = MOST_ENTRIES, good_for: float = GOOD_FOR) -> DataFrame:
    """(id, shard, key, outcome, age) of each request (id, at, key, fresh): hit, miss, expired, or refreshed where the request asks for a new reading.

    A key belongs to one of ``shards`` caches, each with ``most`` entries: what isn't a hit is read anew and put in,
    and beyond that the entry goes that was used longest ago. An entry is good for ``good_for`` seconds after it was
    put in; being used doesn't make it younger. Requests go by ``at`` and ``id``; those without either, or without
    a key, take no part. Repeated requests are requests of their own.
    """
    seconds = F.unix_micros(F.col("at").cast("timestamp")) / F.lit(1e6)
    x = requests.where("at IS NOT NULL AND key IS NOT NULL AND id IS NOT NULL")
    x = x.select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), seconds.alias("at"), F.col("id").cast("long").alias("id"), "key", F.coalesce("fresh", F.lit(False)).alias("fresh"))
    return fold_in_order(x, "shard", [F.col("at"), F.col("id"), F.col("key"), F.col("fresh")], "id long, shard long, key string, outcome string, age double", _cache_steps(most, good_for))
