"""Structured Streaming over upload events: windows, daily buckets, alerts and a keyed latest state."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from dossierlake.operators.ledgers import fold_in_order


def read_files(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder, a bounded number a batch: the queue of jobs, without dropping any."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _instant(events: DataFrame, column: str) -> DataFrame:
    return events.withColumn(column, F.col(column).cast("timestamp"))


def upload_bursts(events: DataFrame, column: str = "uploaded_at", over: int = 5, late: str = "2 hours") -> DataFrame:
    """Users with more than ``over`` uploads within an hour, hours starting every five minutes. Works on a stream and on a table."""
    x = _instant(events, column)
    x = x.withWatermark(column, late) if events.isStreaming else x
    g = x.groupBy("user_id", F.window(column, "1 hour", "5 minutes").alias("w")).agg(F.count(F.lit(1)).alias("uploads"))
    return g.where(F.col("uploads") > over).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "uploads")


#: Seconds of a bucket, from which hours start, and of an hour.
STEP, HOUR = 300, 3600


def upload_buckets(events: DataFrame, column: str = "uploaded_at", late: str = "2 hours") -> DataFrame:
    """(user_id, second, n): uploads of each user in each five minutes, which begin at ``second``. Works on a stream and on a table.

    On a stream a bucket is one row of state, where each of the twelve hours that it is in would be one, and comes out
    once, when the watermark passes its end; an upload whose bucket has come out is dropped.
    """
    x = _instant(events, column)
    x = x.withWatermark(column, late) if events.isStreaming else x
    return x.groupBy("user_id", F.window(column, f"{STEP} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.unix_seconds("w.start").alias("second"), "n")


def bursts_of(buckets: DataFrame, over: int = 5, until: int | None = None) -> DataFrame:
    """The rows of ``upload_bursts`` from ``upload_buckets``; with ``until``, of hours that end by that second.

    A bucket that has uploads is the first such of the hours that begin after the one before it. Those are looked at
    only where it and the buckets of an hour from it on have more than ``over`` uploads together.
    """
    user = Window.partitionBy("user_id").orderBy("second")
    ahead = user.rangeBetween(0, HOUR - STEP)
    x = buckets.select("user_id", "second", "n", F.lag("second").over(user).alias("before"), F.sum("n").over(ahead).alias("most"), F.collect_list(F.struct("second", "n")).over(ahead).alias("held"))
    first = F.greatest(F.col("second") - (HOUR - STEP), F.col("before") + STEP)
    x = x.where(F.col("most") > over).select("user_id", "held", F.explode(F.sequence(first, "second", F.lit(STEP).cast("long"))).alias("from_"))
    x = x.where(F.col("from_") + HOUR <= until) if until is not None else x
    uploads = F.aggregate(F.filter("held", lambda h: h["second"] < F.col("from_") + HOUR), F.lit(0).cast("long"), lambda a, h: a + h["n"])
    at = lambda second: F.timestamp_seconds(second).cast("timestamp_ntz")
    return x.select("user_id", at(F.col("from_")).alias("start"), at(F.col("from_") + HOUR).alias("end"), uploads.alias("uploads")).where(F.col("uploads") > over)


def watermark(query: StreamingQuery) -> int:
    """The second up to which a stream that has ended had closed its windows."""
    from datetime import datetime

    told = (query.lastProgress or {"eventTime": {}})["eventTime"].get("watermark")
    return int(datetime.fromisoformat(told).timestamp() // 1) if told else 0


def daily_buckets(events: DataFrame, column: str = "uploaded_at", late: str = "2 days") -> DataFrame:
    x = _instant(events, column)
    x = x.withWatermark(column, late) if events.isStreaming else x
    return x.groupBy(F.window(column, "1 day").alias("w"), "doc_type").agg(F.count(F.lit(1)).alias("count")).select(F.to_date("w.start").alias("date"), "doc_type", "count")


def sessions(events: DataFrame, column: str = "uploaded_at", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    x = _instant(events, column)
    x = x.withWatermark(column, late) if events.isStreaming else x
    return x.groupBy("user_id", F.session_window(column, gap).alias("w")).agg(F.count(F.lit(1)).alias("uploads")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "uploads")


def first_seen(events: DataFrame, *keys: str, column: str = "uploaded_at", late: str = "1 day") -> DataFrame:
    """One event per key within the watermark."""
    return _instant(events, column).withWatermark(column, late).dropDuplicatesWithinWatermark(list(keys))


def latest_state(events: DataFrame, keys: list[str], column: str, tie: str, lives: str = "7 days", late: str = "1 day") -> DataFrame:
    """The last row of each key by ``column`` and then ``tie``, in every span of ``lives``: what a newer row replaces and an older, late one doesn't.

    Keyed state is kept for a span and ``late`` longer, and then dropped, so it doesn't grow with the keys ever seen.
    Written with ``KeyedTable.keep_latest``, the spans of a key come down to its last row. Rows that come more than
    ``late`` after later ones are dropped. Works on a stream (update mode) and on a table.
    """
    x = events.withColumn("instant_", F.col(column).cast("timestamp"))
    x = x.withWatermark("instant_", late) if events.isStreaming else x
    rest = [c for c in events.columns if c not in (*keys, column, tie)]
    g = x.groupBy(*keys, F.window("instant_", lives).alias("span_")).agg(F.max(F.struct(column, tie, *rest)).alias("top_"))
    return g.select(*keys, "top_.*").select(*events.columns)


#: Users that wait at most, are taken at once, and are remembered as done; states that need no work.
MOST_WAITING, AT_ONCE, REMEMBERED = 1000, 3, 50
SETTLED = ("VERIFIED", "APPROVED", "REJECTED")
_QUEUE_OUT = "queue long, id long, user_id long, outcome string, recent long"
_QUEUE_STATE = "waiting array<bigint>, recent array<bigint>, cancelled boolean"


class WorkQueue:
    """Waiting users of one queue, the last that were done, and whether the run is cancelled."""

    def __init__(self, waiting=(), recent=(), cancelled=False, most: int = MOST_WAITING):
        self.waiting, self.recent, self.cancelled, self.most = list(waiting), list(recent), cancelled, most

    def step(self, kind: str, user: int | None, settled: bool, forced: bool) -> list[tuple[int | None, str]]:
        """(user, outcome) of what an event brings about."""
        if kind == "start":
            self.cancelled = False
        elif kind == "cancel":
            gone, self.waiting, self.cancelled = self.waiting, [], True
            return [(u, "cancelled") for u in gone]
        elif kind == "work":
            taken, self.waiting = self.waiting[:AT_ONCE], self.waiting[AT_ONCE:]
            for u in taken:
                if u not in self.recent:
                    self.recent = [*self.recent, u][-REMEMBERED:]
            return [(u, "done") for u in taken]
        elif kind == "request":
            if settled and not forced:
                return [(user, "skipped")]
            if self.cancelled:
                return [(user, "cancelled")]
            if len(self.waiting) >= self.most:
                return [(user, "refused")]
            self.waiting.append(user)
            return [(user, "accepted")]
        return []


def work_events(requests: DataFrame, controls: DataFrame, users: DataFrame) -> DataFrame:
    """(queue, at, id, kind, user_id, settled, forced): requests (queue, at, id, user_id, forced) with whether their user needs no work, and controls (queue, at, id, kind).

    ``users`` are (id, status), each id once. Both may be streams; a user without a row needs work.
    """
    known = users.select(F.col("id").alias("user_id"), F.upper("status").isin(*SETTLED).alias("settled"))
    asked = requests.join(known, "user_id", "left").select("queue", "at", "id", F.lit("request").alias("kind"), "user_id", F.coalesce("settled", F.lit(False)).alias("settled"), F.coalesce("forced", F.lit(False)).alias("forced"))
    return asked.unionByName(controls.select("queue", "at", "id", "kind", F.lit(None).cast("long").alias("user_id"), F.lit(False).alias("settled"), F.lit(False).alias("forced")))


def run_queue(events: DataFrame, most: int = MOST_WAITING) -> DataFrame:
    """(queue, id, user_id, outcome, recent) of a table of ``work_events``: what each event, by ``at`` and ``id``, brings about for each user, and how many are remembered as done.

    A request is skipped where its user needs no work, cancelled while the run is, refused while ``most`` wait, and
    else accepted; work takes three users at a time; a cancel empties the queue until the next start.
    """

    def fold(rows):
        queue, state = None, WorkQueue(most=most)
        for q, _, ident, kind, user, settled, forced in rows:
            if q != queue:
                queue, state = q, WorkQueue(most=most)
            for u, outcome in state.step(kind, user, settled, forced):
                yield q, ident, u, outcome, len(state.recent)

    x = events.where("queue IS NOT NULL").select("queue", "at", "id", "kind", "user_id", "settled", "forced")
    return fold_in_order(x, "queue", [F.col("at").asc_nulls_first(), F.col("id"), F.col("kind"), F.col("user_id")], _QUEUE_OUT, fold)


def stream_queue(events: DataFrame, most: int = MOST_WAITING) -> DataFrame:
    """The same of a stream whose batches come in order: waiting users, the last done and the cancel are state of each queue."""

    def handle(key, frames, state):
        held = WorkQueue(*state.get, most=most) if state.exists else WorkQueue(most=most)
        rows = pd.concat(list(frames)).sort_values(["at", "id", "kind", "user_id"], na_position="first", kind="stable")
        out = []
        for ident, kind, user, settled, forced in rows[["id", "kind", "user_id", "settled", "forced"]].itertuples(index=False):
            user = None if pd.isna(user) else int(user)
            out += [(key[0], ident, u, outcome, len(held.recent)) for u, outcome in held.step(kind, user, settled, forced)]
        state.update((held.waiting, held.recent, held.cancelled))
        frame = pd.DataFrame(out, columns=["queue", "id", "user_id", "outcome", "recent"])
        yield frame.astype({"user_id": "Int64"})

    return events.where("queue IS NOT NULL").groupBy("queue").applyInPandasWithState(handle, _QUEUE_OUT, _QUEUE_STATE, "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """All that is there now, batch by batch; ``write`` gets (batch, number) and must give the same result if a batch comes again."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return q


def append_new(target: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """Appends the rows of a batch whose keys the target doesn't have: rows already in a final state are passed over.

    Of rows of one batch with the same keys the one whose columns come first in order is taken. The target is read by
    its keys alone.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
            batch = batch.join(spark.read.schema(batch.schema).parquet(target).select(*keys), keys, "left_anti")
        rest = [c for c in batch.columns if c not in keys]
        single = batch.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("least")).select(*keys, "least.*") if rest else batch.distinct()
        single.select(*batch.columns).write.mode("append").parquet(target)

    return write
