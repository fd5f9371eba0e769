"""Queries over tables that are changed by versions, and over streams that come in several rounds."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dossierlake.plans import metric_queries, text_queries  # noqa: F401  their SQL is used here
from dossierlake.plans._registry import SQL, query
from dossierlake.sources import logical as lt
from dossierlake.sources.keyed import KeyedTable
from dossierlake.sources.logical import with_tables as w
from dossierlake.sources.shared import remove, shared_root
from dossierlake.streaming import jobs


def _place(s: SparkSession, name: str) -> str:
    return f"{shared_root(s)}/{name}-{uuid.uuid4().hex}"


def changed_reviews(s: SparkSession, d: str) -> KeyedTable:
    """Reviews after three changes of their states, each a version."""
    table = KeyedTable(s, _place(s, "reviews"), ["id"], 16)
    reviews = lt.reviews(s, d)
    table.create(reviews)
    for chosen, status in (("status = 'pending' AND id % 2 = 0", "approved"), ("status = 'in_review' AND id % 3 = 0", "rejected"), ("id % 10 = 5", "corrected")):
        table.upsert(reviews.where(chosen).withColumn("status", F.lit(status)))
    return table


_AFTER = "CASE WHEN id % 10 = 5 THEN 'corrected' WHEN status = 'in_review' AND id % 3 = 0 THEN 'rejected' WHEN status = 'pending' AND id % 2 = 0 THEN 'approved' ELSE status END"
query("s6_stored_reviews", w(f"SELECT * REPLACE ({_AFTER} AS status) FROM reviews", "reviews"))(lambda s, d: changed_reviews(s, d).read())
query("s6_earlier_version", w("SELECT * REPLACE (CASE WHEN status = 'pending' AND id % 2 = 0 THEN 'approved' ELSE status END AS status) FROM reviews", "reviews"))(lambda s, d: changed_reviews(s, d).read(1))


@query("s7_stored_extractions", w("SELECT * FROM extracted WHERE user_id % 3 <> 0 UNION ALL SELECT * REPLACE (0.5::DOUBLE AS confidence_score) FROM extracted WHERE user_id % 3 = 0 AND doc_type = 'view'", "extracted"))
def stored_extractions(s: SparkSession, d: str) -> DataFrame:
    table, rows = KeyedTable(s, _place(s, "extracted"), ["user_id"], 16), lt.extracted(s, d)
    table.create(rows)
    # Users of this change that have no view at all keep their rows in neither form.
    table.replace(rows.where("user_id % 3 = 0 AND doc_type = 'view'").withColumn("confidence_score", F.lit(0.5)))
    return table.read()


def in_rounds(s: SparkSession, rows: DataFrame, rounds: list[str], build: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None], mode: str) -> StreamingQuery:
    """Runs a stream over ``rows`` that arrive in rounds, named by conditions; it stops and goes on from its checkpoint between them. Returns the last run."""
    at = _place(s, "rounds")
    for k, condition in enumerate(rounds):
        rows.where(condition).write.mode("append").parquet(f"{at}/in/round={k}")
        source = s.readStream.schema(rows.schema).parquet(f"{at}/in/*")
        last = jobs.run_once(build(source), f"{at}/state", write, mode)
    remove(s, at)
    return last


@query("st5_latest_state", SQL["w7_latest_extractions"])
def latest_extractions(s: SparkSession, d: str) -> DataFrame:
    """The last extraction of each user and type, from a stream whose rounds are out of order."""
    rows, keys = lt.extracted(s, d), ["user_id", "doc_type"]
    table = KeyedTable(s, _place(s, "latest"), keys, 16)
    table.create(rows.limit(0))
    in_rounds(s, rows, ["id % 3 = 1", "id % 3 = 0", "id % 3 = 2"], lambda x: jobs.latest_state(x, keys, "processed_at", "id", lives="60 days", late="60 days"), lambda b, n: table.keep_latest(b, ["processed_at", "id"], n), "update")
    return table.read()


def queue_events(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests for work, controls of their queues, and states of users."""
    e = lt.table(s, d, "events").select("event_id", "ts", "user_id", (F.col("user_id") % 8).alias("queue"))
    k = F.col("event_id")
    control = F.when(k % 101 == 0, "cancel").when(k % 101 == 5, "start").when(k % 4 == 3, "work")
    requests = e.where(control.isNull()).select("queue", F.col("ts").alias("at"), k.alias("id"), "user_id", (k % 29 == 0).alias("forced"))
    users = lt.verified(s, d).where("status IN ('VERIFIED', 'APPROVED')").groupBy(F.col("user_id").alias("id")).agg(F.max("status").alias("status")).where("id % 4 = 0")
    return requests, e.where(control.isNotNull()).select("queue", F.col("ts").alias("at"), k.alias("id"), control.alias("kind")), users


query("st3_work_queue")(lambda s, d: jobs.run_queue(jobs.work_events(*queue_events(s, d)), most=40))


@query("st4_streamed_queue")
def streamed_queue(s: SparkSession, d: str) -> DataFrame:
    """The same outcomes from a stream that is stopped twice and goes on."""
    requests, controls, users = queue_events(s, d)
    rows = requests.withColumn("kind", F.lit("request")).unionByName(controls, allowMissingColumns=True)
    out = _place(s, "queue")

    def build(x: DataFrame) -> DataFrame:
        asked, told = x.where("kind = 'request'").drop("kind"), x.where("kind <> 'request'").select("queue", "at", "id", "kind")
        return jobs.stream_queue(jobs.work_events(asked, told, users), most=40)

    in_rounds(s, rows, ["at < '2024-01-10'", "at >= '2024-01-10' AND at < '2024-01-20'", "at >= '2024-01-20'"], build, lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}"), "append")
    return s.read.schema(jobs._QUEUE_OUT).parquet(out).select("queue", "id", "user_id", "outcome", "recent")


def _rows_of(build: Callable[[DataFrame], DataFrame], rounds: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        out = _place(s, "streamed")
        in_rounds(s, lt.uploads(s, d), rounds, build, lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}"), "append")
        made = build(lt.uploads(s, d).limit(0))
        return s.read.schema(made.schema).parquet(out).select(*made.columns)

    return run


# Half of one day comes a round late; what ends two days before the last event is closed in the end.
_LATE = ["uploaded_at < '2024-01-10' AND NOT (uploaded_at >= '2024-01-09' AND id % 2 = 0)", "uploaded_at >= '2024-01-10' AND uploaded_at < '2024-01-20' OR uploaded_at >= '2024-01-09' AND uploaded_at < '2024-01-10' AND id % 2 = 0", "uploaded_at >= '2024-01-20'"]
_CLOSED = "(SELECT max(ts) FROM events) - INTERVAL 2 DAY"


@query("st1_streamed_bursts", f'SELECT * FROM ({SQL["st1_upload_bursts"]}) WHERE "end" <= {_CLOSED}')
def streamed_bursts(s: SparkSession, d: str) -> DataFrame:
    """Bursts in the hours that a stream has closed: it hands on counts of five minutes, of which hours are made where they are read."""
    out = _place(s, "streamed")
    last = in_rounds(s, lt.uploads(s, d), _LATE, lambda x: jobs.upload_buckets(x, late="2 days"), lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}"), "append")
    buckets = s.read.schema(jobs.upload_buckets(lt.uploads(s, d)).schema).parquet(out).select("user_id", "second", "n")
    return jobs.bursts_of(buckets, over=1, until=jobs.watermark(last))


query("st7_streamed_sessions", w("""WITH g AS (SELECT user_id, uploaded_at, CASE WHEN uploaded_at - lag(uploaded_at) OVER (PARTITION BY user_id ORDER BY uploaded_at) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM uploads),
  h AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY uploaded_at ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id, min(uploaded_at) AS start, count(*) AS uploads FROM h GROUP BY user_id, k HAVING max(uploaded_at) + INTERVAL 30 MINUTE <= """ + _CLOSED, "uploads"))(_rows_of(lambda x: jobs.sessions(x, late="2 days"), _LATE))
