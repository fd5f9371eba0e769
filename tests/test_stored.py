"""Ledgers, caches, versioned tables and work queues, against plain simulations."""

from __future__ import annotations

import random
import uuid
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from dossierlake.operators import ledgers as ld
from dossierlake.plans.registry import QUERIES, SQL
from dossierlake.sources.keyed import KeyedTable
from dossierlake.sources.shared import shared_root
from dossierlake.streaming import jobs
from tests.oracle import assert_same

EVENTS = "id long, at timestamp, position long, action string, reviewer_id string"


def ledger(spark, reviews, events):
    from datetime import datetime, timedelta

    at = lambda n: None if n is None else datetime(2024, 1, 1) + timedelta(minutes=n)
    return ld.review_ledger(spark.createDataFrame(reviews, "id long, status string, reviewer_id string"), spark.createDataFrame([(i, at(n), p, a, r) for i, n, p, a, r in events], EVENTS).repartition(3))


def test_double_claims_and_releases_of_others(spark):
    got = ledger(spark, [(1, "pending", None), (2, "approved", "c")], [(1, 1, 0, "claim", "a"), (1, 2, 0, "claim", "b"), (1, 3, 0, "release", "b"), (1, 4, 0, "release", "a"), (1, 5, 0, "claim", "b"), (2, 1, 0, "claim", "a"), (2, 2, 0, "release", "c"), (2, 3, 0, "claim", "a"), (3, 1, 0, "claim", "a")])
    assert sorted(map(tuple, ld.review_states(got).collect())) == [(1, "in_review", "b", 3), (2, "in_review", "a", 2)]
    assert sorted((r["id"], r["number"], r["action"], r["reviewer_id"], r["status"], r["holder"]) for r in ld.rejected_events(got).collect()) == [(1, 2, "claim", "b", "in_review", "a"), (1, 3, "release", "b", "in_review", "a"), (2, 1, "claim", "a", "approved", "c"), (3, 1, "claim", "a", None, None)]


def test_ledger_against_a_plain_walk(spark):
    r = random.Random(9)
    reviews = [(i, r.choice(("pending", "in_review", "approved")), r.choice((None, "a", "b"))) for i in range(12)]
    # Most events are of one review.
    events = [(r.choice((0,) * 12 + tuple(range(14))), r.choice((None, *range(40))), r.randrange(3), r.choice(("claim", "claim", "release", "release", "approve", "reprocess", "other", None, "start")), r.choice((None, "a", "b", "c"))) for _ in range(600)]
    events += events[:30]
    want, states = [], {}
    by = defaultdict(list)
    for i, n, p, a, v in events:
        by[i].append((n is not None, n or 0, p, "" if a in (None, "start") else a, v is not None, v or ""))
    for i in {*by, *(x[0] for x in reviews)}:
        known = next((x for x in reviews if x[0] == i), None)
        status, holder = known[1:] if known else (None, None)
        for k, (_, _, _, a, has, v) in enumerate(sorted(by[i])):
            v = v if has else None
            new = None
            if known and a == "claim" and status == "pending":
                new = "in_review", v
            if known and a == "release" and v and holder == v:
                new = "pending", None
            if known and a in ("approve", "reprocess"):
                new = {"approve": "approved", "reprocess": "reprocess_requested"}[a], v or holder
            want.append((i, k + 1, a, v, new is not None, status))
            status, holder = new or (status, holder)
        if known:
            states[i] = status, holder
    got = ledger(spark, reviews, events)
    key = lambda x: (x[0], x[1])
    assert sorted(((x["id"], x["number"], x["action"], x["reviewer_id"], x["accepted"], x["before"]) for x in got.where("number > 0").collect()), key=key) == sorted(want, key=key)
    assert {x["id"]: (x["status"], x["reviewer_id"]) for x in ld.review_states(got).collect()} == states


def test_empty_ledgers_and_other_columns(spark):
    reviews = spark.createDataFrame([(1, "pending", None, "x")], "id long, status string, reviewer_id string, first string")
    none = spark.createDataFrame([], EVENTS + ", number int")
    assert [tuple(r) for r in ld.review_states(ld.review_ledger(reviews, none)).collect()] == [(1, "pending", None, 0)]
    assert ld.review_ledger(reviews.limit(0), none).collect() == []


@pytest.mark.parametrize("name", ["s8_claims", "s8_rejected_events"])
def test_events_without_reviewer_or_time_come_last_as_in_sql(spark, tmp_path, name):
    from datetime import datetime

    day = datetime(2024, 1, 1)
    spark.createDataFrame([(i, i, "OPF"[i % 3], day, "1-URGENT") for i in range(30)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    # Order 0 is claimed at once by nobody (part 11) and by a reviewer (part 1); others at random, many at once.
    r = random.Random(4)
    events = [(0, 11, 5, 1, day), (0, 1, 5, 1, day)] + [(r.randrange(32), r.choice((11, 1, 22, 2, 33, 4, 5, 44, 7, None)), r.choice((*range(6), None)), r.choice((1, 2, None)), r.choice((day, day, None))) for _ in range(500)]
    events = [e for e in events if e[0] or e in events[:2]]
    spark.createDataFrame(events, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_shipdate timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    duck = duckdb.connect()
    for t in ("orders", "lineitem"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    found = QUERIES[name](spark, str(tmp_path)).toPandas()
    assert name != "s8_claims" or found.set_index("id").loc[0, "reviewer_id"] == "rev2"
    assert_same(found, duck.sql(SQL[name]).df())


@pytest.mark.parametrize(("shards", "most"), [(1, 5), (3, 4), (2, 1000)])
def test_cache_against_a_plain_table(spark, shards, most):
    r = random.Random(most)
    rows = [(i, float(r.randrange(0, 400_000)), r.choice((*"abcdefghijkl", *"aaaaaaaa")), r.random() < 0.1) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, sec double, key string, fresh boolean").select("id", F.timestamp_seconds("sec").alias("at"), "key", "fresh").repartition(3)
    got = {x["id"]: x for x in ld.cache_log(df, shards, most, 90_000).collect()}
    assert len(got) == 800
    for shard in {x["shard"] for x in got.values()}:
        used, put = [], {}  # keys by use, and when each was read
        for i, sec, key, fresh in sorted((x for x in rows if got[x[0]]["shard"] == shard), key=lambda x: (x[1], x[0])):
            want = "miss" if key not in put else "refreshed" if fresh else "expired" if sec - put[key] > 90_000 else "hit"
            assert (got[i]["outcome"], got[i]["age"]) == (want, sec - put[key] if want == "hit" else None)
            if want != "hit":
                put[key] = sec
            used = [*(k for k in used if k != key), key]
            for gone in used[:-most]:
                del put[gone]
            used = used[-most:]
    assert (most < 1000) == (sum(x["outcome"] == "miss" for x in got.values()) > 12)


def place(spark):
    return f"{shared_root(spark)}/test-{uuid.uuid4().hex}"


def test_versions_and_buckets(spark):
    rows = spark.createDataFrame([(i, f"v{i}", i % 3) for i in range(400)] + [(None, "none", 0)], "id long, value string, bucket int")
    table = KeyedTable(spark, place(spark), ["id"], 32)
    first = table.create(rows)
    change = table.upsert(spark.createDataFrame([(7, "new", 1), (1000, "more", 2), (None, "some", 0)], rows.schema))
    assert (change.version, change.buckets <= 3) == (1, True)
    assert 0 < change.bytes_written < first.bytes_written / 4 < change.bytes_total
    now = {r["id"]: r["value"] for r in table.read().collect()}
    assert (len(now), now[7], now[1000], now[8], now[None]) == (402, "new", "more", "v8", "some")
    assert {r["id"]: r["value"] for r in table.read(0).collect()} == {r["id"]: r["value"] for r in rows.collect()}
    assert table.upsert(rows.limit(0)).buckets == 0
    assert table.versions() == [0, 1, 2]


def test_a_change_that_fails_leaves_the_version_before(spark):
    rows = spark.createDataFrame([(i, 1) for i in range(50)], "id long, n int")
    table = KeyedTable(spark, place(spark), ["id"], 4)
    table.create(rows)
    with pytest.raises(Exception, match="broken"):
        table.upsert(rows.withColumn("n", F.when(F.col("id") == 30, F.raise_error(F.lit("broken")).cast("int")).otherwise(2)))
    assert table.versions() == [0] and table.read().agg(F.sum("n")).first()[0] == 50
    table.upsert(rows.withColumn("n", F.lit(3)))
    assert table.read().agg(F.sum("n")).first()[0] == 150


def test_replaced_keys_and_late_rows(spark):
    table = KeyedTable(spark, place(spark), ["user"], 4)
    schema = "user long, at int, n int"
    table.create(spark.createDataFrame([(1, 1, 1), (1, 1, 2), (2, 1, 3)], schema))
    table.replace(spark.createDataFrame([(1, 5, 9)], schema))
    assert sorted(map(tuple, table.read().collect())) == [(1, 5, 9), (2, 1, 3)]
    table.keep_latest(spark.createDataFrame([(1, 4, 0), (2, 2, 4), (3, None, 1), (3, 1, 2)], schema), ["at"], batch=0)
    assert sorted(map(tuple, table.read().collect())) == [(1, 5, 9), (2, 2, 4), (3, 1, 2)]
    again = table.keep_latest(spark.createDataFrame([(1, 99, 99)], schema), ["at"], batch=0)
    assert again.buckets == 0 and sorted(map(tuple, table.read().collect()))[0] == (1, 5, 9)


def test_work_queue_against_a_plain_walk(spark):
    r = random.Random(1)
    rows = [(r.randrange(3), i, i, "request" if (u := r.random()) < 0.6 else "work" if u < 0.9 else r.choice(("cancel", "start")), r.randrange(300), r.random() < 0.1, r.random() < 0.1) for i in range(900)]
    df = spark.createDataFrame(rows, "queue long, at long, id long, kind string, user_id long, settled boolean, forced boolean").repartition(4)
    waiting, recent, stopped, want = defaultdict(list), defaultdict(list), defaultdict(bool), []
    for q, _, i, kind, user, settled, forced in rows:
        if kind == "request":
            outcome = "skipped" if settled and not forced else "cancelled" if stopped[q] else "refused" if len(waiting[q]) == 10 else "accepted"
            waiting[q] += [user] if outcome == "accepted" else []
            want.append((q, i, user, outcome, len(recent[q])))
        elif kind == "work":
            done, waiting[q] = waiting[q][:3], waiting[q][3:]
            for u in done:
                if u not in recent[q]:
                    recent[q] = (recent[q] + [u])[-50:]
            want += [(q, i, u, "done", len(recent[q])) for u in done]
        else:
            want += [(q, i, u, "cancelled", len(recent[q])) for u in waiting[q]] if kind == "cancel" else []
            waiting[q] = [] if kind == "cancel" else waiting[q]
            stopped[q] = kind == "cancel"
    assert {"skipped", "cancelled", "refused", "accepted", "done"} == {x[3] for x in want}
    assert max(x[4] for x in want) == 50
    assert sorted(map(tuple, jobs.run_queue(df, 10).collect())) == sorted(want)


def test_a_streamed_queue_gives_the_same(spark, tiny):
    from dossierlake.plans import stored_queries as sq

    assert sorted(map(str, sq.streamed_queue(spark, tiny).collect())) == sorted(map(str, jobs.run_queue(jobs.work_events(*sq.queue_events(spark, tiny)), 40).select("queue", "id", "user_id", "outcome", "recent").collect()))


def test_state_before_the_first_action(spark):
    from dossierlake.operators import documents as dc

    reviews = spark.createDataFrame([(1, "pending")], "id long, status string")
    actions = spark.createDataFrame([(1, "approve", "a", 1, 1), (1, "correct", "a", 2, 1), (2, "approve", "a", 1, 1)], "id long, action string, reviewer_id string, acted_at int, position int")
    assert sorted((r["id"], r["acted_at"], r["before"], r["after"]) for r in dc.action_log(reviews, actions).collect()) == [(1, 1, "pending", "approved"), (1, 2, "approved", "corrected"), (2, 1, None, "approved")]


def test_counts_of_five_minutes_give_the_hours_and_one_row_of_state(spark):
    from dossierlake.plans import stored_queries as st

    r = random.Random(6)
    rows = [(u, 300 * r.randrange(60) + r.choice((0, 299, 17))) for u in (1, 1, 1, 2, None) for _ in range(30)] + [(3, 0), (3, 3599), (4, 0), (4, 3600), (5, 7), (None, None), (6, None)]
    ups = spark.createDataFrame(rows, "user_id long, sec long").select("user_id", (F.timestamp_seconds("sec")).cast("timestamp_ntz").alias("uploaded_at"))
    for over in (0, 1, 5):
        got = sorted(map(tuple, jobs.bursts_of(jobs.upload_buckets(ups), over).collect()), key=str)
        assert got and got == sorted(map(tuple, jobs.upload_bursts(ups, over=over).collect()), key=str)
    # Three hours, then a day later one upload: all but the last is closed, and each bucket was one row of state.
    ups = ups.where("user_id IS NOT NULL AND uploaded_at IS NOT NULL").withColumn("id", F.lit(0)).unionByName(spark.sql("SELECT 9L AS user_id, TIMESTAMP_NTZ'1970-01-02 05:00:00' AS uploaded_at, 1 AS id"))
    out = place(spark)
    last = st.in_rounds(spark, ups, ["id = 0", "id = 1"], lambda x: jobs.upload_buckets(x, late="1 hour"), lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}"), "append")
    assert jobs.watermark(last) == 28 * 3600
    kept = sum(p["stateOperators"][0]["numRowsUpdated"] for p in last.recentProgress if p["stateOperators"])
    assert kept == 1
    held = spark.read.parquet(out).select("user_id", "second", "n")
    assert held.count() == ups.where("id = 0").select("user_id", F.floor(F.unix_seconds(F.col("uploaded_at").cast("timestamp")) / 300)).distinct().count()
    want = sorted(map(tuple, jobs.upload_bursts(ups.where("id = 0"), over=1).where("end <= '1970-01-01 03:00:00'").collect()))
    assert sorted(map(tuple, jobs.bursts_of(held, 1, 3 * 3600).collect())) == want and want


def test_streamed_bursts_keep_a_row_of_state_for_each_upload(spark, tiny, monkeypatch):
    updated, once = [], jobs.run_once

    def run(*a, **k):
        q = once(*a, **k)
        updated.append(sum(p["stateOperators"][0]["numRowsUpdated"] for p in q.recentProgress if p["stateOperators"]))
        return q

    monkeypatch.setattr(jobs, "run_once", run)
    QUERIES["st1_streamed_bursts"](spark, tiny)
    assert len(updated) == 3 and sum(updated) <= spark.read.parquet(f"{tiny}/events.parquet").count()
