"""Keyed state of ingest against the batch result, in any order of micro-batches, over restarts."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from verbena.progress import Progress, StreamProgress
from verbena.streaming import flows, keyed

FIELDS = "candidate_id string, session_id string, seq long, sha256 string, score int"


def rows(n=120, seed=7):
    r = random.Random(seed)
    return [(f"c{i:03d}", f"s{r.randrange(3)}", i, f"h{r.randrange(25)}" if r.random() < 0.95 else None, r.choice([10, 50, 90])) for i in range(n)]


def batch(spark, data):
    c = spark.createDataFrame(data, FIELDS).dropDuplicates(["candidate_id"]).where("sha256 IS NOT NULL").withColumn("own", keyed.own_status(F.col("score")))
    owner = c.where("own <> 'rejected'").groupBy("sha256").agg(F.min(F.struct("seq", "candidate_id")).alias("o"))
    status = F.when((F.col("own") != "rejected") & (F.col("o.candidate_id") != F.col("candidate_id")), "duplicate_linked").otherwise(F.col("own"))
    return {(r.candidate_id, r.session_id, r.status) for r in c.join(owner, "sha256", "left").select("candidate_id", "session_id", status.alias("status")).collect()}


def test_any_order_of_batches_gives_the_batch_result(spark, tmp_path):
    data = rows()
    want = batch(spark, data)
    for trial in range(2):
        mixed = data + data[:15]  # some come twice
        random.Random(trial).shuffle(mixed)
        place = f"{tmp_path}/{trial}"
        thirds = [mixed[:45], mixed[45:90], mixed[90:]]
        got = None
        for part in thirds:  # a new start on the same checkpoint each time
            spark.createDataFrame(part, FIELDS).coalesce(1).write.mode("append").parquet(f"{place}/in")
            stream = flows.file_stream(spark, f"{place}/in", FIELDS, most_files=1).withColumn("own", keyed.own_status(F.col("score")))
            got = keyed.run(spark, stream, f"{place}/out")
        assert {(r.candidate_id, r.session_id, r.status) for r in keyed.statuses(got).collect()} == want
        counted = {(r.session_id, r.status): r.n for r in keyed.counters(got).collect()}
        assert counted == {k: sum((s, st) == k for _, s, st in want) for k in {(s, st) for _, s, st in want}}


def test_a_listener_tells_the_batches_of_a_stream(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame(rows()[i * 40 : i * 40 + 40], FIELDS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    heard = []
    watch = StreamProgress(Progress(heard.append, interval=0))
    spark.streams.addListener(watch)
    try:
        flows.drain(flows.file_stream(spark, f"{tmp_path}/in", FIELDS, most_files=1), f"{tmp_path}/out")
        end = time.time() + 60
        while time.time() < end and not any(t["status"] == "done" for t in watch.progress.transfers.values()):
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(watch)
    (transfer,) = watch.progress.transfers.values()
    assert transfer["done"] == 120 and transfer["status"] == "done"
    assert [n for _, _, n in watch.points][:3] == [40, 80, 120] and len(heard) >= 4
    told = watch.rates(spark).orderBy("at").collect()
    assert told[-1].bytes == 120 and set(told[0].asDict()) == {"transfer", "at", "bytes", "rate"}


def test_points_are_bounded():
    class Event:
        def __init__(self, i):
            self.progress = type("P", (), {"runId": "r", "numInputRows": 1, "timestamp": "2024-01-01T00:00:00.000Z", "batchDuration": i})

    watch = StreamProgress()
    watch.MOST_POINTS = 100
    watch.progress.start("r", "r", None)
    for i in range(1000):
        watch.onQueryProgress(Event(i))
    assert len(watch.points) <= 100 and watch.points[-1][2] == 1000
