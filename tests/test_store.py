"""The store as a data source: what is read back, and what a failing task, an abort and a second attempt leave."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from verbena.sources import store

FIELDS = "sha256 string, name string, content binary, about string"


def rows(spark, n, start=0):
    d = spark.range(start, start + n).select(F.concat(F.lit("text "), "id").alias("t"), F.concat(F.lit("f"), "id", F.lit(".txt")).alias("name"))
    return d.select(F.sha2("t", 256).alias("sha256"), "name", F.col("t").cast("binary").alias("content"), F.when(F.col("name") != "f1.txt", F.lit('{"a":1}')).alias("about"))


def test_files_come_back_and_jobs_add_up(spark, tmp_path):
    store.register(spark)
    place = str(tmp_path / "s")
    rows(spark, 20).repartition(3).write.format(store.NAME).mode("append").save(place)
    rows(spark, 5, start=20).write.format(store.NAME).mode("append").save(place)
    got = {r.name: (bytes(r.content), r.size, os.path.exists(f"{place}/{r.path}"), os.path.exists(f"{place}/{r.path}.json")) for r in spark.read.format(store.NAME).load(place).collect()}
    assert got == {f"f{i}.txt": (f"text {i}".encode(), len(f"text {i}"), True, i != 1) for i in range(25)}
    assert len(os.listdir(f"{place}/jobs")) == 2
    spark.createDataFrame([], FIELDS).write.format(store.NAME).mode("append").save(place)
    assert spark.read.format(store.NAME).load(place).count() == 25


def test_a_task_that_fails_half_way_leaves_nothing(spark, tmp_path):
    store.register(spark)
    place = str(tmp_path / "s")
    bad = rows(spark, 40).repartition(2).withColumn("name", F.when(F.col("name") == "f33.txt", F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("name")))
    with pytest.raises(Exception, match="lost"):
        bad.write.format(store.NAME).mode("append").save(place)
    assert not os.path.exists(f"{place}/jobs")
    assert sum(len(f) for _, _, f in os.walk(place)) == 0
    assert spark.read.format(store.NAME).load(place).count() == 0

    # a driver that is lost before its commit: never read, and swept
    w = store.StoreWriter(place)
    message = w.write(iter(rows(spark, 3).collect()))
    assert message.listed and spark.read.format(store.NAME).load(place).count() == 0
    assert store.sweep(place) == 1
    # of two attempts of one task only the one that is committed is read
    w = store.StoreWriter(place)
    first, second = (w.write(iter(rows(spark, 3).collect())) for _ in range(2))
    assert first.listed != second.listed
    w.commit([second, None])
    assert spark.read.format(store.NAME).load(place).count() == 3


def test_a_task_that_outlives_an_abort_leaves_nothing(spark, tmp_path):
    place = str(tmp_path / "s")
    few = rows(spark, 6).withColumn("name", F.concat(F.lit("in/"), "name")).collect()
    for stop in range(7):
        w = store.StoreWriter(place)

        def still_running(w=w, stop=stop):
            for i, row in enumerate([*few, None]):
                if i == stop:
                    w.abort([])
                if row is not None:
                    yield row

        with pytest.raises(OSError):
            w.write(still_running())
        assert sum(len(f) for _, _, f in os.walk(place)) == 0
    assert os.listdir(f"{place}/files") == []
    w.abort([])  # again
