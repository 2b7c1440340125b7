"""A kept index of sketches against pairs made anew, and what an intake reads."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from verbena.operators import neardup
from verbena.operators.sketchindex import SketchIndex


def texts(n, seed=5):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    base = [[r.choice(words) for _ in range(60)] for _ in range(n)]
    out = [" ".join(b) for b in base]
    for b in base[: n // 3]:
        b = b[:]
        b[r.randrange(len(b))] = "changed"
        out.append(" ".join(b))
    return out + out[: n // 4]


def test_intakes_equal_a_rebuild(spark, tmp_path):
    rows = list(enumerate(texts(60)))
    sketches = neardup.signatures(spark.createDataFrame(rows, "id long, text string"), "id").cache()
    node = F.sha2(F.array_join("sketch", ","), 256)
    whole = {(r.a, r.b, r.shared, r.size) for r in neardup.near_pairs(sketches.select(node.alias("id"), "sketch").dropDuplicates(["id"])).collect()}
    assert whole
    index = SketchIndex(spark, str(tmp_path / "i"), buckets=16)
    found = set()
    for third in range(3):
        new = {(r.a, r.b, r.shared, r.size) for r in index.add(sketches.where(F.col("id") % 3 == third)).collect()}
        assert not new & found
        found |= new
    assert found == whole
    assert index.add(sketches).count() == 0  # all is held
    assert {r.id for r in index.read("members").collect()} == {str(r.id) for r in sketches.select("id").collect()}
    before = {(r.node, tuple(r.sketch)) for r in index.read("nodes").collect()}
    seen = index.parts()
    index.compact()
    assert len(index.parts()) == 1 and not set(index.parts()) & set(seen)
    assert {(r.node, tuple(r.sketch)) for r in index.read("nodes").collect()} == before


def test_an_intake_reads_only_its_buckets(spark, tmp_path):
    rows = list(enumerate(texts(40)))
    sketches = neardup.signatures(spark.createDataFrame(rows, "id long, text string"), "id")
    index = SketchIndex(spark, str(tmp_path / "i"), buckets=64)
    index.add(sketches.where("id > 0"))
    one = sketches.where("id = 0").select(F.lit("n").alias("node"), F.lit("0").alias("rep"), "sketch")
    hit = index._hit(index._prefixes(one))
    assert 0 < len(hit) < 30
    read = index.read("prefixes", hit)
    assert {r.bucket for r in read.collect()} == set(hit)
    scan = read._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numFiles").value() == len(hit)  # one file for each bucket, no other is opened


def test_copies_are_members_and_a_part_without_marker_is_not_read(spark, tmp_path):
    text = " ".join(f"x{i}" for i in range(50))
    copies = spark.range(10_000).select("id", F.lit(text).alias("text"))
    index = SketchIndex(spark, str(tmp_path / "i"), buckets=4)
    assert index.add(neardup.signatures(copies, "id")).count() == 0
    assert index.read("members").count() == 10_000
    assert index.read("nodes").count() == 1

    broken = neardup.signatures(copies.where("id < 5").select((F.col("id") + 20_000).alias("id"), F.concat(F.lit("other "), "text", F.lit(" y"), F.col("id")).alias("text")), "id")
    real = index._put
    index._put = lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        index.add(broken)
    index._put = real
    assert index.read("members").count() == 10_000
    assert index.add(broken).count() > 0
    assert index.read("members").count() == 10_005
