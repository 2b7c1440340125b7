"""Connected components of links, as joins and aggregations only.

Alternating star contraction: each node points its larger neighbours to the least node it knows, then its smaller ones; the
number of rounds grows with the logarithm of a class's diameter, chains of copies included. No links reach the driver; each
round is written, so a lost executor costs one round at most. The centre of a large class has a row for each of its members: such
keys are counted, and dealt_join() spreads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt_join, release, written


def _large(e: DataFrame, rows: int) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    known = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    least = known.select("u", F.least("u", "m").alias("m"))
    return dealt_join(both, least, "u", 2 * rows, counts=known).where("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(e: DataFrame, rows: int) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    known = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    least = known.select("u", "m")
    across = dealt_join(down, least, "u", rows, counts=known).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return across.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int | None = None) -> DataFrame:
    """node, label: each node of links and the least node of its class. Loops and repeated links don't matter.

    With rounds, it stops after so many: labels are then of the same class, but a class may still have several.
    """
    e = written(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    rows = e.count()
    state, done = None, 0
    while rows and done != rounds:
        after = written(_small(_large(e, rows), rows), "links")
        release(e)
        e = after
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state or now[0] == 0:
            break
        state, done, rows = now, done + 1, now[0]
    down = e.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("label"))
    return down.union(down.select(F.col("label").alias("node"), "label")).groupBy("node").agg(F.min("label").alias("label"))
