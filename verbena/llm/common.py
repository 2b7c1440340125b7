"""What the corpus operators share: tables, texts as bytes, values worked out once, free column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verbena.session import Scratch, release, shared_folder, ship, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value), with value worked out once for the row, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def text_bytes(column: str = "text") -> Column:
    """The text as UTF-8 bytes; null becomes empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that df doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


#: A key is hot if more than one in so many of all rows have it. There are no more such keys than this, so a list of them is small.
HOT_KEYS = 10_000
#: No key with fewer rows than this is hot.
LEAST_HOT = 64


def dealt_join(left: DataFrame, right: DataFrame, on: str | list[str], rows: int, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """left.join(right, on, how), for a left side of so many rows of which a few keys may hold a large share.

    The rows of a hot key are dealt by hash into parts, and the rows that right has for it are given to each part. counts has the
    keys and how many rows of left have each, n; without it they are counted. how is inner, left or left_semi. Only the list of
    hot keys is broadcast, which HOT_KEYS bounds.
    """
    on = [on] if isinstance(on, str) else on
    counts = left.groupBy(*on).agg(F.count("*").alias("n")) if counts is None else counts
    most = max(LEAST_HOT, -(-rows // HOT_KEYS))
    hot = counts.where(F.col("n") > most).select(*(F.col(c).alias(f"hot_{c}") for c in on), F.ceil(F.col("n") / most).alias("hot_parts"))
    hot = F.broadcast(hot)
    same = lambda side: [side[c] == hot[f"hot_{c}"] for c in on]
    part = F.when(F.col("hot_parts").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64(F.lit("part"), *left.columns), F.col("hot_parts")))
    dealt = left.join(hot, same(left), "left").select(*left.columns, part.alias("hot_part"))
    given = right.join(hot, same(right), "left").select(*right.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("hot_parts", F.lit(1)) - 1)).alias("hot_part"))
    return dealt.join(given, [*on, "hot_part"], how).drop("hot_part")


__all__ = ["Scratch", "dealt_join", "free_name", "let", "release", "shared_folder", "ship", "table", "text_bytes", "written"]
