"""Line dedup by overlapping windows of three lines.

Lines with a word, trimmed, are taken three at a time, one window starting at each; windows equal by a 128-bit hash anywhere in
the corpus are repeats. The occurrence first by key, then by place, stays; what any later occurrence covers goes. Every distinct
line keeps the first place it has, as a line only goes where an equal one stands earlier. A text of one or two such lines is one window
of its own length, which only texts of the same lines repeat.

Style: native. Windows are written once as narrow rows; the first place of each is a pre-aggregated minimum, so a line that a
third of all documents share is a hot key only in a join, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, release, written

_SPACE = " \t\x0b\x0c\r"


def _solid(text: Column) -> Column:
    """number and text, trimmed, of the lines that have a word."""
    lines = F.split(text, "\n", -1)
    numbered = F.transform(lines, lambda line, i: F.struct(i.alias("number"), F.btrim(line, F.lit(_SPACE)).alias("line")))
    return F.filter(numbered, lambda x: x["line"] != "")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_lines (with a word), n_removed, text (what stays) for each row of docs.

    Null texts stay null, without lines; a text of one or two such lines loses them where an earlier text has just these. Null keys come first in the order.
    Rows alike in key and text are one document: each has the same result. Lines without a word always stay. Texts and lines may be
    of any length; an empty table gives an empty result. Other columns are left out, whatever their names.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.xxhash64(F.col(key), F.col(text)).alias("r"))
    hashes = F.transform(_solid(F.col("t")), lambda x: F.struct(F.xxhash64(x["line"]).alias("a"), F.xxhash64(F.lit("second"), x["line"]).alias("b")))
    per_row = rows.select("k", "r", hashes.alias("h")).where(F.size("h") > 0)
    lines = F.least(F.lit(3), F.size("h"))
    starts = F.sequence(F.lit(0), F.size("h") - lines)
    # a place past the end is null, which the hash passes over
    of = lambda i, c: F.xxhash64(*(F.get("h", i + j)[c] for j in range(3)))
    windows = per_row.select("k", "r", lines.alias("lines"), F.explode(F.transform(starts, lambda i: F.struct(i.alias("p"), of(i, "a").alias("a"), of(i, "b").alias("b")))).alias("w")).select("k", "r", "lines", "w.*")
    windows = written(windows, "windows")
    repeated = windows.groupBy("a", "b").agg(F.min(F.struct("k", "r", "p")).alias("first"), F.count("*").alias("n")).where("n > 1").select("a", "b", "first")
    later = windows.join(repeated, ["a", "b"]).where(~F.struct("k", "r", "p").eqNullSafe(F.col("first")))
    covered = later.select("k", "r", F.explode(F.sequence(F.col("p"), F.col("p") + F.col("lines") - 1)).alias("p"))
    gone = written(covered.groupBy(F.col("k").alias("k2"), F.col("r").alias("r2")).agg(F.collect_set("p").alias("gone")), "gone")
    release(windows)
    # always by a shuffle: how many texts lose lines grows with the corpus
    both = rows.join(gone.hint("merge"), (F.col("r") == F.col("r2")) & F.col("k").eqNullSafe(F.col("k2")), "left")
    numbers = F.transform(_solid(F.col("t")), lambda x: x["number"])

    def kept(v: Column) -> Column:
        stays = F.array_except(F.sequence(F.lit(0), F.size(v["lines"]) - 1), F.transform(v["gone"], lambda p: F.get(v["numbers"], p)))
        return F.array_join(F.transform(stays, lambda i: F.get(v["lines"], i)), "\n")

    return both.select(
        F.col("k").alias(key),
        F.when(F.col("t").isNull(), 0).otherwise(F.size(numbers)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("t")).otherwise(let(F.struct(F.split("t", "\n", -1).alias("lines"), numbers.alias("numbers"), "gone"), kept)).alias(text),
    )
