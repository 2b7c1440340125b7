"""Mixing sources to target weights by dependent rounding.

Each source gets a target number of words; each of its documents the same expected number of copies, target / source size. Whole
copies are given at once. What is left of each document, a fraction, is rounded by pivoting: two documents meet, and words
move between them, by chance and without bias, until one of them has a whole number of copies; the other meets the next. The
words of the two stay the same in sum, so a source's mix misses its target by less than one document.

The meetings form a tree: documents are dealt by hash into small groups, each group leaves at most one document with a
fraction, and these meet in the next level, and so on; the number of levels grows with the logarithm of the largest source.
Groups are bounded by the dealing, so a source with a third of all rows is spread like any other.

Style: native. DataFrame functions only: word counts by regular expression, folds of small arrays inside the groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, let, written

#: Words are runs of anything but these.
WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a group, about, in the first level; exactly in the others.
GROUP = 32


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """source, source_size, target from source, source_size.

    Sources in code point order, null last, take the weights in turn; their targets are in proportion to these and make up share of
    all words, but none is above most times its source's size. What is cut off goes to the others by weight.

    Sources are put in order in one task, which sees a name and four numbers of each: that serves ten million of them. Only words are
    counted over all rows, and that is pre-aggregated.
    """
    everything = Window.partitionBy()
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sizes.withColumn("turn", turn).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("turn") % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("cap", F.col("source_size").cast("double") * most)
    # full at the lowest water level first: with those before a source full, would the level fill it, too?
    before = Window.orderBy(F.col("cap") / F.col("w"), "turn").rowsBetween(Window.unboundedPreceding, -1)
    words, weight = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.coalesce(F.sum("w").over(before), F.lit(0.0))
    s = s.withColumn("level", (F.sum("source_size").over(everything) * F.lit(share) - words) / (F.sum("w").over(everything) - weight))
    s = s.withColumn("full", F.col("cap") <= F.col("level") * F.col("w"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    return s.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(level * F.col("w")).alias("target"))


def _chance(*parts: Column) -> Column:
    """A number from 0 to 1 that only the parts decide."""
    return (F.xxhash64(*parts).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))).cast("double")


_UNIT = "struct<h:bigint,key:{key},source:string,size:bigint,rows:bigint,whole:bigint,part:double>"


def _meet(state: Column, x: Column, unit: str) -> Column:
    """state (cur: the one with a fraction, if any; done: those without) after x has met cur."""
    def pivot(v: Column) -> Column:
        a, b = v["a"], v["b"]
        room_a, have_a = (1 - a["part"]) * a["size"], a["part"] * a["size"]
        room_b, have_b = (1 - b["part"]) * b["size"], b["part"] * b["size"]

        def moved(m: Column) -> Column:
            to_a = _chance(a["h"], b["h"]) * (m["up"] + m["down"]) < m["down"]
            part_a = F.when(to_a, F.when(room_a <= have_b, 1.0).otherwise(a["part"] + m["up"] / a["size"])).otherwise(F.when(have_a <= room_b, 0.0).otherwise(a["part"] - m["down"] / a["size"]))
            part_b = F.when(to_a, F.when(have_b <= room_a, 0.0).otherwise(b["part"] - m["up"] / b["size"])).otherwise(F.when(room_b <= have_a, 1.0).otherwise(b["part"] + m["down"] / b["size"]))
            return F.struct(a.withField("part", part_a).alias("a"), b.withField("part", part_b).alias("b"))

        return let(F.struct(F.least(room_a, have_b).alias("up"), F.least(have_a, room_b).alias("down")), moved)

    def settle(v: Column) -> Column:
        open_a, open_b = ((v[k]["part"] > 1e-9) & (v[k]["part"] < 1 - 1e-9) for k in "ab")
        none = F.array().cast(f"array<{unit}>")
        shut = F.concat(F.when(open_a, none).otherwise(F.array(v["a"])), F.when(open_b, none).otherwise(F.array(v["b"])))
        return F.struct(F.when(open_a, v["a"]).when(open_b, v["b"]).cast(unit).alias("cur"), F.concat(state["done"], shut).alias("done"))

    return F.when(state["cur"].isNull(), F.struct(x.alias("cur"), state["done"].alias("done"))).otherwise(let(let(F.struct(state["cur"].alias("a"), x.alias("b")), pivot), settle))


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """key, source, size (words), rows (with this key, source and size), source_size, target, copies (of these rows in all).

    Null and empty texts have no words, and null keys and sources are values like others. Rows alike in key, source and size
    are rounded as one. Reruns agree: chance comes from hashes of key and size. Texts may be of any length. An empty table gives an empty result. Other columns are
    left out, whatever their names.
    """
    kind = docs.schema[key].dataType.simpleString()
    unit = _UNIT.format(key=kind)
    words = docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), n_words(text).alias("size"))
    sized = written(words.groupBy("key", "source", "size").agg(F.count("*").alias("rows")), "sizes")
    goals = targets(sized.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).cast("long").alias("source_size")), weights, share, most)
    goals = written(goals.withColumnRenamed("source", "of"), "targets")
    known = F.col("source").eqNullSafe(F.col("of"))
    placed = sized.join(goals, known).drop("of")
    wanted = F.when(F.col("size") > 0, F.col("rows") * F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    placed = placed.withColumn("wanted", wanted).withColumn("whole", F.floor("wanted")).withColumn("part", F.col("wanted") - F.col("whole"))
    whole_only = (F.col("part") <= 1e-9) | (F.col("part") >= 1 - 1e-9)
    columns = ["key", "source", "size", "rows"]
    settled = placed.where(whole_only).select(*columns, F.round("wanted").cast("long").alias("copies"))
    open_ = placed.where(~whole_only).select("source", F.struct(F.xxhash64("key", "source", "size").alias("h"), "key", "source", "size", "rows", "whole", "part").cast(unit).alias("x"))
    largest = sized.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    groups = max(1, -(-largest // GROUP))
    level = open_.withColumn("g", F.pmod(F.xxhash64(F.col("x.h"), F.lit("group")), F.lit(groups)))
    start = F.struct(F.lit(None).cast(unit).alias("cur"), F.array().cast(f"array<{unit}>").alias("done"))
    while True:
        fold = F.aggregate(F.sort_array(F.collect_list("x")), start, lambda s, x: _meet(s, x, unit))
        folded = written(level.groupBy("source", "g").agg(fold.alias("f")).select("source", "g", "f.*"), "level")
        shut = folded.select(F.explode("done").alias("x"))
        settled = settled.union(shut.select(*(f"x.{c}" for c in columns), (F.col("x.whole") + F.round("x.part").cast("long"))))
        level = folded.where("cur IS NOT NULL").select("source", F.col("cur").alias("x"), F.floor(F.col("g") / GROUP).alias("g"))
        if groups == 1:
            break
        groups = -(-groups // GROUP)
    last = level.select("x.*").withColumn("copies", F.col("whole") + (_chance(F.col("h"), F.lit("last")) < F.col("part")).cast("long"))
    settled = settled.union(last.select(*columns, "copies"))
    out = settled.join(goals, known).drop("of")
    return out.select(F.col("key").alias(key), F.col("source").alias(source), "size", "rows", "source_size", "target", "copies")


def _own_copies(copies: Column, rows: Column, number: Column) -> Column:
    """Of the copies of so many alike rows, those of the row with that number, from 1."""
    return F.floor(copies / rows) + (number <= copies % rows).cast("long")


def mix_report(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """mixed() with a row for each row of docs: its copies and taken, the words that the mix takes of it."""
    m = mixed(docs, key, source, text, **options)
    each = m.withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    each = each.withColumn("copies", _own_copies(F.col("copies"), F.col("rows"), F.col("number")))
    return each.select(key, source, "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def take_mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The mix itself: the rows of docs, all columns, each as often as its copies say. Rows without words go."""
    m = mixed(docs, key, source, text, **options).where("copies > 0").select(F.col(key).alias("mix_key"), F.col(source).alias("mix_source"), F.col("size").alias("mix_size"), F.col("rows").alias("mix_rows"), F.col("copies").alias("mix_copies"))
    names = {c: free_name(docs, c) for c in m.columns}
    m = m.withColumnsRenamed(names)
    own, number = free_name(docs, "own_size"), free_name(docs, "own_number")
    d = docs.withColumn(own, n_words(text))
    both = d.join(m, d[key].eqNullSafe(m[names["mix_key"]]) & d[source].cast("string").eqNullSafe(m[names["mix_source"]]) & (d[own] == m[names["mix_size"]]))
    alike = Window.partitionBy(names["mix_key"], names["mix_source"], names["mix_size"]).orderBy(F.col(text))
    both = both.withColumn(number, F.row_number().over(alike))
    times = _own_copies(F.col(names["mix_copies"]), F.col(names["mix_rows"]), F.col(number))
    repeated = both.withColumn(number, F.explode(F.array_repeat(F.lit(1), times.cast("int"))))
    return repeated.select(*[docs[c] for c in docs.columns])
