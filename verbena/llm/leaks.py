"""Benchmark decontamination by winnowing.

Both sides are cut into grams of `gram` words; of each window of `window - gram + 1` consecutive grams the smallest hash is
a fingerprint. A span of at least `window` words that both sides share holds such a window whole, so both sides keep the same
fingerprint of it: no such span can be missed. Items of fewer words are one window of their own length; for each such length that the
benchmark has (there are window - 1 at most) the same is done with grams of at most that length.

1. The fingerprints of both sides are joined. Only documents with a fingerprint of the benchmark, the seeds, go on.
2. Each seed is extended: every window that holds it is taken from the document's words, and likewise from the items', and these windows
   are joined by a 128-bit hash of the words themselves. Runs of windows found make the spans, of any length. A document or item that
   repeats itself has few different fingerprints and windows, with places as runs, so the work stays linear in the texts.

Style: free (mapInArrow cuts and hashes; joins and aggregations do the rest). Nothing of the benchmark or the documents reaches the driver but
the distinct lengths of short items. No side is broadcast by order: Spark does so where the benchmark's fingerprints, or the seeds, are
small by its own threshold, and shuffles otherwise; whole texts are shuffled at most once, and only where the documents with seeds are
too many to broadcast their hashes. What is found is written, so a lost executor costs tasks of one step.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, free_name, ship, text_bytes, written
from .wordhash import ALNUM, gram_hashes, word_hashes

#: The words of bytes whose A-Z are lower case, and of a string as it is.
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprints(grams: np.ndarray, width: int) -> np.ndarray:
    """Places of the grams that are the least of some window of that width; ties all count."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = grams[:n].copy()
    for d in range(1, width):
        np.minimum(least, grams[d : d + n], out=least)
    chosen = np.zeros(len(grams), bool)
    for d in range(width):
        chosen[d : d + n] |= grams[d : d + n] == least
    return np.flatnonzero(chosen)


def prints(words: np.ndarray, lengths: list[int], gram: int) -> np.ndarray:
    """The distinct fingerprints of the words, for windows of each of these lengths."""
    parts = [np.zeros(0, np.uint64)]
    for n in lengths:
        if len(words) >= n:
            grams = gram_hashes(words, min(gram, n))
            parts.append(grams[fingerprints(grams, n - min(gram, n) + 1)])
    return np.unique(np.concatenate(parts))


def seeded_windows(text: bytes, seeds: np.ndarray, lengths: list[int], gram: int) -> dict[bytes, list[tuple[int, int]]]:
    """A hash of the words of each window that holds a seed, and the spans of words, end exclusive, that its occurrences cover."""
    hashes = word_hashes(text, ALNUM, lower=True)
    words = _WORDS.findall(text.translate(_LOWER))
    out: dict[bytes, list[tuple[int, int]]] = {}
    for n in lengths:
        g = min(gram, n)
        if len(words) < n:
            continue
        edge = np.zeros(len(words) - n + 2, np.int64)
        at = np.flatnonzero(np.isin(gram_hashes(hashes, g), seeds))
        np.add.at(edge, np.maximum(at - (n - g), 0), 1)
        np.add.at(edge, np.minimum(at, len(words) - n) + 1, -1)
        for p in np.flatnonzero(np.cumsum(edge[:-1]) > 0).tolist():
            spans = out.setdefault(hashlib.blake2b(b" ".join(words[p : p + n]), digest_size=16).digest(), [])
            if spans and spans[-1][1] >= p:
                spans[-1] = (spans[-1][0], p + n)
            else:
                spans.append((p, p + n))
    return out


def _text_ids(text: str) -> list[Column]:
    """t1, t2: two hashes that stand for a text. Texts alike are judged once."""
    return [F.xxhash64(F.lit(mark), F.col(text)).alias(mark) for mark in ("t1", "t2")]


def _windows_of(sides: DataFrame, gram: int) -> DataFrame:
    """The columns of sides but the last three (text, seeds, lengths of windows), then window and spans, a row for each window that holds a seed."""
    schema = T.StructType([*sides.schema.fields[:-3], T.StructField("window", T.BinaryType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (text, seeds, lengths) in enumerate(zip(*b.columns[-3:], strict=True)):
                found = seeded_windows(text.as_py(), np.array(seeds.as_py(), np.int64).view(np.uint64), lengths.as_py(), gram)
                if found:
                    own = [c.take(pa.array([i] * len(found))) for c in b.columns[:-3]]
                    spans = [[{"start": s, "end": e} for s, e in x] for x in found.values()]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(list(found), pa.binary()), pa.array(spans, span)], names=schema.names)

    return sides.mapInArrow(run, schema)


def _hits(docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str, window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Of the texts in which a window of an item occurs: t1, t2, start, end of the spans; and t1, t2, item, a row for each item."""
    ship(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, found = [], []
            for x in b.column(1):
                words = word_hashes(x.as_py(), ALNUM, lower=True)
                sizes.append(min(window, len(words)))
                found.append(prints(words, [sizes[-1]], gram).view(np.int64) if sizes[-1] else [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["item", "body", "size", "prints"])

    items = benchmark.select(F.col(item).cast("string").alias("item"), text_bytes(item_text).alias("body"))
    items = written(items.mapInArrow(cut, "item string, body binary, size long, prints array<long>").where("size > 0"), "items")
    lengths = sorted(r["size"] for r in items.select("size").distinct().collect())
    sought = items.select(F.explode("prints").alias("print")).distinct()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [prints(word_hashes(x.as_py(), ALNUM, lower=True), lengths, gram).view(np.int64) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int64()))], names=["t1", "t2", "prints"])

    bodies = docs.select(*_text_ids(text), text_bytes(text).alias("body"))
    met = bodies.mapInArrow(search, "t1 long, t2 long, prints array<long>").select("t1", "t2", F.explode("prints").alias("print")).join(sought, "print")
    seeds = written(met.groupBy("t1", "t2").agg(F.collect_set("print").alias("seeds")), "seeds")
    sizes = F.array(*(F.lit(n).cast("long") for n in lengths)).cast("array<bigint>")
    windows = _windows_of(bodies.join(seeds, ["t1", "t2"]).withColumn("lengths", sizes), gram).select("t1", "t2", "window", F.explode("spans").alias("s"))
    windows = windows.select("t1", "t2", "window", "s.start", "s.end").distinct()

    # windows that the same items have share a set of items
    by_window = _windows_of(items.select("item", "body", F.col("prints").alias("seeds"), F.array("size").alias("lengths")), gram).select("window", "item").distinct()
    by_window = by_window.groupBy("window").agg(F.sort_array(F.collect_list("item")).alias("items"))
    by_window = written(by_window.withColumn("shared", F.md5(F.to_json("items").cast("binary"))), "windows")
    hits = written(windows.join(by_window.select("window", "shared"), "window").select("t1", "t2", "start", "end", "shared").distinct(), "hits")
    sets = by_window.groupBy("shared").agg(F.first("items").alias("items"))
    named = hits.select("t1", "t2", "shared").distinct().join(sets, "shared").select("t1", "t2", F.explode("items").alias("item")).distinct()
    return hits.select("t1", "t2", "start", "end").distinct(), named


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, gram: int = 5) -> DataFrame:
    """key, n_words, hit_spans (merged, by word) and hit_items (distinct ids, sorted) for each row of docs.

    Null and empty texts have no words and no hits. An item with a null id marks words but is not listed. Repeated rows and keys
    are judged each alone; an empty benchmark leaves every document clean, and an empty table gives an empty result. Texts may be
    of any length. Other columns are left out, whatever their names. A document's spans and
    items are gathered in one row: no more than its words, and than the benchmark's items.
    """
    with Scratch() as scratch:
        spans, named = _hits(docs, benchmark, text, item, item_text, window, gram)
        # gaps between the spans of a text: a span opens an island where it starts after all before it have ended
        by_place = Window.partitionBy("t1", "t2").orderBy("start", "end")
        spans = spans.withColumn("before", F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1)))
        spans = spans.withColumn("island", F.sum(F.when(F.col("before").isNull() | (F.col("start") > F.col("before")), 1).otherwise(0)).over(by_place))
        islands = spans.groupBy("t1", "t2", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        islands = islands.groupBy("t1", "t2").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("hit_spans"))
        items = named.groupBy("t1", "t2").agg(F.sort_array(F.collect_list("item")).alias("hit_items"))
        found = scratch.keep(written(islands.join(items, ["t1", "t2"], "left"), "leaks"))
    count = F.coalesce(F.regexp_count(F.col(text), F.lit(_WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(key), count.alias("n_words"), *_text_ids(text)).join(found, ["t1", "t2"], "left")
    none = F.array().cast(found.schema["hit_spans"].dataType)
    return rows.select(F.col(key), "n_words", F.coalesce("hit_spans", none).alias("hit_spans"), F.coalesce("hit_items", F.array().cast("array<string>")).alias("hit_items"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, gram: int = 5) -> DataFrame:
    """The rows of docs, all columns, in whose text no item's window occurs. Null and empty texts stay; an empty benchmark takes nothing."""
    with Scratch() as scratch:
        spans, _ = _hits(docs, benchmark, text, item, item_text, window, gram)
        gone = scratch.keep(written(spans.select("t1", "t2").distinct(), "gone"))
    names = [free_name(docs, "t1"), free_name(docs, "t2")]
    marked = docs.select("*", *(c.alias(n) for c, n in zip(_text_ids(text), names, strict=True)))
    return marked.join(gone.toDF(*names), names, "left_anti").select(*docs.columns)
