"""Which of very many terms a text holds: an automaton reads each text once, whatever the number of terms.

Terms go to the executors in blocks of at most BLOCK, each a broadcast of that many short strings; a task builds a block's automaton once. Texts stay where they are: no
shuffle, no row for each word.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from verbena.session import ship

#: Terms of one automaton: some 100 MB of a worker's memory.
BLOCK = 200_000


def automaton(terms: list[str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for folded in terms:
        a.add_word(folded, folded)
    a.make_automaton()
    return a


def found(a: ahocorasick.Automaton, blob: str) -> dict[str, bool]:
    """The terms in a folded text, and whether they stand there as whole words: between blanks or the text's ends."""
    out: dict[str, bool] = {}
    n = len(blob)
    for end, term in a.iter(blob):
        if not out.get(term):
            start = end + 1 - len(term)
            out[term] = (start == 0 or blob[start - 1] == " ") and (end + 1 == n or blob[end + 1] == " ")
    return out


def _blocks(terms: DataFrame) -> Iterator[list[str]]:
    """The distinct folded terms, BLOCK at a time."""
    rows = (r.folded for r in terms.where("folded <> ''").select("folded").distinct().orderBy("folded").toLocalIterator())
    while block := list(islice(rows, BLOCK)):
        yield block


def term_hits(texts: DataFrame, key: str, fields: list[str], terms: DataFrame) -> DataFrame:
    """key, field, folded, whole: for each text (key and folded fields) the terms (folded) in its fields, each once for a field.

    Null and empty fields hold nothing; empty terms are in nothing. Repeated keys give their rows each.
    """
    spark = texts.sparkSession
    ship(spark)
    kind = texts.schema[key].dataType.simpleString()
    shape = f"`{key}` {kind}, field string, folded string, whole boolean"
    schema = to_arrow_schema(StructType.fromDDL(shape))
    out = spark.createDataFrame([], shape)
    for block in _blocks(terms):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            a = automaton(sent.value)  # once for each task
            for b in batches:
                held = []
                for k, *blobs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    for name, blob in zip(fields, blobs, strict=True):
                        held += [{key: k, "field": name, "folded": t, "whole": whole} for t, whole in found(a, blob or "").items()]
                yield pa.RecordBatch.from_pylist(held, schema=schema)

        out = out.unionByName(texts.select(key, *fields).mapInArrow(run, shape))
    return out
