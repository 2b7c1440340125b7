"""Near duplicates by bottom-k sketches, losslessly: pairs that reach the threshold share one of the rarest few hashes of both."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbena.functions.text import signature, sketch_shared, sketch_union, tokens
from verbena.session import ship, written

try:
    from _md5 import md5  # Python's own form takes less than half the time of OpenSSL's for short texts
except ImportError:
    from hashlib import md5


def bottom_hashes(words: str, k: int = 128, size: int = 5) -> list[str] | None:
    """signature() of words with single blanks between them: runs of words are slices of the text."""
    said = words.encode()
    parts = said.split(b" ")
    if len(parts) < 4 * size:
        return None
    starts = list(accumulate(map(len, parts), lambda at, n: at + n + 1, initial=0))
    digests = b"".join([md5(said[a : b - 1]).digest() for a, b in zip(starts, starts[size:], strict=False)])
    first = np.unique(np.frombuffer(digests, ">u8")[::2].astype(np.uint64))[:k]
    return [f"{h:016x}" for h in first.tolist()]


def signatures(texts: DataFrame, key: str, text: str = "text", k: int = 128) -> DataFrame:
    """id, sketch: signature() of the texts that have one. Spark finds the words; the hashes are worked out in Arrow batches, as expressions take many times as long for them."""
    ship(texts.sparkSession)
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sketches = pa.array([bottom_hashes(w.as_py(), k) for w in b.column(1)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), sketches], names=["id", "sketch"])

    words = texts.select(F.col(key).alias("id"), F.array_join(tokens(F.col(text)), " ").alias("words"))
    return words.mapInArrow(run, f"id {kind}, sketch array<string>").where("sketch IS NOT NULL")


def near_pairs(sketches: DataFrame, threshold: float = 0.85, k: int = 128, fresh: DataFrame | None = None) -> DataFrame:
    """a, b (a before b), shared, size: pairs of different sketches whose estimate shared / size reaches the threshold.

    sketches: id, sketch, one row for each different sketch (see sketch_classes). fresh (id): only pairs with one of these are sought.
    Integers are compared, not quotients.

    What a pair shares of the union's first k hashes is in both sketches, so a pair that reaches the threshold shares that share of the larger
    sketch at least, and one of the first n - ceil(threshold * n) + 1 of its n hashes, in any common order. The order is by how many sketches have a hash, rarest
    first: a hash of a passage that very many texts hold is in few prefixes, and meets only sketches of a size that fits.
    """
    sketches = written(sketches, "sketches")  # read several times below
    keep = Decimal(str(threshold))
    spread = sketches.select("id", F.size("sketch").alias("n"), F.explode("sketch").alias("h"))
    often = spread.groupBy("h").agg(F.count("*").alias("often"))
    order = F.transform(F.sort_array(F.collect_list(F.struct("often", "h"))), lambda x: x["h"])
    first = spread.join(often.where("often > 1"), "h").groupBy("id", "n").agg(order.alias("hs"))
    # hashes that no other sketch has come first in the order, and need no row
    alone = F.col("n") - F.size("hs")
    length = F.col("n") - F.ceil(F.col("n") * F.lit(keep)) + 1
    prefix = first.select("id", "n", alone.alias("alone"), F.posexplode(F.slice("hs", 1, F.greatest(F.lit(0), length - alone).cast("int"))).alias("at", "h"))
    prefix = written(prefix.select("id", "n", (F.col("at") + F.col("alone") + 1).alias("at"), "h"), "prefixes")
    x, y = (prefix.select("h", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "at"))) for s in "xy")
    most = F.greatest("n_x", "n_y") * F.lit(keep)
    ordered = F.col("id_x") < F.col("id_y") if fresh is None else F.col("id_x") != F.col("id_y")
    if fresh is not None:
        x = x.join(fresh.select(F.col("id").alias("id_x")), "id_x", "left_semi")
    met = x.join(y, "h").where(ordered & (F.least("n_x", "n_y") >= most) & (1 + F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y")) >= most))
    pairs = met.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()
    side = lambda x: sketches.select(F.col("id").alias(x), F.col("sketch").alias(f"s{x}"))
    wide = pairs.join(side("a"), "a").join(side("b"), "b")
    measured = wide.select("a", "b", sketch_shared(F.col("sa"), F.col("sb"), k).cast("long").alias("shared"), F.size(sketch_union(F.col("sa"), F.col("sb"), k)).cast("long").alias("size"))
    percent = round(threshold * 10000)
    return measured.where(F.col("shared") * 10000 >= F.col("size") * percent)


def sketch_classes(sketches: DataFrame) -> DataFrame:
    """id, class: texts with equal sketches, each class named by its least id; near_pairs() then needs one of each."""
    sketches = written(sketches, "sketches")  # making sketches is the costly part
    classes = sketches.groupBy("sketch").agg(F.min("id").alias("class"))
    return sketches.join(classes, "sketch").select("id", "class", "sketch")


def sketch_notes(resources: DataFrame, k: int = 128) -> DataFrame:
    """id, sketch, note from id, category, text: why a resource has no sketch. Images and sound would need decoders."""
    from pyspark.sql import Column

    s: Column = signature(tokens(F.col("text")), k)
    note = (
        F.when(F.col("category") == "images", "image signatures need an image decoder").when(F.col("category").isin("audio", "video"), "audio signatures need a decoder")
        .when(F.coalesce("text", F.lit("")) == "", "no text").when(s.isNull(), "too little text for a signature").otherwise("")
    )
    return resources.select("id", F.when(~F.col("category").isin("images", "audio", "video"), s).alias("sketch"), note.alias("note"))
