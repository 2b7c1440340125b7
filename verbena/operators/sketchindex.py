"""An index of sketches that stays on disk: new sketches meet only what may be near them, whatever is held.

Texts with equal sketches are one node, named by the hash of its sketch, so copies are members of a node and never pairs. Of each node the prefix is
kept: the hashes of which a node that is near enough must share one (see neardup.near_pairs). The order that prefixes follow is frozen when the index
is made: common hashes by how many sketches had them then, after all others; any later hash counts as rare. A frozen order keeps every prefix right for good;
it only makes fewer candidates the better it fits, so remake() may be called when the collection has changed much.

On disk an index is a list of parts, each the nodes, prefixes and members of one intake in folders by bucket, so an intake reads the buckets that its
own prefixes fall into and no others. A part counts once its marker is there, which is written last; a marker also names the parts it takes the place
of. A task or driver that fails leaves a part without a marker, which nobody reads.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verbena.functions.text import sketch_shared, sketch_union
from verbena.session import written

#: A hash that so many sketches have is common.
COMMON = 4
FIELDS = {
    "nodes": "node string, rep string, sketch array<string>, bucket int",
    "prefixes": "h string, at int, n int, node string, bucket int",
    "members": "id string, node string, bucket int",
}


class SketchIndex:
    def __init__(self, spark: SparkSession, place: str, threshold: float = 0.85, k: int = 128, buckets: int = 64):
        self.spark, self.place, self.threshold, self.k, self.buckets = spark, place.rstrip("/"), threshold, k, buckets
        path = spark._jvm.org.apache.hadoop.fs.Path(self.place)
        self._fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    # ------------------------------------------------------------ parts
    def _path(self, name: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.place}/{name}")

    def _put(self, name: str, text: str) -> None:
        """A small file, there as a whole or not at all."""
        aside = self._path(f"_aside/{uuid.uuid4().hex}")
        out = self._fs.create(aside, True)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.mkdirs(self._path(name).getParent())
        self._fs.rename(aside, self._path(name))

    def parts(self) -> list[str]:
        """The parts that count, in no order."""
        if not self._fs.exists(self._path("markers")):
            return []
        named = {}
        for s in self._fs.listStatus(self._path("markers")):
            stream = self._fs.open(s.getPath())
            named[s.getPath().getName()] = json.loads(bytes(stream.readAllBytes()).decode())
            stream.close()
        gone = {p for replaced in named.values() for p in replaced}
        return sorted(set(named) - gone)

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table of all parts, or only its rows in some buckets: their folders alone are read."""
        out = None
        for p in self.parts():
            t = self.spark.read.schema(FIELDS[name]).parquet(f"{self.place}/parts/{p}/{name}")
            t = t if buckets is None else t.where(F.col("bucket").isin(buckets))
            out = t if out is None else out.unionByName(t)
        return self.spark.createDataFrame([], FIELDS[name]) if out is None else out

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int").alias("bucket")

    def _lay(self, part: str, name: str, rows: DataFrame) -> DataFrame:
        """rows written as a table of a part, one file for each bucket, and read again. Nobody else reads them before the part's marker is there."""
        place = f"{self.place}/parts/{part}/{name}"
        rows.repartition(self.buckets, "bucket").write.partitionBy("bucket").parquet(place, compression="zstd")
        return self.spark.read.schema(rows.schema).parquet(place)

    def _mark(self, part: str, replaced: list[str]) -> None:
        self._put(f"markers/{part}", json.dumps(replaced))

    # ------------------------------------------------------------ order
    def _order(self) -> DataFrame:
        """h, often of the common hashes, as they were when the index was made."""
        fields = "h string, often bigint"
        return self.spark.read.schema(fields).parquet(f"{self.place}/order") if self._fs.exists(self._path("order/_SUCCESS")) else self.spark.createDataFrame([], fields)

    def _prefixes(self, nodes: DataFrame) -> DataFrame:
        """h, at (from 1), n, node, bucket: the first n - ceil(threshold * n) + 1 hashes of each node in the frozen order.

        nodes may have number, a short name. Hashes that are not common need no row: they come first, as they stand in the sketch; only the common ones go back to their node.
        """
        name = "number" if "number" in nodes.columns else "node"
        spread = nodes.select(name, F.explode("sketch").alias("h")).join(self._order(), "h")
        common = spread.groupBy(name).agg(F.sort_array(F.collect_list(F.struct("often", "h")))["h"].alias("common"))
        held = F.coalesce("common", F.array().cast("array<string>"))
        n = F.size("sketch")
        length = n - F.ceil(n * F.lit(Decimal(str(self.threshold)))) + 1
        hs = F.concat(F.sort_array(F.array_except("sketch", held)), held)
        first = nodes.join(common, name, "left").select("node", n.alias("n"), F.posexplode(F.slice(hs, 1, length.cast("int"))).alias("at", "h"))
        return first.select("h", (F.col("at") + 1).cast("int").alias("at"), F.col("n").cast("int").alias("n"), "node").withColumn("bucket", self._bucket("h"))

    # ------------------------------------------------------------ intake
    def add(self, sketches: DataFrame, sink: Callable[[DataFrame, DataFrame], None] | None = None) -> DataFrame:
        """Take in sketches (id, sketch); a, b (a before b), shared, size, rep_a, rep_b of the pairs of nodes that are near and of which one is new.

        An id that is held already stays with the node that it had. Null sketches have no node. rep is a node's first text. sink gets the
        pairs and the new texts of nodes (id, rep) before the part counts: if it fails, or what comes after it, the same sketches may be added again.
        sketches is read several times, so it has to be a table on disk (see written()), not one that is costly to work out.
        """
        given = sketches.where("sketch IS NOT NULL").select(F.col("id").cast("string").alias("id"), "sketch", F.sha2(F.array_join("sketch", ","), 256).alias("node"))
        part = uuid.uuid4().hex
        members = given.groupBy("id").agg(F.min("node").alias("node")).withColumn("bucket", self._bucket("id"))
        held = self.read("members", self._hit(members)).select("id")
        members = self._lay(part, "members", members.join(held, "id", "left_anti"))
        # a node is the hash of its sketch, so the sketch of any row will do: sketches are shuffled once, and copies are one row by then
        touched = members.groupBy("node").agg(F.min("id").alias("rep")).withColumn("bucket", self._bucket("node"))
        known = self.read("nodes", self._hit(touched)).select("node")
        sketch = given.groupBy("node").agg(F.first("sketch").alias("sketch"))
        nodes = touched.join(known, "node", "left_anti").join(sketch, "node").select("node", "rep", "sketch", "bucket", F.monotonically_increasing_id().alias("number"))
        numbered = self._lay(part, "nodes", nodes)
        nodes = numbered.drop("number")
        if not self.parts() and not self._fs.exists(self._path("order/_SUCCESS")):
            often = nodes.select(F.explode("sketch").alias("h")).groupBy("h").agg(F.count("*").alias("often"))
            often.where(F.col("often") >= COMMON).write.mode("overwrite").parquet(f"{self.place}/order")
        prefixes = self._lay(part, "prefixes", self._prefixes(numbered))
        old = self.read("prefixes", self._hit(prefixes))
        pairs = written(self._pairs(prefixes, old).unionByName(self._pairs(prefixes, prefixes)).distinct(), "pairs")
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("bucket", self._bucket("node"))
        bodies = self.read("nodes", self._hit(ends)).unionByName(nodes).join(ends.select("node"), "node", "left_semi")
        near = written(self._near(pairs, bodies), "near")
        if sink is not None:
            reps = self.read("nodes", self._hit(touched)).unionByName(nodes).select("node", "rep")
            sink(near, members.join(reps, "node").where("id <> rep").select("id", "rep"))
        self._mark(part, [])
        return near

    def _hit(self, rows: DataFrame) -> list[int]:
        """The buckets of rows: numbers under self.buckets, so the list is small."""
        return sorted(r.bucket for r in rows.select("bucket").distinct().collect())

    def _pairs(self, new: DataFrame, other: DataFrame) -> DataFrame:
        side = lambda t, s: t.select("h", "bucket", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "at")))
        most = F.greatest("n_x", "n_y") * F.lit(Decimal(str(self.threshold)))
        met = side(new, "x").join(side(other, "y"), ["h", "bucket"]).where((F.col("node_x") != F.col("node_y")) & (F.least("n_x", "n_y") >= most) & (1 + F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y")) >= most))
        return met.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()

    def _near(self, pairs: DataFrame, bodies: DataFrame) -> DataFrame:
        side = lambda x: bodies.select(F.col("node").alias(x), F.col("rep").alias(f"rep_{x}"), F.col("sketch").alias(f"s{x}"))
        wide = pairs.join(side("a"), "a").join(side("b"), "b")
        measured = wide.select("a", "b", "rep_a", "rep_b", sketch_shared(F.col("sa"), F.col("sb"), self.k).cast("long").alias("shared"), F.size(sketch_union(F.col("sa"), F.col("sb"), self.k)).cast("long").alias("size"))
        return measured.where(F.col("shared") * 10000 >= F.col("size") * round(self.threshold * 10000))

    def members(self, nodes: DataFrame) -> DataFrame:
        """id, node of all texts of these nodes (node)."""
        return self.read("members").join(nodes.select("node").distinct(), "node", "left_semi").select("id", "node")

    # ------------------------------------------------------------ upkeep
    def compact(self) -> None:
        """All parts as one. Readers see the old ones until its marker is there, and the new one from then on."""
        old = self.parts()
        if len(old) > 1:
            part = uuid.uuid4().hex
            for name in FIELDS:
                self._lay(part, name, self.read(name))
            self._mark(part, old)
