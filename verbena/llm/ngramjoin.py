"""N-gram Jaccard join: links between texts whose sets of word grams have a Jaccard similarity of a threshold or more.

1. Texts with equal gram sets are one node, numbered: copies are never paired with each other, and keys play no part.
2. Each node gets MinHash values; bands of them put nodes into buckets. With 40 bands of 6 values a pair at 0.8 shares no bucket
   with a probability of 5e-6.
3. Star round: in each bucket the node with the most company over all its buckets (an original among edited copies) is the centre;
   each node is compared with the one centre it shares the most buckets with, so there are no more candidates than
   nodes. A candidate's MinHash values are compared a few at a time; it is dropped as soon as the posterior probability that
   its similarity reaches the threshold (uniform prior, binomial likelihood) is under the tolerance. The rest are verified
   exactly.
4. Peeling: of the nodes in buckets that then hold several classes, those with too many grams of their own go, grams that no
   other such node has: they can't reach the threshold with any. This is exact, repeated while nodes go, and linear.
5. Last round: of the nodes left, pairs of different classes that share a gram in both prefixes (each node's rarest grams, so many that
   a partner must share one), whose sizes are near enough and whose shared gram stands early enough, by the same pruning and
   verification. Two nodes that share a bucket are thus in one class by links found, or ruled out exactly, or have been compared
   with each other: pairs inside a class add nothing to it and are not enumerated.

A document's n_links counts the nodes, that is different gram sets, that reach the threshold with it; all of them are in its class. They are
counted within each class, block by block: a class is dealt by hash into blocks, bounded by nodes and by grams, and a task has two
blocks at most, whose shared grams matrix products count; pairs are counted there and never become rows. A class of N nodes
in blocks of B sends N / B copies of each gram set, and the counting itself grows with the square of the class, as any exact count
must where all are near each other. keep_one(), which needs no counts, leaves it out (exact_links=False: then n_links counts the links
found above, which connect each class).

Keys that many rows share, a common bucket, the centre of a large class, a text with many copies, are counted before each join and dealt
to several tasks (dealt_join).

Style: free (mapInArrow for signatures, pruning and verification; all grouping by joins and aggregations). Nothing is collected.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .classes import components
from .common import Scratch, dealt_join, free_name, release, ship, text_bytes, written
from .wordhash import ALNUM, gram_hashes, mix, word_hashes


@dataclass(frozen=True)
class JoinParams:
    words: int = 5
    threshold: float = 0.8
    bands: int = 40
    rows: int = 6
    step: int = 24
    tolerance: float = 1e-7
    block: int = 64
    block_grams: int = 2_000_000

    @property
    def size(self) -> int:
        return self.bands * self.rows


def gram_set(text: bytes, k: int) -> np.ndarray:
    """The sorted hashes of the text's k-word grams; a text of fewer words, but not none, is one gram."""
    words = word_hashes(text, ALNUM, lower=True)
    return np.unique(gram_hashes(words, min(k, len(words)))) if len(words) else words


def _set_hash(grams: np.ndarray) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(grams.tobytes(), digest_size=16).digest(), "<i8")


def _constants(n: int) -> tuple[np.ndarray, ...]:
    r = np.random.Generator(np.random.PCG64(77))
    draw = lambda: r.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32)
    return draw() | np.uint32(1), draw(), draw() | np.uint32(1)


def min_hashes(grams: np.ndarray, constants: tuple[np.ndarray, ...], piece: int = 256) -> np.ndarray:
    """The least value of each hash function over the grams; a piece of them at a time."""
    times, plus, again = constants
    x = (grams ^ (grams >> np.uint64(32))).astype(np.uint32)
    least = np.full(len(times), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), piece):
        y = x[i : i + piece, None] * times
        y += plus
        y ^= y >> np.uint32(16)
        y *= again
        np.minimum(least, y.min(axis=0), out=least)
    return least


def least_matches(params: JoinParams) -> list[int]:
    """For each number of values compared, in steps: the fewest matches with which a pair stays.

    With m of n matches and a uniform prior, the probability of s >= t is the upper tail of a Beta(m + 1, n - m + 1), which is
    the chance of m or fewer heads in n + 1 throws of a coin with heads t. Values are kept to a byte, so unlike ones match
    with 1/256; t is raised by that.
    """
    t = params.threshold + (1 - params.threshold) / 256
    out = []
    for n in range(params.step, params.size + 1, params.step):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(t) + (n + 1 - m) * math.log1p(-t))
            if tail >= params.tolerance:
                break
            m += 1
        out.append(m)
    return out


def _row_ids(key: str, text: str) -> list[Column]:
    """r1, r2: two hashes that stand for a row's key and text. Rows alike in both are one row."""
    return [F.xxhash64(F.lit(mark), F.col(key), F.lit("text"), F.col(text)).alias(mark) for mark in ("r1", "r2")]


def signatures(docs: DataFrame, key: str, text: str, params: JoinParams) -> DataFrame:
    """r1, r2, key, n_grams, hi, lo (a 128-bit hash of the gram set), sig (a byte of each MinHash value), bands."""
    ship(docs.sparkSession)
    names = ["r1", "r2", "key", "n_grams", "hi", "lo", "sig", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        constants = _constants(params.size)
        salt = mix(np.arange(1, params.bands + 1, dtype=np.uint64))
        for b in _small(batches):
            sizes, halves, least = [], [], np.zeros((b.num_rows, params.size), np.uint32)
            for i, x in enumerate(b.column(3)):
                grams = gram_set(x.as_py(), params.words)
                sizes.append(len(grams))
                halves.append(_set_hash(grams))
                if len(grams):
                    least[i] = min_hashes(grams, constants)
            wide = least.reshape(b.num_rows, params.bands, params.rows).astype(np.uint64)
            with np.errstate(over="ignore"):
                bands = np.zeros((b.num_rows, params.bands), np.uint64) + salt
                for j in range(params.rows):
                    bands = mix(bands * np.uint64(0x9E3779B97F4A7C15) + wide[:, :, j])
            both = np.array(halves, np.int64).reshape(-1, 2)
            offsets = pa.array(np.arange(0, b.num_rows * params.bands + 1, params.bands, dtype=np.int32))
            low = least.astype(np.uint8)
            made = [pa.array(sizes, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array([row.tobytes() for row in low], pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(bands.view(np.int64).ravel()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *made], names=names)

    narrow = docs.select(*_row_ids(key, text), F.col(key).alias("key"), text_bytes(text).alias("body"))
    made = [T.StructField(n, T.LongType()) for n in names[3:6]] + [T.StructField("sig", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    return narrow.mapInArrow(run, T.StructType([*narrow.schema.fields[:3], *made]))


def _with_sides(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """pairs (a, b, written) with these columns of table for either side, named column_a and column_b. A node may be in many pairs."""
    rows = pairs.count()
    for x in "ab":
        counts = pairs.groupBy(x).agg(F.count("*").alias("n"))
        side = table.select(F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns))
        out = dealt_join(pairs if x == "a" else out, side, x, rows, counts=counts)
    return out


def _likely(pairs: DataFrame, nodes: DataFrame, params: JoinParams) -> DataFrame:
    """a, b, matches of the candidate pairs (written) that sizes and MinHash values leave."""
    ship(pairs.sparkSession)
    wide = _with_sides(pairs, nodes, "n_grams", "sig")
    wide = wide.where(F.least("n_grams_a", "n_grams_b") >= F.lit(params.threshold - 1e-9) * F.greatest("n_grams_a", "n_grams_b")).select("a", "b", "sig_a", "sig_b")
    floors = least_matches(params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, params.size) for c in (2, 3))
            alive, matches = np.arange(b.num_rows), np.zeros(b.num_rows, np.int64)
            for k, floor in enumerate(floors):
                cut = slice(k * params.step, (k + 1) * params.step)
                matches[alive] += (x[alive, cut] == y[alive, cut]).sum(axis=1)
                alive = alive[matches[alive] >= floor]
            some = pa.array(alive)
            yield pa.RecordBatch.from_arrays([b.column(0).take(some), b.column(1).take(some), pa.array(matches[alive], pa.int64())], names=["a", "b", "matches"])

    return wide.mapInArrow(run, "a long, b long, matches long")


def _gram_sets(docs: DataFrame, key: str, text: str, wanted: DataFrame, params: JoinParams) -> DataFrame:
    """id, grams of the nodes in wanted (id, r1, r2, hi, lo); what repeated rows give twice may come twice."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the join leaves rows alike next to each other
        for b in _small(batches):
            ids, sets = [], []
            for i, hi, lo, x in zip(*(b.column(c).to_pylist() for c in range(3)), b.column(3), strict=True):
                if i != last:
                    grams = gram_set(x.as_py(), params.words)
                    if tuple(_set_hash(grams)) == (hi, lo):
                        ids.append(i)
                        sets.append(grams.tobytes())
                        last = i
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["id", "grams"])

    # always by a shuffle: how many are wanted grows with the corpus
    bodies = docs.select(*_row_ids(key, text), text_bytes(text).alias("body"))
    return bodies.join(wanted.hint("merge"), ["r1", "r2"]).select("id", "hi", "lo", "body").mapInArrow(run, "id long, grams binary")


def _peeled(open_: DataFrame, sets: DataFrame, params: JoinParams) -> tuple[DataFrame, DataFrame]:
    """What of open_ (id, n_grams, least: the fewest grams of a node it shares a bucket with) is not ruled out: id and most, the grams
    it may have to itself; and the grams of these nodes, a row each.

    To reach t with a partner of least grams or more, a node must share t / (1 + t) * (n_grams + least) of its grams, and with any
    partner t * n_grams: it may have no more than the rest to itself.
    """
    t = params.threshold - 1e-9
    bounds = open_.groupBy("id").agg(F.min("least").alias("least"), F.first("n_grams").alias("n_grams"))
    bounds = bounds.select("id", (F.col("n_grams") - F.greatest(F.lit(t) * F.col("n_grams"), F.lit(t / (1 + t)) * (F.col("n_grams") + F.col("least")))).alias("most"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                grams = np.frombuffer(x.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), i)), pa.array(grams)], names=["id", "gram"])

    nodes = written(bounds, "bounds")
    spread = written(sets.join(nodes.select("id"), "id", "left_semi").mapInArrow(run, "id long, gram long").distinct(), "grams")
    while True:
        alive = spread.join(nodes.select("id"), "id", "left_semi")
        own = alive.groupBy("gram").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").groupBy("id").agg(F.count("*").alias("own"))
        rest = written(nodes.join(own, "id", "left").where(F.coalesce("own", F.lit(0)) <= F.col("most")).select("id", "most"), "bounds")
        before, after = nodes.count(), rest.count()
        release(nodes)
        nodes = rest
        if after >= 0.95 * before:  # what little more would go costs less to compare
            break
    return nodes, spread.join(nodes.select("id"), "id", "left_semi")


def _prefixes(nodes: DataFrame, grams: DataFrame, labels: DataFrame) -> DataFrame:
    """id, label, gram, k (its place), n_grams, size: each node's most + 1 rarest grams among these nodes, for those grams that nodes of several
    classes have there. A partner that reaches the threshold shares one of them with it, in its own prefix too, as both follow one
    order."""
    often = grams.groupBy("gram").agg(F.count("*").alias("n"))
    order = Window.partitionBy("id").orderBy("n", "gram")
    ranked = grams.join(often, "gram").withColumn("k", F.row_number().over(order)).withColumn("n_grams", F.count("*").over(Window.partitionBy("id")))
    some = ranked.join(nodes, "id").where(F.col("k") <= F.floor("most") + 1).select("gram", "id", "k", "n_grams")
    return some.join(labels, F.col("id") == F.col("node"), "left").select("gram", "id", "k", "n_grams", F.coalesce("label", "id").alias("label"))


def _prefix_pairs(prefixes: DataFrame, params: JoinParams) -> DataFrame:
    """a, b: nodes of different classes that share a gram of both prefixes and whose sizes, and places of that gram, let them reach t.

    Rows meet by gram and by size: a partner has at least t and at most 1 / t times as many grams, so its size class is the same or
    the next. Within a gram and size class, the class with most rows never meets itself: a gram that a large class has costs a
    row of it for each row of another class, not the square.
    """
    t = params.threshold - 1e-9
    step = -math.log(t)
    sized = prefixes.withColumn("size", F.floor(F.log("n_grams") / F.lit(step)).cast("long"))
    # in (gram, size) stand the rows of that size class, own, and those of the one below
    rows = sized.withColumn("own", F.lit(True)).union(sized.withColumn("size", F.col("size") + 1).withColumn("own", F.lit(False)))
    counts = rows.groupBy("gram", "size", "label").agg(F.count("*").alias("n"), F.max("own").alias("own"))
    counts = counts.groupBy("gram", "size").agg(F.max_by("label", F.struct("n", "label")).alias("major"), F.count("*").alias("classes"), F.max("own").alias("own")).where("classes > 1 AND own").select("gram", "size", "major")
    met = written(rows.join(counts, ["gram", "size"]), "met")
    x = met.where("label != major").select("gram", "size", *(F.col(c).alias(f"{c}_x") for c in ("id", "label", "k", "n_grams", "own")), "major")
    y = met.select("gram", "size", *(F.col(c).alias(f"{c}_y") for c in ("id", "label", "k", "n_grams", "own")))
    # both not major: each pair once; both of the class below: met there
    apart = "label_x != label_y AND (label_y = major OR label_x < label_y) AND (own_x OR own_y)"
    sizes = F.least("n_grams_x", "n_grams_y") >= F.lit(t) * F.greatest("n_grams_x", "n_grams_y")
    places = 1 + F.least(F.col("n_grams_x") - F.col("k_x"), F.col("n_grams_y") - F.col("k_y")) >= F.lit(t / (1 + t)) * (F.col("n_grams_x") + F.col("n_grams_y"))
    return x.join(y, ["gram", "size"]).where(F.expr(apart) & sizes & places).select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, params: JoinParams) -> DataFrame:
    """a, b of the pairs whose gram sets reach the threshold."""
    t = params.threshold - 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches):
            good = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                at = np.searchsorted(y, x)
                shared = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
                good.append(shared >= t * (len(x) + len(y) - shared))
            yield b.select([0, 1]).filter(pa.array(good, pa.bool_()))

    wide = _with_sides(written(pairs.select("a", "b"), "pairs"), sets, "grams")
    return wide.select("a", "b", "grams_a", "grams_b").mapInArrow(run, "a long, b long").distinct()


#: Nodes of two blocks that a matrix product compares at once.
_TILE = 256
#: Rows that a worker turns into an output batch, so that what it holds does not depend on Spark's batches.
_ROWS = 1024


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, _ROWS):
            yield b.slice(at, _ROWS)


def _links_in_block(a: list[np.ndarray], b: list[np.ndarray], t: float, columns: int = 4096) -> np.ndarray:
    """For each pair of gram sets, whether it reaches the threshold. Shared grams are counted some columns at a time."""
    every = np.concatenate([*a, *b])
    sizes = np.array([len(x) for x in [*a, *b]])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, inverse, often = np.unique(every, return_inverse=True, return_counts=True)
    place = np.cumsum(often > 1) - 1
    some = often[inverse] > 1
    owner, column = owner[some], place[inverse[some]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((len(a), len(b)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        low, high = np.searchsorted(column, [start, start + columns])
        has = np.zeros((len(sizes), columns), np.float32)
        has[owner[low:high], column[low:high] - start] = 1
        shared += has[: len(a)] @ has[len(a) :].T
    total = sizes[: len(a), None] + sizes[None, len(a) :]
    return shared >= t * (total - shared)


def _link_counts(labels: DataFrame, sets: DataFrame, params: JoinParams) -> DataFrame:
    """node, n_links: for each node of labels (node, label, n_grams), how many others of its class reach the threshold with it.

    A class is dealt by hash into blocks; each block meets itself and every other one once, in a task that holds these two. A
    block holds a sixteenth of its class, but params.block nodes at least, and no more grams than block_grams, one node at least.
    """
    ship(labels.sparkSession)
    t = params.threshold - 1e-9
    classes = labels.groupBy("label").agg(F.count("*").alias("n"), F.sum("n_grams").alias("grams"))
    wanted = F.greatest(F.ceil(F.col("n") / F.greatest(F.lit(params.block), F.ceil(F.col("n") / 16))), F.ceil(F.col("grams") / params.block_grams))
    blocks = classes.select("label", F.greatest(F.lit(1), F.least("n", wanted)).cast("long").alias("blocks"))
    placed = dealt_join(labels.select("label", "node"), blocks, "label", labels.count(), counts=classes.select("label", "n"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
    spread = placed.select("label", "node", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    spread = spread.select("label", "node", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    one = sets.groupBy("id").agg(F.first("grams").alias("grams"))
    wide = spread.join(one, F.col("node") == F.col("id")).select("label", "i", "j", "node", "own", "grams")

    def count(group: pa.Table) -> pa.Table:
        nodes, own = group.column("node").to_numpy(), group.column("own").to_numpy()
        grams = [np.frombuffer(x.as_buffer(), np.uint64) for chunk in group.column("grams").chunks for x in chunk]
        first, second = np.flatnonzero(own == group.column("i")[0].as_py()), np.flatnonzero(own == group.column("j")[0].as_py())
        alone = group.column("i")[0] == group.column("j")[0]
        found = np.zeros(len(nodes), np.int64)
        for p in range(0, len(first), _TILE):
            for q in range(p if alone else 0, len(second), _TILE):
                a, b = first[p : p + _TILE], second[q : q + _TILE]
                met = _links_in_block([grams[k] for k in a], [grams[k] for k in b], t)
                if alone and p == q:
                    np.fill_diagonal(met, False)
                    found[a] += met.sum(axis=1)
                else:
                    found[a] += met.sum(axis=1)
                    found[b] += met.sum(axis=0)
        return pa.table({"node": nodes, "n": found})

    counted = wide.groupBy("label", "i", "j").applyInArrow(count, "node long, n long")
    return counted.groupBy("node").agg(F.sum("n").alias("n_links"))


def _star_labels(star: DataFrame) -> DataFrame:
    """node, label: of each node linked to a centre, the centre that its own centre is linked to, else its centre. Nodes of one label are of one
    class, but a class may have several. star: a (the centre), b, each b once."""
    up = star.select(F.col("b").alias("a"), F.col("a").alias("upper"))
    met = dealt_join(star, up, "a", star.count(), "left")
    label = F.when(F.col("upper").isNull(), F.col("a")).when(F.col("upper") == F.col("b"), F.least("a", "b")).otherwise(F.col("upper"))
    return met.select(F.col("b").alias("node"), label.alias("label"))


def _joined_labels(star: DataFrame, last: DataFrame, labels: DataFrame) -> DataFrame:
    """node, label of each node with a link: labels that a link joins become one. Only these, few as they are, go through components()."""
    of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))
    edges = None
    for links in (star, last):
        rows = links.count()
        met = dealt_join(dealt_join(links, of("a"), "a", rows, "left"), of("b"), "b", rows, "left")
        met = met.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")).where("a <> b")
        edges = met if edges is None else edges.union(met)
    joined = written(components(edges).select(F.col("node").alias("label"), F.col("label").alias("whole")), "joined")
    every = star.union(last).select(F.explode(F.array("a", "b")).alias("node")).distinct()
    every = written(every.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "every")
    return dealt_join(every, joined, "label", every.count(), "left").select("node", F.coalesce("whole", "label").alias("label"))


def _classed(docs: DataFrame, key: str, text: str, params: JoinParams, exact_links: bool) -> tuple[DataFrame, DataFrame]:
    """The rows (r1, r2, key, n_grams, hi, lo) and what is known of each gram set: hi, lo, n (its rows), n_links, least (the row of its
    class with the least key, nulls last, then the least r1, r2)."""
    signed = written(signatures(docs, key, text, params), "signatures")
    first = lambda c: F.first(c).alias(c)
    own = F.struct(F.col("key").isNull().alias("none"), "key", "r1", "r2")
    nodes = signed.where("n_grams > 0").groupBy("hi", "lo").agg(F.min(own).alias("least"), F.count("*").alias("n"), *map(first, ("n_grams", "sig", "bands")))
    # numbered after a sort, so that reruns number alike
    nodes = written(nodes.sortWithinPartitions("hi", "lo").withColumn("id", F.monotonically_increasing_id()), "nodes")
    spread = nodes.select("id", "n_grams", F.explode("bands").alias("bucket"))
    in_all = params.bands * nodes.count()
    company = written(spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "company")
    shared = written(dealt_join(spread, company, "bucket", in_all, counts=company), "shared")
    members = written(shared.join(shared.groupBy("id").agg(F.sum("n").alias("weight")), "id").select("bucket", "id", "n_grams", "weight"), "members")
    release(shared)
    wanted = nodes.select("id", "least.r1", "least.r2", "hi", "lo").join(members.select("id").distinct(), "id", "left_semi")
    sets = written(_gram_sets(docs, key, text, wanted, params), "sets")

    # star round
    centres = members.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("id")).alias("minus"))).alias("c")).select("bucket", (-F.col("c.minus")).alias("centre"), F.col("c.weight").alias("weight"))
    near = dealt_join(members.select("bucket", "id"), centres, "bucket", in_all, counts=company).where("id != centre").groupBy("id", "centre").agg(F.count("*").alias("n"), F.first("weight").alias("weight"))
    best = near.groupBy("id").agg(F.max_by("centre", F.struct("n", "weight", "centre")).alias("centre"))
    pairs = written(best.select(F.col("centre").alias("a"), F.col("id").alias("b")), "pairs")
    star = written(_verified(_likely(pairs, nodes, params), sets, params), "links")
    labels = written(_star_labels(star), "labels")

    # what the star left apart
    placed = members.join(labels, members["id"] == labels["node"], "left").select("bucket", "id", "n_grams", F.coalesce("label", "id").alias("label"))
    placed = written(placed, "placed")
    several = placed.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("n_grams").alias("least")).where("low < high").select("bucket", "least")
    open_ = written(dealt_join(placed, several, "bucket", in_all, counts=company), "open")
    nodes_left, grams = _peeled(open_, sets, params)
    pairs = written(_prefix_pairs(written(_prefixes(nodes_left, grams, labels), "prefixes"), params), "pairs")
    last = written(_verified(_likely(pairs, nodes, params), sets, params), "links")
    links = written(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(last).distinct(), "links")
    labels = _joined_labels(star, last, labels)
    labels = written(labels.join(nodes.select(F.col("id").alias("node"), "n_grams"), "node"), "labels")
    if exact_links:
        degree = _link_counts(labels, sets, params)
    else:
        degree = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    linked = nodes.select("hi", "lo", "n", "id", "least").join(labels.select(F.col("node").alias("id"), "label"), "id").join(degree.withColumnRenamed("node", "id"), "id")
    linked = written(linked.drop("id"), "linked")
    best = linked.groupBy("label").agg(F.min("least").alias("least"), F.count("*").alias("n"))
    linked = dealt_join(linked.drop("least"), best.drop("n"), "label", in_all // params.bands, counts=best.select("label", "n")).drop("label")
    alone = nodes.join(labels.select(F.col("node").alias("id")), "id", "left_anti").select("hi", "lo", "n", F.lit(0).cast("long").alias("n_links"), "least")
    return signed, written(linked.select("hi", "lo", "n", "n_links", "least").union(alone), "classed")


def _rows_classed(signed: DataFrame, classed: DataFrame) -> DataFrame:
    """The rows with words, each with n_links and least of its class."""
    rows = signed.where("n_grams > 0").select("r1", "r2", "key", "n_grams", "hi", "lo")
    return dealt_join(rows, classed.drop("n"), ["hi", "lo"], signed.count(), counts=classed.select("hi", "lo", "n"))


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", params: JoinParams | None = None, exact_links: bool = True) -> DataFrame:
    """key, class_id, n_links, n_grams for each row of docs.

    A class holds the rows with equal gram sets and those that links connect; class_id is its least key, of any type that can be ordered. Null
    keys count last, so class_id is null only if a class has no other. Rows that share a key are told apart by their texts: unrelated
    ones are in different classes, though both may be named by that key. A row without words (null, empty, marks only) is alone:
    its class_id is its key. Texts may be of any length. An empty table gives an empty result. Other columns are left out, whatever their names.
    """
    with Scratch() as scratch:
        signed, classed = _classed(docs, key, text, params or JoinParams(), exact_links)
        rows = _rows_classed(signed, classed).select(F.col("key").alias(key), F.col("least.key").alias("class_id"), "n_links", "n_grams")
        wordless = signed.where("n_grams = 0").select(F.col("key").alias(key), F.col("key").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "n_grams")
        return scratch.keep(written(rows.union(wordless), "classes"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", params: JoinParams | None = None) -> DataFrame:
    """The rows of docs, all columns, of each class the one with the least key (nulls last; then by hashes of key and text).

    Only rows of one class stand for each other, whatever their keys: unrelated texts under one key all stay, and copies under null
    keys leave one. Of rows alike in key and text one stays, the one with the least other columns. Rows without words all stay.
    """
    with Scratch() as scratch:
        signed, classed = _classed(docs, key, text, params or JoinParams(), exact_links=False)
        gone = _rows_classed(signed, classed).where("r1 != least.r1 OR r2 != least.r2").select("r1", "r2").distinct()
        gone = scratch.keep(written(gone, "gone"))
        again = signed.where("n_grams > 0").groupBy("r1", "r2").agg(F.count("*").alias("n")).where("n > 1").select("r1", "r2")
        again = scratch.keep(written(again, "again"))
    names = [free_name(docs, "r1"), free_name(docs, "r2")]
    ids = lambda d: d.withColumnsRenamed(dict(zip(["r1", "r2"], names, strict=True)))
    kept = docs.select("*", *(c.alias(n) for c, n in zip(_row_ids(key, text), names, strict=True))).join(ids(gone), names, "left_anti")
    if not again.isEmpty():
        order = [c for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
        whole = F.struct(*(F.col(c) for c in docs.columns))
        repeated = kept.join(ids(again), names, "left_semi").groupBy(*names).agg(F.min_by(whole, F.struct(*order)).alias("row"))
        kept = kept.join(ids(again), names, "left_anti").select(*docs.columns).union(repeated.select("row.*"))
    return kept.select(*docs.columns)
