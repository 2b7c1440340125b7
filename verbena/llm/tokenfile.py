"""Token ids of whole texts, written in a compact binary form and read back.

Ids are replaced by their rank among all ids of the corpus, the most frequent first. Ranks are coded in one to four bytes each;
two bits for each rank, kept apart in control bytes, give the number of bytes. A reader looks each control byte up in a table
of its four lengths and gathers the ranks with numpy.

Files: Parquet with a row for each block, so that any store Spark can write will do and its commit protocol covers lost
executors. A block holds whole documents in ascending order of their key (equal keys by their ids): part and block numbers,
the ids of its part before it, its own number of ids, the documents' keys and numbers of ids, the control bytes and the data bytes. The ranks are a table beside them.

Style: free (mapInArrow). Texts are range-partitioned once by key and encoded once, into plain ids on disk; these are counted and
then recoded, both without a shuffle of ids. Only counts (a row for each id and task at most) and totals of parts are shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import encoder
from .common import free_name, release, ship, written

#: A block is closed when it holds so many ids.
BLOCK_IDS = 1 << 19
#: Text of a part, about, as it lies in the input's files, and the parts there may be: a row for each is broadcast when they are read.
PART_BYTES, MOST_PARTS = 128 << 20, 1_000_000

_LENGTHS = np.array([[(c >> 2 * j & 3) + 1 for j in range(4)] for c in range(256)], np.uint8)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values behind pack()'s result."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    start = np.zeros(n, np.int64)
    np.cumsum(size[:-1], out=start[1:])
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[start].astype(np.uint32)
    for j in range(1, int(size.max(initial=1))):
        out |= (raw[start + j] * (size > j)).astype(np.uint32) << np.uint32(8 * j)
    return out


def _bodies(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    body = free_name(docs.select(key), "body")
    return docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(body)), body


def _encoded(docs: DataFrame, path: str, key: str, text: str, end_id: int | None, parts: int, block_ids: int) -> DataFrame:
    """The blocks with plain ids (little-endian, as wide as the vocabulary needs), written."""
    bodies, body = _bodies(docs, key, text)
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part, block, before, size = encoder(path), TaskContext.get().partitionId(), 0, 0, 0
        tail = np.array([] if end_id is None else [end_id], e.kind)
        keys: list[pa.Scalar] = []
        lengths: list[int] = []
        ids: list[np.ndarray] = []

        def closed() -> pa.RecordBatch:
            columns = [pa.array([part], pa.int64()), pa.array([block], pa.int64()), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([[k.as_py() for k in keys]], pa.list_(keys[0].type)), pa.array([lengths], pa.list_(pa.int64())), pa.array([np.concatenate(ids).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for b in batches:
            for k, x in zip(b.column(0), b.column(1), strict=True):
                new = e.encode(x.as_py())
                keys.append(k)
                ids += [new, tail]
                lengths.append(len(new) + len(tail))
                size += lengths[-1]
                if size >= block_ids:
                    yield closed()
                    block, before, size, keys, lengths, ids = block + 1, before + size, 0, [], [], []
        if keys:
            yield closed()

    # rows with equal keys and equal texts are alike, so any order among them gives the same files; a key that many rows have is cut by hash
    order = [F.col(key).asc_nulls_first(), F.col(free_name(bodies, "mark"))]
    placed = bodies.withColumn(free_name(bodies, "mark"), F.xxhash64(body)).repartitionByRange(parts, *order).sortWithinPartitions(*order, body)
    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("block", T.LongType()), T.StructField("before", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("keys", T.ArrayType(kind)), T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("ids", T.BinaryType())])
    return written(placed.mapInArrow(run, schema), "ids", "zstd")


def id_counts(blocks: DataFrame, kind: str) -> DataFrame:
    """token, n: how often each id occurs in all blocks. A task sends a row for each id it has seen at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for b in batches:
            for x in b.column(0):
                new = np.bincount(np.frombuffer(x.as_buffer(), kind))
                total = np.pad(total, (0, max(0, len(new) - len(total))))
                total[: len(new)] += new
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["token", "n"])

    return blocks.select("ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def ranks(counts: DataFrame) -> np.ndarray:
    """The ids by falling count, then by id: the place of an id is its rank. Bounded by the vocabulary."""
    rows = counts.collect()
    return np.array([r["token"] for r in sorted(rows, key=lambda r: (-r["n"], r["token"]))], np.int64)


def _part_count(docs: DataFrame, text: str) -> int:
    """A part for each PART_BYTES of text, MOST_PARTS at most, but as many as Spark shuffles into by default at least. The size is Spark's own
    estimate of its input; where it has none, the texts are measured."""
    size = int(str(docs.select(text)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 60:
        size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, least, min(MOST_PARTS, -(-size // PART_BYTES)))


def write_token_blocks(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int | None = 0, parts: int | None = None, block_ids: int = BLOCK_IDS) -> tuple[DataFrame, np.ndarray]:
    """Encode all texts and write them; returns the written blocks, as read back, and the ids by rank.

    Blocks have part, block (both from 0, ascending in key order), before, n_ids, keys, lengths, control, data. Null keys come first; rows with
    equal keys are ordered by a hash of their texts, then by their texts. A null text is empty: it has the end id alone. Texts may be of any length, as they may go on
    in the next block. An empty table gives no blocks. Other columns are left out, whatever their names.
    """
    spark = docs.sparkSession
    ship(spark)
    plain = _encoded(docs, path, key, text, end_id, parts or _part_count(docs, text), block_ids)
    kind = encoder(path).kind
    order = ranks(id_counts(plain, kind))
    rank = np.zeros(int(order.max(initial=0)) + 1, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [pack(rank[np.frombuffer(x.as_buffer(), kind)]) for x in b.column(6)]
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array([c for c, _ in packed], pa.binary()), pa.array([d for _, d in packed], pa.binary())], names=schema.names)

    schema = T.StructType([*plain.schema.fields[:6], T.StructField("control", T.BinaryType()), T.StructField("data", T.BinaryType())])
    blocks = written(plain.mapInArrow(run, schema), "tokens", "zstd")
    release(plain)
    return blocks, order


def read_token_blocks(blocks: DataFrame, order: np.ndarray, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens, ids_crc32 of each document, from the written blocks.

    start counts the ids of all documents before: each block has those of its part, and the parts' totals are summed here. There is
    a row for each part, as many as the writer had partitions: that bounds what is broadcast.
    """
    ship(blocks.sparkSession)
    kind = blocks.schema["keys"].dataType.elementType
    by_part = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before_part = by_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before_part"))
    ids = order.astype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                keys, lengths, control, data, first = (b.column(c)[k].as_py() for c in range(5))
                values = ids[unpack(control, data, sum(lengths))]
                ends = np.cumsum(lengths)
                begins = ends - lengths
                sums = [zlib.crc32(values[s:e].tobytes()) for s, e in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, b.column(0).type.value_type), pa.array(begins + first, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())], names=[key, "start", "n_tokens", "ids_crc32"])

    wide = blocks.join(F.broadcast(before_part), "part").select("keys", "lengths", "control", "data", (F.col("before") + F.col("before_part")).alias("first_id"))
    return wide.mapInArrow(run, T.StructType([T.StructField(key, kind), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]))
