"""Token counts of whole texts.

Whole-token shortcut: the driver proves which vocabulary strings encode alone as one token; workers count pre-tokens among
them directly and let the model merge only the rest (see bpe.py).

Style: free (Arrow batches, no shuffle, a bounded table of remembered pre-tokens in each worker).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import encoder
from .common import free_name, ship


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes and n_tokens for each row of docs, with the vocabulary file at path.

    Null counts as empty: no bytes, no tokens. Repeated rows and keys are counted each alone. Texts may be of any length; an empty table gives
    an empty result. Other columns are left out, whatever their names.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(path).count
        for b in batches:
            texts = [x.as_py() or "" for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array([count(x) for x in texts], pa.int64())], names=[key, "n_bytes", "n_tokens"])

    narrow = docs.select(F.col(key), F.col(text).alias(free_name(docs.select(key), "body")))
    return narrow.mapInArrow(run, T.StructType([docs.schema[key], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]))
