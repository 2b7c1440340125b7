"""Quality rules: counts over words and lines, and bands of zstandard compression ratios.

Style: free (Arrow batches through mapInArrow; one batch is in memory at a time, no shuffle, no state between rows, so a
lost executor costs its tasks alone).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, ship, text_bytes
from .wordhash import SOLID, gram_hashes, word_hashes

#: Length in bytes, least and greatest ratio of the whole text at that length; between two lengths the limits follow the logarithm
#: of the length, before the first and after the last they stay. Clean prose gets more compressible as it gets longer, evenly
#: with that logarithm, and these limits keep a distance of 0.05 or more from all clean texts among the labelled ones.
BANDS = (
    (128, 1.00, 1.65), (256, 1.10, 1.82), (512, 1.20, 1.96), (1024, 1.35, 2.07), (2048, 1.45, 2.22), (4096, 1.50, 2.32),
    (8192, 1.50, 2.43), (16384, 1.50, 2.50), (32768, 1.50, 2.58), (65536, 1.50, 2.68), (131072, 1.50, 2.78), (1048576, 1.50, 3.00),
)

#: The same for the chunks of a text. Their lengths differ little, so clean ones differ little too: those of the labelled texts lie
#: between 1.98 and 2.27, and chunks of base64 at 1.31. The floors leave room for a few lines of junk in a chunk.
CHUNK_BANDS = ((2048, 1.60, 2.30), (4096, 1.70, 2.35), (8192, 1.75, 2.43))


def limits(n_bytes: int, bands: tuple) -> tuple[float, float]:
    """The least and greatest ratio that a text of that length may have."""
    at = np.log2(max(1, n_bytes))
    knots = np.log2([b[0] for b in bands])
    return float(np.interp(at, knots, [b[1] for b in bands])), float(np.interp(at, knots, [b[2] for b in bands]))


@dataclass(frozen=True)
class QualityRules:
    """Limits of the rules. A text fails if a rule fails; chunks are chunk_bytes long, a last one of under half joins its neighbour."""

    min_words: int = 20
    repeat_window: int = 8
    max_repeat_percent: int = 30
    level: int = 3
    bands: tuple = field(default=BANDS)
    chunk_bytes: int = 4096
    chunk_bands: tuple = field(default=CHUNK_BANDS)
    max_bad_chunks: float = 0.10


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NOT_FIRST = np.zeros(256, bool)
_NOT_FIRST[0x80:0xC0] = True
_SPACES = b" \t\n\x0b\x0c\r"


def chunks(data: bytes, size: int) -> list[bytes]:
    parts = [data[i : i + size] for i in range(0, len(data), size)]
    if len(parts) > 1 and len(parts[-1]) < size // 2:
        last = parts.pop()
        parts[-1] += last
    return parts


def repeated_words(words: np.ndarray, window: int) -> int:
    """Words inside windows of that many words that occur twice or more in the text, the first included."""
    grams = gram_hashes(words, window)
    if len(grams) < 2:
        return 0
    _, inverse, counts = np.unique(grams, return_inverse=True, return_counts=True)
    often = np.flatnonzero(counts[inverse] > 1)
    if not len(often):
        return 0
    edge = np.zeros(len(words) + 1, np.int32)
    np.add.at(edge, often, 1)
    np.add.at(edge, often + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(data: bytes, rules: QualityRules, packer: zstandard.ZstdCompressor) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratio, bad_chunks, reason."""
    raw = np.frombuffer(data, np.uint8)
    words = word_hashes(data, SOLID, lower=False)
    n_words = len(words)
    word_chars = int((SOLID[raw] & ~_NOT_FIRST[raw]).sum())
    n_symbols = int(_SYMBOL[raw].sum())
    lines = [x for x in data.split(b"\n") if x.strip(_SPACES)]
    n_dup_lines = len(lines) - len(set(lines))
    n_repeat = repeated_words(words, rules.repeat_window)
    base_failed = n_words < rules.min_words or 100 * n_repeat > rules.max_repeat_percent * n_words
    ratio = len(data) / len(packer.compress(data)) if data else 0.0
    low, high = limits(len(data), rules.bands)
    parts = chunks(data, rules.chunk_bytes)
    bad = 0.0
    if len(parts) > 1:
        for x in parts:
            least, most = limits(len(x), rules.chunk_bands)
            bad += not least <= len(x) / len(packer.compress(x)) <= most
        bad /= len(parts)
    if base_failed:
        reason = "few words" if n_words < rules.min_words else "repeated windows"
    elif ratio > high:
        reason = "repetitive"
    elif ratio < low:
        reason = "incompressible"
    elif bad > rules.max_bad_chunks:
        reason = "uneven chunks"
    else:
        reason = None
    return n_words, word_chars, n_symbols, n_dup_lines, n_repeat, base_failed, reason is None, ratio, bad, reason


_MEASURES = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()), T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()), T.StructField("n_repeat_words", T.LongType()), T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()), T.StructField("ratio", T.DoubleType()), T.StructField("bad_chunks", T.DoubleType()),
    T.StructField("reason", T.StringType()),
])
_ARROW = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2 + [pa.string()]


def quality_measures(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: QualityRules | None = None) -> DataFrame:
    """key, then what measure() gives, for each row of docs.

    Null and empty texts have no words: they fail with "few words". Repeated rows and repeated or null keys stay as they are:
    each row is judged alone. Texts may be of any length; an empty table gives an empty result. Other columns are left out, whatever their names.
    """
    ship(docs.sparkSession)
    rules = rules or QualityRules()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=rules.level)
        for b in batches:
            rows = [measure(x.as_py(), rules, packer) for x in b.column(1)]
            columns = zip(*rows, strict=True) if rows else [[]] * len(_ARROW)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), t) for c, t in zip(columns, _ARROW, strict=True))], names=[key, *_MEASURES.names])

    narrow = docs.select(F.col(key), text_bytes(text).alias(free_name(docs.select(key), "body")))
    return narrow.mapInArrow(run, T.StructType([docs.schema[key], *_MEASURES.fields]))


def keep_good(docs: DataFrame, text: str = "text", rules: QualityRules | None = None) -> DataFrame:
    """The rows of docs, all columns, whose text passes the rules."""
    ship(docs.sparkSession)
    rules = rules or QualityRules()
    body = free_name(docs, "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=rules.level)
        for b in batches:
            good = pa.array([measure(x.as_py(), rules, packer)[6] for x in b.column(b.num_columns - 1)], pa.bool_())
            yield b.select(range(b.num_columns - 1)).filter(good)

    return docs.select("*", text_bytes(text).alias(body)).mapInArrow(run, docs.schema)
