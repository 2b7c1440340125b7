"""The corpus pipeline: quality rules, near duplicates, benchmark leaks, mixing, token file.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but the last return the columns of
documents, extra ones and their order included. run() writes each stage's rows as Parquet in the shared folder and reads them again for the next one, so a lost executor
never costs more than the stage it worked on; what a stage wrote for itself goes when it ends.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from verbena.llm.common import Scratch, release, table, written
from verbena.llm.leaks import keep_clean
from verbena.llm.mixing import take_mix
from verbena.llm.ngramjoin import keep_one
from verbena.llm.quality import keep_good
from verbena.llm.tokenfile import read_token_blocks, write_token_blocks


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, null and empty texts among them. Each row is judged alone, so repeated rows and keys
    and null keys don't matter; an empty table stays empty. Columns may have any names."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one with the least doc_id (null ones last; then by a hash of the text). Texts decide, not
    keys: unrelated texts under one doc_id all stay, copies under null doc_ids leave one, and so do repeated rows. Texts without
    words all stay. An empty table stays empty; columns may have any names."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go. Null and empty texts have none and stay; repeated rows have one fate. An empty
    benchmark takes nothing, an empty table stays empty; columns may have any names."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix of sources takes them; those without words are not taken. A null source is a source like others,
    and null doc_ids are keys like others; rows alike in doc_id, source and size share their copies out. An empty table stays empty;
    columns may have any names."""
    return take_mix(docs)


def token_file(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as a token file read back: doc_id, start, n_tokens, ids_crc32 of each document. Null doc_ids come first, rows with equal ones
    are ordered by their texts; a null or empty text has the end id alone. An empty table gives an empty file and no rows."""
    blocks, order = write_token_blocks(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_blocks(blocks, order)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", token_file),
]

#: zstandard ratios decide in the first stage: SQL can't express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        with Scratch() as scratch:
            after = scratch.keep(written(stage(spark, docs, sf_dir), f"stage{i}"))
        release(docs)
        docs = after
    return docs
