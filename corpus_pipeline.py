"""The corpus pipeline: documents in, packed training sequences out.

Every stage takes what its predecessor kept, as the table of documents, and its decisions take effect. Stages are written
as Parquet in the session's shared folder and read again, so each can be repeated by itself."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from privatrail.llm import language, line_runs, near_texts, packing, prefix_free
from privatrail.llm.common import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in no language (null, or without a letter) go. The model learns from the labelled
    documents that are not held out."""
    model = language.train(docs.where(~language.held_out(F.col("doc_id"))))
    named = language.identify(docs.select(*COLUMNS), model, COLUMNS)
    # without any labelled text there is nothing to judge by, and nothing goes
    return named.where(F.col("lang_pred") != language.UNKNOWN).select(*COLUMNS) if model else docs.select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents share stay in one of them. No document goes; one may be left empty."""
    return _documents(line_runs.dedup_lines(docs.select(*COLUMNS)).withColumn("text", F.col("kept_text")))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, a similarity of 0.8 or more on five-word shingles, one row stays: that of the
    smallest id, and of rows that repeat this id one of them. Rows go by their group, not by their id: other texts of a
    null or repeated id stay. Empty documents are a group."""
    # a null id is before all others; one shuffle of the texts serves the join and the rows that repeat whole
    docs = docs.select(*COLUMNS).withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("row", F.xxhash64(*COLUMNS))
    kept = near_texts.representatives(docs, "key", "row")
    return docs.join(kept, ["key", "row"], "left_semi").dropDuplicates(["key", "row"]).select(*COLUMNS)


def dedup_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that stand earlier in the corpus go, with the halves of characters they cut. No
    document goes; one may be left empty."""
    kept = prefix_free.remove_repeats(docs.select(*COLUMNS))
    return _documents(prefix_free.as_text(kept, "kept", "text", ["doc_id", "lang", "source"]))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of at most 2048 tokens."""
    pieces = packing.token_pieces(
        docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("lines", dedup_lines),
    ("near_duplicates", dedup_near),
    ("passages", dedup_passages),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs


#: Languages, token ids and packing are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None
