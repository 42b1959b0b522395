"""The registered queries of the operators, and the SQL that states the results SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from privatrail.llm import (
    chat_format,
    chunk_fingerprints,
    cover_tree,
    host_suffix,
    language,
    line_runs,
    merge_replay,
    merkle,
    packing,
    prefix_free,
    prefix_trie,
    simhash_trie,
    splitters,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query
def op4_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text by the multilingual ranks, and what they decode to."""
    ranks = merge_replay.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = merge_replay.encode(_read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, ["doc_id"], decoded="decoded")
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op1_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness to it and to the next document."""
    return chunk_fingerprints.compare_neighbours(_read(spark, sf_dir, "documents"))


@query
def op8_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every whole text that three or more documents share stay in the last of them alone."""
    kept = line_runs.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE["op8_line_runs"] = line_runs.ORACLE


@query
def op5_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of every whole text: fingerprints of 3-word shingles that differ in 2 bits or fewer."""
    near = simhash_trie.near_duplicates(_read(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


SHARDS = 24


@query
def op2_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes, ranges of the text's hash between sampled splitters."""
    placed = splitters.shard_documents(_read(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    pieces = packing.token_pieces(
        _read(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from the labelled documents that are not held out."""
    docs = _read(spark, sf_dir, "documents")
    apart = language.held_out(F.col("doc_id"))
    model = language.train(docs.where(~apart))
    return language.identify(docs.select("doc_id", "text", apart.alias("held_out")), model, ["doc_id", "held_out"])


@query
def op7_prefix_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text without the bytes of 100-byte strings that start earlier in the corpus."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    kept = prefix_free.remove_repeats(docs)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op3_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all vectors at a cosine of 0.9 or more, and the groups they make."""
    return cover_tree.link(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query
def op6_host_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = host_suffix.extract(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations, every node with the sums of its subtree."""
    return prefix_trie.prefix_trie(_read(spark, sf_dir, "conversations"))


ORACLE["op11_prefix_trie"] = prefix_trie.ORACLE


@query
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash tree per language and one over them, a proof per document, and which of the altered documents it finds."""
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return merkle.manifest(
        _read(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", {"n_chars": F.col("n_chars") + 1}, altered
    )


ORACLE["op12_merkle"] = merkle.oracle(prefix_trie.CRC32)


@query
def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and a planted one as ids under a mask, and what they say when read back."""
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(chat_format.PLANTED, "conv_id long, turn long, role string, text string")
    coder = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return chat_format.read_back(chat_format.format_conversations(turns.unionByName(planted), *coder), *coder)


ORACLE["op13_chat_format"] = chat_format.ORACLE
