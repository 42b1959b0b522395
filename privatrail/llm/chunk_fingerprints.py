"""Document fingerprints from content-defined chunks.

A gear hash over the UTF-8 bytes marks chunk ends: before the normal size a harder mask must match, after it an easier
one (normalised chunking), so sizes gather around the normal one. A chunk's end depends on the bytes before it alone,
so an insertion shifts chunks without changing those behind it. A fingerprint is the set of a text's distinct chunks,
each a 48-bit digest and its length; containment weighs the shared chunks by length.

Fixed definitions: null counts as the empty text; the empty text has the empty fingerprint; two empty fingerprints are
alike (1), an empty and a full one are not (0). Equal texts have equal fingerprints.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_SIZE, NORMAL_SIZE, MAX_SIZE = 16, 48, 192
#: Bits that must be zero in the hash: harder before the normal size, easier after it.
HARD_BITS, EASY_BITS = 7, 4
#: Bytes hashed at a time, which bounds a task's memory for very long texts.
BLOCK = 1 << 20
WIDTH = 32
#: Rows of a bucket of neighbours, about.
BUCKET_ROWS = 512
MAX_BUCKETS = 4096

_GEAR = np.random.default_rng(20240607).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash (h << 1) + G[byte] at every byte; 32 bits remember the last 32 bytes, summed by doubling."""
    h = _GEAR[data]
    step = 1
    while step < WIDTH:
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        step *= 2
    return h


def _candidates(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places after which the hard and the easy mask match."""
    hard, easy = [], []
    data = np.frombuffer(raw, np.uint8)
    top_hard, top_easy = np.uint32(32 - HARD_BITS), np.uint32(32 - EASY_BITS)
    for a in range(0, len(data), BLOCK):
        lead = min(a, WIDTH)
        h = gear_hashes(data[a - lead : a + BLOCK])[lead:]
        found = np.flatnonzero((h >> top_easy) == 0)
        easy.append(found + a + 1)
        hard.append(found[(h[found] >> top_hard) == 0] + a + 1)
    return np.concatenate(hard), np.concatenate(easy)


def chunk_ends(raw: bytes) -> list[int]:
    """Ends of the chunks of a text's bytes."""
    n = len(raw)
    if n == 0:
        return []
    hard, easy = (x.tolist() for x in _candidates(raw))
    hard.append(n + MAX_SIZE)
    easy.append(n + MAX_SIZE)
    ends, a, i, j = [], 0, 0, 0
    while n - a > MIN_SIZE:
        least, middle, most = a + MIN_SIZE, a + NORMAL_SIZE, a + MAX_SIZE
        while hard[i] < least:
            i += 1
        if hard[i] <= middle:
            a = hard[i]
        else:
            while easy[j] <= middle:
                j += 1
            a = easy[j] if easy[j] < most else most
        if a >= n:
            break
        ends.append(a)
    ends.append(n)
    return ends


def fingerprint(raw: bytes) -> dict[bytes, int]:
    """Digest -> length of the distinct chunks."""
    out, a, digest = {}, 0, xxhash.xxh3_64_digest
    for b in chunk_ends(raw):
        out[digest(raw[a:b])[:6]] = b - a
        a = b
    return out


def packed(chunks: dict[bytes, int]) -> str:
    """The fingerprint as text: base64 of the sorted digests, each followed by its length in one byte."""
    return base64.b64encode(b"".join(k + v.to_bytes(1, "big") for k, v in sorted(chunks.items()))).decode()


def unpacked(text: str) -> dict[bytes, int]:
    raw = base64.b64decode(text)
    return {raw[i : i + 6]: raw[i + 6] for i in range(0, len(raw), 7)}


def containment(a: dict[bytes, int], b: dict[bytes, int]) -> float:
    """The share of a's chunk length that b holds too."""
    if not a or not b:
        return float(len(a) == len(b))
    return sum(a[k] for k in a.keys() & b.keys()) / sum(a.values())


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many first ones of the following text, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (bucket, key, text, guest) such that the rows of a bucket, by descending key, are neighbours in the whole
    order, and a bucket ends with guests: the first rows of the next one, or of the first bucket after the last.
    Boundaries are quantiles of the key, at most MAX_BUCKETS; a bucket is streamed, never collected. Null keys come
    last, equal keys in the order of their texts."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = docs.count()
    many = max(1, min(MAX_BUCKETS, -(-n // BUCKET_ROWS)))
    bounds: list[int] = []
    if many > 1:
        shares = [i / many for i in range(1, many)]
        bounds = sorted(set(docs.select(F.percentile_approx("doc_id", shares, 10 * many)).first()[0] or []))
    sorted_bounds = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def bucket_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.where(ids.isna(), -1, np.searchsorted(sorted_bounds, ids.fillna(0).astype("int64"), "right")))

    placed = docs.select(bucket_of("doc_id").alias("bucket"), "doc_id", "text", F.lit(False).alias("guest"))
    # one row per bucket, at most MAX_BUCKETS + 1
    tops = sorted(docs.select(bucket_of("doc_id").alias("bucket"), "doc_id").groupBy("bucket").agg(F.max("doc_id")).collect(), reverse=True)
    hosts = [(tops[i - 1][0], tops[i][0], tops[i][1]) for i in range(len(tops))]
    if not hosts:
        return placed
    firsts = docs.sparkSession.createDataFrame(hosts, "host int, own int, first long")
    guests = docs.join(F.broadcast(firsts), docs.doc_id.eqNullSafe(firsts["first"])).select(
        F.col("host").alias("bucket"), "doc_id", "text", F.lit(True).alias("guest")
    )
    return placed.unionByName(guests).repartition("bucket").sortWithinPartitions(
        F.desc("bucket"), "guest", F.desc_nulls_last("doc_id"), F.desc(F.xxhash64("text"))
    )


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row that is no guest: its own and its edited text's fingerprint, and their likeness."""
    held = None  # (bucket, doc_id, text, fingerprint)
    rows: list[tuple] = []

    def close(row: tuple, text: str, chunks: dict[bytes, int]) -> None:
        _, doc_id, own, mine = row
        changed = edited(own, text)
        raw = changed.encode()
        other = fingerprint(raw)
        rows.append((doc_id, len(own), hashlib.sha256(raw).hexdigest(), packed(mine), packed(other), containment(mine, other), containment(mine, chunks)))

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    for batch in batches:
        buckets, ids, texts, guests = (c.to_pylist() for c in batch.columns)
        for bucket, doc_id, text, guest in zip(buckets, ids, texts, guests, strict=True):
            if guest and held is None:
                continue
            chunks = fingerprint(text.encode())
            if held is not None:
                close(held, text, chunks)
            held = None if guest else (bucket, doc_id, text, chunks)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)], names=names)
        rows.clear()


def compare_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and the containment of the document in its
    edited text and in the next document by descending key. One shuffle of the texts, then streamed by bucket."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_neighbours(docs, key, text).mapInArrow(_pairs, schema)
