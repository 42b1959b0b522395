"""Sharding by sampled splitters.

Records are ordered by a key, here the hash of the text, so that equal texts lie together; ties go by a second hash.
Keys are drawn in proportion to their share of bytes and of records, their quantiles become splitters, and every record
falls into the range between two of them. A range that holds over twice its share (a text of very many copies) is
subdivided by splitters drawn inside it, until none is overfull. The sums of the ranges then place every record in the
whole order of bytes, which is cut into shards of equal size: shards differ by one record's size at most.

Bounds: at most about SAMPLES draws a round and RANGES * 3 splitters come to the driver, whatever the input.
Defined cases: a null text has no bytes, and the checksum of no bytes (0); repeated rows are records of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from privatrail.llm.common import cut

SAMPLES = 16384
RANGES = 256
OVERFULL = 2.0


def _range_of(splitters: list[tuple[int, int]]) -> Column:
    """The number of splitters at or below (key, tie)."""
    keys = np.array([k for k, _ in splitters], np.int64)
    ties = np.array([t for _, t in splitters], np.int64)

    @F.pandas_udf("int")
    def search(key: pd.Series, tie: pd.Series) -> pd.Series:
        k, t = key.to_numpy(), tie.to_numpy()
        low, high = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        for at in np.unique(low[high > low]).tolist():  # keys that splitters divide
            rows = np.flatnonzero((low == at) & (high > low))
            low[rows] = at + np.searchsorted(ties[at : high[rows[0]]], t[rows], "right")
        return pd.Series(low.astype(np.int32))

    return search(F.col("key"), F.col("tie"))


def _draw(records: DataFrame, weight: Column, many: int, salt: int) -> list[tuple[int, int]]:
    """(key, tie) of about `many` draws, in order; a record is drawn in proportion to its weight, heavy ones again."""
    unit = F.pmod(F.xxhash64("tie", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    times = F.floor(weight * many + unit).cast("int")
    drawn = records.withColumn("times", times).where("times > 0").select("key", "tie", F.least("times", F.lit(many)).alias("times"))
    return sorted((r.key, r.tie) for r in drawn.collect() for _ in range(r.times))


def place(records: DataFrame, shards: int, seed: int = 7) -> DataFrame:
    """records (id, size, key, ...) with `shard` and `slot`; slots of a shard have no gaps. Sizes must be positive."""
    extra = [c for c in records.columns if c not in ("key", "tie", "row")]
    records = cut(
        records.withColumn("row", F.monotonically_increasing_id()).withColumn("tie", F.xxhash64("id", "row", F.lit(seed)))
    )
    total, rows = records.agg(F.sum("size"), F.count(F.lit(1))).first()
    if not rows:
        return records.select(*extra, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    weight = F.col("size") / (2.0 * total) + 1 / (2.0 * rows)
    drawn = _draw(records, weight, SAMPLES, seed)
    lowest = -(1 << 63)
    splitters = sorted({(drawn[len(drawn) * i // RANGES][0], lowest) for i in range(1, RANGES)}) if drawn else []
    while True:
        ranged = records.withColumn("range", _range_of(splitters)) if splitters else records.withColumn("range", F.lit(0))
        held = {r["range"]: r for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w")).collect()}
        over = {k: r.w for k, r in held.items() if r.w > OVERFULL / RANGES and r.n > 1}
        if not over:
            break
        inside = _draw(ranged.where(F.col("range").isin(list(over))), weight / sum(over.values()), SAMPLES, seed + len(splitters))
        bounds = [(lowest, lowest), *splitters, (1 << 63, 0)]
        fresh: set[tuple[int, int]] = set()
        for k, w in over.items():
            own = [x for x in inside if bounds[k] <= x < bounds[k + 1]]
            parts = int(np.ceil(w * RANGES))
            fresh |= {own[len(own) * i // parts] for i in range(1, parts)} if len(own) >= parts else set(own)
        fresh -= set(splitters)
        if not fresh:
            break  # what is left overfull is one record
        splitters = sorted({*splitters, *fresh})
    offsets, nbytes, nrows = [], 0, 0
    for k in sorted(held):
        offsets.append((k, nbytes, nrows))
        nbytes += held[k]["bytes"]
        nrows += held[k]["n"]
    starts = records.sparkSession.createDataFrame(offsets, "range int, from_byte long, from_row long")
    order = Window.partitionBy("range").orderBy("key", "tie", "row")
    ordered = (
        ranged.withColumn("before", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
        .withColumn("nth", F.row_number().over(order) - 1)
        .join(F.broadcast(starts), "range")
        .withColumn("middle", F.col("from_byte") + F.col("before") + F.expr("size div 2"))
        .withColumn("nth", F.col("from_row") + F.col("nth"))
        # twofold division: no product of bytes and shards can overflow
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.col("middle") / F.lit(total / shards))).cast("int"))
    )
    placed = cut(ordered.select(*extra, "shard", "nth"))
    firsts = placed.groupBy("shard").agg(F.min("nth").alias("first"))  # one row a shard
    return placed.join(F.broadcast(firsts), "shard").select(*extra, "shard", (F.col("nth") - F.col("first")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot): size is the UTF-8 bytes of the text plus 8."""
    text_bytes = F.coalesce(F.col(text), F.lit(""))
    records = docs.select(
        F.col(key).alias("id"),
        (F.octet_length(text_bytes) + 8).cast("long").alias("size"),
        F.crc32(text_bytes.cast("binary")).alias("text_crc32"),
        F.xxhash64(text_bytes).alias("key"),
    )
    return place(records, shards)
