"""Groups of texts of a Jaccard similarity of 0.8 or more on five-word shingles, from SimHash fingerprints.

Two texts of this similarity differ in about 10 of 64 bits of their SimHash, and unrelated ones in 32. A walk of the trie
with such a budget keeps 40 in 100 of all node pairs down to the depth at which a quarter of a million texts part, so its
cost is the square of their number. Candidates come from two kinds of fingerprints instead:

- the SimHash of the whole text, joined by the trie with its small budget;
- BANDS SimHashes of samples: band i takes the least hashes of the text under ROWS permutations of its own. Texts of a
  similarity s agree in all of a band with probability s^ROWS, so of pairs at 0.8 one in 2,700 agrees in no band.

Texts that share a fingerprint are a bucket. Each is compared, by exact Jaccard, with two centres of its bucket: one by a
hash of the band's own, and the text that shares its buckets with the most others, as the origin of edited copies does.
Buckets whose texts are not one group by then are dealt into blocks, and pairs of blocks compare texts of different
groups, so no link of a bucket is lost, no pair is a row, and a bucket of copies costs no pairs. Only shingle sets of
texts that share a bucket are moved.
Texts of equal shingle sets are one text throughout; texts without words are one group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privatrail.llm import simhash_trie
from privatrail.llm.common import add_columns, cut, discard
from privatrail.llm.components import components

BANDS, ROWS = 15, 4
#: Texts and bytes of shingle sets of a block.
BLOCK, BLOCK_BYTES = 128, 1 << 22
_RNG = np.random.default_rng(11)
#: Odd factors and offsets of the permutations.
_FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return np.unique(simhash_trie.shingle_hashes(text, size))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def band_fingerprints(held: np.ndarray) -> list[int]:
    """The SimHash of each band's sample of a set of hashes."""
    if not len(held):
        return [0] * BANDS
    least = np.array([held[_mixed(held * f + o).argmin()] for f, o in zip(_FACTORS, _OFFSETS, strict=True)])
    return [_signed(simhash_trie.majority(least[i : i + ROWS])) for i in range(0, BANDS * ROWS, ROWS)]


def _prints(docs: DataFrame, keep: list[str], text: str, size: int) -> DataFrame:
    def work():
        def made(texts):
            for t in texts:
                hashes = simhash_trie.shingle_hashes(t, size)
                held = np.unique(hashes)
                yield [hashlib.blake2b(held.tobytes(), digest_size=16).digest(), len(held), _signed(simhash_trie.majority(hashes)), band_fingerprints(held)]

        return lambda texts: list(zip(*made(texts), strict=True)) or [[]] * 4

    return add_columns(docs, text, {"sid": "binary", "n": "long", "fp": "long", "bands": "array<long>"}, work, keep)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose sets are as similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common >= similarity * (len(x) + len(y) - common):
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(j).take(pa.array(kept, pa.int64())) for j in (0, 1)], names=["a", "b"])

    met = pairs.join(sets.select(F.col("sid").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("sid").alias("b"), F.col("set").alias("y")), "b")
    return met.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def _between_blocks(similarity: float):
    """Links between texts of different groups in a pair of blocks: a spanning forest of them, over the groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column(0), batch.column(1), strict=True):
                sides = [[(x["sid"], x["label"], np.frombuffer(x["set"], np.uint64)) for x in side.as_py()] for side in (left, right)]
                parent = {x[1]: x[1] for side in sides for x in side}

                def root(x, parent=parent):
                    while parent[x] != x:
                        parent[x] = parent[parent[x]]
                        x = parent[x]
                    return x

                found = []
                for sid, label, x in sides[0]:
                    for other, label2, y in sides[1]:
                        if label == label2 or min(len(x), len(y)) < similarity * max(len(x), len(y)) or root(label) == root(label2):
                            continue
                        common = len(np.intersect1d(x, y, assume_unique=True))
                        if common >= similarity * (len(x) + len(y) - common):
                            parent[root(label2)] = root(label)
                            found.append((sid, other))
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.binary()) for i in (0, 1)], names=["a", "b"])

    return run


def groups(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = 5, similarity: float = 0.8, budget: int = 2) -> DataFrame:
    """The columns `keep` of every row with `sid`, its text's shingle set, and `group`, the least set reachable over pairs
    of a similarity of `similarity` or more."""
    printed = cut(_prints(docs.select(*keep, text), keep, text, shingle))
    nodes = cut(printed.groupBy("sid").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    trie = components(simhash_trie.links(nodes.select("fp").distinct(), budget))
    walked = nodes.join(trie, nodes.fp == trie.node, "left").select("sid", "n", F.lit(BANDS).alias("band"), F.coalesce("component", "fp").alias("value"))
    banded = nodes.select("sid", "n", F.posexplode("bands").alias("band", "value"))
    buckets = cut(walked.unionByName(banded))
    # the centre is the least by a hash of its own in each band; a combining minimum, whatever the bucket's size
    order = F.struct(F.xxhash64("sid", "band").alias("h"), "sid", "n")
    centres = buckets.groupBy("band", "value").agg(F.count(F.lit(1)).alias("held"), F.min(order).alias("c")).where("held > 1")
    shared = cut(buckets.join(centres.select("band", "value", "held", F.col("c.sid").alias("centre"), F.col("c.n").alias("centre_n")), ["band", "value"]))
    # the text that meets the most others in all its buckets
    met = shared.groupBy("sid").agg(F.sum("held").alias("met"))
    origins = shared.join(met, "sid").groupBy("band", "value").agg(F.max(F.struct("met", "sid", "n")).alias("o"))
    origins = shared.join(origins, ["band", "value"]).select("sid", "n", F.col("o.sid").alias("centre"), F.col("o.n").alias("centre_n"))

    def alike(n, m):
        return F.least(n, m) >= similarity * F.greatest(n, m)  # no pair of other sizes is as similar

    stars = shared.select("sid", "n", "centre", "centre_n").unionByName(origins).where((F.col("sid") != F.col("centre")) & alike(F.col("n"), F.col("centre_n")))
    stars = stars.select(F.least("sid", "centre").alias("a"), F.greatest("sid", "centre").alias("b")).distinct()
    wanted = shared.select("sid").distinct()
    # the sets of these texts alone, each once
    involved = printed.join(wanted, "sid", "left_semi").groupBy("sid").agg(F.min(F.struct(*keep)).alias("k")).select("sid", "k.*")
    texts = docs.select(*keep, text).join(involved, keep).dropDuplicates(["sid"])

    def work():
        return lambda values: [[shingle_set(t, shingle).tobytes() for t in values]]

    sets = cut(add_columns(texts, text, {"set": "binary"}, work, ["sid"]))
    first = cut(_verified(stars, sets, similarity))
    found = components(first)
    labelled = cut(shared.join(found, shared.sid == found.node, "left").select("band", "value", "sid", "n", F.coalesce("component", "sid").alias("label")))
    many = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES))
    mixed = labelled.groupBy("band", "value").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), many.alias("many")).where("lo <> hi").select("band", "value", "many")
    rest = labelled.join(mixed, ["band", "value"]).withColumn("block", F.pmod(F.xxhash64("sid", F.lit(29)), F.col("many"))).join(sets, "sid")
    # about BLOCK texts of BLOCK_BYTES in a row
    packed = cut(rest.groupBy("band", "value", "block", "many").agg(F.collect_list(F.struct("sid", "label", "set")).alias("held")))
    right = packed.select("band", "value", F.col("block").alias("other"), F.col("held").alias("held2"))
    later = F.explode(F.sequence(F.col("block"), F.col("many") - 1))
    units = packed.select("band", "value", "held", later.alias("other")).join(right, ["band", "value", "other"])
    second = cut(units.select("held", "held2").mapInArrow(_between_blocks(similarity), "a binary, b binary"))
    merged = components(first.unionByName(second))
    out = cut(printed.join(merged, printed.sid == merged.node, "left").select(*keep, "sid", F.coalesce("component", "sid").alias("group")))
    discard(printed, nodes, buckets, shared, sets, first, labelled, packed, second)
    return out


def representatives(docs: DataFrame, key: str, row: str, text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(key, row): one row of each group, the least by key, then shingle set, then `row`, a hash of the whole row."""
    grouped = groups(docs, [key, row], text, shingle, similarity)
    least = grouped.groupBy("group").agg(F.min(F.struct(key, "sid", row)).alias("first"))
    return least.select(F.col(f"first.{key}").alias(key), F.col(f"first.{row}").alias(row))
