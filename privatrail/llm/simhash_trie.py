"""SimHash near-dedup by a self-join of a binary trie.

The distinct fingerprints form a binary trie over their bits. Pairs of trie nodes of one depth are walked down
together from (root, root): a step of STEP bits goes from each child of one node to the children of the other whose
bits differ in no more places than the pair's remaining budget, and children that hold no fingerprint end the walk. A
pair whose nodes hold few fingerprints is a unit, two leaves: their fingerprints are packed into one row each, and a
task compares them. A unit returns a spanning forest of its links, never its pairs.

Fixed definitions: only A-Z are lower-cased; words are runs of other than the six ASCII blanks; a text of fewer words
than a shingle is one shingle; no words (null, empty, blank): fingerprint zero, which links like any other. Equal
fingerprints are one node of the trie, whatever the number of their documents. Ids that repeat are one document for
the component's number; a null id is left out of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privatrail.llm.common import add_columns, cut, discard
from privatrail.llm.components import components

BITS = 64
STEP = 2
UNIT = 1024
SEED = 42


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """The hash of every shingle, repeats included; none for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    ends = np.cumsum(np.array(list(map(len, words)), np.int64) + 1)
    line = b" ".join(words)
    starts = [0, *ends[: len(words) - size].tolist()]
    stops = (ends[size - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The SimHash of some hashes, as an unsigned integer: a bit is set if it is in over half of them."""
    counts = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), 1 << 16):  # long texts in blocks
        counts += np.unpackbits(hashes[a : a + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def simhash(text: str | None, size: int) -> int:
    """The fingerprint as an unsigned integer."""
    return majority(shingle_hashes(text, size))


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = 3, out: str = "fp") -> DataFrame:
    """The columns `keep` and `out`: the 64 bits as a long (two's complement)."""

    def work():
        return lambda texts: [[x - (1 << 64) if (x := simhash(t, shingle)) >> 63 else x for t in texts]]

    return add_columns(docs, text, {out: "long"}, work, keep)


def _prefix(column: str, depth: int):
    return F.shiftrightunsigned(column, BITS - depth) if depth else F.lit(0).cast("long")


def _units(nodes: DataFrame, budget: int) -> tuple[list[tuple[int, DataFrame]], int]:
    """Pairs of trie nodes (a, b) whose fingerprints may link, by the depth at which both hold at most UNIT."""
    spark = nodes.sparkSession
    masks = [(m, m.bit_count()) for m in range(1 << STEP) if m.bit_count() <= budget]
    steps = F.explode(F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(c).alias("cost")) for m, c in masks]))
    pairs = spark.createDataFrame([(0, 0, 0)], "a long, b long, spent int")
    found: list[tuple[int, DataFrame]] = []
    for depth in range(STEP, BITS + 1, STEP):
        cells = cut(nodes.groupBy(_prefix("fp", depth).alias("cell")).agg(F.count(F.lit(1)).alias("held")))
        left = cells.select(F.col("cell").alias("na"), F.shiftrightunsigned("cell", STEP).alias("a"), F.col("held").alias("ha"))
        right = cells.select(F.col("cell").alias("nb"), F.col("held").alias("hb"))
        walked = pairs.join(left, "a").withColumn("step", steps).where(F.col("spent") + F.col("step.cost") <= budget)
        # the child of b that differs from the child of a in the bits of the mask
        child = F.shiftleft("b", STEP).bitwiseOR(F.col("na").bitwiseAND((1 << STEP) - 1).bitwiseXOR(F.col("step.mask")))
        walked = walked.select("a", "b", "na", "ha", child.alias("nb"), (F.col("spent") + F.col("step.cost")).alias("spent"))
        # both orders of a pair of one node's children come up: keep one
        walked = cut(walked.where((F.col("a") != F.col("b")) | (F.col("na") <= F.col("nb"))).drop("a", "b").join(right, "nb"))
        small = (F.col("ha") <= UNIT) & (F.col("hb") <= UNIT)
        last = depth == BITS
        found.append((depth, walked.where(F.lit(True) if last else small).select("na", "nb", "spent")))
        if last:
            break
        pairs = walked.where(~small).select(F.col("na").alias("a"), F.col("nb").alias("b"), "spent")
        if not pairs.limit(1).count():
            break
    return found, depth


def _forest(a: np.ndarray, b: np.ndarray | None, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the budget between a and b (or inside a): each linked fingerprint and the root of its tree here."""
    points = a if b is None else np.concatenate([a, b])
    parent = list(range(len(points)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    other = a if b is None else b
    shift = 0 if b is None else len(a)
    for i in range(len(a)):
        begin = i + 1 if b is None else 0
        near = np.flatnonzero(np.bitwise_count(other[begin:] ^ a[i]) <= budget)
        if len(near):
            r = root(i)
            for j in (near + begin + shift).tolist():
                s = root(j)
                if s != r:
                    parent[s] = r
    roots = np.array([root(i) for i in range(len(points))], np.int64)
    linked = np.flatnonzero(roots != np.arange(len(points)))
    return points[linked], points[roots[linked]]


def links(nodes: DataFrame, budget: int) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect all those within `budget` differing bits. nodes: fp."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column(0), batch.column(1), strict=True):
                a = np.array(left.as_py(), np.int64).view(np.uint64)
                b = np.array(right.as_py(), np.int64).view(np.uint64)
                same = len(a) == len(b) and bool((a[0] == b).any())
                x, y = _forest(a, None if same else b, budget)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

    found, _ = _units(nodes, budget)
    out = None
    for depth, pairs in found:
        wanted = pairs.select(F.col("na").alias("cell")).union(pairs.select(F.col("nb").alias("cell"))).distinct()
        # at most UNIT fingerprints a cell, by the walk
        packed = cut(nodes.withColumn("cell", _prefix("fp", depth)).join(wanted, "cell").groupBy("cell").agg(F.collect_list("fp").alias("fps")))
        units = pairs.join(packed.select(F.col("cell").alias("na"), F.col("fps").alias("fa")), "na").join(
            packed.select(F.col("cell").alias("nb"), F.col("fps").alias("fb")), "nb"
        )
        part = units.select("fa", "fb").mapInArrow(finish, "a long, b long")
        out = part if out is None else out.unionByName(part)
    return out


def _labelled(nodes: DataFrame, budget: int) -> DataFrame:
    """nodes (fp and others) with `component`, a fingerprint that all nodes linked over others have in common."""
    found = components(links(nodes.select("fp"), budget))
    return nodes.join(found, nodes.fp == found.node, "left").select(*[nodes[c] for c in nodes.columns], F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, budget: int = 2) -> DataFrame:
    """(key, fp, component_id): the smallest id reachable over links of at most `budget` differing bits."""
    printed = cut(fingerprints(docs.select(F.col(key), F.col(text)), [key], text, shingle))
    nodes = cut(printed.groupBy("fp").agg(F.min(key).alias("first")))
    labelled = _labelled(nodes, budget)
    firsts = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    labels = cut(labelled.join(firsts, "component").select("fp", "component_id"))
    return printed.join(labels, "fp").select(key, "fp", "component_id")


def representatives(docs: DataFrame, key: str, row: str, text: str = "text", shingle: int = 3, budget: int = 2) -> DataFrame:
    """(key, row): one row of each component, the least by key, then fingerprint, then `row`, a hash of the whole row.
    Ids may repeat, in one component or in several."""
    printed = fingerprints(docs.select(key, row, text), [key, row], text, shingle)
    nodes = cut(printed.groupBy("fp").agg(F.min(F.struct(F.col(key).alias("key"), F.col("fp").alias("print"), F.col(row).alias("row"))).alias("first")))
    first = _labelled(nodes, budget).groupBy("component").agg(F.min("first").alias("first"))
    return cut(first.select(F.col("first.key").alias(key), F.col("first.row").alias(row)))
