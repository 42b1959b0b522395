"""A Merkle manifest of a dataset: a binary hash tree per group of rows, one over the groups, and a proof per row.

H is the lowercase hex SHA-256 of its inputs concatenated, digests as hex text. A row's leaf is H of its fields; a
group's leaves ascend by key, and while several nodes remain, every two neighbours (at last one alone) become their H.
Trees are hashed in blocks of 2^BLOCK_BITS neighbours, so a tree of any size takes a few rounds.

Proofs by pointer jumping: a node holds a pointer to an ancestor and the segment of siblings up to it, at first its
parent and its own sibling. Every round joins the nodes to themselves on the pointer and appends the ancestor's segment,
which doubles the distance, until every leaf points at the root. Ancestors of more than a HOT-th of all rows are at most
HOT a level whatever the table's size, and are broadcast; any other key has fewer rows than that.

Results on odd input: a null field counts as `-`, an empty one as `0:`; rows with a null key come first in their group;
rows of one key go by their leaves, and repeated rows are leaves of their own; a null group is a group, the first; a
group of one row has its leaf for a root, and one group's root is the whole one; an empty table has no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from privatrail.llm.common import cut, discard
from privatrail.llm.ordering import AT, PART, place

BLOCK_BITS = 10
HOT = 256
#: The tree over the groups; names of the others begin with another character.
TOP = ""
NODE = ["tree", "level", "idx"]
#: A sibling in a segment: its side (left, right, none) and digest, 33 bytes.
LEFT, RIGHT, ALONE = b"L", b"R", b"N"
STEP = 33


def field(column: Column) -> Column:
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def _block(hashes: list[bytes], weights: list[int], whole: bool, bits: int) -> Iterator[tuple[int, int, bytes | None, int, int, bytes]]:
    """(level, place, own sibling or None at the top, rows below it and below its parent, digest) of every node over one
    block of 2^bits nodes. A whole tree ends at its root; part of one takes all levels of a block."""
    level = 0
    while (len(hashes) > 1) if whole else level < bits:
        for i, (h, w) in enumerate(zip(hashes, weights, strict=True)):
            j = i ^ 1
            yield level, i, (ALONE + bytes(32) if j >= len(hashes) else (LEFT if j < i else RIGHT) + hashes[j]), w, sum(weights[i & -2 : (i & -2) + 2]), h
        pairs = range(0, len(hashes), 2)
        hashes = [hashlib.sha256("".join(h.hex() for h in hashes[i : i + 2]).encode()).digest() for i in pairs]
        weights = [sum(weights[i : i + 2]) for i in pairs]
        level += 1
    yield level, 0, None, weights[0], weights[0], hashes[0]


def _grow(leaves: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Nodes below the roots (NODE, seg, weight, at_weight) and the roots (tree, level, hash, weight) of the trees over `leaves`
    (tree, idx, hash, weight, size; at most `most` a tree)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tree, level, block, size, held in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                hashes, weights = [x["hash"] for x in held], [x["weight"] for x in held]
                for up, i, seg, weight, above, digest in _block(hashes, weights, size <= 1 << BLOCK_BITS, BLOCK_BITS):
                    top = seg is None
                    rows.append((tree, level + up, (block << (BLOCK_BITS - up)) + i, seg, weight, above, digest if top else None, -(-size >> up) if top else None))
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            types = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[*NODE, "seg", "weight", "at_weight", "hash", "size"])

    nodes, roots, level, now = [], [], 0, leaves
    while True:
        blocks = now.groupBy("tree", F.shiftright("idx", BLOCK_BITS).alias("block")).agg(
            F.sort_array(F.collect_list(F.struct("idx", "hash", "weight"))).alias("held"), F.max("size").alias("size")
        )
        blocks = blocks.select("tree", F.lit(level).alias("level"), "block", "size", "held")
        made = cut(blocks.mapInArrow(run, "tree string, level int, idx long, seg binary, weight long, at_weight long, hash binary, size long"))
        nodes.append(made.where(F.col("hash").isNull()).select(*NODE, "seg", "weight", "at_weight"))
        tops = made.where(F.col("hash").isNotNull())
        roots.append(tops.where(F.col("size") == 1).select("tree", "level", "hash", "weight"))
        most = -(-most >> BLOCK_BITS)
        if most <= 1:
            break
        # the top of a block is a node of the next round, at its block's place
        now = tops.where(F.col("size") > 1).select("tree", "idx", "hash", "weight", "size")
        level += BLOCK_BITS
    union = nodes[0]
    for more in nodes[1:]:
        union = union.unionByName(more)
    rooted = roots[0]
    for more in roots[1:]:
        rooted = rooted.unionByName(more)
    return union, rooted


def _jump(rows: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """rows, each moved on to where the node it points at points, with that node's segment behind its own."""
    side = nodes.select(*[F.col(c).alias(f"at_{c}") for c in NODE], *[F.col(c).alias(f"to_{c}") for c in ("at_tree", "at_level", "at_idx", "at_weight", "seg", "crossed")], "weight")
    keys = [f"at_{c}" for c in NODE]
    heavy = F.col("at_weight") * HOT > total
    # at most HOT such nodes a level, and a level's segments are as long as the trees are high
    few = F.broadcast(side.where(F.col("weight") * HOT > total).drop("weight"))
    joined = rows.where(heavy).join(few, keys, "left").unionByName(rows.where(~heavy).join(side.drop("weight"), keys, "left"))
    moved = F.col("to_at_tree").isNotNull()
    rest = [c for c in rows.columns if c not in (*keys, "at_weight", "seg", "crossed")]
    return joined.select(
        *rest,
        *[F.when(moved, F.col(f"to_{c}")).otherwise(F.col(c)).alias(c) for c in (*keys, "at_weight")],
        F.when(moved, F.concat("seg", "to_seg")).otherwise(F.col("seg")).alias("seg"),
        F.coalesce("crossed", F.when(moved, F.col("to_crossed"))).alias("crossed"),
    )


def _folded(start: Column, seg: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    steps = F.when(F.length(seg) > 0, F.transform(F.sequence(F.lit(0), (F.length(seg) / STEP - 1).cast("int")), lambda i: F.substring(seg, i * STEP + 1, F.lit(STEP))))
    steps = F.coalesce(steps, F.array().cast("array<binary>"))

    def up(now: Column, x: Column) -> Column:
        side, other = F.substring(x, 1, 1), F.lower(F.hex(F.substring(x, 2, 32)))
        return F.sha2(F.when(side == F.lit(LEFT), F.concat(other, now)).when(side == F.lit(RIGHT), F.concat(now, other)).otherwise(now), 256)

    return F.aggregate(steps, start, up)


def _siblings(seg: Column) -> Column:
    """The digests of a segment as hex text, from the leaf up."""
    steps = F.transform(F.sequence(F.lit(0), (F.length(seg) / STEP - 1).cast("int")), lambda i: F.substring(seg, i * STEP + 1, F.lit(STEP)))
    met = F.filter(steps, lambda x: F.substring(x, 1, 1) != F.lit(ALONE))
    return F.when(F.length(seg) > 0, F.array_join(F.transform(met, lambda x: F.lower(F.hex(F.substring(x, 2, 32)))), "")).otherwise("")


def prove(rows: DataFrame, group: str, key: str) -> DataFrame:
    """rows (with `leaf`, hex) and `subroot`, `root` and `seg`, the siblings from the leaf up to the root."""
    keep = rows.columns
    name = F.col(group).cast("string")
    # a long group name moves as its digest
    tree = F.when(name.isNull(), "-").when(F.octet_length(name) <= 32, F.concat(F.lit("="), name)).otherwise(F.concat(F.lit("#"), F.sha2(name, 256)))
    placed, groups = place(rows.withColumn("tree", tree), ["tree"], [F.col(key).asc_nulls_first(), F.col("leaf")])
    sizes = groups.agg(F.max("size").alias("most"), F.sum("n").alias("total")).first()
    if not sizes["total"]:
        return rows.select(*keep, *[F.lit(None).cast(t).alias(c) for c, t in (("subroot", "string"), ("root", "string"), ("seg", "binary"))])
    total = sizes["total"]
    idx = F.col(AT) - F.col("first") + F.col("before")
    leaves = cut(placed.join(groups.select("tree", PART, "first", "before", "size"), ["tree", PART]).select(*keep, "tree", idx.alias("idx"), "size"))
    discard(placed)
    nodes, roots = _grow(leaves.select("tree", "idx", F.unhex("leaf").alias("hash"), F.lit(1).cast("long").alias("weight"), "size"), sizes["most"])
    named = leaves.groupBy("tree").agg(F.min(group).alias("__name"))
    ordered, parts = place(roots.join(named, "tree"), [], [F.col("__name").asc_nulls_first()])
    ordered = cut(ordered.join(parts, [PART]).select("tree", "level", "hash", "weight", (F.col(AT) - F.col("first") + F.col("before")).alias("rank"), F.col("size")))
    trees = ordered.agg(F.max("size").alias("n"), F.max("level").alias("high")).first()
    above, root = _grow(ordered.select(F.lit(TOP).alias("tree"), F.col("rank").alias("idx"), "hash", "weight", "size"), trees["n"])
    whole = root.first()

    up = [F.col("tree").alias("at_tree"), (F.col("level") + 1).alias("at_level"), F.shiftright("idx", 1).alias("at_idx")]
    steps = nodes.unionByName(above).select(*NODE, *up, "seg", "weight", "at_weight", F.lit(None).cast("string").alias("crossed"))
    # a group's root is a leaf of the upper tree: no step of its own, and where the group's root is noted
    bridge = ordered.select(
        "tree", "level", F.lit(0).cast("long").alias("idx"), F.lit(TOP).alias("at_tree"), F.lit(0).alias("at_level"), F.col("rank").alias("at_idx"),
        F.lit(b"").alias("seg"), "weight", F.col("weight").alias("at_weight"), F.lower(F.hex("hash")).alias("crossed"),
    )
    pointers = cut(steps.unionByName(bridge))
    at = ["at_tree", "at_level", "at_idx", "at_weight", "seg", "crossed"]
    first = pointers.where((F.col("level") == 0) & (F.col("tree") != TOP)).select("tree", "idx", *at)
    trail = cut(leaves.drop("size").join(first, ["tree", "idx"]).drop("tree", "idx"))
    discard(leaves)

    height, distance = trees["high"] + 1 + whole["level"], 1
    while distance < height:
        # what a leaf points at lies `distance` above it or in the upper tree
        further = cut(_jump(trail, pointers, total))
        discard(trail)
        trail = further
        distance *= 2
        if distance < height:
            doubled = _jump(pointers, pointers, total).where((F.col("level") % distance == 0) | (F.col("tree") == TOP))
            doubled = cut(doubled)
            discard(pointers)
            pointers = doubled
    return trail.select(*keep, F.col("crossed").alias("subroot"), F.lit(whole["hash"].hex()).alias("root"), "seg")


def manifest(docs: DataFrame, fields: list[str], group: str, key: str, altered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """Every row's key, leaf, subroot, root, proof_sha256 and, for a copy of the data in which the rows `where` have the
    columns `altered`, the root that the row and its proof lead to: `folded_root`, `verified` if it is the root."""
    columns = [F.col(f) for f in fields]
    changed = F.when(where, leaf([(altered or {}).get(f, F.col(f)) for f in fields])) if where is not None else F.lit(None).cast("string")
    rows = docs.select(F.col(key).alias(key), F.col(group).alias(group), leaf(columns).alias("leaf"), changed.alias("changed"))
    proved = prove(rows, group, key).withColumn("folded_root", _folded(F.coalesce("changed", "leaf"), F.col("seg")))
    return proved.select(
        key, "leaf", "subroot", "root", F.sha2(_siblings(F.col("seg")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def _field_sql(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"


def oracle(crc32: str) -> str:
    """SQL of the manifest of `documents` in which n_chars is one more wherever 7 divides crc32(doc_id)."""
    fields = " || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    changed = " || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", "(n_chars + 1)", "text"))
    side = "CASE WHEN i % 2 = 1 THEN 'L' || lag(h) OVER w ELSE coalesce('R' || lead(h) OVER w, 'N') END"

    def tree(name: str, leaves: str) -> str:
        return f"""{name} AS (SELECT * FROM {leaves} UNION ALL
          SELECT g, l + 1, i // 2, n, sha256(h || coalesce(nx, '')), NULL FROM
            (SELECT g, l, i, n, h, lead(h) OVER (PARTITION BY g ORDER BY i) AS nx, max(i) OVER (PARTITION BY g) AS m FROM {name}) WHERE m > 0 AND i % 2 = 0)"""

    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, lang, sha256({fields}) AS leaf,
    CASE WHEN {crc32.format("doc_id")} % 7 = 0 THEN sha256({changed}) END AS changed FROM documents),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    coalesce('=' || lang, '-') AS g, count(*) OVER (PARTITION BY lang) AS n FROM d),
a0 AS (SELECT g, 0 AS l, i, n, leaf AS h, NULL AS z FROM o),
{tree("a", "a0")},
ra AS MATERIALIZED (SELECT g, arg_max(h, l) AS subroot, max(l) AS high FROM a GROUP BY g),
b0 AS (SELECT '' AS g, 0 AS l, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n, subroot AS h, NULL AS z
    FROM (SELECT DISTINCT lang, coalesce('=' || lang, '-') AS g FROM d) JOIN ra USING (g)),
{tree("b", "b0")},
rb AS (SELECT arg_max(h, l) AS root, max(l) AS high FROM b),
sa AS MATERIALIZED (SELECT g, l, i, {side} AS s FROM a WINDOW w AS (PARTITION BY g, l ORDER BY i)),
sb AS MATERIALIZED (SELECT l, i, {side} AS s FROM b WINDOW w AS (PARTITION BY l ORDER BY i)),
k AS (SELECT b0.i AS k, ra.g, ra.subroot, ra.high FROM b0 JOIN ra ON ra.subroot = b0.h),
steps AS (SELECT o.g, o.i, sa.l, sa.s FROM o JOIN ra USING (g) JOIN sa ON sa.g = o.g AND sa.l < ra.high AND sa.i = o.i >> sa.l
    UNION ALL SELECT o.g, o.i, 1000 + sb.l, sb.s FROM o JOIN k USING (g) JOIN rb ON true JOIN sb ON sb.l < rb.high AND sb.i = k.k >> sb.l),
p AS (SELECT g, i, list(s ORDER BY l) AS ss FROM steps GROUP BY ALL),
f AS (SELECT o.doc_id, o.leaf, ra.subroot, rb.root, coalesce(ss, []) AS ss, coalesce(o.changed, o.leaf) AS start
    FROM o JOIN ra USING (g) JOIN rb ON true LEFT JOIN p USING (g, i)),
v AS (SELECT *, list_reduce([start] || ss, lambda acc, x: sha256(CASE x[1] WHEN 'L' THEN x[2:] || acc WHEN 'R' THEN acc || x[2:] ELSE acc END)) AS folded_root FROM f)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(list_filter(ss, lambda x: x <> 'N'), lambda x: x[2:]), '')) AS proof_sha256,
    folded_root, folded_root = root AS verified FROM v
"""
