"""The trie of conversation prefixes, rolled up in depth bands.

A node is a distinct sequence of a conversation's first turns. Its number is the sum, in 128 bits, of the hashes of
(depth, turn) along the path, so paths of any length are numbered by running sums. Rollup: bands are FAN deep, and a
node explodes only to its ancestors in its own band, FAN rows at most. A band root's total inside its band then stands
for the band, and the band roots, a trie a FAN-th as deep, are rolled up in the same way; their completed totals come
back down to the ancestors in the band above. A trie of depth D needs log(D) / log(FAN) rounds, and no round makes more
than FAN rows of one.

Results on odd input: a null turn comes first, rows of one turn go by the SHA-256 of role and text, and repeated rows
all count; a null role or text is empty; rows with a null conversation id belong to no conversation and make none; a
conversation all of whose turns go in rebuilding is a member of the root alone; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from privatrail.llm.common import cut, discard
from privatrail.llm.ordering import AT, PART, place, running

FAN = 8
#: Conversations that share a start: ids that lie this far from a multiple of it.
FAMILY = 5
SHARED = 9
#: A chunk of a node's list of ends holds ids that agree above this many bits.
CHUNK_BITS = 12
ID = ["depth", "p1", "p2"]


def turn_digest(role: str = "role", text: str = "text") -> Column:
    """SHA-256 of a turn; the role's length keeps role and text apart."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def _shared(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % SHARED


def _length(conv: Column, n: Column, base: Column) -> Column:
    return F.least(_shared(conv), base) + F.greatest(F.lit(0), n - _shared(conv))


def rebuild(conversations: DataFrame) -> tuple[DataFrame, int]:
    """(conv, depth, digest, bytes, length) of every turn of every rebuilt conversation, and a row of depth 0 for each;
    the greatest length. Conversation c begins with the first crc32(c) % 9 turns of conversation c - c % 5 and goes on
    with its own turns behind as many. Texts stay where they are: only digests and sizes move."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"), turn_digest().alias("digest"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"),
    )
    placed, groups = place(rows, ["conv"], [F.col("turn").asc_nulls_first(), F.col("digest")])
    base = F.col("conv") - F.col("conv") % FAMILY
    convs = groups.groupBy("conv").agg(F.max("size").alias("n"))
    # at most nine ids share a base, whatever the table
    families = convs.groupBy(base.alias("base")).agg(
        F.collect_list(F.struct("conv", "n")).alias("members"), F.coalesce(F.max(F.when(F.col("conv") == base, F.col("n"))), F.lit(0)).alias("base_n")
    )
    info = cut(groups.withColumn("base", base).join(families, "base"))
    discard_later = [placed, groups]
    longest = info.select(F.max(_length(F.col("conv"), F.col("size"), F.col("base_n"))).alias("n")).first()["n"] or 0

    pos = F.col(AT) - F.col("first") + F.col("before")
    turns = placed.join(info.drop("n"), ["conv", PART]).withColumn("pos", pos)
    lent = F.transform(
        F.filter("members", lambda m: _shared(m["conv"]) > F.col("pos")),
        lambda m: F.struct(m["conv"].alias("conv"), (F.col("pos") + 1).alias("depth"), _length(m["conv"], m["n"], F.col("base_n")).alias("length")),
    )
    h = _shared(F.col("conv"))
    own = F.array(
        F.struct("conv", (F.least(h, F.col("base_n")) + F.col("pos") - h + 1).alias("depth"), _length(F.col("conv"), F.col("size"), F.col("base_n")).alias("length"))
    )
    none = F.array().cast("array<struct<conv:bigint,depth:bigint,length:bigint>>")
    to = F.concat(F.when((F.col("conv") == F.col("base")) & (F.col("pos") < SHARED - 1), lent).otherwise(none), F.when(F.col("pos") >= h, own).otherwise(none))
    turns = turns.select("digest", "bytes", F.explode(to).alias("to")).select("to.conv", "to.depth", "digest", "bytes", "to.length")
    roots = info.where(F.col("before") == 0).select(
        "conv", F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("bytes"),
        _length(F.col("conv"), F.col("size"), F.col("base_n")).alias("length"),
    )
    out = cut(turns.unionByName(roots))
    discard(*discard_later, info)
    return out, longest


def paths(turns: DataFrame, longest: int) -> DataFrame:
    """turns (conv, depth from 0 without gaps, digest, bytes, length) with the node of each prefix (p1, p2) and its
    parent's (q1, q2; null at the root)."""
    halves = [F.xxhash64(F.lit(seed), F.col("depth"), F.col("digest")) for seed in (1, 2)]
    low = (1 << 32) - 1
    # four words of 32 bits, whose sums over 2^31 turns do not overflow
    words = {"a1": F.shiftrightunsigned(halves[0], 32), "b1": halves[0].bitwiseAND(low), "a2": F.shiftrightunsigned(halves[1], 32), "b2": halves[1].bitwiseAND(low)}
    words = {k: F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(v) for k, v in words.items()}
    hashed = turns.select("conv", "depth", "bytes", "length", *[v.alias(k) for k, v in words.items()], *[v.alias(f"own_{k}") for k, v in words.items()])
    summed = running(hashed, ["conv"], "depth", list(words), longest)

    def joined(a: Column, b: Column) -> Column:
        return F.shiftleft(a.bitwiseAND(low), 32).bitwiseOR(b.bitwiseAND(low))

    below = F.col("depth") > 0
    return cut(
        summed.select(
            "conv", "depth", "bytes", (F.col("depth") == F.col("length")).alias("ends"),
            joined(F.col("a1"), F.col("b1")).alias("p1"), joined(F.col("a2"), F.col("b2")).alias("p2"),
            F.when(below, joined(F.col("a1") - F.col("own_a1"), F.col("b1") - F.col("own_b1"))).alias("q1"),
            F.when(below, joined(F.col("a2") - F.col("own_a2"), F.col("b2") - F.col("own_b2"))).alias("q2"),
        )
    )


def _chains(steps: DataFrame, level: int, extra: list[str]) -> DataFrame:
    """Rows whose depth is a multiple of FAN^level with `above`: the nodes over them in their band of FAN such rows,
    from the band's root down, as p1 and p2 in turn. A band root at depth d > 0 ends the band above it."""
    step = FAN**level
    span = step * FAN
    band = F.floor(F.col("depth") / span)
    bands = F.when((F.col("depth") % span == 0) & (F.col("depth") > 0), F.array(band - 1, band)).otherwise(F.array(band))
    rows = steps.where(F.col("depth") % step == 0).withColumn("band", F.explode(bands))
    runs = rows.groupBy("conv", "band").agg(F.sort_array(F.collect_list(F.struct("depth", "p1", "p2", *extra))).alias("run"))  # FAN + 1 at most
    spread = runs.select("conv", "run", F.posexplode("run").alias("i", "x")).where((F.col("i") > 0) | (F.col("x.depth") == 0))
    over = F.flatten(F.transform(F.slice("run", F.lit(1), F.col("i")), lambda x: F.array(x["p1"], x["p2"])))
    return spread.select("conv", *[F.col(f"x.{c}").alias(c) for c in [*ID, *extra]], over.alias("above"))


def _lifted(rows: DataFrame, level: int, first: int) -> DataFrame:
    """The sums of each row (leaves, saved) for its ancestors `above` from the first-th on, by node."""
    step = FAN**level
    top = F.floor((F.col("depth") - 1) / (step * FAN)) * step * FAN
    spread = rows.select(top.alias("top"), "above", "leaves", "saved", F.explode(F.sequence(F.lit(0), (F.size("above") / 2 - 1).cast("int"))).alias("i"))
    spread = spread.where(F.col("i") >= first)
    return spread.select((F.col("top") + F.col("i") * step).cast("long").alias("depth"), F.get("above", 2 * F.col("i")).alias("p1"),
                         F.get("above", 2 * F.col("i") + 1).alias("p2"), "leaves", "saved")


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*ID).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def roll_up(weights: DataFrame, steps: DataFrame, longest: int) -> DataFrame:
    """(ID, leaves, saved) over every node's subtree. weights: ID, leaves, saved, and `above` of level 0."""
    part: list[DataFrame] = []
    above: list[DataFrame] = [weights.select(*ID, "above")]
    level = 0
    while True:
        span = FAN ** (level + 1)
        if level:
            above.append(cut(_chains(steps, level, []).groupBy(*ID).agg(F.first("above").alias("above"))))
            weights = part[-1].where(F.col("depth") % FAN**level == 0).join(above[-1], ID)
        # a band root below the top stands for its own band only: what it holds reaches the band above when complete
        inner = weights.where((F.col("depth") % span != 0) & (F.size("above") > 0))
        part.append(cut(_summed(weights.select(*ID, "leaves", "saved").unionByName(_lifted(inner, level, 0)))))
        if span > longest:
            break
        level += 1
    total = part[-1]
    for level in range(level - 1, -1, -1):
        span = FAN ** (level + 1)
        roots = total.where(F.col("depth") > 0).join(above[level], ID)
        rest = part[level].where(F.col("depth") % span != 0)
        total = cut(total.unionByName(_summed(rest.unionByName(_lifted(roots, level, 1)))))
    return total


def _ends(steps: DataFrame) -> DataFrame:
    """(ID, ends_sha256): the hash of the ids that end at each node, ascending. Ids are gathered by chunks of
    2^CHUNK_BITS neighbouring numbers, and a node's chunks stream through the hash one after another."""
    chunks = steps.where("ends").groupBy(*ID, F.shiftright("conv", CHUNK_BITS).alias("chunk")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, done = None, None, []

        def out(rows):
            columns = list(zip(*[(*k, d) for k, d in rows], strict=True)) or [[]] * 4
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[*ID, "ends_sha256"])

        for batch in batches:
            for depth, p1, p2, _, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (depth, p1, p2) != now:
                    if now is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = (depth, p1, p2), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield out(done)
            done = []
        yield out([(now, digest.hexdigest())] if now is not None else [])

    dealt = chunks.repartition(*ID).sortWithinPartitions(*ID, "chunk").select(*ID, "chunk", "ids")
    return dealt.mapInArrow(run, "depth long, p1 long, p2 long, ends_sha256 string")


def trie(turns: DataFrame, longest: int) -> DataFrame:
    """One row per node of the trie over `turns` (see `paths`): conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens (over the subtree, members but one times the last text's bytes) and ends_sha256."""
    steps = paths(turns, longest)
    nodes = _chains(steps, 0, ["bytes", "q1", "q2"]).groupBy(*ID).agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"),
        F.max("q1").alias("q1"), F.max("q2").alias("q2"), F.first("above").alias("above"),
    )
    nodes = cut(nodes)
    children = nodes.where(F.col("depth") > 0).groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes_with = cut(nodes.join(children, ID, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    weights = nodes_with.select(*ID, "above", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    total = roll_up(weights, steps, longest)
    over = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return (
        nodes_with.drop("above").join(total, ID).join(_ends(steps), ID, "left").join(over, ["depth", "q1", "q2"], "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"))
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations (conv_id, turn, role, text)."""
    return trie(*rebuild(conversations))


#: crc32 of a decimal number, for DuckDB, which has no such function.
CRC32 = """xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(1, strlen({0}::VARCHAR) + 1), lambda i: ord(substr({0}::VARCHAR, i, 1))::BIGINT),
    lambda acc, b: list_reduce([xor(acc, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda s, z: xor(s >> 1, 3988292384 * (s & 1)))))"""

ORACLE = f"""
WITH o AS (SELECT conv_id AS c, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS p FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, count(*) AS n, {CRC32.format("c")} % {SHARED} AS h FROM o GROUP BY c),
k AS (SELECT n.c, n.n, n.h, n.c - n.c % {FAMILY} AS base, coalesce(b.n, 0) AS bn FROM n LEFT JOIN n b ON b.c = n.c - n.c % {FAMILY}),
r AS (SELECT k.c, p + 1 AS d, role, text FROM k JOIN o ON o.c = k.base AND p < k.h
      UNION ALL SELECT k.c, least(h, bn) + p - h + 1, role, text FROM k JOIN o ON o.c = k.c AND p >= h),
w AS (SELECT c, d, strlen(coalesce(text, '')) AS b, sha256(string_agg(sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), '')
      OVER (PARTITION BY c ORDER BY d)) AS s FROM r
      UNION ALL SELECT c, 0, 0, '' FROM k),
e AS (SELECT c, d, b, s, lead(d) OVER (PARTITION BY c ORDER BY d) IS NULL AS last, lag(s) OVER (PARTITION BY c ORDER BY d) AS up FROM w),
v AS (SELECT d, s, min(c) AS conv_id, count(*) AS n_convs, max(b) AS b, max(up) AS up,
      sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE last), '')) AS ends FROM e GROUP BY d, s),
ch AS (SELECT d - 1 AS d, up AS s, count(*) AS n FROM v WHERE d > 0 GROUP BY ALL),
x AS (SELECT v.*, coalesce(ch.n, 0) AS n_children FROM v LEFT JOIN ch USING (d, s)),
t AS (SELECT e.d, e.s, count(*) FILTER (WHERE x.n_children = 0) AS n_leaves, sum((x.n_convs - 1) * x.b) AS saved
      FROM x JOIN e ON e.c = x.conv_id AND e.d <= x.d GROUP BY e.d, e.s)
SELECT x.conv_id, x.d::BIGINT AS depth, p.conv_id AS parent_conv_id, x.n_convs::BIGINT AS n_convs, x.n_children::BIGINT AS n_children,
    t.n_leaves::BIGINT AS n_leaves, t.saved::BIGINT AS saved_tokens, x.ends AS ends_sha256
FROM x JOIN t USING (d, s) LEFT JOIN v p ON p.d = x.d - 1 AND p.s = x.up
"""
