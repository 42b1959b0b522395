"""Line dedup over levelled sorted runs of line hashes, in DataFrame operations only.

Documents come in batches of descending ids. A batch's line hashes, with the number of their documents and the largest
id, are anti-joined (sort-merge) with the runs so far: a hash that is new takes its holder from this batch, a hash
already there only adds to its count. The result is a new sorted run at level 0; LEVEL_RUNS runs of one level are
merged into one of the next. The last merge gives every key's documents and holder.

Defined cases: a null or empty text is one empty line; keys shorter than `min_chars` code points never go; rows that
repeat an id count as one document, and each of them keeps or loses its lines by its own text; a null id is a document
below all others. Further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from privatrail.llm.common import cut, discard

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BATCHES = 4
LEVEL_RUNS = 2
KEY = ["__h1", "__h2"]


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(BLANKS)), UPPER, LOWER)


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(hash, id, row, position) of every line long enough to count; 128 bits by two seeds."""
    exploded = docs.select("__id", "__row", F.posexplode(F.split("__text", "\n")).alias("__pos", "__line"))
    keyed = exploded.select("__id", "__row", "__pos", line_key(F.col("__line")).alias("__key"))
    return keyed.where(F.char_length("__key") >= min_chars).select(
        F.xxhash64("__key").alias("__h1"), F.xxhash64(F.lit(1), "__key").alias("__h2"), "__id", "__row", "__pos"
    )


def _merged(runs: list[DataFrame]) -> DataFrame:
    """One sorted run of several: counts add up, and of the holders the largest stays."""
    table = runs[0]
    for run in runs[1:]:
        table = table.unionByName(run)
    merged = cut(table.groupBy(*KEY).agg(F.sum("__docs").alias("__docs"), F.max("__holder").alias("__holder")).sortWithinPartitions(*KEY))
    discard(*runs)
    return merged


def build_runs(lines: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The documents and the holder of every key. lines: __h1, __h2, __id."""
    shares = [i / batches for i in range(1, batches)]
    bounds = sorted(set(lines.select(F.percentile_approx("__id", shares)).first()[0] or []), reverse=True)
    levels: list[list[DataFrame]] = [[]]
    for i in range(len(bounds) + 1):
        batch = lines
        if i > 0:
            batch = batch.where(F.col("__id") < bounds[i - 1])
        if i < len(bounds):
            batch = batch.where(F.col("__id") >= bounds[i])
        # distinct per document first, so that a line of a third of all documents is counted in parallel
        mine = batch.select(*KEY, "__id").distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("__docs"), F.max("__id").alias("__holder"))
        earlier = [run.select(*KEY) for level in levels for run in level]
        if earlier:
            mine = cut(mine)
            fresh = mine
            for run in earlier:
                fresh = fresh.join(run, KEY, "left_anti")
            again = mine
            fresh = fresh.withColumn("__new", F.lit(True)).select(*KEY, "__new")
            mine = again.join(fresh, KEY, "left").select(*KEY, "__docs", F.when(F.col("__new"), F.col("__holder")).alias("__holder"))
        levels[0].append(cut(mine.sortWithinPartitions(*KEY)))
        if earlier:
            discard(again)
        for depth in range(len(levels)):
            if len(levels[depth]) >= LEVEL_RUNS:
                if depth + 1 == len(levels):
                    levels.append([])
                levels[depth + 1].append(_merged(levels[depth]))
                levels[depth] = []
    runs = [run for level in levels for run in level]
    return runs[0] if len(runs) == 1 else _merged(runs)


def dedup_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3, batches: int = BATCHES
) -> DataFrame:
    """docs with `kept_text`, `n_lines` (before) and `n_dropped`: lines whose key is in `min_docs` documents or more
    stay only in the largest id that holds it."""
    rest = [c for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")]
    # other columns pass under names of their own, so that none meets a name used here
    docs = docs.select(
        *[F.col(f"`{c}`").alias(f"x_{c}") for c in rest],
        F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("__id"),
        F.coalesce(F.col(text), F.lit("")).alias("__text"),
    ).withColumn("__row", F.xxhash64("__text"))
    lines = cut(_lines(docs, min_chars))
    common = build_runs(lines, batches).where(F.col("__docs") >= min_docs).select(*KEY, "__holder")
    dropped = (
        lines.join(common, KEY)
        .where(F.col("__id") != F.col("__holder"))
        .groupBy("__id", "__row")
        .agg(F.collect_set("__pos").alias("__gone"))
    )
    split = F.split("__text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("__gone"))
    kept_text = F.when(F.col("__gone").isNull(), F.col("__text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(F.col("__split"), i)), "\n")
    )
    joined = docs.join(dropped, ["__id", "__row"], "left").withColumn("__split", split)
    made = joined.select(
        *[F.col(f"`x_{c}`") for c in rest],
        kept_text.alias("kept_text"),
        F.size("__split").cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    return made.select(*[F.col(f"`x_{c}`").alias(c) for c in rest], "kept_text", "n_lines", "n_dropped")


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, h.key IS NOT NULL AND k.doc_id <> h.holder AS gone FROM k LEFT JOIN h USING (key))
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""
